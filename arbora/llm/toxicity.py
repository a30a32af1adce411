"""Toxicity from misspelled lexicon terms and what stands around them.

The lexicon is learned from labelled rows: words, and stems of many words, that occur in toxic documents more often than chance allows.  It is
held as a trie.  A word of a text is compared by
running its Levenshtein automaton (a state is the row of edit distances after the characters read so far) along the trie and leaving a
branch when no cell is within the edits allowed (one; two for terms of ``LONG_TERM`` characters or more, which takes in swapped letters); so
``w0rthless`` and ``wrothless`` reach ``worthless`` without a list of misspellings.  A word that clean documents use too is never a
misspelling (but for words that toxic ones use more often than chance allows), and a term with ``CROWDED`` or more such neighbours is matched only as it is.  Each hit gets a context score from
a window of ``SPAN`` words on either side: quotation marks and words of report speak for a quotation, address of a person for abuse.
A logistic regression on the hits' sums gives the score.

The sample for fitting is bounded by ``SAMPLE_ROWS``, and a sampled text longer than ``SAMPLE_CHARS`` is read in a window from a place picked by
hash; scores are of whole texts.  Rows are scored each for itself, so repeated rows score alike; an empty table gives an empty result; a column
called ``score`` is replaced, all others stay.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import documents, slices
from arbora.llm.language import held_out
from arbora.llm.sample import labelled_sample

SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
#: Lexicon terms at most, their least length, and how many terms of pure chance are expected at a document count that is let in.
TERMS, TERM_CHARS, BY_CHANCE = 400, 4, 0.3
#: Lengths of stems, and the least number of different words that a stem stands for.
STEM_CHARS, STEM_WORDS = (4, 5, 6), 4
#: Least log-odds of a word and of a stem.
TERM_ODDS, STEM_ODDS = 2.5, 4.0
#: What a misspelled hit counts of an exact one.
MISSPELLED = 0.7
EDITS = 1
#: Terms of this length may be misspelled twice.
LONG_TERM = 8
#: A term with this many ordinary words near it is not matched misspelled.
CROWDED = 2
SPAN = 4
THRESHOLD = 0.7
CACHE = 200_000
_STRIP = ".,;:!?\"'()[]{}#*$%&|<>“”„«»‘’…"
# Cues in the languages of the corpus.
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
REPORTING = frozenset("said says wrote quoted quote called word term phrase sagte schrieb nannte wort dit écrit mot dijo escribió palabra".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dein deine dich ihr tu toi ton ta vous votre tú eres tus usted".split())
# Characters that stand in for letters.
LEET = str.maketrans("013457@$", "oieastas")


def edits_of(term: str) -> int:
    return EDITS + (len(term) >= LONG_TERM)


class Trie:
    """A lexicon as nested dicts; the empty string's entry is the term's index."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.limit = [edits_of(t) for t in terms]
        # Of a term cut into one part more than it may have edits, a word within these edits holds a part as it is.
        self.parts: dict[int, set[str]] = {}
        for i, term in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = i
            k = self.limit[i] + 1
            cuts = [len(term) * j // k for j in range(k + 1)]
            for n in range(len(term) - self.limit[i], len(term) + self.limit[i] + 1):
                self.parts.setdefault(n, set()).update(term[x:y] for x, y in pairwise(cuts))
        self.sizes = {n: sorted({len(x) for x in found}) for n, found in self.parts.items()}

    def may_match(self, word: str) -> bool:
        """Whether ``word`` may be within a term's edits."""
        parts = self.parts.get(len(word))
        return parts is not None and any(word[i : i + k] in parts for k in self.sizes[len(word)] for i in range(len(word) - k + 1))

    def nearest(self, word: str) -> tuple[int, int] | None:
        """(distance, term index) of the nearest term within its edits, the least index among equals."""
        best: tuple[int, int] | None = None
        most = max(self.limit, default=0)
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            if "" in node and row[-1] <= self.limit[node[""]]:
                found = row[-1], node[""]
                best = found if best is None else min(best, found)
            for c, child in node.items():
                if c:
                    new = [row[0] + 1]
                    for j, w in enumerate(word, 1):
                        new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != c)))
                    if min(new) <= (most if best is None else best[0]):
                        stack.append((child, new))
        return best


class Toxicity:
    """The lexicon with each term's weight, and the regression.  ``terms`` that end in ``*`` are stems; those in ``strict`` are not matched misspelled, and the words ``ordinary`` are no misspellings."""

    def __init__(self, terms: list[str], odds: list[float], strict: frozenset[int] = frozenset(), ordinary: frozenset[str] = frozenset()):
        self.terms, self.odds, self.strict, self.ordinary = terms, odds, strict, ordinary
        self.index = {t: i for i, t in enumerate(terms)}
        self.whole = [t for t in terms if t[-1] != "*"]
        # Terms that are only matched as they are stay out of the trie, so that they hide no other term.
        self.spelled = [t for t in self.whole if self.index[t] not in strict]
        self.trie = Trie(self.spelled)
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t[-1] == "*"}
        self.seen: dict[str, tuple[int, int] | None] = {}
        self.coef = np.zeros(len(self.features("")) + 1)
        self.coef[-1] = -4.0

    def hit(self, word: str) -> tuple[int, int] | None:
        """Of a whitespace-delimited word: the edits (a stand-in character counts as one) to its nearest term, and the term."""
        found = self.seen.get(word, 0)
        if found != 0:
            return found
        if len(self.seen) >= CACHE:
            self.seen.clear()
        bare, found = word.strip(_STRIP), None
        if len(bare) >= TERM_CHARS - EDITS:
            if bare in self.index and bare[-1] != "*":
                found = 0, self.index[bare]
            elif bare not in self.ordinary:
                for form in dict.fromkeys((bare, bare.translate(LEET))):
                    if form in self.index and form[-1] != "*":
                        near = 1, self.index[form]
                    elif self.trie.may_match(form) and (near := self.trie.nearest(form)):
                        near = near[0] + (form != bare), self.index[self.spelled[near[1]]]
                    else:
                        continue
                    found = min(found or near, near)
            if not found or found[0]:
                found = next(((0, self.stems[bare[:k]]) for k in STEM_CHARS if bare[:k] in self.stems), found)
        self.seen[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """Of the hits: their weight outside and inside quotations and where someone is addressed, how many terms they are of, and their share of the words."""
        words = text.lower().split()
        weight = quoted = addressed = hits = 0.0
        terms = set()
        for i, w in enumerate(words):
            if (h := self.hit(w)) is None:
                continue
            before, after = words[max(0, i - SPAN) : i + 1], words[i : i + SPAN + 1]
            marks = any(x[0] in OPENING for x in before) and any(x.rstrip(".,;:!?")[-1:] in CLOSING or x[-1] in CLOSING for x in after)
            around = [x.strip(_STRIP) for x in (*before[:-1], *after[1:])]
            # Above 0: abuse; below: quotation.
            context = sum(x in ADDRESS for x in around) - sum(x in REPORTING for x in around) - 2 * marks
            value = (min(8.0, self.odds[h[1]]) - 2) * MISSPELLED ** h[0]
            if context < 0:
                quoted += value
            else:
                weight, hits = weight + value, hits + 1
                addressed += value * (context > 0)
                terms.add(h[1])
        return [math.log1p(weight), math.log1p(quoted), math.log1p(addressed), math.log1p(len(terms)), math.sqrt(hits / max(1, len(words)))]

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 600, ridge: float = 2e-3) -> None:
        x = np.c_[np.array([self.features(t) for t in texts]), np.ones(len(texts))]
        # Classes count alike; quoted hits can only lower the score, all others only raise it.
        per = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
        sign = np.array([1, -1, 1, 1, 1, 0])
        first, second = np.zeros_like(self.coef), np.zeros_like(self.coef)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))
            g = x.T @ ((p - labels) * per) + ridge * self.coef * (sign != 0)
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            self.coef -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
            self.coef = np.where(sign * self.coef < 0, 0, self.coef)

    def score(self, text: str) -> float:
        z = float(np.dot(self.coef[:-1], self.features(text)) + self.coef[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """A model from the labelled rows of ``labels`` (``doc_id``, ``toxic``); without toxic ones every score is low."""
    rows = labelled_sample(docs, labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull()), SAMPLE_ROWS, SAMPLE_CHARS)
    return fit_model([r["text"] for r in rows], np.array([r["toxic"] for r in rows], int))


def fit_model(texts: list[str], y: np.ndarray) -> Toxicity:
    sets = [frozenset(w.strip(_STRIP) for w in t.lower().split()) for t in texts]
    # Copies would make their rare words look common: of texts that share their least-hashed words only one counts.
    once = {(y[i], frozenset(sorted(s, key=hash32)[:4])): s for i, s in enumerate(sets)}
    bad, good, family = Counter(), Counter(), {}
    for (label, _), words in once.items():
        stems = {w[:k] + "*" for w in words if len(w) > max(STEM_CHARS) for k in STEM_CHARS}
        (bad if label else good).update({w for w in words if len(w) >= TERM_CHARS} | stems)
        for w in words if label else ():
            for k in STEM_CHARS:
                family.setdefault(w[:k] + "*", set()).add(w)
    n_bad, n_good = (sum(k[0] == v for k in once) for v in (1, 0))
    base, totals = n_bad / max(1, len(once)), Counter()
    for w in {*bad, *good}:
        totals[w[-1] == "*", bad[w] + good[w]] += 1

    def sure(w: str) -> bool:
        """Whether few terms as one-sided as this would be expected by chance, among the terms of as many documents."""
        n, k = bad[w] + good[w], bad[w]
        return k > 1 and k > 4 * base * n and totals[w[-1] == "*", n] * sum(math.comb(n, j) * base**j * (1 - base) ** (n - j) for j in range(k, n + 1)) < BY_CHANCE

    odds = {w: math.log((bad[w] + 0.5) / (n_bad + 1)) - math.log((good[w] + 0.5) / (n_good + 1)) for w in bad if sure(w) and (w[-1] != "*" or len(family[w]) >= STEM_WORDS)}
    odds = {w: o for w, o in odds.items() if o > (STEM_ODDS if w[-1] == "*" else TERM_ODDS)}
    # Of stems within a stem, the shorter; of a stem's words, the stem.
    odds = {w: o for w, o in odds.items() if not any(w.rstrip("*")[:k] + "*" in odds for k in STEM_CHARS if k < len(w.rstrip("*")))}
    chosen = sorted(odds, key=lambda w: (-odds[w] * math.sqrt(bad[w]), w))[:TERMS]
    model = Toxicity(chosen, [odds[w] for w in chosen])
    # Words near a term that clean documents use too.
    near = {w: h[1] for w in good if w[-1] != "*" and not sure(w) and (h := model.hit(w)) and h[0]}
    crowd = Counter(near.values())
    model = Toxicity(chosen, model.odds, frozenset(i for i, n in crowd.items() if n >= CROWDED), frozenset(near))
    if len(set(y.tolist())) == 2:
        model.fit(texts, y)
    model.seen.clear()
    return model


def hash32(word: str) -> int:
    """A hash that is the same in every process."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=2)
def _of(terms: tuple[str, ...], odds: tuple[float, ...], strict: frozenset[int], ordinary: frozenset[str], coef: tuple[float, ...]) -> Toxicity:
    """One model per process, so that what it has seen outlives a task."""
    model = Toxicity(list(terms), list(odds), strict, ordinary)
    model.coef = np.array(coef)
    return model


def scored(df: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``score``.  A null or empty text has no hit and so the least score."""
    kept = [f for f in df.schema if f.name not in (text, "score")]
    spec = tuple(model.terms), tuple(model.odds), model.strict, model.ordinary, tuple(model.coef.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _of(*spec)
        for batch in slices(batches):
            score = [model.score(x or "") for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(score, pa.float64())], names=[*(f.name for f in kept), "score"])

    return df.drop("score").mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"]))


def detect(df: DataFrame, docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``score`` from a model learned on ``docs`` joined with ``labels``."""
    return scored(df, learn(docs, labels), text)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from rows that are not held out."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = detect(docs.select("doc_id", held_out().alias("held_out"), "text"), docs, labels.filter(~held_out()))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
