"""Mixing by soft membership: document rates whose expected domain token totals match target weights.

1. A classifier, fitted on a bounded sample of the labelled table, gives every document its posterior over domains.  For the fit alone,
   posteriors are set on a grid of 1/``GRID``, so that documents fall into cells of equal posterior; the posteriors returned are exact.
2. With rate ``w``, tokens ``n`` and posterior ``p``, the expected tokens of domain ``k`` are ``sum w n p_k``.  Projected gradient descent
   with momentum minimises half the squared distance of those totals (as shares of all tokens) from the targets, plus
   ``PULL / 2 * sum (n / N) (w - 1)^2``, over ``w >= 0``, in the metric ``n / N``.  There a step on ``w`` needs the document's posterior and
   the totals' residual alone; so equal posteriors have equal rates, and a table of cells and token sums is enough.  Each iteration is one pass
   over the cells that returns a few sums; a cell's rate is replayed from the residuals so far, so no state has to survive on an executor.
   A table of ``CELLS_IN_TASK`` cells or fewer (there are C(GRID + k - 1, k - 1) at most for k domains: 5,151 for three) has all its iterations in one task, a
   larger one a distributed pass for each; both take the same steps until totals rest, and a fit that does not come to rest raises.
3. Rates become copies: ``floor(w)`` and one more with the remaining probability, by a hash of the key.

Rows are rated each for itself: repeated rows each count, and rows that share a key or have none too; equal keys have equal chances.  An empty
table gives an empty result.  Only key, text and carried columns are read, and carried columns may have any name but those of the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import documents, durable, release, slices
from arbora.llm.sample import labelled_sample

SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
GRID = 100
PULL = 0.0001
#: Iterations after which a fit that has not come to rest is given up.
STEPS = 5000
#: A fit rests when no share of a domain moves more than this in an iteration, nor lies further from where the next one starts.
REST = 1e-7
#: Cells of equal posterior that one task of a step takes.
CELLS_IN_TASK = 50_000
#: Words that the classifier weighs, at most, and the least number of sampled documents that hold such a word.
EVIDENCE_WORDS, EVIDENCE_DOCS = 2000, 4
#: Target shares of tokens.
TARGETS = {"high": 0.95, "low": 0.03, "toxic": 0.02}
_SYMBOL, _UPPER, _LOWER = re.compile(r"[#*$%&|<>!]"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[a-zß-öø-ÿ]")


class DomainClassifier:
    """Softmax regression on a few counts of the text and on the words that tell the domains apart."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.evidence: dict[str, int] = {}
        self.weight = np.zeros((0, len(domains)), np.float32)
        self.coef = np.zeros((1, len(domains)))
        self.mean, self.scale = np.zeros(1), np.ones(1)

    @staticmethod
    def words(text: str) -> list[str]:
        return [w.strip(".,;:!?\"'()#*$%&|") for w in text.lower().split()]

    def features(self, text: str) -> tuple[int, list[float]]:
        """The number of words, and what the regression sees."""
        words = self.words(text)
        n, k = len(words), len(self.domains)
        lines = [x for x in text.split("\n") if x.strip()]
        upper, lower = len(_UPPER.findall(text)), len(_LOWER.findall(text))
        own = [math.log1p(n), len(_SYMBOL.findall(text)) / max(1, n), upper / max(1, upper + lower), 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / max(1, n)]
        at = [i for i in map(self.evidence.get, words) if i is not None]
        if at:
            weights = self.weight[at]
            own += [*weights.max(0).tolist(), *np.log1p(np.clip(weights - 1, 0, None).sum(0)).tolist()]
        else:
            own += [0.0] * (2 * k)
        return n, own

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> None:
        k = len(self.domains)
        sets = [set(self.words(t)) for t in texts]
        per = [Counter(w for s, y in zip(sets, labels, strict=True) if y == c for w in s) for c in range(k)]
        size = np.bincount(labels, minlength=k)
        total = Counter()
        for p in per:
            total.update(p)
        found = []
        for w, n in total.items():
            if n >= EVIDENCE_DOCS:
                inside = np.array([(p[w] + 0.5) / (s + 1) for p, s in zip(per, size, strict=True)])
                outside = np.array([(n - p[w] + 0.5) / (len(texts) - s + 1) for p, s in zip(per, size, strict=True)])
                odds = np.log(inside / outside)
                found.append((float(np.abs(odds).max() * math.sqrt(n)), w, odds))
        found = sorted(found, key=lambda x: (-x[0], x[1]))[:EVIDENCE_WORDS]
        self.evidence = {w: i for i, (_, w, _) in enumerate(found)}
        self.weight = np.array([o for _, _, o in found], np.float32).reshape(-1, k)
        x = np.array([self.features(t)[1] for t in texts])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.coef = np.zeros((x.shape[1], k))
        one, first, second = np.eye(k)[labels], np.zeros_like(self.coef), np.zeros_like(self.coef)
        for t in range(1, steps + 1):
            y = x @ self.coef
            y = np.exp(y - y.max(1, keepdims=True))
            g = x.T @ (y / y.sum(1, keepdims=True) - one) / len(x) + ridge * self.coef
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            self.coef -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)

    def posteriors(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """Numbers of words, and posteriors."""
        found = [self.features(t) for t in texts]
        x = np.array([f for _, f in found]).reshape(len(texts), -1)
        y = np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))] @ self.coef
        y = np.exp(y - y.max(1, keepdims=True))
        return [n for n, _ in found], y / y.sum(1, keepdims=True)


def cells_of(posteriors: np.ndarray) -> np.ndarray:
    """Posteriors as whole multiples of 1/GRID that add up to 1: rounded, what is missing or too much at the greatest."""
    cell = np.floor(posteriors * GRID + 0.5).astype(np.int64)
    cell[np.arange(len(cell)), posteriors.argmax(1)] += GRID - cell.sum(1)
    return cell


def learn(docs: DataFrame, labels: DataFrame, domain: str = "domain") -> DomainClassifier:
    """A classifier for the ``domain`` of ``labels``; with no labelled document it has no domain."""
    rows = labelled_sample(docs, labels.select("doc_id", domain).filter(F.col(domain).isNotNull()), SAMPLE_ROWS, SAMPLE_CHARS)
    domains = sorted({r[domain] for r in rows})
    model = DomainClassifier(domains)
    if len(domains) > 1:
        model.fit([r["text"] for r in rows], np.array([domains.index(r[domain]) for r in rows]))
    return model


class Descent:
    """Rates of cells under projected gradient steps with the momentum that the pull's convexity allows."""

    def __init__(self, cells: np.ndarray, pull: float = PULL):
        self.p, self.pull, self.eta = cells / GRID, pull, 1 / (1 + pull)
        self.w, self.y = np.ones(len(cells)), np.ones(len(cells))
        root = math.sqrt(pull / (1 + pull))
        self.momentum = (1 - root) / (1 + root)

    def step(self, residual: np.ndarray) -> None:
        """A step from ``y``, where the totals miss the targets by ``residual``."""
        new = np.maximum(0, self.y - self.eta * (self.p @ residual + self.pull * (self.y - 1)))
        self.y, self.w = new + self.momentum * (new - self.w), new


def rates_of(cells: np.ndarray, history: list[np.ndarray], pull: float = PULL) -> np.ndarray:
    """Rates after the steps whose residuals are ``history``, from 1, and the point where the next is taken."""
    found = Descent(cells, pull)
    for residual in history:
        found.step(residual)
    return np.stack([found.w, found.y])


def rests(before: np.ndarray, done: np.ndarray, ahead: np.ndarray) -> bool:
    return bool(np.abs(done - before).max() < REST and np.abs(done - ahead).max() < REST)


def _in_one_task(cells: DataFrame, targets: np.ndarray, steps: int) -> tuple[list[np.ndarray], np.ndarray]:
    """All steps in one task that holds the whole bounded table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        c, n = np.stack(rows["cell"].to_list()), rows["tokens"].to_numpy(np.float64)
        weight = (n / max(1.0, n.sum()))[:, None] * (c / GRID)
        found, history = Descent(c), []
        done = ahead = found.y @ weight
        for _ in range(steps):
            history.append(ahead - targets)
            found.step(history[-1])
            before, done, ahead = done, found.w @ weight, found.y @ weight
            if rests(before, done, ahead):
                break
        yield pd.DataFrame({"history": [[x.tolist() for x in history]], "before": [before.tolist()], "done": [done.tolist()], "ahead": [ahead.tolist()]})

    row = cells.coalesce(1).mapInPandas(run, "history array<array<double>>, before array<double>, done array<double>, ahead array<double>").first()
    history, done = [np.array(x) for x in row["history"]], np.array(row["done"])
    if not rests(np.array(row["before"]), done, np.array(row["ahead"])):
        raise RuntimeError(f"the rates did not come to rest in {steps} steps")
    return history, done


def _in_passes(cells: DataFrame, targets: np.ndarray, steps: int) -> tuple[list[np.ndarray], np.ndarray]:
    """One distributed pass for each step."""
    history: list[np.ndarray] = []
    k = len(targets)

    def totals(past: list[np.ndarray]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokens, sums = 0, np.zeros((2, k))
            for rows in batches:
                if len(rows):
                    c, n = np.stack(rows["cell"].to_list()), rows["tokens"].to_numpy(np.float64)
                    tokens += int(n.sum())
                    sums += (rates_of(c, past) * n) @ (c / GRID)
            yield pd.DataFrame({"tokens": [tokens], "done": [sums[0].tolist()], "next": [sums[1].tolist()]})

        found = cells.mapInPandas(run, "tokens bigint, done array<double>, next array<double>")
        row = found.agg(F.sum("tokens").alias("tokens"), *[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("done", "next") for i in range(k)]).first()
        n = max(1, row["tokens"] or 0)
        return [np.array([(row[f"{c}{i}"] or 0.0) / n for i in range(k)]) for c in ("done", "next")]

    done, ahead = totals(history)
    for _ in range(steps):
        history.append(ahead - targets)
        before = done
        done, ahead = totals(history)
        if rests(before, done, ahead):
            return history, done
    raise RuntimeError(f"the rates did not come to rest in {steps} steps")


def fit_rates(cells: DataFrame, targets: np.ndarray, steps: int = STEPS) -> tuple[list[np.ndarray], np.ndarray]:
    """The residuals of each projected-gradient step over ``cells`` (``cell`` array<bigint>, ``tokens`` bigint), and the shares reached."""
    n = cells.count()
    if not n:
        return [], np.zeros(len(targets))
    if n <= CELLS_IN_TASK:
        return _in_one_task(cells, targets, steps)
    return _in_passes(cells.coalesce(math.ceil(n / CELLS_IN_TASK)), targets, steps)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "domain", key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``carry``, ``n_tokens`` (words), ``domain_pred``, ``posterior`` (map), ``rate`` and ``copies`` for each row of ``docs``.

    A null text counts as empty.  Domains without labelled documents or without a target are left out of the fit, and the other targets
    scaled to 1; with fewer than two domains every rate is 1.  Texts are read once; the fit runs on token sums of cells.
    """
    model, kept = learn(docs, labels, domain), (key, *carry)
    wanted = np.array([targets.get(d, 0.0) for d in model.domains])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            if len(model.domains) > 1:
                n, posterior = model.posteriors(texts)
                cell = cells_of(posterior)
            else:
                n, posterior = [len(t.split()) for t in texts], np.ones((len(texts), len(model.domains)))
                cell = (posterior * GRID).astype(np.int64)
            lists = pa.array(posterior.tolist(), pa.list_(pa.float64())), pa.array(cell.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64()), *lists], names=[*kept, "n_tokens", "posterior", "cell"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    scored = durable(docs.select(*kept, text).mapInArrow(run, f"{schema}, n_tokens bigint, posterior array<double>, cell array<bigint>"), "mixing")
    history: list[np.ndarray] = []
    if len(model.domains) > 1 and wanted.sum() > 0:
        cells = durable(scored.groupBy("cell").agg(F.sum("n_tokens").alias("tokens")), "mixing-cells")
        history, _ = fit_rates(cells, wanted / wanted.sum())
        release(cells)

    @F.pandas_udf("double")
    def rate(cell: pd.Series) -> pd.Series:
        if not history or not len(cell):
            return pd.Series(np.ones(len(cell)))
        different, of = np.unique(np.stack(cell.to_list()), axis=0, return_inverse=True)
        return pd.Series(rates_of(different, history)[0][of.reshape(-1)])

    names = F.array(*[F.lit(d) for d in model.domains]) if model.domains else F.array().cast("array<string>")
    chance = F.pmod(F.xxhash64(F.col(key), F.lit("mixing")), F.lit(1 << 30)) / (1 << 30)
    out = scored.withColumn("rate", rate("cell"))
    return out.select(
        *kept,
        "n_tokens",
        F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1).alias("domain_pred"),
        F.map_from_arrays(names, "posterior").alias("posterior"),
        "rate",
        F.floor(F.col("rate") + chance).cast("int").alias("copies"),
    )


def quality_domains(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain``: toxic, else high or low by quality; null where neither is known."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain posterior, rate and copies under the production targets."""
    labels = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = mix(documents(spark, sf_dir), labels, TARGETS)
    shares = [F.coalesce(F.col("posterior")[d], F.lit(0.0)).alias(f"p_{d}") for d in TARGETS]
    return found.select("doc_id", "n_tokens", "domain_pred", *shares, "rate", "copies")
