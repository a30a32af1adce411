"""Token ids in files compressed by Re-Pair grammars, with random access.

Texts are encoded with a public tokenizer and an end id is appended to each; ids lie in ascending key order in shards of about
``SHARD_TOKENS``.  Each shard has a grammar of its own: frequent pairs of symbols are replaced by new symbols, round after round, until no
pair is left that occurs ``LEAST`` times.  The file stores, per shard, the rules (two symbols each), the expansion length of every rule and the remaining
sequence.  From the lengths follows where in the sequence any id lies, so a document is decoded by expanding the few symbols that cover it.

A file is a row of a table written by Spark's own writer to a shared folder: ``part``, ``seq`` (its place in the order), ``keys``, ``sizes`` (ids per
document), ``rules``, ``lengths`` and ``symbols`` (little-endian unsigned 32-bit numbers) and ``terminals`` (symbols below it are ids).

A null text counts as empty: its document holds the end id alone.  A null key sorts first; documents that share a key lie in the order of a
hash of their texts, so that a key with many rows is cut into several ranges, and repeated rows are documents of their own.  An empty table
gives no file rows.  Of the table's columns only key and text are read, so others may have any name.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.bpe import byte_symbols
from arbora.llm.common import documents, forget, new_path, slices, tasks

SHARD_TOKENS = 1 << 18
#: The least number of times a replaced pair occurs: a rule takes two symbols and a length, and saves a symbol each time.
LEAST = 8
#: Words remembered in a generation (a process keeps two), and the longest (in characters) that are: these bound its memory.
CACHE, LONGEST = 400_000, 64

# The pre-tokenizer's pattern as its file spells it, and the same for engines in which white space has to be spelled out.
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+"
# For words up to U+017F, where letters and digits are few enough to list, so that Python's faster engine will do.
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_DIGITS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+"


# ---------------------------------------------------------------- ids


def check_word_tokenizer(spec: dict) -> None:
    """Raises unless the tokenizer file asks for what :class:`WordEncoder` does."""
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", ())]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())
    pattern = cuts[0].get("pattern", {}).get("Regex") if cuts else None
    bytes_as_they_are = len(cuts) == 2 and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
    if steps != ["NFC", "Replace", "Lowercase"] or pattern != _FILE_PATTERN or not bytes_as_they_are or spec["model"].get("dropout"):
        raise ValueError("the tokenizer file normalises or cuts texts in another way than this encoder")


class WordIds(dict):
    """The ids of words, made when first asked for.  At ``CACHE`` words a new generation begins, into which frequent ones come back from the last."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found


class WordEncoder:
    """The tokenizers library, asked once for each different piece of a word: no piece holds white space, so words are encoded independently."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check_word_tokenizer(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.model = self.tokenizer.normalizer, self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols, self.pieces, self.plain_pieces = byte_symbols(), regex.compile(_PATTERN), re.compile(_PLAIN_PATTERN)
        # Texts of other characters may change in more than case; U+001C to U+001F are white space to Python alone.
        self.not_plain = re.compile("[^\x00-\x1b -\u012f\u0131-\u017f]")
        self.words = WordIds(self._word)

    def _word(self, word: str) -> bytes:
        if not word.isalpha():
            pieces = (self.pieces if self.not_plain.search(word) else self.plain_pieces).findall(word)
            if len(pieces) != 1:  # a piece is a word of its own
                return b"".join(map(self.words.__getitem__, pieces))
        mapped = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode("utf-8", "surrogatepass")))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        words = self.normalizer.normalize_str(text).split(" ") if self.not_plain.search(text) else text.lower().split()
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as native unsigned 32-bit numbers."""
        if not any(x in text for x in self.special):
            return self._plain(text)
        parts = self.at_special.split(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if k % 2 else self._plain(x) for k, x in enumerate(parts))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---------------------------------------------------------------- the grammar


def _disjoint(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent of ``pairs`` of which no two can share a symbol of the sequence, in ascending order."""
    lefts, rights, chosen = set(), set(), []
    ordered = pairs[np.argsort(-counts, kind="stable")]
    for a, b in zip((ordered >> 32).tolist(), (ordered & 0xFFFFFFFF).tolist(), strict=True):
        if a not in rights and b not in lefts and (a != b or a not in lefts):
            lefts.add(a)
            rights.add(b)
            chosen.append(a << 32 | b)
    return np.sort(np.array(chosen))


def _slot(pairs: np.ndarray) -> np.ndarray:
    """20 bits of a hash of each pair."""
    return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)


def _slots(pairs: np.ndarray) -> np.ndarray:
    """For each slot, whether one of ``pairs`` falls on it."""
    there = np.zeros(1 << 20, bool)
    there[_slot(pairs)] = True
    return there


def compress(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols): rule ``i`` stands for symbol ``terminals + i``.

    A pair found rarer than ``LEAST`` stays so unless a new symbol is in it; so each round counts only pairs that were frequent in the last one
    (or share a slot with such) or that hold a new symbol.
    """
    s, rules, lengths = ids.astype(np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    live = np.ones(max(0, len(s) - 1), bool)  # of each pair, by its first place
    while True:
        places = np.flatnonzero(live)
        keys = s[places] << 32 | s[places + 1]
        ordered = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        counts = np.diff(first, append=len(ordered))
        often = counts >= LEAST
        if not often.any():
            break
        frequent = ordered[first[often]]
        chosen = _disjoint(frequent, counts[often])
        slot = _slot(keys)
        there = _slots(frequent)[slot]
        live[places[~there]] = False
        near = np.flatnonzero(_slots(chosen)[slot])
        places, keys = places[near], keys[near]
        rule = np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)
        hit = chosen[rule] == keys
        places, rule = places[hit], rule[hit]
        # In a run of one symbol every second pair.
        same = np.flatnonzero(s[places] == s[places + 1])
        if len(same):
            at = places[same]
            begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
            keep = np.ones(len(places), bool)
            keep[same[(np.arange(len(same)) - begin) % 2 == 1]] = False
            places, rule = places[keep], rule[keep]
        s[places] = terminals + len(rules) + rule
        live[places[places < len(live)]] = True
        live[places[places > 0] - 1] = True
        after = places + 1
        # The pair that began with the deleted symbol begins with the new one now.
        keep = np.ones(len(s), bool)
        keep[after] = False
        s, live = s[keep], live[keep[: len(live)]]
        live = live[: max(0, len(s) - 1)]
        added = np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1)
        size = np.concatenate([np.ones(terminals, np.int64), lengths])
        rules, lengths = np.concatenate([rules, added]), np.concatenate([lengths, size[added].sum(1)])
    return rules.astype("<u4"), lengths.astype("<u4"), s.astype("<u4")


@lru_cache(maxsize=2)
def _terminal_bytes(terminals: int) -> list[bytes]:
    return [i.to_bytes(4, "little") for i in range(terminals)]


class Shard:
    """Random access to the ids of a stored shard."""

    def __init__(self, rules: bytes, lengths: bytes, symbols: bytes, terminals: int):
        self.rules = np.frombuffer(rules, "<u4").reshape(-1, 2).astype(np.int64)
        self.terminals = terminals
        self.size = np.concatenate([np.ones(terminals, np.int64), np.frombuffer(lengths, "<u4").astype(np.int64)])
        self.symbols = np.frombuffer(symbols, "<u4").astype(np.int64)
        self.ends = np.cumsum(self.size[self.symbols])

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start``."""
        if n == 0:
            return np.zeros(0, "<u4")
        first, last = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, start + n, "left")
        s = self.symbols[first : last + 1]
        skip = start - (self.ends[first] - self.size[self.symbols[first]])
        while len(at := np.flatnonzero(s >= self.terminals)):
            width = np.ones(len(s), np.int64)
            width[at] = 2
            out = np.repeat(s, width)
            place = (np.cumsum(width) - width)[at]
            out[place], out[place + 1] = self.rules[s[at] - self.terminals].T
            s = out
        return s[skip : skip + n].astype("<u4")

    def whole(self) -> bytes:
        """All ids, as little-endian unsigned 32-bit numbers: each rule is expanded once, unless the expansions together are much longer than the shard."""
        n = int(self.ends[-1]) if len(self.ends) else 0
        if self.size[self.terminals :].sum() > 16 * n:
            return self.ids(0, n).tobytes()
        told = _terminal_bytes(self.terminals).copy()
        for a, b in self.rules.tolist():
            told.append(told[a] + told[b])
        return b"".join(map(told.__getitem__, self.symbols.tolist()))


# ---------------------------------------------------------------- files


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write its shard files to ``path``, in ascending ``key`` order over ``part`` and ``seq``."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"part int, seq int, keys array<{kind}>, sizes array<bigint>, rules binary, lengths binary, symbols binary, terminals bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        terminals = code.tokenizer.get_vocab_size()
        end = array("I", [end_id]).tobytes()
        keys, sizes, held, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            rules, lengths, symbols = compress(np.frombuffer(b"".join(held), np.uint32), terminals)
            row = [[part], [seq], [keys], [sizes], [rules.tobytes()], [lengths.tobytes()], [symbols.tobytes()], [terminals]]
            types = [pa.int32(), pa.int32(), pa.list_(key_type), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=["part", "seq", "keys", "sizes", "rules", "lengths", "symbols", "terminals"])

        for batch in slices(batches):
            key_type = batch.column(key).type
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                ids = code.encode(t or "") + end
                keys.append(k), sizes.append(len(ids) // 4), held.append(ids)
                total += len(ids) // 4
                if total >= SHARD_TOKENS:
                    yield shard()
                    keys, sizes, held, seq, total = [], [], [], seq + 1, 0
        if keys:
            yield shard()

    order = [F.col(key).asc_nulls_first(), F.col("__hash")]
    rows = docs.select(key, text, F.xxhash64(text).alias("__hash"))
    rows.repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order, text).select(key, text).mapInArrow(run, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from the files in ``path`` alone."""
    files = spark.read.parquet(path)
    kind = files.schema["keys"].dataType.elementType.simpleString()
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    # Shards before this one: in its part by a running sum, in other parts by their totals, of which there is one per part.
    counted = files.select("part", "seq", total.alias("n"))
    parts = {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(parts, default=-1) + 1):
        offsets.append(before)
        before += parts.get(p, 0)
    array_of = F.split(F.lit(",".join(map(str, offsets or [0]))), ",").cast("array<bigint>")
    running = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")
    starts = counted.select("part", "seq", (F.get(array_of, F.col("part")) + running).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {n: batch.column(n)[0].as_py() for n in ("part", "seq", "sizes", "rules", "lengths", "symbols", "terminals")}
            shard = Shard(row["rules"], row["lengths"], row["symbols"], row["terminals"])
            sizes = np.array(row["sizes"], np.int64)
            at = np.cumsum(sizes) - sizes
            # All documents of a shard are wanted: one expansion of the whole is cheaper than one for each.
            ids = memoryview(shard.whole())
            crc = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
            n = len(sizes)
            columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), batch.column("keys")[0].values, pa.array(at), pa.array(sizes), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", key, "at", "n_tokens", "ids_crc32"])

    found = files.mapInArrow(run, f"part int, seq int, `{key}` {kind}, at bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, ["part", "seq"]).select(key, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the id files, and a checksum of its ids as read back."""
    import public_tokenizers

    path = new_path(spark, "ids")
    write_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    forget(spark, path)
    return read_ids(spark, path)
