"""Byte-level BPE: whole texts to ids and back, equal to what the vocabulary's own library gives.

A text is cut at its special tokens, the rest into pieces by the vocabulary's pattern.  Pieces repeat, so each process keeps the
ids of those it has seen (of ``SHORT`` bytes at most, cleared at ``CACHE`` entries, which bounds memory).  A new piece is merged with a contiguous
rank array: ``bounds`` holds the places in the piece where its parts begin, and its end, ``at`` the id of the part that begins at a place, and
``ranks[i]`` the rank of parts ``i`` and ``i+1`` as a pair; the least rank is found by a scan, the boundary between the two is deleted, and the ranks of
the merged part with the parts at the boundaries beside it are looked up again.  The scan is quadratic in a piece's length, so pieces over ``SHORT`` bytes
use a heap over linked parts, which merges in the same order (least rank, leftmost first).

A null text counts as empty and gives no ids; an empty table gives an empty result; rows are encoded each for itself, so repeated rows and
nulls in other columns change nothing.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import documents, slices

CACHE = 300_000
SHORT = 64
NEVER = 1 << 60

# The pre-tokenizer's pattern. Its white space is the Unicode property, spelled out because Python's \s also takes U+001C to U+001F.
_WS = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
# The same for texts in a range where the letters and digits are few enough to list, for Python's faster engine.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN_WS = r"\t-\r \x85\xa0"
_PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_PLAIN_WS}{_LETTERS}{_DIGITS}]+|[{_PLAIN_WS}]+(?![^{_PLAIN_WS}])|[{_PLAIN_WS}]+"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def check_byte_tokenizer(spec: dict) -> None:
    """Raises unless the tokenizer file asks for what :class:`ByteBPE` does."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    whole = not any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or cut.get("use_regex") is False or not plain or not whole:
        raise ValueError("the tokenizer file normalises or cuts texts in another way than this encoder")


class PieceIds(dict):
    """The ids, as int32 in a row, of pieces, made when first asked for.  Long pieces are not kept; at ``CACHE`` pieces all are forgotten."""

    def __init__(self, make: Callable[[bytes], list[int]]):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        found = array("i", self.make(raw)).tobytes()
        if len(raw) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = found
        return found


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizer file; truncation and padding are not applied."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_byte_tokenizer(spec)
        model, symbols = spec["model"], byte_symbols()
        byte_of = {c: b for b, c in symbols.items()}
        vocab = model["vocab"]
        self.byte_id = [vocab[symbols[b]] for b in range(256)]
        # Of a pair of ids, packed into one number: its rank and the merged id, packed so that they order by rank.
        self.bits = max(vocab.values()).bit_length()
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"], 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << self.bits | vocab[b]] = rank << self.bits | vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces, self.plain_pieces, self.not_plain = regex.compile(_PATTERN), re.compile(_PLAIN_PATTERN), re.compile("[^\x00-ſ]")
        self.seen = PieceIds(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if len(piece) > SHORT:
            return self._merge_long(piece)
        bounds, at = [*range(len(piece) + 1)], [*map(self.byte_id.__getitem__, piece)]
        get, bits, low = self.merges.get, self.bits, (1 << self.bits) - 1
        ranks = [get(a << bits | b, NEVER) for a, b in pairwise(at)]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            at[bounds[i]] = new = least & low
            if i < len(ranks):
                ranks[i] = get(new << bits | at[bounds[i + 1]], NEVER)
            if i:
                ranks[i - 1] = get(at[bounds[i - 1]] << bits | new, NEVER)
        bounds.pop()
        return [*map(at.__getitem__, bounds)]

    def _merge_long(self, piece: bytes) -> list[int]:
        ids: list[int] = [self.byte_id[b] for b in piece]
        n, get, bits, low = len(ids), self.merges.get, self.bits, (1 << self.bits) - 1
        before, after, gone = list(range(-1, n - 1)), [*range(1, n), -1], bytearray(n)
        # An entry holds the pair's rank and merged id, the place of its left part and the ids it saw there: stale ones are skipped.
        heap = [(m, i, a, b) for i, (a, b) in enumerate(pairwise(ids)) if (m := get(a << bits | b))]
        heapq.heapify(heap)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], gone[j], after[i] = m & low, 1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] >= 0 and (m := get(ids[p] << bits | ids[after[p]])):
                    heapq.heappush(heap, (m, p, ids[p], ids[after[p]]))
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]

    def _plain(self, text: str) -> bytes:
        """The ids, as int32 in a row, of a text without special tokens."""
        pieces = (self.pieces if self.not_plain.search(text) else self.plain_pieces).findall(text)
        return b"".join(map(self.seen.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        if not any(x in text for x in self.special):
            return np.frombuffer(self._plain(text), np.int32)
        parts = self.at_special.split(text)
        return np.frombuffer(b"".join(np.int32(self.special[x]).tobytes() if k % 2 else self._plain(x) for k, x in enumerate(parts)), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    """One per process and file, so that its cache outlives a task."""
    return ByteBPE(path)


def _extended(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    columns, names = list(batch.columns), list(batch.schema.names)
    if at >= 0:
        columns[at] = values
    else:
        columns, names = [*columns, values], [*names, name]
    return pa.RecordBatch.from_arrays(columns, names=names)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids`` array<int>: the whole ``text`` encoded.  A column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches):
            found = [bpe.encode(x or "") for x in batch.column(text).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            values = pa.array(np.concatenate(found) if found else np.array([], np.int32), pa.int32())
            yield _extended(batch, ids, pa.ListArray.from_arrays(pa.array(offsets), values))

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != ids]
    df = df.drop(ids)
    return df.mapInArrow(run, ", ".join([*rest, f"`{ids}` array<int>"]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text`` string: ``ids`` decoded, special tokens included, malformed bytes as U+FFFD.  A null list gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches):
            # One text's ids at a time become Python numbers.
            yield _extended(batch, text, pa.array([bpe.decode(x.values.to_pylist() if x.is_valid else ()) for x in batch.column(ids)], pa.string()))

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text]
    df = df.drop(text)
    return df.mapInArrow(run, ", ".join([*rest, f"`{text}` string"]))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = decode(encode(documents(spark, sf_dir).select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
