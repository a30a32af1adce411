"""Language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward GRU read the UTF-8 bytes in windows; a softmax over both states labels every byte; a document's probabilities
are the mean over all its bytes.  The network is trained here, in numpy, by backpropagation through time, on a bounded sample of
labelled rows (about ``PER_LANGUAGE`` of each label, picked by hash; fewer where labels are so many that this passes ``SAMPLE_ROWS``, but one at least).
Of a sampled text it reads ``SAMPLE_BYTES`` bytes from a place picked by hash.  Prediction reads whole texts, in windows of ``WINDOW`` bytes at
whose bounds the states begin anew.

A letter is what Unicode calls one (categories L*).  Repeated rows are predicted alike and count once in the sample; an empty table gives an
empty result; columns called ``lang_pred`` and ``score`` are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import documents, slices
from arbora.llm.sample import window_of

PER_LANGUAGE = 300
SAMPLE_ROWS = 64 * PER_LANGUAGE
#: Bytes of a sampled text that training reads.
SAMPLE_BYTES = 768
HIDDEN = 6
WINDOW = 96
UNDEFINED = "und"
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGRU:
    """Two GRUs over bytes and a softmax at every position.  Arrays are feature-major: (features, sequences)."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng, h = np.random.default_rng(seed), hidden
        self.classes, self.hidden = classes, hidden
        self.p = {"V": rng.normal(0, 0.3, (len(classes), 2 * h)), "c": np.zeros((len(classes), 1))}
        for d in "fb":
            # Rows: update gate, reset gate, candidate.
            self.p |= {f"X{d}": rng.normal(0, 0.3, (3 * h, 256)), f"U{d}": rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _states(self, d: str, codes: np.ndarray, lengths: np.ndarray | None, tape: list | None = None) -> np.ndarray:
        """The state after each step: (steps, hidden, sequences).  Past a sequence's length the state is 0."""
        h, steps, n = self.hidden, len(codes), codes.shape[1]
        x, u = self.p[f"X{d}"], self.p[f"U{d}"]
        out, state = np.empty((steps, h, n), np.float32), np.zeros((h, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, g = x.take(codes[t], axis=1), u @ state
            gates = a[: 2 * h]
            gates += g[: 2 * h]
            _sigmoid(gates)
            z, r, inner = gates[:h], gates[h:], g[2 * h :]
            m = r * inner
            m += a[2 * h :]
            np.tanh(m, out=m)
            new = out[t]
            np.subtract(state, m, out=new)
            new *= z
            new += m
            if lengths is not None:
                new *= t < lengths
            if tape is not None:
                tape.append((t, z.copy(), r.copy(), m, inner.copy(), state))
            state = new
        return out

    def probabilities(self, codes: np.ndarray, lengths: np.ndarray | None) -> np.ndarray:
        """The sum over each sequence's positions of their class probabilities: (classes, sequences).  ``codes``: (steps, sequences)."""
        forth, back = self._states("f", codes, lengths), self._states("b", codes, lengths)
        h, total = self.hidden, np.zeros((len(self.classes), codes.shape[1]), np.float32)
        vf, vb = np.ascontiguousarray(self.p["V"][:, :h]), np.ascontiguousarray(self.p["V"][:, h:])
        for t in range(len(codes)):
            y = vf @ forth[t]
            y += vb @ back[t]
            y += self.p["c"]
            np.minimum(y, 60, out=y)
            np.exp(y, out=y)
            y /= y.sum(0) + np.float32(1e-30)
            if lengths is not None:
                y *= t < lengths
            total += y
        return total

    def _gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        h, (steps, n) = self.hidden, codes.shape
        tapes: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._states("f", codes, None, tapes["f"]), self._states("b", codes, None, tapes["b"])], axis=1)
        y = np.matmul(self.p["V"], both) + self.p["c"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        loss = -float(np.log(y[:, labels, np.arange(n)] + 1e-9).mean())
        y[:, labels, np.arange(n)] -= 1
        y /= steps * n
        grads = {"V": np.einsum("tcn,tkn->ck", y, both), "c": y.sum((0, 2))[:, None]}
        above = np.matmul(self.p["V"].T, y)
        for d, at in (("f", slice(0, h)), ("b", slice(h, None))):
            u, dx, du, later = self.p[f"U{d}"], np.zeros_like(self.p[f"X{d}"]), np.zeros_like(self.p[f"U{d}"]), np.zeros((h, n), np.float32)
            for t, z, r, m, inner, state in reversed(tapes[d]):
                ds = above[t][at] + later
                dm = ds * (1 - z) * (1 - m * m)
                dz = ds * (state - m) * z * (1 - z)
                dr = dm * inner * r * (1 - r)
                dg, da = np.concatenate([dz, dr, dm * r]), np.concatenate([dz, dr, dm])
                du += dg @ state.T
                later = u.T @ dg + ds * z
                order = np.argsort(codes[t], kind="stable")
                values, first = np.unique(codes[t][order], return_index=True)
                dx[:, values] += np.add.reduceat(da[:, order], first, axis=1)
            grads |= {f"X{d}": dx, f"U{d}": du}
        return loss, grads

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = 260, batch: int = 192, width: int = 48, rate: float = 0.02, seed: int = 11) -> float:
        """Adam on random windows, languages drawn alike; returns the last loss."""
        rng, loss = np.random.default_rng(seed), float("nan")
        of = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        present = [c for c in range(len(self.classes)) if len(of[c])]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            chosen = rng.choice(present, batch)
            codes = np.zeros((width, batch), np.uint8)
            for k, c in enumerate(chosen):
                text = texts[of[c][rng.integers(len(of[c]))]]
                at = int(rng.integers(max(1, len(text) - width + 1)))
                part = np.resize(np.frombuffer(text[at : at + width], np.uint8), width)  # short texts repeat
                codes[:, k] = part
            loss, grads = self._gradients(codes, chosen)
            lr = rate * min(1, step / 10) * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def predict(self, texts: list[bytes], window: int = WINDOW, block: int = 2048) -> np.ndarray:
        """Each text's class probabilities: the mean over all its bytes; zeros for an empty text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros((len(texts), len(self.classes)))
        data = np.frombuffer(b"".join(texts) + bytes(window), np.uint8)
        start = np.cumsum(sizes) - sizes
        full = sizes // window
        for lengths_known in (True, False):  # windows that are full, then each text's last bytes
            count = full if lengths_known else (sizes % window > 0).astype(np.int64)
            owner = np.repeat(np.arange(len(texts)), count)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            at = start[owner] + window * (inner if lengths_known else full[owner])
            left = None if lengths_known else sizes[owner] % window
            if left is not None:  # of like length together, so that steps past all of them are not taken
                order = np.argsort(left, kind="stable")
                owner, at, left = owner[order], at[order], left[order]
            for a in range(0, len(owner), block):
                here = None if left is None else left[a : a + block]
                steps = window if here is None else int(here.max())
                codes = data[at[a : a + block][None, :] + np.arange(steps)[:, None]]
                np.add.at(out, owner[a : a + block], self.probabilities(codes, here).T.astype(np.float64))
        return out / np.maximum(1, sizes)[:, None]


def held_out(key: str = "doc_id") -> Column:
    """Whether the CRC-32 of the key as text leaves 1 when divided by 3."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> ByteGRU | None:
    """A network for all labels of ``labelled``; None where no row has both a label and a text with letters.

    The sample is picked by a hash of key and text against a share for each label, so nothing is shuffled for it but the counts and itself.
    """
    rows = labelled.filter(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = rows.groupBy(label).count().collect()
    if not counts:
        return None
    per = min(PER_LANGUAGE, SAMPLE_ROWS / len(counts))
    shares = labelled.sparkSession.createDataFrame([(r[label], min(1.0, per / r["count"])) for r in counts], "__label string, __share double")
    chance = F.pmod(F.xxhash64(key, text), F.lit(1 << 30)) / (1 << 30)
    rows = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), chance.alias("chance"), window_of(F.col(text), SAMPLE_BYTES, key).alias("t"))
    picked = rows.join(F.broadcast(shares), F.col("label") == F.col("__label")).filter("chance < __share").select("key", "label", "t").distinct().orderBy("key", "label", "t").collect()
    # No label is lost to chance.
    if missing := sorted({r[label] for r in counts} - {r["label"] for r in picked}):
        rest = rows.join(F.broadcast(labelled.sparkSession.createDataFrame([(x,) for x in missing], "label string")), "label")
        picked += rest.groupBy("label").agg(F.min(F.struct("chance", "key", "t")).alias("r")).select("r.key", "label", "r.t").orderBy("label").collect()
    classes = sorted({r["label"] for r in picked})
    texts = [r["t"].encode("utf-8", "surrogatepass")[:SAMPLE_BYTES] for r in picked]
    net = ByteGRU(classes)
    if len(classes) > 1:
        net.train(texts, np.array([classes.index(r["label"]) for r in picked]))
    return net


def identify(df: DataFrame, net: ByteGRU | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df``, without ``text`` unless ``keep_text``, with ``lang_pred`` and ``score`` (the mean probability of the predicted label over all bytes).

    A null text, one without a letter and any text where nothing was learned get ``und`` and 0.
    """
    kept = [f for f in df.schema if f.name not in ("lang_pred", "score") and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            texts = batch.column(text).to_pylist()
            known = [net is not None and x is not None and _LETTER.search(x) is not None for x in texts]
            label, score = [UNDEFINED] * len(texts), np.zeros(len(texts))
            if any(known):
                at = np.flatnonzero(known)
                p = net.predict([texts[i].encode("utf-8", "surrogatepass") for i in at])
                best = p.argmax(1)
                score[at] = np.clip(p.max(1), 0, 1)
                for i, b in zip(at, best, strict=True):
                    label[i] = net.classes[b]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(label, pa.string()), pa.array(score)], names=[*(f.name for f in kept), "lang_pred", "score"])

    return df.drop("lang_pred", "score").mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"]))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, learned from rows that are not held out."""
    docs = documents(spark, sf_dir)
    net = learn(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), net)
