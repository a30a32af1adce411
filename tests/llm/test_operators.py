"""Every operator's query on odd documents against brute force, on empty tables, and its parts on their own."""

from __future__ import annotations

import hashlib
import json
import math
import random
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from arbora.llm import backoff, bpe, fingerprints, language, mixing, registry, repair, sharding, simhash, toxicity
from tests.llm.conftest import SCHEMA, labels_of, sentence, written

QUERIES = registry.queries()


def found(spark, name, folder):
    return {r["doc_id"]: r.asDict() for r in QUERIES[name](spark, folder).collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def test_op1_fingerprints(spark, odd, rows):
    got = found(spark, "op1_fingerprints", odd)
    texts = [(r[0], r[1] or "") for r in rows]
    errors = []

    def jaccard(a, b):
        a, b = Counter(a.lower().split()), Counter(b.lower().split())
        keys = a.keys() | b.keys()
        return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0

    for i, (k, t) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if k not in (18,):  # U+000B is no space to Python's split of text
            errors += [got[k]["near_edited"] - jaccard(t, edited), got[k]["near_next"] - jaccard(t, following)]
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.09
    assert got[24]["fingerprint"] == got[27]["fingerprint"] != got[30]["fingerprint"]


def backed_off(texts, order):
    """(words, log score, history words given up) of each text, by dictionaries."""
    words = [(t or "").encode().lower().split() for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    every = sum(map(grams, words), Counter())
    n = sum(map(len, words))
    for w in words:
        own, total, given_up = grams(w), 0.0, 0
        others = lambda g: every[g] - own[g]  # noqa: B023, E731
        for i in range(len(w)):
            longest = min(i, order - 1)
            k = next((k for k in range(longest, 0, -1) if others(tuple(w[i - k : i + 1]))), 0)
            seen = others(tuple(w[i - k : i + 1])) / others(tuple(w[i - k : i])) if k else max(others((w[i],)), 1) / max(n - len(w), 1)
            total += math.log(seen) + (longest - k) * math.log(0.4)
            given_up += longest - k
        yield len(w), total, given_up


@pytest.mark.parametrize("order", [1, 2, 3])
def test_op2_backoff(spark, odd, rows, order, monkeypatch):
    monkeypatch.setattr(backoff, "BATCH_BYTES", 20_000)  # many batches
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = {r["doc_id"]: r for r in backoff.score(docs, order).collect()}
    for (k, *_), (n, total, given_up) in zip(rows, backed_off([t for _, t, *_ in rows], order), strict=True):
        assert (got[k]["n_words"], got[k]["n_backoffs"]) == (n, given_up) and got[k]["log_score"] == pytest.approx(total, rel=1e-9, abs=1e-9)


def test_op3_counts(spark, odd, rows):
    got = found(spark, "op3_quality", odd)
    for k, t, *_ in rows:
        w = (t or "").encode().split()
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (got[k]["n_words"], got[k]["n_repeat_words"], got[k]["n_dup_lines"]) == (len(w), len(inside), len(lines) - len(set(lines)))
        assert got[k]["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
    assert not got[39]["kept"] and not got[42]["kept"] and got[0]["kept"]


def test_op3_rules_equal_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(3)
    phrases = ["Licensed Under", "ALL RIGHTS RESERVED", "copyright (C)", "terms of service", "cookie policy", "houſes cookies", "cooKie policy", "sıgn in to", "sign up for", "log in to", "login to", "log  in to", "skip to main content", "read more", "read more\r"]
    bits = [*phrases, "word", "Haus", "ABC", "aB", "ÀÉ", "éà", "X1y", "»", "|", "#", "*$%", "end.", "end.\r", "end!\u0085", "end? ", "fin…", " ", "\t", "\x0b", "\n", "\n", "", "🙂", "𝐀𝐁", "one two three four five six seven eight nine ten"]
    texts = [None, "", "\n", *phrases, *(f"x {p} y and ten words or more of them are in this line" for p in phrases)]
    texts += ["".join(rng.choice("aBcDEF 1") for _ in range(rng.randint(9, 18))) + "." for _ in range(150)]
    texts += [rng.choice(["\n", " ", ""]).join(rng.choice(bits) for _ in range(rng.choice([1, 2, 3, 8, 40, 90]))) for _ in range(300)]
    texts += [" ".join(rng.choice("abcdef") for _ in range(n)) for n in range(0, 80, 2)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        want = c.execute(registry.oracle_sql()["op3_quality"])
        names = [d[0] for d in want.description]
        rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert len(rows) == len(texts) and found(spark, "op3_quality", str(tmp_path)) == {r["doc_id"]: r for r in rows}


def test_op3_holds_a_line_against_boilerplate_once(spark, odd):
    plan = QUERIES["op3_quality"](spark, odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("icen[c") == 1


def test_op4_sharding(spark, odd, rows):
    got = found(spark, "op4_sharding", odd)
    assert sorted(r["position"] for r in got.values()) == list(range(len(rows)))
    per = Counter(r["shard"] for r in got.values())
    assert max(per.values()) - min(per.get(s, 0) for s in range(40)) <= 1
    for s in per:
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(per[s]))
    assert all(got[k]["size"] == len((t or "").encode()) + 16 and got[k]["text_crc32"] == zlib.crc32((t or "").encode()) for k, t, *_ in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 40, 1000, 4097])
def test_feistel_is_a_bijection(n):
    f = sharding.Feistel(n, 5)
    x = np.arange(n)
    assert sorted(f.forward(x)) == list(x) and (f.inverse(f.forward(x)) == x).all()


def test_op5_bpe(spark, odd, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = found(spark, "op5_bpe", odd)
    for k, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, own, rng = Tokenizer.from_file(path), bpe.ByteBPE(path), random.Random(1)
    pool = "ab Ab  \n\t'sréß漢字é́²½Ⅷ٣\x1c\x85\xa0 　😀!?.,<|endoftext|>ªº\x00ʰ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["x" * 3000, "the" * 90, "<|endoftext|>a<|endoftext|>"]
    for text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids and own.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_op6_simhash(spark, odd, rows):
    got = found(spark, "op6_simhash", odd)
    prints = {k: simhash.fingerprint(t, 4) for k, t, *_ in rows}
    reach = {k: k for k in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    reach[a] = reach[b] = min(reach[a], reach[b])
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{p:016x}", reach[k]) for k, p in prints.items()}
    assert got[24]["component_id"] == got[27]["component_id"] == 24 and got[12]["fingerprint"] == "0" * 16


def test_gray_index_equals_all_pairs():
    rng = np.random.default_rng(0)
    codes = []
    for base in rng.integers(0, 2**63, 80, dtype=np.int64).tolist():
        for _ in range(4):
            x = base
            for bit in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << bit
            codes.append(x)
    codes = np.unique(np.array(codes, np.uint64))
    group = np.unique(rng.integers(0, 5, len(codes)), return_inverse=True)[1]
    got = {(int(a), int(b)) for q, c in simhash.GrayIndex(codes, group).links(4) for a, b in zip(q, c, strict=True)}
    far = np.bitwise_count(codes[:, None] ^ codes[None])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero((far <= 4) & (group[:, None] == group[None])), strict=True)}


def test_hot_keys_lose_no_link(spark, monkeypatch):
    """With tiny groups every key is hot: chunks must still meet."""
    monkeypatch.setattr(simhash, "GROUP", 4)
    rng = random.Random(2)
    codes = {rng.getrandbits(63) & ~0xFFFF | rng.getrandbits(8) for _ in range(3)}
    codes |= {c ^ 1 << rng.randrange(40) ^ 1 << rng.randrange(40) for c in codes for _ in range(25)}
    df = spark.createDataFrame([(c,) for c in codes], "fingerprint bigint")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4)).collect()}
    want = {c: c for c in codes}
    for _ in range(len(codes)):
        for a in codes:
            for b in codes:
                if (a ^ b).bit_count() <= 4:
                    want[a] = want[b] = min(want[a], want[b])
    assert {c: root.get(c, c) for c in codes} == want


def test_op7_repair(spark, odd, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, at = found(spark, "op7_repair", odd), 0
    for k, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_words_equal_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, own, rng = Tokenizer.from_file(path), repair.WordEncoder(path), random.Random(1)
    pool = "ab Ab  \n\t'sréßİıſΣσ漢字é́²½Ⅷ٣\x1c\x1d\x85\xa0 　😀!?.,<|endoftext|>ªº\x00ʰ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["x" * 3000, "the" * 90, "<|endoftext|>a<|startoftext|> b", "don't we're 12'sx"]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused(tmp_path):
    """A file that cuts or normalises texts otherwise would give wrong ids without a word."""
    import public_tokenizers

    for name, kind in (("byte_bpe_50k.json", bpe.ByteBPE), ("word_bpe_49k.json", repair.WordEncoder)):
        spec = json.loads(Path(public_tokenizers.path(name)).read_text())
        spec["normalizer"] = {"type": "Lowercase"}
        (tmp_path / name).write_text(json.dumps(spec))
        with pytest.raises(ValueError, match="another way"):
            kind(str(tmp_path / name))


def test_caches_are_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "CACHE", 10)
    monkeypatch.setattr(repair, "CACHE", 10)
    own, words = bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json")), repair.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)) + " " + "y" * 500
    for code in (own, words):
        assert bytes(code.encode(text)) == bytes(code.encode(text))
    assert len(own.seen) <= 10 and len(words.words) <= 10 and len(words.words.before) <= 10 and not any("yy" in x for x in (*own.seen, *words.words))


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 9, 700)
    for ids in (np.concatenate([passage] * 40), rng.integers(0, 12, 20_000)):
        _, _, s = repair.compress(ids.astype(np.uint32), 12)
        pairs = np.stack([s[:-1], s[1:]], 1)[s[:-1] != s[1:]]  # pairs of one symbol overlap
        assert np.unique(pairs, axis=0, return_counts=True)[1].max(initial=0) < repair.LEAST


def test_grammar_round_trip():
    rng = np.random.default_rng(4)
    for ids in ([1] * 1001, [1, 1, 1, 2] * 50, [5], [1, 2] * 300, rng.integers(0, 6, 5000).tolist()):
        a = np.array(ids, np.uint32)
        rules, lengths, symbols = repair.compress(a, 10)
        s = repair.Shard(rules.tobytes(), lengths.tobytes(), symbols.tobytes(), 10)
        assert s.whole() == a.tobytes() and (s.ids(0, len(a)) == a).all() and (s.ids(len(a) // 3, len(a) // 2) == a[len(a) // 3 :][: len(a) // 2]).all()
        assert len(a) < 300 or len(symbols) < len(a)


def test_op8_language(spark, odd, rows):
    got = found(spark, "op8_language", odd)
    assert {got[k]["lang_pred"] for k in (12, 15, 18, 21)} == {"und"}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for k, r in got.items())
    clean = [(k, g) for k, t, g, *_ in rows if g and k > 50]
    assert np.mean([got[k]["lang_pred"] == g for k, g in clean]) > 0.9


def test_every_label_is_learned(spark, monkeypatch):
    """Also the rarest of many, in a sample that stays bounded."""
    monkeypatch.setattr(language, "SAMPLE_ROWS", 140, raising=False)
    sizes = []
    monkeypatch.setattr(language.ByteGRU, "train", lambda self, texts, labels: sizes.append(len(texts)))
    labels = [f"l{k:02}" for k in range(70) for _ in range(80 if k else 1)]
    df = spark.createDataFrame([(i, f"word {x}", x) for i, x in enumerate(labels)], "doc_id bigint, text string, lang string")
    assert language.learn(df).classes == sorted(set(labels)) and 70 <= sizes[0] < 250


def test_letters():
    """Digits, fractions, numerals and marks are no letters."""
    df = [(i, t) for i, t in enumerate(["² ½ Ⅷ", "12_", "é", "٣", "ª", "漢", "\u0301", "İ"])]
    assert [language._LETTER.search(t) is not None for _, t in df] == [False, False, True, False, True, True, False, True]


def test_predict_equals_one_window_at_a_time():
    """Pooling: each window by itself, one byte's probabilities after the other, in double precision."""
    net, rng = language.ByteGRU(["a", "b", "c"], hidden=4), random.Random(3)
    texts = ["".join(rng.choice("abcdé ") for _ in range(n)).encode() for n in (0, 1, 95, 96, 97, 200, 1000)]
    p = {k: v.astype(float) for k, v in net.p.items()}

    def states(d, codes):
        h, state, out = net.hidden, np.zeros(net.hidden), []
        for c in codes if d == "f" else codes[::-1]:
            x, g = p[f"X{d}"][:, c], p[f"U{d}"] @ state
            z, r = 1 / (1 + np.exp(-(x + g)[: 2 * h].reshape(2, h)))
            state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * g[2 * h :])
            out.append(state)
        return out if d == "f" else out[::-1]

    for text, got in zip(texts, net.predict(texts), strict=True):
        total = np.zeros(3)
        for at in range(0, len(text), language.WINDOW):
            codes = list(text[at : at + language.WINDOW])
            for f, b in zip(states("f", codes), states("b", codes), strict=True):
                y = np.exp(p["V"] @ np.concatenate([f, b]) + p["c"][:, 0])
                total += y / y.sum()
        assert np.allclose(got, total / max(1, len(text)), atol=1e-5)


def test_languages_apart_and_short():
    """Held-out accuracy for each language, and on texts of a few words."""
    rng = random.Random(8)
    make = lambda g, n: sentence(rng, g, n).encode()
    names = ["en", "fr", "de"]
    train = [(make(g, 60), i) for i, g in enumerate(names) for _ in range(80)]
    net = language.ByteGRU(names)
    net.train([t for t, _ in train], np.array([i for _, i in train]))
    for n, least in ((60, 0.97), (4, 0.8)):
        for i, g in enumerate(names):
            assert np.mean(net.predict([make(g, n) for _ in range(60)]).argmax(1) == i) >= least, (n, g)


def test_gru_gradients():
    net = language.ByteGRU(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    codes, labels = rng.integers(97, 100, (6, 4)).astype(np.uint8), rng.integers(0, 2, 4)
    _, grads = net._gradients(codes, labels)
    for name, g in grads.items():
        at = (0, 98) if name[0] == "X" else (0, 0)
        old, step = net.p[name][at], 1e-2
        net.p[name][at] = old + step
        up = net._gradients(codes, labels)[0]
        net.p[name][at] = old - step
        down = net._gradients(codes, labels)[0]
        net.p[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], abs=5e-4)


def test_op9_toxicity(spark, odd, rows):
    got = found(spark, "op9_toxicity", odd)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())
    marked = {k for k, t, *_ in rows if "stinker" in (t or "")}
    assert np.mean([got[k]["score"] for k in marked]) > np.mean([r["score"] for k, r in got.items() if k not in marked]) + 0.3


def test_misspelled_and_quoted():
    m = toxicity.Toxicity(["worthless", "idiot"], [7.0, 7.0])
    m.coef = np.array([3.0, -1.0, 1.0, 1.0, 1.0, -4.0])
    assert m.hit("w0rthless") == (1, 0) and m.hit("idiott!") == (1, 1) and m.hit("idiot") == (0, 1) and m.hit("patriot") is None
    assert m.score("you idiot") > 0.7 > m.score('they said "idiot" was the word they wrote') and m.score("") < 0.1


def test_ordinary_neighbours():
    """A clean word near a term is no misspelling of it, and does not keep other misspellings from being found."""
    m = toxicity.Toxicity(["moron", "worthless"], [7.0, 7.0], ordinary=frozenset({"oron"}))
    assert m.hit("oron") is None and m.hit("m0ron") == (1, 0) and m.hit("morron") == (1, 0) and m.hit("wrothless") == (2, 1)
    strict = toxicity.Toxicity(["moron"], [7.0], strict=frozenset({0}))
    assert strict.hit("morron") is None and strict.hit("moron!") == (0, 0)


def test_features_by_hand():
    """Every word looked at alone: its best term by plain edit distance, its context by its neighbours."""
    m = toxicity.Toxicity(["worthless", "idiot", "scum*"], [7.0, 6.0, 5.0])
    text = 'He said the word "idiot" there.\nYou are a w0rthless scumbag and an idiott, you idiot!  Nobody called\tthis "scummy thing" good'
    words = text.lower().split()
    value = {"idiot": 4.0, "worthless": 5.0, "scum": 3.0}
    # (place, term, edits) read off the text.
    hits = [(4, "idiot", 0), (9, "worthless", 1), (10, "scum", 0), (13, "idiot", 1), (15, "idiot", 0), (19, "scum", 0)]
    assert [w.strip('."!,') for w in (words[i] for i, *_ in hits)] == ["idiot", "w0rthless", "scumbag", "idiott", "idiot", "scummy"]
    sums, terms, n = [0.0, 0.0, 0.0], set(), 0
    for i, term, edits in hits:
        quoted = i in (4, 19)
        around = [w.strip('."!,') for w in words[max(0, i - 4) : i] + words[i + 1 : i + 5]]
        context = sum(w in toxicity.ADDRESS for w in around) - sum(w in toxicity.REPORTING for w in around) - 2 * quoted
        v = value[term] * toxicity.MISSPELLED**edits
        if context < 0:
            sums[1] += v
        else:
            sums[0] += v
            sums[2] += v * (context > 0)
            terms.add(term)
            n += 1
    want = [math.log1p(sums[0]), math.log1p(sums[1]), math.log1p(sums[2]), math.log1p(len(terms)), math.sqrt(n / len(words))]
    assert m.features(text) == pytest.approx(want)
    m.coef = np.array([1.0, -1.0, 0.5, 0.5, 2.0, -3.0])
    assert m.score(text) == pytest.approx(1 / (1 + math.exp(3.0 - np.dot(m.coef[:5], want))))


def test_trie_equals_edit_distance():
    terms = ["abba", "abcd", "dcba", "abcdabcd", "ddaabbccd"]
    trie, rng = toxicity.Trie(terms), random.Random(5)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(2, 11)))
        near = min(((edits(t, w), i) for i, t in enumerate(terms) if edits(t, w) <= toxicity.edits_of(t)), default=None)
        assert trie.nearest(w) == near
        assert near is None or trie.may_match(w)


def test_op10_mixing(spark, odd):
    got = found(spark, "op10_mixing", odd)
    assert all(r["rate"] >= 0 and r["copies"] >= math.floor(r["rate"]) for r in got.values())
    assert all(sum(r[f"p_{d}"] for d in mixing.TARGETS) == pytest.approx(1) for r in got.values())


def test_rates_meet_targets(spark):
    """By both ways over the cells, and as any point nearby is worse."""
    rng = np.random.default_rng(1)
    cells = {}
    for _ in range(300):
        p = rng.multinomial(100, rng.dirichlet([1, 1, 1]))
        cells[tuple(p.tolist())] = int(rng.integers(1, 500))
    df = spark.createDataFrame([(list(c), n) for c, n in cells.items()], "cell array<bigint>, tokens bigint")
    targets = np.array([0.5, 0.3, 0.2])
    history, reached = mixing.fit_rates(df, targets)
    assert np.abs(reached - targets).max() < 0.002
    c, n = np.array(list(cells)), np.array(list(cells.values()))
    w = mixing.rates_of(c, history)[0]
    assert (w >= 0).all() and np.allclose((w * n) @ (c / 100) / n.sum(), reached)

    def cost(w):
        return 0.5 * np.square((w * n) @ (c / 100) / n.sum() - targets).sum() + mixing.PULL / 2 * (n / n.sum() * np.square(w - 1)).sum()

    assert all(cost(w) <= cost(np.maximum(0, w + rng.normal(0, 0.05, len(w)))) for _ in range(200))
    with pytest.raises(RuntimeError, match="rest"):
        mixing.fit_rates(df, targets, steps=3)
    with pytest.raises(RuntimeError, match="rest"):
        mixing._in_passes(df, targets, 3)


def test_passes_equal_one_task(spark, monkeypatch):
    """The distributed passes, stopped early, took the same steps as one task."""
    df = spark.createDataFrame([([70, 30], 10), ([20, 80], 30), ([50, 50], 5)], "cell array<bigint>, tokens bigint").repartition(3)
    monkeypatch.setattr(mixing, "REST", 1e-3)
    one, many = mixing._in_one_task(df, np.array([0.6, 0.4]), 300), mixing._in_passes(df, np.array([0.6, 0.4]), 300)
    c, n = np.array([[70, 30], [20, 80], [50, 50]]), np.array([10, 30, 5])
    assert np.allclose(one[0][: len(many[0])], many[0]) and np.allclose((mixing.rates_of(c, many[0])[0] * n) @ (c / 100) / n.sum(), many[1])


def test_op10_totals(spark, odd):
    """The rates of the query, with its own posteriors and tokens, give the targets; the fit's grid is the difference."""
    got = list(found(spark, "op10_mixing", odd).values())
    tokens = sum(r["n_tokens"] for r in got)
    reached = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) / tokens for d in mixing.TARGETS}
    there = {r["domain_pred"] for r in got}
    wanted = {d: mixing.TARGETS[d] / sum(mixing.TARGETS[x] for x in there) for d in there}
    assert all(abs(reached[d] - wanted[d]) < 0.03 for d in there), (reached, wanted)


def test_weights_beyond_counts(spark):
    """Any positive weights: the share of agreeing samples is the generalised Jaccard similarity."""
    terms = [(0, i, 0.5 + i % 3, 1.0 + i % 2) for i in range(60)]
    df = spark.createDataFrame([(k, hash((i, "t")) & (2**62 - 1), a, b) for k, i, a, b in terms], "key int, term bigint, a double, b double")
    same = total = 0
    for r in fingerprints.signatures(df, ["key"], ["a", "b"], samples=1024).collect():
        same += sum(x == y for x, y in zip(r["a"], r["b"], strict=True))
        total += len(r["a"])
    want = sum(min(a, b) for *_, a, b in terms) / sum(max(a, b) for *_, a, b in terms)
    assert same / total == pytest.approx(want, abs=0.06)


def test_samples_equal_brute_force(spark, odd, rows):
    """Signatures recomputed outside Spark.  Logarithms may differ in the last bit, and so a few of many samples."""

    def uniform(h, shift):
        return ((h >> shift & 0xFFFFFFFF) + 0.5) * 2.0**-32

    def log_sample(term, k, weight):
        by_k = xxhash.xxh64_intdigest(struct.pack("<i", k), term)
        g1, g2, g3 = (xxhash.xxh64_intdigest(struct.pack("<i", salt), by_k) for salt in (1, 2, 3))
        r = -math.log(uniform(g1, 0) * uniform(g1, 32))
        log_c = math.log(-math.log(uniform(g2, 0) * uniform(g2, 32)))
        b = uniform(g3, 0)
        return log_c - r * (math.floor(math.log(weight) / r + b) - b + 1)

    got = found(spark, "op1_fingerprints", odd)
    same = total = 0
    for k, t, *_ in rows[:10] + rows[13:30]:
        terms = [(xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(w, 42)), 42), n) for w, n in Counter((t or "").lower().encode().split()).items()]
        own = [min((log_sample(w, s, n) for w, n in terms), default=None) for s in range(fingerprints.SAMPLES)]
        digits = "".join("0" * 8 if x is None else f"{xxhash.xxh64_intdigest(struct.pack('<d', x), 42) & 0xFFFFFFFF:08x}" for x in own)
        told = got[k]["fingerprint"]
        same += sum(digits[i : i + 8] == told[i : i + 8] for i in range(0, len(digits), 8))
        total += fingerprints.SAMPLES
    assert same > 0.9 * total


def repeated(rows):
    """Rows of one key, of none, and rows that repeat; and which text each result row must be of."""
    one = [(7, *r[1:]) for r in rows[:12] + rows[13:20]]
    none = [(None, *r[1:]) for r in rows[20:30] + rows[4:7]]
    return one + none + [rows[40]] * 5 + rows[41:50] + [(7, *rows[40][1:])] * 3


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory, rows):
    made = repeated(rows)
    return made, written(spark, tmp_path_factory.mktemp("shared"), made, labels_of(rows) + [(7, 1, 0), (7, 1, 0), (7, 0, 1)])


def text_facts(name, made):
    """What a result row must say of its text alone; None where a row depends on others."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [(r[0], r[1] or "") for r in made]
    if name == "op1_fingerprints":
        return ("doc_id", "n_chars"), [(k, len(t)) for k, t in texts]
    if name == "op2_backoff":
        return ("doc_id", "n_words", "n_backoffs"), [(k, n, g) for (k, _), (n, _, g) in zip(texts, backed_off([t for _, t in texts], backoff.ORDER), strict=True)]
    if name == "op3_quality":
        return ("doc_id", "n_words"), [(k, len(t.encode().split())) for k, t in texts]
    if name == "op4_sharding":
        return ("doc_id", "size", "text_crc32"), [(k, len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in texts]
    if name == "op5_bpe":
        code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        return ("doc_id", "n_tokens"), [(k, len(code.encode(t, add_special_tokens=False).ids)) for k, t in texts]
    if name == "op6_simhash":
        return ("doc_id", "fingerprint"), [(k, f"{simhash.fingerprint(t, 4):016x}") for k, t in texts]
    if name == "op7_repair":
        code = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        ids = [[*code.encode(t, add_special_tokens=False).ids, 2] for _, t in texts]
        return ("doc_id", "n_tokens", "ids_crc32"), [(k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (k, _), x in zip(texts, ids, strict=True)]
    return ("doc_id",), [(k,) for k, _ in texts]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_shared_null_and_repeated_keys(spark, shared, name):
    made, folder = shared
    columns, want = text_facts(name, made)
    got = QUERIES[name](spark, folder).collect()
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(want)
    if name == "op1_fingerprints":  # nulls first, rows of a key in any order among themselves; the last is followed by the first
        edited = Counter(r["edited_sha256"] for r in got)
        heads = Counter()
        texts = [r[1] or "" for r in made]
        for t in texts:
            cut = len(t) // 4
            heads.update({hashlib.sha256((t[: len(t) - cut] + u[:cut]).encode()).hexdigest() for u in texts})
        assert all(heads[x] for x in edited)
    if name == "op4_sharding":
        assert sorted(r["position"] for r in got) == list(range(len(made)))
    if name == "op6_simhash":
        least = {}
        for r in got:
            if r["doc_id"] is not None:
                least[r["fingerprint"]] = min(least.get(r["fingerprint"], r["doc_id"]), r["doc_id"])
        assert all(r["component_id"] <= least[r["fingerprint"]] for r in got if r["fingerprint"] in least)
    if name == "op7_repair":
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    if name in ("op8_language", "op9_toxicity"):
        assert all(0 <= r["score"] <= 1 for r in got)
    if name == "op10_mixing":
        assert all(r["rate"] >= 0 for r in got)


def test_sharding_is_reproducible(spark, odd):
    """Other partitions, same shards and slots."""
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "n_chars")
    results = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts + 1)
        results.append({tuple(r) for r in sharding.shard(docs.repartition(parts), "doc_id", "n_chars").select("doc_id", "shard", "slot").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    assert results[0] == results[1]


def test_many_buckets_by_one_key(spark, rows, monkeypatch):
    """A key that holds nearly all rows is cut by the hash of its texts, and each row still meets the next."""
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 2000)
    made = [(7 if i % 9 else None, f"text {i} " + "ab" * (i % 50), "en", "s", 1, "", 0.5, 1, 2) for i in range(400)] + [(9, "last one", "en", "s", 1, "", 0.5, 1, 2)]
    got = fingerprints.with_next(spark.createDataFrame(made, SCHEMA)).filter("not guest").collect()
    assert len(got) == len(made) and len({r["bucket"] for r in got}) > 10
    following = {r["text"]: r["next_text"] for r in got}
    at, seen = got[0]["text"], set()
    while at not in seen:  # one cycle through all rows
        seen.add(at)
        at = following[at]
    assert len(seen) == len(made)
    key = {r["text"]: r["key"] for r in got}
    assert key[following["last one"]] is None
