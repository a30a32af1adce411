from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, score double, bucket int, part int"
SYLLABLES = {"en": "the ing er and ou sh wh", "fr": "é eau ou que ré è tion", "de": "sch ung ö ß keit ch"}


def sentence(rng, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(words)).capitalize() + "."


def made(n=60, seed=3):
    """Documents with nulls, empty and blank texts, copies, near copies, odd characters, a very long text, junk and toxic ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        text = "\n".join(sentence(rng, lang, rng.randint(8, 30)) for _ in range(rng.randint(2, 6)))
        if lang == "en" and i % 5 == 0:
            text = text.replace("the ", "stinker the dolt ")
        rows.append([i * 3, text, lang])
    rows[4][1], rows[5][1], rows[6][1], rows[7][1] = None, "", " \n\t \x0b", "12 34 !!"
    rows[9][1] = rows[8][1]
    rows[10][1] = rows[8][1] + " extra"
    rows[11][1] = sentence(rng, "fr", 30_000)
    rows[12][1] = "漢字 é́ ² ½ <|endoftext|> \x1c İ 😀 " * 12
    rows[13][1] = "\n".join("HOME | NEWS | SHOP" for _ in range(30))
    rows[14][1] = "the same words again " * 40
    rows[15][2] = None
    return [(k, t, g, f"s{k % 2}", len(t or ""), "old", 0.5, 1, 2) for k, t, g in rows]


def labels_of(rows):
    return [(r[0], 0 if r[0] in (39, 42) else 1, int("stinker" in (r[1] or ""))) for r in rows] + [(None, 1, 1), (999_999, None, None)]


def written(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory, rows):
    return written(spark, tmp_path_factory.mktemp("odd"), rows, labels_of(rows))


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("nothing"), [], [])
