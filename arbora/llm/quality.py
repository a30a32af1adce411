"""Line-first cleaning, in DataFrame functions only.

Every line of a text is held against rules on punctuation, navigation and boilerplate; lines that fail are removed; a document that
loses over ``MAX_LOST_PERCENT`` of its characters is rejected, as is one that fails the base rules.  Nothing is shuffled: a text's lines and
words are arrays of its own row, and windows of words that repeat are found by sorting their hashes with their places.

A null text counts as empty: it has no words, so it fails the base rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import SPACES, documents, let

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 40
#: A line without end punctuation fails only if it is shorter than this.
SHORT_LINE_WORDS = 10
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    r"(?i)licen[cs]ed under|all rights reserved|copyright \(c\)|terms of (use|service)|privacy policy|cookie policy|uses cookies|enable javascript"
    r"|lorem ipsum|click here|sign (in|up) (to|for)|log ?in to|subscribe (to|now)|skip to (main )?content|read more$"
)
#: How a sentence may end, closing quotes and brackets included.
ENDED = r"[.!?…:;\"'”’»)\]]$"


#: The two patterns as Java reads them.  SQL's ``$`` is the end of the line alone (Java's also stands before a last ``\r``), its ``(?i)`` knows of ſ and K.
_ENDED = ENDED.removesuffix("$") + r"\z"
#: ``BOILERPLATE``'s alternatives, each parted at its first space: what stands before and after is looked at only there.
_PARTED = [re.split(" (?![?])", a, maxsplit=1) for a in re.split(r"\|(?![^(]*\))", BOILERPLATE.removeprefix("(?i)"))]
_BOILERPLATE = "(?i) (?:" + "|".join(f"(?={after})(?<={before} )" for before, after in _PARTED).replace("$", r"\z").replace("s", "[sſ]").replace("k", "[kK]") + ")"
#: More upper than lower case letters can only be where two of them have at most one lower case letter between them.
_DENSE = r"\p{Lu}[^\p{Lu}\p{Ll}]*+(?:\p{Ll}[^\p{Lu}\p{Ll}]*+)?+\p{Lu}"


def words(text: Column) -> Column:
    """The words of a text: runs without U+0020 and U+0009 to U+000D."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(windows: Column) -> Column:
    """How many words lie in a 3-word window found twice or more; ``windows`` are 64-bit hashes in order."""

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(same, lambda e: e["p"]))

    def spread(p: Column) -> Column:
        # A window covers three words, or as many as lie before the next such window.
        own = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("bigint"))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)

    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    # Most texts repeat no window; those need no sorting.
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(let(let(F.sort_array(placed), twice), spread))


def _facts(line: Column) -> Column:
    """What the rules need to know of a line."""
    return F.struct(
        line.alias("line"),
        words(line).alias("words"),
        F.regexp_replace(line, "[^#*$%&|<>»›]+", "").alias("marks"),
    )


def _judge(f: Column) -> Column:
    """A line's facts, with its symbols counted and whether it has words and breaks a rule."""
    n = F.size(f["words"])
    symbols = _count(f["marks"], SYMBOLS)
    letters = lambda kind: F.length(F.regexp_replace(f["line"], rf"[^\p{{{kind}}}]+", ""))
    shouting = f["line"].rlike(_DENSE) & let(F.struct(letters("Lu").alias("u"), letters("Ll").alias("l")), lambda x: (x["u"] > x["l"]) & (x["u"] + x["l"] > 10))
    unended = (n < SHORT_LINE_WORDS) & ~F.rtrim(f["line"]).rlike(_ENDED)
    navigation = _count(f["marks"], "|»›") * 4 >= n
    fails = (n > 0) & ((symbols * 3 >= n) | navigation | unended | shouting | f["line"].rlike(_BOILERPLATE))
    return F.struct(f["line"].alias("line"), f["words"].alias("words"), symbols.alias("symbols"), F.length(f["line"]).alias("size"), (n > 0).alias("worded"), fails.alias("fails"))


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``facts`` (a struct of counts), ``cleaned`` (the text without failing lines), ``base_failed`` and ``kept``.

    Columns of those names are replaced; all others stay as they are.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("facts", "cleaned", "base_failed", "kept")]
    rows = F.col("__lines")
    total = lambda of, count: F.aggregate(of, F.lit(0).cast("bigint"), lambda a, f: a + count(f))
    # A line break parts words, so a text's words are those of its lines.
    judged = df.select(*rest, F.transform(F.transform(lines, _facts), _judge).alias("__lines"))
    split = judged.select(
        *rest,
        F.flatten(F.transform(rows, lambda f: f["words"])).alias("__words"),
        total(rows, lambda f: f["symbols"]).alias("__n_symbols"),
        F.transform(F.filter(rows, lambda f: f["worded"]), lambda f: f["line"]).alias("__worded"),
        let(F.filter(rows, lambda f: f["fails"]), lambda b: F.struct(F.size(b).cast("bigint").alias("n"), total(b, lambda f: f["size"]).alias("chars"))).alias("__lost"),
        total(F.filter(rows, lambda f: f["worded"]), lambda f: f["size"]).alias("__line_chars"),
        F.array_join(F.transform(F.filter(rows, lambda f: ~f["fails"]), lambda f: f["line"]), "\n").alias("__text"),
    )
    # The last two hashes are of two words and one, so they equal none of a window.
    hashed = F.transform("__words", lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)))
    counted = split.select(
        *rest,
        F.size("__words").cast("bigint").alias("__n_words"),
        hashed.alias("__windows"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("__word_chars"),
        (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("bigint").alias("__n_dup_lines"),
        *[F.col(c) for c in ("__n_symbols", "__lost", "__line_chars", "__text")],
    ).withColumn("__repeats", repeated_words(F.col("__windows")))
    n, repeats = F.col("__n_words"), F.col("__repeats")
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    facts = F.struct(
        n.alias("n_words"),
        F.col("__word_chars").alias("word_chars"),
        F.col("__n_symbols").alias("n_symbols"),
        F.col("__n_dup_lines").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.col("__lost.n").alias("n_lost_lines"),
        F.col("__lost.chars").alias("lost_chars"),
        F.col("__line_chars").alias("line_chars"),
    )
    kept = ~failed & (100 * F.col("__lost.chars") <= MAX_LOST_PERCENT * F.col("__line_chars"))
    return counted.select(*rest, facts.alias("facts"), F.col("__text").alias("cleaned"), failed.alias("base_failed"), kept.alias("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    judged = clean_lines(documents(spark, sf_dir).select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"facts.{c}").alias(c) for c in counts], "base_failed", "kept", F.col("facts.n_lost_lines").alias("n_lost_lines"), F.col("facts.lost_chars").alias("lost_chars"), F.col("facts.line_chars").alias("line_chars"))


_LINE_SQL = rf"""
  SELECT doc_id, length(line) AS size,
    len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
    length(line) - length(regexp_replace(line, '[|»›]', '', 'g')) AS bars,
    length(regexp_replace(line, '[^\p{{Lu}}]+', '', 'g')) AS upper,
    length(regexp_replace(line, '[^\p{{Ll}}]+', '', 'g')) AS lower,
    NOT regexp_matches(rtrim(line, ' '), '{ENDED.replace("'", "''")}') AS unended,
    regexp_matches(line, '{BOILERPLATE}') AS boilerplate
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
"""

OP3_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM texts WHERE len(w) >= 3),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM places),
covered AS (SELECT doc_id, count(DISTINCT p + d) AS n FROM windows, (VALUES (0), (1), (2)) AS s(d) WHERE n >= 2 GROUP BY doc_id),
lines AS ({_LINE_SQL}),
failing AS (
  SELECT doc_id, size, words, words > 0 AND (symbols * 3 >= words OR bars * 4 >= words OR (upper > lower AND upper + lower > 10)
    OR (words < {SHORT_LINE_WORDS} AND unended) OR boilerplate) AS fails FROM lines),
lost AS (
  SELECT doc_id, CAST(count(*) FILTER (fails) AS BIGINT) AS n_lost_lines, CAST(coalesce(sum(size) FILTER (fails), 0) AS BIGINT) AS lost_chars,
    CAST(coalesce(sum(size) FILTER (words > 0), 0) AS BIGINT) AS line_chars FROM failing GROUP BY doc_id),
counted AS (
  SELECT texts.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts LEFT JOIN covered ON texts.doc_id = covered.doc_id),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT based.*, NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * line_chars AS kept, n_lost_lines, lost_chars, line_chars
FROM based JOIN lost ON based.doc_id = lost.doc_id
"""
