"""Personal data in text: ordered replacements that give the same alias for the same input every time."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what counts as an e-mail address.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
# Names up to this length are replaced only where no letter touches them; names that are ordinary words of programs.
SHORT_NAME = 4
ORDINARY = frozenset({"max", "floor"})


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def unaccent(text: pd.Series) -> pd.Series:
    """Letters without their marks.  Spark has no function for Unicode decomposition."""
    return text.map(lambda x: x if x is None or x.isascii() else strip_accents(x))


def exactly(text: str) -> str:
    """A pattern for ``text`` itself, whatever its case (of all letters, not of ASCII's alone).  Signs are escaped, so any engine reads it alike."""
    return "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", text)


@dataclass(frozen=True)
class Rule:
    """A pattern and its replacement."""

    pattern: str
    alias: str


def replace_all(text: Column, rules: list[Rule]) -> Column:
    """Rules one after the other, each on what the last one left."""
    for r in rules:
        text = F.regexp_replace(text, r.pattern, r.alias)
    return text


def replace_emails(text: Column, alias: str = "user@example.com") -> Column:
    return F.regexp_replace(text, EMAIL, alias)


def alias_emails(text: Column, salt: str = "") -> Column:
    """The text with each address replaced by a digest of itself in lower case: the same address has the same alias wherever it stands, others have others."""
    aliases = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda x: F.concat(F.substring(F.sha2(F.concat(F.lit(salt), F.lower(x)), 256), 1, 10), F.lit("@example.com")))
    return F.array_join(F.zip_with(F.split(text, EMAIL, -1), aliases, lambda between, alias: F.concat(between, F.coalesce(alias, F.lit("")))), "")


def name_alias(name: str, salt: str = "") -> str:
    import hashlib

    return "N" + hashlib.sha256((salt + name.lower()).encode()).hexdigest()[:8]


def number_alias(number: str, salt: str = "") -> str:
    import hashlib

    return str(int(hashlib.sha256((salt + number).encode()).hexdigest(), 16) % 9_000_000 + 1_000_000)


def student_rules(name: str, number: str | None, salt: str = "") -> list[Rule]:
    """Rules for one student, named "Last, First": the number; then each of the names as it is, with and without accents; then the words of names of several.

    A name over ``SHORT_NAME`` letters goes anywhere, a shorter one only between non-letters, which stay.  Of the words of a name only those over
    ``SHORT_NAME`` letters go, so that particles ("de", "van") stay where they are no name by themselves.  Ordinary words stay.
    """
    rules = [Rule(exactly(number), number_alias(number, salt))] if number else []

    def anywhere(piece: str) -> None:
        rules.extend(Rule(exactly(form), name_alias(piece, salt)) for form in dict.fromkeys((piece, strip_accents(piece))))

    names = [n.strip() for n in name.split(",") if n.strip()]
    for n in names:
        if n.lower() in ORDINARY:
            continue
        if len(n) > SHORT_NAME:
            anywhere(n)
        else:
            rules.extend(Rule(rf"(?iu)(^|[^a-zA-Z])({exactly(form).removeprefix('(?iu)')})([^a-zA-Z]|$)", f"$1{name_alias(n, salt)}$3") for form in dict.fromkeys((n, strip_accents(n))))
    for n in names:
        for part in n.split():
            if len(part) > SHORT_NAME and part != n and part.lower() not in ORDINARY:
                anywhere(part)
    return rules


def map_strings(column: Column, kind: T.DataType, f: Callable[[Column], Column]) -> Column:
    """``f`` on every string of a column of type ``kind``, however deep in structs, arrays and the values of maps; all else stays."""
    if isinstance(kind, T.StringType):
        return f(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: map_strings(x, kind.elementType, f))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, x: map_strings(x, kind.valueType, f))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[map_strings(column[x.name], x.dataType, f).alias(x.name) for x in kind.fields]))
    return column
