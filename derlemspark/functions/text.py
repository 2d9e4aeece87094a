"""Column functions on text shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column | str) -> Column:
    """Lower case in which the dotted capital I is one letter."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def first_rule(text: Column, rules: Iterable[tuple[str, str]], default: Column | None = None) -> Column:
    """Result of the first rule whose pattern is found in the text: one ordered CASE."""
    return F.coalesce(*[F.when(F.regexp_like(text, F.lit(p)), F.lit(v)) for p, v in rules], default if default is not None else F.lit(None).cast("string"))


def first_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """First keyword of the list that the text contains, or null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords])


def replace_all(text: Column, patterns: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), patterns, text)


def tokens(text: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.filter(F.split(fold(text), r"[^a-z0-9çğıöşüâîû]+"), lambda w: w != "")


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ascii_fold(text: Column) -> Column:
    """Turkish letters to ASCII, after lower case."""
    return F.translate(fold(text), "çğıöşüâîû", "cgiosuaiu")


#: What stands before a word: the start of the text or a sign that no word has (in patterns that every engine reads alike).
START = "(?:^|[^0-9a-z_çğıöşüâîû])"


def begins(words: str, then: str = "") -> str:
    """Pattern for a word that begins with one of the words, followed somewhere by one that begins with one of the others."""
    return f"{START}(?:{words})" + (f".*{START}(?:{then})" if then else "")


def up_to_last(words: str) -> str:
    """Pattern for a text up to its last word that begins with one of the words."""
    return f"^.*{START}(?:{words})"
