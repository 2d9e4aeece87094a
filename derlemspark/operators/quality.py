"""Quality predicates, issue tables and corpus statistics over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import first_keyword, fold
from .joins import guarded_join

BUCKETS = ((50, "<50"), (200, "50-200"), (1000, "200-1K"), (5000, "1K-5K"), (50000, "5K-50K"))


def blank(c: Column) -> Column:
    return c.isNull() | (F.length(F.trim(c)) == 0)


def reject_reason(content: Column, kind: Column, category: Column, minimum: int = fixed.MIN_CONTENT) -> Column:
    """First failing ingest rule: empty, short, placeholder, metadata; null for a valid document."""
    marked = F.lit(False)
    for p in fixed.PLACEHOLDER_PATTERNS:
        marked = marked | F.regexp_like(fold(content), F.lit(p))
    return (
        F.when(blank(content), "empty")
        .when((F.length(F.trim(content)) < minimum) & ~F.coalesce(kind.isin(*fixed.SHORT_KINDS), F.lit(False)), "short")
        .when(marked, "placeholder")
        .when(~F.coalesce(category.isin(*fixed.CATEGORIES) & kind.isin(*fixed.DOC_KINDS), F.lit(False)), "metadata")
    )


def bucket(length: Column) -> Column:
    out = F.lit(">50K")
    for limit, name in reversed(BUCKETS):
        out = F.when(length < limit, name).otherwise(out)
    return out


def issues(docs: DataFrame, id_col: str, content: str, required: list[str], recommended: list[str], url: str, title: str) -> DataFrame:
    """id, severity, field, message of every issue of every document, the first id of each url by a grouped minimum; no text is shuffled by url."""
    found = [F.when(blank(F.col(c)), F.struct(F.lit("error").alias("severity"), F.lit(c).alias("field"), F.lit("missing").alias("message"))) for c in required]
    found += [F.when(blank(F.col(c)), F.struct(F.lit("info").alias("severity"), F.lit(c).alias("field"), F.lit("missing").alias("message"))) for c in recommended]

    def say(condition: Column, severity: str, field: str, message: Column) -> Column:
        return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), message.alias("message")))

    n, word = F.length(F.trim(content)), first_keyword(fold(content), fixed.PLACEHOLDER_KEYWORDS)
    found += [
        say(~blank(F.col(title)) & (F.length(F.trim(title)) < 3), "warning", "title", F.lit("short")),
        say(F.coalesce(n, F.lit(0)) < fixed.MIN_CONTENT, "warning", "content", F.lit("short")),
        say(n > fixed.MAX_CONTENT, "warning", "content", F.lit("long")),
        say(word.isNotNull(), "error", "content", word),
    ]
    own = docs.select(id_col, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select(id_col, "i.*")
    keyed = docs.filter(~blank(F.col(url))).select(id_col, url)
    again = guarded_join(keyed, firsts(keyed, url, id_col), [url]).filter(F.col("__first") < F.col(id_col))
    return own.unionAll(again.select(id_col, F.lit("warning"), F.lit(url), F.concat(F.lit("duplicate of "), F.col("__first").cast("string"))))


def firsts(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """key, __first: the least id of each key that has more than one row; a partial aggregation, so a hot key costs one row a task."""
    return rows.groupBy(key).agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(key, "__first")
