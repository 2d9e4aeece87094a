"""Registry of queries over the test tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Tables whose rows hold texts: a single small file of them still keeps all cores busy.
TEXTS = ("documents", "page_results", "static_slugs_output", "test_seed")


class Tables:
    """Tables of one folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = table(self.spark, self.folder, name)
        return spread(df) if name in TEXTS else df


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def case_sql(text: str, rules, default: str = "NULL") -> str:
    """The rules as one SQL CASE, in order."""
    quote = lambda s: s.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{quote(p)}') THEN '{quote(v)}'" for p, v in rules) + f" ELSE {default} END"


def list_sql(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


#: SQL of functions.text.fold and functions.text.tokens.
def fold_sql(c: str) -> str:
    return f"lower(replace({c}, 'İ', 'i'))"


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({fold_sql(c)}, '[^a-z0-9çğıöşüâîû]+'), lambda w: w <> '')"
