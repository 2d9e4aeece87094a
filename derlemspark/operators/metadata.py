"""Years and public addresses of documents from their metadata and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import ascii_fold, fold
from .joins import guarded_join

YEARS = r"(20[0-9]{2})\s*[-–—/]\s*(20[0-9]{2})"
YEAR = "20[0-9]{2}"
#: Characters before and after a pair of years in which a word of the school year must stand.
AROUND = 80


def file_name(path: Column) -> Column:
    """What stands after the last slash or backslash of a path or url, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"([^/\\]*)$", 1)


def academic_year(text: Column) -> Column:
    """First pair of successive years (as 2024-2025) of a text that has a word of the school year around it; null without one."""
    pieces = F.zip_with(F.split(text, YEARS), F.regexp_extract_all(text, F.lit(YEARS), F.lit(0)), lambda part, hit: F.struct(part.alias("part"), hit.alias("hit")))

    def add(state: Column, piece: Column) -> Column:
        start, n = state["at"] + F.length(piece["part"]), F.coalesce(F.length(piece["hit"]), F.lit(0))
        first, second = (F.regexp_extract(piece["hit"], YEARS, k) for k in (1, 2))
        around = fold(F.substring(text, F.greatest(start - AROUND, F.lit(0)) + 1, F.least(start, F.lit(AROUND)) + n + AROUND))
        good = (second.try_cast("int") - first.try_cast("int") == 1) & F.regexp_like(around, F.lit("|".join(fixed.ACADEMIC_CONTEXT)))
        return F.struct((start + n).alias("at"), F.coalesce(state["year"], F.when(good, F.concat(first, F.lit("-"), second))).alias("year"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("year")), add, lambda s: s["year"])


def single_year(text: Column) -> Column:
    """The only year a text names besides pairs of years; null for none or several."""
    found = F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, YEARS, " "), F.lit(rf"\b{YEAR}\b"), F.lit(0)))
    return F.when(F.size(found) == 1, found[0])


def document_years(title: Column, path: Column, kind: Column, text: Column) -> tuple[Column, Column]:
    """academic_year, from title, file name or text, and, without one, document_year of reports, from title or file name."""
    name = file_name(path)
    academic = F.coalesce(academic_year(title), academic_year(name), academic_year(text))
    report = F.coalesce(kind.isin(*fixed.REPORT_KINDS), F.lit(False)) | F.regexp_like(fold(F.concat_ws(" ", title, name)), F.lit("|".join(fixed.REPORT_WORDS)))
    return academic, F.when(academic.isNull() & report, F.coalesce(single_year(title), single_year(name)))


def name_key(name: Column) -> Column:
    """Key by which file names and titles are compared: ASCII letters and digits in lower case, without the ending .pdf."""
    return F.trim(F.regexp_replace(ascii_fold(F.regexp_replace(name, "(?i)[.]pdf$", "")), "[^a-z0-9]+", " "))


def unambiguous(links: DataFrame) -> DataFrame:
    """key, public: the url of each key that has a single one. links: key, url."""
    return links.filter("key <> ''").groupBy("key").agg(F.min("url").alias("public"), F.max("url").alias("__last")).filter("public = __last").select("key", "public")


def with_public_urls(docs: DataFrame, links: DataFrame, path: str, title: str) -> DataFrame:
    """docs with file_path, public_url and status of a local path: resolved by its file name or else by the title, or unresolved_local_pdf.

    A web address is its own public url and has no status; nothing comes of a missing path. links: key, url.
    """
    known = unambiguous(links)
    local = ~F.col(path).rlike(r"(?i)^\s*https?://") & (F.trim(path) != "")
    out = docs.withColumn("__k1", F.when(local, name_key(file_name(F.col(path))))).withColumn("__k2", F.when(local, name_key(F.col(title))))
    for k in ("__k1", "__k2"):
        out = guarded_join(out, known.select(F.col("key").alias(k), F.col("public").alias(f"{k}_url")), [k], "left")
    found = F.coalesce("__k1_url", "__k2_url")
    out = out.withColumn("file_path", F.when(local, F.col(path))).withColumn("public_url", F.when(local, found).when(F.trim(path) != "", F.col(path)))
    status = F.when(local, F.when(found.isNotNull(), "resolved").otherwise("unresolved_local_pdf"))
    return out.withColumn("status", status).drop("__k1", "__k2", "__k1_url", "__k2_url")
