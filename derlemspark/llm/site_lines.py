"""Lines repeated across one site's documents.

A line is normalised (white space to one blank, digit runs to one sign) and hashed; rows are counted
by site and hash with a map-side combine; the lines above a share of the site's rows are joined back.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import guarded_join
from ..session import reliable, spread

MIN_ROWS = 4
MIN_SHARE = 0.25

_DIGITS = re.compile(r"\d+")
#: Lines a worker keeps hashes of; emptied when full.
CACHE = 300_000


def site_of(url: Column) -> Column:
    """Host of a url in lower case, without a leading www., user or port; null if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def normal_line(line: str) -> str:
    """Trimmed line with one blank for each run of white space and 0 for each run of digits."""
    return _DIGITS.sub("0", " ".join(line.split()))


class LineHashes(dict):
    """line -> signed 64-bit hash of its normal form, None for an empty line."""

    def __missing__(self, line: str) -> int | None:
        if len(self) >= CACHE:
            self.clear()
        normal = normal_line(line)
        value = xxhash.xxh64_intdigest(normal) - (1 << 63) if normal else None
        self[line] = value
        return value


_lines = LineHashes()


@F.arrow_udf(T.ArrayType(T.LongType()))
def line_hashes(texts: pa.Array) -> pa.Array:
    """For each line of a text its hash, null for an empty line; null for a null text."""
    get = _lines.__getitem__
    return pa.array([None if t is None else list(map(get, t.split("\n"))) for t in texts.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def positions_within(hashes: pa.Array, frequent: pa.Array) -> pa.Array:
    """Positions of the hashes that the second array has."""
    out, last, known = [], None, frozenset()
    for h, f in zip(hashes.to_pylist(), frequent.to_pylist()):
        if f != last:
            last, known = f, frozenset(f or ())
        out.append([i for i, x in enumerate(h or ()) if x in known and x is not None])
    return pa.array(out, pa.list_(pa.int32()))


@F.arrow_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("removed", T.IntegerType())]))
def rebuilt(texts: pa.Array, frequent: pa.Array) -> pa.Array:
    """Text without the lines whose hashes the second array has, and how many those are."""
    get, bodies, removed = _lines.__getitem__, [], []
    for t, f in zip(texts.to_pylist(), frequent.to_pylist()):
        if t is None:
            bodies.append(None)
            removed.append(0)
            continue
        known, lines = set(f or ()), t.split("\n")
        kept = [x for x in lines if get(x) is None or get(x) not in known]
        bodies.append("\n".join(kept))
        removed.append(len(lines) - len(kept))
    return pa.StructArray.from_arrays([pa.array(bodies, pa.string()), pa.array(removed, pa.int32())], names=["body", "removed"])


def repeated_lines(docs: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """site, line_hash, n, site_rows of the lines on at least min_rows rows and min_share of the site's.

    docs has site and hashes (array of bigint). Rows without a site or text count for nothing.
    A site has at most average-lines / min_share such lines, whatever its number of rows.
    """
    # one exchange: the row count of a site travels as the line with a null hash
    marked = F.array_distinct(F.concat(F.array(F.lit(None).cast("bigint")), "hashes"))
    counts = docs.filter("site is not null and hashes is not null").select("site", F.explode(marked).alias("line_hash")).groupBy("site", "line_hash").agg(F.count(F.lit(1)).alias("n"))
    return repeated_counts(counts, min_rows, min_share)


def repeated_counts(counts: DataFrame, min_rows: int, min_share: float) -> DataFrame:
    """site, line_hash, n, site_rows of the repeated lines, from rows counted by site and hash; a null hash counts the site's rows."""
    kept = reliable(counts.filter(F.col("line_hash").isNull() | (F.col("n") >= min_rows)))
    per_site = kept.filter("line_hash is null").select("site", F.col("n").alias("site_rows"))
    lines = guarded_join(kept.filter("line_hash is not null"), per_site, ["site"])
    return lines.filter(F.col("n") >= F.col("site_rows") * F.lit(min_share)).select("site", "line_hash", "n", "site_rows")


def hashed_lines(docs: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """id, site, hashes of every row, written once: eight bytes a line instead of the text."""
    return reliable(spread(docs.select(id_col, url_col, text_col)).select(id_col, site_of(F.col(url_col)).alias("site"), line_hashes(text_col).alias("hashes")))


def frequent_by_site(hashed: DataFrame, **bounds: float) -> DataFrame:
    """site, frequent: the hashes of its repeated lines."""
    return repeated_lines(hashed, **bounds).groupBy("site").agg(F.sort_array(F.collect_set("line_hash")).alias("frequent"))


def repeated_positions(docs: DataFrame, id_col: str, url_col: str, text_col: str, **bounds: float) -> DataFrame:
    """id, line_no (from 0) of every non-empty line that is repeated across its site.

    Null texts and urls give no rows; every row of a text that occurs again counts by itself.
    """
    hashed = hashed_lines(docs, id_col, url_col, text_col)
    joined = guarded_join(hashed, frequent_by_site(hashed, **bounds), ["site"])
    return joined.select(id_col, F.explode(positions_within("hashes", "frequent")).alias("line_no"))


def without_repeated(docs: DataFrame, id_col: str, url_col: str, text_col: str, **bounds: float) -> DataFrame:
    """id, text rebuilt without the repeated lines, removed (their number).

    A null text stays null with 0 removed; a text of nothing but repeated lines becomes empty; rows
    without a site keep their text.
    """
    hashed = hashed_lines(docs, id_col, url_col, text_col)
    texts = docs.select(id_col, site_of(F.col(url_col)).alias("site"), text_col)
    joined = guarded_join(texts, frequent_by_site(hashed, **bounds), ["site"], "left")
    return joined.select(id_col, rebuilt(text_col, "frequent").alias("r")).select(id_col, F.col("r.body").alias(text_col), "r.removed")
