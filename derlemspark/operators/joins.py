"""Joins that stay safe when the small side or one key grows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable

#: A side is broadcast only if it has at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Rows of one key on one side from which hot_join() deals them to several cells.
HOT_ROWS = 20_000


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About the bytes of a value; what has no simple measure counts by its JSON text."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        return F.greatest(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0))
    return F.lit(16)


def measured(side: DataFrame) -> tuple[DataFrame, int, int]:
    """The side, written once to the shared folder, with its rows and about its bytes, from one pass over what was written."""
    side = reliable(side)
    width = reduce(lambda a, b: a + b, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in side.schema.fields], F.lit(0)).cast("bigint")
    rows, size = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return side, rows, size


def dealt(df: DataFrame, cells: Column | int) -> Column:
    """Number of the cell a row is dealt to, by a hash of its values: a task that runs again deals alike."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.pmod(F.xxhash64(*plain, F.lit(17)), F.lit(cells) if isinstance(cells, int) else cells).cast("int")


def guarded_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    salts: int = 32,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join big with small on equal keys, small having one row for each key.

    The small side is written and measured. Within the bound it is broadcast. Beyond it both sides
    are shuffled on the keys and a salt: rows of a hot key of the big side spread over ``salts``
    tasks and the small side's row is repeated for each. The result is the same either way; rows
    with a null key meet nothing. how: inner, left, left_semi or left_anti.
    """
    small, rows, size = measured(small)
    if rows <= max_rows and size <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    salt = "__salt"
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn(salt, dealt(big, salts)).join(spread, [*on, salt], how).drop(salt)


def hot_join(left: DataFrame, right: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join on equal keys of which any may be hot on either side, or on both.

    Rows are counted by key first. A key with hot_rows rows or more on a side becomes a grid: its left rows
    are dealt to lines, its right rows to columns, each is copied along the other side's cells, and every
    pair of rows meets in exactly one cell. All other keys are joined as they are, without copies. Both
    sides are read twice: pass inputs that are cheap to read again. Rows with a null key meet nothing.
    """

    def heavy(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*on).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) >= hot_rows)

    hot = reliable(heavy(left, "__l").join(heavy(right, "__r"), on, "full"))
    if hot.isEmpty():
        return left.join(right, on)

    def cells(name: str) -> Column:
        return F.ceil(F.coalesce(F.col(name), F.lit(1)) / hot_rows).cast("int")

    grid = hot.select(*on, cells("__l").alias("__lines"), cells("__r").alias("__columns"))

    def placed(side: DataFrame, own: str, other: str, mine: str, copied: str) -> DataFrame:
        marked = side.withColumn("__deal", dealt(side, 1 << 30))
        marked = guarded_join(marked, grid, on, "left")
        marked = marked.withColumn(mine, F.pmod(F.col("__deal"), F.coalesce(own, F.lit(1))).cast("int"))
        return marked.withColumn(copied, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("__deal", "__lines", "__columns")

    a = placed(left, "__lines", "__columns", "__i", "__j")
    b = placed(right, "__columns", "__lines", "__j", "__i")
    return a.join(b, [*on, "__i", "__j"]).drop("__i", "__j")
