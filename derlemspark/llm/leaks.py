"""Evaluation texts leaking into training text, by spaced-seed hashing.

A seed is a fixed mask over eight consecutive words; positions that the mask ignores may differ. Hashes
of the masked windows of test items and documents are joined, and each hit is verified by comparing the
words around it along the same alignment, substitutions tolerated. Together the masks look at all eight
positions, so a window that is equal in all eight words is hit by every one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import guarded_join
from .words import WordHashes, folded_words, multipliers

#: Fixed masks over SPAN words; 1 marks a word that counts.
SEEDS = ("11011011", "10110111")
SPAN = 8
#: Words compared before and after a hit.
AROUND = 8
#: An opening line that at least this many items share is an instruction, not the passage proper.
SHARED_LINE = 3
#: Size of the filter over test hashes: 2 ** FILTER_BITS bits, whatever the number of items.
FILTER_BITS = 24

_hashes = WordHashes()


def passages_proper(items: DataFrame, id_col: str, text_col: str, shared: int = SHARED_LINE) -> DataFrame:
    """id and passage without an opening line, ended by a line break, that at least ``shared`` items have."""
    line = F.when(F.instr(text_col, "\n") > 0, F.trim(F.substring_index(text_col, "\n", 1)))
    items = items.select(id_col, text_col).withColumn("__line", line)
    counts = items.filter("__line is not null").groupBy("__line").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= shared)
    joined = guarded_join(items, counts, ["__line"], "left")
    rest = F.substring(F.col(text_col), F.instr(text_col, "\n") + 1, F.length(text_col))
    return joined.select(id_col, F.when(F.col("__n").isNotNull(), rest).otherwise(F.col(text_col)).alias(text_col))


def windows_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Word hashes of all texts with AROUND gaps between them, row of each word (-1 in gaps), window hashes by seed, start validity."""
    counts, parts = [], []
    for text in texts:
        words = folded_words(text)
        counts.append(len(words))
        parts.append(_hashes.of(words))
    gap = np.zeros(AROUND + SPAN, dtype=np.uint64)
    hashes = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
    rows = np.full(len(hashes), -1, dtype=np.int64)
    at = len(gap)
    for i, n in enumerate(counts):
        rows[at : at + n] = i
        at += n + len(gap)
    starts = len(hashes) - SPAN + 1
    mult = multipliers(SPAN)
    found = []
    for k, seed in enumerate(SEEDS):
        h = np.full(starts, k + 1, dtype=np.uint64)
        for p, bit in enumerate(seed):
            if bit == "1":
                h += hashes[p : p + starts] * mult[p]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        found.append(h ^ (h >> np.uint64(32)))
    valid = (rows[:starts] >= 0) & (rows[:starts] == rows[SPAN - 1 : SPAN - 1 + starts])
    return hashes, rows, found, valid


def seed_hits(docs: DataFrame, id_col: str, text_col: str, out_id: str, prefix: str, bits: np.ndarray | None) -> DataFrame:
    """out_id, h, prefix+pos, prefix+around of every masked window, or of those whose hash the filter has."""
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if shipped is None else shipped.value
        for batch in batches:
            hashes, rows, found, valid = windows_of(batch.column(1).to_pylist())
            short = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            where, values = [], []
            for h in found:
                ok = valid
                if table is not None:
                    slot = h >> np.uint64(64 - FILTER_BITS)
                    ok = valid & ((table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
                at = np.flatnonzero(ok)
                where.append(at)
                values.append(h[at])
            at, h = np.concatenate(where), np.concatenate(values)
            around = short[at[:, None] + np.arange(-AROUND, SPAN + AROUND)] if len(at) else np.zeros((0, SPAN + 2 * AROUND), np.int32)
            size = SPAN + 2 * AROUND
            # a repetitive text has the same window with the same words around it many times: one row for each
            key = np.ascontiguousarray(np.column_stack([rows[at], h.view(np.int64), around.astype(np.int64)]))
            kept = np.sort(np.unique(key.view(f"V{key.shape[1] * 8}").reshape(-1), return_index=True)[1]) if len(at) else np.arange(0)
            at, h, around = at[kept], h[kept], around[kept]
            first = np.maximum.accumulate(np.where(np.r_[True, rows[1:] != rows[:-1]], np.arange(len(rows)), 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[at])),
                    pa.array(h.view(np.int64)),
                    pa.array((at - first[at]).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(at) + 1, size, dtype=np.int32)), pa.array(around.reshape(-1))),
                ],
                names=[out_id, "h", f"{prefix}pos", f"{prefix}around"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{out_id}` {kind}, h bigint, {prefix}pos int, {prefix}around array<int>")


def hash_filter(hits: DataFrame) -> np.ndarray:
    """Bits of the test hashes; at most 2 ** (FILTER_BITS - 6) words reach the driver."""
    slot = f"shiftrightunsigned(h, {64 - FILTER_BITS})"
    words = hits.groupBy(F.expr(f"shiftright({slot}, 6)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")).alias("b"))
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for w, b in words.collect():
        table[w] = b & 0xFFFFFFFFFFFFFFFF
    return table


def overlaps(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """doc, item, hits (pairs of different windows), best (most equal words of the 24 around a hit), exact (at least eight equal consecutive words).

    One row for each document and item that share a seed. Null and short texts share none.
    """
    proper = passages_proper(items, item_id, item_text)
    tests = seed_hits(proper, item_id, item_text, "item", "i", None)
    hits = seed_hits(docs, doc_id, doc_text, "doc", "d", hash_filter(tests))
    met = guarded_join(hits, tests, ["h"])
    same = F.zip_with("daround", "iaround", lambda a, b: (a == b) & (a != 0))
    met = met.select("doc", "item", same.alias("same"))
    return (
        met.select("doc", "item", F.size(F.filter("same", lambda x: x)).alias("equal"), F.forall(F.slice("same", AROUND + 1, SPAN), lambda x: x).alias("whole"))
        .groupBy("doc", "item")
        .agg(F.count(F.lit(1)).alias("hits"), F.max("equal").alias("best"), F.bool_or("whole").alias("exact"))
        .select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "hits", "best", "exact")
    )
