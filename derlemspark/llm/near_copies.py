"""Near-duplicate records by a chosen-path set similarity join.

Records are sets of word triples. At the root every tree sends a record to one node for each of a few
minwise coordinates, named by the coordinate and its value; a node that is still large branches again on
coordinates chosen by the node itself; a small node compares its records exhaustively by their sketches
(Christiani, Pagh and Sivertsen, "Scalable and Robust Set Similarity Join", 2018). Independent trees are
repeated for recall. Candidates are verified on their whole sets of triples. Copies with equal sets form
one class from the start and never meet each other, so a hot group of copies is one record here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import guarded_join, hot_join
from ..session import reliable
from .words import multipliers

#: Words in a shingle and least number of words of a text that takes part.
WORDS, MIN_WORDS = 3, 20
#: Similarity to reach; sketch coordinates; trees and coordinates by which a root branches.
SIMILARITY, COORDINATES, TREES, BRANCHES = 0.5, 48, 3, 3
#: Coordinates by which a large node branches, out of a pool of its level; no level's pool has coordinates of another or of the roots.
CHILDREN, POOL = 4, 8
#: Nodes up to LEAF records are compared exhaustively; deeper than DEPTH a node is compared block by block.
LEAF, DEPTH, BLOCK = 512, 3, 512
#: A sketch keeps this many bits of each minwise value, two values in a byte.
BITS = 4
#: Sketches that agree in fewer coordinates than expected less this are no candidates (three standard deviations).
SLACK = 0.21

#: Characters of text that are hashed at once, and pairs of sketches that are compared at once.
CHUNK, PAIRS = 1 << 20, 1 << 19

_TRIPLE = multipliers(WORDS, 7)
_A = multipliers(COORDINATES, 11)
_B = multipliers(COORDINATES, 13)


class _Letters:
    """Tables over all code points, made when first used: whether one is part of a word, and its random number; powers of a base and its inverse."""

    base = int(multipliers(1, 17)[0])

    @cached_property
    def word(self) -> np.ndarray:
        return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)

    @cached_property
    def number(self) -> np.ndarray:
        return np.random.default_rng(19).integers(0, 1 << 63, 0x110000, dtype=np.uint64)

    def powers(self, n: int, base: int) -> np.ndarray:
        kept = self.__dict__.setdefault(f"powers{base}", np.ones(1, dtype=np.uint64))
        if len(kept) < n:
            steps = np.full(max(n, CHUNK) + 1, base, dtype=np.uint64)
            steps[0] = 1
            kept = self.__dict__[f"powers{base}"] = np.multiply.accumulate(steps)
        return kept[:n]


_letters = _Letters()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts (runs of letters and digits in lower case, the dotted capital I counts as i) and its text's number."""
    lowered = [t.replace("İ", "i").lower() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)) + 1)
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(points) + 2, dtype=np.int8)
    inside[1:-1] = _letters.word[points]
    change = np.diff(inside)
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # a word is a polynomial in the base: a difference of prefix sums, shifted to start at power 0
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(_letters.number[points] * _letters.powers(len(points), _Letters.base), out=sums[1:])
    h = (sums[last] - sums[first]) * _letters.powers(len(points) + 1, pow(_Letters.base, -1, 1 << 64))[first]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93), np.searchsorted(ends, first, side="right")


def shingle_sets(texts: list[str], least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the texts of ``least`` words or more, offsets, and the sorted distinct 32-bit hashes of their word triples."""
    words, doc = word_hashes(texts)
    count = np.bincount(doc, minlength=len(texts))
    n = max(len(words) - WORDS + 1, 0)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        h += words[k : k + n] * _TRIPLE[k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    whole = (doc[:n] == doc[WORDS - 1 :][:n]) & (count[doc[:n]] >= max(least, WORDS))
    keys = np.sort((doc[:n][whole].astype(np.uint64) << np.uint64(32)) | (h[whole] >> np.uint64(32)))
    keys = keys[np.diff(keys, prepend=~keys[:1]) != 0]
    owner = (keys >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[starts], np.r_[starts, len(keys)], keys.astype(np.uint32)


def shingles(text: str | None, least: int = MIN_WORDS) -> np.ndarray | None:
    """Sorted distinct 32-bit hashes of a text's word triples; None for texts under ``least`` words."""
    kept, _, triples = shingle_sets([text], least) if text else ((), None, None)
    return triples if len(kept) else None


def sketches(offsets: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """Minwise values of each set by coordinate."""
    h, starts = triples.astype(np.uint64), offsets[:-1]
    out = np.empty((COORDINATES, len(starts)), dtype=np.uint64)
    for k in range(COORDINATES if len(starts) else 0):
        x = h * _A[k]
        x += _B[k]
        x ^= x >> np.uint64(29)
        np.minimum.reduceat(x, starts, out=out[k])
    return out.T


def sketch(triples: np.ndarray) -> np.ndarray:
    return sketches(np.array([0, len(triples)]), triples)[0]


def packed(values: np.ndarray) -> np.ndarray:
    """The last BITS bits of each minwise value, two in a byte: rows of COORDINATES / 2 bytes."""
    low = (values & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return np.ascontiguousarray(low[:, 0::2] << BITS | low[:, 1::2])


def branch_values(values: np.ndarray) -> np.ndarray:
    """Two bytes of the minwise values of the coordinates after the roots', POOL for each level that branches."""
    first = TREES * BRANCHES
    return values[:, first : first + DEPTH * POOL].astype(np.uint16)


def root_nodes(values: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Names of the nodes below the roots: TREES x BRANCHES coordinates with their values, for each row and its table's salt."""
    n = TREES * BRANCHES
    x = values[:, :n] * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(n, dtype=np.uint64) * np.uint64(0x165667B19E3779F9) + np.asarray(salt, dtype=np.uint64).reshape(-1, 1)
    return (x ^ (x >> np.uint64(33))).view(np.int64)


#: Columns of a packed sketch, 16 values in each.
SKETCH = [f"s{k}" for k in range(COORDINATES // 16)]
NAMES = ["tbl", "rec_id", "copy", "nodes", *SKETCH, "branch", "triples"]
SCHEMA = f"tbl string, rec_id bigint, copy bigint, nodes array<bigint>, {', '.join(f'{s} bigint' for s in SKETCH)}, branch binary, triples binary"


def record_rows(tables: list[str], ids: list[int], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
    """Rows (NAMES) of the records whose text has MIN_WORDS words, a bounded number of characters at a time."""
    salts = {t: xxhash.xxh64_intdigest(t) >> 1 for t in set(tables)}
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < CHUNK:
            size += len(texts[end] or "")
            end += 1
        kept, offsets, triples = shingle_sets([t or "" for t in texts[at:end]])
        values = sketches(offsets, triples)
        rows = (kept + at).tolist()
        names = [tables[i] for i in rows]
        sets = [triples[i:j].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        nodes = root_nodes(values, [salts[t] for t in names])
        columns = [
            pa.array(names, pa.string()),
            pa.array([ids[i] for i in rows], pa.int64()),
            pa.array([xxhash.xxh64_intdigest(raw, salts[t] & 0xFFFFFFFF) - (1 << 63) for raw, t in zip(sets, names)], pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * nodes.shape[1]), pa.array(nodes.reshape(-1))),
            *(pa.array(x) for x in packed(values).view(np.int64).T),
            pa.array([x.tobytes() for x in branch_values(values)], pa.binary()),
            pa.array(sets, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=NAMES)
        at = end


def sketched(texts: DataFrame) -> DataFrame:
    """Rows for tbl, rec_id, text; texts that are null or under MIN_WORDS words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from record_rows(*(batch.column(k).to_pylist() for k in range(3)))

    return texts.select("tbl", "rec_id", "text").mapInArrow(run, SCHEMA)


_EACH = np.uint64(0x1111111111111111)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates in which rows of packed sketches (as 64-bit words of 16 values) agree."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    x &= _EACH
    return COORDINATES - np.bitwise_count(x).sum(1, dtype=np.int64)


def close_pairs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within the groups that agree in at least ``least`` coordinates; groups of one size go together."""
    left, right = [], []
    for n in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == n]
        i, j = np.triu_indices(n, 1)
        groups, span = max(1, PAIRS // len(i)), min(PAIRS, len(i))
        for g in range(0, len(at), groups):
            base = at[g : g + groups, None]
            for k in range(0, len(i), span):
                a, b = (base + i[k : k + span]).ravel(), (base + j[k : k + span]).ravel()
                good = agreement(words[a], words[b]) >= least
                left.append(a[good])
                right.append(b[good])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def compared(groups: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b) of the close pairs of each group; groups: members array<struct<copy, SKETCH>>."""
    chance = 1 / (1 << BITS)
    least = int(np.floor((similarity + (1 - similarity) * chance - SLACK) * COORDINATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            offsets = members.offsets.to_numpy().astype(np.int64)
            copies = members.values.field(0).to_numpy()
            words = np.stack([members.values.field(k + 1).to_numpy() for k in range(len(SKETCH))], 1).view(np.uint64)
            i, j = close_pairs(words, offsets[:-1], np.diff(offsets), least)
            a, b = np.minimum(copies[i], copies[j]), np.maximum(copies[i], copies[j])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            fresh = a != b
            fresh[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh])], names=["a", "b"])

    return groups.select("members").mapInArrow(run, "a bigint, b bigint")


def grouped(rows: DataFrame, by: str) -> DataFrame:
    """Groups of a bounded number of records, single ones left out. Most are single: rows are not combined before the exchange."""
    members = F.collect_list(F.struct("copy", *SKETCH)).alias("members")
    return rows.select(by, "copy", *SKETCH).repartition(by).groupBy(by).agg(members).filter(F.size("members") > 1)


def candidates(base: DataFrame, similarity: float = SIMILARITY, leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """a, b of the pairs of copies that meet in a leaf of some tree with close sketches."""
    copies = reliable(base.groupBy("copy").agg(*[F.first(c).alias(c) for c in ("nodes", *SKETCH, "branch")]))
    level, found, done = copies.select(F.explode("nodes").alias("node"), "copy", *SKETCH, "branch"), [], 0
    while True:
        heavy = reliable(level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf))
        if heavy.isEmpty():
            found.append(compared(grouped(level, "node"), similarity))
            break
        found.append(compared(grouped(guarded_join(level, heavy.select("node"), ["node"], "left_anti"), "node"), similarity))
        done += 1
        if done > depth:
            found.append(compared(grouped(blocks(level, heavy, block), "pair"), similarity))
            break
        hot = guarded_join(level, heavy.select("node"), ["node"], "left_semi")
        level = hot.select(F.explode(F.array(*[child(k, done) for k in range(CHILDREN)])).alias("node"), "copy", *SKETCH, "branch")
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.distinct()


def child(k: int, level: int) -> Column:
    """Name of the node below a node by its k-th chosen coordinate of the level's pool and the record's value there."""
    at = (F.pmod(F.xxhash64("node"), F.lit(POOL)) + k * (POOL // CHILDREN)) % POOL + (level - 1) % DEPTH * POOL
    return F.xxhash64("node", F.lit(k), F.substring("branch", (2 * at + 1).cast("int"), F.lit(2)))


def blocks(level: DataFrame, heavy: DataFrame, block: int) -> DataFrame:
    """Rows of heavy nodes once for each pair of blocks of the node: every pair of records meets in one of them."""
    rows = guarded_join(level, heavy, ["node"])
    n = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    rows = rows.withColumn("m", n).withColumn("own", F.pmod(F.xxhash64("copy"), F.col("m")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "copy", *SKETCH)


@F.arrow_udf(T.DoubleType())
def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    """Common triples by all triples of two sorted sets."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        u, v = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
        if len(u) > len(v):
            u, v = v, u
        at = np.searchsorted(v, u)
        at[at == len(v)] = 0
        common = int(np.count_nonzero(v[at] == u))
        out.append(common / (len(u) + len(v) - common))
    return pa.array(out, pa.float64())


def similar_classes(base: DataFrame, similarity: float = SIMILARITY, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """members (tbl, rec_id, copy) and links (a, b, similarity) between classes of equal sets, verified on whole sets.

    base: reliable rows of sketched(). An empty input has neither.
    """
    found = reliable(candidates(base, similarity, **sizes))
    ends = found.select(F.col("a").alias("copy")).unionAll(found.select("b")).distinct()
    sets = guarded_join(base.select("copy", "triples"), ends, ["copy"], "left_semi").groupBy("copy").agg(F.first("triples").alias("triples"))
    left = found.join(sets.select(F.col("copy").alias("a"), F.col("triples").alias("ta")), "a")
    both = left.join(sets.select(F.col("copy").alias("b"), F.col("triples").alias("tb")), "b")
    links = both.select("a", "b", jaccard("ta", "tb").alias("similarity")).filter(F.col("similarity") >= similarity)
    return base.select("tbl", "rec_id", "copy"), reliable(links)


def pairs(members: DataFrame, links: DataFrame, **sizes: int) -> DataFrame:
    """tbl, rec_id_a, rec_id_b of the records in one class or in linked classes.

    Both expansions go through hot_join(): a class of many copies is dealt to many tasks.
    """
    left = members.select("tbl", F.col("rec_id").alias("rec_id_a"), F.col("copy").alias("a"))
    right = members.select(F.col("rec_id").alias("rec_id_b"), F.col("copy").alias("b"))
    same = hot_join(left, right.withColumnRenamed("b", "a"), ["a"], **sizes).filter("rec_id_a < rec_id_b").select("tbl", "rec_id_a", "rec_id_b")
    one = reliable(hot_join(links.select("a", "b"), left, ["a"], **sizes))
    other = hot_join(one, right, ["b"], **sizes).select("tbl", F.least("rec_id_a", "rec_id_b").alias("rec_id_a"), F.greatest("rec_id_a", "rec_id_b").alias("rec_id_b"))
    return same.unionAll(other)
