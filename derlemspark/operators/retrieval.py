"""Vector and keyword retrieval, fusion and an inverted-file index."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, tokens
from ..session import reliable
from .joins import guarded_join, hot_join

K1, B, RRF = 1.2, 0.75, 60
#: Queries, and vectors, of one cell of the comparison: what a task holds at a time.
BLOCK = 8192
#: Vectors that a task of a small table takes at least.
LEAST_ROWS = 256

def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(names: np.ndarray, matrix: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int) -> pa.Table:
    """query_id, vec_id, similarity of the k nearest rows of each query, ties by id, a bounded number of similarities at a time."""
    m = min(k, len(own))
    by_id = np.argsort(own, kind="stable")
    own, rows = own[by_id], rows[by_id]
    ids, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for at in range(0, len(names), 512):
        s = np.round(matrix[at : at + 512] @ rows.T, 6)
        if m < s.shape[1]:  # all rows that reach the k-th similarity, ties included, then the stable order of ids decides
            least = np.partition(s, s.shape[1] - m, axis=1)[:, -m]
            order = np.stack([c[np.argsort(-x[c], kind="stable")[:m]] for x, c in ((x, np.flatnonzero(x >= v)) for x, v in zip(s, least))]) if len(s) else np.zeros((0, m), dtype=np.int64)
        else:
            order = np.argsort(-s, axis=1, kind="stable")
        ids.append(own[order].reshape(-1))
        found.append(np.take_along_axis(s, order, 1).reshape(-1))
    return pa.table({"query_id": pa.array(np.repeat(names, m)), "vec_id": pa.array(np.concatenate(ids)), "similarity": pa.array(np.concatenate(found))})


def top_cosine(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, similarity (6 digits), rank of the k nearest vectors of each query, ties by id; null vectors are left out.

    The stated queries and the vectors are dealt to blocks; every pair of blocks meets in one task, which gives its own
    top k of each of its queries; one window per query merges these. Nothing comes to the driver but two counts.
    """
    vectors, queries = (df.filter("embedding is not null").select("vec_id", "embedding") for df in (vectors, queries))
    n, m = vectors.count(), queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    tiles, blocks = max(1, -(-n // block), min(cores, n // LEAST_ROWS)), max(1, -(-m // block))

    def cell(df: DataFrame, own: int, others: int, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(own)).cast("int").alias(names[0])
        return df.select("vec_id", "embedding", mine, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(names[1]))

    rows = cell(vectors, tiles, blocks, ("tile", "block")).groupBy("tile", "block")
    asked = cell(queries, blocks, tiles, ("block", "tile")).groupBy("tile", "block")

    def meet(v: pa.Table, q: pa.Table) -> pa.Table:
        v, q = v.combine_chunks(), q.combine_chunks()
        if not v.num_rows or not q.num_rows:
            none = pa.array([], pa.int64())
            return pa.table({"query_id": none, "vec_id": none, "similarity": pa.array([], pa.float64())})
        return nearest(q["vec_id"].to_numpy(), _unit(_matrix(q["embedding"])), v["vec_id"].to_numpy(), _unit(_matrix(v["embedding"])), k)

    found = rows.cogroup(asked).applyInArrow(meet, "query_id bigint, vec_id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: The words of functions.text.tokens(), in folded text.
WORD = re.compile("[a-z0-9çğıöşüâîû]+")


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; each different word is hashed once."""
    coded = words.dictionary_encode()
    return hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False).view(np.int64)[coded.indices.to_numpy()]


@F.arrow_udf(T.LongType())
def named(words: pa.Array) -> pa.Array:
    return pa.array(hashes(words))


def shards(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """An index of the wanted terms, written once: a row for each batch of documents with text, with its postings by term.

    One scan of the texts and no exchange; id_col is a key. Texts are cut into the words of tokens() in Arrow batches, as the pattern
    takes ten times longer in the JVM. Terms are known by their 64-bit hashes. What is left out by a filter of
    FILTER_BITS bits are words that no query asks for; the few others that pass it are never looked up. n counts documents, total all
    their words; the rest are packed arrays: ids and words of the documents; terms in order with their numbers of postings;
    document (its place in the shard) and tf of each posting.
    """
    mask = FILTER_BITS - 1
    bits = np.zeros(FILTER_BITS, dtype=bool)
    asked = wanted.select(named("term").bitwiseAND(F.lit(mask)).cast("int").alias("bit")).distinct().toArrow()  # at most FILTER_BITS numbers
    bits[asked["bit"].to_numpy()] = True
    shipped = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(shipped.value).astype(bool)
        for whole in batches:
            for at in range(0, whole.num_rows, SHARD_ROWS):
                batch = whole.slice(at, SHARD_ROWS)
                cut = [WORD.findall(x) for x in batch.column(1).to_pylist()]
                dl = np.array([len(x) for x in cut], dtype=np.int32)
                words, doc = hashes(pa.array(itertools.chain.from_iterable(cut), pa.string())), np.repeat(np.arange(batch.num_rows, dtype=np.uint16), dl)
                keep = passes[words & mask]
                words, doc = words[keep], doc[keep]
                order = np.argsort(words, kind="stable")  # the documents of a term stay in order
                words, doc = words[order], doc[order]
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(words)), dtype=bool), (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])]))
                tf = np.diff(np.append(first, len(words)))
                names, count = np.unique(words[first], return_counts=True)
                small = tf.astype(np.uint8 if tf.size and tf.max() < 256 else np.uint32)
                packed = [x.tobytes() for x in (batch.column(0).cast(pa.int64()).to_numpy(), dl, names, count.astype(np.int32), doc[first], small)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([int(dl.sum())], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], names=["n", "total", *PACKED])

    texts = docs.filter(F.col(text_col).isNotNull()).select(id_col, fold(text_col))
    return reliable(texts.mapInArrow(run, "n bigint, total bigint, " + ", ".join(f"{c} binary" for c in PACKED)))


FILTER_BITS = 1 << 24
#: Documents of a shard at most (their places are numbers of 16 bits), and about the documents that a task scores together.
SHARD_ROWS, TILE_DOCS = 1 << 16, 1 << 17
#: Queries that a task takes together.
QUERY_BLOCK = 1 << 16
PACKED = ("ids", "dl", "terms", "counts", "places", "tf")


class Tile:
    """Postings by term of the shards that meet in one task."""

    def __init__(self, rows: pa.Table):
        parts, base = [], 0
        ids, dl = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for row in rows.select(list(PACKED)).to_pylist():
            own = np.frombuffer(row["ids"], dtype=np.int64)
            count, place = np.frombuffer(row["counts"], dtype=np.int32), np.frombuffer(row["places"], dtype=np.uint16)
            tf = np.frombuffer(row["tf"], dtype=np.uint8 if len(row["tf"]) == len(place) else np.uint32)
            parts.append((np.repeat(np.frombuffer(row["terms"], dtype=np.int64), count), place.astype(np.int32) + base, tf.astype(np.float64)))
            ids.append(own)
            dl.append(np.frombuffer(row["dl"], dtype=np.int32))
            base += len(own)
        self.ids, self.dl = np.concatenate(ids), np.concatenate(dl)
        word = np.concatenate([p[0] for p in parts] or [np.zeros(0, dtype=np.int64)])
        order = np.argsort(word, kind="stable")
        self.docs, self.tf = (np.concatenate([p[k] for p in parts])[order] if parts else np.zeros(0, dtype=kind) for k, kind in ((1, np.int32), (2, np.float64)))
        self.names, first = np.unique(word[order], return_index=True)
        self.ends = np.append(first, len(word))

    def slot(self, term: int) -> int:
        """Number of a term, or -1."""
        at = int(np.searchsorted(self.names, term))
        return at if at < len(self.names) and self.names[at] == term else -1

    def weigh(self, avgdl: float) -> None:
        """tf becomes the part of BM25 that one posting gives before idf; tops has the largest of each term."""
        self.tf = self.tf * (K1 + 1) / (self.tf + K1 * (1 - B + B * self.dl[self.docs] / avgdl))
        self.tops = np.maximum.reduceat(self.tf, self.ends[:-1]) if len(self.names) else np.zeros(0)
        self.sums = np.zeros(len(self.ids))

    def held(self, slot: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the documents, whether it has the term and at which posting."""
        own = self.docs[self.ends[slot] : self.ends[slot + 1]]
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return own[at] == docs, at + self.ends[slot]

    def best(self, terms: np.ndarray, idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best documents, ties by id.

        Terms are added from the one that can give most; once the k-th sum is more than all terms left could give,
        only the documents found are looked up in these. Nothing that could be among the k best is left out.
        """
        slots = [(self.tops[s] * w, s, w) for s, w in ((self.slot(t), w) for t, w in zip(terms, idf)) if s >= 0]
        slots.sort(reverse=True)
        left, met, sums = sum(x[0] for x in slots), np.zeros(0, dtype=np.int64), self.sums
        given, least = 0.0, 0.0
        for j, (most, s, w) in enumerate(slots, 1):
            sums[self.docs[self.ends[s] : self.ends[s + 1]]] += w * self.tf[self.ends[s] : self.ends[s + 1]]
            given, left = given + most, left - most
            if j == len(slots) or given > left:
                met = np.flatnonzero(sums)
                if len(met) >= k:
                    least = np.partition(sums[met], len(met) - k)[len(met) - k]
                    if least > left + SLACK:
                        break
        else:
            j = len(slots)
        near = met[sums[met] + left >= least - SLACK]
        score = sums[near]
        sums[met] = 0
        for _, s, w in slots[j:]:
            has, at = self.held(s, near)
            score = score + np.where(has, w * self.tf[at], 0.0)
        score = np.floor(score * 1e6 + 0.5) / 1e6
        order = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near][order], score[order]

    def all_of(self, terms: np.ndarray) -> np.ndarray:
        """ids of the documents that have all the terms."""
        slots = sorted((self.slot(t) for t in terms), key=lambda s: -1 if s < 0 else self.ends[s + 1] - self.ends[s])
        if not slots or slots[0] < 0:
            return np.zeros(0, dtype=np.int64)
        docs = self.docs[self.ends[slots[0]] : self.ends[slots[0] + 1]]
        for s in slots[1:]:
            docs = docs[self.held(s, docs)[0]]
        return self.ids[docs]


#: Scores are compared with this much room before they are rounded to 6 digits.
SLACK = 2e-6


def met_in_tiles(index: DataFrame, queries: DataFrame, find: Callable, kind: str) -> DataFrame:
    """What find(tile, queries) gives for the shards and the queries dealt to tiles and blocks; every pair meets in one task. queries: query_id, h and more numbers."""
    docs, asked = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], queries.select("query_id").distinct().count()
    cores = index.sparkSession.sparkContext.defaultParallelism
    tiles, blocks = max(1, -(-docs // TILE_DOCS), min(cores, docs // LEAST_ROWS)), max(1, -(-asked // QUERY_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(tiles)).cast("int")).withColumn("block", each(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("tile", each(tiles))
    names = [f.split()[0] for f in kind.split(", ")]
    empty = pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})

    def meet(rows: pa.Table, q: pa.Table) -> pa.Table:
        if not rows.num_rows or not q.num_rows:
            return empty
        q = q.combine_chunks()
        own, h = q["query_id"].to_numpy(), q["h"].to_numpy()
        order = np.lexsort((h, own))
        order = order[np.concatenate([[True], (np.diff(own[order]) != 0) | (np.diff(h[order].astype(np.uint64)) != 0)])]  # a term of a query once
        q = q.take(pa.array(order))
        own = q["query_id"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        return pa.table(dict(zip(names, find(Tile(rows), q, own[starts], np.append(starts, len(own))))))

    return left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(meet, kind)


def all_terms(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame) -> DataFrame:
    """query_id, id of the documents that have all terms of a query. queries: query_id, term."""

    def find(tile: Tile, q: pa.Table, names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = q["h"].to_numpy()
        got = [tile.all_of(h[a:b]) for a, b in zip(starts[:-1], starts[1:])]
        return np.repeat(names, [len(x) for x in got]), np.concatenate(got)

    return met_in_tiles(shards(docs, id_col, text_col, queries), queries.select("query_id", named("term").alias("h")), find, f"query_id bigint, {id_col} bigint")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return queries.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def top_bm25(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score (6 digits), rank: the k best documents of each query by BM25 (Robertson and Zaragoza, 2009), ties by id.

    queries: query_id, term. idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N and average length are over the
    documents with text. Each task gives its own k best of each query, so pairs of a query and a document are never written.
    """
    index = shards(docs, id_col, text_col, queries)
    size = index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    avgdl = size["total"] / size["n"] if size["total"] else 1.0

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, dtype=np.int64)), pa.array(np.frombuffer(count, dtype=np.int32))], names=["h", "n"])

    df = index.select("terms", "counts").mapInArrow(frequencies, "h bigint, n int").groupBy("h").agg(F.sum("n").alias("df"))
    wanted = guarded_join(queries.select("query_id", named("term").alias("h")), df, ["h"])
    wanted = reliable(wanted.select("query_id", "h", F.log(1 + (F.lit(size["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))

    def find(tile: Tile, q: pa.Table, names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tile.weigh(avgdl)
        h, idf = q["h"].to_numpy(), q["idf"].to_numpy()
        got = [tile.best(h[a:b], idf[a:b], k) for a, b in zip(starts[:-1], starts[1:])]
        return np.repeat(names, [len(x) for x, _ in got]), np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])

    found = met_in_tiles(index, wanted, find, f"query_id bigint, {id_col} bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(legs: list[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """query_id, id, score, rank by reciprocal rank fusion (Cormack, Clarke and Buettcher, 2009); legs: query_id, id, rank."""
    union = legs[0]
    for leg in legs[1:]:
        union = union.unionByName(leg)
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cells_for(rows: int) -> int:
    """Number of cells of an index: it grows as the root of the rows, so a cell and the list of cells grow alike."""
    return max(4, int(rows**0.5))


def centroids(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Cell centres fitted by spherical k-means on a bounded sample (lowest id hashes)."""
    rows = vectors.filter("embedding is not null").orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding").toPandas()
    x = _unit(np.array(rows.embedding.tolist(), dtype=np.float64))
    c = x[np.random.default_rng(5).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.array([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def in_cells(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """vec_id, embedding, cell: the ``probes`` nearest cells of every vector."""
    shipped = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_unit(_matrix(batch.column(1))) @ shipped.value.T), axis=1)[:, :probes]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(near.reshape(-1).astype(np.int32))], names=["vec_id", "embedding", "cell"])

    return vectors.filter("embedding is not null").select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, embedding array<float>, cell int")
