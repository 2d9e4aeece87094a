"""Reading level of each document from the acquisition grades of its words.

The model is fitted on a bounded sample of labelled rows. A word's acquisition grade is the level at which
half of its use in graded texts, each level weighted alike, has been reached. A document is described by
quantiles of the grades of its known words; a logistic calibration on labelled documents, whose own labels
did not enter the grades it sees, turns the quantiles into a level. Every document is then scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable
from .words import lower_words

#: Bound of the fit: labelled documents used. It bounds the words that get a grade as well; every word of MIN_DOCS of them gets one.
MAX_LABELLED = 20_000
MIN_DOCS = 3
LEVELS = (1, 2, 3, 4)
QUANTILES = (0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95)
#: Documents with fewer known words have no level.
MIN_WORDS = 5
PRIOR = 0.5


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, level, fold: median of each rated document's ratings, at most ``limit`` documents by hash order."""
    rated = labels.filter(F.col("reading_level").between(LEVELS[0], LEVELS[-1])).groupBy("doc_id").agg(F.percentile("reading_level", 0.5).alias("m"))
    rated = rated.select("doc_id", F.floor(F.col("m") + F.lit(0.5)).cast("int").alias("level"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").filter(F.length(F.trim("text")) > 0)
    return texts.join(F.broadcast(rated), "doc_id").withColumn("fold", F.abs(F.xxhash64("doc_id", F.lit(7))) % 2)


def _distinct_words(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted({w for w in lower_words(t) if not w.isdigit()}) for t in batch.column(0).to_pylist()]
            n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            rows = pa.array(np.repeat(np.arange(len(words)), n))
            yield pa.RecordBatch.from_arrays([pa.array([w for ws in words for w in ws], pa.string()), batch.column(1).take(rows), batch.column(2).take(rows)], names=["word", "level", "fold"])

    return sample.select("text", "level", "fold").mapInArrow(run, "word string, level int, fold bigint")


def grades_from(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Acquisition grade of each word: counts is words x levels, totals the documents of each level."""
    rate = (counts + PRIOR * totals / totals.sum()) / np.maximum(totals, 1)
    share = np.cumsum(rate / rate.sum(1, keepdims=True), axis=1)
    k = (share >= 0.5).argmax(1)
    rows = np.arange(len(k))
    before = np.where(k > 0, share[rows, np.maximum(k - 1, 0)], 0.0)
    return LEVELS[0] + k - 0.5 + (0.5 - before) / np.maximum(share[rows, k] - before, 1e-9)


def features(texts: list[str | None], grades: dict[str, float]) -> np.ndarray:
    """Rows of quantiles of known-word grades, their mean, the share of known words; NaN rows for too few known words."""
    out = np.full((len(texts), len(QUANTILES) + 2), np.nan)
    for i, text in enumerate(texts):
        words = [w for w in lower_words(text) if not w.isdigit()]
        known = [g for g in map(grades.get, words) if g is not None]
        if len(known) >= MIN_WORDS:
            g = np.sort(np.array(known))
            out[i, : len(QUANTILES)] = g[[min(len(g) - 1, int(q * len(g))) for q in QUANTILES]]
            out[i, -2:] = g.mean(), len(known) / len(words)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 400, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights of a multinomial logistic regression on quadratic terms, by gradient steps with momentum."""
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = expand((x - centre) / scale)
    target = np.eye(len(LEVELS))[y - LEVELS[0]]
    weight = np.zeros((z.shape[1], len(LEVELS)))
    speed = np.zeros_like(weight)
    rate = 0.5 / max(1.0, (z**2).sum(1).mean() / 4)
    for _ in range(steps):
        e = z @ weight
        p = np.exp(e - e.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - rate * (z.T @ (p - target) / len(z) + penalty * weight)
        weight += speed
    return centre, scale, weight


def expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -4, 4)
    return np.hstack([np.ones((len(z), 1)), z, z**2])


class ReadingModel:
    def __init__(self, grades: dict[str, float], centre: np.ndarray, scale: np.ndarray, weight: np.ndarray):
        self.grades, self.centre, self.scale, self.weight = grades, centre, scale, weight

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        e = expand((x - self.centre) / self.scale) @ self.weight
        p = np.exp(e - e.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame) -> ReadingModel | None:
    """The model, or None if no labelled document has text. Counts come to the driver for the words of the bounded sample."""
    sample = reliable(labelled_sample(docs, labels))
    words = _distinct_words(sample)
    cells = [F.count_if((F.col("level") == v) & (F.col("fold") == f)).alias(f"c{f}{v}") for f in (0, 1) for v in LEVELS]
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *cells).filter(F.col("n") >= MIN_DOCS).orderBy("word").toPandas()
    sized = {(r[0], r[1]): r[2] for r in sample.groupBy("fold", "level").count().collect()}
    if not len(top) or not sized:
        return None
    total = [np.array([sized.get((f, v), 0) for v in LEVELS], dtype=float) for f in (0, 1)]
    count = [top[[f"c{f}{v}" for v in LEVELS]].to_numpy(dtype=float) for f in (0, 1)]
    half = [dict(zip(top.word, grades_from(count[f], total[f]))) for f in (0, 1)]
    whole = dict(zip(top.word, grades_from(count[0] + count[1], total[0] + total[1])))
    shipped = docs.sparkSession.sparkContext.broadcast(half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            x = np.where(folds[:, None] == 0, features(texts, shipped.value[1]), features(texts, shipped.value[0]))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([flat, batch.column(1)], names=["x", "level"])

    seen = sample.select("text", "level", "fold").mapInArrow(run, "x array<double>, level int").toPandas()
    x, y = np.array(seen.x.tolist(), dtype=float).reshape(len(seen), -1), seen.level.to_numpy()
    ok = ~np.isnan(x).any(1)
    return ReadingModel(whole, *calibrate(x[ok], y[ok])) if ok.any() else None


def levels(docs: DataFrame, model: ReadingModel | None) -> DataFrame:
    """doc_id, reading_level (null for null, empty and tiny texts), level_score (expected level), known_share."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = features(texts, m.grades if m else {})
            bad = np.isnan(x).any(1)
            p = m.probabilities(np.nan_to_num(x)) if m else np.zeros((len(texts), len(LEVELS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.argmax(1).astype(np.int32) + LEVELS[0], mask=bad), pa.array(p @ np.array(LEVELS, dtype=float), mask=bad), pa.array(x[:, -1], mask=bad)],
                names=["doc_id", "reading_level", "level_score", "known_share"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, reading_level int, level_score double, known_share double")
