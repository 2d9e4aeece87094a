"""Queries of this subpackage, pN_... for problem N, over the whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable, spread, table
from . import addresses, body, bpe_automaton, garbled, leaks, near_copies, pieces, reading, residue, site_lines

#: Vocabulary of problem 8; a parameter, never copied into the repository.
VOCABULARY = os.environ.get("DERLEM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def two_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, rec_id, text of test_seed and page_results."""
    seeds = table(spark, sf_dir, "test_seed").select(F.lit("test_seed").alias("tbl"), F.col("seed_id").alias("rec_id"), F.col("content").alias("text"))
    pages = table(spark, sf_dir, "page_results").select(F.lit("page_results").alias("tbl"), F.col("page_id").alias("rec_id"), F.col("body_content").alias("text"))
    return seeds.unionAll(pages)


def web_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, rec_id, url, title, text, preview of page_results and static_slugs_output."""
    pages = table(spark, sf_dir, "page_results").select(F.lit("page_results").alias("tbl"), F.col("page_id").alias("rec_id"), "url", "title", F.col("body_content").alias("text"), F.lit(False).alias("preview"))
    slugs = table(spark, sf_dir, "static_slugs_output").select(F.lit("static_slugs_output").alias("tbl"), F.col("slug_page_id").alias("rec_id"), "url", "title", F.col("content_preview").alias("text"), F.lit(True).alias("preview"))
    return pages.unionAll(slugs)


def shared_pages(spark: SparkSession, sf_dir: str, only_pages: bool = False) -> tuple[DataFrame, body.BodyModel | None]:
    """Rows with the repeated lines of their sites, and the body model fitted on a bounded sample of pages."""
    texts = web_texts(spark, sf_dir)
    pages = texts.filter("tbl = 'page_results'")
    shared = body.with_shares(spread(pages if only_pages else texts), pages)
    return shared, body.fit(shared.filter("tbl = 'page_results'"), pages.count())


def p1_places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return addresses.same_place(table(spark, sf_dir, "birim_iletisim_tablosu"), "kayit_id", "adres", "telefon")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.pairs(*p1_places(spark, sf_dir), "kayit_id")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kayit_id, class and number of linked classes of every record with an address."""
    members, links = p1_places(spark, sf_dir)
    ends = links.select(F.col("a").alias("class")).unionAll(links.select("b")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "class", "left").select(F.col("id").alias("kayit_id"), "class", F.coalesce("links", F.lit(0)).alias("links"))


def p2_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.classify(*shared_pages(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_residue(spark, sf_dir).filter("residue is not null").select("tbl", "rec_id")


def p4_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_words(spread(two_texts(spark, sf_dir)))[0]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_words(spark, sf_dir).select("tbl", "rec_id").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restored(spread(two_texts(spark, sf_dir)))


def main_sketches(shared: DataFrame, model: body.BodyModel | None) -> DataFrame:
    """near_copies rows of the main text of pages, cases of residue left out, in one pass over the texts."""
    shipped = shared.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in body.parts_of(batches):
            texts, titles = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            pages = body.Pages(texts, titles, batch.column(4), batch.column(5), [False] * len(texts))
            p = shipped.value.furniture(pages) if shipped.value else np.zeros(len(pages.ids))
            kinds = residue.verdicts(texts, titles, pages, p)
            mains = [None if kind else main for main, kind in zip(body.main_bodies(texts, pages, p)[0], kinds)]
            yield from near_copies.record_rows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), mains)

    return shared.select("tbl", "rec_id", "text", "title", "strong", "weak").mapInArrow(run, near_copies.SCHEMA)


def p5_joined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seeds = near_copies.sketched(spread(two_texts(spark, sf_dir).filter("tbl = 'test_seed'")))
    base = reliable(main_sketches(*shared_pages(spark, sf_dir, only_pages=True)).unionAll(seeds))
    return near_copies.similar_classes(base)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.pairs(*p5_joined(spark, sf_dir))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, rec_id, class and number of linked classes of every record that takes part."""
    members, links = p5_joined(spark, sf_dir)
    ends = links.select(F.col("a").alias("copy")).unionAll(links.select("b")).groupBy("copy").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "copy", "left").select("tbl", "rec_id", F.col("copy").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.marked_lines(*shared_pages(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_lines(spark, sf_dir).filter("furniture > 0.5").select("tbl", "rec_id", "line_no")


def p6_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.marked_lines(*shared_pages(spark, sf_dir), what="bodies")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_positions(table(spark, sf_dir, "page_results"), "page_id", "url", "body_content")


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.without_repeated(table(spark, sf_dir, "page_results"), "page_id", "url", "body_content")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_spans(spread(two_texts(spark, sf_dir)), "text").filter("piece_no = 1").select("tbl", "rec_id")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_items(spread(two_texts(spark, sf_dir)), "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", VOCABULARY)


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaks.overlaps(docs, "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_overlaps(spark, sf_dir).filter("exact").select("doc_id", "item_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return reading.levels(docs, reading.fit(docs, table(spark, sf_dir, "reading_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).filter("reading_level = 4").select("doc_id")


def queries() -> dict[str, Query]:
    inner = {"p1_places", "p5_joined"}
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and name not in inner}
