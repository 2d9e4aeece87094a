"""Chunking queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from ..operators.quality import reject_reason
from .base import query
from .corpus import REJECT

WINDOWS = lambda x: f"list_transform(range(0, greatest(len(string_split({x}, ' ')) - 41, 0) + 1, 160), lambda i: array_to_string(string_split({x}, ' ')[i + 1:i + 200], ' '))"
MARKS = lambda x, p: f"list_filter(string_split(regexp_replace({x}, '({p})', chr(1) || '\\1', 'g'), chr(1)), lambda y: length(trim(y)) > 0)"
BY_MARKS = lambda p, least: f"CASE WHEN len({MARKS('text', p)}) < {least} THEN {WINDOWS('text')} ELSE flatten(list_transform({MARKS('text', p)}, lambda q: CASE WHEN length(q) > 1800 THEN {WINDOWS('q')} ELSE [q] END)) END"
NUMBERED = lambda e: f"SELECT doc_id, generate_subscripts(c, 1) - 1 AS chunk_index, unnest(c) AS chunk FROM (SELECT doc_id, {e} AS c FROM documents WHERE text IS NOT NULL)"


def numbered(t, chunks):
    return t.documents.filter("text is not null").select("doc_id", F.posexplode(chunks).alias("chunk_index", "chunk"))


@query(NUMBERED(WINDOWS("text")))
def chunk_words(t):
    return numbered(t, chunking.word_windows(F.col("text")))


@query(NUMBERED(f"CASE WHEN length(text) <= 1200 THEN [text] ELSE {WINDOWS('text')} END"))
def chunk_news(t):
    return numbered(t, chunking.whole_or_windows(F.col("text")))


@query(NUMBERED(MARKS("text", "(?m)^(?:Madde|MADDE)\\s+\\d+")))
def article_split(t):
    return numbered(t, chunking.marked_split(F.col("text"), chunking.ARTICLE))


@query(NUMBERED(BY_MARKS("(?m)^(?:Madde|MADDE)\\s+\\d+", 3)))
def chunk_articles(t):
    return numbered(t, chunking.by_marks(F.col("text"), chunking.ARTICLE, 3))


@query(NUMBERED(BY_MARKS("(?m)^#{1,4}\\s+", 2)))
def chunk_headings(t):
    return numbered(t, chunking.by_marks(F.col("text"), chunking.HEADING))


@query()
def chunk_heading_ctx(t):
    return t.documents.filter("text is not null").select("doc_id", F.posexplode(chunking.heading_context(F.col("text"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")


@query()
def chunk_paragraphs(t):
    return numbered(t, chunking.paragraphs(F.col("text")))


@query()
def chunk_dispatch(t):
    return numbered(t, chunking.dispatch(F.col("text"), F.col("doc_kind")))


@query(f"SELECT 'doc-' || doc_id AS parent_doc_id, chunk_index, length(chunk) AS chars FROM ({NUMBERED(WINDOWS('text'))})")
def chunk_index(t):
    return numbered(t, chunking.word_windows(F.col("text"))).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("parent_doc_id"), "chunk_index", F.length("chunk").alias("chars"))


@query(f"SELECT doc_id, chunk_index, sha256(chunk || chunk_index) AS chunk_id FROM ({NUMBERED(WINDOWS('text'))})")
def chunk_id(t):
    return numbered(t, chunking.word_windows(F.col("text"))).select("doc_id", "chunk_index", F.sha2(F.concat("chunk", F.col("chunk_index").cast("string")), 256).alias("chunk_id"))


@query("SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 16) AS short_hash, left(sha256(coalesce(source_url, '') || left(text, 200)), 16) AS url_hash FROM documents WHERE text IS NOT NULL")
def doc_id_hash(t):
    h = F.sha2("text", 256)
    return t.documents.filter("text is not null").select("doc_id", h.alias("content_hash"), F.substring(h, 1, 16).alias("short_hash"), F.substring(F.sha2(F.concat(F.coalesce("source_url", F.lit("")), F.substring("text", 1, 200)), 256), 1, 16).alias("url_hash"))


@query(f"""WITH ok AS (SELECT doc_id, text FROM documents WHERE {REJECT} IS NULL), c AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS chunk_index, unnest(c) AS chunk FROM (SELECT doc_id, {WINDOWS('text')} AS c FROM ok))
  SELECT sha256(chunk || chunk_index) AS chunk_id, min(doc_id) AS doc_id, chunk_index FROM c GROUP BY 1, 3""")
def ingest_pipeline(t):
    ok = t.documents.withColumn("r", reject_reason(F.col("text"), F.col("doc_kind"), F.col("category"))).filter("r is null")
    c = ok.select("doc_id", F.posexplode(chunking.word_windows(F.col("text"))).alias("chunk_index", "chunk"))
    return c.groupBy(F.sha2(F.concat("chunk", F.col("chunk_index").cast("string")), 256).alias("chunk_id"), "chunk_index").agg(F.min("doc_id").alias("doc_id")).select("chunk_id", "doc_id", "chunk_index")
