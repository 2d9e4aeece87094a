"""Corpus statistics, quality checks and reports (one pass over the table each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import first_keyword, fold
from ..operators import quality
from ..operators.joins import guarded_join
from .base import Tables, fold_sql, list_sql, query

SPACE = "length(trim(text))"
PLACEHOLDER_CASE = "CASE " + " ".join(f"WHEN contains({fold_sql('text')}, '{k}') THEN '{k}'" for k in fixed.PLACEHOLDER_KEYWORDS) + " END"
REJECT = f"""CASE WHEN text IS NULL OR {SPACE} = 0 THEN 'empty'
  WHEN {SPACE} < 50 AND NOT coalesce(doc_kind IN ({list_sql(fixed.SHORT_KINDS)}), false) THEN 'short'
  WHEN {" OR ".join(f"regexp_matches({fold_sql('text')}, '{p}')" for p in fixed.PLACEHOLDER_PATTERNS)} THEN 'placeholder'
  WHEN NOT coalesce(category IN ({list_sql(fixed.CATEGORIES)}) AND doc_kind IN ({list_sql(fixed.DOC_KINDS)}), false) THEN 'metadata' END"""
BUCKET = "CASE WHEN n < 50 THEN '<50' WHEN n < 200 THEN '50-200' WHEN n < 1000 THEN '200-1K' WHEN n < 5000 THEN '1K-5K' WHEN n < 50000 THEN '5K-50K' ELSE '>50K' END"
FIELDS = ("text", "lang", "source", "title", "category", "doc_kind", "source_url", "last_updated")


def reasons(t: Tables) -> DataFrame:
    return t.documents.withColumn("reject_reason", quality.reject_reason(F.col("text"), F.col("doc_kind"), F.col("category")))


@query(f"SELECT doc_id, {REJECT} AS reject_reason FROM documents")
def ingest_validate(t):
    return reasons(t).select("doc_id", "reject_reason")


@query(f"SELECT coalesce({REJECT}, 'valid') AS reject_reason, count(*) AS n FROM documents GROUP BY 1")
def reject_counts(t):
    return reasons(t).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS (SELECT seed_id, content AS text, meta.* FROM test_seed),
  f AS (SELECT *, min(seed_id) OVER (PARTITION BY source_url) AS first_id FROM d),
  {", ".join(f"r_{c} AS (SELECT seed_id, 'error' AS severity, '{c}' AS field, 'missing' AS message FROM f WHERE {c} IS NULL OR length(trim({c})) = 0)" for c in ("category", "source_url", "source_type", "source_id", "title", "doc_kind"))},
  {", ".join(f"i_{c} AS (SELECT seed_id, 'info' AS severity, '{c}' AS field, 'missing' AS message FROM f WHERE {c} IS NULL OR length(trim({c})) = 0)" for c in ("last_updated", "contact_unit", "contact_info", "language"))}
  {" UNION ALL ".join(f"SELECT * FROM {x}" for x in ("r_category", "r_source_url", "r_source_type", "r_source_id", "r_title", "r_doc_kind", "i_last_updated", "i_contact_unit", "i_contact_info", "i_language"))}
  UNION ALL SELECT seed_id, 'warning', 'title', 'short' FROM f WHERE length(trim(title)) BETWEEN 1 AND 2
  UNION ALL SELECT seed_id, 'warning', 'content', 'short' FROM f WHERE coalesce({SPACE}, 0) < 50
  UNION ALL SELECT seed_id, 'warning', 'content', 'long' FROM f WHERE {SPACE} > 100000
  UNION ALL SELECT seed_id, 'error', 'content', {PLACEHOLDER_CASE} FROM f WHERE {PLACEHOLDER_CASE} IS NOT NULL
  UNION ALL SELECT seed_id, 'warning', 'source_url', 'duplicate of ' || first_id FROM f WHERE length(trim(source_url)) > 0 AND first_id < seed_id""")
def quality_issues(t):
    docs = t.test_seed.select("seed_id", "content", "meta.*")
    required = [c for c in fixed.REQUIRED_FIELDS if c != "department"]
    return quality.issues(docs, "seed_id", "content", required, list(fixed.RECOMMENDED_FIELDS), "source_url", "title")


@query(f"SELECT doc_id, {PLACEHOLDER_CASE} AS placeholder FROM documents WHERE {PLACEHOLDER_CASE} IS NOT NULL")
def placeholder_scan(t):
    return t.documents.select("doc_id", first_keyword(fold("text"), fixed.PLACEHOLDER_KEYWORDS).alias("placeholder")).filter("placeholder is not null")


@query("""SELECT doc_kind, category, count(*) AS n, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 4) AS avg_chars, CAST(sum(length(text)) AS BIGINT) AS total_chars
  FROM documents WHERE text IS NOT NULL GROUP BY doc_kind, category""")
def char_stats(t):
    n = F.length("text")
    return t.documents.filter("text is not null").groupBy("doc_kind", "category").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 4).alias("avg_chars"), F.sum(n).alias("total_chars"))


@query("""WITH a AS (SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS nulls, count(*) FILTER (WHERE title IS NULL) AS untitled, count(DISTINCT doc_kind) AS kinds, bool_and(source_url IS NOT NULL) AS urls FROM documents)
  SELECT 'count' AS check_name, n >= 100 AS passed FROM a UNION ALL SELECT 'few_null_texts', nulls * 20 <= n FROM a UNION ALL SELECT 'few_untitled', untitled * 20 <= n FROM a
  UNION ALL SELECT 'kinds_present', kinds >= 5 FROM a UNION ALL SELECT 'all_urls', urls FROM a""")
def gate_checks(t):
    a = t.documents.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("nulls"), F.count_if(F.col("title").isNull()).alias("untitled"), F.count_distinct("doc_kind").alias("kinds"), F.bool_and(F.col("source_url").isNotNull()).alias("urls"))
    return a.selectExpr("stack(5, 'count', n >= 100, 'few_null_texts', nulls * 20 <= n, 'few_untitled', untitled * 20 <= n, 'kinds_present', kinds >= 5, 'all_urls', urls) as (check_name, passed)")


@query("""WITH a AS (SELECT count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT category) AS categories, count(*) FILTER (WHERE length(text) >= 50) AS long_texts, count(DISTINCT md5(text)) AS texts,
    count(*) FILTER (WHERE title <> '') AS titled, count(*) FILTER (WHERE source <> '') AS sourced, count(*) FILTER (WHERE last_updated <> '') AS dated, count(*) FILTER (WHERE lang <> '') AS languages FROM documents),
  c AS (SELECT unnest(['documents', 'sources', 'categories', 'length', 'distinct', 'title', 'source', 'last_updated', 'lang']) AS check_name,
    unnest([n >= 500, sources >= 10, categories >= 10, long_texts >= 0.9 * n, texts >= 0.8 * n, titled >= 0.9 * n, sourced >= 0.9 * n, dated >= 0.9 * n, languages >= 0.9 * n]) AS passed FROM a)
  SELECT check_name, passed, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) OVER (), 4) AS ratio FROM c""")
def scorecard(t):
    filled = lambda c: F.count_if(F.col(c) != "").alias(f"f_{c}")
    a = t.documents.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("category").alias("categories"), F.count_if(F.length("text") >= 50).alias("long_texts"), F.count_distinct(F.md5("text")).alias("texts"), *[filled(c) for c in ("title", "source", "last_updated", "lang")])
    c = a.selectExpr("stack(9, 'documents', n >= 500, 'sources', sources >= 10, 'categories', categories >= 10, 'length', long_texts >= 0.9 * n, 'distinct', texts >= 0.8 * n, 'title', f_title >= 0.9 * n, 'source', f_source >= 0.9 * n, 'last_updated', f_last_updated >= 0.9 * n, 'lang', f_lang >= 0.9 * n) as (check_name, passed)")
    return c.withColumn("ratio", F.round(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).over(Window.partitionBy()), 4))  # nine rows


@query("SELECT category, count(*) AS n FROM documents GROUP BY category")
def dist_category(t):
    return t.documents.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n FROM documents WHERE source <> '' GROUP BY source ORDER BY n DESC, source LIMIT 20")
def top_departments(t):
    return t.documents.filter("source <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(20)


@query("WITH a AS (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {c} <> '') AS c_{c}" for c in FIELDS) + ") FROM documents".replace(") FROM", " FROM") + ") " + " UNION ALL ".join(f"SELECT '{c}' AS field, c_{c} AS filled, total, round(100.0 * c_{c} / total, 4) AS pct FROM a" for c in FIELDS))
def field_coverage(t):
    a = t.documents.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c) != "").alias(c) for c in FIELDS])
    rows = ", ".join(f"'{c}', `{c}`" for c in FIELDS)
    return a.selectExpr("total", f"stack({len(FIELDS)}, {rows}) as (field, filled)").select("field", "filled", "total", F.round(F.lit(100.0) * F.col("filled") / F.col("total"), 4).alias("pct"))


@query("SELECT count(DISTINCT source_url) AS urls, count(DISTINCT source) AS sources FROM documents")
def distinct_sources(t):
    return t.documents.agg(F.count_distinct("source_url").alias("urls"), F.count_distinct("source").alias("sources"))


@query("SELECT md5(text) AS content_hash, count(*) AS cnt FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY cnt DESC, content_hash LIMIT 20")
def dup_content_groups(t):
    g = t.documents.filter("text is not null").groupBy(F.md5("text").alias("content_hash")).agg(F.count(F.lit(1)).alias("cnt"))
    return g.filter("cnt > 1").orderBy(F.desc("cnt"), "content_hash").limit(20)


@query("SELECT count(*) AS groups, CAST(coalesce(sum(c), 0) AS BIGINT) AS rows_in_groups FROM (SELECT count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1)")
def dup_group_count(t):
    g = t.documents.filter("text is not null").groupBy(F.md5("text")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows_in_groups"))


@query("SELECT round(avg(length(text)), 4) AS avg_len, min(length(text)) AS min_len, max(length(text)) AS max_len, quantile_cont(length(text), 0.5) AS median_len FROM documents WHERE text IS NOT NULL")
def length_stats(t):
    n = F.length("text")
    return t.documents.filter("text is not null").agg(F.round(F.avg(n), 4).alias("avg_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.percentile(n, 0.5).alias("median_len"))


@query(f"SELECT bucket, count(*) AS n FROM (SELECT {BUCKET} AS bucket FROM (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL)) GROUP BY bucket")
def char_buckets(t):
    return t.documents.filter("text is not null").groupBy(quality.bucket(F.length("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


URL_TYPE = "CASE WHEN url IS NULL OR url = '' THEN 'none' WHEN regexp_matches(url, 'BirimIcerik') THEN 'deep' WHEN regexp_matches(url, 'Birim.*\\.aspx') THEN 'unit' WHEN regexp_matches(url, '\\.pdf') THEN 'pdf' WHEN regexp_matches(url, 'icerik/') THEN 'slug' ELSE 'other' END"


@query(f"SELECT {URL_TYPE} AS url_type, count(*) AS n FROM page_results GROUP BY 1")
def url_type_buckets(t):
    u = F.col("url")
    kind = F.when(u.isNull() | (u == ""), "none").when(u.contains("BirimIcerik"), "deep").when(u.rlike(r"Birim.*\.aspx"), "unit").when(u.contains(".pdf"), "pdf").when(u.contains("icerik/"), "slug").otherwise("other")
    return t.page_results.groupBy(kind.alias("url_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE meta.source_type = 'pdf' OR meta.source_url LIKE '%.pdf') AS pdf, count(*) FILTER (WHERE NOT coalesce(meta.source_type = 'pdf' OR meta.source_url LIKE '%.pdf', false)) AS web FROM test_seed")
def source_mix(t):
    pdf = F.coalesce((F.col("meta.source_type") == "pdf") | F.col("meta.source_url").like("%.pdf"), F.lit(False))
    return t.test_seed.agg(F.count_if(pdf).alias("pdf"), F.count_if(~pdf).alias("web"))


META = ("category", "subcategory", "source_url", "source_type", "source_id", "last_updated", "title", "doc_kind", "language", "contact_unit", "contact_info")


@query("WITH a AS (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE trim(meta.{c}) <> '') AS c_{c}" for c in META) + " FROM test_seed) " + " UNION ALL ".join(f"SELECT '{c}' AS field, c_{c} AS filled, total, round_even(100.0 * c_{c} / total, 1) AS pct FROM a" for c in META))
def completeness(t):
    a = t.test_seed.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.trim(f"meta.{c}") != "").alias(c) for c in META])
    rows = ", ".join(f"'{c}', `{c}`" for c in META)
    return a.selectExpr("total", f"stack({len(META)}, {rows}) as (field, filled)").select("field", "filled", "total", F.bround(F.lit(100.0) * F.col("filled") / F.col("total"), 1).alias("pct"))


@query(f"""WITH d AS (SELECT seed_id, content AS text, meta.*, row_number() OVER (PARTITION BY meta.source_url ORDER BY seed_id) AS rn FROM test_seed),
  a AS (SELECT count(*) AS n, avg(({" + ".join(f"CASE WHEN trim({c}) <> '' THEN 1 ELSE 0 END" for c in fixed.REQUIRED_FIELDS if c != "department")}) / 6.0) * 100 AS required_pct,
    100.0 * count(*) FILTER (WHERE {PLACEHOLDER_CASE} IS NOT NULL) / count(*) AS ph, 100.0 * count(*) FILTER (WHERE coalesce({SPACE}, 0) < 50) / count(*) AS short,
    100.0 * count(*) FILTER (WHERE title IS NULL OR trim(title) = '') / count(*) AS untitled, 100.0 * count(*) FILTER (WHERE rn > 1) / count(*) AS dup FROM d),
  s AS (SELECT greatest(0, least(100, 100 - 0.3 * (100 - required_pct) - least(2 * ph, 20) - least(1.5 * short, 15) - least(untitled, 10) - least(dup, 10))) AS score FROM a)
  SELECT round(score, 4) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def health_score(t):
    d = t.test_seed.select("seed_id", F.col("content").alias("text"), "meta.*")
    urls = d.groupBy("source_url").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("again"))  # rows after the first of their url
    required = [c for c in fixed.REQUIRED_FIELDS if c != "department"]
    filled = sum((F.when(F.trim(c) != "", 1).otherwise(0) for c in required), F.lit(0))
    pct = lambda c: F.lit(100.0) * F.count_if(c) / F.count(F.lit(1))
    a = d.agg(
        (F.avg(filled / 6.0) * 100).alias("required_pct"),
        pct(first_keyword(fold("text"), fixed.PLACEHOLDER_KEYWORDS).isNotNull()).alias("ph"),
        pct(F.coalesce(F.length(F.trim("text")), F.lit(0)) < 50).alias("short"),
        pct(quality.blank(F.col("title"))).alias("untitled"),
        F.count(F.lit(1)).alias("n"),
    )
    a = a.crossJoin(urls).withColumn("dup", 100.0 * F.col("again") / F.col("n"))  # one row each
    s = a.selectExpr("greatest(0.0D, least(100.0D, 100 - 0.3D * (100 - required_pct) - least(2 * ph, 20.0D) - least(1.5D * short, 15.0D) - least(untitled, 10.0D) - least(dup, 10.0D))) as score")
    return s.selectExpr("round(score, 4) as score", "case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as grade")


@query("""WITH c AS (SELECT birim_id, count(*) AS n FROM page_results GROUP BY birim_id),
  j AS (SELECT b.birim_id, coalesce(c.n, 0) AS n FROM birimler b LEFT JOIN c USING (birim_id))
  SELECT count(*) AS units, count(*) FILTER (WHERE n > 0) AS covered, count(*) FILTER (WHERE n = 0) AS uncovered, round(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 4) AS pct, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE birim_id NOT IN (SELECT birim_id FROM birimler)) AS unknown_rows FROM j""")
def coverage_report(t):
    counts = t.page_results.groupBy("birim_id").agg(F.count(F.lit(1)).alias("n"))
    j = counts.join(t.birimler.select("birim_id", F.lit(True).alias("known")), "birim_id", "full_outer")
    j = j.select("birim_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("known", F.lit(False)).alias("known"))
    have = F.col("known") & (F.col("n") > 0)
    return j.agg(F.count_if("known").alias("units"), F.count_if(have).alias("covered"), F.count_if(F.col("known") & (F.col("n") == 0)).alias("uncovered"), F.round(F.lit(100.0) * F.count_if(have) / F.count_if("known"), 4).alias("pct"), F.coalesce(F.sum(F.when(~F.col("known") & F.col("birim_id").isNotNull(), F.col("n"))), F.lit(0)).alias("unknown_rows"))


@query("""WITH s AS (SELECT source_url, count(*) AS c FROM documents WHERE source_url IS NOT NULL GROUP BY source_url)
  SELECT (SELECT count(*) FROM documents) AS total, count(*) AS sources, count(*) FILTER (WHERE c > 1) AS multi, least(count(*) FILTER (WHERE c > 1), 20) AS multi_capped, round(avg(c), 4) AS avg_per_source FROM s""")
def delta_report(t):
    s = t.documents.groupBy("source_url").agg(F.count(F.lit(1)).alias("c"))
    ok = F.col("source_url").isNotNull()
    multi = F.count_if(ok & (F.col("c") > 1))
    return s.agg(F.sum("c").alias("total"), F.count_if(ok).alias("sources"), multi.alias("multi"), F.least(multi, F.lit(20)).alias("multi_capped"), F.round(F.avg(F.when(ok, F.col("c"))), 4).alias("avg_per_source"))


@query("""WITH c AS (SELECT doc_id, doc_id % 3 = 0 AS orphan FROM documents), p AS (SELECT CASE WHEN orphan THEN NULL ELSE doc_id // 4 END AS parent FROM c)
  SELECT count(*) AS chunks, count(*) FILTER (WHERE parent IS NULL) AS orphans, count(DISTINCT parent) AS parents, least(count(DISTINCT parent), 20) AS parents_capped FROM p""")
def parent_chunk_report(t):
    parent = F.when(F.col("doc_id") % 3 != 0, F.expr("doc_id div 4"))
    p = t.documents.select(parent.alias("parent"))
    return p.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("parent").isNull()).alias("orphans"), F.count_distinct("parent").alias("parents"), F.least(F.count_distinct("parent"), F.lit(20)).alias("parents_capped"))


@query("""SELECT doc_kind, count(*) AS n, count(*) FILTER (WHERE reading_level >= 3) AS pass, count(*) FILTER (WHERE reading_level = 2) AS partial, count(*) FILTER (WHERE reading_level < 2) AS fail, round(avg(reading_level), 4) AS avg_score
  FROM reading_labels JOIN documents USING (doc_id) GROUP BY doc_kind""")
def eval_summary(t):
    j = t.reading_labels.select("doc_id", "reading_level").join(t.documents.select("doc_id", "doc_kind"), "doc_id")
    v = F.col("reading_level")
    return j.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(v >= 3).alias("pass"), F.count_if(v == 2).alias("partial"), F.count_if(v < 2).alias("fail"), F.round(F.avg(v), 4).alias("avg_score"))


@query("SELECT event_type, round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value, CASE WHEN avg(value) > 15 THEN 'bad' WHEN avg(value) > 10 THEN 'medium' ELSE 'ok' END AS band FROM events GROUP BY event_type")
def latency_summary(t):
    a = F.avg("value")
    return t.events.groupBy("event_type").agg(F.round(a, 4).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.when(a > 15, "bad").when(a > 10, "medium").otherwise("ok").alias("band"))


@query("""SELECT grup, birim_adi, count(*) AS pages, CAST(coalesce(sum(char_count), 0) AS BIGINT) AS chars, count(*) FILTER (WHERE is_valid) AS valid
  FROM page_results JOIN birimler USING (birim_id) GROUP BY ROLLUP (grup, birim_adi)""")
def run_rollup(t):
    j = t.page_results.select("birim_id", "char_count", "is_valid").join(F.broadcast(t.birimler.select("birim_id", "grup", "birim_adi")), "birim_id")  # 60 units
    return j.rollup("grup", "birim_adi").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars"), F.count_if("is_valid").alias("valid"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM documents WHERE text IS NOT NULL QUALIFY first_id < doc_id")
def dup_content_first(t):
    h = t.documents.filter("text is not null").select("doc_id", F.md5("text").alias("h"))
    first = quality.firsts(h, "h", "doc_id")
    return guarded_join(h, first, ["h"]).filter("__first < doc_id").select("doc_id", F.col("__first").alias("first_id"))


@query("SELECT count(*) AS total, count(embedding) AS with_embedding, count(*) FILTER (WHERE embedding IS NULL) AS without_embedding, count(*) FILTER (WHERE embedding IS NULL) = 0 AS passed FROM embeddings")
def embedding_coverage(t):
    none = F.count_if(F.col("embedding").isNull())
    return t.embeddings.agg(F.count(F.lit(1)).alias("total"), F.count("embedding").alias("with_embedding"), none.alias("without_embedding"), (none == 0).alias("passed"))


@query("SELECT len(embedding) AS dim, count(*) AS n, len(embedding) = 64 AS passed FROM embeddings GROUP BY 1")
def vector_dim_check(t):
    return t.embeddings.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).withColumn("passed", F.col("dim") == 64)


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\x{0385}-\\x{10FFFF}]')) > 3 AS garbled FROM documents WHERE text IS NOT NULL")
def garbled_flag(t):
    return t.documents.filter("text is not null").select("doc_id", (F.regexp_count("text", F.lit("[\\x{0385}-\\x{10FFFF}]")) > 3).alias("garbled"))


@query("SELECT DISTINCT department FROM page_results WHERE department ILIKE '%merkez%' OR department ILIKE '%daire%'")
def distinct_units(t):
    return t.page_results.filter(F.col("department").ilike("%merkez%") | F.col("department").ilike("%daire%")).select("department").distinct()


@query("SELECT count(*) AS n, count(*) FILTER (WHERE nullif(trim(meta.title), '') IS NULL) AS untitled, count(*) FILTER (WHERE regexp_matches(meta.last_updated, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) AS day_format, count(*) FILTER (WHERE regexp_matches(meta.last_updated, 'T.*Z$')) AS stamp_format, count(*) FILTER (WHERE meta.source_url LIKE 'http%') AS public_urls FROM test_seed")
def migration_stats(t):
    m = lambda c: F.col(f"meta.{c}")
    return t.test_seed.agg(F.count(F.lit(1)).alias("n"), F.count_if(quality.blank(m("title"))).alias("untitled"), F.count_if(m("last_updated").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).alias("day_format"), F.count_if(m("last_updated").rlike("T.*Z$")).alias("stamp_format"), F.count_if(m("source_url").like("http%")).alias("public_urls"))
