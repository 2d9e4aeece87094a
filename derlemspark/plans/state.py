"""Incremental and join queries: upserts, scans, lookups, overlays, logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metadata
from ..sources import state
from .base import fold_sql, query

OLD_SQL = "SELECT doc_id, text, title FROM documents WHERE doc_id % 3 <> 0"
NEW_SQL = "SELECT doc_id, title AS text, text AS title FROM documents WHERE doc_id % 2 = 0"


def old(t):
    return t.documents.filter("doc_id % 3 <> 0").select("doc_id", "text", "title")


def new(t):
    return t.documents.filter("doc_id % 2 = 0").select("doc_id", F.col("title").alias("text"), F.col("text").alias("title"))


@query("SELECT doc_id, title, category FROM documents WHERE category = 'kampus' AND doc_kind = 'duyuru' ORDER BY doc_id LIMIT 10000")
def scan_filter_limit(t):
    return t.documents.filter("category = 'kampus' and doc_kind = 'duyuru'").select("doc_id", "title", "category").orderBy("doc_id").limit(10000)


@query("SELECT doc_id, title FROM documents ORDER BY doc_id LIMIT 64 OFFSET 128")
def page_offset(t):
    return t.documents.select("doc_id", "title").orderBy("doc_id").offset(128).limit(64)


@query(f"WITH o AS ({OLD_SQL}), n AS ({NEW_SQL}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)")
def upsert_skip(t):
    return state.upsert_skip(old(t), new(t), "doc_id", "doc_id")


@query(f"WITH o AS ({OLD_SQL}), n AS ({NEW_SQL}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def upsert_overwrite(t):
    return state.upsert_overwrite(old(t), new(t), "doc_id", "doc_id")


@query("SELECT event_id, user_id, event_type AS user_query, nullif(props, '') AS source_documents, ts FROM events")
def chat_log_projection(t):
    return t.events.select("event_id", "user_id", F.col("event_type").alias("user_query"), F.nullif("props", F.lit("")).alias("source_documents"), "ts")


@query("SELECT seed_id, trim(meta.title) AS title, left(meta.last_updated, 10) AS last_updated FROM test_seed WHERE trim(meta.title) IS DISTINCT FROM meta.title OR left(meta.last_updated, 10) IS DISTINCT FROM meta.last_updated")
def meta_changed_rows(t):
    before = t.test_seed.select("seed_id", "meta.title", "meta.last_updated")
    after = before.select("seed_id", F.trim("title").alias("title"), F.substring("last_updated", 1, 10).alias("last_updated"))
    return state.changed_rows(before, after, "seed_id", ["title", "last_updated"])


KEY_SQL = lambda c: f"trim(regexp_replace(translate(regexp_replace({fold_sql(c)}, '[.]pdf$', ''), 'çğıöşüâîû', 'cgiosuaiu'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT seed_id, meta.source_id AS source_id, meta.title AS title, CASE WHEN seed_id % 3 = 0 THEN 'C:\\arsiv\\' || coalesce(meta.title, 'x') || '.pdf' ELSE meta.source_url END AS path, coalesce(meta.language, 'tr') AS language FROM test_seed),
  l AS (SELECT key, min(url) AS url FROM (SELECT {KEY_SQL('title')} AS key, source_url AS url FROM documents WHERE regexp_matches(source_url, '^https?://')) WHERE key <> '' GROUP BY key HAVING min(url) = max(url)),
  p AS (SELECT *, trim(path) <> '' AND NOT regexp_matches(path, '(?i)^\\s*https?://') AS is_local FROM s)
  SELECT seed_id, source_id, language, CASE WHEN is_local THEN path END AS file_path, CASE WHEN is_local THEN coalesce(a.url, b.url) WHEN trim(path) <> '' THEN path END AS public_url, CASE WHEN is_local THEN CASE WHEN coalesce(a.url, b.url) IS NULL THEN 'unresolved_local_pdf' ELSE 'resolved' END END AS status
  FROM p LEFT JOIN l a ON is_local AND a.key = {KEY_SQL("regexp_extract(regexp_replace(path, '[?#].*$', ''), '([^/' || chr(92) || chr(92) || ']*)$', 1)")} LEFT JOIN l b ON is_local AND b.key = {KEY_SQL('title')}""")
def meta_rewrite(t):
    """Metadata of the seeds rewritten; every third seed stands for a local file named as its title, the documents' titles and addresses for the links."""
    path = F.when(F.col("seed_id") % 3 == 0, F.concat(F.lit("C:\\arsiv\\"), F.coalesce("meta.title", F.lit("x")), F.lit(".pdf"))).otherwise(F.col("meta.source_url"))
    seeds = t.test_seed.select("seed_id", "meta.source_id", "meta.title", path.alias("path"), F.coalesce("meta.language", F.lit("tr")).alias("language"))
    links = t.documents.filter("source_url rlike '^https?://'").select(metadata.name_key(F.col("title")).alias("key"), F.col("source_url").alias("url"))
    return metadata.with_public_urls(seeds, links, "path", "title").select("seed_id", "source_id", "language", "file_path", "public_url", "status")


@query("SELECT doc_id FROM documents WHERE (doc_id // 4) IS DISTINCT FROM 25")
def orphan_cleanup(t):
    return t.documents.select("doc_id", F.expr("doc_id div 4").alias("parent")).filter(~F.col("parent").eqNullSafe(F.lit(25))).select("doc_id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def log_ring_last_n(t):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)


@query(f"SELECT page_id FROM page_results WHERE {fold_sql('url')} NOT IN (SELECT {fold_sql('source_url')} FROM documents WHERE source_url IS NOT NULL)")
def new_only_anti(t):
    from ..functions.text import fold

    known = t.documents.filter("source_url is not null").select(fold("source_url").alias("u"))
    p = t.page_results.select("page_id", fold("url").alias("u"))
    return p.join(known, "u", "left_anti").select("page_id")


KEY_SQL = lambda c: f"trim(regexp_replace(translate({fold_sql(c)}, 'çğıöşüâîû', 'cgiosuaiu'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH k AS (SELECT {KEY_SQL('title')} AS key, min(url) AS url FROM static_slugs_output WHERE title IS NOT NULL GROUP BY 1 HAVING count(DISTINCT url) = 1) SELECT page_id, k.url AS public_url FROM page_results LEFT JOIN k ON k.key = {KEY_SQL('page_results.title')}")
def unambiguous_lookup(t):
    from ..functions.text import ascii_fold

    key = lambda c: F.trim(F.regexp_replace(ascii_fold(F.col(c)), "[^a-z0-9]+", " "))
    k = t.static_slugs_output.filter("title is not null").groupBy(key("title").alias("key")).agg(F.min("url").alias("public_url"), F.max("url").alias("m")).filter("public_url = m").drop("m")
    return t.page_results.select("page_id", key("title").alias("key")).join(k, "key", "left").select("page_id", "public_url")


@query("SELECT k.kayit_id, coalesce(nullif(trim(k.eposta), ''), b.slug || '@' || b.host) AS eposta, coalesce(nullif(trim(k.web), ''), b.host) AS web FROM birim_iletisim_tablosu k LEFT JOIN birimler b ON b.slug = k.slug")
def contact_overlay(t):
    b = t.birimler.select("slug", "host")
    own = lambda c: F.nullif(F.trim(c), F.lit(""))
    return t.birim_iletisim_tablosu.select("kayit_id", "slug", "eposta", "web").join(F.broadcast(b), "slug", "left").select("kayit_id", F.coalesce(own("eposta"), F.concat("slug", F.lit("@"), "host")).alias("eposta"), F.coalesce(own("web"), "host").alias("web"))


@query("SELECT grup, string_agg(birim_adi || ' (' || slug || ')', '; ' ORDER BY birim_adi, slug) AS members FROM birimler GROUP BY grup")
def group_directory(t):
    g = t.birimler.groupBy("grup").agg(F.sort_array(F.collect_list(F.struct("birim_adi", "slug"))).alias("m"))  # the unit registry has a fixed size
    return g.select("grup", F.array_join(F.transform("m", lambda x: F.concat(x["birim_adi"], F.lit(" ("), x["slug"], F.lit(")"))), "; ").alias("members"))


@query("SELECT 'page' AS kind, page_id AS id, title, depth FROM page_results UNION ALL SELECT 'slug', slug_page_id, title, NULL FROM static_slugs_output UNION ALL SELECT 'seed', seed_id, meta.title, NULL FROM test_seed")
def union_sources(t):
    a = t.page_results.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "title", "depth")
    b = t.static_slugs_output.select(F.lit("slug").alias("kind"), F.col("slug_page_id").alias("id"), "title")
    c = t.test_seed.select(F.lit("seed").alias("kind"), F.col("seed_id").alias("id"), "meta.title")
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("SELECT page_id, url FROM (SELECT page_id, url, dense_rank() OVER (PARTITION BY birim_id ORDER BY CAST(fetched_at AS DATE) DESC) AS d FROM page_results WHERE birim_id IS NOT NULL) WHERE d <= 3")
def delta_window(t):
    w = Window.partitionBy("birim_id").orderBy(F.desc("day"))
    days = t.page_results.filter("birim_id is not null").select("birim_id", F.to_date("fetched_at").alias("day")).distinct().withColumn("d", F.row_number().over(w)).filter("d <= 3")
    return t.page_results.select("page_id", "url", "birim_id", F.to_date("fetched_at").alias("day")).join(days, ["birim_id", "day"]).select("page_id", "url")


@query("SELECT url, fetched_at, h AS hash FROM (SELECT url, fetched_at, left(sha256(body_content), 16) AS h, lag(left(sha256(body_content), 16)) OVER (PARTITION BY url ORDER BY fetched_at) AS b FROM page_results) WHERE h IS DISTINCT FROM b")
def content_changed(t):
    return state.content_changes(t.page_results.select("url", "fetched_at", "body_content"), "url", "fetched_at", "body_content")


@query("SELECT b.birim_id, k.page_kind FROM birimler b, (SELECT unnest(['akademik', 'idari', 'yonetim']) AS page_kind) k WHERE NOT EXISTS (SELECT 1 FROM page_results p WHERE p.birim_id = b.birim_id AND p.category = k.page_kind)")
def cross_anti(t):
    kinds = F.array(*[F.lit(k) for k in ("akademik", "idari", "yonetim")])
    wanted = t.birimler.select("birim_id", F.explode(kinds).alias("page_kind"))  # units times three kinds
    have = t.page_results.select("birim_id", F.col("category").alias("page_kind"))
    return wanted.join(have, ["birim_id", "page_kind"], "left_anti")
