"""URL queries over page_results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import first_rule
from ..operators import urls
from .base import case_sql, query

NETLOC = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
REST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)"
PATH = f"regexp_replace(regexp_extract({REST}, '^([^?]*)', 1), '/+$', '')"
NORMAL = f"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {NETLOC} || CASE WHEN length({PATH}) > 0 THEN {PATH} ELSE '/' END || regexp_extract({REST}, '(\\?.*)$', 1)"
HOST = f"regexp_replace({NETLOC}, '^www\\.', '')"
SEGMENT = f"CASE WHEN regexp_matches(string_split({PATH}, '/')[-1], '^[0-9]+$') AND len(string_split({PATH}, '/')) > 1 THEN string_split({PATH}, '/')[-2] ELSE string_split({PATH}, '/')[-1] END"
UNIT_NAME = "CASE WHEN regexp_extract(s, '^Birim(.+)\\.aspx$', 1) <> '' THEN regexp_extract(s, '^Birim(.+)\\.aspx$', 1) ELSE regexp_replace(s, '\\.[A-Za-z]+$', '') END"


@query(f"SELECT page_id, {NORMAL} AS url FROM page_results")
def url_normalize(t):
    return t.page_results.select("page_id", urls.normalize(F.col("url")).alias("url"))


@query(f"SELECT page_id FROM page_results WHERE {NETLOC} = 'akcasu.edu.example' OR {NETLOC} LIKE '%.akcasu.edu.example' OR {NETLOC} = 'sedefkaya.example' OR {NETLOC} LIKE '%.sedefkaya.example'")
def domain_filter(t):
    return t.page_results.filter(urls.allowed(F.col("url"), ["akcasu.edu.example", "sedefkaya.example"])).select("page_id")


@query("""SELECT page_id, CASE WHEN u = '' OR u LIKE 'javascript:%' THEN 'parent' WHEN u LIKE '#%' THEN 'anchor' WHEN c LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(c, '\\.(docx?|xlsx?|pptx?|zip|rar)$') THEN 'doc'
    WHEN contains(u, '/media/') AND contains(u, '.pdf') THEN 'pdf' WHEN n <> '' AND regexp_replace(n, '^www\\.', '') <> 'yenipinar.edu.example' THEN 'external' ELSE 'page' END AS kind
  FROM (SELECT page_id, lower(trim(url)) AS u, regexp_replace(lower(trim(url)), '[?#].*$', '') AS c, regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS n FROM page_results)""")
def link_classify(t):
    return t.page_results.select("page_id", urls.link_kind(F.col("url"), "yenipinar.edu.example").alias("kind"))


@query(f"SELECT page_id, replace({NETLOC}, 'www.', '') || {REST} AS source_id FROM page_results")
def url_source_id(t):
    u = F.col("url")
    return t.page_results.select("page_id", F.concat(F.replace(urls.netloc(u), F.lit("www."), F.lit("")), urls.path_query(u)).alias("source_id"))


@query("SELECT page_id, regexp_extract(url, '[?&]id=([0-9]+)', 1) AS unit_id FROM page_results WHERE regexp_matches(url, '[?&]id=[0-9]+')")
def url_query_param(t):
    return t.page_results.select("page_id", F.regexp_extract("url", r"[?&]id=([0-9]+)", 1).alias("unit_id")).filter("unit_id <> ''")


@query(f"SELECT page_id, {NORMAL} AS url FROM page_results QUALIFY row_number() OVER (PARTITION BY {NORMAL} ORDER BY page_id) = 1")
def url_first_seen(t):
    # the first row of a url is a minimum: partial aggregation, no window over a hot url
    return t.page_results.groupBy(urls.normalize(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id")).select("page_id", "url")


@query(f"SELECT page_id FROM page_results WHERE string_split({PATH}, '/')[2] IN ('duyuru', 'haber') OR regexp_extract(url, '[?&]id=([0-9]+)', 1) IN ('30', '7', '12')")
def scope_filter(t):
    u = F.col("url")
    path = F.regexp_replace(F.regexp_replace(urls.path_query(u), r"\?.*$", ""), "/+$", "")
    return t.page_results.filter(F.get(F.split(path, "/"), F.lit(1)).isin("duyuru", "haber") | F.regexp_extract(u, r"[?&]id=([0-9]+)", 1).isin("30", "7", "12")).select("page_id")


@query(f"""WITH p AS (SELECT page_id, {HOST} AS h, lower({HOST} || {PATH}) AS slug, url FROM page_results)
  SELECT slug, min(page_id) AS page_id FROM p WHERE h IN ('yenipinar.edu.example', 'sedefkaya.example') AND NOT regexp_matches(url, 'Birim|/media/') GROUP BY slug""")
def slug_url_filter(t):
    u = F.col("url")
    host = F.regexp_replace(urls.netloc(u), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(urls.path_query(u), r"\?.*$", ""), "/+$", "")
    p = t.page_results.filter(host.isin("yenipinar.edu.example", "sedefkaya.example") & ~u.rlike("Birim|/media/"))
    return p.groupBy(F.lower(F.concat(host, path)).alias("slug")).agg(F.min("page_id").alias("page_id"))


@query("SELECT seed_id, CASE WHEN regexp_matches(meta.contact_info, '(?i)^\\s*https?://') THEN meta.contact_info WHEN regexp_matches(meta.source_url, '(?i)^\\s*https?://') THEN meta.source_url END AS public_url FROM test_seed")
def public_url(t):
    web = lambda c: F.when(F.col(c).rlike(r"(?i)^\s*https?://"), F.col(c))
    return t.test_seed.select("seed_id", F.coalesce(web("meta.contact_info"), web("meta.source_url")).alias("public_url"))


@query("SELECT lower(regexp_extract(url, '//([^/:?]*)', 1)) AS domain, count(*) AS n FROM page_results GROUP BY 1")
def domain_counts(t):
    return t.page_results.groupBy(F.lower(F.regexp_extract("url", "//([^/:?]*)", 1)).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.slug_page_id FROM static_slugs_output s WHERE NOT EXISTS (SELECT 1 FROM birimler b WHERE contains(s.url, b.slug) OR contains(b.slug, s.url))")
def url_contains_anti(t):
    # the registry has a fixed number of units; containment has no key to join on
    known = F.broadcast(t.birimler.select(F.col("slug").alias("known")))
    s = t.static_slugs_output.select("slug_page_id", "url")
    return s.join(known, F.contains("url", "known") | F.contains("known", "url"), "left_anti").select("slug_page_id")


@query(f"SELECT page_id, {case_sql('lower(url)', fixed.URL_KINDS, chr(39) + 'genel' + chr(39))} AS doc_kind FROM page_results")
def url_doc_kind(t):
    return t.page_results.select("page_id", first_rule(F.lower("url"), fixed.URL_KINDS, F.lit("genel")).alias("doc_kind"))


@query(f"SELECT page_id, upper(substring(n, 1, 1)) || substring(n, 2) AS title FROM (SELECT page_id, trim(regexp_replace({UNIT_NAME}, '[-_]+', ' ', 'g')) AS n FROM (SELECT page_id, {SEGMENT} AS s FROM page_results))")
def slug_title(t):
    return t.page_results.select("page_id", urls.slug_title(F.col("url")).alias("title"))


@query("SELECT url AS first_url, page_id, rn FROM (SELECT url, page_id, row_number() OVER (PARTITION BY birim_id ORDER BY page_id) AS rn FROM page_results) WHERE rn <= 10")
def group_limit(t):
    w = Window.partitionBy("birim_id").orderBy("page_id")
    return t.page_results.select("birim_id", "page_id", F.col("url").alias("first_url")).withColumn("rn", F.row_number().over(w)).filter("rn <= 10").select("first_url", "page_id", "rn")


# every page links to these forms of address
HREFS = ("/media/f.pdf", "../ust/belge.pdf", "alt/sayfa?x=1", "./yan", "#bas", "?sayfa=2", "//diger.example/y", "https://dis.example/a/../b")
ROOT_SQL = f"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {NETLOC}"
DIR_SQL = f"CASE WHEN regexp_extract({REST}, '^([^?]*)', 1) LIKE '%/%' THEN regexp_replace(regexp_extract({REST}, '^([^?]*)', 1), '[^/]*$', '') ELSE '/' END"


@query(f"""WITH h AS (SELECT page_id, url, unnest([{", ".join(f"'{h}'" for h in HREFS)}]) AS href FROM page_results),
  j AS (SELECT page_id, href, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href LIKE '//%' THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || ':' || href WHEN href LIKE '/%' THEN {ROOT_SQL} || href WHEN href LIKE '#%' THEN {ROOT_SQL} || {REST} || href
    WHEN href LIKE '?%' THEN {ROOT_SQL} || regexp_extract({REST}, '^([^?]*)', 1) || href ELSE {ROOT_SQL} || {DIR_SQL} || href END AS u FROM h)
  SELECT page_id, href, regexp_replace(regexp_replace(regexp_replace(u, '/\\./', '/', 'g'), '(://[^/]*(?:/.*)?)/[^/.?#][^/]*/\\.\\./', '\\1/'), '(://[^/]*)/\\.\\./', '\\1/') AS resolved FROM j""")
def url_absolute(t):
    h = t.page_results.select("page_id", "url", F.explode(F.array(*[F.lit(x) for x in HREFS])).alias("href"))
    return h.select("page_id", "href", urls.absolute(F.col("url"), F.col("href")).alias("resolved"))


@query(f"SELECT page_id, {ROOT_SQL} || '/dosya/f ' || (page_id % 50) || '.pdf' AS file FROM page_results")
def viewer_unwrap(t):
    """Files behind a viewer page; each page's host has one viewer address for each of fifty files."""
    root = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url")))
    shown = F.concat(root, F.lit("/goster/web/PdfViewer.aspx?a=1&file=..%2F..%2Fdosya%2Ff%20"), (F.col("page_id") % 50).cast("string"), F.lit(".pdf&b=2#s"))
    return t.page_results.select("page_id", urls.unwrapped(shown).alias("file"))
