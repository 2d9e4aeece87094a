"""Answer queries: a page's text stands for an answer, the slug page with the same number for its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import fold
from ..operators import answers as A
from .base import fold_sql, query

PAIR_SQL = "(SELECT p.page_id, p.body_content AS a, p.department AS dep, [coalesce(s.content_preview, ''), coalesce(s.url, '')] AS src FROM page_results p LEFT JOIN static_slugs_output s ON s.slug_page_id = p.page_id)"
NOT_IN = lambda pattern: f"list_filter(list_distinct(regexp_extract_all(a, '{pattern}')), lambda m: len(list_filter(src, lambda s: contains(s, m))) = 0)"
URL_SQL = r"https?://[^\s\)\]\}>\"'']+"
ROWS = lambda e, name: f"SELECT page_id, unnest({e}) AS {name} FROM {PAIR_SQL}"


def pairs(t):
    s = t.static_slugs_output.select(F.col("slug_page_id").alias("page_id"), F.array(F.coalesce("content_preview", F.lit("")), F.coalesce("url", F.lit(""))).alias("src"))
    p = t.page_results.select("page_id", F.col("body_content").alias("a"), F.col("department").alias("dep"))
    return p.join(s, "page_id", "left").withColumn("src", F.coalesce("src", F.array(F.lit(""), F.lit(""))))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def source_preview(t):
    return t.documents.select("doc_id", A.preview(F.col("text")).alias("preview"))


@query(ROWS(NOT_IN(URL_SQL), "url"))
def ungrounded_urls(t):
    return pairs(t).select("page_id", F.explode(A.ungrounded(F.col("a"), fixed.URL, F.col("src"))).alias("url"))


@query(ROWS("list_filter(list_distinct(regexp_extract_all(a, '\\+?\\(?\\d[\\d\\s\\(\\)\\-]{8,}\\d')), lambda m: length(regexp_replace(m, '\\D', '', 'g')) >= 10 AND len(list_filter(src, lambda s: contains(s, m) OR contains(regexp_replace(s, '\\D', '', 'g'), regexp_replace(m, '\\D', '', 'g')))) = 0)", "phone"))
def ungrounded_phones(t):
    return pairs(t).select("page_id", F.explode(A.ungrounded(F.col("a"), fixed.PHONE, F.col("src"), plain=False)).alias("phone"))


@query(ROWS(NOT_IN(r"[\w.+-]+@[\w.-]+\.\w{2,}"), "email"))
def ungrounded_emails(t):
    return pairs(t).select("page_id", F.explode(A.ungrounded(F.col("a"), fixed.EMAIL, F.col("src"))).alias("email"))


@query()
def validate_answer(t):
    return pairs(t).select("page_id", A.validate_column(F.col("a"), F.col("src"), ("other-site.example",)).alias("answer"))


@query(r"SELECT page_id, regexp_replace(body_content, '[A-Za-z]:\\[^\s" + '"' + r"]+', '', 'g') AS text FROM page_results")
def redact_paths(t):
    return t.page_results.select("page_id", F.regexp_replace("body_content", fixed.LOCAL_PATH, "").alias("text"))


@query()
def greedy_source_dedup(t):
    """Kept sources of each list of ten pages: every unit's pages in page order, cut into consecutive lists."""
    from pyspark.sql import Window

    w = Window.partitionBy("birim_id").orderBy("page_id")
    pages = t.page_results.select("birim_id", "page_id", "url", "title", F.md5("body_content").alias("hash")).withColumn("list_no", F.floor((F.row_number().over(w) - 1) / 10).cast("int"))
    lists = pages.groupBy("birim_id", "list_no").agg(F.sort_array(F.collect_list(F.struct(F.col("page_id").alias("id"), "url", "hash", "title"))).alias("s"))  # at most ten each
    return lists.select("birim_id", "list_no", A.greedy_dedup(F.col("s")).alias("kept"))


@query(f"SELECT page_id, CASE WHEN dep IS NULL OR contains({fold_sql('a')}, array_to_string(string_split({fold_sql('dep')}, ' ')[1:2], ' ')) THEN a ELSE a || chr(10) || chr(10) || dep END AS answer FROM {PAIR_SQL}")
def routing_note(t):
    """The answer with the unit to turn to, unless it names the unit's first two words already."""
    two = F.array_join(F.slice(F.split(fold("dep"), " "), 1, 2), " ")
    there = F.col("dep").isNull() | F.contains(fold("a"), two)
    return pairs(t).select("page_id", F.when(there, F.col("a")).otherwise(F.concat("a", F.lit("\n\n"), "dep")).alias("answer"))


REDACT_SQL = "regexp_replace(regexp_replace(regexp_replace(body_content, '\\b\\d{11}\\b', '[TC_KİMLİK_FİLTRELENDİ]', 'g'), '\\b\\d{8,10}\\b', '[ÖĞRENCİ_NO_FİLTRELENDİ]', 'g'), '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b', '[E_POSTA_FİLTRELENDİ]', 'g')"


@query(f"SELECT page_id, {REDACT_SQL} AS text FROM page_results")
def pii_redact(t):
    return t.page_results.select("page_id", A.redact(F.col("body_content")).alias("text"))


@query(f"SELECT count(*) FILTER (WHERE contains(x, '[TC_KİMLİK_FİLTRELENDİ]')) AS ids, count(*) FILTER (WHERE contains(x, '[ÖĞRENCİ_NO_FİLTRELENDİ]')) AS numbers, count(*) FILTER (WHERE contains(x, '[E_POSTA_FİLTRELENDİ]')) AS emails FROM (SELECT {REDACT_SQL} AS x FROM page_results)")
def pii_counts(t):
    x = t.page_results.select(A.redact(F.col("body_content")).alias("x"))
    return x.agg(*[F.count_if(F.contains("x", F.lit(m))).alias(n) for (_, m), n in zip(fixed.PII, ("ids", "numbers", "emails"))])


@query(f"""WITH k AS (SELECT page_id, body_content AS a, list_filter(string_split({fold_sql("coalesce(title, '')")}, ' '), lambda w: length(w) > 3) AS ks FROM page_results),
  r AS (SELECT page_id, a, len(ks) AS wanted, len(list_filter(ks, lambda w: contains({fold_sql('a')}, w))) AS found FROM k),
  s AS (SELECT page_id, 5 + CASE WHEN wanted = 0 THEN 0 WHEN found >= 0.8 * wanted THEN 2 WHEN found >= 0.5 * wanted THEN 1 ELSE -2 END + CASE WHEN contains({fold_sql('a')}, 'lorem') THEN -3 ELSE 0 END + CASE WHEN length(a) < 50 THEN -2 WHEN length(a) < 100 THEN -1 ELSE 0 END
    + CASE WHEN regexp_matches(a, 'https?://') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(a, '\\*\\*|^#|\\n- ') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(a, '@|\\([0-9]{{3}}\\)') THEN 1 ELSE 0 END AS s FROM r)
  SELECT page_id, least(greatest(s, 0), 10) AS score, CASE WHEN s >= 7 THEN 'PASS' WHEN s >= 4 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM s""")
def answer_score(t):
    ks = F.filter(F.split(fold(F.coalesce("title", F.lit(""))), " "), lambda w: F.length(w) > 3)
    k = t.page_results.select("page_id", F.col("body_content").alias("a"), ks.alias("ks")).withColumn("low", fold("a"))
    r = k.select("page_id", "a", "low", F.size("ks").alias("wanted"), F.size(F.filter("ks", lambda w: F.contains(F.col("low"), w))).alias("found"))
    s = r.select("page_id", A.score(F.col("a"), F.col("found"), F.col("wanted"), F.contains("low", F.lit("lorem"))).alias("score"))
    return s.withColumn("verdict", F.expr("case when score >= 7 then 'PASS' when score >= 4 then 'PARTIAL' else 'FAIL' end"))
