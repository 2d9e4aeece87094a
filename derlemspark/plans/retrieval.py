"""Retrieval queries. The stated query set is every row whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import fold, strings, tokens
from ..operators import retrieval as R
from ..operators.joins import guarded_join, hot_join
from ..session import reliable
from .base import fold_sql, list_sql, query, tokens_sql

VEC = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
  s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v AS q, v WHERE q.vec_id % 50 = 0),
  vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)"""
BM = f"""d AS (SELECT doc_id, {tokens_sql('text')} AS ts FROM documents WHERE text IS NOT NULL),
  qt AS (SELECT DISTINCT doc_id AS query_id, unnest({tokens_sql('title')}) AS term FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
  tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
  sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
  kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


#: Share of the cells that a query of the index looks into.
PROBED = 0.4


def vector_leg(t, k):
    return R.top_cosine(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), k)


def titles(t):
    return t.documents.filter("doc_id % 50 = 0")


def keyword_leg(t, k, asked=None):
    """asked: column query_id, if only these queries are of use."""
    terms = R.query_terms(titles(t), "doc_id", "title")
    return R.top_bm25(t.documents, "doc_id", "text", terms if asked is None else guarded_join(terms, asked, ["query_id"], "left_semi"), k)


@query(f"WITH {VEC} SELECT query_id, vec_id, similarity, rank FROM vr WHERE rank <= 5")
def vector_topk(t):
    return vector_leg(t, 5)


@query(f"WITH {BM} SELECT query_id, doc_id, score, rank FROM kr WHERE rank <= 3")
def bm25_topk(t):
    return keyword_leg(t, 3)


@query(f"WITH {BM}, n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1) SELECT query_id, doc_id FROM qt JOIN tf USING (term) JOIN n USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) = n")
def keyword_and(t):
    return R.all_terms(t.documents, "doc_id", "text", R.query_terms(titles(t), "doc_id", "title"))


RRF_SQL = f"""WITH {VEC}, {BM}, u AS (SELECT query_id, vec_id AS id, rank FROM vr WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, rank FROM kr WHERE rank <= 10),
  f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)"""


def fused(t):
    return R.fuse([vector_leg(t, 10).select("query_id", F.col("vec_id").alias("id"), "rank"), keyword_leg(t, 10).select("query_id", F.col("doc_id").alias("id"), "rank")], 5)


@query(f"{RRF_SQL} SELECT query_id, id, score, rank FROM r WHERE rank <= 5")
def rrf_hybrid(t):
    return fused(t)


@query(f"WITH {VEC}, {BM} SELECT query_id, count(*) AS overlap FROM (SELECT query_id, vec_id AS id FROM vr WHERE rank <= 100) JOIN (SELECT query_id, doc_id AS id FROM kr WHERE rank <= 100) USING (query_id, id) GROUP BY query_id")
def leg_overlap(t):
    asked = t.embeddings.filter("vec_id % 50 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id")).distinct()  # others have no overlap
    both = vector_leg(t, 100).select("query_id", F.col("vec_id").alias("id")).intersect(keyword_leg(t, 100, asked).select("query_id", F.col("doc_id").alias("id")))
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("overlap"))


@query(f"WITH {VEC} SELECT query_id, round(min(similarity), 4) AS min_s, round(max(similarity), 4) AS max_s, round(avg(similarity), 4) AS mean_s, round(stddev_pop(similarity), 4) AS std_s FROM vr WHERE rank <= 100 GROUP BY query_id")
def similarity_dist(t):
    s = F.col("similarity")
    return vector_leg(t, 100).groupBy("query_id").agg(F.round(F.min(s), 4).alias("min_s"), F.round(F.max(s), 4).alias("max_s"), F.round(F.avg(s), 4).alias("mean_s"), F.round(F.stddev_pop(s), 4).alias("std_s"))


@query()
def ann_recall(t):
    """Share of the exact five nearest that an inverted-file index over all rows finds.

    Cells grow as the root of the rows; every row lies in its two nearest cells, and a query looks into PROBED of all cells.
    Hot cells are dealt; a task keeps its own best of each query before the exchange.
    """
    from math import ceil

    centres = R.centroids(t.embeddings, R.cells_for(t.embeddings.count()))
    rows = reliable(R.in_cells(t.embeddings, centres, 2))
    queries = R.in_cells(t.embeddings.filter("vec_id % 50 = 0"), centres, max(2, ceil(len(centres) * PROBED))).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"), "cell")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    met = hot_join(rows, queries, ["cell"])
    scored = met.select("query_id", "vec_id", F.round(dot("qe", "embedding") / F.sqrt(dot("qe", "qe") * dot("embedding", "embedding")), 6).alias("similarity"))
    # a row in two probed cells is met twice: the ten best meetings hold the five best rows
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    ten = scored.withColumn("place", F.row_number().over(w)).filter("place <= 10").dropDuplicates(["query_id", "vec_id"])
    near = ten.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = vector_leg(t, 5).select("query_id", "vec_id")
    return exact.join(near, ["query_id", "vec_id"], "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


STRATEGIES = ("öğrenci belgesi", "bilgi sistemleri dairesi", "sınav itirazı için", "kütüphane", "which students")
S_TOK = lambda s: f"list_filter(regexp_split_to_array('{s}', '[^a-z0-9çğıöşüâîû]+'), lambda w: w <> '')"


@query(
    f"WITH d AS (SELECT list_distinct({tokens_sql('text')}) AS ts FROM documents WHERE text IS NOT NULL), q AS (SELECT unnest([{list_sql(STRATEGIES)}]) AS query), w AS (SELECT query, string_split(query, ' ') AS ws, list_filter(string_split(query, ' '), lambda x: NOT list_contains([{list_sql(fixed.STOPWORDS)}], x)) AS cs FROM q)"
    " SELECT query, count(*) FILTER (WHERE list_has_all(ts, ws)) AS and_hits, count(*) FILTER (WHERE list_has_any(ts, ws)) AS or_hits, count(*) FILTER (WHERE list_has_all(ts, cs)) AS clean_and_hits FROM w, d GROUP BY query"
)
def search_strategy_matrix(t):
    d = t.documents.filter("text is not null").select(F.array_distinct(tokens(F.col("text"))).alias("ts"))
    out = []
    for s in STRATEGIES:
        ws = s.split(" ")
        cs = [w for w in ws if w not in fixed.STOPWORDS]
        has = lambda words: F.size(F.array_intersect("ts", strings(words))) == len(words)
        out.append(F.struct(F.lit(s).alias("query"), F.count_if(has(ws)).alias("and_hits"), F.count_if(F.arrays_overlap("ts", strings(ws))).alias("or_hits"), F.count_if(has(cs)).alias("clean_and_hits")))
    return d.agg(F.array(*out).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term")
def token_df(t):
    return t.documents.filter("text is not null").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE text ILIKE '%burs%' AND (text ILIKE '%transkript%' OR text ILIKE '%portal%') ORDER BY chars DESC, doc_id LIMIT 20")
def ilike_multi(t):
    x = F.col("text")
    return t.documents.filter(x.ilike("%burs%") & (x.ilike("%transkript%") | x.ilike("%portal%"))).select("doc_id", F.length("text").alias("chars")).orderBy(F.desc("chars"), "doc_id").limit(20)


@query()
def sample(t):
    return t.documents.select("doc_id", "title").orderBy(F.rand(42)).limit(5)


@query(f"WITH {VEC} SELECT count(*) AS queries, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE ok) * 1.0 / count(*) >= 0.6 AS overall FROM (SELECT query_id, max(similarity) > 0.3 AND bool_or(a.label = b.label AND vr.vec_id <> query_id) AS ok FROM vr JOIN embeddings a ON a.vec_id = vr.vec_id JOIN embeddings b ON b.vec_id = query_id WHERE rank <= 5 GROUP BY query_id)")
def retrieval_eval(t):
    labels = t.embeddings.select("vec_id", "label")
    top = vector_leg(t, 5).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    per = top.groupBy("query_id").agg(((F.max("similarity") > 0.3) & F.bool_or((F.col("label") == F.col("own")) & (F.col("vec_id") != F.col("query_id")))).alias("ok"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.count_if("ok").alias("passed"), (F.count_if("ok") / F.count(F.lit(1)) >= 0.6).alias("overall"))


DOC_SQL = "'[' || coalesce(category, '') || '] ' || coalesce(title, '') || chr(10) || 'Kaynak: ' || coalesce(CASE WHEN source_url LIKE 'http%' THEN source_url END, title, '') || chr(10) || coalesce(text, '')"


@query(f"{RRF_SQL} SELECT query_id, string_agg({DOC_SQL}, chr(10) || '---' || chr(10) ORDER BY rank) || chr(10) || 'Soru: ' || (SELECT coalesce(q.title, '') FROM documents q WHERE q.doc_id = query_id) AS prompt FROM r JOIN documents ON doc_id = id WHERE rank <= 5 AND query_id IN (SELECT doc_id FROM documents) GROUP BY query_id")
def prompt_render(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("["), F.coalesce("category", F.lit("")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\nKaynak: "), F.coalesce(F.when(F.col("source_url").like("http%"), F.col("source_url")), "title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("part"))
    found = reliable(fused(t))
    docs = guarded_join(docs, found.select("id").distinct(), ["id"], "left_semi")  # no other text is moved
    parts = found.join(docs, "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "part"))).alias("p"))  # at most five documents a query
    asked = titles(t).select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("question"))
    return parts.join(asked, "query_id").select("query_id", F.concat(F.array_join(F.transform("p", lambda x: x["part"]), "\n---\n"), F.lit("\nSoru: "), "question").alias("prompt"))


@query(f"""WITH k AS (SELECT doc_id, list_distinct(list_filter(string_split({fold_sql('title')}, ' '), lambda w: length(w) > 3)) AS ks, {fold_sql('text')} AS b FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
  r AS (SELECT doc_id, len(ks) AS wanted, len(list_filter(ks, lambda w: contains(b, w))) AS found FROM k)
  SELECT doc_id, wanted, found, CASE WHEN wanted = 0 THEN 'none' WHEN found >= 0.8 * wanted THEN 'good' WHEN found >= 0.5 * wanted THEN 'partial' ELSE 'poor' END AS band FROM r""")
def keyword_recall(t):
    k = t.documents.filter("title is not null and text is not null").select("doc_id", F.array_distinct(F.filter(F.split(fold("title"), " "), lambda w: F.length(w) > 3)).alias("ks"), fold("text").alias("b"))
    r = k.select("doc_id", F.size("ks").alias("wanted"), F.size(F.filter("ks", lambda w: F.contains(F.col("b"), w))).alias("found"))
    return r.withColumn("band", F.expr("case when wanted = 0 then 'none' when found >= 0.8 * wanted then 'good' when found >= 0.5 * wanted then 'partial' else 'poor' end"))
