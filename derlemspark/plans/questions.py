"""Query preprocessing over a questions table: every title of documents serves as a question."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import ascii_fold, begins, first_rule, fold, strings, up_to_last
from ..operators import metadata
from ..operators.joins import guarded_join
from .base import case_sql, fold_sql, list_sql, query

Q = f"(SELECT doc_id, {fold_sql('title')} AS q, title FROM documents WHERE length(title) BETWEEN 1 AND 2000)"
WORDS = "list_filter(string_split(q, ' '), lambda w: w <> '')"
#: The text in which a rule looks: after the last of the words that must not follow.
OUT_SQL = " OR ".join(f"regexp_matches({f"regexp_replace(q, '{up_to_last(unless)}', 'x')" if unless else 'q'}, '{begins(first, then)}')" for first, then, unless in fixed.OUT_OF_SCOPE)
TOPICS = tuple((begins(p), unit) for p, unit in fixed.TOPICS)
SIGNAL_SQL = f"list_has_any({WORDS}, [{list_sql(fixed.SIGNALS)}])"
STEM_SQL = lambda w: "CASE " + " ".join(f"WHEN length({w}) > {len(s) + 3} AND ends_with({w}, '{s}') THEN left({w}, length({w}) - {len(s)})" for s in fixed.SUFFIXES) + f" ELSE {w} END"
EXPAND_SQL = f"array_to_string(list_transform({WORDS}, lambda w: CASE " + " ".join(f"WHEN w = '{k}' THEN '{k} {v}'" for k, v in fixed.ABBREVIATIONS.items()) + " ELSE w END), ' ')"
STOP_SQL = f"coalesce(nullif(array_to_string(list_filter({WORDS}, lambda w: NOT list_contains([{list_sql(fixed.STOPWORDS)}], w)), ' '), ''), q)"
# How a question compares two things.
COMPARE = ("([^ ].*?) +m[iıuü] +(.+?) +m[iıuü](?: |$|[?])", "([^ ].*?) +(?:ile|ve) +(.+?) +(?:arasındaki? +fark|karşılaştır|kıyasla)", "([^ ].*?) +(?:vs[.]?|versus) +(.+)")


def questions(t):
    return t.documents.filter(F.length("title").between(1, 2000)).select("doc_id", fold("title").alias("q"), "title")


def words(q="q"):
    return F.filter(F.split(q, " "), lambda w: w != "")


def stem(w):
    out = w
    for s in reversed(fixed.SUFFIXES):
        out = F.when((F.length(w) > len(s) + 3) & F.endswith(w, F.lit(s)), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(out)
    return out


def expanded(q="q"):
    table = F.create_map(*[F.lit(x) for k, v in fixed.ABBREVIATIONS.items() for x in (k, f"{k} {v}")])
    return F.array_join(F.transform(words(q), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def compared(q="q") -> Column:
    """struct<a, b> of the two things that a question compares, or null."""
    pairs = [F.struct(F.regexp_extract(q, p, 1).alias("a"), F.regexp_extract(q, p, 2).alias("b")) for p in COMPARE]
    return F.coalesce(*[F.when((F.length(x["a"]) > 2) & (F.length(x["b"]) > 2), x) for x in pairs])


def without_stopwords(q="q"):
    kept = F.array_join(F.filter(words(q), lambda w: ~F.array_contains(strings(fixed.STOPWORDS), w)), " ")
    return F.coalesce(F.nullif(kept, F.lit("")), F.col(q))


@query(f"SELECT doc_id, CASE WHEN {OUT_SQL} THEN CASE WHEN {SIGNAL_SQL} THEN 'IN_SCOPE' ELSE 'OUT_OF_SCOPE' END WHEN {SIGNAL_SQL} THEN 'IN_SCOPE' ELSE 'NEEDS_CHECK' END AS intent FROM {Q}")
def intent_gate(t):
    out = F.lit(False)
    for first, then, unless in fixed.OUT_OF_SCOPE:
        rest = F.regexp_replace("q", up_to_last(unless), "x") if unless else F.col("q")
        out = out | F.regexp_like(rest, F.lit(begins(first, then)))
    signal = F.arrays_overlap(words(), strings(fixed.SIGNALS))
    return questions(t).select("doc_id", F.when(signal, "IN_SCOPE").when(out, "OUT_OF_SCOPE").otherwise("NEEDS_CHECK").alias("intent"))


#: Least sequence similarity of a word, and of its stem, to the term that corrects it.
CLOSE, STEM_CLOSE = 0.6, 0.65


def best_term(word: str, terms: tuple[str, ...] = fixed.DOMAIN_TERMS) -> str:
    """The domain term closest to the word or, if none is close enough, to its stem; else the word. Short words and terms stay."""
    if len(word) < 4 or word in terms:
        return word
    root = next((word[: -len(s)] for s in fixed.SUFFIXES if len(word) > len(s) + 3 and word.endswith(s)), word)
    near = difflib.get_close_matches(word, terms, 1, CLOSE) or difflib.get_close_matches(root, terms, 1, STEM_CLOSE)
    return near[0] if near else word


def corrections(words: DataFrame) -> DataFrame:
    """word, corrected for the different words that a domain term corrects: each is compared once, however often it is used."""

    @F.arrow_udf(T.StringType())
    def correct(ws: pa.Array) -> pa.Array:
        return pa.array([best_term(w) for w in ws.to_pylist()], pa.string())

    return words.select("word").distinct().select("word", correct("word").alias("corrected")).filter("word <> corrected")


@query()
def typo_correct(t):
    return corrections(questions(t).select(F.explode(words()).alias("word")))


FOLDED_TERMS = tuple(sorted({x.translate(str.maketrans("çğıöşüâîû", "cgiosuaiu")) for x in fixed.DOMAIN_TERMS}))


@query(f"""WITH w AS (SELECT DISTINCT translate(w, 'çğıöşüâîû', 'cgiosuaiu') AS word FROM (SELECT unnest({WORDS}) AS w FROM {Q})), d AS (SELECT unnest([{list_sql(FOLDED_TERMS)}]) AS term)
  SELECT word, min_by(term, (levenshtein(word, term), term)) AS nearest, CAST(min(levenshtein(word, term)) AS INTEGER) AS distance FROM w, d WHERE regexp_matches(word, '^[a-z0-9]{{4,}}$') GROUP BY word""")
def levenshtein_nearest(t):
    w = questions(t).select(F.explode(words()).alias("w")).select(ascii_fold(F.col("w")).alias("word")).filter(F.col("word").rlike("^[a-z0-9]{4,}$")).distinct()
    scored = F.transform(strings(FOLDED_TERMS), lambda x: F.struct(F.levenshtein("word", x).alias("d"), x.alias("term")))
    return w.select("word", F.array_min(scored).alias("m")).select("word", F.col("m.term").alias("nearest"), F.col("m.d").alias("distance"))


@query(f"SELECT word, {STEM_SQL('word')} AS stem FROM (SELECT DISTINCT unnest({WORDS}) AS word FROM {Q})")
def suffix_stem(t):
    return questions(t).select(F.explode(words()).alias("word")).distinct().select("word", stem(F.col("word")).alias("stem"))


@query(f"SELECT doc_id, {EXPAND_SQL} AS expanded FROM {Q}")
def abbrev_expand(t):
    return questions(t).select("doc_id", expanded().alias("expanded"))


@query(f"""WITH c AS (SELECT doc_id, {", ".join(f"regexp_extract(q, '{p}', 1) AS a{i}, regexp_extract(q, '{p}', 2) AS b{i}" for i, p in enumerate(COMPARE))} FROM {Q}),
  r AS (SELECT doc_id, CASE WHEN length(a0) > 2 AND length(b0) > 2 THEN a0 WHEN length(a1) > 2 AND length(b1) > 2 THEN a1 WHEN length(a2) > 2 AND length(b2) > 2 THEN a2 END AS first, CASE WHEN length(a0) > 2 AND length(b0) > 2 THEN b0 WHEN length(a1) > 2 AND length(b1) > 2 THEN b1 WHEN length(a2) > 2 AND length(b2) > 2 THEN b2 END AS second FROM c)
  SELECT doc_id, first IS NOT NULL AS is_comparison, first, second, CASE WHEN first IS NOT NULL THEN 3 ELSE 0 END AS boost FROM r""")
def comparison_detect(t):
    c = questions(t).select("doc_id", compared().alias("hit"))
    return c.select("doc_id", F.col("hit").isNotNull().alias("is_comparison"), F.col("hit.a").alias("first"), F.col("hit.b").alias("second"), F.when(F.col("hit").isNotNull(), 3).otherwise(0).alias("boost"))


@query(f"SELECT doc_id, {case_sql('q', TOPICS)} AS unit FROM {Q}")
def topic_route(t):
    return questions(t).select("doc_id", first_rule(F.col("q"), TOPICS).alias("unit"))


@query(f"SELECT doc_id, {STOP_SQL} AS keywords FROM {Q}")
def stopword_strip(t):
    return questions(t).select("doc_id", without_stopwords().alias("keywords"))


COMPARED_SQL = "WITH c AS (SELECT doc_id, " + ", ".join(f"regexp_extract(q, '{p}', 1) AS a{i}, regexp_extract(q, '{p}', 2) AS b{i}" for i, p in enumerate(COMPARE)) + f" FROM {Q}), r AS (SELECT doc_id, " + ", ".join("CASE " + " ".join(f"WHEN length(a{i}) > 2 AND length(b{i}) > 2 THEN {side}{i}" for i in range(3)) + f" END AS {name}" for side, name in (("a", "first"), ("b", "second"))) + " FROM c)"


def preprocessed(asked: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """doc_id, keyword_query, vector_query, unit, is_comparison of questions (doc_id, q), in one pass.

    corrected: word, corrected; spelling is mended before abbreviations are expanded. Comparison and topic are read from the
    question as asked; the topic's unit is added to the keywords, the compared things to the vector query.
    """
    if corrected is None:
        mended = asked.withColumn("fixed", F.col("q"))
    else:
        each = asked.select("doc_id", "q", F.posexplode_outer(words()).alias("pos", "word"))
        each = guarded_join(each, corrected, ["word"], "left")
        mended = each.groupBy("doc_id", "q").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("corrected", "word").alias("word")))).alias("ws"))  # words of one question
        mended = mended.select("doc_id", "q", F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("fixed"))
    read = mended.select("doc_id", "fixed", expanded("fixed").alias("keywords"), first_rule(F.col("q"), TOPICS).alias("unit"), compared().alias("hit"))
    return read.select("doc_id", F.concat_ws(" ", "keywords", "unit").alias("keyword_query"), F.concat_ws(" ", "fixed", "hit.a", "hit.b").alias("vector_query"), "unit", F.col("hit").isNotNull().alias("is_comparison"))


@query(f"{COMPARED_SQL} SELECT doc_id, CASE WHEN unit IS NULL THEN keywords ELSE keywords || ' ' || unit END AS keyword_query, CASE WHEN first IS NULL THEN q ELSE q || ' ' || first || ' ' || second END AS vector_query, unit, first IS NOT NULL AS is_comparison FROM (SELECT doc_id, q, {EXPAND_SQL} AS keywords, {case_sql('q', TOPICS)} AS unit FROM {Q}) JOIN r USING (doc_id)")
def query_preprocess(t):
    """Every question with its spelling as it is."""
    return preprocessed(questions(t))


@query()
def query_preprocess_mended(t):
    """Every question, its spelling mended first."""
    asked = questions(t)
    return preprocessed(asked, corrections(asked.select(F.explode(words()).alias("word"))))


@query(f"SELECT word, word AS raw, {STEM_SQL('word')} AS stem, list_contains([{list_sql(fixed.STOPWORDS)}], word) AS is_stopword FROM (SELECT DISTINCT unnest({WORDS}) AS word FROM {Q})")
def token_variants(t):
    w = questions(t).select(F.explode(words()).alias("word")).distinct()
    return w.select("word", F.col("word").alias("raw"), stem(F.col("word")).alias("stem"), F.array_contains(strings(fixed.STOPWORDS), F.col("word")).alias("is_stopword"))


FILES = f"(SELECT doc_id, {fold_sql('title')} AS q, doc_kind, category FROM documents WHERE length(title) BETWEEN 1 AND 2000)"


def files(t):
    """Titles stand for file names, the documents' kind and category for the defaults of their folder."""
    return t.documents.filter(F.length("title").between(1, 2000)).select("doc_id", fold("title").alias("q"), "doc_kind", "category")


@query(f"SELECT doc_id, CASE WHEN doc_kind IN ({list_sql(fixed.FOLDER_KINDS)}) THEN doc_kind ELSE {case_sql('q', fixed.FILE_KINDS, 'doc_kind')} END AS file_kind FROM {FILES}")
def filename_kind(t):
    return files(t).select("doc_id", F.when(F.col("doc_kind").isin(*fixed.FOLDER_KINDS), F.col("doc_kind")).otherwise(first_rule(F.col("q"), fixed.FILE_KINDS, F.col("doc_kind"))).alias("file_kind"))


@query(f"SELECT doc_id, {case_sql('q', fixed.FILE_DEPARTMENTS)} AS department FROM {FILES}")
def filename_department(t):
    return files(t).select("doc_id", first_rule(F.col("q"), fixed.FILE_DEPARTMENTS).alias("department"))


CONTACT_SQL = "CASE " + " ".join("WHEN " + " OR ".join(([f"regexp_matches(q, '{p}')"] if p else []) + ([f"category = '{c}'"] if c else [])) + f" THEN '{unit}'" for p, c, unit in fixed.FILE_CONTACTS) + " END"


@query(f"SELECT doc_id, {CONTACT_SQL} AS contact_unit FROM {FILES}")
def filename_contact(t):
    rules = [(F.regexp_like("q", F.lit(p)) if p else F.lit(False)) | (F.coalesce(F.col("category") == c, F.lit(False)) if c else F.lit(False)) for p, c, _ in fixed.FILE_CONTACTS]
    return files(t).select("doc_id", F.coalesce(*[F.when(rule, unit) for rule, (_, _, unit) in zip(rules, fixed.FILE_CONTACTS)]).alias("contact_unit"))


@query(f"SELECT doc_id, {case_sql('q', fixed.FILE_CATEGORIES, 'category')} AS file_category FROM {FILES}")
def keyword_category(t):
    return files(t).select("doc_id", first_rule(F.col("q"), fixed.FILE_CATEGORIES, F.col("category")).alias("file_category"))


KIND_RULES = (("telefon|e-posta|santral", "iletisim"), ("değerli|hoş geldiniz|sevgili", "tanitim"))


@query(f"SELECT slug_page_id, coalesce(CASE WHEN slug LIKE '%iletisim%' THEN 'iletisim' END, {case_sql(fold_sql('content_preview'), KIND_RULES, chr(39) + 'yonetim' + chr(39))}) AS kind FROM static_slugs_output")
def content_kind_fallback(t):
    return t.static_slugs_output.select("slug_page_id", F.coalesce(F.when(F.col("slug").like("%iletisim%"), "iletisim"), first_rule(fold("content_preview"), KIND_RULES, F.lit("yonetim"))).alias("kind"))


YEARS = r"(20[0-9]{2}) *[-–—/] *(20[0-9]{2})"


@query(f"""WITH y AS (SELECT doc_id, regexp_extract(text, '{YEARS}', 1) AS a, regexp_extract(text, '{YEARS}', 2) AS b FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CASE WHEN a <> '' AND CAST(nullif(b, '') AS INTEGER) - CAST(nullif(a, '') AS INTEGER) = 1 THEN a || '-' || b END AS academic_year FROM y""")
def academic_year(t):
    a, b = F.regexp_extract("text", YEARS, 1), F.regexp_extract("text", YEARS, 2)
    ok = F.nullif(b, F.lit("")).cast("int") - F.nullif(a, F.lit("")).cast("int") == 1
    return t.documents.filter("text is not null").select("doc_id", F.when(ok, F.concat(a, F.lit("-"), b)).alias("academic_year"))


NAME_SQL = r"regexp_extract(regexp_replace(source_url, '[?#].*$', ''), '([^/\\]*)$', 1)"


def context_sql(parts: str) -> str:
    """CTEs f, s, e, k: k has doc_id and the academic year of the parts (doc_id, src, c), the first part and place first."""
    y = metadata.YEARS
    return f"""f AS ({parts}), s AS (SELECT doc_id, src, c, regexp_extract_all(c, '{y}') AS m, regexp_split_to_array(c, '{y}') AS p FROM f WHERE regexp_matches(c, '{y}')),
  e AS (SELECT doc_id, src, c, i, m[i] AS hit, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM s)),
  k AS (SELECT doc_id, min_by(regexp_extract(hit, '{y}', 1) || '-' || regexp_extract(hit, '{y}', 2), src * 1000000 + i) AS academic_year FROM e
    WHERE CAST(regexp_extract(hit, '{y}', 2) AS INTEGER) - CAST(regexp_extract(hit, '{y}', 1) AS INTEGER) = 1
      AND regexp_matches({fold_sql(f"substring(c, CAST(greatest(start - {metadata.AROUND}, 0) + 1 AS BIGINT), CAST(least(start, {metadata.AROUND}) + length(hit) + {metadata.AROUND} AS BIGINT))")}, '{"|".join(fixed.ACADEMIC_CONTEXT)}') GROUP BY doc_id)"""


@query(f"WITH {context_sql('SELECT doc_id, 1 AS src, text AS c FROM documents WHERE text IS NOT NULL')} SELECT doc_id, academic_year FROM k")
def academic_year_ctx(t):
    return t.documents.select("doc_id", metadata.academic_year(F.col("text")).alias("academic_year")).filter("academic_year is not null")


SINGLE_SQL = lambda c: f"CASE WHEN len(list_distinct(regexp_extract_all(regexp_replace({c}, '{metadata.YEARS}', ' ', 'g'), '\\b20[0-9]{{2}}\\b'))) = 1 THEN regexp_extract(regexp_replace({c}, '{metadata.YEARS}', ' ', 'g'), '\\b(20[0-9]{{2}})\\b', 1) END"


@query(f"""WITH {context_sql(f"SELECT doc_id, 1 AS src, title AS c FROM documents UNION ALL SELECT doc_id, 2, {NAME_SQL} FROM documents UNION ALL SELECT doc_id, 3, text FROM documents")}
  SELECT d.doc_id, k.academic_year, CASE WHEN k.academic_year IS NULL AND (coalesce(d.doc_kind IN ({list_sql(fixed.REPORT_KINDS)}), false) OR regexp_matches({fold_sql(f"concat_ws(' ', title, {NAME_SQL})")}, '{"|".join(fixed.REPORT_WORDS)}'))
    THEN coalesce({SINGLE_SQL('title')}, {SINGLE_SQL(NAME_SQL)}) END AS document_year FROM documents d LEFT JOIN k USING (doc_id)""")
def document_year(t):
    """Academic and document year from title, file name and whole text."""
    academic, year = metadata.document_years(F.col("title"), F.col("source_url"), F.col("doc_kind"), F.col("text"))
    return t.documents.select("doc_id", academic.alias("academic_year"), year.alias("document_year"))


@query(f"SELECT doc_id, trim(regexp_replace(translate(regexp_replace({fold_sql('title')}, '[.]pdf$', ''), 'çğıöşüâîû', 'cgiosuaiu'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents WHERE title IS NOT NULL")
def norm_key(t):
    return t.documents.filter("title is not null").select("doc_id", F.trim(F.regexp_replace(ascii_fold(F.regexp_replace("title", "(?i)[.]pdf$", "")), "[^a-z0-9]+", " ")).alias("key"))
