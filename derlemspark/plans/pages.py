"""Page extraction queries. The tables hold text, so each page is first written as HTML, alike in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, replace_all
from ..operators import html
from .base import Tables, fold_sql, query

MENU = '<nav><ul><li><a href="/">Ana Sayfa</a><ul><li><a href="/iletisim">İletişim</a></li><li><a href="/doc/a.pdf">Belge</a></li></ul></li><li><a href="https://other.example/x">Dış</a></li></ul></nav>'
HTML_SQL = f"""'<html><head><title>Site - ' || coalesce(title, '') || '</title><script>var a = "<p>";</script></head><body>{MENU}<h1>' || coalesce(title, '') || '</h1><div class="body-detail"><p>' || replace(body_content, chr(10), '</p><p>') || '</p><a href="' || url || '">kaynak</a><a href="#top">yukarı</a><a href="/media/f' || (page_id % 50) || '.pdf">rapor</a></div><footer>Alt &amp; bilgi</footer></body></html>'"""
PAGES_SQL = f"WITH p AS (SELECT page_id, url, title, {HTML_SQL} AS html FROM page_results) "
DROP_SQL = "html"
for _tag in html.DROPPED:
    DROP_SQL = f"regexp_replace({DROP_SQL}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
ENTITY_SQL = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
NL = "' || chr(10) || '"
CLEAN_SQL = f"regexp_replace(regexp_replace(regexp_replace({ENTITY_SQL(f'''regexp_replace({DROP_SQL}, '(?s)<[^>]*>', chr(10), 'g')''')}, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
TAG_SQL = lambda tag: "nullif(trim(" + ENTITY_SQL(f"regexp_replace(regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1), '(?s)<[^>]*>', ' ', 'g')") + "), '')"
LINKS_SQL = PAGES_SQL + """, a AS (SELECT page_id, regexp_extract_all(html, '(?is)(<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>)', 1) AS tags FROM p),
  l AS (SELECT page_id, generate_subscripts(tags, 1) - 1 AS pos, unnest(tags) AS tag FROM a),
  links AS (SELECT page_id, pos, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS href, trim(regexp_replace(tag, '(?s)<[^>]*>', ' ', 'g')) AS label FROM l) """
TYPE_SQL = "CASE WHEN lower(href) LIKE '%.pdf' THEN 'pdf' WHEN href LIKE 'http%' THEN 'external' ELSE 'page' END"
BOILERPLATE = (r"(?i)Tüm hakları saklıdır[^\n]*", r"(?i)Güncellenme +tarihi[^\n]*", r"(?i)Son güncelleme:[^\n]*", r"(?i)Görüntülenme:[^\n]*")


def with_html(t: Tables) -> DataFrame:
    title = F.coalesce("title", F.lit(""))
    page = F.concat(
        F.lit("<html><head><title>Site - "), title, F.lit(f'</title><script>var a = "<p>";</script></head><body>{MENU}<h1>'), title, F.lit('</h1><div class="body-detail"><p>'),
        F.replace("body_content", F.lit("\n"), F.lit("</p><p>")), F.lit('</p><a href="'), F.col("url"), F.lit('">kaynak</a><a href="#top">yukarı</a><a href="/media/f'), (F.col("page_id") % 50).cast("string"),
        F.lit('.pdf">rapor</a></div><footer>Alt &amp; bilgi</footer></body></html>'),
    )
    return t.page_results.select("page_id", "url", "title", page.alias("html"))


def links(t: Tables) -> DataFrame:
    return with_html(t).select("page_id", F.explode(html.link_list(F.col("html"))).alias("l")).select("page_id", "l.*")


def link_type(href):
    return F.when(F.lower(href).endswith(".pdf"), "pdf").when(href.startswith("http"), "external").otherwise("page")


@query(PAGES_SQL + f"SELECT page_id, {CLEAN_SQL} AS text FROM p")
def html_clean_text(t):
    return with_html(t).select("page_id", html.clean(F.col("html")).alias("text"))


@query(PAGES_SQL + f"SELECT page_id, coalesce({TAG_SQL('h1')}, {TAG_SQL('title')}, '') AS title FROM p")
def html_title(t):
    h = F.col("html")
    return with_html(t).select("page_id", F.coalesce(html.first_tag(h, "h1"), html.first_tag(h, "title"), F.lit("")).alias("title"))


@query(PAGES_SQL + f""", c AS (SELECT page_id, {TAG_SQL('h1')} AS h1, {TAG_SQL('h2')} AS h2, nullif(trim(regexp_extract({TAG_SQL('title')}, ' - (.*)$', 1)), '') AS tail, nullif(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1), '') AS slug FROM p)
  SELECT page_id, CASE WHEN length(h1) > 2 THEN h1 WHEN length(h2) > 2 THEN h2 WHEN length(tail) > 2 THEN tail ELSE slug END AS title FROM c""")
def title_tiered(t):
    h = F.col("html")
    tail = F.nullif(F.trim(F.regexp_extract(html.first_tag(h, "title"), " - (.*)$", 1)), F.lit(""))
    slug = F.nullif(F.regexp_extract("url", r"([^/?#]+)/?(?:[?#].*)?$", 1), F.lit(""))
    tiers = [html.first_tag(h, "h1"), html.first_tag(h, "h2"), tail]
    return with_html(t).select("page_id", F.coalesce(*[F.when(F.length(x) > 2, x) for x in tiers], slug).alias("title"))


@query()
def main_content(t):
    regions, dropped = ("div.body-detail", "div.card-content", "form#aspnetForm", "body"), (*html.DROPPED, "ul.side-nav", "div.navbar", "div#footer")
    text = html.main_text_column(F.col("html"), regions, dropped)
    return with_html(t).select("page_id", replace_all(text, [(p, "") for p in BOILERPLATE]).alias("text"))


@query("SELECT page_id, " + "regexp_replace(regexp_replace(regexp_replace(regexp_replace(body_content, '(?i)Tüm hakları saklıdır[^\n]*', '', 'g'), '(?i)Güncellenme +tarihi[^\\n]*', '', 'g'), '(?i)Son güncelleme:[^\\n]*', '', 'g'), '(?i)Görüntülenme:[^\\n]*', '', 'g') AS text FROM page_results")
def boilerplate_strip(t):
    return t.page_results.select("page_id", replace_all(F.col("body_content"), [(p, "") for p in BOILERPLATE]).alias("text"))


@query("SELECT page_id, left(array_to_string(list_filter(list_transform(string_split(body_content, chr(10)), lambda x: trim(x)), lambda x: length(x) > 2), chr(10)), 30000) AS text FROM page_results")
def line_filter_cap(t):
    kept = F.filter(F.transform(F.split("body_content", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 2)
    return t.page_results.select("page_id", F.substring(F.array_join(kept, "\n"), 1, 30000).alias("text"))


@query(PAGES_SQL + ", n AS (SELECT page_id, regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1) AS nav FROM p), a AS (SELECT page_id, unnest(regexp_extract_all(nav, 'href=\"([^\"]*)\"', 1)) AS href FROM n) SELECT page_id, href FROM a")
def nav_links(t):
    nav = F.regexp_extract("html", r"(?is)<nav>(.*?)</nav>", 1)
    return with_html(t).select("page_id", F.explode(F.regexp_extract_all(nav, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))


@query()
def menu_tree(t):
    return with_html(t).select("page_id", F.explode(html.menu_column("html")).alias("m")).select("page_id", "m.*")


@query("WITH b AS (SELECT grup, birim_adi, row_number() OVER (PARTITION BY grup ORDER BY birim_adi, birim_id) AS k, count(*) OVER (PARTITION BY grup) AS n FROM birimler) SELECT grup, string_agg(CASE WHEN k = n THEN '└── ' ELSE '├── ' END || birim_adi, chr(10) ORDER BY k) AS menu FROM b GROUP BY grup")
def menu_text(t):
    ordered = F.sort_array(F.collect_list(F.struct("birim_adi", "birim_id")))
    g = t.birimler.groupBy("grup").agg(ordered.alias("m"))  # the unit registry has a fixed size
    return g.select("grup", F.array_join(F.transform("m", lambda x, i: F.concat(F.when(i == F.size("m") - 1, F.lit("└── ")).otherwise(F.lit("├── ")), x["birim_adi"])), "\n").alias("menu"))


@query(LINKS_SQL + f"SELECT {TYPE_SQL} AS kind, count(*) AS n, count(DISTINCT href) AS urls FROM links GROUP BY 1")
def link_type_stats(t):
    return links(t).groupBy(link_type(F.col("href")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("href").alias("urls"))


@query(LINKS_SQL + f"SELECT page_id, href, {TYPE_SQL} AS kind, left(label, 120) AS label FROM (SELECT * FROM links WHERE href <> '' AND href NOT LIKE '#%' AND href NOT LIKE 'javascript:%' AND label <> '' QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)")
def page_links(t):
    ok = links(t).filter("href <> '' and not href like '#%' and not href like 'javascript:%' and label <> ''")
    one = ok.groupBy("page_id", "href").agg(F.min_by("label", "pos").alias("label"))
    return one.select("page_id", "href", link_type(F.col("href")).alias("kind"), F.substring("label", 1, 120).alias("label"))


@query(LINKS_SQL + "SELECT page_id, href, CASE WHEN min_by(label, pos) = '' THEN regexp_extract(href, '([^/]+)$', 1) ELSE min_by(label, pos) END AS label FROM links WHERE lower(href) LIKE '%.pdf' GROUP BY page_id, href")
def pdf_links(t):
    one = links(t).filter(F.lower("href").endswith(".pdf")).groupBy("page_id", "href").agg(F.min_by("label", "pos").alias("label"))
    return one.select("page_id", "href", F.when(F.col("label") == "", F.regexp_extract("href", "([^/]+)$", 1)).otherwise(F.col("label")).alias("label"))


@query(LINKS_SQL + "SELECT 'https://site.example' || href AS resolved, min(page_id) AS first_page FROM links WHERE lower(href) LIKE '%.pdf' AND label NOT IN ('Belge') GROUP BY 1")
def pdf_links_resolved(t):
    pdf = links(t).filter(F.lower("href").endswith(".pdf") & ~F.col("label").isin("Belge"))
    return pdf.groupBy(F.concat(F.lit("https://site.example"), "href").alias("resolved")).agg(F.min("page_id").alias("first_page"))


@query("""WITH r AS (SELECT page_id, string_split(body_content, chr(10)) AS ls FROM page_results), l AS (SELECT page_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM r),
  f AS (SELECT page_id, pos, nullif(regexp_extract(line, '(\\+?[0-9][0-9 ()-]{8,}[0-9])', 1), '') AS number, nullif(regexp_extract(line, '([A-Za-z0-9._+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,})', 1), '') AS email, regexp_matches(lower(line), 'faks|fax') AS is_fax FROM l)
  SELECT page_id, min_by(number, pos) FILTER (WHERE number IS NOT NULL AND NOT is_fax) AS phone, min_by(email, pos) FILTER (WHERE email IS NOT NULL) AS email, min_by(number, pos) FILTER (WHERE number IS NOT NULL AND is_fax) AS fax FROM f GROUP BY page_id""")
def contact_extract(t):
    """First telephone, e-mail and fax of each page; a number on a line that says fax is a fax."""
    lines = t.page_results.select("page_id", F.posexplode(F.split("body_content", "\n")).alias("pos", "line"))
    number = F.nullif(F.regexp_extract("line", r"(\+?[0-9][0-9 ()-]{8,}[0-9])", 1), F.lit(""))
    email = F.nullif(F.regexp_extract("line", r"([A-Za-z0-9._+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,})", 1), F.lit(""))
    f = lines.select("page_id", "pos", number.alias("number"), email.alias("email"), F.regexp_like(F.lower("line"), F.lit("faks|fax")).alias("is_fax"))
    have = lambda c, when=F.lit(True): F.when(F.col(c).isNotNull() & when, F.col("pos"))
    first = {"phone": ("number", ~F.col("is_fax")), "email": ("email", F.lit(True)), "fax": ("number", F.col("is_fax"))}
    return f.groupBy("page_id").agg(*[F.min_by(c, have(c, when)).alias(name) for name, (c, when) in first.items()])


@query("SELECT string_agg(k || '. ' || birim_adi, chr(10) ORDER BY k) AS master FROM (SELECT birim_adi, row_number() OVER (ORDER BY birim_adi, birim_id) AS k FROM birimler)")
def master_list(t):
    rows = t.birimler.agg(F.sort_array(F.collect_list(F.struct("birim_adi", "birim_id"))).alias("m"))  # the unit registry has a fixed size
    return rows.select(F.array_join(F.transform("m", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["birim_adi"])), "\n").alias("master"))


@query("SELECT item_id, 'Soru: ' || question || chr(10) || 'Yanıt: ' || passage AS pair FROM eval_items WHERE length(passage) >= 20")
def qa_pairs(t):
    return t.eval_items.filter(F.length("passage") >= 20).select("item_id", F.concat(F.lit("Soru: "), "question", F.lit("\nYanıt: "), "passage").alias("pair"))


@query(f"SELECT doc_id, regexp_replace(translate({fold_sql('title')}, 'çğıöşüâîû', 'cgiosuaiu'), '[^a-z0-9]+', '_', 'g') || '_pdf' AS source_id FROM documents WHERE title IS NOT NULL")
def slugify_source_id(t):
    return t.documents.filter("title is not null").select("doc_id", F.concat(F.regexp_replace(ascii_fold(F.col("title")), "[^a-z0-9]+", "_"), F.lit("_pdf")).alias("source_id"))


@query("SELECT page_id, length(trim(body_content)) >= 20 AS is_valid, CASE WHEN length(trim(body_content)) < 20 THEN 'short body: ' || length(trim(body_content)) END AS reason, length(body_content) AS char_count FROM page_results")
def deep_parse(t):
    n = F.length(F.trim("body_content"))
    return t.page_results.select("page_id", (n >= 20).alias("is_valid"), F.when(n < 20, F.concat(F.lit("short body: "), n.cast("string"))).alias("reason"), F.length("body_content").alias("char_count"))


@query("SELECT birim_id, count(*) AS pages, min(page_id) AS first_page FROM page_results GROUP BY birim_id QUALIFY row_number() OVER (ORDER BY pages DESC, birim_id) <= 20")
def unit_pages(t):
    g = t.page_results.groupBy("birim_id").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))
    return g.orderBy(F.desc("pages"), "birim_id").limit(20)
