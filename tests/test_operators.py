"""Operators that SQL doesn't express, against hand-made cases and plain Python."""

import json

from pyspark.sql import functions as F

from derlemspark.operators import answers, chunking, crawl, html, joins, retrieval
from derlemspark.sources import readers, state
from derlemspark.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def plain_paragraphs(text, limit=1200):
    import re

    current, out = "", []
    for part in [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]:
        if current and len(current) + len(part) + 2 > limit:
            out.append(current)
            last = re.split(r"(?<=[.!?])\s+", current)[-1]
            current = f"{last}\n\n{part}" if 11 <= len(last) <= 200 else part
        else:
            current = f"{current}\n\n{part}" if current else part
    return out + ([current] if current else [])


def test_paragraph_packing(spark):
    text = "\n\n".join(f"Paragraf {i} başlar. " + "söz " * 60 + f"Son cümle {i} burada biter." for i in range(14))
    assert one(spark, text, chunking.paragraphs) == plain_paragraphs(text)
    assert one(spark, "kısa", chunking.paragraphs) == ["kısa"]
    assert one(spark, None, chunking.paragraphs) is None


def test_heading_context_appends_deeper_levels(spark):
    text = "# A\ngiriş\n## B\nmetin\n### C\nbir\n### D\niki"
    got = [(r["text"].split("\n")[0], r["context"]) for r in one(spark, text, chunking.heading_context)]
    assert got == [("# A", "A"), ("## B", "B"), ("### C", "B > C"), ("### D", "B > C > D")]
    assert [r["context"] for r in one(spark, "kısa giriş\n# A\nx", chunking.heading_context)] == ["A"]


def test_merge_short(spark):
    df = spark.createDataFrame([(["a", "b" * 50, "c"],), (["x"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(chunking.merge_short(F.col("c"))).collect()] == [["a\n" + "b" * 50 + "\nc"], ["x"], []]


def test_word_windows_reach_the_end_once(spark):
    words = [f"w{i}" for i in range(401)]
    got = one(spark, " ".join(words), chunking.word_windows)
    assert [g.split(" ")[0] for g in got] == ["w0", "w160", "w320"] and got[-1].endswith("w400")


def test_greedy_dedup_dropped_rows_claim_nothing(spark):
    rows = [[(1, "u1", "h1", "A"), (2, "u1", "h2", "B"), (3, "u2", "h2", "C"), (4, None, "h9", "C"), (5, None, "h8", "Z")]]
    df = spark.createDataFrame([(r,) for r in rows], "s array<struct<id:bigint,url:string,hash:string,title:string>>")
    assert df.select(answers.greedy_dedup(F.col("s"))).first()[0] == [1, 3, 5]


def test_validated_answer():
    check = lambda a, s: answers.validated(a, s, ("blocked.example",))
    assert check("bak https://blocked.example/x son", ["https://blocked.example/x"]) == "bak  son"
    assert check("bak http://ok.example/a/", ["https://ok.example/a"]) == "bak http://ok.example/a/"
    assert check("bak https://no.example/a", ["boş"]) == f"bak {answers.PLACEHOLDER_URL}"
    assert check("tel 0 (312) 555 44 33", ["0 312 5554433"]) == "tel 0 (312) 555 44 33"
    assert check("tel 0 (312) 555 44 99", ["0 312 5554433"]) == "tel "
    assert check("yaz a@ok.example", ["a@ok.example"]) == "yaz a@ok.example" and check("C:\\x\\y.txt", []) == ""
    assert check(None, []) is None


def test_main_text_prefers_regions():
    page = '<body><nav>menü</nav><div class="body-detail x"><p>asıl</p><script>a</script></div><footer>alt</footer></body>'
    assert html.main_text(page, ("div.body-detail", "body"), html.DROPPED) == "asıl"
    assert html.main_text("<p>yalnız</p>", ("div.none",), html.DROPPED) == "yalnız"
    assert html.main_text(None, (), ()) is None and html.menu_items(None) is None


def test_guarded_join_is_the_same_beyond_the_bound(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        wide, narrow = joins.guarded_join(big, small, ["k"], how), joins.guarded_join(big, small, ["k"], how, max_rows=1)
        assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, narrow.collect()), key=str)


def test_hot_join_meets_every_pair_once(spark):
    rows = [(k, i) for k, n in ((1, 70), (2, 3), (3, 25), (None, 4)) for i in range(n)]
    left = spark.createDataFrame(rows, "k int, a int")
    right = spark.createDataFrame([(k, i + 1000) for k, i in rows if k != 3] + [(3, 1)] * 2, "k int, b int")
    plain = sorted(map(tuple, left.join(right, ["k"]).collect()))
    for hot in (1, 7, 30, 10**6):
        assert sorted(map(tuple, joins.hot_join(left, right, ["k"], hot_rows=hot).collect())) == plain
    empty = joins.hot_join(left.limit(0), right, ["k"], hot_rows=7)
    assert empty.columns == ["k", "a", "b"] and empty.count() == 0


def test_measured_counts_rows_and_bytes(spark):
    side = spark.createDataFrame([(1, "abc", [1, 2]), (2, None, None)], "k int, s string, a array<bigint>")
    assert joins.measured(side)[1:] == (2, (16 + 19 + 32) + (16 + 16 + 16))
    assert joins.measured(side.limit(0))[1:] == (0, 0)


def test_upserts_changes_and_versions(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id int, v string")
    assert sorted(map(tuple, state.upsert_skip(old, batch, "id", "v").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, state.upsert_overwrite(old, batch, "id", "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in state.changed_rows(old, batch.filter("v <> 'e'"), "id", ["v"]).collect()] == [(2, "c")]
    path = str(tmp_path / "t")
    assert state.write_upsert(old, path, "id", "v") == 2 and state.write_upsert(batch, path, "id", "v") == 1
    assert state.write_upsert(batch, path, "id", "v", dry_run=True) == 0
    assert sorted(map(tuple, spark.read.parquet(f"{path}/v=2").collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_file_stream_upserts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string").write.parquet(source)
    stream = ingest.file_stream(spark, source, "id int, v string")
    ingest.upsert_stream(stream, target, "id", "v", str(tmp_path / "c")).awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(f"{target}/v=1").collect()] == [(1, "a")]


def test_readers(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"content": "metin", "meta": {"title": "T"}}, {"content": " "}, {"x": 1}]))
    assert [r["content"] for r in readers.json_documents(spark, str(tmp_path / "d.json")).collect()] == ["metin"]
    (tmp_path / "c.json").write_text(json.dumps({"meta": {"task": "t", "category": "k"}, "page_results": [{"url": "u", "body_content": "b"}]}))
    assert [(r["url"], r["category"]) for r in readers.crawl_outputs(spark, str(tmp_path / "c.json")).collect()] == [("u", "k")]
    (tmp_path / "m.json").write_text(json.dumps({"pdf_links": [{"url": "a.pdf"}]}))
    assert readers.manifests(spark, [str(tmp_path / "m.json"), str(tmp_path / "none.json")]).first()["resolved_url"] == "a.pdf"
    (tmp_path / "s_summary.json").write_text(json.dumps({"task": "x", "birimler": [{"total_documents": 2, "total_chars": 5}, {"total_documents": 3}]}))
    assert readers.run_summaries(spark, str(tmp_path / "s_summary.json")).first()["documents"] == 5
    folder = tmp_path / "pdf" / "formlar"
    folder.mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"bir|iki")
    (folder / "b.pdf").write_bytes(b"!")
    got = readers.pdf_folder(spark, str(tmp_path / "pdf"), lambda b: [p.decode() for p in b.split(b"|")] if b != b"!" else 1 / 0).orderBy("path").collect()
    assert got[0]["content"] == "bir\n\niki" and got[0]["folder"] == "formlar" and got[1]["error"].startswith("ZeroDivisionError")
    raw = spark.createDataFrame([(bytearray("ğüş".encode()),), (bytearray("ğüş".encode("windows-1254")),), (None,)], "b binary")
    assert [r[0] for r in raw.select(readers.decoded(F.col("b"))).collect()] == ["ğüş", "ğüş", None]


def test_frontier(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    assert sorted(map(tuple, crawl.frontier(links, spark.createDataFrame([(1,)], "node int")).collect())) == [(1, 0), (2, 1), (3, 2)]


def test_top_cosine_ties_and_nulls(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in retrieval.top_cosine(v, v.filter("vec_id = 1"), 2).orderBy("rank").collect()] == [(1, 1), (1, 2)]
    assert retrieval.top_cosine(v.limit(0), v.limit(0), 2).count() == 0


def test_source_lists_cover_every_page(spark, tmp_path):
    from derlemspark.plans import registry

    rows = [(i, 1 if i < 27 else 2, f"u{i % 14}", f"t{i}", f"b{i}") for i in range(31)]
    spark.createDataFrame(rows, "page_id bigint, birim_id int, url string, title string, body_content string").write.parquet(str(tmp_path / "page_results.parquet"))
    got = {(r["birim_id"], r["list_no"]): r["kept"] for r in registry.queries()["greedy_source_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): list(range(10)), (1, 1): list(range(10, 20)), (1, 2): list(range(20, 27)), (2, 0): [27, 28, 29, 30]}


def test_crawl_goes_on_until_the_frontier_is_empty(spark, tmp_path):
    from derlemspark.plans import registry

    spark.createDataFrame([(i, f"https://x.example/?id={i + 1}") for i in range(1, 16)], "birim_id int, url string").coalesce(1).write.parquet(str(tmp_path / "page_results.parquet"))
    assert sorted(map(tuple, registry.queries()["crawl_frontier"](spark, str(tmp_path)).collect())) == [(i + 1, i) for i in range(16)]


def test_spelling_aims_at_domain_terms():
    import difflib

    from derlemspark.functions import fixed
    from derlemspark.plans import questions

    assert questions.best_term("kütüphanee") == "kütüphane" and questions.best_term("mühendislgi") in ("mühendisliği", "mühendislik")
    assert questions.best_term("yurt") == "yurt" and questions.best_term("ne") == "ne" and questions.best_term("zzzzqqq") == "zzzzqqq"
    for word in ("fakulte", "transkrip", "erasmuss", "laboratuar", "kontenjanlar", "bahar"):
        near = [x for x in fixed.DOMAIN_TERMS if difflib.SequenceMatcher(None, x, word).ratio() >= questions.CLOSE]
        assert (questions.best_term(word) in near) if near else True


def test_questions_are_mended_and_routed_as_asked(spark):
    from derlemspark.plans import questions

    asked = spark.createDataFrame([(1, "mdbf transkrip nasıl alınır"), (2, "tıp mı diş mi"), (3, "bursa yolu"), (4, "gelecek program"), (5, "")], "doc_id bigint, q string")
    corrected = spark.createDataFrame([("transkrip", "transkript")], "word string, corrected string")
    got = {r["doc_id"]: r for r in questions.preprocessed(asked, corrected).collect()}
    assert got[1]["keyword_query"] == "mdbf mühendislik ve doğa bilimleri fakültesi transkript nasıl alınır" and got[1]["unit"] is None
    assert got[2]["is_comparison"] is True or len("diş") <= 2
    assert got[3]["unit"] == "sağlık kültür ve spor daire başkanlığı" and got[3]["keyword_query"].endswith("başkanlığı")
    assert got[4]["unit"] is None and got[5]["keyword_query"] == ""


def test_intent_rules_look_at_beginnings_of_words(spark):
    from pyspark.sql import functions as F

    from derlemspark.functions import fixed
    from derlemspark.functions.text import begins, up_to_last

    def hit(q):
        for first, then, unless in fixed.OUT_OF_SCOPE:
            rest = F.regexp_replace(F.lit(q), up_to_last(unless), "x") if unless else F.lit(q)
            if one(spark, q, lambda c: F.regexp_like(rest, F.lit(begins(first, then)))):
                return True
        return False

    assert hit("bana python kodu yaz") and hit("rust ile program yaz") and hit("türev nasıl alınır") and hit("şiir yaz") and hit("harç öde ve türev hesapla")
    assert not hit("alpython kodu") and not hit("hesapla harç ücretini") and not hit("öğrenci işleri nerede")


def test_dispatch_goes_to_headings(spark):
    text = "Bu giriş paragrafı kırk karakterden uzundur, evet uzundur.\n\n# Bir\n" + "söz " * 20 + "\n## İki\n" + ("Bir tümce burada biter. " * 20 + "\n\n") * 6
    rows = one(spark, text, lambda c: chunking.heading_context(c))
    assert [r["context"] for r in rows][:3] == ["Giriş", "Bir", "İki"] and {r["context"] for r in rows[2:]} == {"İki"} and len(rows) > 3
    assert max(len(r["text"]) for r in rows) <= chunking.LONG
    assert [r["text"] for r in rows] == one(spark, text, chunking.semantic)
    plain = "Bir paragraf.\n\nBaşka bir paragraf.\n# tek başlık"
    assert one(spark, plain, chunking.semantic) == one(spark, plain, chunking.paragraphs)


def test_top_cosine_is_the_same_in_any_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 8)), 2)
    x[40:45] = x[3]  # ties
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None)], "vec_id bigint, embedding array<float>")
    asked = df.filter("vec_id % 10 = 3")
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    wanted = {(q, v, r + 1) for q in range(3, 90, 10) for r, v in enumerate(sorted(range(90), key=lambda v: (-round(float(np.float32(unit[q]) @ np.float32(unit[v])), 4), v))[:3])}
    whole = {(r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.top_cosine(df, asked, 7).collect()}
    assert whole == {(r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.top_cosine(df, asked, 7, block=4).collect()}
    assert len({w[:2] for w in wanted} & {w[:2] for w in whole}) >= 0.9 * len(wanted)
    assert retrieval.top_cosine(df.limit(0), asked.limit(0), 3).count() == 0


def test_index_finds_nine_tenths(spark):
    from derlemspark.plans import registry

    for sf in ("sf0.001", "sf0.01"):
        assert registry.queries()["ann_recall"](spark, f"/root/testdata/{sf}").first()["recall"] >= 0.9


def test_bm25_on_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "söz söz var"), (4, "başka söz")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(9, "söz"), (9, "yok")], "query_id bigint, term string")
    got = retrieval.top_bm25(docs, "doc_id", "text", asked, 5).collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(9, 3, 1), (9, 4, 2)]
    assert retrieval.top_bm25(docs.limit(0), "doc_id", "text", asked, 5).count() == 0


def test_keyword_index_is_packed_and_its_tiles_give_the_best(spark, monkeypatch):
    """Every posting takes a few bytes, no pair of query and document is written, and pruning loses nothing, ties by id included."""
    import math
    import random

    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("abcdefghijklmnop") * rng.choice((1, 1, 2)) for _ in range(rng.randint(0, 40))) for i in range(1500)}
    asked = {q: rng.sample(["a", "b", "cc", "dd", "e", "ff", "yok"], rng.randint(1, 5)) for q in range(40)}
    docs = spark.createDataFrame([(i, x) for i, x in texts.items()], "doc_id bigint, text string").repartition(3)
    terms = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "query_id bigint, term string")
    size = retrieval.shards(docs, "doc_id", "text", terms).selectExpr("sum(n)", "sum(total)", "sum(length(places) + length(tf))").first()
    cut = {i: x.split() for i, x in texts.items()}
    assert size[:2] == (1500, sum(map(len, cut.values()))) and size[2] == 3 * sum(len({"a", "b", "cc", "dd", "e", "ff"} & set(x)) for x in cut.values())
    n, avgdl = 1500, size[1] / 1500
    idf = {w: math.log(1 + (n - df + 0.5) / (df + 0.5)) for w in ("a", "b", "cc", "dd", "e", "ff", "yok") for df in [sum(w in x for x in cut.values())]}
    best, whole = set(), set()
    for q, ws in asked.items():
        score = {i: round(sum(idf[w] * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / avgdl)) for w in ws), 6) for i, x in cut.items() if set(ws) & set(x)}
        best |= {(q, i, s, r) for r, (s, i) in enumerate(sorted((-s, i) for i, s in score.items())[:7], 1) for s in [-s]}
        whole |= {(q, i) for i, x in cut.items() if set(ws) <= set(x)}
    for tile, block in ((1 << 17, 1 << 16), (100, 9)):
        monkeypatch.setattr(retrieval, "TILE_DOCS", tile)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        assert {tuple(r) for r in retrieval.top_bm25(docs, "doc_id", "text", terms, 7).collect()} == best
        assert {tuple(r) for r in retrieval.all_terms(docs, "doc_id", "text", terms).collect()} == whole


def test_years_of_titles_names_and_texts(spark):
    from derlemspark.operators import metadata

    def years(title, kind, text="", path=None):
        df = spark.createDataFrame([(title, path, kind, text)], "title string, path string, kind string, text string")
        academic, year = metadata.document_years(F.col("title"), F.col("path"), F.col("kind"), F.col("text"))
        return tuple(df.select(academic, year).first())

    assert years("Stratejik Plan 2022 - 2026", "rapor") == (None, None)
    assert years("Stratejik Plan 2022 2026", "rapor") == (None, None)
    assert years("2024 Yılı Faaliyet Raporu", "rapor") == (None, "2024")
    assert years("2025 / 2026 Eğitim Öğretim Yılı Takvimi", "takvim") == ("2025-2026", None)
    assert years("Duyuru", "duyuru", "x" * 5000 + " 2023–2024 güz dönemi ve 2024-2025 bahar") == ("2023-2024", None)
    assert years("Duyuru", "duyuru", "2023-2024 " + "x" * 90 + " güz, 2025-2026") == ("2025-2026", None)
    assert years("Rapor", None, None, "C:\\\\d\\\\Faaliyet 2021.pdf") == (None, "2021")
    assert years(None, None, None) == (None, None) and years("", "", "") == (None, None)


def test_local_files_get_public_urls(spark):
    from derlemspark.operators import metadata

    links = spark.createDataFrame([("2024 yili faaliyet raporu", "https://a.example/r.pdf"), ("iki", "https://a.example/1"), ("iki", "https://a.example/2"), ("", "https://a.example/3")], "key string, url string")
    docs = spark.createDataFrame([(1, r"C:\data\2024 Yılı Faaliyet Raporu.pdf", "x"), (2, "/data/iki.pdf", "İki"), (3, "https://b.example/x", "y"), (4, None, "z"), (5, " ", "z"), (6, "/d/q.pdf", "2024 Yılı Faaliyet Raporu")], "id int, path string, title string")
    got = {r["id"]: (r["file_path"], r["public_url"], r["status"]) for r in metadata.with_public_urls(docs, links, "path", "title").collect()}
    assert got[1][1:] == ("https://a.example/r.pdf", "resolved") and got[6][1:] == ("https://a.example/r.pdf", "resolved")
    assert got[2] == ("/data/iki.pdf", None, "unresolved_local_pdf") and got[3] == (None, "https://b.example/x", None)
    assert got[4] == got[5] == (None, None, None)


def test_addresses_are_read_against_their_page(spark):
    from urllib.parse import urljoin

    from derlemspark.operators import urls

    base = "https://a.example/b/c/d?q=1"
    hrefs = ["g", "./g", "g/", "/g", "//h.example/g", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "g/./h", "g/../h", "mailto:x@y.z", "https://c.example/x/../y"]
    df = spark.createDataFrame([(base, h) for h in hrefs] + [("https://a.example", "g"), (base, None)], "base string, href string")
    got = [r["u"] for r in df.select(urls.absolute(F.col("base"), F.col("href")).alias("u")).collect()]
    wanted = [urljoin(base, h) if h != "https://c.example/x/../y" else "https://c.example/y" for h in hrefs]
    assert got == [*wanted, "https://a.example/g", None]
    assert one(spark, "https://a.example/m/web/PdfViewer.aspx?file=../../d/f%20x.pdf", urls.unwrapped) == "https://a.example/d/f x.pdf"
    assert one(spark, "https://a.example/m/web/PdfViewer.aspx?x=1", urls.unwrapped).endswith("?x=1") and one(spark, "https://a.example/x.pdf?file=y", urls.unwrapped).endswith("file=y")
