"""Operators against brute force, exact round trips and hand-made cases."""

import os
import random

import numpy as np
import pytest

from derlemspark.llm import addresses, body, bpe_automaton, garbled, leaks, near_copies, pieces, reading, residue, site_lines, words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def machine():
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary file")
    return bpe_automaton.Automaton(*bpe_automaton.read_merges(VOCABULARY))


def test_ids_equal_the_library_and_round_trip(machine):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    rng = random.Random(3)
    signs = "abcdeğüşıöçİ  \n\t.,'!?0123<|>ß日مر🗺️  \x1c\x85"
    texts = ["", "a  b", "\n\n x \t\ty", "<|endoftext|> hi", "don't we'll I'LL", "aaaaaaaaaaaaa", "x" * 200, "   ", "Üniversite öğrencileri için duyuru."]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text in texts:
        ids = machine.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert machine.decode(ids) == text
    assert machine.encode(None) == []


def test_pieces_cover_and_overlap():
    rng = random.Random(5)
    for _ in range(120):
        text = "".join(rng.choice(["söz ", "uzunca ", "son. ", "\n", "\n\nMadde 3 - ", "x" * 40, "\n# Başlık\n"]) for _ in range(rng.randint(0, 900)))
        found = pieces.spans(text)
        assert "".join(text[s:e] for _, s, e in found) == text
        assert all(e - f <= 1200 and s - f <= 200 for f, s, e in found)
        assert len(found) == 1 if len(text) <= 1200 else len(found) > 1
    assert pieces.spans(None) == [] and pieces.spans("") == [(0, 0, 0)]
    assert all(e - f <= 1200 for f, _, e in pieces.spans("x" * 30_000))
    article = "söz " * 150 + "\nMadde 2 - " + "söz " * 160
    assert article[pieces.spans(article)[1][1] :].startswith("Madde 2")


def test_leaks_find_every_exact_run(spark):
    rng = random.Random(7)
    vocabulary = [f"söz{i}" for i in range(300)]
    items = [(i, "Yönerge satırı.\n" + " ".join(rng.choices(vocabulary, k=40))) for i in range(12)]
    docs = []
    for d in range(80):
        text = rng.choices(vocabulary, k=60)
        source = items[d % 12][1].split("\n")[1].split()
        n = rng.choice([0, 6, 7, 8, 9, 20])
        at = rng.randint(0, 40 - n)
        text[20:20] = source[at : at + n]
        docs.append((d, ", ".join(text).upper().replace("S", "ş") if d % 5 == 0 else " ".join(text)))
    docs += [(100, None), (101, "")]
    got = {(r["d"], r["i"]) for r in leaks.overlaps(spark.createDataFrame(docs, "d bigint, t string"), "d", "t", spark.createDataFrame(items, "i int, p string"), "i", "p").filter("exact").collect()}

    def runs(text):
        w = words.folded_words(text)
        return {tuple(w[k : k + 8]) for k in range(len(w) - 7)}

    wanted = {(d, i) for d, t in docs for i, p in items if runs(t) & runs(p.split("\n")[1])}
    assert got == wanted and len(wanted) > 20


def test_chosen_path_finds_all_pairs(spark):
    rng = random.Random(11)
    texts = []
    for family in range(30):
        base = [f"s{rng.randint(0, 4000)}" for _ in range(60)]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(60)] = f"s{rng.randint(0, 4000)}"
            texts.append(("t", len(texts), " ".join(copy)))
    texts += [("t", 900, texts[0][2]), ("u", 901, texts[0][2]), ("t", 902, "az söz"), ("t", 903, None)]
    df = spark.createDataFrame(texts, "tbl string, rec_id bigint, text string")
    sets = {(t, r): set(near_copies.shingles(x).tolist()) for t, r, x in texts if near_copies.shingles(x) is not None}
    wanted = {(a[0], *sorted((a[1], b[1]))) for a in sets for b in sets if a < b and a[0] == b[0] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    for sizes in ({}, {"leaf": 3, "depth": 1, "block": 2}):
        base = near_copies.sketched(df).cache()
        got = {tuple(r) for r in near_copies.pairs(*near_copies.similar_classes(base, **sizes)).collect()}
        assert got <= wanted and len(got) >= 0.97 * len(wanted)
        assert ("t", 0, 900) in got


@pytest.mark.parametrize("sizes", ({}, {"leaf": 128}, {"leaf": 16}))
def test_large_nodes_keep_pairs_at_the_threshold(spark, sizes):
    """Records with a long passage in common meet in large nodes only; pairs just over the threshold outlast their branching."""
    rng = random.Random(17)
    common, texts = [f"o{i}" for i in range(72)], []
    for _ in range(200):
        shared = [f"s{rng.randint(0, 10**6)}" for _ in range(25)]
        texts += [("t", len(texts) + k, " ".join(common + shared + [f"s{rng.randint(0, 10**6)}" for _ in range(42)])) for k in range(2)]
    sets = [set(near_copies.shingles(x).tolist()) for _, _, x in texts]
    wanted = {("t", 2 * i, 2 * i + 1) for i in range(200) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.5 * len(sets[2 * i] | sets[2 * i + 1])}
    base = near_copies.sketched(spark.createDataFrame(texts, "tbl string, rec_id bigint, text string")).cache()
    got = {tuple(r) for r in near_copies.pairs(*near_copies.similar_classes(base, **sizes)).collect()}
    assert len(wanted) == 200 and got == got & wanted and len(got) >= 0.97 * len(wanted)


def test_roots_join_pairs_at_the_threshold():
    """Nine coordinates miss 0.2 % of the pairs at similarity 0.5, six would miss 1.6 %."""
    rng = np.random.default_rng(23)
    missed = 0
    for _ in range(3000):
        x = rng.integers(0, 1 << 32, 120).astype(np.uint32)
        a, b = (near_copies.root_nodes(near_copies.sketch(s)[None, :], 0) for s in (x[:90], x[30:]))
        missed += not (a == b).any()
    assert missed <= 15


def test_hashed_words_and_triples_are_those_of_the_text():
    """Whole batches at once give each text the words it has by itself, whatever stands beside it."""
    rng = random.Random(29)
    pool = ["İstanbul", "ışık", "a_b", "x1", "日本", "é", "\u0307", "ÇAĞ", "...", "\n", "söz", "SÖZ", ""]
    texts = ["", "bir", *(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(60)), "uzun söz " * 4000]
    hashes, owner = near_copies.word_hashes(texts)
    seen: dict[str, int] = {}
    for i, text in enumerate(texts):
        mine = words.lower_words(text)
        assert len(mine) == (owner == i).sum()
        for word, h in zip(mine, hashes[owner == i].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    kept, offsets, triples = near_copies.shingle_sets(texts)
    for i, a, b in zip(kept.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        mine = words.lower_words(texts[i])
        assert len(mine) >= near_copies.MIN_WORDS and b - a == len(set(zip(mine, mine[1:], mine[2:])))
        assert (triples[a:b] == near_copies.shingles(texts[i])).all()
    assert set(kept.tolist()) == {i for i, t in enumerate(texts) if len(words.lower_words(t)) >= near_copies.MIN_WORDS}


def test_sketches_agree_as_their_coordinates_do():
    values = np.random.default_rng(31).integers(0, 3, (40, near_copies.COORDINATES)).astype(np.uint64)
    raw = near_copies.packed(values).view(np.uint64)
    assert raw.shape == (40, len(near_copies.SKETCH))
    starts, sizes = np.array([0, 1, 4, 4, 24]), np.array([1, 3, 0, 20, 16])
    got = set(zip(*(x.tolist() for x in near_copies.close_pairs(raw, starts, sizes, 18))))
    wanted = {(i, j) for s, n in zip(starts, sizes) for i in range(s, s + n) for j in range(i + 1, s + n) if (values[i] == values[j]).sum() >= 18}
    assert got == wanted and wanted


@pytest.mark.parametrize("groups,size,sizes", ((6, 300, {"leaf": 128}), (2, 1000, {})))
def test_large_groups_of_similar_texts_lose_no_link(spark, groups, size, sizes):
    """Groups beyond the size of a leaf, all records of one similar to each other around the threshold; the second case has production parameters."""
    rng = random.Random(37)
    texts, truth = [], {}
    for g in range(groups):
        base, sets = [f"g{g}w{i}" for i in range(110)], []
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(110), rng.choice((4, 6, 8, 10))):
                copy[at] = f"x{rng.randint(0, 10**7)}"
            texts.append(("t", len(texts), " ".join(copy)))
            sets.append(near_copies.shingles(texts[-1][2]))
        number = {x: i for i, x in enumerate(np.unique(np.concatenate(sets)).tolist())}
        has = np.zeros((size, len(number)), dtype=np.float32)
        for i, s in enumerate(sets):
            has[i, [number[x] for x in s.tolist()]] = 1
        common, n = has @ has.T, has.sum(1)
        jaccard = common / (n[:, None] + n[None, :] - common)
        truth |= {(g * size + i, g * size + j): float(jaccard[i, j]) for i, j in zip(*np.triu_indices(size, 1)) if jaccard[i, j] >= 0.5}
    base = near_copies.sketched(spark.createDataFrame(texts, "tbl string, rec_id bigint, text string")).cache()
    found = near_copies.pairs(*near_copies.similar_classes(base, **sizes)).toPandas()
    got = set(zip(found.rec_id_a.tolist(), found.rec_id_b.tolist()))
    for low, high in ((0.5, 0.55), (0.55, 0.6), (0.6, 1.01)):
        wanted = {p for p, s in truth.items() if low <= s < high}
        assert len(wanted) > 1000 and len(wanted & got) >= 0.98 * len(wanted), (low, len(wanted), len(wanted & got))
    assert got <= set(truth)


def test_copies_are_dealt_to_cells(spark):
    """A class of many copies, and links to it, give all pairs whether or not the class is dealt to cells."""
    members = spark.createDataFrame([("t", i, 1) for i in range(50)] + [("t", 100 + i, 2) for i in range(7)] + [("t", 200, 3)], "tbl string, rec_id bigint, copy bigint")
    links = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
    wanted = {(i, j) for i in range(50) for j in range(i + 1, 50)} | {(100 + i, 100 + j) for i in range(7) for j in range(i + 1, 7)} | {(i, 100 + j) for i in range(50) for j in range(7)} | {(i, 200) for i in range(50)}
    for hot in (5, 10**6):
        got = [(r[1], r[2]) for r in near_copies.pairs(members, links, hot_rows=hot).collect()]
        assert len(got) == len(wanted) and set(got) == wanted


def test_repeated_lines_by_hand(spark):
    assert site_lines.normal_line("  a  b 12.03 ") == "a b 0.0"
    rows = [(i, f"https://WWW.Site.example/{i}", f"Menü {i}\nöz {'abcdefgh'[i]}\n\nson") for i in range(8)] + [(8, None, "Menü 9"), (9, "https://site.example/x", None)]
    df = spark.createDataFrame(rows, "id bigint, url string, body string")
    got = {tuple(r) for r in site_lines.repeated_positions(df, "id", "url", "body").collect()}
    assert got == {(i, k) for i in range(8) for k in (0, 3)}
    bodies = {r["id"]: (r["body"], r["removed"]) for r in site_lines.without_repeated(df, "id", "url", "body").collect()}
    assert bodies[0] == ("öz a\n", 2) and bodies[8] == ("Menü 9", 0) and bodies[9] == (None, 0)


def test_mapping_is_learned_from_bigrams():
    vocabulary = {"açık": 50, "kapalı": 40, "öğrenci": 60, "sınav": 80, "başvuru": 70, "yardım": 30, "kayıt": 50, "ışık": 20, "alış": 20}
    clean = [(None, *c, n) for w, n in vocabulary.items() for c in garbled.contexts(w)]
    swap = {w: w.encode().decode("latin-1") for w in vocabulary}
    strange = [("s", *c, n) for w, n in vocabulary.items() for c in garbled.contexts(swap[w])]
    mapping = garbled.learn(clean, strange)
    assert all(garbled.fitting(mapping, "s", swap[w], w) > -np.inf for w in vocabulary if swap[w] != w)
    assert garbled.SUSPECT.search("doğru Türkçe – 25 € ve mi?") is None
    assert garbled.SUSPECT.search("ba?vuru") and garbled.SUSPECT.search("sınýf")


def test_restored_texts_are_the_planted_originals(spark):
    """Rows garbled by several swaps, with names and signs that no clean row has, come back as they were."""
    words_ = "açık kapalı öğrenci sınav başvuru yardım kayıt ışık alış üç iç öğretim güz dönemi ücret çalışma Üniversitesi İletişim değişiklik süre".split()
    rng = random.Random(41)
    clean = [("t", i, " ".join(rng.choices(words_, k=12))) for i in range(300)]
    originals = {1000 + i: " ".join(rng.choices(words_, k=14)) + " Yenipınarğü • son – “söz” üç" for i in range(60)}
    swaps = [lambda t: t.encode().decode("cp1252"), lambda t: t.encode().decode("latin-1"), lambda t: t.encode("cp1254").decode("latin-1"), lambda t: t.encode().decode("mac_roman")]
    garbled_rows = {i: swaps[i % 4](t) if i % 4 else t.replace("İ", "I").encode().decode("cp1252", "ignore") for i, t in originals.items()}
    df = spark.createDataFrame(clean + [("t", i, t) for i, t in garbled_rows.items()] + [("t", 5000, None), ("t", 5001, ""), ("t", 5002, "été à la plage 日本 üç")], "tbl string, rec_id bigint, text string")
    got = {r["rec_id"]: r["text"] for r in garbled.restored(df).collect()}
    assert set(got) == set(originals)
    for i, text in got.items():
        if i % 4:
            assert text == originals[i], (garbled_rows[i], text)


def test_short_words_and_long_runs_are_read_part_by_part():
    mapping = {("s", "Ã¼"): {"ü": 1.0}, ("s", "Ã§"): {"ç": 0.9}}
    assert garbled.chance(mapping, "s", "Ã¼Ã§", "üç") == pytest.approx(0.9)
    assert garbled.chance(mapping, "s", "Ã¼Ã§" * 20, "üç" * 20) == pytest.approx(0.9**20)
    assert garbled.chance(mapping, "s", "Ã¼x", "üç") == 0.0
    assert not garbled.suspects("20 € ve 5€ – ? ??")
    assert "Ã¼Ã§" in garbled.suspects("son Ã¼Ã§ yıl") and garbled.suspects("日" * 5000) == {"日" * 5000}
    assert garbled.best_reading({"Ã¼": ("ü", 1.0), "Ã§": ("ç", 0.9)}, "Ã¼Ã§") == "üç"
    assert garbled.best_reading({"Ã¼": ("ü", 1.0)}, "Ã¼Ã§") is None and garbled.best_reading({}, "Ã") is None


def test_long_notices_count_by_their_sentences():
    long = "HTTP Error 404. " + "Aradığınız sayfa bulunamadı ya da taşınmış olabilir. " * 6
    assert len(long) > residue.NOTICE_CHARS and residue.page_residue([long], None) == "error"
    assert residue.page_residue(["Ders notları bu sayfadan indirilebilir ve herkese açıktır. " * 6 + "Aradığınız sayfa bulunamadı."], None) is None


def test_needed_strings_never_hide_a_notice():
    for kind, strings, pattern in residue.RULES:
        for line in ("Sayfa bulunamadı", "HTTP Error 404", "Yakında...", "Bu sayfa henüz hazır değil", "test sayfası 3", "Lütfen bekleyin, yükleniyor", "at Foo.bar(", "nginx/1.2", "deneme metin", "(hata 404)"):
            low = residue.lowered(line)
            assert not pattern.search(low) or not strings or any(x in low for x in strings), (pattern.pattern, line)
    assert residue.residue_kind("(hata 404)") == "error" and residue.residue_kind("Yeni paragraf") == "filler"


def test_placeholders_and_notices():
    for text in ("Yer - {{ ad }}", "Sayın ${ad_soyad},", "ara %%tarih%% son", "[INSERT ad]", "__ad__ ile", "Tarih\t<son_basvuru>", "@Model.ad", "undefined undefined", "#ad_soyad#"):
        assert residue.placeholders(text), text
    for text in ("{a, b, c} kümesi", "[Tablo 2] içinde <82", "Şablon dilinde yer tutucu {{ ad }} biçiminde yazılır", "bkz. #9 sayılı", "%20 indirim", ""):
        assert not residue.placeholders(text), text
    assert residue.page_residue(["Başlık", "HTTP Error 404"], "Başlık") == "error"
    assert residue.page_residue(["Lorem ipsum dolor sit amet consectetur"], None) == "filler"
    assert residue.page_residue(["JavaScript dersinin kontenjanı 20 kişiye çıkarılmıştır. " * 6, "Hata Ayıklama atölyesi açıldı."], "Dersler") is None
    assert residue.page_residue([], None) is None


def test_body_model_separates_menus_from_text():
    menu = ["Ana Sayfa", "Haberler", "İletişim"]
    texts = ["\n".join([*menu, f"Konu {i}", f"Bu {i}. sayfanın uzun metni burada başlar ve birkaç cümle boyunca sürüp gider. " * 2, "© 2024 Kurum"]) for i in range(40)]
    strong = [body.skeleton_hash(body.skeleton(x)) for x in (*menu, "© 2024 Kurum")]
    pages = body.Pages(texts, [f"Konu {i}" for i in range(40)], [strong] * 40, [strong] * 40, [False] * 40)
    model = body.train(pages, body.annotate(pages))
    p = model.furniture(pages).reshape(40, 6)
    assert (p[:, [0, 1, 2, 5]] > 0.5).all() and (p[:, [3, 4]] < 0.5).all()
    assert model.furniture(body.Pages([None, ""], [None] * 2, [None] * 2, [None] * 2, [False] * 2)).size == 0


def test_addresses_parse_and_pair(spark):
    p = addresses.parse("Barış Mah. - Küçük Halıcılar Cad. - Kapı No 40 - K.2 - P.K. 97460 - Güzelkonak / Akçasu - Türkiye")
    assert (p["quarter"], p["street"], p["kind"], p["door"], p["post"], p["names"]) == ("baris", "kucuk halicilar", "cadde", "40", "97460", ["akcasu", "guzelkonak"])
    assert addresses.parse("-") is None and addresses.parse(None) is None
    assert addresses.phone_key("0(299) 554 78 63 / 12") == addresses.phone_key("+90 299 554 78 63") == "2995547863"
    assert addresses.near("halicilar", "hlaicilar") and not addresses.near("demirkapi", "demirkaya")


def test_streets_one_consonant_apart_are_paired(spark):
    """Each name stands once or twice, so nothing corrects it, and the edit changes its sound."""
    names = ["halicilar", "demirkapi", "gulbahce", "yenikoy", "taskopru", "karaagac", "cinarli", "degirmen"]
    rows = [(2 * i + k, f"Barış Mah. {x} Sok. No {i + 3} 9746{i} Akçasu", "") for i, x in enumerate(names) for k, x in enumerate((x, "v" + x[1:]))]
    df = spark.createDataFrame(rows, "id bigint, address string, phone string")
    got = {tuple(r) for r in addresses.pairs(*addresses.same_place(df, "id", "address", "phone"), "id").collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(8)}


def test_weights_decide_whether_near_streets_are_one_place():
    """The same pattern, of streets one letter apart with no quarter, is a link or none as such streets mostly agree or contradict elsewhere."""
    asked = (1, 2, 2, 3, 2, 2, 3)
    assert not addresses.contradicts(asked)
    same = [((2, 2, 2, 2, 2, 2, 2), 300), ((2, 2, 2, 3, 2, 2, 2), 60), (asked, 2), ((2, 2, 0, 2, 2, 2, 2), 40)]
    other = addresses.estimate([*same, ((1, 2, 2, 0, 2, 2, 2), 9000)])
    typos = addresses.estimate([*same, ((1, 2, 2, 2, 2, 2, 2), 100), ((0, 2, 2, 2, 2, 2, 2), 300)])
    assert other[asked] < addresses.THRESHOLD < typos[asked]
    assert other[(1, 2, 2, 0, 2, 2, 2)] == 0 and min(other[(2, 2, 2, 2, 2, 2, 2)], typos[(2, 2, 2, 2, 2, 2, 2)]) > addresses.THRESHOLD


def test_letters_that_changed_places_are_one_edit(spark):
    names = [("Çeşmebaşı", "Çeşembaşı"), ("Gülbahçe", "Gülabhçe"), ("Demirkapı", "Demikrapı"), ("Karaağaç", "Kaarağaç")]
    rows = [(4 * i + k, f"{x} Sk. No {i + 5 + (k == 2)} {'' if k == 3 else f'9039{i}'} Yamaçköy", "") for i, (a, b) in enumerate(names) for k, x in enumerate((a, b, a, a))]
    df = spark.createDataFrame(rows, "id bigint, address string, phone string")
    assert {tuple(r) for r in addresses.pairs(*addresses.same_place(df, "id", "address", "phone"), "id").collect()} == {(4 * i + a, 4 * i + b) for i in range(4) for a, b in ((0, 1), (0, 3), (1, 3))}


def test_chance_pairs_of_a_large_table_do_not_unlearn_agreement():
    """Matches grow with the rows, pairs that one street and district brings together with their square."""
    whole, short = (2, 2, 2, 2, 2, 2, 3), (2, 2, 2, 3, 2, 2, 3)
    for k in (1, 10, 200):
        chance = [((2, 2, 0, 2, 2, 2, 3), 60 * k * k), ((2, 2, 0, 3, 2, 2, 3), 50 * k * k), ((0, 2, 2, 2, 2, 2, 2), 90 * k * k), ((2, 2, 2, 0, 0, 0, 3), 2 * k * k)]
        weight = addresses.estimate([(whole, 300 * k), (short, 360 * k), *chance])
        assert min(weight[whole], weight[short]) > 0.9 and max(weight[p] for p, _ in chance) == 0


def test_usual_quarter_of_a_postcode_is_not_filled_in(spark):
    rows = [(i, f"Barış Mah. {1200 + i}. Sk. No {i} 91200 Otluca / Bozdoruk", "") for i in range(9)]
    rows += [(20, "Zafer Mah. Ötügen Sk. No 103 91200 Otluca / Bozdoruk", ""), (21, "Ötügen Sokağı No:103 91200 Otluca / Bozdoruk", "")]
    df = spark.createDataFrame(rows, "id bigint, address string, phone string")
    assert [tuple(r) for r in addresses.pairs(*addresses.same_place(df, "id", "address", "phone"), "id").collect()] == [(20, 21)]


def test_typo_in_a_title_and_door_by_telephone_and_area(spark):
    assert {addresses.parse(f"Yeni Fevzi {x} Cad. No 4")["street"] for x in ("Bey", "eBy", "ey", "Beey")} == {"yeni fevzi bey"}
    assert addresses.parse("Yeni Boy Cad. No 4")["street"] == "yeni boy"
    rows = [("2", "t1", "a", "c", "p", "5"), ("2", "t1", "b", "h", "p", "9"), ("2", "t1", "d", "z", "p", "5"), ("2", "t1", "b", "h", "p", None)]
    parts = spark.createDataFrame([(i, t, s, "sokak", d, q, x, v, None) for i, (s, t, q, x, v, d) in enumerate(rows)], "id bigint, phone string, street string, kind string, door string, quarter string, district string, province string, post string")
    assert {r["id"]: r["door"] for r in addresses.with_doors(parts).collect()}[3] == "9"


def test_grades_and_levels():
    counts = np.array([[9.0, 1, 0, 0], [0, 0, 1, 9], [5, 5, 5, 5]])
    g = reading.grades_from(counts, np.array([10.0, 10, 10, 10]))
    assert g[0] < g[2] < g[1]
    x = reading.features(["kolay kolay kolay kolay kolay", "", None], {"kolay": 1.0})
    assert not np.isnan(x[0]).any() and np.isnan(x[1:]).any(1).all()
