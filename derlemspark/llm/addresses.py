"""Postal addresses that denote the same place, by probabilistic linkage of address components."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import guarded_join, hot_join
from ..session import reliable

# How Turkish addresses name the kinds of their parts (folded to ASCII).
QUARTER = r"(?:mahallesi|mahalle|mah|mh)"
STREET = {"sokak": r"sokagi|sokak|sok|sk|st|street", "cadde": r"caddesi|cadde|cad|cd|ave|avenue", "bulvar": r"bulvari|bulvar|bulv|blvd|blv"}
DOOR = r"(?:dis kapi no|kapi numarasi|kapi no|numarasi|numara|no|nu|n)"
RANK = ("yeni", "eski", "buyuk", "kucuk")
BUILDING = r"(?:blok|blogu|binasi|bina|girisi|merkezi|tesisi|tesis|evi|kampusu|yerleskesi|plaza|apartmani|apt|sitesi|is hani|hani|katı)"
NOTHING = re.compile(r"^\W*$|girilmemis|belirtilmemis|bilgi yok|yok$|bilinmiyor|adres bilgisi")

_FOLD = str.maketrans("ıİşŞğĞçÇöÖüÜâÂîÎûÛ", "iIsSgGcCoOuUaAiIuU")
_POST = re.compile(r"(?:\bp\.?\s?k\.?\s*:?\s*)?\b(\d{5})\b")
_FLOOR = re.compile(r"\bkat\s*[.:]?\s*-?\d+\b|\bk\s*[.:]\s*-?\d+\b|\b\d+\s*\.\s*kat\b|\b(?:zemin|bodrum) kat\b")
_NUMBERED = re.compile(rf"\b(\d{{2,5}})\s*\.?\s*(?:no'?lu\s+|numarali\s+)?({'|'.join(STREET.values())})\b\.?")
_DOOR = re.compile(rf"\b{DOOR}\s*[.:]?\s*(\d+(?:\s*/\s*[a-z0-9]+)?)\b")
_QUARTER = re.compile(rf"\b([a-z']+)\s+{QUARTER}\b\.?")
_NAMED = re.compile(rf"\b(?:(?:([a-z']+)[ \t]+)?([a-z']+)[ \t]+)?([a-z']+)[ \t]+({'|'.join(STREET.values())})\b\.?")
_BUILDING = re.compile(rf"(?:\b[a-z']+\s+){{1,2}}{BUILDING}\b")
_PHONE_EXT = re.compile(r"(?:/|dahili|\(?\s*ic hat|ext|#).*$")
#: Titles that end a street name of two words.
TITLES = frozenset("bey pasa hatun efendi aga sultan hoca baba dede hanim usta".split())


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).translate(_FOLD).lower()
    return re.sub(r"[’`´]", "'", text)


def street_kind(word: str) -> str:
    return next(kind for kind, forms in STREET.items() if word in forms.split("|"))


def near(a: str, b: str, least: int = 4) -> bool:
    """At most one letter inserted, left out, changed or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < least:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def title_of(word: str) -> str | None:
    """The title that a word is, or that it is at one edit from: no other writing of the street would correct a word this short."""
    return word if word in TITLES else next((t for t in sorted(TITLES) if near(word, t, 2)), None)


def parse(address: str | None) -> dict | None:
    """Components of an address: quarter, street, kind, door, post, names (districts and provinces); None without an address."""
    if not address or not address.strip():
        return None
    text = fold(address)
    if NOTHING.search(text.strip()):
        return None
    text = re.sub(r"^\s*adres\s*:", " ", text)
    text = re.sub(r"\bt(?:urkiye|r)\b\.?", " | ", text)
    text = re.sub(r"\s-\s|[,()\n;]|\s{2,}|(?<=[a-z])\s*[/-]\s*(?=[a-z])", " | ", text)
    out = {"quarter": None, "street": None, "kind": None, "door": None, "post": None, "names": []}

    def take(pattern: re.Pattern, rest: str):
        m = pattern.search(rest)
        return m, (rest[: m.start()] + " | " + rest[m.end() :] if m else rest)

    m, text = take(_POST, text)
    out["post"] = m.group(1) if m else None
    m, text = take(_FLOOR, text)
    m, text = take(_NUMBERED, text)
    if m:
        out["street"], out["kind"] = m.group(1), street_kind(m.group(2))
    m, text = take(_DOOR, text)
    out["door"] = re.sub(r"\s", "", m.group(1)) if m else None
    m, text = take(_QUARTER, text)
    out["quarter"] = m.group(1) if m else None
    if out["street"] is None:
        m = _NAMED.search(text)
        if m:
            before, first, name = m.group(1), m.group(2), m.group(3)
            start = m.start(3)
            title = title_of(name) if first and not any(near(first, r, 3) for r in RANK) else None
            if title:
                name, start, first = f"{first} {title}", m.start(2), before
            at = m.start(2) if start == m.start(3) else m.start(1)
            rank = next((r for r in RANK if first and near(first, r, 3)), None)
            start = at if rank else start
            out["street"], out["kind"] = f"{rank} {name}" if rank else name, street_kind(m.group(4))
            text = text[:start] + " | " + text[m.end() :]
    text = _BUILDING.sub(" | ", text)
    out["names"] = sorted({w for part in text.split("|") for w in [re.sub(r"[^a-z ]", "", part).strip()] if len(w) > 2 for w in w.split()})
    return out


def phone_key(phone: str | None) -> str | None:
    """Ten digits of a telephone number without country code, trunk zero and extension."""
    if not phone:
        return None
    digits = re.sub(r"\D", "", _PHONE_EXT.sub("", fold(phone)))
    digits = re.sub(r"^(?:00)?90(?=\d{10}$)", "", digits)
    digits = digits[-10:]
    return digits if len(digits) == 10 else None


FIELDS = ("street", "kind", "door", "quarter", "district", "province", "post")
#: Names seen so often more than a near one are taken for its correct form; least rows of a name that corrects others.
CORRECTS, MIN_NAME = 3, 3
#: Share of the rows of a postcode that must agree on the district for it to fill it in.
POST_SHARE = 0.8
ROUNDS, THRESHOLD, PRIOR = 40, 0.5, 0.1


def components(records: DataFrame, id_col: str, address_col: str, phone_col: str) -> DataFrame:
    """id, phone and the components of each record with an address; its street may be null."""
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for rec, address, phone in zip(*(batch.column(k).to_pylist() for k in range(3))):
                p = parse(address)
                if p:
                    ids.append(rec)
                    rows.append((phone_key(phone), p["street"], p["kind"], p["door"], p["quarter"], p["post"], p["names"]))
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(6)] + [pa.array([r[6] for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *columns], names=["id", "phone", "street", "kind", "door", "quarter", "post", "names"])

    return records.select(id_col, address_col, phone_col).mapInArrow(run, f"id {kind}, phone string, street string, kind string, door string, quarter string, post string, names array<string>")


def left_out(word: str) -> Column:
    """A word and the words with one of its letters left out."""
    places = F.sequence(F.lit(1), F.length(word))
    return F.array_distinct(F.concat(F.array(word), F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def corrections(names: DataFrame) -> DataFrame:
    """word -> right for rare words one edit away from a word CORRECTS times as frequent. names: column word, one row for each use.

    Candidates meet in the words with one letter left out, so no word is compared with all others.
    """
    counts = reliable(names.filter("word is not null and length(word) >= 4 and not word rlike '^[0-9]'").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    spread = counts.select("word", "n", F.explode(left_out("word")).alias("key"))
    right = spread.filter(F.col("n") >= MIN_NAME).select(F.col("word").alias("right"), F.col("n").alias("m"), "key")
    met = spread.join(right, "key").filter((F.col("m") >= CORRECTS * F.col("n")) & (F.col("word") != F.col("right")) & (F.levenshtein("word", "right") <= 2))

    @F.arrow_udf("boolean")
    def one_edit(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([near(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    return met.select("word", "right", "m").distinct().filter(one_edit("word", "right")).groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def corrected(df: DataFrame, column: str, fixes: DataFrame) -> DataFrame:
    fixes = fixes.select(F.col("word").alias(column), F.col("right").alias("__right"))
    return guarded_join(df, fixes, [column], "left").withColumn(column, F.coalesce("__right", column)).drop("__right")


def hierarchy(names: DataFrame) -> DataFrame:
    """name, province for each district: of two names that stand together, the one with more partners is the province."""
    pair = names.filter(F.size("names") == 2).select(F.col("names")[0].alias("a"), F.col("names")[1].alias("b"))
    both = pair.unionAll(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    both = reliable(both)
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("w"))
    told = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e"), F.col("w").alias("v")), "b")
    up = told.filter((F.col("e") > F.col("d")) | ((F.col("e") == F.col("d")) & (F.col("v") > F.col("w"))))
    return up.groupBy(F.col("a").alias("name")).agg(F.max_by("b", F.struct("n", "b")).alias("province"))


def resolved(parts: DataFrame) -> DataFrame:
    """id, phone and FIELDS with names corrected, district and province told apart, what a postcode or a telephone tells filled in."""
    parts = reliable(parts)
    parts = corrected(parts, "quarter", corrections(parts.select(F.col("quarter").alias("word"))))
    parts = corrected(parts, "street", corrections(parts.select(F.col("street").alias("word"))))
    one = parts.select("id", F.explode_outer("names").alias("name"))
    fixed = corrected(one, "name", corrections(one.select(F.col("name").alias("word"))))
    names = fixed.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    parts = reliable(parts.drop("names").join(names, "id"))
    tree = reliable(hierarchy(parts))
    below = tree.select("name", "province")
    named = parts.select("id", F.explode_outer("names").alias("name"))
    named = guarded_join(named, below, ["name"], "left")
    tops = tree.select(F.col("province").alias("name")).distinct().withColumn("top", F.lit(True))
    named = guarded_join(named, tops, ["name"], "left")
    placed = named.groupBy("id").agg(
        F.min(F.when(F.col("province").isNotNull() & F.col("top").isNull(), F.struct("name", "province"))).alias("low"),
        F.min(F.when(F.col("top"), F.col("name"))).alias("top"),
    )
    parts = parts.drop("names").join(placed, "id").select("id", "phone", "street", "kind", "door", "quarter", F.col("low.name").alias("district"), F.coalesce("top", "low.province").alias("province"), "post")
    parts = reliable(parts)
    told = parts.filter("post is not null").groupBy("post", "district").agg(F.count(F.lit(1)).alias("n"))

    def usual(column: str) -> DataFrame:
        by = told.filter(F.col(column).isNotNull()).groupBy("post", column).agg(F.sum("n").alias("n"))
        best = by.groupBy("post").agg(F.sum("n").alias("all"), F.max_by(column, F.struct("n", column)).alias(f"__{column}"), F.max("n").alias("top"))
        return best.filter((F.col("top") >= MIN_NAME) & (F.col("top") >= F.col("all") * POST_SHARE)).select("post", f"__{column}")

    # a postcode lies in one district but in several quarters: the usual quarter, filled in, would contradict the others
    parts = guarded_join(parts, usual("district"), ["post"], "left").withColumn("district", F.coalesce("district", "__district")).drop("__district")
    up = tree.select(F.col("name").alias("district"), F.col("province").alias("__up"))
    parts = guarded_join(parts, up, ["district"], "left").withColumn("province", F.coalesce("province", "__up")).drop("__up")
    return reliable(with_doors(parts))


def with_doors(parts: DataFrame) -> DataFrame:
    """Without a door number a record gets that of the records on its street with its telephone whose area doesn't contradict its own, or the telephone itself in its place."""
    parts = reliable(parts)
    area = ("quarter", "district", "province")
    known = parts.filter("door is not null and phone is not null").groupBy("street", "kind", "phone").agg(F.collect_set(F.struct("door", *area)).alias("doors"))
    none = parts.filter("door is null and phone is not null")
    met = none.join(known, ["street", "kind", "phone"], "left")
    fits = F.filter("doors", lambda x: reduce(lambda p, q: p & q, [F.coalesce(x[k] == F.col(k), F.lit(True)) for k in area]))
    doors = F.array_distinct(F.transform(fits, lambda x: x["door"]))
    filled = met.withColumn("door", F.when(F.size(doors) == 1, doors[0]).otherwise(F.concat(F.lit("tel:"), "phone"))).select(parts.columns)
    return parts.filter("door is not null").unionByName(filled)


def sound(street: Column) -> Column:
    """Street-sound key: a number as it is; a name's first letter and its consonants without repeats."""
    rest = F.regexp_replace(F.regexp_replace(F.substring(street, 2, 100), "[aeiou' ]", ""), r"(.)\1+", "$1")
    return F.when(street.rlike("^[0-9]"), street).otherwise(F.concat(F.substring(street, 1, 1), rest))


def levels(a: str, b: str) -> Column:
    """2 equal, 1 one edit apart (or two letters that changed places), 0 different, 3 missing on a side."""
    x, y = F.col(a), F.col(b)

    def letters(z: Column) -> Column:
        return F.array_sort(F.split(z, ""))

    edits = F.levenshtein(x, y)
    close = ((edits <= 1) | ((edits == 2) & (letters(x) == letters(y)))) & (F.least(F.length(x), F.length(y)) >= 5) & ~x.rlike("[0-9]")
    return F.when(x.isNull() | y.isNull(), 3).when(x == y, 2).when(close, 1).otherwise(0)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of a match for each pattern of agreement levels, by expectation-maximization with missing as a level of its own.

    Pairs that contradict each other are known to be none: they teach how often each level agrees by chance. Only pairs on
    one street with one door teach: blocking meets all of these, whatever else they agree on, while of the others it meets
    those that agree on an area, ever more of them the larger the table, which would make agreement on all look like chance.
    """
    post = {p: 0.0 for p, _ in patterns}
    patterns = [(p, n) for p, n in patterns if p[0] in (1, 2) and p[2] == 2]
    if not patterns:
        return post
    width = len(patterns[0][0])
    share = 0.2
    first_m, first_u = {2: 0.9, 1: 0.05, 0: 0.03, 3: 0.1}, {2: 0.2, 1: 0.05, 0: 0.7, 3: 0.1}
    m, u = [dict(first_m) for _ in range(width)], [dict(first_u) for _ in range(width)]
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        for p, _n in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(m[k][v] / u[k][v]) for k, v in enumerate(p) if k != 2)  # the door is the same in all
            post[p] = 0.0 if contradicts(p) else 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        matched = sum(n * post[p] for p, n in patterns)
        share = min(0.99, max(1 / (total + 2), matched / total))
        for k in range(width):
            for table, first, part, own in ((m, first_m, lambda p: post[p], matched), (u, first_u, lambda p: 1 - post[p], total)):
                # the first tables count as PRIOR of the matches, of all pairs for the rest: what is missing often doesn't become a class of its own
                mass = {v: 0.5 + PRIOR * own * first[v] + sum(n * part(p) for p, n in patterns if p[k] == v) for v in (0, 1, 2, 3)}
                z = sum(mass.values())
                table[k] = {v: x / z for v, x in mass.items()}
    return post


def linked_classes(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (id, class) and links (a, b, weight) between classes of records with the same components.

    Pairs of classes come from two blocking keys: street sound and door, and door with the street or the street with one
    letter left out. All pairs that contradicts() allows have one door and streets at most one letter apart, so they meet
    here; blocks on postcode or district would add only pairs that it excludes, as many as the square of the rows. Copies are
    collapsed before, so a hot place is a few classes however many rows it has; what is still a hot key (the main
    street of a large city) is dealt to cells. The weights decide whether streets one edit apart, and records that leave
    parts out, are one place; pairs that contradicts() excludes by definition teach them what chance agreement looks like.
    """
    whole = F.xxhash64(*[F.coalesce(F.col(f), F.lit("-")) for f in FIELDS])
    parts = parts.withColumn("class", whole)
    members = parts.select("id", "class")
    classes = reliable(parts.select("class", *FIELDS).dropDuplicates(["class"]).withColumn("sound", sound(F.col("street"))))

    def block(*keys: str) -> DataFrame:
        a = classes.filter(" and ".join(f"{k} is not null" for k in keys))
        b = a.select(*[F.col(c).alias(f"{c}_b") for c in a.columns], *keys)
        return hot_join(a, b, list(keys)).filter(F.col("class") < F.col("class_b")).select(*a.columns, *[f"{c}_b" for c in a.columns])

    def one_letter() -> DataFrame:
        keyed = classes.filter("door is not null and length(street) >= 5 and not street rlike '[0-9]'").withColumn("key", F.explode(left_out("street")))
        b = keyed.select(*[F.col(c).alias(f"{c}_b") for c in classes.columns], "key", "door")
        return hot_join(keyed, b, ["key", "door"]).filter(F.col("class") < F.col("class_b")).select(*classes.columns, *[f"{c}_b" for c in classes.columns])

    pairs = block("sound", "door").unionByName(one_letter()).dropDuplicates(["class", "class_b"])
    marked = reliable(pairs.select(F.col("class").alias("a"), F.col("class_b").alias("b"), *[levels(f, f"{f}_b").alias(f"l_{f}") for f in FIELDS]))
    names = [f"l_{f}" for f in FIELDS]
    patterns = [(tuple(r[:-1]), r[-1]) for r in marked.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 4 ** 7 rows
    weight = estimate(patterns)
    good = [(*p, w) for p, w in weight.items() if w >= THRESHOLD]
    table = parts.sparkSession.createDataFrame(good, ", ".join(f"{n} int" for n in names) + ", weight double")
    return members, reliable(marked.join(F.broadcast(table), names).select("a", "b", "weight"))


def contradicts(pattern: tuple[int, ...]) -> bool:
    """Exact check after the linkage: another street, kind of street, door, quarter, district or province is another place by definition. A postcode may differ."""
    street, kind, door, quarter, district, province, _ = pattern
    return door != 2 or min(street, kind, quarter, district, province) == 0


def same_place(records: DataFrame, id_col: str, address_col: str, phone_col: str) -> tuple[DataFrame, DataFrame]:
    """members and links of linked_classes() for the records with an address.

    Records without a street, and those with neither door number nor telephone, are classes by themselves.
    """
    parts = reliable(components(records, id_col, address_col, phone_col))
    members, links = linked_classes(resolved(parts.filter("street is not null")))
    members = reliable(members)
    alone = parts.select("id").distinct().join(members.select("id").distinct(), "id", "left_anti")
    return members.unionByName(alone.select("id", F.xxhash64("id", F.lit("alone")).alias("class"))), links


def pairs(members: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Pairs of records in one class or in linked classes, the smaller id first."""
    a, b = f"{id_col}_a", f"{id_col}_b"
    left, right = members.select(F.col("id").alias(a), F.col("class").alias("a")), members.select(F.col("id").alias(b), F.col("class").alias("b"))
    same = hot_join(left, right.withColumnRenamed("b", "a"), ["a"]).filter(F.col(a) < F.col(b)).select(a, b)
    one = reliable(hot_join(links.select("a", "b"), left, ["a"]))
    other = hot_join(one, right, ["b"]).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    return same.unionAll(other).distinct()
