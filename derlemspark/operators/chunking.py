"""Chunking operators. Windows and splits are built-in expressions; greedy packings are folds within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT, LONG, MIN_CHUNK = 1200, 1800, 40
WORDS, OVERLAP = 200, 40
#: Context of the text before the first heading.
INTRO = "Giriş"
#: Marks put before a heading or an article, so that one plain split serves every engine.
MARK = "\u0001"


def word_windows(text: Column, words: int = WORDS, overlap: int = OVERLAP) -> Column:
    """Windows of ``words`` words that advance by words - overlap; the last is the first to reach the end. A short text is one window."""
    parts = F.split(text, " ")
    starts = F.sequence(F.lit(0), F.greatest(F.size(parts) - overlap - 1, F.lit(0)), F.lit(words - overlap))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i + 1, F.lit(words)), " "))


def marked_split(text: Column, pattern: str) -> Column:
    """Pieces that start at each match of the pattern, the text before the first match included if it isn't blank."""
    return F.filter(F.split(F.regexp_replace(text, pattern, MARK + "$0"), MARK), lambda x: F.length(F.trim(x)) > 0)


ARTICLE = r"(?m)^(?:Madde|MADDE)\s+\d+"
HEADING = r"(?m)^#{1,4}\s+"


def by_marks(text: Column, pattern: str, least: int = 2, longest: int = LONG) -> Column:
    """Pieces at the matches; word windows for a text with fewer than ``least`` pieces and for pieces that are too long."""
    pieces = marked_split(text, pattern)
    fine = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > longest, word_windows(p)).otherwise(F.array(p))))
    return F.when(F.size(pieces) < least, word_windows(text)).otherwise(fine)


def whole_or_windows(text: Column, limit: int = LIMIT) -> Column:
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(word_windows(text))


def paragraphs(text: Column, limit: int = LIMIT) -> Column:
    """Greedy packing of blank-line paragraphs up to the limit; each next chunk begins with the last sentence of the one before if that has 11 to 200 characters."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")

    def add(state: Column, part: Column) -> Column:
        current, out = state["current"], state["out"]
        last = F.element_at(F.split(current, r"(?<=[.!?])\s+"), -1)
        carried = F.when(F.length(last).between(11, 200), F.concat(last, F.lit("\n\n"), part)).otherwise(part)
        full = (current != "") & (F.length(current) + F.length(part) + 2 > limit)
        return F.struct(
            F.when(full, carried).when(current == "", part).otherwise(F.concat(current, F.lit("\n\n"), part)).alias("current"),
            F.when(full, F.concat(out, F.array(current))).otherwise(out).alias("out"),
        )

    start = F.struct(F.lit("").alias("current"), F.array().cast("array<string>").alias("out"))
    packed = F.aggregate(parts, start, add, lambda s: F.when(s["current"] != "", F.concat(s["out"], F.array(s["current"]))).otherwise(s["out"]))
    return F.flatten(F.transform(packed, lambda p: F.when(F.length(p) > 2 * limit, word_windows(p)).otherwise(F.array(p))))


def heading_context(text: Column, longest: int = LONG) -> Column:
    """array<struct<text, context>>: sections at headings; up to level 2 a heading starts the context anew, a deeper one is appended to it.

    An introduction under MIN_CHUNK characters is dropped, another has the context INTRO. Sections that are too long are
    packed from their paragraphs and keep their context.
    """
    sections = marked_split(text, HEADING)

    def add(state: Column, section: Column) -> Column:
        level = F.length(F.regexp_extract(section, r"^(#*)", 1))
        title = F.trim(F.regexp_extract(section, r"^#+\s+([^\n]*)", 1))
        context = F.when(level == 0, F.lit("")).when((level <= 2) | (state["context"] == ""), title).otherwise(F.concat(state["context"], F.lit(" > "), title))
        kept = (level > 0) | (F.length(F.trim(section)) >= MIN_CHUNK)
        item = F.struct(F.trim(section).alias("text"), F.when(level == 0, F.lit(INTRO)).otherwise(context).alias("context"))
        return F.struct(context.alias("context"), F.when(kept, F.concat(state["out"], F.array(item))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit("").alias("context"), F.array().cast("array<struct<text:string,context:string>>").alias("out"))
    whole = F.aggregate(sections, start, add, lambda s: s["out"])

    def packed(x: Column) -> Column:
        parts = F.transform(paragraphs(x["text"]), lambda p: F.struct(p.alias("text"), x["context"].alias("context")))
        return F.when(F.length(x["text"]) > longest, parts).otherwise(F.array(F.struct(x["text"].alias("text"), x["context"].alias("context"))))

    return F.flatten(F.transform(whole, packed))


def semantic(text: Column) -> Column:
    """Sections at headings where a text has two headings or more, packed paragraphs elsewhere."""
    headed = F.size(F.regexp_extract_all(text, F.lit(HEADING + r"\S"), F.lit(0))) >= 2
    return F.when(headed, F.transform(heading_context(text), lambda x: x["text"])).otherwise(paragraphs(text))


def merge_short(chunks: Column, least: int = MIN_CHUNK) -> Column:
    """Chunks under the least length are carried into the next; a carry left at the end joins the last chunk."""

    def add(state: Column, chunk: Column) -> Column:
        joined = F.when(state["carry"] != "", F.concat(state["carry"], F.lit("\n"), chunk)).otherwise(chunk)
        short = F.length(joined) < least
        return F.struct(F.when(short, joined).otherwise(F.lit("")).alias("carry"), F.when(short, state["out"]).otherwise(F.concat(state["out"], F.array(joined))).alias("out"))

    def finish(state: Column) -> Column:
        out, n = state["out"], F.size(state["out"])
        last = F.concat(F.element_at(out, -1), F.lit("\n"), state["carry"])
        return F.when(state["carry"] == "", out).when(n == 0, F.array(state["carry"])).otherwise(F.concat(F.slice(out, F.lit(1), n - 1), F.array(last)))

    start = F.struct(F.lit("").alias("carry"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(chunks, start, add, finish)


def dispatch(text: Column, kind: Column) -> Column:
    """Chunks by the document's kind, short ones merged."""
    chosen = (
        F.when(kind.isin("yonetmelik", "yonerge"), by_marks(text, ARTICLE, 3))
        .when(kind.isin("iletisim", "form"), F.array(text))
        .when(kind.isin("tanitim", "rehber"), by_marks(text, HEADING))
        .when(kind.isin("duyuru", "haber"), whole_or_windows(text))
        .when(kind.isin("mufradat", "ders_plani"), word_windows(text))
        .otherwise(semantic(text))
    )
    return merge_short(chosen)
