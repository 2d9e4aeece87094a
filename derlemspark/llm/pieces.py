"""Splitting oversized items at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 1200, 200

ARTICLE = re.compile(r"(?:ek |geçici )?(?:madde|article|artikel|bölüm|kısım|section|chapter|المادة)\s+[\dIVXivx]", re.IGNORECASE)
HEADING = re.compile(r"#{1,6}\s|\d+(?:\.\d+)*[.)]\s+\S")
SENTENCE = re.compile(r"[.!?…;][\"'”’)»]?[^\S\n]+")
#: Signs that open a list entry or end a sentence: such a line is no heading.
ENTRY, CLOSED, HEADING_CHARS = tuple("-•*+–»›"), tuple(".,;:!?…"), 80
WORD = re.compile(r"\s+")
#: Strength of a cut before an article, a heading, a paragraph after a blank line, a line, a sentence, a word.
S_ARTICLE, S_HEADING, S_PARAGRAPH, S_LINE, S_SENTENCE = 5, 4, 3, 2, 1


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions where a new unit starts, and their strengths."""
    places, strengths, at, blank = [], [], 0, False
    for line in text.split("\n"):
        bare = line.lstrip()
        if bare:
            start = at + len(line) - len(bare)
            if start:
                if ARTICLE.match(bare):
                    s = S_ARTICLE
                elif HEADING.match(bare) or (len(bare) <= HEADING_CHARS and not bare.startswith(ENTRY) and not bare.rstrip().endswith(CLOSED)):
                    s = S_HEADING
                else:
                    s = S_PARAGRAPH if blank else S_LINE
                places.append(start)
                strengths.append(s)
            for m in SENTENCE.finditer(line):
                if m.end() < len(line):
                    places.append(at + m.end())
                    strengths.append(S_SENTENCE)
        blank = not bare
        at += len(line) + 1
    return places, strengths


def cut_place(text: str, start: int, end: int, places: list[int], strengths: list[int]) -> int:
    """The strongest boundary in the middle half of [start, end), the nearest to the midpoint among equals.

    Without one there: any boundary nearest to the midpoint, then white space, then the midpoint itself,
    moved past combining signs.
    """
    mid, reach = (start + end) // 2, (end - start) // 4
    lo, hi = bisect_left(places, max(start + 1, mid - reach)), bisect_right(places, min(end - 1, mid + reach))
    if lo < hi:
        return places[max(range(lo, hi), key=lambda i: (strengths[i], -abs(places[i] - mid)))]
    lo, hi = bisect_right(places, start), bisect_left(places, end)
    near = min(places[lo:hi], key=lambda p: abs(p - mid), default=None)
    blanks = [m.end() for m in WORD.finditer(text, max(start, mid - reach), min(end, mid + reach)) if start < m.end() < end]
    if blanks:
        return min(blanks, key=lambda p: abs(p - mid))
    if near is not None:
        return near
    while mid < end - 1 and 0x300 <= ord(text[mid]) <= 0x36F:
        mid += 1
    return mid


def spans(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(from, start, end) of each piece: text[from:end] is the piece, text[from:start] the repeated end of the one before.

    A null text has no piece, a text within the limit one, an empty text one empty piece. The parts
    [start, end) follow each other without a gap, so joining them restores the text exactly.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if text is None:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    places, strengths = boundaries(text)
    room, todo, parts = limit - overlap, [(0, len(text))], []
    while todo:
        start, end = todo.pop()
        if end - start <= room:
            parts.append((start, end))
            continue
        at = cut_place(text, start, end, places, strengths)
        todo += [(at, end), (start, at)]
    out = [(parts[0][0], *parts[0])]
    for (before, _), (start, end) in zip(parts, parts[1:]):
        low = max(before, start - overlap)
        i = bisect_left(places, low)
        if low > before and (i == len(places) or places[i] >= start):  # no unit starts there: take whole words
            m = WORD.search(text, low, start)
            first = m.end() if m and m.end() < start else low
        else:
            first = low if low == before else places[i]
        out.append((first, start, end))
    return out


def span_udf(limit: int = LIMIT, overlap: int = OVERLAP):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def flat(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [x for span in spans(t, limit, overlap) for x in span] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return flat


def piece_spans(items: DataFrame, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """items with piece_no, n_pieces, piece_from, piece_start, piece_end (code points), one row for each piece.

    Null texts give no rows. No shuffle: one Python call for each Arrow batch of texts.
    """
    flat = items.withColumn("__spans", span_udf(limit, overlap)(F.col(text_col)))
    n = (F.size("__spans") / 3).cast("int")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("piece_no"), F.get("__spans", i * 3).alias("piece_from"), F.get("__spans", i * 3 + 1).alias("piece_start"), F.get("__spans", i * 3 + 2).alias("piece_end")))
    return flat.filter(F.col("__spans").isNotNull()).withColumn("n_pieces", n).withColumn("__piece", F.explode(rows)).select(*[c for c in items.columns if c not in ("piece_no", "n_pieces", "piece_from", "piece_start", "piece_end")], "n_pieces", "__piece.*")


def split_items(items: DataFrame, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces with their text in column piece; the item's text column is left out."""
    cut = piece_spans(items, text_col, limit, overlap)
    return cut.withColumn("piece", F.substring(text_col, F.col("piece_from") + 1, F.col("piece_end") - F.col("piece_from"))).drop(text_col)
