"""Answer post-processing: grounding checks, redaction, source deduplication, scoring."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed

PREVIEW, PLACEHOLDER_URL = 200, "(see the official web site)"


def preview(text: Column, limit: int = PREVIEW) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def ungrounded(answer: Column, pattern: str, sources: Column, plain: bool = True) -> Column:
    """Matches of the pattern in the answer that no source contains; with plain=False digits are compared only."""
    found = F.array_distinct(F.regexp_extract_all(answer, F.lit(pattern), F.lit(0)))
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    if plain:
        return F.filter(found, lambda m: ~F.exists(sources, lambda s: F.contains(s, m)))
    return F.filter(found, lambda m: (F.length(digits(m)) >= 10) & ~F.exists(sources, lambda s: F.contains(s, m) | F.contains(digits(s), digits(m))))


def redact(text: Column) -> Column:
    for pattern, mark in fixed.PII:
        text = F.regexp_replace(text, pattern, mark)
    return text


def validated(answer: str | None, sources: list[str], blocked: tuple[str, ...]) -> str | None:
    """The answer with ungrounded and blocked urls replaced, local paths removed, ungrounded telephones and e-mails removed.

    Each match of the text as it was at the start of a step replaces its first occurrence in the text so far.
    """
    if answer is None:
        return None
    text = answer
    for m in re.finditer(fixed.URL, answer):
        url = m.group()
        host = re.sub(r"^https?://", "", url).split("/")[0].split(":")[0].lower()
        if any(host == b or host.endswith("." + b) for b in blocked):
            text = text.replace(url, "", 1)
        else:
            bare = url.rstrip("/")
            forms = {bare, bare.replace("https://", "http://", 1), bare.replace("http://", "https://", 1)}
            if not any(f in s for f in forms for s in sources):
                text = text.replace(url, PLACEHOLDER_URL, 1)
    text = re.sub(fixed.LOCAL_PATH, "", text)
    all_digits = [re.sub(r"\D", "", s) for s in sources]
    for m in re.finditer(fixed.PHONE, text):
        digits = re.sub(r"\D", "", m.group())
        if len(digits) >= 10 and not any(m.group() in s for s in sources) and not any(digits in d for d in all_digits):
            text = text.replace(m.group(), "", 1)
    for m in re.finditer(fixed.EMAIL, text):
        if any(m.group().lower().endswith(b) for b in blocked) or not any(m.group() in s for s in sources):
            text = text.replace(m.group(), "", 1)
    return text


def validate_column(answer: Column, sources: Column, blocked: tuple[str, ...]) -> Column:
    @F.arrow_udf(T.StringType())
    def run(answers: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([validated(a, [s for s in ss or [] if s], blocked) for a, ss in zip(answers.to_pylist(), lists.to_pylist())], pa.string())

    return run(answer, sources)


def greedy_dedup(sources: Column) -> Column:
    """Sources (array<struct<id, url, hash, title>>) in order without those whose url or hash was kept before, or, without a url, whose title was.

    Only kept sources claim their url, hash and title.
    """
    empty = F.array().cast("array<string>")

    def add(state: Column, s: Column) -> Column:
        url, title = F.coalesce(s["url"], F.lit("")), F.coalesce(s["title"], F.lit(""))
        seen = ((url != "") & F.array_contains(state["urls"], url)) | F.array_contains(state["hashes"], s["hash"]) | ((url == "") & F.array_contains(state["titles"], title))
        keep = ~F.coalesce(seen, F.lit(False))
        grow = lambda old, new: F.when(keep, F.concat(old, F.array(new))).otherwise(old)
        return F.struct(grow(state["urls"], url).alias("urls"), grow(state["hashes"], s["hash"]).alias("hashes"), grow(state["titles"], title).alias("titles"), F.when(keep, F.concat(state["out"], F.array(s["id"]))).otherwise(state["out"]).alias("out"))

    start = F.struct(empty.alias("urls"), empty.alias("hashes"), empty.alias("titles"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(sources, start, add, lambda s: s["out"])


def score(answer: Column, found: Column, wanted: Column, negative: Column) -> Column:
    """0 to 10: base 5, keywords +2/+1/-2, forbidden words -3, length -2/-1, url, markup and contact +1 each."""
    n = F.length(answer)
    s = F.lit(5) + F.when(wanted == 0, 0).when(found >= 0.8 * wanted, 2).when(found >= 0.5 * wanted, 1).otherwise(-2)
    s = s + F.when(negative, -3).otherwise(0) + F.when(n < 50, -2).when(n < 100, -1).otherwise(0)
    for pattern in ("https?://", r"\*\*|^#|\n- ", "@|\\([0-9]{3}\\)"):
        s = s + F.when(F.regexp_like(answer, F.lit(pattern)), 1).otherwise(0)
    return F.least(F.greatest(s, F.lit(0)), F.lit(10))
