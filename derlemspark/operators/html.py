"""HTML extraction: regular markup by Catalyst regular expressions, selectors by an Arrow UDF over html.parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is never content.
DROPPED = ("script", "style", "nav", "footer", "header", "noscript", "iframe", "svg")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def unescape(text: Column) -> Column:
    for sign, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def clean(html: Column) -> Column:
    """Text of a page: dropped elements out, tags to line breaks, entities decoded, white space collapsed."""
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    text = unescape(F.regexp_replace(html, r"(?s)<[^>]*>", "\n"))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_tag(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(F.trim(unescape(F.regexp_replace(inner, r"(?s)<[^>]*>", " "))), F.lit(""))


class _Tree(HTMLParser):
    """Elements as [tag, attributes, children]; text as strings."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def matches(node: list, selector: str) -> bool:
    """tag, .class, #id or tag.class / tag#id."""
    for sign, key in (("#", "id"), (".", "class")):
        if sign in selector:
            tag, value = selector.split(sign, 1)
            return (not tag or node[0] == tag) and value in node[1].get(key, "").split()
    return node[0] == selector


def find(node: list, selector: str) -> list | None:
    for child in node[2]:
        if isinstance(child, list):
            if matches(child, selector):
                return child
            deeper = find(child, selector)
            if deeper is not None:
                return deeper
    return None


def text_of(node: list, dropped: tuple[str, ...]) -> str:
    out: list[str] = []

    def walk(n: list) -> None:
        for child in n[2]:
            if isinstance(child, str):
                out.append(child)
            elif not any(matches(child, d) for d in dropped):
                walk(child)

    walk(node)
    return "\n".join(x for x in (" ".join(part.split()) for part in "\n".join(out).split("\n")) if x)


def main_text(html: str | None, regions: tuple[str, ...], dropped: tuple[str, ...]) -> str | None:
    """Text of the first region that a page has, without the dropped elements; the whole page without a region."""
    if html is None:
        return None
    root = _Tree(html).root
    region = next((r for r in (find(root, s) for s in regions) if r is not None), root)
    return text_of(region, dropped)


def main_text_column(html: Column, regions: tuple[str, ...], dropped: tuple[str, ...]) -> Column:
    @F.arrow_udf(T.StringType())
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(h, regions, dropped) for h in pages.to_pylist()], pa.string())

    return run(html)


def menu_items(html: str | None, depth: int = 0) -> list[tuple[int, str, str]] | None:
    """(level, title, href) of the list items of a page's first navigation list, in document order."""
    if html is None:
        return None
    root = _Tree(html).root
    out: list[tuple[int, str, str]] = []

    def walk(node: list, level: int) -> None:
        for child in node[2]:
            if not isinstance(child, list):
                continue
            if child[0] == "li":
                link = find(child, "a")
                title = text_of(link, ()) if link else text_of(child, ("ul",)).split("\n")[0]
                out.append((level, title, link[1].get("href", "") if link else ""))
            walk(child, level + (child[0] == "ul" and node[0] == "li"))

    nav = find(root, "nav") or find(root, "ul")
    if nav is not None:
        walk(nav, 0)
    return out


MENU = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("href", T.StringType())]))


@F.arrow_udf(MENU)
def menu_column(pages: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string()), ("href", pa.string())]))
    return pa.array([None if m is None else [{"level": a, "title": b, "href": c} for a, b, c in m] for m in map(menu_items, pages.to_pylist())], kind)


def link_list(html: Column) -> Column:
    """array<struct<pos, href, label>> of the links of a page, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(
        tags,
        lambda a, i: F.struct(i.alias("pos"), F.regexp_extract(a, r"(?i)href=\"([^\"]*)\"", 1).alias("href"), F.trim(F.regexp_replace(a, r"(?s)<[^>]*>", " ")).alias("label")),
    )
