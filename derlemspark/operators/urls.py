"""URL operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFICE = r"\.(docx?|xlsx?|pptx?|zip|rar)$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def netloc(url: Column) -> Column:
    """Host with its port as written, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)


def normalize(url: Column) -> Column:
    """Fragment dropped, scheme and host in lower case, the slash at the end of a path dropped (the root keeps it)."""
    rest = path_query(url)
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    path = F.when(F.length(F.regexp_replace(path, "/+$", "")) > 0, F.regexp_replace(path, "/+$", "")).otherwise(F.lit("/"))
    return F.concat(scheme(url), F.lit("://"), netloc(url), path, query)


def allowed(url: Column, domains: list[str]) -> Column:
    """Whether the host (port included) is one of the domains or below one."""
    host, out = netloc(url), F.lit(False)
    for d in domains:
        out = out | (host == d) | F.endswith(host, F.lit("." + d))
    return out


def link_kind(href: Column, host: str) -> Column:
    """parent, anchor, pdf, doc, external or page."""
    low = F.lower(F.trim(href))
    clean = F.regexp_replace(low, r"[?#].*$", "")
    return (
        F.when(low.isNull() | (low == "") | F.startswith(low, F.lit("javascript:")), "parent")
        .when(F.startswith(low, F.lit("#")), "anchor")
        .when(F.endswith(clean, F.lit(".pdf")), "pdf")
        .when(F.regexp_like(clean, F.lit(OFFICE)), "doc")
        .when(F.contains(low, F.lit("/media/")) & F.contains(low, F.lit(".pdf")), "pdf")
        .when((netloc(low) != "") & (F.regexp_replace(netloc(low), r"^www\.", "") != host), "external")
        .otherwise("page")
    )


def slug_title(url: Column) -> Column:
    """Title from the last path segment: BirimX.aspx gives X, a number the segment before; signs to blanks, first letter in upper case."""
    path = F.regexp_replace(F.regexp_replace(path_query(url), r"\?.*$", ""), "/+$", "")
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    pick = F.when(F.regexp_like(last, F.lit("^[0-9]+$")) & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(last)
    unit = F.regexp_extract(pick, r"^Birim(.+)\.aspx$", 1)
    name = F.trim(F.regexp_replace(F.when(unit != "", unit).otherwise(F.regexp_replace(pick, r"\.[A-Za-z]+$", "")), "[-_]+", " "))
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def absolute(base: Column, href: Column) -> Column:
    """href as an address, read against the address of the page it stands on; . and .. are resolved, null stays null."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    rest = path_query(base)
    path = F.regexp_replace(rest, r"\?.*$", "")
    href = F.trim(href)
    joined = (
        F.when(F.regexp_like(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when((href == "") | F.startswith(href, F.lit("#")), F.concat(root, rest, href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path, href))
        .otherwise(F.concat(root, F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.lit("/")), href))
    )
    return without_dots(joined)


def without_dots(url: Column) -> Column:
    """A web address with the . and .. of its path resolved; .. above the root is dropped."""
    head = F.regexp_extract(url, "^((?:https?|ftp)://[^/?#]*)", 1)
    path, tail = F.regexp_extract(url, "^(?:https?|ftp)://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, "([?#].*)$", 1)
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == ".", kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(part)))

    solved = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    solved = F.when(last.isin(".", ".."), F.concat(solved, F.array(F.lit("")))).otherwise(solved)
    dotted = (head != "") & F.regexp_like(path, F.lit(r"(?:^|/)\.\.?(?:/|$)"))
    return F.when(dotted, F.concat(head, F.array_join(solved, "/"), tail)).otherwise(url)


def unwrapped(url: Column, viewer: str = "PdfViewer.aspx", parameter: str = "file") -> Column:
    """The file that a viewer page shows: the parameter, decoded and read against the viewer's folder; other addresses as they are."""
    path = F.regexp_replace(path_query(url), r"\?.*$", "")
    shown = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]+)", 1)
    folder = F.substring_index(url, viewer, 1)
    return F.when(F.contains(path, F.lit(viewer)) & (shown != ""), absolute(folder, F.url_decode(shown))).otherwise(url)
