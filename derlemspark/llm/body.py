"""Main body of web pages: a tree-structured graphical model over a page's lines.

The text of a page is read as a shallow document tree: the page, its blocks (runs of lines of one shape)
and their lines. Each node is main content or furniture. Line evidence comes from a logistic model over
hashed features (words, shape, place, relation to the title, share of the site's rows with that line);
parent-child potentials tie lines to their block and blocks to the page. Sum-product messages passed upward
and downward give each line's marginal. Evidence weights and potentials are trained on a bounded sample of
labelled pages; pages, counts and shares cover the whole corpus.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import guarded_join
from ..session import spread
from .site_lines import repeated_counts, site_of

#: Bound of the labelled sample, and the number of hashed features.
MAX_PAGES, DIMS = 3_000, 1 << 16
#: Shares of a site's rows from which a line counts as strongly or weakly repeated.
STRONG, WEAK, MIN_ROWS = 0.25, 0.02, 4
#: Bounds of what a worker keeps between batches: lines and their characters; pages that are read at once.
CACHE, CACHE_CHARS, PAGES = 100_000, 8_000_000, 1_000
#: Longer lines seldom return and aren't kept with their hashes.
KEPT_CHARS = 120
#: Weight in training of lines of pages without running text.
SHORT_WEIGHT = 4.0
#: Shape of running text.
LONG = 70

_ZEROS = re.compile(rb"00+")
_LOWER = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 if 28 <= b <= 31 else b for b in range(256))
_DATED = re.compile(r"0[./-]0[./-]0\s")
_PATH_TAIL = re.compile(r"\s[>›/]\s(?!.*\s[>›/]\s)\s*(\S.*)$")
_SEPARATORS = ("|", "»", "›", " > ", " / ", "©", "[")

# How furniture of Turkish and English web pages is worded; used to label the sample only.
_COOKIE = re.compile(r"\[[^\]\n]{2,40}\]\s*$")
_COOKIE_WORD = re.compile(r"çerez|cookie|kişisel veri|kvkk", re.IGNORECASE)
_PATH = re.compile(r"^(?:buradasınız|ana ?sayfa|home|you are here)\s*[:>»›/]", re.IGNORECASE)
_RELATED = re.compile(r"^(?:ilgili (?:haber|sayfa|içerik)|ilginizi çekebilir|bunu da okuyun|bunlara da bakın|ayrıca bakınız|related|see also|read also)\b", re.IGNORECASE)
_PAGER = re.compile(r"(?:geri|önceki|previous|«).*\|.*(?:sonraki|ileri|next|»)", re.IGNORECASE)
_LISTHEAD = re.compile(r"^(?:diğer (?:haberler|duyurular)|son (?:duyurular|haberler|eklenenler)|en çok okunanlar|yaklaşan etkinlikler|hızlı (?:bağlantılar|erişim)|popüler|latest|popular|quick links)\b", re.IGNORECASE)
_BYLINE = re.compile(r"^(?:haber|yazan|yazar|hazırlayan|fotoğraf(?:lar)?|editör|kaynak|by|photo(?:s)?)\s*:", re.IGNORECASE)
_SHARE = re.compile(r"paylaş|tweet|whatsapp|facebook|yazdır|share this", re.IGNORECASE)
_COUNTER = re.compile(r"^(?:görüntülenme|okunma(?: sayısı)?|son güncelleme|güncellenme tarihi|last updated?|views?)\b|\bdefa okundu\b", re.IGNORECASE)
_LEGAL = re.compile(r"^(?:©|copyright\b)|hakları? saklıdır|izinsiz alıntı|all rights reserved|aydınlatma metni|resmî belge niteliği|kurum sorumlu tutulamaz|santral:", re.IGNORECASE)
_ENTRY = re.compile(r"^[»›+–]\s+\S")
_DATED_ENTRY = re.compile(r"^\d{1,2}[./]\d{1,2}[./]\d{4}\s+\S.*[^.!?]$")


def skeleton(line: str) -> str:
    """ASCII of a line in lower case, digit runs as 0: the same whether or not its letters were decoded rightly."""
    raw = line.encode() if line.isascii() else " ".join(line.split()).encode("ascii", "ignore")
    raw = b" ".join(raw.translate(_LOWER, b"?").split())
    return (_ZEROS.sub(b"0", raw) if b"00" in raw else raw).decode("ascii")


def skeleton_hash(sk: str) -> int:
    return xxhash.xxh64_intdigest(sk) - (1 << 63)


class Lines(dict):
    """line -> its number; what is known of each different line, in lists and arrays by that number.

    Python runs once for a different line; lines that a worker meets again cost a look-up.
    """

    #: hash and length of the skeleton, codes of its first eight and last four letters, shape (0: white space), length of the line
    NUMBERS = ("hash", "size", "head", "tail", "shape", "length")

    def __init__(self):
        self.text: list[str] = []
        self.sk: list[str] = []
        self.path: dict[int, str] = {}
        self.chars = 0
        self._new: list[tuple] = []
        self._table = np.zeros((0, len(self.NUMBERS)), dtype=np.int64)

    def __missing__(self, line: str) -> int:
        at = self[line] = len(self.text)
        sk, bare = skeleton(line), line.strip()
        self.chars += len(line)
        self.text.append(line)
        self.sk.append(sk)
        self._new.append((skeleton_hash(sk) if sk else 0, len(sk), hash(sk[:8]), hash(sk[-4:]), shape(bare, sk) if bare else 0, len(bare)))
        if bare and (" > " in line or " › " in line or " / " in line):
            m = _PATH_TAIL.search(line)
            if m:
                self.path[at] = skeleton(m.group(1))
        return at

    def numbers(self, lines: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, lines), dtype=np.int64, count=len(lines))

    def column(self, name: str) -> np.ndarray:
        if self._new:
            self._table = np.concatenate([self._table, np.array(self._new, dtype=np.int64)])
            self._new = []
        return self._table[:, self.NUMBERS.index(name)]


_lines = Lines()


def known_lines() -> Lines:
    """The worker's table of lines; a new one when the last is full."""
    global _lines
    if len(_lines) > CACHE or _lines.chars > CACHE_CHARS:
        _lines = Lines()
    return _lines


class _Codes(dict):
    """feature -> its hashed number."""

    def __missing__(self, feature: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[feature] = _code(feature)
        return value


_codes = _Codes()


class _Hashes(dict):
    """line -> hash of its skeleton, 0 for signs only, None for white space."""

    def __missing__(self, line: str) -> int | None:
        if len(self) >= CACHE:
            self.clear()
        sk = skeleton(line)
        value = skeleton_hash(sk) if sk else 0 if line.strip() else None
        if len(line) <= KEPT_CHARS:
            self[line] = value
        return value


def line_rows(pages: DataFrame) -> DataFrame:
    """site, line_hash, n: rows of each site with each line, counted within a batch; a null hash counts the site's rows with text.

    pages: site, text. Rows without a site or text count for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _hashes.__getitem__
        for batch in batches:
            sites, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            number = {x: i for i, x in enumerate(dict.fromkeys(sites))}
            found = [list(map(get, t.split("\n"))) for t in texts]
            hashes = np.array([0 if h is None else h for row in found for h in row], dtype=np.int64)
            full = np.array([h is not None for row in found for h in row], dtype=bool)
            doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), dtype=np.int64, count=len(found)))[full]
            hashes = hashes[full]
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            once = np.ones(len(doc), dtype=bool)
            once[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            of = np.array([number[x] for x in sites], dtype=np.int64)
            hashes, site = hashes[once], of[doc[once]]
            order = np.lexsort((hashes, site))
            hashes, site = hashes[order], site[order]
            first = np.ones(len(site), dtype=bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (site[1:] != site[:-1])
            at = np.flatnonzero(first)
            names = pa.array(list(number), pa.string())
            lines = [names.take(pa.array(site[at])), pa.array(hashes[at]), pa.array(np.diff(np.r_[at, len(site)]))]
            rows = [names, pa.nulls(len(number), pa.int64()), pa.array(np.bincount(of, minlength=len(number)))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(lines, rows)], names=["site", "line_hash", "n"])

    return pages.filter("site is not null and text is not null").select("site", "text").mapInArrow(run, "site string, line_hash bigint, n bigint")


_hashes = _Hashes()


def _code(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % DIMS


def lexical(line: str, sk: str) -> list[int]:
    """Hashed features of a line by itself."""
    bare = line.strip()
    head, tail, n = sk.split(" ", 2), sk.rsplit(" ", 2), sk.count(" ") + 1
    first, last = bare[0], bare[-1]
    signs, ends = first if not first.isalnum() else "", last if not last.isalnum() else ""
    found = [
        "f1:" + head[0],
        "f2:" + " ".join(head[:2]),
        "l1:" + tail[-1],
        "l2:" + " ".join(tail[-2:]),
        f"n:{min(n, 12)}",
        f"c:{min(len(bare) // 12, 12)}",
        "e:" + (ends or ("0" if last.isdigit() else "a")),
        "s:" + (signs or ("0" if first.isdigit() else "A" if first.isupper() else "a")),
        "p:" + "".join(s.strip() for s in _SEPARATORS if s in bare),
        "b:" + (signs or "a") + (ends or "a") + str(min(n // 3, 5)),
    ]
    if _DATED.match(sk):
        found.append("dated:" + ("." if last == "." else ""))
    if len(sk) <= 48:
        found.append("L:" + sk)
    return [_codes[f] for f in found]


def shape(bare: str, sk: str) -> int:
    """Shape of a stripped line; lines of one shape next to each other form a block."""
    if _DATED.match(sk):
        return 1
    if not bare[0].isalnum() and bare[0] not in "\"“«([":
        return 2 + ord(bare[0]) % 61
    if len(bare) > 90 or bare[-1] in ".!?…":
        return LONG
    if "\t" in bare:
        return 71
    return 72 if len(bare) <= 30 else 73


def sets_of(column: pa.Array | list) -> list[bytes]:
    """Each row's hashes as bytes (nothing for null), to tell rows with equal sets."""
    if isinstance(column, list):
        column = pa.array(column, pa.list_(pa.int64()))
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    null = column.is_null().to_numpy(zero_copy_only=False)
    return [b"" if gone else values[i:j].tobytes() for i, j, gone in zip(offsets[:-1].tolist(), offsets[1:].tolist(), null.tolist())]


def among(hashes: np.ndarray, raw: bytes) -> np.ndarray:
    """Which hashes are in a set."""
    known = np.sort(np.frombuffer(raw, dtype=np.int64))
    if not len(known):
        return np.zeros(len(hashes), dtype=bool)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


class Pages:
    """Nodes of a batch of pages: one entry for each non-empty line, with its block and page.

    strong, weak: hashes of the lines repeated on each page's site; cut: whether its last line is cut off.
    """

    def __init__(self, texts: list[str | None], titles: list[str | None], strong: pa.Array | list, weak: pa.Array | list, cut: list[bool]):
        self.table = table = known_lines()
        split = [t.split("\n") if t else [] for t in texts]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        ids = table.numbers([x for lines in split for x in lines])
        page = np.repeat(np.arange(len(split)), counts)
        line_no = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        title_ids = table.numbers([t or "" for t in titles])
        full = table.column("shape")[ids] != 0
        self.ids, self.page, self.line_no = ids, page, line_no = ids[full], page[full], line_no[full].astype(np.int32)
        n = np.bincount(page, minlength=len(split))
        starts = np.cumsum(n) - n
        at = np.arange(len(ids)) - starts[page]
        form = table.column("shape")[ids]
        share = self._shares(strong, weak, starts, n)
        now = form * 2 + (share == 2)
        fresh = np.ones(len(ids), dtype=bool)
        fresh[1:] = (now[1:] != now[:-1]) | (page[1:] != page[:-1])
        self.block = np.cumsum(fresh) - 1
        ends = np.array(cut, dtype=bool) & (n > 0) if len(cut) else np.zeros(0, dtype=bool)
        self.cut_lines = set((starts + n - 1)[ends].tolist())
        relation = self._title_relations(title_ids)
        for k, kind in self._path_relations(starts, n).items():
            if relation[k] in (0, 3):
                relation[k] = kind
        long = np.bincount(page, form == LONG, minlength=len(split)) > 0
        low = np.where(np.array(cut, dtype=bool)[page] if len(page) else False, 10, np.minimum(n[page] - 1 - at, 9))
        self.structural = (((long[page] * 3 + share) * 4 + relation) * 10 + np.minimum(at, 9)) * 11 + low

    @property
    def lines(self) -> list[str]:
        return list(map(self.table.text.__getitem__, self.ids.tolist()))

    @property
    def skeletons(self) -> list[str]:
        return list(map(self.table.sk.__getitem__, self.ids.tolist()))

    def _shares(self, strong, weak, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """2 for lines among the strongly repeated ones of their site, 1 among the weakly repeated, else 0."""
        rows: dict[tuple[bytes, bytes], list[int]] = {}
        for i, pair in enumerate(zip(sets_of(strong), sets_of(weak))):
            rows.setdefault(pair, []).append(i)
        hashes, out = self.table.column("hash")[self.ids], np.zeros(len(self.ids), dtype=np.int64)
        for (s, w), pages in rows.items():
            if s or w:
                k = np.array(pages)
                size = n[k]
                where = np.repeat(starts[k] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                out[where] = np.where(among(hashes[where], s), 2, among(hashes[where], w))
        return out

    def _title_relations(self, title_ids: np.ndarray) -> np.ndarray:
        """1 for the title's line, 2 for a line that ends with the title, 0 for others, 3 on a page without a title."""
        table, mine = self.table, title_ids[self.page]
        size, tail, hashes = (table.column(k) for k in ("size", "tail", "hash"))
        named = size[mine] > 0
        out = np.where(named, 0, 3)
        out[named & (hashes[self.ids] == hashes[mine])] = 1
        maybe = named & (size[self.ids] > size[mine]) & ((tail[self.ids] == tail[mine]) | (size[mine] < 4))
        for k in np.flatnonzero(maybe).tolist():
            if table.sk[self.ids[k]].endswith(table.sk[mine[k]]):
                out[k] = 2
        return out

    def _path_relations(self, starts: np.ndarray, n: np.ndarray) -> dict[int, int]:
        """2 for a line that leads, after path signs, to another line of the page, 1 for the line it leads to in full."""
        table, out = self.table, {}
        if not table.path:
            return out
        head = table.column("head")[self.ids]
        leads = np.zeros(len(table), dtype=bool)
        leads[list(table.path)] = True
        for k in np.flatnonzero(leads[self.ids]).tolist():
            tail = table.path[int(self.ids[k])].rstrip(". " if k in self.cut_lines else " ")
            if len(tail) < 8:
                continue
            first = int(starts[self.page[k]])
            for other in (np.flatnonzero(head[first : first + int(n[self.page[k]])] == hash(tail[:8])) + first).tolist():
                sk = table.sk[self.ids[other]]
                if other != k and sk.startswith(tail):
                    out[k] = 2
                    if sk == tail:
                        out.setdefault(other, 1)
                    break
        return out


def structural_features(codes: np.ndarray) -> np.ndarray:
    """Hashed features of place, share, relation to the title and running text on the page: rows of seven."""
    low, rest = codes % 11, codes // 11
    top, rest = rest % 10, rest // 10
    relation, share, long = rest % 4, rest // 4 % 3, rest // 12
    base = np.array([_code(f"base{k}") for k in range(7)])
    return (np.stack([top, low, relation, share, share * 4 + relation, share * 110 + np.minimum(top, low), rest * 2 + long], 1) * 97 + base) % DIMS


def annotate(pages: Pages) -> np.ndarray:
    """1 for furniture, 0 for main content: labels of the sample by the wording and repetition of furniture."""
    codes = pages.structural // 110
    share, relation = codes // 4 % 3, codes % 4
    out, listed, last = np.zeros(len(pages.ids), dtype=np.int64), False, -1
    for i, line in enumerate(pages.lines):
        bare = " ".join(line.split())
        if pages.page[i] != last:
            last, listed = pages.page[i], False
        if listed and _DATED_ENTRY.match(bare):
            out[i] = 1
            continue
        listed = bool(_LISTHEAD.match(bare)) and len(bare) < 60
        if relation[i] == 1 and share[i] < 2:
            continue
        out[i] = (
            share[i] == 2
            or listed
            or bool(_PATH.match(bare) or _RELATED.match(bare) or _ENTRY.match(bare))
            or (relation[i] == 2 and any(s in bare for s in (" > ", " › ", " / ", " » ")))
            or (len(bare) < 260 and bool(_COOKIE.search(bare)) and bool(_COOKIE_WORD.search(bare) or "settings" in bare or "ayarlardan" in bare))
            or (len(bare) < 240 and bool(_PAGER.search(bare)))
            or (len(bare) < 110 and bool(_BYLINE.match(bare) or _COUNTER.search(bare) or (_SHARE.search(bare) and bare[-1] != ".")))
            or (len(bare) < 200 and bool(_LEGAL.search(bare)))
        )
    return out


class BodyModel:
    """Evidence weights and potentials; furniture() gives each line's marginal."""

    def __init__(self, weights: np.ndarray, bias: float, line_given_block: np.ndarray, block_given_page: np.ndarray, page_prior: np.ndarray, whole_lines: list[str]):
        self.weights, self.bias = weights, bias
        self.line_given_block, self.block_given_page, self.page_prior = line_given_block, block_given_page, page_prior
        #: furniture lines of the sample: a line cut by a preview is scored as the whole ones that begin with it
        self.whole_lines = whole_lines
        self._weights = weights.tolist()
        self._table: Lines | None = None
        self._known = np.zeros(0)
        whole = sorted((skeleton(x), x) for x in whole_lines)
        self._whole = [sk for sk, _ in whole]
        self._whole_scores = np.array([self._score(x, sk) for sk, x in whole])

    def __reduce__(self):
        return BodyModel, (self.weights, self.bias, self.line_given_block, self.block_given_page, self.page_prior, self.whole_lines)

    def _score(self, line: str, sk: str) -> float:
        return sum(map(self._weights.__getitem__, lexical(line, sk)))

    def _cut_score(self, line: str, sk: str) -> float:
        bare = line.rstrip().removesuffix("...")
        bare = bare if bare.strip() else line
        own = self._score(bare, skeleton(bare) or sk)
        begun = sk.rstrip(". ")
        i, j = bisect_left(self._whole, begun), bisect_left(self._whole, begun + "\x7f")
        return max(own, float(self._whole_scores[i:j].max())) if len(begun) > 2 and i < j else own

    def evidence(self, pages: Pages) -> np.ndarray:
        table, ids = pages.table, pages.ids
        if self._table is not table:
            self._table, self._known = table, np.zeros(0)
        known = self._known
        if len(known) < len(table):
            known = self._known = np.concatenate([known, np.full(len(table) - len(known), np.nan)])
        for i in np.unique(ids[np.isnan(known[ids])]).tolist():
            known[i] = self._score(table.text[i], table.sk[i])
        scores = known[ids]
        for i in pages.cut_lines:
            scores[i] = self._cut_score(table.text[ids[i]], table.sk[ids[i]])
        return scores + self.weights[structural_features(pages.structural)].sum(1) + self.bias

    def furniture(self, pages: Pages) -> np.ndarray:
        """Marginal probability that a line is furniture, by one upward and one downward pass of messages."""
        if not len(pages.ids):
            return np.zeros(0)
        u = np.clip(self.evidence(pages), -30, 30)
        first_line = np.r_[0, np.flatnonzero(np.diff(pages.block)) + 1]
        block_page = pages.page[first_line]
        first_block = np.r_[0, np.flatnonzero(np.diff(block_page)) + 1]
        pi, phi = self.line_given_block, self.block_given_page
        up = np.log(pi[:, 0][None, :] + pi[:, 1][None, :] * np.exp(u)[:, None])  # line -> block: lines x block states
        block_up = np.add.reduceat(up, first_line, axis=0)
        peak = block_up.max(1, keepdims=True)
        to_page = np.log(np.exp(block_up - peak) @ phi.T) + peak  # block -> page: blocks x page states
        page_up = np.log(self.page_prior)[None, :] + np.add.reduceat(to_page, first_block, axis=0)
        which_page = np.repeat(np.arange(len(first_block)), np.diff(np.r_[first_block, len(block_page)]))
        down_page = page_up[which_page] - to_page
        down_page = np.exp(down_page - down_page.max(1, keepdims=True))
        down = np.log(down_page @ phi)  # page -> block
        which_block = np.repeat(np.arange(len(first_line)), np.diff(np.r_[first_line, len(u)]))
        down_line = (down + block_up)[which_block] - up
        down_line = np.exp(down_line - down_line.max(1, keepdims=True))
        prior = down_line @ pi  # block -> line
        odds = u + np.log(prior[:, 1]) - np.log(prior[:, 0])
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def train(pages: Pages, labels: np.ndarray, steps: int = 150) -> BodyModel:
    """Logistic evidence by full-batch adaptive gradient steps, potentials by smoothed counts."""
    rows = [lexical(a, b) for a, b in zip(pages.lines, pages.skeletons)]
    n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    fixed = structural_features(pages.structural)
    feature = np.concatenate([np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(n.sum())), fixed.reshape(-1)])
    row = np.concatenate([np.repeat(np.arange(len(rows)), n), np.repeat(np.arange(len(rows)), fixed.shape[1])])
    y, w, seen = labels.astype(float), np.zeros(DIMS), np.full(DIMS, 1e-8)
    weight = np.where(pages.structural // 1320 == 0, SHORT_WEIGHT, 1.0)  # pages without running text are few
    bias = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[feature], len(rows)) + bias, -30, 30)))
        g = np.bincount(feature, (weight * (p - y))[row], DIMS) + 0.005 * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
        bias -= 0.3 * float((weight * (p - y)).mean())
    first = np.r_[0, np.flatnonzero(np.diff(pages.block)) + 1]
    size = np.diff(np.r_[first, len(y)])
    block_y = (np.add.reduceat(y, first) * 2 > size).astype(int)
    which = np.repeat(np.arange(len(first)), size)
    line = np.ones((2, 2)) + np.array([[((block_y[which] == s) & (labels == v)).sum() for v in (0, 1)] for s in (0, 1)])
    page_of = pages.page[first]
    starts = np.r_[0, np.flatnonzero(np.diff(page_of)) + 1]
    blocks = np.diff(np.r_[starts, len(first)])
    page_y = (np.add.reduceat(block_y.astype(float), starts) * 10 > 7 * blocks).astype(int)  # pages of mostly furniture blocks
    which_page = np.repeat(np.arange(len(starts)), blocks)
    block = np.ones((2, 2)) + np.array([[((page_y[which_page] == r) & (block_y == s)).sum() for s in (0, 1)] for r in (0, 1)])
    prior = np.array([1.0, 1.0]) + np.bincount(page_y, minlength=2)
    pi, phi = line / line.sum(1, keepdims=True), block / block.sum(1, keepdims=True)
    # the evidence already holds the classes' base rate: keep only what the parents add to it
    base = np.array([1 - y.mean(), y.mean()]).clip(1e-3)
    pi = pi / base
    whole = sorted({line for line, v in zip(pages.lines, labels) if v})
    return BodyModel(w, bias, np.clip(pi, 0.02, None), phi, prior / prior.sum(), whole)


def labelled_pages(rows: list, cut: bool = False) -> tuple[Pages, np.ndarray]:
    pages = Pages([r.text for r in rows], [r.title for r in rows], [r.strong for r in rows], [r.weak for r in rows], [cut] * len(rows))
    return pages, annotate(pages)


def with_shares(pages: DataFrame, corpus: DataFrame) -> DataFrame:
    """pages (tbl, rec_id, url, title, text) with strong and weak: hashes of the lines repeated on its site in corpus."""
    counted = line_rows(spread(corpus.select("url", "text")).select(site_of(F.col("url")).alias("site"), "text"))
    lines = repeated_counts(counted.groupBy("site", "line_hash").agg(F.sum("n").alias("n")), MIN_ROWS, WEAK)
    strong = F.collect_set(F.when(F.col("n") >= F.col("site_rows") * STRONG, F.col("line_hash")))
    by_site = lines.groupBy("site").agg(F.sort_array(strong).alias("strong"), F.sort_array(F.collect_set("line_hash")).alias("weak"))
    return guarded_join(pages.withColumn("site", site_of(F.col("url"))), by_site, ["site"], "left")


def fit(shared: DataFrame, total: int, limit: int = MAX_PAGES) -> BodyModel | None:
    """Model from at most ``limit`` pages (lowest id hashes) of the rows of with_shares(), ``total`` in number; None without text."""
    rows = shared.filter(F.length(F.trim("text")) > 0).select("rec_id", "text", "title", "strong", "weak")
    near = F.abs(F.xxhash64("rec_id", F.lit(3)) % 1_000_000) < int(min(1.0, limit / max(1, total) * 1.3) * 1_000_000) + 1
    sample = rows.filter(near).orderBy(F.xxhash64("rec_id", F.lit(3)), "rec_id").limit(limit).collect()
    if not sample:
        return None
    return train(*labelled_pages(sample))


def marked_lines(shared: DataFrame, model: BodyModel | None, what: str = "lines") -> DataFrame:
    """For rows of with_shares(): lines -> tbl, rec_id, line_no, furniture (marginal); bodies -> tbl, rec_id, body, n_lines, n_furniture.

    Null and empty texts have no lines; their body is null or empty. Without a model every line is content.
    """
    shipped = shared.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            texts = batch.column(2).to_pylist()
            pages = Pages(texts, batch.column(3).to_pylist(), batch.column(4), batch.column(5), [is_cut(t, b) for t, b in zip(texts, batch.column(6).to_pylist())])
            p = shipped.value.furniture(pages) if shipped.value else np.zeros(len(pages.ids))
            if what == "lines":
                at = pa.array(pages.page)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pages.line_no), pa.array(p)], names=["tbl", "rec_id", "line_no", "furniture"])
            else:
                bodies, n, gone = main_bodies(texts, pages, p)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.string()), pa.array(n), pa.array(gone)], names=["tbl", "rec_id", "body", "n_lines", "n_furniture"])

    schema = "tbl string, rec_id bigint, line_no int, furniture double" if what == "lines" else "tbl string, rec_id bigint, body string, n_lines int, n_furniture int"
    return shared.select("tbl", "rec_id", "text", "title", "strong", "weak", "preview").mapInArrow(run, schema)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = PAGES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def is_cut(text: str | None, preview: bool) -> bool:
    return bool(preview and text and len(text) >= 303 and text.endswith("..."))


def main_bodies(texts: list[str | None], pages: Pages, furniture: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Main text of each page (its content lines), its lines, and its furniture lines."""
    kept: list[list[str]] = [[] for _ in texts]
    main = furniture <= 0.5
    for i, line in zip(pages.page[main].tolist(), map(pages.table.text.__getitem__, pages.ids[main].tolist())):
        kept[i].append(line)
    n = np.bincount(pages.page, minlength=len(texts)).astype(np.int32)
    gone = n - np.array([len(k) for k in kept], dtype=np.int32) if texts else n
    return [None if t is None else "\n".join(k) for t, k in zip(texts, kept)], n, gone
