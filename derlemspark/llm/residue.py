"""Template residue, filler and error-page text.

Unfilled placeholders are found by one grammar for each kind of delimiter, in the whole visible text;
those inside code blocks, quotations and explanations of templates are discounted by the words around them
and by how densely the page explains such things. Filler, error messages, script notices and announcements
count only where they are all that a page has besides its furniture.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from re import _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import body

try:
    import ahocorasick
except ImportError:  # one search for each string instead of one pass for all
    ahocorasick = None


class Finder:
    """Finds where any of many strings ends in a text, in one pass."""

    def __init__(self, strings: list[str]):
        self.strings = [x for x in dict.fromkeys(strings) if x]
        self.machine = None
        if ahocorasick:
            self.machine = ahocorasick.Automaton()
            for x in self.strings:
                self.machine.add_word(x, x)
            self.machine.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[int, str]]:
        """(place of the last letter, string) of every occurrence; without the automaton in no order."""
        if self.machine is not None:
            return self.machine.iter(text)
        return ((m.end() - 1, x) for x in self.strings if x in text for m in re.finditer(re.escape(x), text))


NAME = r"[A-Za-zÇĞİÖŞÜçğıöşü][\w.\-]{0,60}"
# Grammars of unfilled placeholders by delimiter.
GRAMMARS = {
    "braces": rf"\{{\{{[-~]?\s*[#/^>&!]?\s*{NAME}(?:\s*\|[^{{}}\n]{{1,60}})?\s*[-~]?\}}\}}|\{{%[-~]?\s*[^%{{}}\n]{{1,80}}?\s*[-~]?%\}}|\{{#\s*{NAME}\s*#\}}",
    "dollar": rf"\$\{{\s*{NAME}\s*\}}|\$\(\s*{NAME}\s*\)",
    "percent": rf"%%\s*{NAME}\s*%%|%\({NAME}\)[sdifr]|(?<![\w%])%[A-Z][A-Z0-9_]{{2,40}}%(?![\w%])",
    "tag": rf"<%[=\-]?\s*[^%<>\n]{{1,80}}%>|<\?=?\s*(?:php\s+)?[^?<>\n]{{1,80}}\?>",
    "angle": r"<(?:[a-zçğıöşü]+(?:[_.][a-zçğıöşü]+)+|title|tarih|telefon|icerik|içerik|aciklama|açıklama|baslik|başlık|isim|adres|name|date|ad|soyad)>",
    "square": rf"\[\[\s*{NAME}\s*\]\]|\[\s*(?:INSERT|ENTER|YOUR|BURAYA|GİRİNİZ|EKLEYİN)\s[^\]\n]{{1,60}}\]|\[[^\]\n]{{1,60}}\s(?:buraya (?:yazılacak|gelecek|eklenecek|girilecek)|goes here|to be added)\]",
    "underscore": r"(?<![\w/])__[A-Za-zÇĞİÖŞÜçğıöşü][\w.]{0,60}?__(?!\w)",
    "hash": r"(?<![\w#&/])#[A-Za-zÇĞİÖŞÜçğıöşü][\wçğıöşü.]{1,40}#(?!\w)",
    "model": r"(?<![\w.])@(?:Model|ViewBag|ViewData)\.[\w.]+|\bMERGEFIELD\s+\w+(?:\s+\\\*\s*\w+)?|«\w+_\w+»",
    "values": r"\bundefined undefined\b|\bnull null\b|\bNaN\.NaN\.NaN\b|\bNaN[/:]NaN\b|\[object Object\]|\bInvalid Date\b",
    "blanks": r"\bX{2}\.X{2}\.(?:20)?X{2,4}\b|\bX{5,}\b|[\w ]{2,30}alanı: \.\.\.",
}
PLACEHOLDER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in GRAMMARS.items()))
#: A text without any of these signs has no placeholder.
OPENERS = ("{", "$", "%", "<", "[", "_", "#", "@", "«", "undefined", "null", "NaN", "Invalid Date", "MERGEFIELD", "XX", "alanı: ...")
#: The one of them that ends its placeholder instead of beginning it.
FIELD = OPENERS[-1]
_openers = Finder(OPENERS)
# Words by which a text explains or quotes a placeholder instead of leaving one unfilled.
EXPLAINS = re.compile(r"\bşablon (?:dili|motoru|değişken)|\byer ?tutucu|\bdeğişken(?:i|inin|leri)?\b|\bsözdizimi|\bplaceholder|\bvariable|\bsyntax|\btemplate (?:language|engine|variable)|\bPlatzhalter", re.IGNORECASE)
QUOTES = "\"'`“”‘’«»„"
FENCE = re.compile(r"^\s*(?:```|~~~)|</?(?:code|pre)\b", re.IGNORECASE)
#: So many explaining words on a page, for each placeholder, make it a tutorial.
TUTORIAL_DENSITY = 2.0

# Words of the usual filler text and of keyboard filler.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
MASH = frozenset("asdf asd qwe qwerty xxx aaa bbb zzz abc test deneme foo bar dummy".split())
# Messages that stand in the place of content.
NOTICES = {
    "filler": r"\b(?:örnek|sample|dummy|deneme|test) (?:metin|text|içerik|yazı|content)\b|(?:metin|içerik|yazı|bilgi|açıklama)\w* (?:buraya|bu alana) (?:eklen|yazıl|gel|gir)|buraya [^.\n]{0,60}(?:gelecek|yazılacak|eklenecek|giriniz|yazınız|ekleyin)|^yeni (?:paragraf|başlık|sayfa|metin|liste)$|düzenlemek için tıklayın|(?:alt )?başlık giriniz|^resim açıklaması$|^görsel açıklaması$|click (?:here )?to (?:add|edit)|(?:your )?(?:heading|title|text|content) goes here|(?:deneme|test) amaçlı (?:doldur|oluştur|gir)|^(?:test|deneme) sayfası\s*\d*\.?$|^(?:başlık|metin|paragraf|untitled|new page|add your text here)\s*\d*$|placeholder text",
    "error": r"http error \d{3}|^(?:error|hata)\s*(?:kodu)?\s*:?\s*\d{3}|\b[45]\d\d (?:bad gateway|not found|forbidden|internal server error|service unavailable|gateway time-?out)|internal server error|server error in|service (?:temporarily )?unavailable|access (?:is )?denied|permission denied|erişim engellendi|erişim yetkiniz|yetkiniz (?:bulunmamaktadır|yok)|request(?:ed)? (?:blocked|resource)|could not be (?:served|found)|support id|page (?:not found|cannot be found|could not be found)|seite (?:wurde )?nicht gefunden|(?:die )?angeforderte (?:adresse|seite)|existiert nicht|sayfa(?:ya|yı)? (?:bulunamadı|ulaşılamıyor|görüntülenemiyor)|(?:aradığınız|istediğiniz) (?:sayfa|içerik)|sunucu hatası|beklenmeyen (?:bir )?hata|bir hata oluştu|hata oluştu|veritabanı(?:na|) (?:bağlan|hata)|bağlanılamadı|timeout expired|connection (?:refused|timed out)|\b(?:warning|fatal error|parse error|notice): |failed to open stream|stack trace|traceback \(most recent|unhandled exception|exception (?:details|in)|oturum(?:unuz)?(?:un)? süresi (?:doldu|sona)|session (?:has )?expired|yeniden giriş yap|işlem no:|^nginx(?:/[\d.]+)?$|^apache(?:/[\d.]+)?|^iis\b|not found on this server|\(hata \d{3}\)|görüntülenecek kayıt (?:yok|bulunamadı)|kayıt bulunamadı|object reference not set|^at [\w.]+\(|no (?:records?|results?) found|^ref:? ?\d+$|^ray (?:id:? )?[0-9a-f]{8,}$|üzgünüz,",
    "script": r"(?:enable|activate|turn on|requires?|need) (?:javascript|scripts?|cookies)|(?:javascript|js|betik|script)[^.\n]{0,40}(?:etkinleştir|açınız|açın\b|desteği(?:ni)? (?:kapalı|açınız)|gerek(?:mektedir|li)|kapalı|devre dışı|aktif)|tarayıcınız(?:da|ın|ı)? [^.\n]{0,60}(?:desteklem|kapalı|güncelle|açınız|betik|js\b|javascript)|aktivieren sie|checking your browser|browser (?:is not supported|does not support)|javascript(?:'?[iı])? [^.\n]{0,30}(?:etkin|disabled|required)|sürüm [\d.]+ desteklenmiyor|version [\d.]+ is not supported|yükleniyor|loading\.\.\.|please wait|lütfen bekle|robot olmadığınızı|(?:not|are) a robot|verify (?:that )?you are human|doğrulayın[^.\n]{0,40}yönlendiril",
    "later": r"(?:yapım|yapılma|hazırlanma|yazılma|inşa|düzenleme|çalışma) aşamasında|under construction|coming soon|check back (?:later|soon)|(?:çok )?yakında (?:eklenecek|yayın|hizmet|sizler|burada|güncellen)|^yakında[.!…]*$|eklenecektir|içerik (?:hazırlanıyor|eklenecek)|bakım(?:dadır|dayız| çalışması yapılmaktadır)|hizmet vermeye devam edeceğiz|will (?:be|follow) (?:added|available|published|updated)? ?(?:soon|shortly)|in kürze|bu sayfa henüz|henüz (?:içerik|bilgi) (?:eklenmemiş|girilmemiş|bulunma)|to be announced|sayfa güncellenecektir|(?:burada|bu sayfada) yer alacaktır|burada (?:yayınlanacak|yayımlanacak|duyurulacak)",
}


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern that stand outside of its groups."""
    out, depth, escaped, listed = [""], 0, False, False
    for c in pattern:
        if not escaped and not listed and c in "()":
            depth += 1 if c == "(" else -1
        if c == "|" and not depth and not escaped and not listed:
            out.append("")
            continue
        out[-1] += c
        listed = not escaped and (c == "[" or (listed and c != "]"))
        escaped = c == "\\" and not escaped
    return out


def needed(pattern) -> tuple[str, ...]:
    """Strings of which every match of a pattern (as parsed) has one; none if nothing can be told."""
    found, run = [], ""
    for op, value in [*pattern, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append((run,))
        run = ""
        if op is _constants.SUBPATTERN:
            found.append(needed(value[3]))
        elif op is _constants.BRANCH:
            each = [needed(x) for x in value[1]]
            found.append(tuple(y for x in each for y in x) if all(each) else ())
    return max(found, key=lambda x: (min(map(len, x), default=0), -len(x)), default=())


#: (kind, strings of which a match must have one, pattern) of each notice: the strings keep the patterns away from most lines.
RULES = [(kind, needed(_parser.parse(p)), re.compile(p, re.IGNORECASE)) for kind, whole in NOTICES.items() for p in alternatives(whole)]
#: (string, kind, pattern): one entry for each needed string.
TRIGGERS = [(x, kind, pattern) for kind, strings, pattern in RULES for x in strings or ("",)]
_ALWAYS = [t for t in TRIGGERS if not t[0]]
_triggers = Finder([t[0] for t in TRIGGERS])
#: A line up to this length is a notice as a whole, a longer one sentence by sentence; a page of which this share is residue is residue.
NOTICE_CHARS, RESIDUE_SHARE = 220, 0.8
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)")


def fenced_spans(text: str) -> list[tuple[int, int]]:
    """Places of the lines of code blocks, their fences included."""
    out, fenced, at = [], False, 0
    for line in text.split("\n"):
        mark = FENCE.search(line)
        if mark or fenced:
            out.append((at, at + len(line)))
        if mark and (line.count("```") % 2 or line.count("~~~") % 2):
            fenced = not fenced
        at += len(line) + 1
    return out


def starts(text: str) -> list[int]:
    """Where a placeholder may begin, in order: at an opening sign, or some letters before one that ends a form field."""
    found = set()
    for at, sign in _openers(text):
        first = at - len(sign) + 1
        found.update(range(max(0, first - 30), first) if sign == FIELD else (first,))
    return sorted(found)


def placeholders(text: str) -> list[tuple[str, str]]:
    """(delimiter, placeholder) of the unfilled placeholders of a text, explained and quoted ones left out."""
    places = starts(text)
    if not places:
        return []
    found, explaining, past, end, line, first = [], 0, -1, -1, "", 0
    fences = fenced_spans(text) if "```" in text or "~~~" in text or ("<" in text and FENCE.search(text)) else []
    for at in places:
        if at < past or any(i <= at < j for i, j in fences):
            continue
        if at > end:
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            first = text.rfind("\n", 0, at) + 1
            line = text[first:end]
        m = PLACEHOLDER.match(line, at - first)
        if m is None:
            continue
        past = first + m.end()
        before, after = line[max(0, m.start() - 40) : m.start()], line[m.end() : m.end() + 40]
        quoted = before.rstrip()[-1:] in QUOTES and after.lstrip()[:1] in QUOTES and before.strip() and after.strip()
        around = EXPLAINS.search(before) or EXPLAINS.search(after)
        if quoted or around:
            explaining += 1
        else:
            found.append((m.lastgroup, m.group()))
    return [] if explaining >= TUTORIAL_DENSITY * max(1, len(found)) else found


def filler_words(line: str) -> bool:
    """Whether a line is words of filler text or keyboard filler."""
    words = _WORD.findall(lowered(line))
    if not words:
        return False
    if sum(map(LOREM.__contains__, words)) >= max(3, 0.7 * len(words)):
        return True
    if len(words) < 3 or MASH.isdisjoint(words):
        return False
    return sum(w in MASH or w.isdigit() for w in words) >= 0.8 * len(words)


def triggers(low: str) -> list[tuple]:
    """The entries of TRIGGERS whose string a text in lower case has."""
    found = {string for _, string in _triggers(low)}
    return [t for t in TRIGGERS if t[0] in found] + _ALWAYS if found else _ALWAYS


def residue_kind(bare: str, possible: list[tuple] | None = None) -> str | None:
    """filler, error, script or later for a line or sentence, trimmed, that stands in the place of content."""
    low = lowered(bare)
    for string, kind, pattern in triggers(low) if possible is None else possible:
        if string in low and pattern.search(low):
            return kind
    return "filler" if filler_words(low) else None


def lowered(text: str) -> str:
    return text.replace("İ", "i").lower()


class Kinds(dict):
    """line -> (kind, characters of residue) of its notices: a short line as a whole, a long one sentence by sentence."""

    def __missing__(self, bare: str) -> tuple[str | None, int]:
        if len(self) >= body.CACHE // 10:
            self.clear()
        if len(bare) <= NOTICE_CHARS:
            kind = residue_kind(bare)
            value = (kind, len(bare) if kind else 0)
        else:
            parts = [(residue_kind(x), len(x)) for x in _SENTENCE.split(bare)]
            value = (next((k for k, _ in parts if k), None), sum(n + 1 for k, n in parts if k))
        self[bare] = value
        return value


_kinds = Kinds()


def surely_real(line: str, total: int) -> bool:
    """Whether the longest sentences of a line of running text alone show that a page of so many characters is no residue."""
    left = (1 - RESIDUE_SHARE) * total
    if len(line) <= max(left, NOTICE_CHARS):
        return False
    sentences = sorted(_SENTENCE.split(" ".join(line.split())), key=len, reverse=True)
    # mostly the first sentences that are longer than the bound together are real, and settle the matter
    first = bisect_right(list(accumulate(map(len, sentences))), left) + 1
    possible = triggers(lowered("\n".join(sentences[:first])))
    for at, x in enumerate(sentences):
        if residue_kind(x, possible if at < first else None):
            continue
        left -= len(x)
        if left < 0:
            return True
    return False


def page_residue(main: list[str], title: str | None, doubtful: list[str] = ()) -> str | None:
    """Kind of residue a page's main lines, its title line aside, consist of; None for real content.

    doubtful: furniture lines that are not strongly repeated; they count if nothing else is left.
    """
    name = " ".join(title.split()) if title else None
    lines = [x for x in (" ".join(m.split()) for m in main) if x]
    rest = [x for x in lines if not x.endswith(name)] if name else lines
    if not rest:
        return next((k for k in (_kinds[" ".join(d.split())][0] for d in doubtful) if k), None) or (_kinds[name][0] if name and name in lines else None)
    if surely_real(max(rest, key=len), sum(map(len, rest))):
        return None
    kinds = [_kinds[x] for x in rest]
    if not any(k for k, _ in kinds):
        return None
    if not name and len(rest) > 1 and kinds[0][0] is None:  # the first line may be the unnamed title
        rest, kinds = rest[1:], kinds[1:]
    return next((k for k, _ in kinds if k), None) if sum(n for _, n in kinds) >= RESIDUE_SHARE * sum(map(len, rest)) else None


def verdicts(texts: list[str | None], titles: list[str | None], pages: body.Pages, furniture: np.ndarray) -> list[str | None]:
    """Kind of residue for each text: placeholder, filler, error, script, later, or None."""
    lines, strong = pages.table.text, pages.structural // 440 % 3 == 2
    main = furniture <= 0.5
    lengths = pages.table.column("length")[pages.ids]
    totals = np.bincount(pages.page[main], lengths[main], minlength=len(texts)).tolist()
    order = np.flatnonzero(main)
    order = order[np.lexsort((-lengths[order], pages.page[order]))]  # each page's longest main line first
    heads = order[np.diff(pages.page[order], prepend=-1) != 0]
    longest = dict(zip(pages.page[heads].tolist(), pages.ids[heads].tolist()))
    out: list[str | None] = [None] * len(texts)
    open_: dict[int, tuple[list[str], list[str]]] = {}
    for i, text in enumerate(texts):
        if text and placeholders(text):
            out[i] = "placeholder"
        elif text:
            line, name = lines[longest[i]] if i in longest else "", titles[i]
            if not (surely_real(line, totals[i]) and not (name and " ".join(line.split()).endswith(" ".join(name.split())))):
                open_[i] = ([], [])
    for i, k, m, s in zip(pages.page.tolist(), pages.ids.tolist(), main.tolist(), strong.tolist()):
        if i in open_ and (m or not s):
            open_[i][0 if m else 1].append(lines[k])
    for i, (mine, doubtful) in open_.items():
        out[i] = page_residue(mine, titles[i], doubtful)
    return out


def classify(shared: DataFrame, model: body.BodyModel | None) -> DataFrame:
    """tbl, rec_id, residue for the rows of body.with_shares(): kind of residue, null for real content and empty texts."""
    shipped = shared.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in body.parts_of(batches):
            texts, titles = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            pages = body.Pages(texts, titles, batch.column(4), batch.column(5), [body.is_cut(t, b) for t, b in zip(texts, batch.column(6).to_pylist())])
            p = shipped.value.furniture(pages) if shipped.value else np.zeros(len(pages.ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts(texts, titles, pages, p), pa.string())], names=["tbl", "rec_id", "residue"])

    return shared.select("tbl", "rec_id", "text", "title", "strong", "weak", "preview").mapInArrow(run, "tbl string, rec_id bigint, residue string")
