"""Text decoded with the wrong character encoding.

An unknown code-page swap is treated as a substitution cipher. Words of rows that show strange signs are
cut into plain ASCII letters and runs of other signs; for each source (rows whose strange signs come from
the same block, as one swap leaves them) the letters that each run stands for are learned by expectation-
maximization against the letter bigrams of the clean rows. A word counts as garbled if the letters so
learned turn it into a word that clean rows have. The learned mapping, applied to every word of an affected
row, restores the text; signs that are no letters follow the code-page swap that the row's words show. All words
and contexts of the corpus count. The letters of each run are learned on the executors; the driver holds the
bigrams of single letters and pairs of letters only, whose number the alphabet bounds.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import guarded_join, hot_join
from ..session import reliable

#: Letters that correct Turkish text has besides ASCII, and signs that may stand next to words.
LETTERS = "çğıöşüâîûÇĞİÖŞÜÂÎÛ"
SIGNS = "“”‘’«»–—…•·©®°±µ€£§´¨"
#: A run of signs up to this long is learned as one, a longer one is read part by part; rows of clean text a word needs; least share of a mapping that is used.
MAX_RUN, MIN_CLEAN, MIN_MAPPING = 14, 2, 0.01
#: ASCII letters of a word whose contexts teach; words with fewer are read by what others taught.
MIN_LETTERS = 2
#: Letters that one part of a run stands for at most; share, and uses of the run, from which a part is taken for its letters without a clean word.
MAX_PART, SURE, MIN_SEEN = 2, 0.9, 5
# Code pages that swaps are looked for in.
PAGES = ("cp1252", "latin-1", "cp1254", "iso8859-9", "cp437", "cp850", "cp857", "mac_roman", "mac_turkish", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp1253", "utf-8")
#: Swaps that one row may have gone through.
MAX_SWAPS = 3
WRITTEN = ("utf-8", "cp1254", "iso8859-9", "cp857", "mac_turkish")
#: Source under which the runs of all sources are learned together, for sources that have few.
ALL = "*"
ROUNDS = 25

_STRANGE = rf"[^\x00-\x7f\s{LETTERS}{SIGNS}]"
_TURKISH = rf"[A-Za-z{LETTERS}]"
#: Rows without a match have no garbled word. Signs of the second kind count between letters only.
SUSPECT = re.compile(rf"{_STRANGE}|{_TURKISH}[{SIGNS}]{_TURKISH}|(?<![^\s]){'[' + SIGNS + ']'}{_TURKISH}|\w\?\w|(?<!\S)\?{_TURKISH}")
TOKEN = re.compile(rf"(?:[A-Za-z?]|[^\x00-\x7f\s])+")
CLEAN = re.compile(rf"[A-Za-z]*[{LETTERS}]{_TURKISH}*")
RUN = re.compile(r"(?:[^\x00-\x7f]|\?)+")
HURT = re.compile(rf"{_STRANGE}|[{SIGNS}?]")
EDGES = "?" + SIGNS
LOST = re.compile("[?\ufffd]")
#: Signs that stand by themselves are no word.
ONLY_SIGNS = re.compile(rf"[{SIGNS}?]+")
#: Runs of nothing but correct letters, or of correct signs, or with lost letters.
PLAIN = re.compile(rf"[{LETTERS}{SIGNS}A-Za-z›‹™\xa0 ]+")
RIGHT = re.compile(rf"[{LETTERS}]+|[{SIGNS}]+|.*[?\ufffd].*")


def block(sign: str) -> str:
    """Name of the block a strange sign comes from."""
    n = ord(sign)
    if sign == "?" or n == 0xFFFD:
        return "lost"
    return "control" if n < 0xA0 else "latin" if n < 0x250 else f"u{n >> 7:x}"


def source_of(text: str) -> str:
    """Block of most of a text's strange signs; two signs for each letter (as UTF-8 leaves) are told apart from one."""
    signs = re.findall(_STRANGE, text)
    if not signs:
        return "lost" if re.search(r"\w\?\w|(?<!\S)\?\w", text) else "signs"
    name = Counter(map(block, signs)).most_common(1)[0][0]
    runs = re.findall(rf"[^\x00-\x7f\s]+", text)
    return f"{name}:{min(4, round(sum(map(len, runs)) / len(runs)))}"


def key_of(word: str) -> str:
    """The word's ASCII letters in lower case with a star for each run of other signs."""
    return RUN.sub("*", word.lower() if word.isascii() else "".join(c.lower() if c.isascii() else c for c in word))


def contexts(word: str) -> list[tuple[str, str, str]]:
    """(letter before, run, letter after) of each run of a word; ^ and $ at its ends."""
    return [(word[m.start() - 1].lower() if m.start() else "^", m.group(), word[m.end()].lower() if m.end() < len(word) else "$") for m in RUN.finditer(word)]


def suspects(text: str) -> set[str]:
    """Words of a text that may be garbled, with and without signs at their ends."""
    out = set()
    for token in set(TOKEN.findall(text)):
        if token.isascii() and "?" not in token:
            continue
        out.update(form for form in {token, token.strip(EDGES), token.rstrip(EDGES)} if form and HURT.search(form) and not ONLY_SIGNS.fullmatch(form))
    return out


def teaches(word: str) -> bool:
    return sum(c.isascii() and c.isalpha() for c in word) >= MIN_LETTERS and all(len(r) <= MAX_RUN for r in RUN.findall(word))


def scan(texts: DataFrame) -> DataFrame:
    """One pass over tbl, rec_id, text: clean words (tbl null) with their rows, and suspect words of each row with its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        schema = ["tbl", "rec_id", "source", "word", "n"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for tbl, rec, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not text:
                    continue
                if SUSPECT.search(text) is None:
                    words.update(set(CLEAN.findall(text)))
                    continue
                found = suspects(text)
                if found:
                    source = source_of(text)
                    rows += [(tbl, rec, source, w, 1) for w in sorted(found)]
            if len(words) > 100_000:
                rows += [(None, None, None, w, n) for w, n in words.items()]
                words.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([None] * len(words), [None] * len(words), [None] * len(words), list(words), list(words.values())), kinds)], names=schema)

    return texts.select("tbl", "rec_id", "text").mapInArrow(run, "tbl string, rec_id bigint, source string, word string, n bigint")


class Bigrams:
    """Letters and pairs of letters of clean words with the letters before and after them; their number is bounded by the alphabet."""

    def __init__(self, before: Counter, after: Counter):
        """before, after: (letters, letter beside them) -> rows."""
        self.letters = sorted({x for x, _ in before})
        column = {x: i for i, x in enumerate(self.letters)}
        total = np.zeros(len(column))
        for (x, _), n in before.items():
            total[column[x]] += n
        self.prior = total / max(total.sum(), 1)
        size = max(len(column), 1)

        def table(counts: Counter) -> dict[str, np.ndarray]:
            rows: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(column)))
            for (x, c), n in counts.items():
                rows[c][column[x]] += n
            return dict(rows)

        none = np.zeros(len(column))
        self.before = {c: (row + 0.05 * self.prior) / (row.sum() + 0.05) for c, row in table(before).items()}
        self.after = {c: (row + 0.05 / size) / (total + 0.05) for c, row in table(after).items()}
        self.no_before, self.no_after = self.prior, (none + 0.05 / size) / (total + 0.05)

    def read(self, seen: list[tuple[str, str, int]], rounds: int = ROUNDS) -> dict[str, float]:
        """Letters -> probability for a run seen (before, after, n), by expectation-maximization."""
        if not self.letters:
            return {}
        weights = np.stack([self.before.get(b, self.no_before) * self.after.get(a, self.no_after) for b, a, _ in seen])
        weights[weights <= 1e-9] = 0
        n, share = np.array([n for _, _, n in seen], dtype=float), self.prior
        for _ in range(rounds):
            scored = weights * share
            z = scored.sum(1, keepdims=True)
            expected = n @ np.divide(scored, z, out=np.zeros_like(scored), where=z > 0)
            if not expected.sum():
                break
            share = expected / expected.sum()
            share = np.where(share > 1e-4, share, 0)
        return {self.letters[i]: float(share[i]) for i in np.flatnonzero(share >= MIN_MAPPING)}


def learn(clean: list[tuple], strange: list[tuple], rounds: int = ROUNDS) -> dict[tuple[str, str], dict[str, float]]:
    """(source, run) -> letters -> probability from rows (source, before, run, after, n) of clean and of strange words."""
    before, after = Counter(), Counter()
    for _, b, letters, a, n in clean:
        if len(letters) <= MAX_PART:
            before[letters, b] += n
            after[letters, a] += n
    bigrams = Bigrams(before, after)
    by_run: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for source, b, r, a, n in strange:
        by_run[source, r][b, a] += n
        by_run[ALL, r][b, a] += n
    return {pair: bigrams.read([(b, a, n) for (b, a), n in seen.items()], rounds) for pair, seen in by_run.items()}


def clean_bigrams(lexicon: DataFrame) -> Bigrams:
    """Bigrams of the clean words (word, n), counted on the executors: at most MAX_PART letters beside an ASCII letter reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b, letters, a in contexts(word):
                    if len(letters) <= MAX_PART:
                        seen["b", letters, b] += n
                        seen["a", letters, a] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], pa.string()) for i in range(3)] + [pa.array(list(seen.values()), pa.int64())], names=["side", "letters", "beside", "n"])

    counted = lexicon.select("word", "n").mapInArrow(run, "side string, letters string, beside string, n bigint").groupBy("side", "letters", "beside").agg(F.sum("n").alias("n"))
    before, after = Counter(), Counter()
    for side, letters, beside, n in counted.collect():
        (before if side == "b" else after)[letters, beside] += n
    return Bigrams(before, after)


def learned(words: DataFrame, bigrams: Bigrams) -> DataFrame:
    """source, run, letters, p, uses: what each run of the words (source, word, n) stands for, by source and for all sources together.

    A run's contexts are pairs of ASCII signs, so a group is bounded however often the run occurs.
    """
    shipped = words.sparkSession.sparkContext.broadcast(bigrams)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for source, word, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if teaches(word):
                    for b, r, a in contexts(word):
                        seen[source, r, b, a] += n
                        seen[ALL, r, b, a] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], pa.string()) for i in range(4)] + [pa.array(list(seen.values()), pa.int64())], names=["source", "run", "before", "after", "n"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, r, seen in zip(*(batch.column(k).to_pylist() for k in range(3))):
                uses = sum(c["n"] for c in seen)
                out += [(source, r, x, p, uses) for x, p in shipped.value.read([(c["before"], c["after"], c["n"]) for c in seen]).items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()))], names=["source", "run", "letters", "p", "uses"])

    seen = words.select("source", "word", "n").mapInArrow(spread, "source string, run string, before string, after string, n bigint")
    seen = seen.groupBy("source", "run", "before", "after").agg(F.sum("n").alias("n"))
    groups = seen.groupBy("source", "run").agg(F.sort_array(F.collect_list(F.struct("before", "after", "n"))).alias("seen"))
    return groups.mapInArrow(fit, "source string, run string, letters string, p double, uses bigint")


def aligned(word: str, clean: str) -> list[tuple[str, str]]:
    return list(zip(RUN.findall(word), RUN.findall(clean)))


def chance(mapping: dict[tuple[str, str], dict[str, float]], source: str, run: str, letters: str) -> float:
    """Probability that a run stands for letters: as learned for the source or for all sources, or part by part."""
    longest = max(map(len, (r for _, r in mapping)), default=0)

    def whole(part: str, x: str) -> float:
        return mapping.get((source, part), {}).get(x, 0.0) or mapping.get((ALL, part), {}).get(x, 0.0)

    @lru_cache(None)
    def best(at: int, done: int) -> float:
        if at == len(run) or done == len(letters):
            return float(at == len(run) and done == len(letters))
        p = whole(run[at:], letters[done:])
        if p:
            return p
        return max((whole(run[at:i], letters[done:j]) * best(i, j) for j in range(done + 1, min(done + MAX_PART, len(letters)) + 1) for i in range(at + 1, min(at + longest, len(run)) + 1)), default=0.0)

    return best(0, 0)


def best_reading(mapping: dict[str, tuple[str, float]], run: str) -> str | None:
    """What a run stands for by its most likely parts (part -> letters, p); None unless parts cover all of it."""
    longest = max(map(len, mapping), default=0)
    best: list[tuple[float, str] | None] = [(0.0, "")]
    for end in range(1, len(run) + 1):
        options = []
        for at in range(max(0, end - longest), end):
            known = mapping.get(run[at:end])
            if known and best[at]:
                options.append((best[at][0] - math.log(known[1]), best[at][1] + known[0]))
        best.append(min(options, default=None))
    return best[-1][1] if best[-1] and run else None


def fitting(mapping: dict[tuple[str, str], dict[str, float]], source: str, word: str, clean: str) -> float:
    """Log probability of reading word as clean; minus infinity if the mapping doesn't allow it or nothing changes."""
    score, changed = 0.0, False
    for run, letters in aligned(word, clean):
        if run == letters:
            continue
        p = chance(mapping, source, run, letters)
        if p == 0.0:
            return -math.inf
        score += math.log(p)
        changed = True
    return score if changed else -math.inf


def keyed(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns, F.lower(F.regexp_replace("word", r"(?:[^\x00-\x7f]|\?)+", "*")).alias("key"))


def differing(pairs: DataFrame) -> DataFrame:
    """source, word, clean, n, run, letters, runs: the runs in which a word differs from a clean one, and how many those are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, runs, letters, counts = [], [], [], []
            for i, (word, clean) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                different = {p for p in aligned(word, clean) if p[0] != p[1]}
                for r, x in sorted(different):
                    at.append(i)
                    runs.append(r)
                    letters.append(x)
                    counts.append(len(different))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(4)), pa.array(runs, pa.string()), pa.array(letters, pa.string()), pa.array(counts, pa.int64())], names=["source", "word", "clean", "n", "run", "letters", "runs"])

    return pairs.select("source", "word", "clean", "n").mapInArrow(run, "source string, word string, clean string, n bigint, run string, letters string, runs bigint")


def part_rows(needed: DataFrame, mapping: DataFrame, on_letters: bool) -> DataFrame:
    """source, run, (letters,) known: what the mapping has on the parts of each run, for its source and for all sources."""
    columns = ["source", "run"] + (["letters"] if on_letters else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whose, parts, texts = [], [], [], []
            for i, (source, r) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x = batch.column(2)[i].as_py() if on_letters else ""
                for part in {r[a:b] for a in range(len(r)) for b in range(a + 1, min(len(r), a + MAX_RUN) + 1)}:
                    for text in {x[a:b] for a in range(len(x)) for b in range(a + 1, min(len(x), a + MAX_PART) + 1)} or {""}:
                        for owner in (source, ALL):
                            at.append(i)
                            whose.append(owner)
                            parts.append(part)
                            texts.append(text)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(columns))), pa.array(whose, pa.string()), pa.array(parts, pa.string()), pa.array(texts, pa.string())], names=[*columns, "owner", "part", "text"])

    spread = needed.select(*columns).mapInArrow(run, ", ".join(f"{c} string" for c in [*columns, "owner", "part", "text"]))
    known = mapping.select(F.col("source").alias("owner"), F.col("run").alias("part"), F.col("letters").alias("text"), "p")
    if on_letters:
        met = guarded_join(spread, known, ["owner", "part", "text"])
    else:
        met = guarded_join(spread.drop("text"), known, ["owner", "part"])
    return met.groupBy(*columns).agg(F.sort_array(F.collect_list(F.struct("owner", "part", "text", "p"))).alias("known"))


@F.arrow_udf(T.DoubleType())
def chance_of(source: pa.Array, run: pa.Array, letters: pa.Array, known: pa.Array) -> pa.Array:
    out = []
    for s, r, x, rows in zip(source.to_pylist(), run.to_pylist(), letters.to_pylist(), known.to_pylist()):
        mapping: dict[tuple[str, str], dict[str, float]] = defaultdict(dict)
        for k in rows:
            mapping[k["owner"], k["part"]][k["text"]] = k["p"]
        out.append(chance(mapping, s, r, x))
    return pa.array(out, pa.float64())


def garbled_words(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tbl, rec_id, source, word, clean (the word restored) of every garbled word of every row; all suspect words; the learned mapping.

    Null and empty texts have none. Foreign words and signs stay: nothing learned turns them into a clean word.
    """
    seen = reliable(scan(texts))
    lexicon = reliable(seen.filter("tbl is null").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_CLEAN))
    rows = seen.filter("tbl is not null").drop("n")
    words = reliable(rows.groupBy("source", "word").agg(F.count(F.lit(1)).alias("n")))
    mapping = reliable(learned(words, clean_bigrams(lexicon)))
    pairs = hot_join(keyed(words, "source", "word"), keyed(lexicon, F.col("word").alias("clean"), "n"), ["key"])
    apart = reliable(differing(pairs))
    likely = part_rows(apart.select("source", "run", "letters").distinct(), mapping, True)
    likely = likely.select("source", "run", "letters", chance_of("source", "run", "letters", "known").alias("p")).filter("p > 0")
    scored = guarded_join(apart, likely, ["source", "run", "letters"])
    scored = scored.groupBy("source", "word", "clean").agg(F.count(F.lit(1)).alias("read"), F.max("runs").alias("runs"), F.max("n").alias("n"), F.round(F.sum(F.log("p")), 9).alias("score"))
    read = scored.filter("read = runs").groupBy("source", "word").agg(F.max_by("clean", F.struct("score", "n", "clean")).alias("clean"))
    return guarded_join(rows.select("tbl", "rec_id", "source", "word"), read, ["source", "word"]), rows, mapping


def swaps_of(known: dict[str, str]) -> list[tuple[str, str, int]]:
    """(page a text was read in, page it was written in, how often), fewest first, that explain known runs -> letters."""
    options = [(wrong, right, times) for times in (1, 2) for right in WRITTEN for wrong in PAGES if wrong != right and (times == 1 or right == "utf-8")]
    out, left = [], dict(known)
    while left and len(out) < MAX_SWAPS:
        explained = {swap: [r for r, x in left.items() if unswapped(r, swap) == x] for swap in options}
        best = max(options, key=lambda swap: len(explained[swap]))  # the first of equals
        if not explained[best]:
            break
        out.append(best)
        for r in explained[best]:
            del left[r]
    return out


def unswapped(run: str, swap: tuple[str, str, int]) -> str:
    """A run read again in the page it was written in; as it is where that fails."""
    text = run
    try:
        for _ in range(swap[2]):
            text = b"".join(bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 and swap[0] != "utf-8" else c.encode(swap[0]) for c in text).decode(swap[1])
    except UnicodeError:
        return run
    return text


def mended(word: str, clean: str) -> str:
    """The word with the runs of the clean one; its own ASCII letters stay as they are."""
    runs = iter(RUN.findall(clean))
    return RUN.sub(lambda m: next(runs, m.group()), word)


def restore(text: str, words: dict[str, str], runs: dict[str, str]) -> str:
    """A text with its garbled words restored, word by word, and other strange runs by the swaps that the words show, or as runs says.

    The swaps are those of the row's own words, so rows of one source may have different ones.
    """
    used: dict[str, str] = {}
    for whole in set(TOKEN.findall(text)):
        form = next((f for f in (whole, whole.strip(EDGES), whole.rstrip(EDGES)) if f and f in words), None)
        if form:
            used[whole] = form
    known = {r: x for form in used.values() for r, x in aligned(form, words[form]) if r != x and not LOST.search(r)}
    swaps = swaps_of(known)

    def sign(m: re.Match) -> str:
        run = m.group()
        if RIGHT.fullmatch(run):
            return run
        for swap in swaps:
            out = unswapped(run, swap)
            if out != run and PLAIN.fullmatch(out):
                return out
        return runs.get(run, run)

    def token(m: re.Match) -> str:
        whole = m.group()
        form = used.get(whole)
        if form is None:
            return RUN.sub(sign, whole)
        head, tail = whole.split(form, 1)
        return RUN.sub(sign, head) + mended(form, words[form]) + RUN.sub(sign, tail)

    return TOKEN.sub(token, text)


def restored(texts: DataFrame) -> DataFrame:
    """tbl, rec_id, text of the affected rows, restored: garbled words as their clean words, all other strange runs of
    these rows by the code pages that the row's words show, else by the mapping of their source, part by part.

    Signs that nothing explains, lost letters without a clean word among them, stay as they are.
    """
    words, rows, mapping = garbled_words(texts)
    words = reliable(words)
    affected = words.select("tbl", "rec_id").distinct()
    runs = guarded_join(rows, affected, ["tbl", "rec_id"], "left_semi").select("tbl", "rec_id", "source", F.explode(F.regexp_extract_all("word", F.lit(r"((?:[^\x00-\x7f]|\?)+)"), 1)).alias("run")).distinct()
    wrong = ~F.col("run").rlike(f"^(?:{RIGHT.pattern})$")
    runs = reliable(runs.filter(wrong))
    sure = mapping.filter((F.col("p") >= SURE) & (F.col("uses") >= MIN_SEEN) & wrong)
    known = part_rows(runs.select("source", "run").distinct(), sure, False)

    @F.arrow_udf("string")
    def reading(run: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for r, rows in zip(run.to_pylist(), parts.to_pylist()):
            table = {k["part"]: (k["text"], k["p"]) for k in sorted(rows, key=lambda k: k["owner"] != ALL)}  # the source's own over all sources'
            out.append(best_reading(table, r))
        return pa.array(out, pa.string())

    readings = known.select("source", "run", reading("run", "known").alias("text")).filter("text is not null")
    by_words = words.groupBy("tbl", "rec_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "clean"))).alias("words"))
    by_runs = guarded_join(runs, readings, ["source", "run"]).groupBy("tbl", "rec_id").agg(F.map_from_entries(F.collect_set(F.struct("run", "text"))).alias("runs"))
    by_row = by_words.join(by_runs, ["tbl", "rec_id"], "left")

    @F.arrow_udf("string")
    def mend(text: pa.Array, words: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([restore(t, dict(w), dict(r or ())) for t, w, r in zip(text.to_pylist(), words.to_pylist(), runs.to_pylist())], pa.string())

    return guarded_join(texts, by_row, ["tbl", "rec_id"]).select("tbl", "rec_id", mend("text", "words", "runs").alias("text"))
