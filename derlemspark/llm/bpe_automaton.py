"""Byte-pair encoding by a tokenization automaton.

The merges are compiled in rank order: each merge adds a gadget that removes, from every state entered
with its left part as live right edge, the arcs whose token starts with its right part as live left edge
(Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA", 2024). What is left accepts
exactly the correct tokenizations. Composed with the tokens' byte trie and made deterministic state by
state, as texts need it, this gives a table (state, byte) -> state. Each state carries the one token that
ends there in a correct tokenization of the bytes read so far; the arcs' labels, read backwards, are the
encoding of a word, and the labels' bytes in order are its decoding.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 1 << 40
#: Cached words of one Python worker; the cache is emptied when it is full.
CACHE_WORDS = 300_000
#: States of the byte automaton of one worker, emptied likewise.
MAX_STATES = 400_000
#: Fixed value: the published pre-split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable Latin-1 as itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_merges(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Ids of the tokens and the merges in rank order, from a byte-level BPE file in JSON."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {raw(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}, [(raw(a), raw(b)) for a, b in merges]


class Automaton:
    """Encoder and decoder of one byte-level BPE vocabulary."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids, self.bytes_of = ids, {i: t for t, i in ids.items()}
        rank = {bytes([b]): -1 for b in range(256)}
        left: dict[bytes, bytes] = {}
        right: dict[bytes, bytes] = {}
        self.gadgets: dict[bytes, list[tuple[bytes, int]]] = defaultdict(list)
        for r, (a, b) in enumerate(merges):
            self.gadgets[a].append((b, r))
            if a + b not in rank:
                rank[a + b], left[a + b], right[a + b] = r, a, b
        self.rank, self.left, self.right = rank, left, right
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[bytes | None] = [None]
        for token in rank:
            if token in ids:
                node = 0
                for byte in token:
                    step = self.trie[node].get(byte)
                    if step is None:
                        step = self.trie[node][byte] = len(self.trie)
                        self.trie.append({})
                        self.ends.append(None)
                    node = step
                self.ends[node] = token
        self.removed: dict[bytes, dict[bytes, list[int]]] = {}
        self.left_edges: dict[bytes, list[tuple[bytes, int, int]]] = {}
        self.reset()
        self.pattern = regex.compile(PATTERN)
        self.chunks = regex.compile(r"\s*\S+|\s+")
        self.inner_blank = regex.compile(r"\s (?!\S)")
        self.cache: dict[str, list[int]] = {}

    def reset(self) -> None:
        """Start the byte automaton anew with its initial state."""
        self.table: list[dict[int, int]] = [{}]
        #: of each state: live (token state at its start, trie node), the token ending there, its length
        self.live: list[tuple[tuple[bytes | None, int], ...]] = [((None, 0),)]
        self.label: list[tuple[int, int]] = [(-1, 0)]
        self.known: dict[tuple, int] = {}

    def _removed_arcs(self, token: bytes) -> dict[bytes, list[int]]:
        """Gadgets of the merges that meet a live right edge of the token: right part -> ranks."""
        arcs = self.removed.get(token)
        if arcs is None:
            arcs, edge, dies = defaultdict(list), token, NEVER
            while edge is not None:
                born = self.rank[edge]
                for other, r in self.gadgets.get(edge, ()):
                    if born < r < dies:
                        arcs[other].append(r)
                dies, edge = born, self.right.get(edge)
            self.removed[token] = arcs
        return arcs

    def _edges(self, token: bytes) -> list[tuple[bytes, int, int]]:
        """(part, rank it is made at, rank it is used up at) along the token's left edge."""
        edges = self.left_edges.get(token)
        if edges is None:
            edges, edge, dies = [], token, NEVER
            while edge is not None:
                edges.append((edge, self.rank[edge], dies))
                dies, edge = self.rank[edge], self.left.get(edge)
            self.left_edges[token] = edges
        return edges

    def allowed(self, first: bytes | None, second: bytes) -> bool:
        """Whether the arc from the state of first by second is left after all gadgets."""
        if first is None:
            return True
        arcs = self._removed_arcs(first)
        return not any(born < r <= dies for part, born, dies in self._edges(second) if part in arcs for r in arcs[part])

    def _step(self, state: int, byte: int) -> int:
        moved, done, size = [], None, 0
        for start, node in self.live[state]:
            to = self.trie[node].get(byte)
            if to is not None:
                moved.append((start, to))
                token = self.ends[to]
                if token is not None and done is None and self.allowed(start, token):
                    done, size = token, len(token)
        key = (tuple(moved), done)
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.table)
            self.table.append({})
            self.live.append((*moved, (done, 0)) if done is not None else tuple(moved))
            self.label.append((self.ids[done] if done is not None else -1, size))
        self.table[state][byte] = to
        return to

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        table, state, path = self.table, 0, []
        for byte in word.encode("utf-8", "replace"):
            nxt = table[state].get(byte)
            state = self._step(state, byte) if nxt is None else nxt
            path.append(state)
        out, at = [], len(path)
        while at:
            token, size = self.label[path[at - 1]]
            out.append(token)
            at -= size
        out.reverse()
        if len(table) > MAX_STATES:
            self.reset()
        return out

    def _chunk(self, chunk: str) -> list[int]:
        runs = self.chunks.findall(chunk)
        if len(runs) > 1:  # line breaks within: look up each run with the white space before it
            get, one = self.cache.get, self._chunk
            return [i for r in runs for i in (get(r) or one(r))]
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        out = [i for word in self.pattern.findall(chunk) for i in self.encode_word(word)]
        if len(chunk) <= 64:
            self.cache[chunk] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; an empty list for an empty or null text.

        A pre-split word starts at every blank before a non-space and at every first space of a run,
        so what stands between such places is looked up as a whole. Texts with blanks inside longer
        runs of white space are cut at the starts of runs only.
        """
        if not text:
            return []
        get, chunk = self.cache.get, self._chunk
        if self.inner_blank.search(text):
            return chunk(text)
        runs = text.replace(" ", "\x00 ").split("\x00") if "\x00" not in text else [text]
        if not runs[0]:
            del runs[0]
        return list(chain.from_iterable([get(c) or chunk(c) for c in runs]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the labels' bytes in order, read as UTF-8."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_workers: dict[int, Automaton] = {}


def encode_column(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """id, ids (array of int) of every row; empty for empty and null texts. No shuffle.

    The vocabulary (a file of fixed size) is read on the driver and sent once to each executor.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_merges(path))
    key = hash(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _workers.get(key)
        if machine is None:
            machine = _workers[key] = Automaton(*model.value)
        for batch in batches:
            found = [machine.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(f) for f in found], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
