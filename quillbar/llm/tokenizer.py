"""Encoding with a public byte-level BPE vocabulary by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens
by successive merge gadgets. It starts with one state in which every byte may
follow every byte. The gadget of the merge (u, v) -> w splits the state behind
u into a copy without an arc for v (u is never left standing before v), lets
every state that has an arc for u and from there one for v also have an arc for
w, and sends that arc to the state behind v. Copies share what they inherit: a
state is the one it was copied from, the moment of the copy, and the arcs cut
later, so a gadget costs constant time and space.

A text is split by the vocabulary's pattern, and each piece runs through a byte
table over this automaton. Every position of a piece is reached by exactly one
arc (the last token of that prefix), so what a prefix leaves open is a set of
arcs begun: the state each begins behind, and how far its label has been read.
These sets are the rows of the table: one look-up per byte gives the next row
and the label that ends there. Rows are compiled the first time a byte leads to
them; the table is dropped and begun again at ``ROWS`` rows, which changes no
result. Decoding emits the arc labels.

Defined results: null and empty texts have the empty list of ids; special
tokens are ordinary text; texts of any length are encoded whole; repeated texts
have equal ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies lie; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed pattern of the vocabulary that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to this length are kept with their ids; longer ones hardly repeat.
KEPT_LENGTH, KEPT_PIECES = 24, 200_000
#: Rows of the byte table and pairs of states that are kept compiled.
ROWS, PAIRS = 100_000, 2_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file:
    printable bytes stand for themselves, the rest for the letters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States are named by the token they stand behind."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]]) -> None:
        n = max(tokens.values()) + 1
        self.label = [b""] * n
        for t, i in tokens.items():
            self.label[i] = t
        self.born = [0] * n  # moment of the token's gadget; 0 for bytes
        self.left, self.right = [-1] * n, [-1] * n
        self.cut: dict[int, int] = {}  # (u, v) -> moment at which the arc for v behind u is cut
        self._open: dict[int, bool] = {}
        for moment, (u, v, w) in enumerate(merges, 1):
            self._gadget(moment, u, v, w)
        self._trie(tokens)
        self._clear()

    def _gadget(self, moment: int, u: int, v: int, w: int) -> None:
        self.cut.setdefault(u << 20 | v, moment)
        if not self.born[w]:
            self.born[w], self.left[w], self.right[w] = moment, u, v

    def _trie(self, tokens: dict[bytes, int]) -> None:
        self.goto: dict[int, int] = {}
        self.accept = [-1]
        for t, i in tokens.items():
            node = 0
            for b in t:
                k = node << 8 | b
                nxt = self.goto.get(k)
                if nxt is None:
                    nxt = self.goto[k] = len(self.accept)
                    self.accept.append(-1)
                node = nxt
            self.accept[node] = i

    def arc(self, x: int, y: int) -> bool:
        """Whether the state behind token x has an arc for token y."""
        key = x << 20 | y
        got = self._open.get(key)
        if got is None:
            if len(self._open) > PAIRS:
                self._open.clear()
            got = self._open[key] = self._walk(x, y)
        return got

    def _walk(self, x: int, y: int) -> bool:
        born, left, right, cut = self.born, self.left, self.right, self.cut
        until = len(self.label) + 1  # only gadgets before this moment count
        while True:
            if cut.get(x << 20 | y, until) < until:
                return False
            bx, by = born[x], born[y]
            if bx == by == 0:
                return True
            if bx > by:  # the state behind x is a copy, made at its gadget, of the one behind its right part
                x, until = right[x], bx
            else:  # the arc for y came with its gadget, where there was one for its left part
                if x == left[y] == right[y]:
                    return False  # of three equal tokens the first two merge
                y, until = left[y], by

    def _clear(self) -> None:
        """The byte table with its first row: nothing read, an arc may begin for any label."""
        self.table: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.rows: list[tuple[int, ...]] = [(0,)]
        self.row_of: dict[tuple[int, ...], int] = {(0,): 0}

    def _compile(self, row: int, byte: int) -> int:
        """The row a byte leads to. An arc begun is (state + 1) << 24 | position in the trie of labels; state 0 is the start of the piece."""
        goto, accept, arc = self.goto, self.accept, self.arc
        begun, ends = [], -1
        for a in self.rows[row]:  # the longest label comes first, and only one can end here
            x, node = a >> 24, goto.get((a & 0xFFFFFF) << 8 | byte, -1)
            if node < 0:
                continue
            t = accept[node]
            if t >= 0 and ends < 0 and (not x or arc(x - 1, t)):
                ends = t
            begun.append(x << 24 | node)
        if ends >= 0:
            begun.append((ends + 1) << 24)
        key = (ends, *begun)
        new = self.row_of.get(key)
        if new is None:
            new = self.row_of[key] = len(self.rows)
            self.rows.append(tuple(begun))
            self.ends.append(ends)
        self.table[row << 8 | byte] = new
        return new

    def run(self, piece: bytes) -> list[int]:
        """Labels of the one path that spells the piece."""
        if len(self.rows) > ROWS:
            self._clear()
        table, ends, row = self.table, self.ends, 0
        last = [-1]
        for byte in piece:
            new = table.get(row << 8 | byte)
            row = self._compile(row, byte) if new is None else new
            last.append(ends[row])
        out, j = [], len(piece)
        while j:
            t = last[j]
            out.append(t)
            j -= len(self.label[t])
        out.reverse()
        return out


class Encoder:
    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        import regex

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        tokens = {raw(s): i for s, i in model["vocab"].items()}
        merges = []
        for m in model["merges"]:
            a, b = (raw(s) for s in (m.split(" ") if isinstance(m, str) else m))
            merges.append((tokens[a], tokens[b], tokens[a + b]))
        self.automaton = Automaton(tokens, merges)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known, add = self.known, out.extend
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.automaton.run(piece.encode("utf-8", "replace")))
                if len(piece) <= KEPT_LENGTH:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    known[piece] = ids
            add(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        label = self.automaton.label
        return b"".join(label[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """The compiled encoder of this process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row, where it is scanned: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for t in b.column(1):
                flat += enc.encode(t.as_py())
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens of every row; the ids stay on the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = pa.array([len(enc.encode(t.as_py())) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*keep, "n_tokens"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, n_tokens bigint")
