"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece the last token of its encoding is unique: it is the token that ends there and may follow
the last token of the prefix before it. An automaton over all tokens gives, in one walk over the piece, the tokens
that end at each byte; whether two tokens may stand side by side is decided from the merges alone. Back-pointers from
the last prefix give the ids, those of the merge procedure itself.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Entries that a worker keeps of pieces (in each of two generations) and of pairs. Longer pieces are not kept.
PIECES, PAIRS, PIECE_BYTES = 160_000, 300_000, 48

Ranges = list[tuple[int, int]]


def _ranges(points: Iterator[int]) -> Ranges:
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


@cache
def character_classes() -> tuple[Ranges, Ranges]:
    """Ranges of letters and of numbers, of the Unicode version by which the tokenizers library splits texts.

    Categories come from unicodedata. Code points that it does not know yet are put to the library's splitter, in
    the four planes where any are assigned. The driver does this once and hands the ranges to the workers.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
    new = [c for c in range(0x40000) if kinds[c] == "Cn"]
    for kind, probe in (("L", "a"), ("N", "1")):
        starts = {at for _, (at, _) in ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f"\n{probe}{chr(c)}" for c in new))}
        for i, c in enumerate(new):
            if 3 * i + 2 not in starts:
                kinds[c] = kind
    return tuple(_ranges(c for c, k in enumerate(kinds) if k[0] == x) for x in "LN")


#: White space as the split of byte-level BPE knows it, Unicode's White_Space property.
SPACES: Ranges = [(9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


def split_pattern(letters: Ranges, numbers: Ranges, top: int) -> re.Pattern:
    """The split of byte-level BPE before its merges, for texts of code points under top."""
    x = lambda ranges: "".join(f"\\U{a:08x}-\\U{min(b, top - 1):08x}" for a, b in ranges if a < top)
    s, n, p = x(letters), x(numbers), x(SPACES)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{s}]+| ?[{n}]+| ?[^{p}{s}{n}]+|[{p}]+(?![^{p}])|[{p}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files: printable Latin-1 as itself, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Encoder:
    """Tables of one vocabulary file, and the encoder and decoder over them."""

    def __init__(self, path: str, letters: Ranges, numbers: Ranges) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model, alphabet = given["model"], byte_alphabet()
        raw = lambda t: bytes(alphabet[c] for c in t)
        vocab = model["vocab"]
        self.bytes = {i: raw(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split, self.split_all = split_pattern(letters, numbers, 0x10000), split_pattern(letters, numbers, 0x110000)
        n = max(self.bytes) + 1
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n  # rank: when the merge that makes a token runs
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = vocab[x], vocab[y], vocab[x + y]
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, a, b
            self.merged.setdefault((a, b), r)
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes.items():
            if i not in self.special.values() and (len(b) == 1 or self.rank[i] >= 0):
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.table = [self.bytes.get(i, b"") for i in range(n)]
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """The merges of a's and b's bytes together end in the tokens a and b.

        Going back in time, the seam lies between a token on a's right edge and one on b's left edge. They fail if
        the merge of such two would run before either grows further; of equal merges the left one runs first.
        """
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        until_a = until_b = 1 << 60
        while True:
            r = merged.get((a, b))
            if r is not None and r < until_a and r <= until_b:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                until_a, a = rank[a], right[a]
            else:
                until_b, b = rank[b], left[b]

    def encode_bytes(self, piece: bytes) -> list[int]:
        n = len(piece)
        last, begin = [-1] * (n + 1), [0] * (n + 1)  # for each prefix its last token, and where that begins
        pairs, follows = self.pairs, self._follows
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):  # of those that end here, the longest first
            to = end + 1
            if last[to] < 0:
                at = to - size
                if at:
                    key = last[at] << 32 | token
                    known = pairs.get(key)
                    if not (follows(key) if known is None else known):
                        continue
                last[to], begin[to] = token, at
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = begin[at]
        return ids[::-1]

    def _follows(self, key: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = self.may_follow(key >> 32, key & 0xFFFFFFFF)
        return known

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece) or self.older.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            found = self.encode_bytes(raw)
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(raw) > PIECE_BYTES:
                return ids
        if len(self.pieces) >= PIECES:
            self.pieces, self.older = {}, self.pieces
        self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers. Strings of special tokens get their ids."""
        out = []
        split = self.split if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.split_all
        for i, part in enumerate(self.special_split.split(text) if self.special_split else [text]):
            if i % 2:
                out.append(struct.pack("<I", self.special[part]))
            else:
                pieces = split.findall(part)
                known = list(map(self.pieces.get, pieces))
                if None in known:
                    known = [x or self._piece(p) for x, p in zip(known, pieces, strict=True)]
                out += known
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str, letters: Ranges, numbers: Ranges) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, letters, numbers)
    return _encoders[path]


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """docs without text, and n_tokens long, ids binary (little-endian unsigned 32-bit), and decoded string if asked for.

    path: a vocabulary file in the tokenizers library's JSON format, of byte-level BPE without a prefix space, that
    every executor can open. Whole texts are encoded, one after another; a null text counts as empty and has no ids.
    Repeated rows and empty input need no care: each row gives one row.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]
    classes = character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, *classes)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            ids = [own.encode(t.as_py() or "") for t in batch.column(at)]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            columns += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*(n for n in batch.schema.names if n != "text"), "n_tokens", "ids", *(["decoded"] if decoded else [])])

    schema = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["n_tokens long", "ids binary", *(["decoded string"] if decoded else [])]
    return docs.select(*names, "text").mapInArrow(run, ", ".join(schema))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded without ids, and text: what the ids binary of each row stand for."""
    small_batches(coded.sparkSession)
    names = [c for c in coded.columns if c not in ("ids", "text")]
    classes = character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, *classes)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            texts = [own.decode(x.as_py() or b"") for x in batch.column(at)]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*(n for n in batch.schema.names if n != "ids"), "text"])

    schema = [f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in names] + ["text string"]
    return coded.select(*names, "ids").mapInArrow(run, ", ".join(schema))
