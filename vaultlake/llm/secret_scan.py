"""Secret scans: fixed patterns, and guess-cost dynamic programming over values in a credential context.

The number of guesses that a value withstands is estimated by the cheapest way to cut it into dictionary words, dates,
repeats, keyboard walks and brute-force characters. A value that follows a credential word and is beyond the limit is
reported even where the fixed patterns miss it.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import small_batches

#: Fixed values of the base: kind, pattern, the group whose length counts, and its least length.
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is found as the whole run, as by [0-9a-f]+
)
KINDS = (*(k for k, *_ in BASE), "guess")

#: Words before a value that make it a credential, as a whole part of a name in snake_case, kebab-case or camelCase; the
#: value runs to its closing quote, spaces included, or without quotes to white space. A scheme word is no part of it.
#: A name goes on for at most 129 characters and a value for 1024, so that time stays in proportion to the text.
NAME = (
    r"(?:(?<![^\W_])|(?<=[a-z0-9])(?=[A-Z]))(?i:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"
    r"|auth(?:orization)?|bearer|credentials?|cred|login|pin|passkey)(?:s|key|id)?)(?:(?:(?<=[a-z])(?=[A-Z])|[0-9_-])[\w-]{0,128}+)?"
)
SCHEME = r"(?i:(?:bearer|basic|digest|negotiate|token|api-?key)\x20+)?"
CONTEXT = NAME + (
    r"[\"']?\x20*(:=|=>|->|={1,3}|:|\x20is\x20)\x20*"
    rf"(?:\"{SCHEME}((?:[^\"\\\n]|\\.){{1,1024}})\"|'{SCHEME}((?:[^'\\\n]|\\.){{1,1024}})'(?!\w)|[\"']?{SCHEME}([^\s\"']{{1,1024}}))"
)
#: Values in the user part of an address.
ADDRESS = r"(?i:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,31})://[^\s/:@]{1,256}:([^\s/@]{1,1024})@"
#: Guesses, as a power of ten, from which a value counts as a secret; such values have at least this length.
LIMIT, LEAST = 10.0, 8

#: The first words of the dictionary, before those of a vocabulary.
WORDS = (
    "password passwd secret token login admin root user guest test demo welcome letmein master access default changeme "
    "example sample dragon monkey shadow sunshine princess football baseball superman batman trustno hello world love "
    "iloveyou summer winter spring autumn monday friday january march april june july august october december please "
    "the and for with that this from your have not are you our was all can key pass null none true false value string "
    "text name number company service server database system client public private account email site web home office "
    "flower freedom whatever computer internet michael jordan hunter ranger killer soccer hockey george charlie andrew "
    "andrea jennifer joshua pepper ginger cookie coffee orange banana purple yellow silver golden diamond secure"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")


def _walks() -> set[str]:
    """Pairs of neighbouring keys in a row, both ways, and of neighbours in adjoining rows."""
    out = set()
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            for d in [row[j : j + 1] for j in (i - 1, i + 1) if 0 <= j] + ([ROWS[r + 1][j : j + 1] for j in (i - 1, i) if 0 <= j] if r < 3 else []):
                if d:
                    out |= {c + d, d + c}
    return out


#: A repeat and a keyboard walk have so many characters; what goes on for longer is several of them.
REPEAT, WALK = range(3, 65), range(3, 33)
WORD_SIZES = range(3, 15)
#: Beyond this power of ten all guess costs are alike.
CEILING = 30.0
WALKS = _walks()
_Y, _M, _D, _S = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", "[-/.]?"
#: Years, months, days, and days with the year last. At one place each of them has one length.
DATES = [re.compile(x, re.A) for x in (_Y, _Y + _S + _M, _Y + _S + _M + _S + _D, _D + _S + _M + _S + _Y)]
LEET = str.maketrans("013457@$!", "oleastasi")
DATE_COST, WALK_COST = math.log10(365 * 120), math.log10(len(WALKS))


@cache
def dictionary(vocabulary: str | None = None) -> dict[str, float]:
    """log10 of a word's rank plus one. After WORDS come the tokens of a byte-level BPE vocabulary file that begin a word
    and are letters alone, in the order of their ids, which is that of their frequency."""
    ranked = list(WORDS)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            given = json.load(f)["model"]["vocab"]
        tokens = (t[1:].lower() for t, _ in sorted(given.items(), key=lambda x: x[1]) if t[0] == "\u0120" and t[1:].isascii() and t[1:].isalpha())
        ranked += [t for t in tokens if 3 < len(t) < WORD_SIZES.stop]
    out: dict[str, float] = {}
    for w in ranked:
        out.setdefault(w, math.log10(len(out) + 2))
    return out


def _space(c: str) -> int:
    """How many characters a guesser tries for this one."""
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def guess_cost(value: str, words: dict[str, float] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of value, at most CEILING; 0 for an empty one.

    best[i] is the cheapest cost of the first i characters, over all pieces that end there: one character; a word, in
    any case and with digits for letters; a date of any form; 3 to 64 times one character; 3 to 32 neighbouring keys;
    a copy of the two to four characters just before. Pieces are bounded, so once 64 prefixes in a row cost CEILING or
    more the rest cannot cost less and is not looked at.
    """
    words = words if words is not None else dictionary()
    n, low = len(value), value.lower()
    low = low if len(low) == n else value
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n

    def reach(to: int, cost: float) -> None:
        if cost < best[to]:
            best[to] = cost

    for i in range(n):
        here, space = best[i], math.log10(_space(value[i]))
        if i and not i % REPEAT.stop and min(best[i - REPEAT.stop + 1 : i + 1]) >= CEILING:
            return CEILING
        reach(i + 1, here + space)
        for size in WORD_SIZES:
            to = i + size
            if to > n:
                break
            asis, other = low[i:to], plain[i:to]
            cost = words.get(asis)
            if cost is not None:
                reach(to, here + cost + (0.0 if value[i:to] == asis else 0.5))
            if other != asis:
                cost = words.get(other)
                if cost is not None:
                    reach(to, here + cost + 0.6 + (0.0 if value[i:to] == asis else 0.5))
        if value[i] in "0123456789":
            for form in DATES:
                m = form.match(value, i)
                if m:
                    reach(m.end(), here + DATE_COST)
        to = i + 1
        while to < n and to - i < REPEAT.stop - 1 and value[to] == value[i]:
            to += 1
            if to - i >= REPEAT.start:
                reach(to, here + space + math.log10(to - i))
        to = i + 1
        while to < n and to - i < WALK.stop - 1 and low[to - 1 : to + 1] in WALKS:
            to += 1
            if to - i >= WALK.start:
                reach(to, here + WALK_COST + math.log10(to - i))
        for unit in (2, 3, 4):
            if i >= unit and i + unit <= n and value[i : i + unit] == value[i - unit : i]:
                reach(i + unit, here + math.log10(2))
    return min(best[n], CEILING)


_BASE = [(k, re.compile(p, re.A), g, least) for k, p, g, least in BASE]
_CONTEXT, _ADDRESS = re.compile(CONTEXT), re.compile(ADDRESS)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    for i, (_, pattern, group, least) in enumerate(_BASE):
        out += [(m.start(), i, m.end(), m.start(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


class _Taken:
    """Spans as disjoint intervals in order, to test others against."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        at = bisect_right(self.ends, a)
        return at < len(self.starts) and self.starts[at] < b


def guess_spans(text: str, taken: list[tuple[int, int]], words: dict[str, float] | None = None) -> list[tuple[int, int, float]]:
    """(start, end, cost) of values in a credential context that pass the limit and meet no span already taken."""
    found: list[tuple[int, int, float]] = []
    for pattern in (_CONTEXT, _ADDRESS):
        before, last = _Taken([*taken, *(x[:2] for x in found)]), 0
        m = pattern.search(text)
        while m:
            a, b = m.span(m.lastindex)
            to = a  # what is not reported may hold the next name
            bare = pattern is _CONTEXT and m[4] is not None and not set(m[1]) & set("=>")
            while b > a and text[b - 1] in ".,;:!?)]}>":
                b -= 1
            if b - a >= LEAST and a >= last and not (bare and _prose(text[a:b])) and not before.meets(a, b):
                cost = guess_cost(text[a:b], words)
                if cost >= LIMIT:
                    found.append((a, b, cost))
                    last, to = b, m.end()
            m = pattern.search(text, to)
    return sorted(found)


def _prose(value: str) -> bool:
    """A word of letters alone, in one case or with a capital: after a colon or "is", without quotes, that is running prose."""
    return value.isalpha() and (value.isupper() or value[1:] == value[1:].lower())


def scan_text(text: str, words: dict[str, float] | None = None) -> tuple[list[str], list[str], list[float]]:
    """Base spans, all spans (each kind:start:end), and the guess cost of each span's value, in order of all spans."""
    base = base_spans(text)
    rows = [(s, k, e, guess_cost(text[v:e], words)) for s, k, e, v in base]
    rows += [(s, 3, e, c) for s, e, c in guess_spans(text, [(s, e) for s, _, e, _ in base], words)]
    rows.sort()
    name = lambda r: f"{KINDS[r[1]]}:{r[0]}:{r[2]}"
    return [name(r) for r in base], [name(r) for r in rows], [r[3] for r in rows]


COLUMNS = {"n_assign": LongType(), "n_access": LongType(), "n_hex": LongType(), "base_sha256": StringType(), "spans": StringType(), "most_guesses": DoubleType()}


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs without text, and n_assign, n_access, n_hex (long), base_sha256, spans (string), most_guesses (double).

    spans lists kind:start:end in code points by start, then kind, comma-joined, empty without any; base_sha256 is of
    the fixed patterns' spans alone. most_guesses is log10 of the guesses that the strongest value found withstands,
    null without any. vocabulary is a BPE vocabulary file that executors can open, see `dictionary`. A null text is
    empty. Each row gives one row, repeated ones too; whole texts of any length are read, one after another; columns of
    docs that are named like the operator's own give way to them; empty input gives no rows.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "text" and c not in COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = [scan_text(t.as_py() or "", words) for t in batch.column(at)]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            for kind in KINDS[:3]:
                columns.append(pa.array([sum(x.startswith(kind) for x in base) for base, _, _ in found], pa.int64()))
            columns.append(pa.array([hashlib.sha256(",".join(base).encode()).hexdigest() for base, _, _ in found], pa.string()))
            columns.append(pa.array([",".join(spans) for _, spans, _ in found], pa.string()))
            columns.append(pa.array([max(costs, default=None) for _, _, costs in found], pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, [*names, *COLUMNS])

    schema = StructType([*(docs.schema[c] for c in names), *(StructField(c, t) for c, t in COLUMNS.items())])
    return docs.select(*names, "text").mapInArrow(run, schema)
