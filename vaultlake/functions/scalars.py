"""Scalar rules of the archive: file kinds, globs, safety of names, settings, sizes, periods."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

S_IFMT = 61440
#: File-type bits of a mode.
KINDS = {16384: "directory", 32768: "regular", 40960: "symlink", 4096: "fifo", 8192: "char_device", 24576: "block_device", 49152: "socket"}


def file_type(mode: Column) -> Column:
    out = F.lit("regular")
    for bits, name in KINDS.items():
        out = F.when(mode.bitwiseAND(S_IFMT) == bits, name).otherwise(out)
    return out


def is_regular(mode: Column) -> Column:
    return mode.bitwiseAND(S_IFMT) == 32768


def snapshot_kind(mode: Column) -> Column:
    """1 regular, 2 directory, 3 symlink, else null."""
    kind = file_type(mode)
    return F.when(is_regular(mode), 1).when(kind == "directory", 2).when(kind == "symlink", 3)


def glob_regex(pattern: str) -> str:
    """`*` and `?` also match a slash, `**/` matches any number of directories, none included; [..] and [!..] are sets."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif c == "*":
            out, i = out + ".*", i + 1
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "[":
            raise ValueError(f"invalid pattern: {pattern}")
        else:
            out, i = out + re.escape(c), i + 1
    return f"(?s)^{out}$"


def matches(path: Column, pattern: str) -> Column:
    """The pattern matches the path with or without its leading slash."""
    rule = glob_regex(pattern)
    return path.rlike(rule) | F.ltrim(path, F.lit("/")).rlike(rule)


def safe_name(name: Column) -> Column:
    return ~name.isin("", ".", "..") & ~name.contains("/")


def safe_component(name: Column) -> Column:
    return safe_name(name) & ~name.contains("\\")


def object_id_valid(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def typed_setting(value: Column, kind: str, default: object) -> Column:
    """The value as a kind, or the default where it is missing or does not parse."""
    return F.coalesce(value.try_cast(kind), F.lit(default).cast(kind))


def human_bytes(n: Column) -> Column:
    units, out = ("B", "KiB", "MiB", "GiB"), None
    for i, u in enumerate(units):
        text = F.concat(n.cast("string"), F.lit(" B")) if not i else F.concat(F.format_string("%.2f", F.bround(n / float(1024**i), 2)), F.lit(f" {u}"))
        out = text if out is None else F.when(n >= 1024**i, text).otherwise(out)
    return out


def codec_of(comp_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in {0: "none", 1: "zstd", 2: "lz4"}.items() for x in kv]), comp_type.bitwiseAND(0x7F))


def is_padded(comp_type: Column) -> Column:
    return comp_type.bitwiseAND(0x80) != 0


def worth_compressing(plain: Column, packed: Column, min_size: int = 64, min_percent: int = 5) -> Column:
    """Long enough, and saves min_percent or more (0: always)."""
    return (plain >= min_size) & (F.lit(min_percent == 0) | ((plain - packed) * 100 >= plain * min_percent))


def version_gate(value: Column) -> Column:
    """Status of a stored format version: missing counts as 1."""
    n = value.try_cast("int")
    return F.when(value.isNull(), "ok").when(n.isNull(), "not a number").when(n > 1, "too new").when(n < 1, "invalid").otherwise("ok")


def dedup_contract(mode: Column, domain: Column, ns: Column) -> Column:
    """scope of a dedup mode: none, archive, pool; anything partial is an error."""
    bare = domain.isNull() & ns.isNull()
    return F.when((mode == "none") & bare, "none").when((mode == "archive") & bare, "archive").when((mode == "pool") & domain.isNotNull() & ns.isNotNull(), "pool").otherwise("error")


PERIODS = ("day", "week", "month", "year")


def period(ts: Column, kind: str) -> Column:
    """Sortable UTC period of epoch seconds; weeks are ISO weeks. Null outside what a timestamp can hold."""
    t = F.timestamp_seconds(ts)
    if kind == "week":
        return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    return F.date_format(t, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[kind])
