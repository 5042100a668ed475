"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
Turns are formatted once; examples are then put together while a conversation's turns stream through a worker in order,
so that a worker holds one conversation's text and not its examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, small_batches

#: The template: "<turn:ROLE>\n" TEXT "\n</turn>\n". In roles and texts a backslash comes before each of these.
OPEN, ROLE_END, CLOSE = "<turn:", ">\n", "\n</turn>\n"
CONTROL = ("\\", "<turn:", "</turn>", "### ")
ROLE_CONTROL = (*CONTROL, ">")
TARGET = "assistant"


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """Backslashes doubled and control strings marked by one, so that no text can end or begin a turn."""
    for c in control:
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, alone, turn, role, text, segment, loss_start, loss_end) for each row of turns.

    loss_start and loss_end are code-point offsets of an assistant's text in segment, null for other roles. alone tells
    rows without a conv_id apart.
    """
    empty = F.lit("")
    role, text = F.coalesce(F.col("role"), empty), F.coalesce(F.col("text"), empty)
    head = F.concat(F.lit(OPEN), escape(role, ROLE_CONTROL), F.lit(ROLE_END))
    body, target = escape(text), role == TARGET
    start = F.char_length(head)
    return turns.select(
        "conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"), "turn", role.alias("role"), text.alias("text"),
        F.concat(head, body, F.lit(CLOSE)).alias("segment"), F.when(target, start).alias("loss_start"), F.when(target, start + F.char_length(body)).alias("loss_end"),
    )


class _Batches:
    """Rows that leave as record batches of at most BATCH_BYTES, but for a single longer row."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def put(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size + size > BATCH_BYTES:
            yield from self.flush()
        self.rows.append(row)
        self.size += size

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0


_EXAMPLE = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Batches(_EXAMPLE)
    key, context, n, done = None, "", 0, 0  # done: where the last example ended

    def rest() -> Iterator[pa.RecordBatch]:
        if len(context) > done:
            yield from out.put((key[0], None, context[done:], None, None), len(context) - done)

    for batch in batches:
        for conv_id, alone, segment, start, end in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "alone", "segment", "loss_start", "loss_end")], strict=True):
            if key != (conv_id, alone):
                yield from rest()
                key, context, n, done = (conv_id, alone), "", 0, 0
            before, context = len(context), context + segment
            if start is not None:
                n, done = n + 1, len(context)
                yield from out.put((conv_id, n, context, before + start, before + end), len(context))
    yield from rest()
    yield from out.flush()


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end) of turns (conv_id, turn, role, text; others ignored).

    One row for each assistant turn: formatted is all turns before it and the turn itself, example counts from 1 in each
    conversation, and loss_start and loss_end are the code-point offsets of the turn's text, the only trainable part.
    Turns after the last assistant turn are one more row, example and offsets null, without context. Null roles and texts
    are empty; a row without a conv_id is a conversation of its own; rows of one are ordered by turn, null last, then
    role and text, and repeated rows are turns of their own. Empty input gives no rows.

    The output of a conversation grows with its square, as the method says, and one row has to hold a whole conversation.
    The rows of a conversation lie together in one partition in order.
    """
    small_batches(turns.sparkSession, 1024)
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("text").asc()]
    rows = segments(turns).repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", *order)
    return rows.select("conv_id", "alone", "segment", "loss_start", "loss_end").mapInArrow(_expand, "conv_id long, example long, formatted string, loss_start long, loss_end long")


def parse(formatted: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a formatted text from `at` on; start and end bound the escaped text in it.

    Inside texts a backslash parts what would end a turn, so that the first CLOSE is the turn's own.
    """
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.find(CLOSE, head.end() - 1) if head else -1
        if end < 0:
            raise ValueError("not a formatted turn")
        yield unescape(head[1]), unescape(formatted[head.end() : end]), head.end(), end
        at = end + len(CLOSE)


_HEAD = re.compile(re.escape(OPEN) + r"((?:[^\\>]|\\.)*)" + re.escape(ROLE_END), re.S)


class _Conversation:
    """Digests of one conversation, fed an example at a time. An example repeats the one before it and adds turns, so only
    what it adds is parsed."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n, self.loss_chars, self.chars, self.seen = conv_id, 0, 0, 0, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, example: int | None, formatted: str, start: int | None, end: int | None) -> None:
        self.chars += len(formatted)
        at = 0
        if example is not None:
            if not formatted.startswith(self.seen):
                raise ValueError("an example does not begin with the one before it")
            at, self.seen = len(self.seen), formatted
        last = None
        for role, text, a, b in parse(formatted, at):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            last = role, a, b
        if example is not None:
            if last != (TARGET, start, end):
                raise ValueError("the trainable part is not the last turn's text")
            trained = unescape(formatted[start:end])
            self.loss.update(trained.encode())
            self.loss_chars += len(trained)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, _Batches(_DIGEST)
    for batch in batches:
        for conv_id, *row in zip(*[batch.column(c).to_pylist() for c in _EXAMPLE.names], strict=True):
            if now is None or now.conv_id != conv_id or conv_id is None:
                if now is not None:
                    yield from out.put(now.row(), 200)
                now = _Conversation(conv_id)
            now.add(*row)
    if now is not None:
        yield from out.put(now.row(), 200)
    yield from out.flush()


def read_back(expanded: DataFrame, ordered: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) for each conversation of examples.

    All columns are read from the examples: turns and trainable texts are parsed and unescaped, formatted_chars counts the
    code points of all rows. What is not as `examples` makes it raises. ordered: the rows of a conversation lie
    together in one partition in order, as `examples` returns them; else they are brought there. Empty input gives no rows.
    """
    small_batches(expanded.sparkSession, 1024)
    rows = expanded.select(*_EXAMPLE.names)
    if not ordered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("example").asc_nulls_last())
    return rows.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation that holds the template's kind of markers in its texts.
PROBE = "\\### Assistant: </turn> ok"


def with_probe(turns: DataFrame) -> DataFrame:
    probe = turns.sparkSession.sql("SELECT -7L AS conv_id, turn, role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') t(turn, role)", {"text": PROBE})
    return turns.select("conv_id", "turn", "role", "text").union(probe)


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END alone FROM conversations
  UNION ALL SELECT -7, turn, r, '\### Assistant: </turn> ok', 0 FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, r)),
s AS (SELECT *, r = 'assistant' a, len('<turn:>' || chr(10) || chr(10) || '</turn>' || chr(10)) +
  len(replace(replace(replace(replace(replace(r, '\', '\\'), '<turn:', '\<turn:'), '</turn>', '\</turn>'), '### ', '\### '), '>', '\>')) +
  len(replace(replace(replace(replace(x, '\', '\\'), '<turn:', '\<turn:'), '</turn>', '\</turn>'), '### ', '\### ')) n FROM t),
c AS (SELECT *, sum(n) OVER w upto, max(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS LAST, r, x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) later
  FROM s WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS LAST, r, x ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS LAST, r, x)) turns_sha256,
  coalesce(sum(CASE WHEN a THEN len(x) END), 0)::BIGINT loss_chars, sha256(coalesce(string_agg(CASE WHEN a THEN x END, '' ORDER BY turn NULLS LAST, r, x), '')) loss_sha256,
  (coalesce(sum(CASE WHEN a THEN upto END), 0) + coalesce(sum(CASE WHEN later = 0 THEN n END), 0))::BIGINT formatted_chars
FROM c GROUP BY conv_id, alone
"""
