"""Chat formatting by event-sourced reconstruction.

A log of events is dealt by conversation and sorted by message and sequence; streamed deltas, edits
and regenerations fold into final messages, which are rendered by a template with a loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Opening and closing mark of each role; any other role is named inside <|...|>.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<|", "|>", "<|end|>")
#: What must not appear inside a text: a backslash goes after the first character of each.
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|", "|>")

EVENTS = "conv_id long, turn long, role string, message long, seq long, kind string, at long, upto long, payload string"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message in the template, and where its text starts and ends in it."""
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    body = escape(text)
    return head + body + tail, len(head), len(head) + len(body)


_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>|<\|(?P<role>.*?)\|>(?P<other>.*?)<\|end\|>", re.S)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) for each turn of a formatted piece."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not in the template at {at}")
        if m["role"] is not None:
            yield unescape(m["role"]), unescape(m["other"]), m.start("other"), m.end("other")
        else:
            yield m.lastgroup, unescape(m[m.lastgroup]), m.start(m.lastgroup), m.end(m.lastgroup)
        at = m.end()


def fold(pieces: list[str], kind: str, at: int, upto: int, payload: str) -> list[str]:
    """The text so far, as pieces, after one more event. delta: appends; edit: replaces the
    characters at..upto; regenerate: starts anew with the payload; other kinds change nothing."""
    if kind == "delta":
        pieces.append(payload)
        return pieces
    if kind == "edit":
        text = "".join(pieces)
        return [text[:at], payload, text[upto:]]
    if kind == "regenerate":
        return [payload]
    return pieces


def reconstruct(events: DataFrame) -> DataFrame:
    """Folds events into final messages and renders them: conv_id, turn, role, message, formatted,
    loss_from, loss_to (the text's place in ``formatted``; null unless the role is
    assistant). Messages of a turn keep the order of (role, message).

    Conversations are dealt by id and message, sorted by (turn, role, message, seq), and folded as a stream: a
    task holds one message at a time, and one long conversation is folded by many tasks. A null role or payload
    is empty; null ids and turns are values of their own and come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, out = None, [], []

        def done():
            conv, turn, role, message = key
            text, a, b = render(role or "", "".join(pieces))
            loss = role == "assistant"
            out.append((conv, turn, role or "", message, text, a if loss else None, b if loss else None))

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for conv, turn, role, message, _, kind, at, upto, payload in zip(*cols):
                if (conv, turn, role, message) != key:
                    if key is not None:
                        done()
                    key, pieces = (conv, turn, role, message), []
                pieces = fold(pieces, kind, at or 0, upto or 0, payload or "")
            yield from _batches(out, _MESSAGES)
            out = []
        if key is not None:
            done()
        yield from _batches(out, _MESSAGES)

    order = ("conv_id", "turn", "role", "message", "seq")
    rows = events.select("conv_id", "turn", "role", "message", "seq", "kind", "at", "upto", "payload")
    return rows.repartition(*order[:-1]).sortWithinPartitions(*order).mapInArrow(run, "conv_id long, turn long, role string, message long, formatted string, loss_from long, loss_to long")


_MESSAGES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("message", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted messages back and digests each conversation: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Hashes run along the sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def done():
            out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for conv, text, a, b in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if state is None or state[0] != conv:
                    if state:
                        done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    said = unescape(text[a:b])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield from _batches(out, _DIGESTS)
            out = []
        if state:
            done()
        yield from _batches(out, _DIGESTS)

    rows = formatted.select("conv_id", "formatted", "loss_from", "loss_to", "turn", "role", "message")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "message").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(turns: DataFrame, piece: int = 200) -> DataFrame:
    """The log that would have produced ``turns`` (conv_id, turn, role, text): every text streams in
    deltas of ``piece`` characters; texts with an even crc32 were first something else and then
    regenerated; those with a crc32 divisible by 3 had a slip that an edit removes. ``message``
    numbers the rows, so repeated rows stay apart, in the order of their text's hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("_text"), F.crc32(text.cast("binary")).alias("_c"))
    # the hash's upper half orders, the row's number keeps equal rows apart
    rows = rows.withColumn("message", F.shiftleft(F.col("_c") % (1 << 19), 44) + F.monotonically_increasing_id() % F.lit(1 << 44))
    n = F.length("_text")
    ev = lambda seq, kind, payload, at=None, upto=None: F.struct(F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), (F.lit(None) if at is None else at).cast("long").alias("at"), (F.lit(None) if upto is None else upto).cast("long").alias("upto"), payload.alias("payload"))
    deltas = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / piece).cast("int")), lambda i: ev(i + 10, "delta", F.substring(F.col("_text"), i * piece + 1, F.lit(piece))))
    none = F.array_except(deltas, deltas)
    draft = F.when(F.col("_c") % 2 == 0, F.array(ev(1, "delta", F.lit("a first try")), ev(2, "regenerate", F.lit("")))).otherwise(none)
    slip = F.when(F.col("_c") % 3 == 0, F.array(ev(1 << 40, "delta", F.lit(" (sic)")), ev((1 << 40) + 1, "edit", F.lit(""), n, n + 6))).otherwise(none)
    log = F.concat(draft, deltas, slip, F.array(ev((1 << 40) + 2, "end", F.lit(""))))
    return rows.select("conv_id", "turn", "role", "message", F.explode(log).alias("e")).select("conv_id", "turn", "role", "message", "e.*")


def op10(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return digests(written(reconstruct(events_of(turns.union(extra))), "formatted"))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'),
        '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<s>', '<\s>'), '</s>', '<\/s>'), '<<SYS>>', '<\<SYS>>'),
        '<</SYS>>', '<\</SYS>>'), '<|', '<\|'), '|>', '|\>'))
      + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
             ELSE 11 + length(replace(replace(replace(replace(replace(replace(replace(replace(replace(role, '\', '\\'),
        '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<s>', '<\s>'), '</s>', '<\/s>'), '<<SYS>>', '<\<SYS>>'),
        '<</SYS>>', '<\</SYS>>'), '<|', '<\|'), '|>', '|\>')) END AS chars FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
