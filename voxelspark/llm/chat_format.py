"""Chat formatting with a grammar round trip.

A turn is rendered as

    ### Role: text
    </turn>

The control strings are "### " and "</turn>". The parser reads a control string
as one only if no backslash stands before it, and takes one backslash off any
run of backslashes before a control string inside a text. A turn is rendered as
it is, parsed, and compared with its source; where they differ its text (and
role) get one backslash more before each control string, and the turn is parsed
again, until they are the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

_CONTROL = re.compile(r"(\\*)(### |</turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1][1:] + m[2], text)


def _role(role: str) -> str:
    """Roles also keep their ends and colons apart from the header's."""
    return re.sub(r"[%:\n#<\\ ]", lambda m: f"%{ord(m[0]):02x}", role)


def _unrole(role: str) -> str:
    return re.sub(r"%([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), role)


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """Turns of a rendered text; None if it isn't a sequence of turns."""
    out, at = [], 0
    marks = [m for m in _CONTROL.finditer(rendered) if not m[1]]
    if len(marks) % 2:
        return None
    for head, tail in zip(marks[::2], marks[1::2]):
        body = rendered[head.end() : tail.start()]
        role, colon, text = body.partition(": ")
        if head[2] != "### " or tail[2] != "</turn>" or head.start() != at or not colon or text[-1:] != "\n" or rendered[tail.end() : tail.end() + 1] != "\n":
            return None
        out.append((_unrole(role), unescape(text[:-1])))
        at = tail.end() + 1
    return out if at == len(rendered) else None


def render(role: str, text: str) -> tuple[str, int, int]:
    """Rendered turn and the character range of its (escaped) text."""
    written, name = text, _role(role)
    for _ in range(2):
        head = f"### {name}: "
        out = f"{head}{written}\n</turn>\n"
        if parse(out) == [(role, text)]:
            return out, len(head), len(head) + len(written)
        written = escape(text)
    raise ValueError("a turn does not survive its round trip")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [render(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
        columns = [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "rendered", "text_begin", "text_end"])


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, rendered, text_begin, text_end, loss.

    The formatted conversation is its rendered turns in order of turn (then
    role and rendered; null turns first); loss marks the turns, and
    text_begin..text_end the characters, that a model learns from (role
    assistant). Null roles and texts are empty. Turns are independent, so a
    conversation of any length is spread over tasks.
    """
    source = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = source.mapInArrow(_render, "conv_id long, turn long, role string, rendered string, text_begin int, text_end int")
    return out.withColumn("loss", F.col("role") == "assistant")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rendered turns sorted by conversation; holds one batch and the running digests of one conversation."""
    now = None
    turns = loss = None
    n = chars = loss_chars = 0
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    done: list[tuple] = []
    for batch in batches:
        for conv, text, a, b, learn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "text_begin", "text_end", "loss"))):
            if turns is None or conv != now:
                if turns is not None:
                    done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                now, n, chars, loss_chars = conv, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, said in parse(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            chars += len(text)
            if learn:
                said = unescape(text[a:b])
                loss.update(said.encode())
                loss_chars += len(said)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in done], schema)
            done = []
    if turns is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)))], schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from the rendered turns."""
    order = ["conv_id", "turn", "role", "rendered"]
    rows = formatted.select(*order, "text_begin", "text_end", "loss").repartition("conv_id").sortWithinPartitions(*order)
    return rows.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return read_back(format_chat(turns.unionByName(hard)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, regexp_replace(text, '(\\*)(### |</turn>)', '\1\\\2', 'g') AS written,
         regexp_replace(role, '[%:\n#<\\ ]', '???', 'g') AS name FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, written)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, written) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(name) + 2 + length(written) + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
