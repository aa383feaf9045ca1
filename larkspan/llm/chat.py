"""Chat formatting: conversations rendered by a compiled template, with the mask of what a model is to learn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import materialize, table
from larkspan.llm.template import Rendering, Template

#: The template of the query, its control strings, and how its turns are read back: fixed values that belong together.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[REPLY]", "[TURN]", "[TEXT]", "[/TURN]")
TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}[REPLY] {% generation %}{{ m.text | escape }}{% endgeneration %} </s>"
    "{% else %}[TURN]{{ m.role | escape }}[TEXT]{{ m.text | escape }}[/TURN]{% endif %}"
    "{% endfor %}"
)
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[REPLY\] (?P<reply>.*?) </s>|\[TURN\](?P<role>.*?)\[TEXT\](?P<text>.*?)\[/TURN\]", re.DOTALL)

_PIECES = "conv long, task int, piece int, formatted string, spans array<struct<start:int,end:int>>"


def format_conversations(turns: DataFrame, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_chars: int = 1 << 20) -> DataFrame:
    """(conv, task, piece, formatted, spans): the pieces of each conversation's output in the order of task and piece.

    What the template has before its loop over messages starts a conversation's first piece and what it has after ends
    its last; both depend on no message and are left out here (`frame` gives them). Rows are dealt by ranges of the whole
    sort key, so that a conversation that holds a third of all rows is rendered by many tasks; spans are code points
    within a piece, and a piece is closed once it has `most_chars`.

    Defined results: null roles and texts count as empty; a null conversation id is a conversation; null turns come
    first; rows of the same turn follow one another by role, then text; repeated rows are turns of their own; texts may
    have any length; other columns, whatever their names, are not read; an empty table gives an empty result. Reading
    back, the digest of a conversation is made in one stream, however hot it is.
    """
    if Template(source, controls).turn is None:
        raise ValueError("the template has one loop over messages, at its top level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, task = Template(source, controls), TaskContext.get().partitionId()
        out, conv, piece = None, None, 0
        for batch in batches:
            done: list[list] = [[], [], [], []]

            def close():
                done[0].append(conv)
                done[1].append(piece)
                done[2].append(out.text)
                done[3].append([{"start": a, "end": b} for a, b in out.spans])

            for own, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if out is not None and (own != conv or out.length >= most_chars):
                    close()
                    out, piece = None, piece + 1
                if out is None:
                    out, conv = Rendering(), own
                template.turn({"role": role, "text": text}, {}, out)
            yield _rows(done, task)
        if out is not None:
            done = [[conv], [piece], [out.text], [[{"start": a, "end": b} for a, b in out.spans]]]
            yield _rows(done, task)

    def _rows(done: list[list], task: int) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array([task] * len(done[0]), pa.int32()), pa.array(done[1], pa.int32()), pa.array(done[2], pa.string()), pa.array(done[3], span)], ["conv", "task", "piece", "formatted", "spans"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    dealt = rows.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.mapInArrow(run, _PIECES)


def frame(source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> tuple[str, str]:
    """What stands before the first and after the last turn of every conversation."""
    template, before, after = Template(source, controls), Rendering(), Rendering()
    template.before({}, before)
    template.after({}, after)
    return before.text, after.text


def turns_of(formatted: str, template: Template) -> Iterator[tuple[str, str]]:
    """(role, text) read back from a piece."""
    back, at = template.escaper.unescape, 0
    for turn in _TURN.finditer(formatted):
        if turn.start() != at:
            raise ValueError("the output has text between turns")
        at = turn.end()
        if turn["user"] is not None:
            yield "user", back(turn["user"])
        elif turn["reply"] is not None:
            yield "assistant", back(turn["reply"])
        else:
            yield back(turn["role"]), back(turn["text"])
    if at != len(formatted):
        raise ValueError("the output has text after its turns")


def read_back(pieces: DataFrame, around: int = 0) -> DataFrame:
    """One row per conversation, from its pieces: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Pieces are parsed where they lie. A digest takes its bytes in order, so the pieces of a conversation, a few rows each,
    then stream through one task, which holds one of them. `around` is the length of what frames a conversation.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(TEMPLATE, CONTROLS)
        back = template.escaper.unescape
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for formatted, spans in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                turns = list(turns_of(formatted, template))
                out[0].append(len(turns))
                out[1].append("".join(f"{role}\n{text}\n" for role, text in turns).encode())
                out[2].append("".join(back(formatted[s["start"] : s["end"]]) for s in spans))
                out[3].append(len(formatted))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["conv", "task", "piece", "n_turns", "turns", "loss", "chars"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row() -> pa.RecordBatch:
            n, turns, chars, loss, total = state
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([n]), pa.array([turns.hexdigest()]), pa.array([chars]), pa.array([loss.hexdigest()]), pa.array([total + around])], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for own, n, turns, loss, chars in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)), strict=True):
                if state is not None and own != conv:
                    yield row()
                    state = None
                if state is None:
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(turns)
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
        if state is not None:
            yield row()

    parsed = pieces.mapInArrow(parse, "conv long, task int, piece int, n_turns long, turns binary, loss string, chars long")
    ordered = parsed.repartition("conv").sortWithinPartitions("conv", "task", "piece")
    return ordered.mapInArrow(stitch, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    pieces = materialize(format_conversations(turns.unionByName(own)), "formatted")
    return read_back(pieces, sum(map(len, frame()))).withColumnRenamed("conv", "conv_id")


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    len(text) + len(text) - len(replace(text, '\\', ''))
      + len(regexp_extract_all(text, '</?s>|\\[/?INST\\]|\\[REPLY\\]|\\[/?TURN\\]|\\[TEXT\\]')) AS escaped,
    len(role) + len(role) - len(replace(role, '\\', ''))
      + len(regexp_extract_all(role, '</?s>|\\[/?INST\\]|\\[REPLY\\]|\\[/?TURN\\]|\\[TEXT\\]')) AS role_escaped
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(CASE role WHEN 'user' THEN 15 + escaped WHEN 'assistant' THEN 13 + escaped ELSE 19 + role_escaped + escaped END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
