"""Chat formatting whose output is proven to parse back to its source.

The grammar, one turn after another, nothing between:

    turn   = "### " role ": " text LF "</turn>" LF
    role   = a known role's label, or any other role as a JSON string
    text   = no LF "</turn>" LF inside; each of its marks ("###" or "</turn>") stands behind a backslash

A turn is first rendered as it is. The rendered text is reparsed by the deterministic parser below; where the
recovered role or text differs from the source, or anything is left over, its marks get one more backslash (each mark
with the backslashes before it) and it's rendered and reparsed again until identical. Reading removes one backslash
before each mark that has any. Loss falls on the texts of assistant turns.

Scale: rendering is by row, with no shuffle. Reading back sorts a conversation's chunks and streams them through the
parser with running digests, so a conversation of any length needs memory for one turn.

Defined cases: null texts and null roles are empty strings; a null conv_id is one conversation of its own; turns order
by turn, nulls first, then role, then rendered text, so that ties and repeated rows stay, in one order; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LABELS = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
ROLES = {label: role for role, label in LABELS.items()}
END = "\n</turn>\n"

_MARK = re.compile(r"(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"\\(\\*(?:###|</turn>))")
_LABEL = re.compile(r'### (?:(User|Assistant|System|Tool)|("(?:[^"\\]|\\.)*")): ')


class Malformed(ValueError):
    """The text isn't of the grammar."""


def escape(text: str) -> str:
    return _MARK.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return f"### {LABELS.get(role) or json.dumps(role)}: {text}{END}"


def parse_one(s: str, at: int = 0) -> tuple[str, int, int, int] | None:
    """(role, start and end of the text, end of the turn) of the turn at a place; None if it isn't complete yet."""
    head = _LABEL.match(s, at)
    if head is None:
        if len(s) - at > 4 and not s.startswith("### ", at):
            raise Malformed(s[at : at + 40])
        return None
    end = s.find(END, head.end())
    if end < 0:
        return None
    return ROLES[head[1]] if head[1] else json.loads(head[2]), head.end(), end, end + len(END)


def recovered(s: str) -> tuple[str, str] | None:
    """Role and text of a rendered turn, if the whole of it reads as one turn with no bare mark in its text."""
    try:
        turn = parse_one(s)
    except Malformed:
        return None
    if turn is None or turn[3] != len(s) or any(not m[1] for m in _MARK.finditer(s, turn[1], turn[2])):
        return None
    return turn[0], unescape(s[turn[1] : turn[2]])


def format_turn(role: str, text: str, rounds: int = 8) -> tuple[str, int, int]:
    """The rendered turn, and start and end of its text within it."""
    body = text
    for _ in range(rounds):
        s = render(role, body)
        if recovered(s) == (role, text):
            _, start, end, _ = parse_one(s)
            return s, start, end
        body = escape(body)
    raise Malformed(f"no rendering of {role!r} reads back")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, chunk (its rendered text), loss_start and loss_end (the part of the chunk
    under the loss mask, empty for other roles). A conversation's text is its chunks, in the stated order."""
    spark = conversations.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    source = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            turns = [format_turn(r, t) for r, t in zip(roles, texts)]
            starts = [s for _, s, _ in turns]
            ends = [e if r == "assistant" else s for r, (_, s, e) in zip(roles, turns)]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([c for c, _, _ in turns], pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "chunk", "loss_start", "loss_end"])

    return source.mapInArrow(rendered, "conv_id long, turn long, role string, chunk string, loss_start long, loss_end long")


class _Reader:
    """Running digests of one conversation, read from its formatted text alone."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.loss = "", 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def feed(self, chunk: str, spans: list[tuple[int, int]]) -> None:
        """spans: what of the chunk is under the loss mask."""
        for start, end in spans:
            text = unescape(chunk[start:end])
            self.loss += len(text)
            self.masked.update(text.encode())
        self.chars += len(chunk)
        s, at = self.rest + chunk, 0
        while at < len(s) and (turn := parse_one(s, at)):
            role, start, end, at = turn
            self.turns += 1
            self.all.update(f"{role}\n{unescape(s[start:end])}\n".encode())
        self.rest = s[at:]

    def row(self, conv_id: int | None) -> tuple:
        if self.rest:
            raise Malformed(self.rest[:40])
        return conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(chunks: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text says: turns and their digest, loss characters and theirs, length."""
    common.ship(chunks.sparkSession)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current, done = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        for batch in batches:
            for conv, chunk, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "chunk", "loss_start", "loss_end"))):
                if reader is None or conv != current:
                    if reader is not None:
                        done.append(reader.row(current))
                    reader, current = _Reader(), conv
                reader.feed(chunk, [(start, end)] if end > start else [])
            if len(done) >= 1000:
                yield out()
                done = []
        if reader is not None:
            done.append(reader.row(current))
        if done:
            yield out()

    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "chunk")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_round_trip(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    source = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(source.unionByName(extra)))
