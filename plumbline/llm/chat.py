"""Chat formatting: final messages from an event log, rendered with a template.

Event sourcing: the log is partitioned by conversation and sorted by message and
sequence number; the streamed deltas, edits and regenerations of each message are folded
into its final text, and each message is rendered as it is complete.  One task reads a
conversation's events in order, holding one message at a time, however long the
conversation is.

Events (conv_id, turn, seq, kind, role, text), folded in this order for each turn:
  message     a whole message of its own (several may share a turn)
  start       begins the turn's message, with text as its first part
  delta       appends to it
  edit        replaces its text
  regenerate  replaces its text, and undoes all that later turns had said before it
  delete      removes it, until a start, edit or regenerate brings it back

Events of any other kind change nothing; rejected() lists them.

The template writes a message as

    <|im_start|>ROLE LF TEXT<|im_end|> LF

Inside texts every run "<", backslashes, "|" gets one more backslash, so no control
string can stand in a text, and taking one away again gives the text back.  A role is
percent-encoded outside letters, digits, "-", "_", ".".
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.session import ship, written

START, STOP = "<|im_start|>", "<|im_end|>\n"
_TO_ESCAPE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
LOSS_ROLE = "assistant"
KINDS = ("message", "start", "delta", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted message, and where in it the text stands."""
    head = f"{START}{quote(role, safe='')}\n"
    body = escape(text)
    return head + body + STOP, len(head), len(head) + len(body)


_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
)


class _Fold:
    """One conversation's state: the message in progress, and what came before."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.position, self.undone = conv_id, 0, None
        self.turn, self.role, self.parts, self.seen_again = object(), None, None, None

    def event(self, turn, seq, kind, role, text) -> Iterator[tuple]:
        if kind not in KINDS:
            return
        if kind == "message" or turn != self.turn:
            yield from self.end()
            self.turn = turn
        if self.undone is not None and seq is not None and seq < self.undone:
            return  # a regeneration of an earlier turn came after this
        if kind in ("message", "start", "edit", "regenerate"):
            self.parts = [text or ""]
            self.role = role if role is not None else self.role
            if kind == "regenerate" and seq is not None:
                self.seen_again = max(self.seen_again or seq, seq)
        elif kind == "delta":
            if self.parts is not None:
                self.parts.append(text or "")
            elif self.role is None:
                self.parts, self.role = [text or ""], role
        elif kind == "delete":
            self.parts, self.role = None, self.role if self.role is not None else role or ""
        if kind == "message":
            yield from self.end()

    def end(self) -> Iterator[tuple]:
        if self.parts is not None:
            role = self.role or ""
            text, a, b = render(role, "".join(self.parts))
            loss = role == LOSS_ROLE
            yield self.conv_id, self.position, text, a if loss else None, b if loss else None
            self.position += 1
        if self.seen_again is not None:
            self.undone = max(self.undone or self.seen_again, self.seen_again)
        self.role = self.parts = self.seen_again = None
        self.turn = object()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, first = None, True
    for batch in batches:
        out = []
        for conv_id, turn, seq, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if first or conv_id != state.conv_id:
                if not first:
                    out += state.end()
                state, first = _Fold(conv_id), False
            out += state.event(turn, seq, kind, role, text)
        yield _batch(out, _SCHEMA)
    if not first:
        yield _batch(list(state.end()), _SCHEMA)


def format_events(events: DataFrame) -> DataFrame:
    """Events -> conv_id, position, formatted, loss_start, loss_end: one row per final message, in order.

    The pieces of a conversation, joined by position, are its formatted text; loss_start and
    loss_end are the assistant text's place in its piece, null for other roles.  Partitions
    hold whole conversations, their rows in order.  Events of a null conv_id form one
    conversation; a null text is empty, a null role empty; ties in turn and seq are ordered
    by kind, role and text.  Events of an unknown kind are passed over (see rejected()).
    """
    ship(events.sparkSession)
    rows = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"),
        F.col("kind").cast("string").alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return placed.mapInArrow(_folded, "conv_id long, position long, formatted string, loss_start long, loss_end long")


_PIECE = re.compile(re.escape(START) + r"([^\n]*)\n")


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """role and text of every message of a formatted text."""
    at = 0
    while at < len(formatted):
        head = _PIECE.match(formatted, at)
        end = formatted.find(STOP, head.end() if head else at)
        if not head or end < 0:
            raise ValueError(f"no message at character {at}")
        yield unquote(head[1]), unescape(formatted[head.end() : end])
        at = end + len(STOP)


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
    + [("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, first = None, True
    n = loss = chars = 0
    turns, kept = hashlib.sha256(), hashlib.sha256()
    row = lambda: (now, n, turns.hexdigest(), loss, kept.hexdigest(), chars)
    for batch in batches:
        out = []
        for conv_id, _, formatted, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if first or conv_id != now:
                if not first:
                    out.append(row())
                now, first = conv_id, False
                n = loss = chars = 0
                turns, kept = hashlib.sha256(), hashlib.sha256()
            for role, text in read_back(formatted):
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            if a is not None:
                text = unescape(formatted[a:b])
                loss += len(text)
                kept.update(text.encode("utf-8", "replace"))
            chars += len(formatted)
        yield _batch(out, _DIGEST)
    if not first:
        yield _batch([row()], _DIGEST)


def digests(formatted: DataFrame) -> DataFrame:
    """What format_events() wrote, read back and digested: one row per conversation."""
    return formatted.mapInArrow(
        _digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted (the whole text), loss_spans (places in it): for conversations that fit a cell."""
    rows = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "formatted", "loss_start", "loss_end"))).alias("p"))
    before = "aggregate(slice(p, 1, i), 0L, (s, x) -> s + length(x.formatted))"
    spans = f"filter(transform(p, (x, i) -> named_struct('start', {before} + x.loss_start, 'end', {before} + x.loss_end)), s -> s.start is not null)"
    return rows.select("conv_id", F.expr("array_join(transform(p, x -> x.formatted), '')").alias("formatted"), F.expr(spans).alias("loss_spans"))


def turns_as_events(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> events: every row is a whole message."""
    return turns.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def rejected(events: DataFrame) -> DataFrame:
    """The events that format_events() passes over: those of an unknown or null kind."""
    return events.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))


_STEPS = 8  # sequence numbers of a turn


def turns_as_log(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the event log of a chat service in which those turns come about.

    By a hash of its place a turn is streamed (a start and deltas), or drafted, streamed on and
    corrected by an edit, or answered wrongly and regenerated in deltas, or deleted and begun
    anew.  Only folding the log gives the turns back.  Rows that share a conversation and turn,
    and those without either, are messages of their own.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    shared = written(rows.groupBy("conv_id", "turn").count().where("count > 1 and conv_id is not null and turn is not null").select("conv_id", "turn", F.lit(True).alias("_shared")), "sharedturns")
    rows = rows.join(shared, ["conv_id", "turn"], "left")
    text, third = F.col("text"), F.ceil(F.length("text") / 3).cast("int")
    piece = lambda k: F.substring(text, F.lit(1) + k * third, third)
    wrong = F.concat(F.lit("<|draft|> "), F.reverse(F.substring(text, 1, 12)))
    role, none = F.col("role"), F.lit(None).cast("string")

    def log(*steps) -> Column:
        return F.array(
            *[F.struct((F.col("turn") * _STEPS + k).alias("seq"), F.lit(kind).alias("kind"), who.alias("role"), said.alias("text")) for k, (kind, who, said) in enumerate(steps)]
        )

    deltas = [("delta", none, piece(1)), ("delta", none, piece(2))]
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    events = (
        F.when(F.col("_shared") | F.col("conv_id").isNull() | F.col("turn").isNull(), log(("message", role, text)))
        .when(way == 0, log(("start", role, piece(0)), *deltas))
        .when(way == 1, log(("start", role, wrong), ("delta", none, F.lit(" and more")), ("edit", none, text)))
        .when(way == 2, log(("start", role, wrong), ("regenerate", role, piece(0)), *deltas))
        .otherwise(log(("start", role, wrong), ("delete", none, none), ("start", role, piece(0)), *deltas))
    )
    return rows.select("conv_id", "turn", F.inline(events)).select("conv_id", "turn", "seq", "kind", "role", "text")
