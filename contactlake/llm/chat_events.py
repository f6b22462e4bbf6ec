"""Chat formatting by event-sourced reconstruction.

A log row (conv_id, turn, copy, seq, kind, role, text) is one event of the message
(turn, copy), in the order of seq: ``start`` opens it with a
role, ``delta`` appends text, ``edit`` replaces the text, ``regenerate`` discards
it, ``delete`` removes the message.  Folding a message needs its own events only, so logs are
first folded per (conversation, message): the last start, edit or regenerate
wins and later deltas are appended to it.  Final messages, far fewer than
events, are then partitioned by conversation, sorted, and rendered as a stream.

The template marks a turn as ``<|role|>\\ntext</s>\\n``.  Control strings inside
roles and texts are broken by a backslash after their first character, and
backslashes are doubled, so reading back is exact.

Scale: a hot conversation's events spread over tasks by message; only its final
messages meet, in one sorted stream.  A conversation becomes rows of at most about
``PART`` code points, and reading back updates its digests part by part, so
memory depends on the longest message and never on the conversation.

Nulls: a null text or role is empty; a null conversation id is a conversation of
its own; unknown roles are rendered like others and carry no loss.  Rows that
repeat a turn are separate messages.  An empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
LOSS_ROLES = ("assistant",)
# Code points of a part, and of the parts or rows that a task gathers for one batch of output.
PART = 1 << 16
GATHERED = 1 << 22
_BREAK = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No control string is left in the result."""
    return _BREAK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turns_to_events(turns: DataFrame) -> DataFrame:
    """The log that a chat service would have kept for rows (conv_id, turn, role, text).

    Assistant texts arrive as a draft, a regeneration and four deltas; user texts
    as a first version and an edit; others as one delta.
    """
    same_turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    quarter = F.ceil(F.length(text) / 4).cast("int")

    def event(kind: str, body=None):
        return F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if body is None else body).alias("text"))

    deltas = [event("delta", F.substring(text, quarter * i + 1, quarter)) for i in range(4)]
    draft = event("delta", F.concat(F.lit("draft: "), F.substring(text, F.lit(1), quarter)))
    log = (
        F.when(F.col("role") == "assistant", F.array(event("start"), draft, event("regenerate"), *deltas))
        .when(F.col("role") == "user", F.array(event("start"), draft, event("edit", text)))
        .otherwise(F.array(event("start"), event("delta", text)))
    )
    return (
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("copy", F.row_number().over(same_turn))
        .select("conv_id", "turn", "copy", "role", F.posexplode(log).alias("seq", "e"))
        .select("conv_id", "turn", "copy", "seq", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))
    )


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text): each message as its events leave it; deleted ones are gone.

    A log that is already spread by (conv_id, turn) is not shuffled again.
    """
    folded = (
        events.groupBy("conv_id", "turn", "copy")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("__log"))
        .withColumn(
            "__from",
            F.coalesce(
                F.array_max(
                    F.transform(
                        "__log", lambda e, i: F.when(e["kind"].isin("start", "edit", "regenerate", "delete"), i + 1)
                    )
                ), F.lit(1),
            ),
        )
        .withColumn("__left", F.slice("__log", F.col("__from"), F.size("__log") - F.col("__from") + 1))
    )
    return folded.where(F.get("__left", F.lit(0))["kind"] != "delete").select(
        "conv_id", "turn", "copy",
        F.coalesce(
            F.get(F.filter(F.reverse("__log"), lambda e: e["role"].isNotNull()), F.lit(0))["role"], F.lit("")
        ).alias("role"),
        F.array_join(F.transform("__left", lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


class _Rendered:
    """The part being rendered of a conversation; full parts go to ``done``."""

    def __init__(self, conv, done: list[tuple]):
        self.conv, self.done, self.part = conv, done, 0
        self._open()

    def _open(self) -> None:
        self.pieces, self.spans, self.at, self.turns = [], [], 0, 0

    def close(self) -> None:
        if self.at:
            self.done.append((self.conv, self.part, "".join(self.pieces), self.spans, self.turns))
            self.part += 1
            self._open()

    def _mark(self, mark: str) -> None:
        """A mark of the template is never cut."""
        if self.at + len(mark) > PART:
            self.close()
        self.pieces.append(mark)
        self.at += len(mark)

    def _cut(self, escaped: str, learnt: bool = False) -> None:
        """Escaped text over as many parts as it needs; a backslash stays with the character that it escapes."""
        begin = 0
        while True:
            if self.at >= PART:
                self.close()
            piece = escaped[begin : begin + PART - self.at]
            if (len(piece) - len(piece.rstrip("\\"))) % 2:
                piece = escaped[begin : begin + len(piece) + 1]
            if learnt:
                self.spans.append({"start": self.at, "stop": self.at + len(piece)})
            self.pieces.append(piece)
            self.at += len(piece)
            begin += len(piece)
            if begin >= len(escaped):
                return

    def add(self, role: str, text: str) -> None:
        self._mark("<|")
        self._cut(escape(role))
        self._mark("|>\n")
        self._cut(escape(text), role in LOSS_ROLES)
        self._mark("</s>\n")
        self.turns += 1


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, open_conv, done = None, None, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        kinds = (kind, pa.int64(), pa.string(), _SPANS, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
            ["conv_id", "part", "formatted", "loss", "turns"],
        )

    held = 0
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in range(batch.num_rows):
            conv, role, text = (batch.column(n)[row].as_py() for n in ("conv_id", "role", "text"))
            if open_conv is None or conv != open_conv.conv:
                if open_conv:
                    open_conv.close()
                open_conv = _Rendered(conv, done)
            open_conv.add(role, text)
            held += len(role) + len(text)
            if held > GATHERED and done:
                yield out()
                held = 0
    if open_conv:
        open_conv.close()
    if done:
        yield out()


def format_chats(events: DataFrame) -> DataFrame:
    """Rows (conv_id, part, formatted, loss, turns): the parts of a conversation, from 0, joined in order are its whole text.

    ``loss`` has spans in code points of the part, ``turns`` counts the turns that end in it.
    """
    kind = events.schema["conv_id"].dataType.simpleString()
    messages = fold_messages(events).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "copy")
    return messages.select("conv_id", "role", "text").mapInArrow(
        _render, f"conv_id {kind}, part bigint, formatted string, loss array<struct<start:bigint,stop:bigint>>, turns bigint"
    )


class _Reading:
    """Digests of a conversation, updated part by part."""

    def __init__(self, conv):
        self.conv, self.found, self.chars, self.learnt_chars = conv, 0, 0, 0
        self.turns, self.learnt, self.inside = hashlib.sha256(), hashlib.sha256(), None

    def add(self, formatted: str, loss: list[dict]) -> None:
        at = 0
        while at < len(formatted):
            if self.inside is None:
                if not formatted.startswith("<|", at):
                    raise ValueError("a turn does not start with its mark")
                self.inside, at = "|>", at + 2
                continue
            mark = formatted.find(self.inside, at)
            self.turns.update(unescape(formatted[at : mark if mark >= 0 else len(formatted)]).encode())
            if mark < 0:
                break
            # Behind the mark comes a line feed.
            at = mark + len(self.inside) + 1
            self.turns.update(b"\n")
            self.found += self.inside == "</s>"
            self.inside = "</s>" if self.inside == "|>" else None
        for span in loss:
            text = unescape(formatted[span["start"] : span["stop"]])
            self.learnt_chars += len(text)
            self.learnt.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        if self.inside is not None:
            raise ValueError("the last turn has no end")
        return self.conv, self.found, self.turns.hexdigest(), self.learnt_chars, self.learnt.hexdigest(), self.chars


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, reading, rows = None, None, []

    def out() -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for i in range(batch.num_rows):
            conv, formatted, loss = (batch.column(n)[i].as_py() for n in ("conv_id", "formatted", "loss"))
            if reading is None or conv != reading.conv:
                if reading:
                    rows.append(reading.row())
                reading = _Reading(conv)
            reading.add(formatted, loss)
        if rows:
            yield out()
    if reading:
        rows.append(reading.row())
        yield out()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, read from the output alone, in whatever order its parts lie."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    parts = formatted.select("conv_id", "part", "formatted", "loss")
    # Sorting spills and Spark bounds an Arrow batch by bytes, so a task never holds a conversation.
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(
        _digest,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
