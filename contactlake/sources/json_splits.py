"""JSON documents read in splits: the elements of arrays as rows, whatever the size of the file.

A file is read as text cut at commas, which Spark splits over tasks like lines.  One pass
sums up each split: for either state it may be entered in (inside a string or not) the
brackets it closes and opens and the commas on each level, and the state it leaves in.
Per file these summaries, one row per split, are chained in order, so every split knows the
containers it starts in and the place within each.  A second pass cuts the elements;
an element that lies in one split, as nearly all do, is complete there, others are put
together from their parts.  No task holds a document, only its own split, and no row
is longer than an element or than what is left of a document without its elements.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.operators.joins import lookup
from contactlake.session import ensure_checkpoint_dir

_TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|["\[\]{},]', re.DOTALL)
_REST = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_PAIRS = {b"]": "[", b"}": "{"}


@dataclass(frozen=True)
class Levels:
    """Depth of the elements, and of the documents they belong to, by how a file's documents open.

    Depth 0 is a document itself, depth 1 what its outermost container holds.  An element is
    named by the ordinals of its document, of the member of that document it lies in, and its own.
    """

    array: tuple[int, int]  # (depth of documents, depth of elements) where documents are arrays
    object: tuple[int, int]


def _tokens(data: bytes, inside: bool) -> Iterator[tuple[int, bytes]]:
    """(position, bracket or comma) outside strings; the last is (length, state after it)."""
    at = 0
    if inside:
        rest = _REST.match(data)
        if not rest:
            yield len(data), b'"'
            return
        at = rest.end()
    for m in _TOKEN.finditer(data, at):
        found = m[0]
        if found == b'"':
            yield len(data), b'"'
            return
        if found[:1] != b'"':
            yield m.start(), found
    yield len(data), b""


class _Effect:
    """What a stretch of text does to the containers around it, relative to where it starts."""

    def __init__(self, inside: bool):
        self.inside, self.closed, self.open = inside, [], [["", 0, 0]]

    def feed(self, data: bytes) -> None:
        for _, found in _tokens(data, self.inside):
            top = self.open[-1]
            if found == b",":
                top[1] += 1
            elif found in (b"[", b"{"):
                top[2] += 1
                self.open.append([found.decode(), 0, 0])
            elif found in _PAIRS:
                if len(self.open) > 1:
                    self.open.pop()
                else:
                    self.closed.append(top[1:])
                    self.open = [["", 0, 0]]
            else:
                self.inside = bool(found)


def _segments(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[tuple, list[bytes], bool]]:
    """((file, block, *extra), pieces, whether the key is new) of consecutive rows."""
    last = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "block", *extra, "value")]
        for key, rows in groupby(zip(*columns, strict=True), key=lambda r: r[:-1]):
            yield key, [r[-1] for r in rows], key[:2] != last
            last = key[:2]


# Pieces travel together in chunks of about so many bytes, so what is joined and sorted is little more than the text.
CHUNK = 1 << 16


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a split, each with its comma, joined to numbered chunks."""

    def row(key, number, pieces):
        return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "number": number, "value": b",".join(pieces) + b","}], _CHUNK)

    key, number, held, size = None, 0, [], 0
    for found, pieces, new in _segments(batches, []):
        if new:
            if held:
                yield row(key, number, held)
            key, number, held, size = found, 0, [], 0
        for piece in pieces:
            held.append(piece)
            size += len(piece) + 1
            if size >= CHUNK:
                yield row(key, number, held)
                number, held, size = number + 1, [], 0
    if held:
        yield row(key, number, held)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(key, size, effects):
        shown = [json.dumps([e.inside, e.closed, e.open]) for e in effects]
        return pa.RecordBatch.from_pylist(
            [{"file": key[0], "block": key[1], "length": key[2], "size": size, "outside": shown[0], "inside": shown[1]}]
        )

    held = None
    for key, pieces, new in _segments(batches, ["length"]):
        if new:
            if held:
                yield row(*held)
            held = (key, 0, (_Effect(False), _Effect(True)))
        data = b",".join(pieces) + b","
        held = (key, held[1] + len(data), held[2])
        for effect in held[2]:
            effect.feed(data)
    if held:
        yield row(*held)


def _chain(table: pa.Table) -> pa.Table:
    """Entry states of one file's splits; no rows if brackets do not match or a string stays open."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    inside, stack, out = False, [["", 0, 0]], []
    for r in rows:
        out.append({"file": r["file"], "block": r["block"], "state": json.dumps([inside, stack])})
        inside, closed, opened = json.loads(r["inside" if inside else "outside"])
        for commas, opens in closed:
            if len(stack) == 1:
                return table.slice(0, 0).select(["file", "block"]).append_column("state", pa.array([], pa.string()))
            stack.pop()
        stack[-1][1] += opened[0][1]
        stack[-1][2] += opened[0][2]
        stack = [*stack, *opened[1:]]
    # Every piece counted a comma; a file that ends with one is no JSON.
    good = not inside and len(stack) == 1 and stack[0][2] and sum(r["size"] for r in rows) == rows[0]["length"] + 1
    return pa.Table.from_pylist(out if good else [], pa.schema([("file", pa.string()), ("block", pa.int64()), ("state", pa.string())]))


class _Cutter:
    """Cuts elements and what is left of their documents out of one split."""

    def __init__(self, state: str, levels: Levels):
        self.inside, self.stack = json.loads(state)
        self.levels, self.rows = levels, []
        self.parts = {"element": [], "document": [], "junk": []}
        self.began = {"element": False, "document": False}
        if len(self.stack) > 1:
            self._place(self.stack[1][0])
        else:
            self.outer, self.depth = 0, 0

    def _place(self, kind: str) -> None:
        self.outer, self.depth = self.levels.array if kind == "[" else self.levels.object

    def _role(self) -> str:
        at = len(self.stack) - 1
        if at == 0:
            return "junk"
        return "element" if at >= max(self.depth, 1) or self.depth == 0 else "document"

    def _ordinals(self, role: str) -> dict:
        top = self.stack[0][2] - 1
        at = lambda depth: top if depth == 0 else self.stack[depth][1]
        document = at(self.outer) if self.depth > self.outer else 0
        if role == "document":
            return {"document": document, "member": 0, "ord": 0, "container": ""}
        member = at(self.outer + 1) if self.depth > self.outer + 1 else 0
        return {"document": document, "member": member, "ord": at(self.depth), "container": self.stack[self.depth][0] if self.depth else ""}

    def _finish(self, role: str, end: str) -> None:
        text = b"".join(self.parts[role])
        if text or self.began[role] or end:
            self.rows.append(self._ordinals(role) | {"role": role, "text": text, "whole": self.began[role] and bool(end), "end": end})
        self.parts[role], self.began[role] = [], True

    def feed(self, data: bytes) -> None:
        last = 0
        for at, found in _tokens(data, self.inside):
            if self.stack[-1][0] or data[last:at].strip():
                self.parts[self._role()].append(data[last:at])
            last = at + 1
            depth = len(self.stack) - 1
            if found == b",":
                if depth and depth == self.depth:
                    self._finish("element", ",")
                elif depth and depth == self.outer:
                    self._finish("document", ",")
                elif depth:
                    self.parts[self._role()].append(found)
                elif at < len(data) - 1:
                    self.parts["junk"].append(found)
                self.stack[-1][1] += 1
            elif found in (b"[", b"{"):
                if not depth:
                    self._place(found.decode())
                    self.began["document"] = self.outer == 0
                    self.began["element"] = self.depth == 0
                role = "element" if depth >= self.depth else "document"
                self.parts[role].append(found)
                self.stack[-1][2] += 1
                self.stack.append([found.decode(), 0, 0])
                if depth + 1 == self.depth:
                    self.began["element"] = True
                if depth + 1 == self.outer:
                    self.parts["document"], self.began["document"] = [], True
            elif found in _PAIRS:
                if self.stack[-1][0] != _PAIRS[found]:
                    self.parts["junk"].append(found)
                if depth == self.depth and depth:
                    self._finish("element", "]")
                if depth == self.outer and depth:
                    self._finish("document", "]")
                self.stack.pop()
                role = "element" if depth - 1 >= self.depth else "document"
                self.parts[role].append(found)
                if depth == 1 and self.depth == 0:
                    self._finish("element", "]")
                if depth == 1 and self.outer == 0 and self.depth:
                    self._finish("document", "]")
                if depth == 1:
                    self.began = {"element": False, "document": False}
                    self.parts["element"], self.parts["document"] = [], []
            else:
                self.inside = bool(found)

    def close(self) -> list[dict]:
        if len(self.stack) > 1:
            for role in ("element", "document"):
                if self.parts[role] or self.began[role]:
                    if not (role == "document" and len(self.stack) - 1 < self.outer) and not (role == "element" and len(self.stack) - 1 < self.depth):
                        self._finish(role, "")
        if b"".join(self.parts["junk"]).strip():
            self.rows.append({"document": 0, "member": 0, "ord": 0, "container": "", "role": "junk", "text": b"", "whole": True, "end": ""})
        return self.rows


_CHUNK = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("value", pa.binary())])
_CUT = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("role", pa.string()), ("document", pa.int64()), ("member", pa.int64()), ("ord", pa.int64()),
    ("container", pa.string()), ("text", pa.binary()), ("whole", pa.bool_()), ("end", pa.string()),
])
_CUT_SQL = (
    "file string, block bigint, role string, document bigint, member bigint, ord bigint, container string, text binary, whole boolean, end string"
)


def _cut(batches: Iterator[pa.RecordBatch], levels: Levels) -> Iterator[pa.RecordBatch]:
    def rows(key, cut):
        place = {"file": key[0], "block": key[1]}
        return pa.RecordBatch.from_pylist([place | r for r in cut], _CUT)

    held = None
    for key, pieces, new in _segments(batches, ["state"]):
        if new:
            if held:
                yield rows(held[0], held[1].close())
            held = (key, _Cutter(key[2], levels))
        for chunk in pieces:
            held[1].feed(chunk)
            yield rows(key, held[1].rows)
            held[1].rows = []
    if held:
        yield rows(held[0], held[1].close())


def json_elements(spark: SparkSession, path: str, levels: Levels) -> tuple[DataFrame, DataFrame]:
    """(elements, documents) of all JSON files under a path.

    elements: (file, document, member, ord, container, text) with the text of each element (in an object: key and value);
    documents: (file, document, text) with the text of each document without its elements.
    Ordinals start at 0.  Files whose brackets or strings do not match, or with anything but blanks
    between documents, give no rows in either; an element that is no JSON is left to the caller.
    """
    ensure_checkpoint_dir(spark)
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("value"),
    )
    summaries = pieces.mapInArrow(_summaries, "file string, block bigint, length bigint, size bigint, outside string, inside string")
    states = summaries.groupBy("file").applyInArrow(_chain, "file string, block bigint, state string").checkpoint(eager=True)
    # The states are one row per split; where they are too many to broadcast, the sort restores the order.
    chunks = pieces.drop("length").mapInArrow(_chunks, "file string, block bigint, number bigint, value binary")
    placed = lookup(chunks, states, ["file", "block"], "inner")
    placed = placed.sortWithinPartitions("file", "block", "number").select("file", "block", "state", "value")
    cut = placed.mapInArrow(partial(_cut, levels=levels), _CUT_SQL).checkpoint(eager=True)

    name = ["file", "role", "document", "member", "ord"]
    broken = cut.where("not whole").groupBy(*name).agg(
        F.max("container").alias("container"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"), F.max("end").alias("end")
    )
    joined = F.aggregate(F.transform("parts", lambda p: p["text"]), F.lit(b""), lambda a, b: F.concat(a, b))
    whole = cut.where("whole").select(*name, "container", "text", "end").unionByName(
        broken.select(*name, "container", joined.alias("text"), "end")
    )
    junk = whole.where("role = 'junk'").select("file").distinct()
    named = whole.where("role <> 'junk'").withColumn("text", F.col("text").cast("string")).join(junk, "file", "left_anti")
    # A container that holds nothing has no element; an empty place beside a comma is one, and no JSON.
    blank = (F.length(F.trim("text", F.lit(" \t\r\n"))) == 0) & (F.col("ord") == 0) & (F.col("end") == "]")
    elements = named.where((F.col("role") == "element") & ~blank).select("file", "document", "member", "ord", "container", "text")
    return elements, named.where("role = 'document'").select("file", "document", "text")
