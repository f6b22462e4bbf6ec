"""Prefix trie of conversations: adaptive radix trees over turn ids.

A turn's id is a 16-byte digest of role and text, so a conversation is a byte string
of fixed-width ids.  Conversations are cut into segments of ``SEGMENT`` turns, sorted
over the cluster by (start, key, conversation), and each task puts runs of at most
``KEYS`` of them into an adaptive radix tree (``radix_tree``).  Only lengths that are
whole turns emit nodes, and a tree emits each node once, whatever the number of its
conversations: the trees are the pre-aggregation.  A node's name is its depth and the sum
of digests of (position, turn id), which running sums give for the start of every
segment, so that one conversation with a third of all turns is many segments in many tasks.

Partial nodes are merged by name.  Sums over subtrees take rounds of pointer doubling,
logarithmically many in the depth.  Ids of conversations that end at a node leave the trees as
sorted runs; one digest has to read them in order, run by run, in bounded memory.

Nulls: a null role or text is empty; a null turn sorts first; rows without a conversation
id take no part.  Rows of equal turns are ordered by turn id (equal ones are equal
rows, each a turn).  Empty and long texts are turns like any other.  An empty table gives
no nodes, not even a root.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.llm.common import materialise, whole_text
from contactlake.llm.radix_tree import Tree
from contactlake.operators.ordering import running

WIDTH = 16
SEGMENT = 64
KEYS = 4_096
LANES = ("z0", "z1", "z2", "z3")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that stand for (role, text)."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def number_turns(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(c, pos, tid, chars): the turns of every conversation, numbered from 0 in order."""
    role, text = whole_text(f"`{role_col}`"), whole_text(f"`{text_col}`")
    turns = conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("c"), F.col(f"`{turn_col}`").alias("turn"),
        turn_id(role, text).alias("tid"), F.length(text).cast("long").alias("chars"),
    ).where("c is not null")
    ranked = running(turns, ["c"], [F.col("turn").asc_nulls_first(), F.col("tid")], row_number="n")
    return materialise(ranked.select("c", (F.col("n") - 1).alias("pos"), "tid", "chars"), "turns")


def _lanes(pos: int, tid: bytes) -> tuple[int, ...]:
    return struct.unpack(">4I", hashlib.md5(pos.to_bytes(8, "big") + tid).digest())


def node_name(depth: int, sums: tuple[int, ...] | list[int]) -> bytes:
    """16 bytes that stand for the first ``depth`` turns."""
    return hashlib.md5(struct.pack(">5q", depth, *sums)).digest()


ROOT = node_name(0, (0, 0, 0, 0))


def _segments(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sums = [], [[] for _ in LANES]
        for seg, turns in zip(batch.column("seg").to_pylist(), batch.column("tids").to_pylist(), strict=True):
            keys.append(b"".join(turns))
            lanes = [_lanes(seg * segment + i, t) for i, t in enumerate(turns)]
            for lane, out in enumerate(sums):
                out.append(sum(x[lane] for x in lanes))
        yield pa.RecordBatch.from_arrays(
            [batch.column("c"), batch.column("seg"), batch.column("last"), pa.array(keys, pa.binary()), batch.column("chars"),
             *[pa.array(s, pa.int64()) for s in sums]],
            ["c", "seg", "last", "key", "chars", *LANES],
        )


_PARTIAL = pa.schema([
    ("node", pa.binary()), ("parent", pa.binary()), ("turn_id", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()),
    ("first", pa.int64()), ("chars", pa.int64()), ("end", pa.int64()), ("ids", pa.string()),
])


def _emit(tree: Tree, base: int, start: tuple[int, ...], chars: dict[bytes, int]) -> Iterator[dict]:
    names, sums = {b"": node_name(base, start)}, {b"": start}
    for key, node, ends in tree.aligned(WIDTH):
        here = ends and node.ends
        row = {"n": node.size, "first": node.first, "end": node.ends[0] if here else None,
               "ids": ",".join(map(str, node.ends)) if here else None}
        if key:
            above, tid = key[:-WIDTH], key[-WIDTH:]
            depth = base + len(key) // WIDTH
            sums[key] = tuple(a + b for a, b in zip(sums[above], _lanes(depth - 1, tid), strict=True))
            names[key] = node_name(depth, sums[key])
            yield row | {"node": names[key], "parent": names[above], "turn_id": tid, "depth": depth, "chars": chars[tid]}
        elif not base:
            yield row | {"node": ROOT, "parent": None, "turn_id": None, "depth": 0, "chars": 0}


def _trees(batches: Iterator[pa.RecordBatch], segment: int, keys: int) -> Iterator[pa.RecordBatch]:
    """Partial nodes of sorted segments, a tree for each run of one start."""
    place, held, tree, chars = None, 0, Tree(), {}

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(list(_emit(tree, place[0] * segment, place[1], chars)), _PARTIAL)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("c", "seg", "last", "key", "chars", *LANES)]
        for c, seg, last, key, counts, *start in zip(*columns, strict=True):
            here = (seg, tuple(start))
            if held and (here != place or held == keys):
                yield flushed()
                tree, held, chars = Tree(), 0, {}
            place = here
            tree.insert(key, c, last)
            chars.update((key[i * WIDTH : (i + 1) * WIDTH], n) for i, n in enumerate(counts))
            held += 1
    if held:
        yield flushed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of its runs of ids, which come in order."""
    node, digest = None, None
    for batch in batches:
        nodes, digests = [], []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                nodes.append(node)
                digests.append(digest.hexdigest())
            node, digest = name, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def _subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(node, *sums) with the sums of the whole subtree, for all nodes but the root."""
    up = F.when(F.col("parent") != F.lit(ROOT), F.col("parent"))
    rows = materialise(nodes.where("depth > 0").select("node", up.alias("up"), *sums), "subtrees")
    while not rows.where("up is not null").isEmpty():
        # Each row adds its sum to the ancestor that its pointer reaches, and doubles the pointer.
        added = rows.where("up is not null").groupBy(F.col("up").alias("to")).agg(*[F.sum(s).alias(f"add_{s}") for s in sums])
        above = rows.select(F.col("node").alias("via"), F.col("up").alias("next"))
        rows = materialise(
            rows.join(added, rows["node"] == added["to"], "left").join(above, rows["up"] == above["via"], "left")
            .select("node", F.col("next").alias("up"), *[(F.col(s) + F.coalesce(f"add_{s}", F.lit(0))).alias(s) for s in sums]),
            "subtrees",
        )
    return rows.select("node", *sums)


def trie(turns: DataFrame, conversations: DataFrame, segment: int = SEGMENT, keys: int = KEYS) -> DataFrame:
    """Nodes of the trie of ``turns`` (c, pos, tid, chars; pos from 0 without gaps).

    ``conversations`` (c) names all of them, those without turns as well.  Returns per node: node and parent (names),
    turn_id (of its last turn), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 (digest of the ids that end here, ascending, comma-joined).
    ``segment`` and ``keys`` bound a segment's turns and a tree's segments; they decide memory, never results.
    """
    lengths = turns.groupBy("c").agg(F.count("*").alias("n_turns"))
    seg = F.floor(F.col("pos") / segment).cast("long")
    grouped = (
        turns.groupBy("c", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "chars"))).alias("t"))
        .select("c", "seg", F.col("t.tid").alias("tids"), F.col("t.chars").alias("chars"))
    )
    last = F.col("seg") == F.floor((F.col("n_turns") - 1) / segment)
    cut = grouped.join(lengths, "c").select("c", "seg", last.alias("last"), "tids", "chars")
    bare = conversations.select("c").distinct().join(lengths, "c", "left_anti").select(
        "c", F.lit(0).cast("long").alias("seg"), F.lit(True).alias("last"),
        F.array().cast("array<binary>").alias("tids"), F.array().cast("array<bigint>").alias("chars"),
    )
    kinds = "c bigint, seg bigint, last boolean, key binary, chars array<bigint>, " + ", ".join(f"{z} bigint" for z in LANES)
    segments = materialise(cut.unionByName(bare).mapInArrow(partial(_segments, segment=segment), kinds), "segments")
    # Only conversations of several segments need to know what came before.
    short = segments.where("seg = 0 and last").withColumns({z: F.lit(0).cast("long") for z in LANES})
    long = running(segments.where("not (seg = 0 and last)"), ["c"], [F.col("seg")], sums={f"upto_{z}": F.col(z) for z in LANES})
    long = long.select("c", "seg", "last", "key", "chars", *[(F.col(f"upto_{z}") - F.col(z)).alias(z) for z in LANES])
    order = ["seg", *LANES, "key", "c"]
    placed = short.unionByName(long).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialise(
        placed.mapInArrow(
            partial(_trees, segment=segment, keys=keys), "node binary, parent binary, turn_id binary, depth bigint, n bigint, first bigint, chars bigint, end bigint, ids string"
        ),
        "trie-parts",
    )
    merged = parts.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("turn_id").alias("turn_id"), F.min("depth").alias("depth"),
        F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.min("chars").alias("chars"),
    )
    nodes = materialise(merged, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    valued = materialise(
        nodes.join(children, "node", "left").select(
            *nodes.columns, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
        ),
        "trie-valued",
    )
    below = _subtree_sums(valued, ["n_leaves", "saved_tokens"])
    top = valued.groupBy().agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    whole = below.unionByName(top.select(F.lit(ROOT).alias("node"), "n_leaves", "saved_tokens"))
    runs = (
        parts.where("ids is not null").select("node", "end", "ids").repartition("node").sortWithinPartitions("node", "end")
        .mapInArrow(_digests, "node binary, ends_sha256 string")
    )
    parents = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    joined = valued.drop("n_leaves", "saved_tokens").join(whole, "node").join(runs, "node", "left")
    return joined.join(parents, F.col("parent") == F.col("above"), "left").select(
        "node", "parent", "turn_id", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
