"""Embedding near-dedup through navigable small-world graphs per shard.

Equal vectors keep one row first, so a vector that fills a third of the table is one
row of what follows.  Distinct vectors are dealt over shards by hash; each shard builds
a graph (``hnsw``) and widens its beam until planted probes at the threshold find
their neighbours (``recall``); where no beam does, the shard is scanned.  Graphs are
written to the shared folder.  Every vector then queries every shard: a task holds one
shard's graph and one bounded part of the queries.  Hits are verified by cosine in
double precision and leave a task as stars, at most one edge per vector and part.

Components of the stars are classes.  Inside a class all members are compared exactly,
in blocks on a grid, so that the number of links does not depend on a beam: a link
is lost only if its two ends share no chain of found links.

Scale: the shards' number is at least ``SHARDS`` and grows with the table beyond
``SHARD_ROWS`` vectors each; searching costs the logarithm of a shard times their
number.  Copies of a vector are never compared; different texts of one large class are.

Nulls: vectors that are null, empty, zero or hold null or non-finite components, and
rows without an id, link with nothing and are kept.  Vectors of different lengths
never link.  Equal vectors link whatever their ids; rows that repeat an id are rows of
their own.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm import hnsw
from contactlake.llm.common import Guarded, materialise
from contactlake.llm.components import components

LEAST = 0.95
BEAM = 48
RECALL = 0.99
SHARDS = 4
SHARD_ROWS = 262_144
QUERY_ROWS = 8_192
BLOCK = 1_024
_SLACK = 1e-4  # of single precision


def _unit(vector: list | None) -> np.ndarray | None:
    if not vector or None in vector:
        return None
    v = np.array(vector, np.float64)
    size = np.abs(v).max()
    if not np.isfinite(v).all() or size == 0:
        return None
    v = v / size
    return v / np.sqrt(np.dot(v, v))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, units, dims = [], [], []
        for vid, vector in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
            unit = None if vid is None else _unit(vector)
            units.append(None if unit is None else unit.tobytes())
            dims.append(0 if unit is None else len(unit))
            # A vector is its values, not its direction; rows without one get keys of their own.
            held = b"-%d" % (vid or 0) if unit is None else (np.array(vector, np.float64) + 0.0).tobytes()
            keys.append(hashlib.md5(held).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
            ["id", "key", "dim", "unit"],
        )


def _matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _build(table: pa.Table, least: float, beam: int, recall: float) -> pa.Table:
    table = table.sort_by("key")  # keys are hashes: a random order, the same in every run
    graph = hnsw.build(_matrix(table.column("unit")).astype(np.float32))
    beam = hnsw.audited_beam(graph, least, beam, recall)
    links = [b"".join(x[i].tobytes() for x in graph.layers[::-1] if i < len(x)) for i in range(len(table))]
    return pa.table({
        "dim": table.column("dim"), "shard": table.column("shard"), "row": pa.array(range(len(table)), pa.int32()),
        "beam": pa.array([beam] * len(table), pa.int32()), "key": table.column("key"), "unit": table.column("unit"),
        "links": pa.array(links, pa.binary()),
    })


def _graph(table: pa.Table) -> hnsw.Graph:
    vecs = _matrix(table.column("unit")).astype(np.float32)
    links = table.column("links").to_pylist()
    size = hnsw.WIDTH * 4
    layers = []
    for level, n in enumerate(hnsw.layer_sizes(len(vecs))[::-1]):
        layers.append(np.frombuffer(b"".join(x[level * size : (level + 1) * size] for x in links[:n]), np.int32).reshape(n, -1))
    return hnsw.Graph(vecs, layers[::-1])


def _scan(vecs: np.ndarray, queries: np.ndarray, least: float):
    for at in range(0, len(queries), 32):
        q, v = np.nonzero(queries[at : at + 32] @ vecs.T >= least - _SLACK)
        yield q + at, v


def _hits(graph: hnsw.Graph, queries: np.ndarray, beam: int, least: float):
    if not beam:
        yield from _scan(graph.vecs, queries, least)
        return
    for at, ids, sims in hnsw.search(graph, queries, beam):
        q, c = np.nonzero(sims >= least - _SLACK)
        yield q + at, ids[q, c]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        for side in (root[a], root[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _query(shard: pa.Table, asked: pa.Table, least: float) -> pa.Table:
    if not len(shard) or not len(asked):
        return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    shard = shard.sort_by("row")
    graph, beam = _graph(shard), shard.column("beam")[0].as_py()
    mine, there = _matrix(asked.column("unit")), _matrix(shard.column("unit"))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, v in _hits(graph, mine.astype(np.float32), beam, least):
        exact = np.einsum("ij,ij->i", mine[q], there[v]) >= least
        a.append(q[exact])
        b.append(v[exact] + len(mine))
    root = _roots(len(mine) + len(there), np.concatenate(a), np.concatenate(b))
    keys = np.array(asked.column("key").to_pylist() + shard.column("key").to_pylist(), object)
    moved = np.nonzero(root != np.arange(len(root)))[0]
    moved = moved[keys[moved] != keys[root[moved]]]
    return pa.table({"a": pa.array(keys[moved], pa.binary()), "b": pa.array(keys[root[moved]], pa.binary())})


def _counts(table: pa.Table, least: float) -> pa.Table:
    """Weighted links of the left rows to the right rows of their class; without right rows, among themselves."""
    table = table.sort_by([("root", "ascending"), ("key", "ascending")])
    root = np.array(table.column("root").to_pylist(), object)
    keys = np.array(table.column("key").to_pylist(), object)
    units, copies = _matrix(table.column("unit")), table.column("copies").to_numpy()
    left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
    ends = np.append(np.nonzero(root[1:] != root[:-1])[0] + 1, len(root))
    out_keys, out_links, start = [], [], 0
    for end in ends:
        part = slice(start, end)
        start = end
        a = left[part]
        b = a if a.all() else ~a
        near = units[part][a] @ units[part][b].T >= least
        near &= keys[part][a][:, None] != keys[part][b][None, :]
        out_keys.extend(keys[part][a])
        out_links.extend(near @ copies[part][b])
    return pa.table({"key": pa.array(out_keys, pa.binary()), "links": pa.array(np.array(out_links, np.int64))})


def _links(members: DataFrame, least: float) -> DataFrame:
    """(key, links) of members (key, unit, copies, root): exact comparisons inside classes, on a grid of blocks."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.join(sizes.select("root", blocks.alias("blocks")), "root")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rest = ["key", "unit", "copies", "root"]
    # Classes of one block share tasks by hash; one side serves both.
    buckets = max(1, members.count() // (4 * BLOCK))
    small = rows.where("blocks = 1").select(
        F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("string").cast("binary").alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"),
        F.lit(True).alias("left"), *rest,
    )
    large = rows.where("blocks > 1").select(
        F.col("root").alias("g"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), *rest
    )
    lefts = large.select("g", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("left"), *rest)
    rights = large.select("g", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"), *rest)

    def counts(table: pa.Table) -> pa.Table:
        return _counts(table, least)

    grid = small.unionByName(lefts).unionByName(rights)
    return grid.groupBy("g", "i", "j").applyInArrow(counts, "key binary, links bigint").groupBy("key").agg(F.sum("links").alias("links"))


def near_vectors(
    vectors: DataFrame, least: float = LEAST, beam: int = BEAM, recall: float = RECALL,
    shards: int = SHARDS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (ids are long)."""
    held = Guarded(vectors)
    rows = held.rows.select(held.col(id_col).cast("long").alias("id"), held.col(vector_col).alias("vector"))
    keyed = materialise(rows.mapInArrow(_read, "id bigint, key binary, dim int, unit binary"), "vectors")
    copies = keyed.where("dim > 0").groupBy("key").agg(
        F.min("id").alias("first"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit")
    )
    distinct = materialise(copies, "vectors-distinct")
    total = distinct.count()
    n_shards, n_parts = max(shards, -(-total // shard_rows)), max(1, -(-total // query_rows))
    placed = distinct.select("dim", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int").alias("shard"), "key", "unit")

    def build(table: pa.Table) -> pa.Table:
        return _build(table, least, beam, recall)

    graphs = materialise(
        placed.groupBy("dim", "shard").applyInArrow(
            build, "dim int, shard int, row int, beam int, key binary, unit binary, links binary"
        ),
        "vector-graphs",
    )
    part = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(n_parts)).cast("int")
    asked = distinct.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), part.alias("part"), "key", "unit"
    )
    answering = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))

    def query(shard: pa.Table, queries: pa.Table) -> pa.Table:
        return _query(shard, queries, least)

    place = ("dim", "shard", "part")
    stars = answering.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(query, "a binary, b binary")
    classes = materialise(components(stars), "vector-classes")

    members = materialise(
        distinct.join(classes.select(F.col("node").alias("key"), "root"), "key").select("key", "unit", "copies", "first", "root"),
        "vector-members",
    )
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = members.select("key", "root").join(smallest, "root").select("key", "component_id")
    counted = (
        distinct.select("key", "first", "copies")
        .join(linked, "key", "left").join(_links(members, least), "key", "left")
        .where("copies > 1 or component_id is not null")
        .select(
            F.col("key").alias("__key"), F.coalesce("component_id", "first").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    found = keyed.select("id", "key").join(counted, F.col("key") == F.col("__key"), "left")
    component = F.coalesce("component_id", "id")
    return found.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
