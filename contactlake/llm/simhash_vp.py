"""SimHash near-dedup through vantage-point trees over fingerprints.

Fingerprints are 64-bit SimHashes of word shingles.  Distinct fingerprints only
are searched; copies keep one.  Distances between unrelated 64-bit fingerprints
crowd around 32 bits, where a ball of radius k overlaps both sides of nearly
every split, so trees are built over three blocks of bits instead: two
fingerprints within k bits agree within floor(k / 3) bits on at least one block,
and on a short block with a small radius the triangle bounds do prune.

Per block, a tree built from a bounded sample of fingerprints (``sample``)
splits by distance to vantage points at the median.  A fingerprint's home is the
one leaf its own distances lead to; its ball also visits every leaf that the
bounds d - r <= mu or d + r > mu do not exclude.  Inside a leaf all home rows are
compared exactly with all rows there, in blocks, so each pair within k bits is
met in the home leaf of either end: the sample decides speed, never results.

Scale: leaves with too many home rows are split by salt, visitors are repeated
per salt.  A leaf answers with stars (fingerprint, smallest linked fingerprint),
at most one edge per row, never with all pairs of a group.  Work grows with
n to the power 1 + log2 of the visiting factor per level (about 1.4 for blocks of
21 bits and radius 1).

Nulls: a null text is empty; a text without words has fingerprint zero and links
like any other; null ids never become a class id unless a class has no other.
Rows that repeat an id or a text have one fingerprint.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm.common import Guarded, materialise, whole_text
from contactlake.llm.components import components

SHINGLE = 4
BITS = 4
BLOCKS = ((0, 21), (21, 21), (42, 22))
SAMPLE = 65_536
LEAF = 1_024
MAX_LEAVES = 65_536
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64 values."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and blanks alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*[words[i : i + n] for i in range(min(shingle, len(words)))], strict=True))
    hashes = np.fromiter(map(_hash, grams), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 16_384):
        bits = np.unpackbits(hashes[at : at + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t, shingle) for t in batch.column("__text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), batch.column("__th"), pa.array(prints)], ["__id", "__th", "__fp"]
        )


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __th, __fp): the id, a hash of the text and the fingerprint (64 bits in a long) of every row."""
    held = Guarded(docs)
    text = whole_text(held.col(text_col))
    rows = held.rows.select(held.col(id_col).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(partial(_fingerprint, shingle=shingle), f"__id {kind}, __th bigint, __fp bigint")


@dataclass
class Tree:
    """Nodes by index: a split has a vantage point, a radius and two children; a leaf has its number."""

    shift: int
    width: int
    radius: int
    vantage: list[int]
    mu: list[int]
    inner: list[int]
    outer: list[int]
    leaf: list[int]

    def values(self, prints: np.ndarray) -> np.ndarray:
        return (prints >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)

    def route(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, indexes of the prints there, whether it is their home)."""
        values = self.values(prints)
        todo = [(0, np.arange(len(prints)), np.ones(len(prints), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if self.leaf[node] >= 0:
                yield self.leaf[node], at, home
                continue
            d = np.bitwise_count(values[at] ^ np.uint64(self.vantage[node])).astype(np.int64)
            inside = d <= self.mu[node]
            near, far = d - self.radius <= self.mu[node], d + self.radius > self.mu[node]
            todo.append((self.inner[node], at[near], (home & inside)[near]))
            todo.append((self.outer[node], at[far], (home & ~inside)[far]))


def build_tree(sample: np.ndarray, block: tuple[int, int], radius: int, leaf_share: float, first_leaf: int) -> Tree:
    """Split at median distances until a node holds ``leaf_share`` of the sample or cannot be split."""
    tree = Tree(block[0], block[1], radius, [], [], [], [], [])
    rng = np.random.default_rng(block[0])
    values = tree.values(sample)

    def node() -> int:
        for part in (tree.vantage, tree.mu, tree.inner, tree.outer, tree.leaf):
            part.append(-1)
        return len(tree.leaf) - 1

    todo, leaves = [(node(), values)], first_leaf
    while todo:
        at, held = todo.pop()
        best = None
        if len(held) > max(2.0, leaf_share * len(values)):
            # Of a few candidates take the vantage point whose split sends the fewest both ways.
            for point in rng.choice(held, 8):
                d = np.bitwise_count(held ^ point).astype(np.int64)
                mu = int(np.median(d))
                both = np.mean((d - radius <= mu) & (d + radius > mu))
                inner = np.mean(d <= mu)
                if 0 < inner < 1 and (best is None or both + abs(inner - 0.5) < best[0]):
                    best = (both + abs(inner - 0.5), int(point), mu, d)
        if best is None or best[0] > 0.95:
            tree.leaf[at] = leaves
            leaves += 1
            continue
        _, tree.vantage[at], tree.mu[at], d = best
        tree.inner[at], tree.outer[at] = node(), node()
        todo.append((tree.inner[at], held[d <= tree.mu[at]]))
        todo.append((tree.outer[at], held[d > tree.mu[at]]))
    return tree


def _route(batches: Iterator[pa.RecordBatch], trees: list[Tree]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("__fp").to_numpy().view(np.uint64)
        for tree in trees:
            for leaf, at, home in tree.route(prints):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), leaf, np.int32)), pa.array(home), pa.array(prints[at].view(np.int64))],
                    ["leaf", "home", "fp"],
                )


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b, root[a], root[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _stars(table: pa.Table, bits: int) -> pa.Table:
    """Links of one leaf as stars: (a, b) with b the smallest fingerprint linked to a here."""
    home = table.column("home").to_numpy()
    prints = table.column("fp").to_numpy().view(np.uint64)
    mine, rest = np.sort(prints[home]), np.sort(prints[~home])
    every = np.concatenate([mine, rest])
    heads, tails = [], []
    for at in range(0, len(mine), 256):
        rows, cols = [], []
        for to in range(0, len(every), 65_536):
            d = np.bitwise_count(mine[at : at + 256, None] ^ every[None, to : to + 65_536])
            i, j = np.nonzero(d <= bits)
            off = i + at != j + to
            rows.append(i[off] + at)
            cols.append(j[off] + to)
        a, b = np.concatenate(rows), np.concatenate(cols)
        if len(a):
            nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = nodes[_local_roots(len(nodes), back[: len(a)], back[len(a) :])]
            heads.append(nodes[root != nodes])
            tails.append(root[root != nodes])
    if heads:
        a, b = np.concatenate(heads), np.concatenate(tails)
        nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[_local_roots(len(nodes), back[: len(a)], back[len(a) :])]
        a, b = every[nodes[root != nodes]], every[root[root != nodes]]
    else:
        a = b = np.zeros(0, np.uint64)
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def link_edges(distinct: DataFrame, bits: int = BITS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Stars (a, b) that connect all distinct fingerprints (column __fp) within ``bits`` of each other."""
    total = distinct.count()
    # The share keeps the driver's part near ``sample`` rows whatever the size; the limit makes it certain.
    share = distinct.where(
        F.pmod(F.xxhash64("__fp"), F.lit(1 << 20)) < min(1 << 20, int(1.2 * sample / max(total, 1) * (1 << 20)) + 1)
    )
    points = np.sort(np.array([r[0] for r in share.limit(sample).collect()], np.int64).view(np.uint64))
    leaf_share = max(leaf / max(total, 1), 1 / MAX_LEAVES, 4 / max(len(points), 1))
    trees, leaves = [], 0
    for block in BLOCKS:
        trees.append(build_tree(points, block, bits // len(BLOCKS), leaf_share, leaves))
        leaves = max([leaves - 1, *trees[-1].leaf]) + 1
    routed = materialise(
        distinct.select("__fp").mapInArrow(partial(_route, trees=trees), "leaf int, home boolean, fp bigint"), "vp-leaves"
    )
    # Leaves of unsplittable regions: home rows are dealt over salts, visitors meet each of them.
    crowded = (
        routed.where("home").groupBy("leaf").count().where(F.col("count") > 4 * leaf)
        .select(F.col("leaf").alias("__leaf"), F.ceil(F.col("count") / (2 * leaf)).cast("int").alias("__parts"))
    )
    salted = (
        routed.join(crowded, routed["leaf"] == crowded["__leaf"], "left")
        .withColumn("__parts", F.coalesce("__parts", F.lit(1)))
        .withColumn("__own", F.pmod(F.xxhash64("fp"), F.col("__parts")).cast("int"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        .select("leaf", "salt", (F.col("home") & (F.col("salt") == F.col("__own"))).alias("home"), "fp")
    )

    def stars(table: pa.Table) -> pa.Table:
        return _stars(table, bits)

    return salted.groupBy("leaf", "salt").applyInArrow(stars, "a bigint, b bigint")


def near_classes(
    docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, sample: int = SAMPLE, leaf: int = LEAF,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(__id, __th, __fp, __root, __class) per row: class id is the smallest id of the class, root its smallest linked print."""
    prints = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash")
    firsts = materialise(prints.groupBy("__fp").agg(F.min("__id").alias("__first")), "simhash-distinct")
    linked = components(link_edges(firsts, bits, sample, leaf))
    rooted = (
        firsts.join(linked, firsts["__fp"] == linked["node"], "left")
        .select("__fp", "__first", F.coalesce("root", "__fp").alias("__root"))
    )
    classes = rooted.groupBy("__root").agg(F.min("__first").alias("__class"))
    per_print = materialise(
        rooted.join(classes, "__root").select(F.col("__fp").alias("__print"), "__root", "__class"), "simhash-classes"
    )
    return prints.join(per_print, prints["__fp"] == per_print["__print"]).select("__id", "__th", "__fp", "__root", "__class")


def one_per_class(
    docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The row with the smallest id of every class, with all its columns; of repeated rows one."""
    held = Guarded(docs)
    rows = held.rows
    found = near_classes(rows, bits, shingle, id_col=held.name(id_col), text_col=held.name(text_col))
    best = found.groupBy("__root").agg(
        F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__th").alias("th"))).alias("__b")
    )
    best = best.select(F.coalesce(F.col("__b.id").cast("string"), F.lit("")).alias("__key"), F.col("__b.th").alias("__th"))
    keyed = rows.select(
        "*", F.coalesce(held.col(id_col).cast("string"), F.lit("")).alias("__key"),
        F.xxhash64(whole_text(held.col(text_col))).alias("__th"), F.xxhash64(*rows.columns).alias("__row"),
    )
    copy = Window.partitionBy("__key", "__th").orderBy("__row")
    kept = keyed.join(best, ["__key", "__th"], "left_semi").withColumn("__copy", F.row_number().over(copy))
    return held.restore(kept.where(F.col("__copy") == 1))
