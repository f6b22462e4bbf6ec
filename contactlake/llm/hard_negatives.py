"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors become whole numbers (``floor(scale * x)``), so that scores are exact inner
products.  Rows are sorted by label and by their place on a Hilbert curve through the cells
of all dimensions, and written as blocks of ``BLOCK_ROWS`` rows of one label, with
the smallest and largest value of every dimension: the zone map.  For an anchor a zone map
bounds every score in the block by interval arithmetic.

Positives: the block an anchor lies in gives a first score that its last positive has to
reach; only blocks of its label whose upper bound reaches that are read.  Negatives: every
positive opens a window of scores; only blocks of other labels whose bounds meet a window
are read.  A block that is read answers each window with its best rows, and the best of
all blocks are the result.  Bounds are widened by more than their rounding, so no row is lost.

Scale: anchors against zone maps, and anchors against blocks, are grids of parts of bounded
size, so neither a label nor a block that every anchor needs fills a task.  Bounds skip
blocks where vectors are clustered; where they are spread evenly in many dimensions nearly
every block has to be read, as any exact method would.

Nulls: rows without id or label, without a vector, or with a null or non-finite component take no part;
a null anchor mark is no anchor.  Components that a shorter vector lacks count as zero.  Rows
that repeat id, label and vector count once.  Rows of one id are never each other's positives or
negatives.  Ties go to the smaller id.  Scores beyond 64 bits are cut to them in the result.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm.common import materialise
from contactlake.llm.hilbert import curve_keys

BLOCK_ROWS = 512
CELL_BITS = 4
ANCHOR_PART = 1_024
ZONE_PART = 4_096
_LONG = 2**63


def _code(vector: list | None, scale: float) -> np.ndarray | None:
    if vector is None or None in vector:
        return None
    v = np.array(vector, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * v), -top, top)


def _encode(code: np.ndarray) -> bytes:
    """Two-byte numbers where they fit, else doubles; the first byte tells."""
    if not code.size or np.abs(code).max() < 2**15:
        return b"h" + code.astype(np.int16).tobytes()
    return b"d" + code.astype(np.float64).tobytes()


def _decode(rows: list[bytes], width: int = 0) -> np.ndarray:
    """Rows as doubles, filled with zeros to the longest one or to ``width``."""
    found = [np.frombuffer(r, np.int16 if r[:1] == b"h" else np.float64, offset=1) for r in rows]
    out = np.zeros((len(rows), max([width, *map(len, found)])))
    for at, row in enumerate(found):
        out[at, : len(row)] = row
    return out


def _codes(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("id", "label", "anchor", "vector")], strict=True)
        kept = [(i, lab, a, _encode(c)) for i, lab, a, v in rows if (c := _code(v, scale)) is not None]
        yield pa.RecordBatch.from_pylist([dict(zip(("id", "label", "anchor", "code"), r, strict=True)) for r in kept], _CODED)


_CODED = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("code", pa.binary())])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            m = _decode(batch.column("code").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(m.shape[1]), pa.int32()), pa.array(m.min(axis=0)), pa.array(m.max(axis=0))], ["dim", "lo", "hi"]
            )


def _placed(batches: Iterator[pa.RecordBatch], lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    cells, top = np.maximum(hi - lo, 1), (1 << CELL_BITS) - 1
    for batch in batches:
        m = _decode(batch.column("code").to_pylist(), len(lo))
        keys = curve_keys(np.floor((m - lo) / cells * (top + 0.999)).clip(0, top).astype(np.uint32), CELL_BITS)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "place"])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles while they are whole, else Python numbers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if not width or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < 2**53:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).dot(whole(b).T)


def _long(value) -> int:
    return max(-_LONG, min(_LONG - 1, int(value)))


_BLOCK = pa.schema([
    ("block", pa.int64()), ("label", pa.int64()), ("ids", pa.list_(pa.int64())), ("codes", pa.list_(pa.binary())),
    ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
    ("anchors", pa.list_(pa.struct([("at", pa.int32()), ("reach", pa.float64())]))),
])
_BLOCK_SQL = (
    "block bigint, label bigint, ids array<bigint>, codes array<binary>, lo array<double>, hi array<double>, "
    "anchors array<struct<at: int, reach: double>>"
)


def _block(number: int, label: int, rows: list[tuple], positives: int) -> dict:
    ids = np.array([r[0] for r in rows], np.int64)
    codes = [r[2] for r in rows]
    m = _decode(codes)
    anchors = np.array([i for i, r in enumerate(rows) if r[1]], np.int64)
    marks = []
    if len(anchors):
        s = _scores(m[anchors], m)
        for at, row in zip(anchors, s, strict=True):
            others = np.sort(row[ids != ids[at]])[::-1]
            reach = float(others[positives - 1]) if len(others) >= positives else -np.inf
            marks.append({"at": int(at), "reach": reach})
    return {"block": number, "label": label, "ids": ids.tolist(), "codes": codes, "lo": m.min(axis=0).tolist(),
            "hi": m.max(axis=0).tolist(), "anchors": marks}


def _pack(batches: Iterator[pa.RecordBatch], block_rows: int, positives: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    label, rows, last = None, [], None
    for batch in batches:
        for vid, lab, anchor, code in zip(*[batch.column(c).to_pylist() for c in ("id", "label", "anchor", "code")], strict=True):
            if rows and (lab != label or len(rows) == block_rows):
                yield pa.RecordBatch.from_pylist([_block(number, label, rows, positives)], _BLOCK)
                number, rows = number + 1, []
            if (vid, lab, code) != last:
                rows.append((vid, anchor, code))
                label = lab
            last = (vid, lab, code)
    if rows:
        yield pa.RecordBatch.from_pylist([_block(number, label, rows, positives)], _BLOCK)


def write_blocks(
    rows: DataFrame, anchor: Column, positives: int, scale: float, block_rows: int, id_col: str, vector_col: str, label_col: str
) -> DataFrame:
    """Blocks (block, label, ids, codes, lo, hi, anchors), written in order of label and curve."""
    named = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"),
    ).where("id is not null and label is not null")
    coded = materialise(named.mapInArrow(partial(_codes, scale=scale), "id bigint, label bigint, anchor boolean, code binary"), "codes")
    # As many rows as a vector has dimensions.
    spans = coded.mapInArrow(_spans, "dim int, lo double, hi double").groupBy("dim").agg(F.min("lo"), F.max("hi")).orderBy("dim").collect()
    lo, hi = np.array([r[1] for r in spans]), np.array([r[2] for r in spans])
    placed = coded.mapInArrow(partial(_placed, lo=lo, hi=hi), "id bigint, label bigint, anchor boolean, code binary, place binary")
    order = ["label", "place", "id", "code"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order, F.col("anchor").desc())
    return materialise(ordered.mapInArrow(partial(_pack, block_rows=block_rows, positives=positives), _BLOCK_SQL), "blocks")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            for mark in r["anchors"]:
                rows.append({"akey": f"{r['block']}:{mark['at']}", "anchor_id": r["ids"][mark["at"]], "label": r["label"],
                             "code": r["codes"][mark["at"]], "reach": mark["reach"]})
        yield pa.RecordBatch.from_pylist(rows, _ANCHOR)


_ANCHOR = pa.schema([("akey", pa.string()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("code", pa.binary()), ("reach", pa.float64())])
_WINDOWS = "array<struct<positive_id: bigint, positive_score: bigint>>"


def _bounds(codes: np.ndarray, zones: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest possible score of each code in each zone, widened by more than the rounding."""
    width = max([codes.shape[1], *(len(z["lo"]) for z in zones)])
    codes = np.pad(codes, ((0, 0), (0, width - codes.shape[1])))
    lo, hi = np.zeros((2, len(zones), width))
    for at, z in enumerate(zones):
        lo[at, : len(z["lo"])], hi[at, : len(z["hi"])] = z["lo"], z["hi"]
    up, down = np.maximum(codes, 0), np.minimum(codes, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        low, high = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
        size = np.abs(codes) @ np.maximum(np.abs(lo), np.abs(hi)).T * 1e-9 + 1
        low, high = low - size, high + size
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def _choose_blocks(anchors: pa.Table, zones: pa.Table, windows: bool, low: int, high: int) -> pa.Table:
    """(block, anchor row) for the blocks that an anchor has to read."""
    if not len(anchors) or not len(zones):
        return anchors.slice(0, 0).append_column("block", pa.array([], pa.int64()))
    maps = zones.to_pylist()
    least, most = _bounds(_decode(anchors.column("code").to_pylist()), maps)
    mine = anchors.column("label").to_numpy()[:, None] == zones.column("label").to_numpy()[None, :]
    if windows:
        need = np.zeros(mine.shape, bool)
        for at, found in enumerate(anchors.column("found").to_pylist()):
            for f in found:
                lo, hi = _window(f["positive_score"], low, high)
                if lo <= hi:
                    need[at] |= (most[at] >= lo) & (least[at] <= hi)
        need &= ~mine
    else:
        need = mine & (most >= anchors.column("reach").to_numpy()[:, None])
    a, z = np.nonzero(need)
    return anchors.take(pa.array(a)).append_column("block", zones.column("block").take(pa.array(z)))


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _read_block(block: pa.Table, anchors: pa.Table, windows: bool, positives: int, negatives: int, low: int, high: int) -> pa.Table:
    """The best rows of one block for each anchor, or for each of its windows."""
    rows = []
    if len(block) and len(anchors):
        held = block.to_pylist()[0]
        ids = np.array(held["ids"], np.int64)
        by_id = np.argsort(ids, kind="stable")
        ids, codes = ids[by_id], _decode([held["codes"][i] for i in by_id])
        asking = anchors.to_pylist()
        scores = _scores(_decode([a["code"] for a in asking]), codes)
        orders = np.argsort(-scores, axis=1, kind="stable")  # ties by id
        for a, s, order in zip(asking, scores, orders, strict=True):
            order = order[ids[order] != a["anchor_id"]]
            s = s[order]
            head = {"akey": a["akey"], "anchor_id": a["anchor_id"]}
            if not windows:
                rows += [head | {"other_id": int(ids[order[i]]), "score": _long(s[i])} for i in range(min(positives, len(s)))]
                continue
            for f in a["found"]:
                lo, hi = _window(f["positive_score"], low, high)
                start = int((s > hi).sum())
                rows += [
                    head | f | {"other_id": int(ids[order[i]]), "score": _long(s[i])}
                    for i in range(start, min(start + negatives, len(s))) if s[i] >= lo
                ]
    return pa.Table.from_pylist(rows, _HIT)


_HIT = pa.schema([
    ("akey", pa.string()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()),
    ("other_id", pa.int64()), ("score", pa.int64()),
])
_HIT_SQL = "akey string, anchor_id bigint, positive_id bigint, positive_score bigint, other_id bigint, score bigint"


def _best(hits: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
    block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` marks.

    Positives are the first rows of the anchor's label; negatives of a positive the first rows of other labels with scores from
    ``low`` to ``high`` percent of the positive's.
    """
    blocks = write_blocks(rows, anchor, positives, scale, block_rows, id_col, vector_col, label_col)
    anchors = materialise(
        blocks.where(F.size("anchors") > 0).mapInArrow(_anchors, "akey string, anchor_id bigint, label bigint, code binary, reach double"),
        "anchors",
    )
    n_parts = max(1, -(-anchors.count() // ANCHOR_PART))
    n_zones = max(1, -(-blocks.count() // ZONE_PART))
    part = F.pmod(F.xxhash64("akey"), F.lit(n_parts)).cast("int").alias("part")
    zone = F.pmod(F.xxhash64("block"), F.lit(n_zones)).cast("int").alias("zone")
    zones = blocks.select("block", "label", "lo", "hi", zone, F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
    pieces = blocks.select("block", "ids", "codes", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))

    def pass_over(asking: DataFrame, windows: bool) -> DataFrame:
        dealt = asking.select("*", part, F.explode(F.sequence(F.lit(0), F.lit(n_zones - 1))).alias("zone"))

        def choose(left: pa.Table, right: pa.Table) -> pa.Table:
            return _choose_blocks(left, right, windows, low, high)

        def read(left: pa.Table, right: pa.Table) -> pa.Table:
            return _read_block(left, right, windows, positives, negatives, low, high)

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", block bigint"
        wanted = dealt.groupBy("part", "zone").cogroup(zones.groupBy("part", "zone")).applyInArrow(choose, kinds)
        return pieces.groupBy("block", "part").cogroup(wanted.groupBy("block", "part")).applyInArrow(read, _HIT_SQL)

    near = materialise(_best(pass_over(anchors, False), ["akey"], positives), "positives")
    found = near.groupBy("akey").agg(
        F.collect_list(F.struct(F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))).cast(_WINDOWS).alias("found")
    )
    far = _best(pass_over(anchors.join(found, "akey"), True), ["akey", "positive_id", "positive_score"], negatives)
    return far.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
