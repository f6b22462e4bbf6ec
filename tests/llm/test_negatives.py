"""Hard negatives against all pairs; curve keys against their defining property."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from contactlake.llm import hard_negatives as H
from contactlake.llm.hilbert import curve_keys

SCHEMA = "vec_id long, embedding array<double>, label int, kept string, block string"


def brute(rows, positives=5, negatives=10):
    seen = {
        (i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows
        if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)
    }
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in seen:
        if a[0] % 100:
            continue
        ranked = sorted(((-score(a, b), b[0], b[1]) for b in seen if b[0] != a[0]))
        for s, p, _ in [r for r in ranked if r[2] == a[1]][:positives]:
            window = [r for r in ranked if r[2] != a[1] and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(window)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


def clustered(seed, n=900, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    rows = []
    for i in range(n):
        k = int(rng.integers(12))
        rows.append((i, [float(x) for x in centres[k] + 0.2 * rng.standard_normal(dims)], int(k % 4) if i % 3 else 0))
    return rows


def test_equal_to_all_pairs(spark, monkeypatch):
    rows = clustered(1) + [(10_000 + i, [0.5] * 8, i % 2) for i in range(40)]
    df = spark.createDataFrame([(*r, "own", "b") for r in rows], SCHEMA)
    want = brute(rows)
    assert want
    assert mined(df) == want
    monkeypatch.setattr(H, "ANCHOR_PART", 2)
    monkeypatch.setattr(H, "ZONE_PART", 5)
    assert mined(df.repartition(7), block_rows=16) == want


def test_bounds_skip_blocks_of_clustered_vectors():
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(8) * 256
    block = np.floor(centre + rng.standard_normal((64, 8)) * 5)
    zone = [{"lo": block.min(axis=0).tolist(), "hi": block.max(axis=0).tolist()}]
    anchor = np.floor(rng.standard_normal((50, 8)) * 256)
    low, high = H._bounds(anchor, zone)
    scores = anchor @ block.T
    assert (low[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= high[:, 0]).all()
    assert np.median((high - low)[:, 0] / (np.abs(scores).max() + 1)) < 0.2


def test_odd_rows(spark):
    nan = float("nan")
    rng = random.Random(4)
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [2.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0], 1), (3, [], 1), (4, [0.5, 0.5], 2), (5, [0.5, 0.5], 2),
        (6, [0.9, 0.2], 3), (7, None, 1), (8, [None, 1.0], 1), (9, [nan, 1.0], 1), (None, [1.0, 1.0], 1), (10, [1.0, 1.0], None), (100, [-1.0, -1.0], 1),
        (200, [0.0, 0.0], 5), (201, [0.0, 0.0], 5), (300, [3.0, 1.0, 7.0], 9), (301, [4e7, 1e8], 9), (302, [2.5, 3e7], 8), (400, [5e7, 6e7], 9),
    ] + [(20 + i, [rng.uniform(-1, 1), rng.uniform(-1, 1)], rng.randrange(4)) for i in range(60)]
    df = spark.createDataFrame([(*r, "own", "b") for r in rows], SCHEMA)
    assert mined(df, block_rows=4) == brute(rows)
    huge = spark.createDataFrame([(0, [1e300, 1e308], 1, "", ""), (1, [1e300, 1.0], 1, "", ""), (2, [1e299, 5.0], 2, "", "")], SCHEMA)
    assert mined(huge) == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)] or mined(huge) == []
    assert mined(df.limit(0)) == []


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = cells[np.argsort(np.array(curve_keys(cells, bits), object), kind="stable")]
        assert len(set(curve_keys(cells, bits))) == len(cells)
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
