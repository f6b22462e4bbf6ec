"""Embedding near-dedup against all pairs, and the graph's recall."""

import numpy as np
import pytest
from pyspark.sql import types as T

from contactlake.llm import embedding_hnsw as E
from contactlake.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def near(rng, v, cosine):
    turn = rng.standard_normal(v.shape)
    turn -= (turn @ v) / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * turn / np.linalg.norm(turn)


@pytest.fixture(scope="module")
def vectors():
    """Loose vectors, near pairs on both sides of the threshold, a large group of near copies, a chain, exact copies."""
    rng = np.random.default_rng(3)
    loose = rng.standard_normal((400, 24))
    out = list(loose)
    out += [near(rng, v, c) for v in loose[:60] for c in (0.96, 0.94)]
    out += [near(rng, loose[100], 0.985) for _ in range(150)]
    chain = [loose[200]]
    for _ in range(40):
        chain.append(near(rng, chain[-1], 0.955))
    out += chain[1:] + [loose[300]] * 30 + [2 * loose[301]]
    return np.array(out, np.float32)


def brute(rows):
    """(n_links, component) per row."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, root = [0] * n, list(range(n))
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if i is not None and usable(v) else None for i, v in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], least.get(find(i)), rows[i][0] == least.get(find(i))) for i in range(n)]


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_classes_and_links_equal_all_pairs(spark, vectors):
    rows = [((i * 37) % 1009, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, 0, "own") for r in rows], SCHEMA)
    want = sorted(brute(rows), key=str)
    assert shown(E.near_vectors(df)) == want
    # Many shards and parts of few queries give the same; so does the scan that stands in for a graph.
    assert shown(E.near_vectors(df, shards=7, query_rows=100)) == want
    assert shown(E.near_vectors(df, beam=10**9)) == want


def test_large_classes_are_compared_in_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, 0, "own") for r in rows], SCHEMA)
    assert shown(E.near_vectors(df)) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.1]),
        (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [3e38, 0.0]), (11, [1e-40, -0.0]), (12, [-1.0, 0.0]), (None, None), (3, [1.0, 0.05]),
    ]
    df = spark.createDataFrame([(*r, None, "own") for r in rows], SCHEMA)
    got = shown(E.near_vectors(df))
    want = [(i, n, c, True if i is None else k) for i, n, c, k in brute(rows)]
    assert got == sorted(want, key=str)
    empty = E.near_vectors(df.limit(0))
    assert empty.collect() == [] and [f.dataType for f in empty.schema.fields] == [T.LongType(), T.LongType(), T.LongType(), T.BooleanType()]


def test_beam_is_widened_until_probes_are_found():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3_000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.build(v)
    assert [len(x) for x in graph.layers] == hnsw.layer_sizes(3_000)
    beam = hnsw.audited_beam(graph, 0.95, 4, 0.99)
    queries = np.array([near(rng, x, 0.951) for x in v], np.float32)
    found = np.concatenate([ids[:, 0] for _, ids, _ in hnsw.search(graph, queries, beam)])
    assert (found == np.arange(3_000)).mean() > 0.97
    broken = hnsw.Graph(v, [np.full_like(x, -1) for x in graph.layers])
    assert hnsw.audited_beam(broken, 0.95, 4, 0.99) == 0
