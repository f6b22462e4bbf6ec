"""Near-dedup against all pairs in Python."""

import random
import re

import numpy as np
import xxhash

from contactlake.llm import simhash_vp as V
from contactlake.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, bits):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for text in ["", " \n", "A b", "a B c d", "É É É a b c d e F\x0bg h", "x y z w " * 5000, None]:
        assert V.simhash(text or "") == brute_print(text)


def planted(rng, n=500):
    base = [rng.getrandbits(64) for _ in range(n)]
    chain = [base[0]]
    for _ in range(60):  # a long chain of small steps
        chain.append(chain[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    near = [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (rng.randrange(1, 7),)]
    dense = [base[1] ^ sum(1 << i for i in rng.sample(range(64), 2)) for _ in range(200)]
    return list(dict.fromkeys([*base, *chain, *near, *dense, 0, 2**64 - 1]))


def test_links_are_complete(spark):
    prints = planted(random.Random(3))
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "__fp long")
    for leaf, sample in ((8, 300), (64, 10_000), (100_000, 50)):
        edges = V.link_edges(df, sample=sample, leaf=leaf).collect()
        unsigned = {(r.a % 2**64, r.b % 2**64) for r in edges}
        index = {p: i for i, p in enumerate(prints)}
        root = V._local_roots(len(prints), np.array([index[a] for a, _ in unsigned]), np.array([index[b] for _, b in unsigned]))
        expected = brute_classes(prints, 4)
        assert len({(int(a), b) for a, b in zip(root, expected, strict=True)}) == len(set(root.tolist())) == len(set(expected))


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 40, -1)] + [(1000 + i, 999) for i in range(50)] + [(7, 7), (5, 6), (6, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {got[i] for i in range(41, 102)} == {41} and {got[i] for i in range(999, 1050)} == {999} and got[6] == 5
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_and_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(50, "the quick brown fox jumps over it " * 9, "en", "a"), (51, "The quick brown fox jumps over it " * 9, "en", "a")]
    out = V.near_classes(make_docs(rows, clashing=True)).collect()
    assert len(out) == len(rows)
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_classes(prints, 4)
    smallest = {}
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None:
            smallest[c] = min(smallest.get(c, r[0]), r[0])
    expected = sorted((str(r[0]), p, str(smallest.get(c))) for r, p, c in zip(rows, prints, roots, strict=True))
    assert sorted((str(r["__id"]), r["__fp"] % 2**64, str(r["__class"])) for r in out) == expected
    kept = V.one_per_class(make_docs(rows, clashing=True)).collect()
    assert len(kept) == len(set(roots)) and all(r["__th"] == "own" for r in kept)
    assert V.near_classes(make_docs([])).count() == 0 and V.one_per_class(make_docs([])).count() == 0
