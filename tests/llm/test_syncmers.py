"""Syncmer fingerprints against Python, with Spark's own hash rebuilt from XXH64."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from contactlake.llm import syncmers as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def xx(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_anchors(text, k=5, s=2):
    w = WORD.findall(text or "")
    if not w:
        return []
    if len(w) < k:
        return [(0, xx(*w))]
    h = [xx(*w[i : i + s]) for i in range(len(w) - s + 1)]
    inner, out = k - s + 1, []
    for i in range(len(w) - k + 1):
        window = h[i : i + inner]
        if min(window) in (window[0], window[-1]):
            out.append((i, xx(h[i], h[i + 2], h[i + 3])))
    return out


def brute_sketch(text, size=S.SIZE):
    return sorted({a >> 32 for _, a in brute_anchors(text)})[:size]


def brute_likeness(a, b, size=S.SIZE):
    union = sorted({*a, *b})[:size]
    return len({*a} & {*b} & {*union}) / len(union) if union else 1.0


def text_of(seed, n):
    return " ".join(hashlib.md5(f"{seed}{i}".encode()).hexdigest()[:5] for i in range(n))


def test_anchors(spark, make_docs):
    texts = ["", "a b", "a b c d", "a b c d e", "x " * 50, text_of(1, 300), "É ß\x0b😀 a b c d"]
    docs = make_docs([(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: [(a.pos, a.hash) for a in r.a] for r in docs.select("doc_id", S.anchors(F.col("text")).alias("a")).collect()}
    assert got == {i: brute_anchors(t) for i, t in enumerate(texts)}
    rows = S.anchor_rows(docs).where("doc_id = 5").collect()
    assert sorted((r.pos, r.hash) for r in rows) == brute_anchors(texts[5])


def test_anchors_do_not_depend_on_context(make_docs):
    core = text_of("core", 60)
    docs = make_docs([(1, text_of("a", 17) + " " + core, "en", "a"), (2, text_of("b", 40) + " " + core + " " + text_of("c", 9), "en", "a")])
    rows = S.anchor_rows(docs)
    left, right = (rows.where(F.col("doc_id") == i).select("hash", F.col("pos").alias(f"p{i}")) for i in (1, 2))
    shifts = {r.p2 - r.p1 for r in left.join(right, "hash").collect()}
    assert shifts == {23}


@pytest.mark.parametrize("clashing", [False, True])
def test_half_edits(make_docs, odd_rows, clashing):
    rows = odd_rows + [(20 + i, text_of(i % 5, 400 + i), "en", "a") for i in range(9)]
    out = S.half_edits(make_docs(rows, clashing)).collect()
    chain = list(dict.fromkeys((r[0], r[1] or "") for r in rows))
    chain.sort(key=lambda d: (d[0] is None, -(d[0] or 0), xx(d[1])))
    expected = {}
    for i, (key, text) in enumerate(chain):
        nxt, half = chain[(i + 1) % len(chain)][1], len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        expected[key, edited] = (len(text), brute_sketch(text), brute_sketch(edited), brute_sketch(nxt))
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_chars, r.sketch, r.edited_sketch, r.next_sketch) == expected[r.doc_id, r.edited]
    assert {(r.doc_id, r.edited) for r in out} == set(expected)


def test_likeness_and_empty(spark, make_docs):
    pairs = [(brute_sketch(text_of(1, 500)), brute_sketch(text_of(1, 500) + " x")), ([], []), ([1], []), ([1, 2], [2, 3])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<int>, b array<int>")
    got = {r.i: r.n for r in df.select("i", S.likeness(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: pytest.approx(brute_likeness(a, b)) for i, (a, b) in enumerate(pairs)}
    assert df.select(S.printed(F.col("a")).alias("p")).collect()[3].p == "0000000100000002"
    assert S.half_edits(make_docs([])).count() == 0
