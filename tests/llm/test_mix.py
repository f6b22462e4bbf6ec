"""Source mix: targets, near totals, caps, odd rows."""

import re

import pytest

from contactlake.llm import pareto_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(cap * sizes[s] for s in stopped)
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return {**{s: cap * sizes[s] for s in stopped}, **target}
        stopped |= over


def test_targets_and_totals(make_docs):
    rows = [(i, "w " * (1 + i * 7 % 40), "en", "abcde"[min(4, i % 17)] if i % 17 < 9 else None) for i in range(600)]
    out = pareto_mix.mix(make_docs(rows)).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    expected = brute_targets(sizes)
    for source in sizes:
        mine = [r for r in out if r.source == source]
        assert mine[0].mix_target == pytest.approx(expected[source])
        assert mine[0].mix_source_size == sizes[source]
        # At most half of one document away.
        assert abs(sum(r.mix_taken for r in mine) - expected[source]) <= 20 + 1e-6
    assert all(r.mix_taken <= 3 * r.mix_size for r in out)
    again = pareto_mix.mix(make_docs(rows).repartition(7), buckets=3).collect()
    assert {(r.doc_id, r.mix_taken) for r in again} == {(r.doc_id, r.mix_taken) for r in out}


def test_unequal_weights_favour_heavy_documents(spark, make_docs):
    docs = make_docs([(i, "w " * 10, "en", "a") for i in range(400)] + [(1000, "w " * 4000, "en", "b")])
    docs = docs.selectExpr("*", "case when doc_id % 2 = 0 then 3.0 else 1.0 end as worth")
    out = pareto_mix.mix(docs, weights=(1, 3), weight_col="worth").where("source = 'a'").collect()
    heavy = sum(r.mix_copies for r in out if r.doc_id % 2 == 0)
    light = sum(r.mix_copies for r in out if r.doc_id % 2)
    assert 2.0 < heavy / max(light, 1) < 4.5


def test_odd_rows(make_docs, odd_rows):
    out = pareto_mix.mix(make_docs(odd_rows, clashing=True)).collect()
    assert len(out) == len(odd_rows)
    assert {r.mix_size for r in out if r.text is None} == {0}
    assert all(r.kept == "own" and r.target == "own" and r["__key"] == "own" for r in out)
    twins = [r.mix_copies for r in out if r.doc_id == 4]
    assert len(set(twins)) == 1
    assert pareto_mix.mix(make_docs([])).count() == 0
    assert {r.mix_copies for r in pareto_mix.mix(make_docs([(1, "", "en", "a"), (2, None, "en", "b")])).collect()} == {0}
    copies = pareto_mix.copies(pareto_mix.mix(make_docs(odd_rows)), ["doc_id", "text"])
    assert copies.count() == sum(r.mix_copies for r in out)


def test_copies_beyond_the_limit_are_reshared_by_weight(make_docs):
    docs = make_docs([(i, "w " * 10, "en", "a") for i in range(400)] + [(1000, "w " * 4000, "en", "b")])
    # Twenty documents would take nine copies each; what they leave goes to the others, thirty to one by weight.
    docs = docs.selectExpr("*", "case when doc_id % 20 = 0 then 1000.0 when doc_id % 20 < 4 then 30.0 else 1.0 end as worth")
    out = pareto_mix.mix(docs, weights=(1, 3), weight_col="worth").where("source = 'a'").collect()
    assert all(r.mix_copies == 3 for r in out if r.doc_id % 20 == 0)
    assert {r.mix_copies for r in out if 0 < r.doc_id % 20 < 4} <= {1, 2}
    assert 110 < sum(r.mix_copies for r in out if 0 < r.doc_id % 20 < 4) <= 120
    assert abs(sum(r.mix_taken for r in out) - out[0].mix_target) <= 5
