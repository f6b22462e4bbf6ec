"""Classifier: held-out accuracy, class prior, odd rows."""

import random
import zlib

import numpy as np
import pytest

from contactlake.llm import pu_quality as Q


def doc(rng, good):
    words = ["".join(rng.choice("aeioustr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 120))]
    return " ".join(words) + "." if good else " ".join(w.upper() + rng.choice(["!!", "###", " |"]) for w in words)


def test_prior():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert Q.estimate_prior(positive, mixed) == pytest.approx(0.7, abs=0.07)


def test_held_out_accuracy(spark, make_docs):
    rng = random.Random(4)
    truth = {i: rng.random() < 0.7 for i in range(1500)}
    docs = make_docs([(i, doc(rng, good), "en", "a") for i, good in truth.items()], clashing=True)
    # Bad labels are there but never read; held-out labels are wrong on purpose.
    rows = [(i, int(not good) if zlib.crc32(str(i).encode()) % 5 == 0 else int(good), 0) for i, good in truth.items() if i % 2]
    labels = spark.createDataFrame([*rows, (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.score_quality(docs, labels, Q.Params(steps=300)).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum((r.score >= 0.3) == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, 0), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.score_quality(make_docs(odd_rows, clashing=True), labels, Q.Params(steps=20)).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 for r in out)
    none = Q.score_quality(make_docs(odd_rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.score_quality(make_docs([]), labels).count() == 0
