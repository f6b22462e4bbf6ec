"""The pipeline's stages on odd rows, its effects, and what the registry offers."""

import re

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_registry():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert {"op1_revisits", "op9_line_runs", "op10_pareto_mix", "op11_hard_negatives", "op12_prefix_trie"} <= set(entry.oracle_sql())


def test_stages_take_odd_and_empty_tables(spark, make_docs, odd_rows):
    good = [(100 + i, " ".join(f"word{i}x{j}" for j in range(60)), "en", "a") for i in range(30)]
    for rows in (odd_rows + good, []):
        docs = make_docs(rows, clashing=True)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns, name
            assert all(r.kept == "own" for r in docs.select("kept").limit(5).collect()), name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.count() == docs.count() and "n_tokens" in last.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out and {r.doc_id for r in out} <= set(docs)
    assert all(r.parity and r.lossless and len(r.input_ids) == r.n_tokens for r in out)
    copies = {}
    for r in out:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.n_chars == len(r.text) and r.source == docs[r.doc_id].source
    assert max(copies.values()) <= 3
