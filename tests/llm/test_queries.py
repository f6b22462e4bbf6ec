"""Registered queries without an SQL twin, and the pipeline, against brute force on the smallest tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline
import pytest
import sentencepiece
import test_levels
import test_lines
import test_mix
import test_pieces
import test_rules
import test_secrets
import test_simhash
import test_syncmers

from contactlake.llm import pareto_mix
from contactlake.llm import robust_rules as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return [tuple(r) for r in rows]


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def brute_kept(docs, params):
    """Verdict per row, in order."""
    cut = R.chi_square_quantile(params.tail, len(R.FEATURES))
    return [d2 is not None and bool(d2 <= cut) for d2 in test_levels.brute_distances(docs, params)]


def test_op7_verdicts(spark, docs):
    got = {r.doc_id: (test_rules.stats(r), r.kept) for r in run(spark, "op7_robust_rules")}
    kept = brute_kept(docs, R.Params())
    assert got == {d[0]: (test_rules.brute(d[1]), k) for d, k in zip(docs, kept, strict=True)}
    assert 0 < sum(kept) < len(docs)


def test_op2(spark, docs):
    reference = sentencepiece.SentencePieceProcessor(model_file=test_pieces.MODEL)
    for r, text in ((r, dict((d[0], d[1]) for d in docs)[r.doc_id]) for r in run(spark, "op2_sentence_pieces")):
        ids = reference.encode(text)
        assert r.parity and r.lossless and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_op3(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op3_syncmers")}
    ordered = sorted(docs, reverse=True)
    show = lambda s: "".join(f"{x & 0xFFFFFFFF:08x}" for x in s)
    for i, (key, text, *_) in enumerate(ordered):
        nxt, half = ordered[(i + 1) % len(ordered)][1], len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        mine, other, after = (test_syncmers.brute_sketch(t) for t in (text, edited, nxt))
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (show(mine), show(other))
        assert r.near_edited == pytest.approx(test_syncmers.brute_likeness(mine, other))
        assert r.near_next == pytest.approx(test_syncmers.brute_likeness(mine, after))


def test_op4(spark, docs):
    prints = [test_simhash.brute_print(d[1]) for d in docs]
    roots = test_simhash.brute_classes(prints, 4)
    first = {}
    for d, c in zip(docs, roots, strict=True):
        first[c] = min(first.get(c, d[0]), d[0])
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op4_simhash_vp")}
    assert got == {(d[0], f"{p:016x}", first[c]) for d, p, c in zip(docs, prints, roots, strict=True)}


def test_op5(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = entry.queries()["op5_pu_quality"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in out if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.93


def test_op6(spark):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-7] = [(t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    expected = set()
    for conv, turns in convs.items():
        body = "".join(f"{role}\n{text}\n" for _, role, text in sorted(turns))
        learnt = "".join(text for _, role, text in sorted(turns) if role == "assistant")
        expected.add((conv, len(turns), hashlib.sha256(body.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()))
    got = run(spark, "op6_chat_events")
    assert {tuple(r)[:5] for r in got} == expected
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_op8(spark, docs):
    names = ("assign", "access", "hex", "forge", "package", "web_token", "private_key")
    show = lambda spans: ",".join(f"{names[k]}:{a}:{z}" for a, k, z in spans)
    expected = {}
    for key, text, *_ in docs:
        spans = test_secrets.brute(text)
        expected[key] = (
            *[sum(k == i for _, k, _ in spans) for i in range(3)], hashlib.sha256(show(spans).encode()).hexdigest(),
            show(test_secrets.brute_all(text)),
        )
    got = run(spark, "op8_secret_scan")
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got} == expected


def brute_copies(docs):
    """Copies per row: certain ones, then Pareto order until the source's words are met."""
    size = [len(test_mix.WORD.findall(d[1] or "")) for d in docs]
    sources = defaultdict(list)
    for i, d in enumerate(docs):
        sources[d[3]].append(i)
    totals = {s: sum(size[i] for i in rows) for s, rows in sources.items()}
    targets, copies = test_mix.brute_targets(totals), [0] * len(docs)
    for s, rows in sources.items():
        each = min(targets[s] / totals[s], 3) if totals[s] else 0
        whole, part = int(each), each - int(each)
        need = targets[s] - whole * totals[s]

        def rank(i, part=part):
            u = (int(hashlib.md5(f"{pareto_mix.SEED}:{docs[i][0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return u * (1 - part) / ((1 - u) * part)

        for i in rows:
            copies[i] = whole
        for i in sorted(rows, key=lambda i: (rank(i), str(docs[i][0]))) if part else []:
            if need > 0 and size[i] <= 2 * need:
                copies[i] += 1
            need -= size[i]
    return copies


def test_pipeline(spark, docs):
    left = [d for d, k in zip(docs, brute_kept(docs, R.Params()), strict=True) if k]
    keys = [[test_lines.LOWER and x.strip(test_lines.BLANK).translate(test_lines.LOWER) for x in d[1].split("\n")] for d in left]
    counts = Counter(k for ks in keys for k in set(ks) if k)
    left = [
        (d[0], "\n".join(x for x, k in zip(d[1].split("\n"), ks, strict=True) if counts[k] < 10), *d[2:])
        for d, ks in zip(left, keys, strict=True)
    ]
    roots = test_simhash.brute_classes([test_simhash.brute_print(d[1]) for d in left], 4)
    first = {}
    for d, c in zip(left, roots, strict=True):
        first[c] = min(first.get(c, d), d, key=lambda x: x[0])
    left = list(first.values())
    reference = sentencepiece.SentencePieceProcessor(model_file=test_pieces.MODEL)
    expected = Counter()
    for d, n in zip(left, brute_copies(left), strict=True):
        if n:
            expected[d[0], d[1], d[2], d[3], tuple(reference.encode(d[1]))] = n
    got = Counter((r.doc_id, r.text, r.lang, r.source, tuple(r.input_ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == expected
