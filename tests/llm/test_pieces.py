"""SentencePiece models: parity with the library, exact decoding, a unigram model made here."""

import hashlib
import random
import struct
from types import SimpleNamespace

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from contactlake.llm import sentence_pieces as P

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "  a  b ", "Hello world\n\n\ttabs", "日本語 😀 \x00", "</s> <unk> <0x41>", "▁x a▁b", "word " * 20_000, "É ß ſ", "a" * 3000]


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def unigram_file(byte_fallback=True, collapse=False):
    """A hand-written unigram model in the format of the library."""
    pieces = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), ("</s>", 0.0, P.CONTROL)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", -20.0, P.BYTE) for b in range(256)]
    words = ["▁", "▁the", "▁th", "e", "t", "h", "a", "b", "c", "ab", "▁ab", "abc", "bc", "▁a", "▁c", "▁▁"]
    pieces += [(w, -1.0 - 0.37 * i, P.NORMAL) for i, w in enumerate(words)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    trainer = field(3, P.UNIGRAM) + field(4, len(pieces)) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1)
    return data + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, int(collapse)) + field(5, 1))


@pytest.mark.parametrize("collapse", [False, True])
def test_unigram_parity(collapse):
    data = unigram_file(collapse=collapse)
    model = P.Model.parse(data)
    assert (model.kind, model.byte_fallback, model.collapse_blanks) == (P.UNIGRAM, True, collapse)
    tok, reference = model.tokenizer(), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ["", "the abc", "  the  ab  abcabc", "thx é zz abcc the", "日 a"]:
        ids = tok.encode(model.marked([text])[0], add_special_tokens=False).ids
        assert ids == reference.encode(text), text
        assert tok.decode(ids, skip_special_tokens=False) == reference.decode(ids), text


def test_unsupported_models_raise():
    with pytest.raises(ValueError):
        P.Model([("<unk>", 0.0, P.UNKNOWN)], kind=3).tokenizer()
    with pytest.raises(ValueError):
        P.Model([("<unk>", 0.0, P.UNKNOWN)], suffix_marker=True).tokenizer()


def test_parity_and_decoding(make_docs, odd_rows):
    rows = odd_rows + [(20 + i, t, "en", "a") for i, t in enumerate(TEXTS)]
    encoded = P.encode(make_docs(rows, clashing=True), MODEL)
    assert encoded.columns[-5:] == ["input_ids", "n_tokens", "parity", "lossless", "decoded_sha256"] and encoded.columns.count("input_ids") == 1
    out = P.decode(encoded, MODEL).collect()
    reference = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(out) == len(rows) and all(r.parity for r in out)
    for r in out:
        assert r.input_ids == reference.encode(r.text or "") and r.n_tokens == len(r.input_ids)
        assert r.decoded == (r.text or "").replace("▁", " ")
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(r.input_ids).encode()).hexdigest()
        assert r.lossless == (r.decoded == (r.text or ""))
    assert P.encode(make_docs([]), MODEL).count() == 0
    nulls = P.decode(make_docs([(1, "x", "en", "a")]).withColumn("input_ids", F.lit(None).cast("array<int>")), MODEL)
    assert nulls.collect()[0].decoded == ""


@pytest.mark.parametrize("data", [P.read_model(MODEL), unigram_file(), unigram_file(collapse=True), unigram_file(byte_fallback=False)])
def test_texts_are_restored_as_by_pieces(data):
    model, tok, restore, reference = P._backends(data, 1)
    texts = [*TEXTS, "   ", "▁", " ▁ \u2580\u2582", "a\U0001f600▁ é", "\u00a0x"]
    ids = [e.ids for e in tok.encode_batch_fast(model.marked(texts), add_special_tokens=False)]
    # Whole texts are put together before their markers are turned back: no decoder step looks at single pieces for them.
    assert restore(ids) == tok.decode_batch(ids, skip_special_tokens=False)
    assert [r == t for r, t in zip(restore(ids), texts)] == [reference.decode(i) == t for i, t in zip(ids, texts)]
    if model.byte_fallback:
        # Ids from elsewhere may spell a marker in bytes; those go by pieces, as in the library.
        spelled = [next(i for i, (p, _, k) in enumerate(model.pieces) if k == P.BYTE and p == f"<0x{b:02X}>") for b in "▁".encode()]
        assert tok.decode(spelled, skip_special_tokens=False) == reference.decode(spelled) == "▁"


def merges_file(words, byte_fallback=True):
    """A hand-written model of merges in the format of the library; earlier words merge first."""
    pieces = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), ("</s>", 0.0, P.CONTROL)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, P.BYTE) for b in range(256)]
    pieces += [(w, -1.0 - i, P.NORMAL) for i, w in enumerate(words)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    trainer = field(3, P.BPE) + field(4, len(pieces)) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1)
    return data + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


# The second holds a piece that goes on across a marker, the last knows no bytes.
WORDS = ["▁a", "ab", "▁▁", "bé", "▁ab", "a▁", "a▁b", "▁", "a", "b", "é", "."]
CUT_MODELS = [(P.read_model(MODEL), True), (merges_file(WORDS), True), (merges_file(WORDS, byte_fallback=False), False)]


@pytest.mark.parametrize("data, cut", CUT_MODELS)
def test_cut_texts_have_the_ids_of_whole_texts(data, cut):
    model, tok, _, reference = P._backends(data, 1)
    assert (model.cuts is not None) == cut
    draw = random.Random(5)
    parts = ["a", "b", "ab", "é", " ", "  ", "\n", "▁", "日", "😀", "▂", "’", "—", "\x00", "\x01", ".", "the", "<0x41>", "</s>", "A"]
    assert P._ids(model, tok, []).to_pylist() == [] and P._ids(model, tok, ["", ""]).to_pylist() == [[], []]
    for size in (1, 3, 40, 3000):
        for _ in range(10):
            texts = ["".join(draw.choices(parts, k=draw.randint(0, size))) for _ in range(draw.choice([1, 5, 400 if size < 50 else 9]))]
            ids = P._ids(model, tok, texts).to_pylist()
            assert ids == [e.ids for e in tok.encode_batch_fast(model.marked(texts), add_special_tokens=False)]
            assert not model.byte_fallback or ids == reference.encode(texts)


def test_runs_of_a_batch_are_encoded_once():
    model, tok, _, reference = P._backends(P.read_model(MODEL), 1)
    seen = []

    class Counting:
        def encode_batch_fast(self, texts, **kwargs):
            seen.extend(texts)
            return tok.encode_batch_fast(texts, **kwargs)

    draw = random.Random(6)
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(draw.choices(words, k=400)) + ".\nEnd" for _ in range(200)]
    assert P._ids(model, Counting(), texts).to_pylist() == reference.encode(texts)
    assert sum(map(len, seen)) < sum(map(len, texts)) / 50


def test_chunks_are_bounded():
    assert list(P._chunks(["a" * 5, "b" * 6, "c", "d" * 30, ""], 10)) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    assert list(P._chunks([], 10)) == []


def test_workers_take_few_characters_at_a_time():
    data = P.read_model(MODEL)
    texts = [*["some words " * 9000] * 40, None, "", *["short text"] * 3000, "one long text " * 30000, *TEXTS]
    batch = pa.record_batch({"text": pa.array(texts, pa.string()), "n": pa.array(range(len(texts)))})
    out = list(P._encode(iter([batch, batch.slice(0, 0)]), SimpleNamespace(value=data), 1, True, "text"))
    sizes = [sum(len(t or "") for t in b.column("text").to_pylist()) for b in out]
    assert all(size <= 1 << 18 or b.num_rows == 1 for size, b in zip(sizes, out)) and max(b.num_rows for b in out) <= 1024
    rows = pa.Table.from_batches(out).to_pylist()
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert [(r["n"], r["text"]) for r in rows] == list(enumerate(texts))
    assert [r["__ids"] for r in rows] == reference.encode([t or "" for t in texts]) and all(r["__parity"] for r in rows)


def test_kept_texts_go_to_workers_once(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = P.encode(docs, MODEL)
    assert "__text" not in kept._jdf.queryExecution().toString()
    apart = P.encode(docs.withColumn("text", F.col("text").cast("binary")), MODEL, keep=["doc_id"])
    binary = P.encode(docs.withColumn("text", F.col("text").cast("binary")), MODEL)
    key = ["doc_id", "n_tokens", "decoded_sha256", "parity", "lossless"]
    want = sorted(map(str, kept.select(key).collect()))
    assert want == sorted(map(str, apart.select(key).collect())) == sorted(map(str, binary.select(key).collect()))
    assert [r.text for r in kept.orderBy("doc_id", "text").collect()] == [r.text for r in docs.orderBy("doc_id", "text").collect()]
