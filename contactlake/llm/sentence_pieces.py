"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protocol buffer; the few fields that matter are read here:
pieces with scores and kinds, the model kind, and the normaliser.  From them a
tokenizers pipeline is rebuilt: normaliser, metaspace marker, unigram scores or
merges ranked by score, byte fallback.  Batches are encoded by the library's
own threads.  Where pieces are merged, texts are cut between characters that stand
together in no piece and each different run of a batch is encoded once; no merge goes
across such a cut, so these are the ids of the whole texts.  Every whole text's ids are
compared with those of the SentencePiece library and decoded by the rebuilt decoder; a
text that this does not restore exactly is also compared with the library's decoding.

Scale: map-only; the model file (bounded by its vocabulary) is read on the driver
and broadcast, so executors need no path.  A worker takes few rows of a batch at a
time, and of these few characters, so its memory does not depend on the number of
rows; one long text is taken alone.  A text that is kept goes to the worker once.

Nulls: a null text is empty and gives no ids; null and repeated ids pass
through.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache, partial
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlake.llm.common import Guarded, whole_text

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
THREADS = 2
# So many rows are taken at a time; of these, runs of so many characters are told apart at a time, and so many
# characters go through a tokenizer or decoder and are handed on.
SLICE_ROWS = 1024
BATCH_CHARS = 1 << 21
PART_CHARS = 1 << 18
# Keeps runs apart: the library takes no piece that holds this byte beside others.
APART = 0
# So many runs are encoded as one text.
GROUP = 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; fixed values stay bytes."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} in a model file")
        yield tag >> 3, value


@dataclass
class Cuts:
    """Where texts may be cut, by their UTF-8 bytes with blanks for markers."""

    # Whether these bytes, one after the other, are in some piece or inside a character.
    joins: np.ndarray
    # Bytes that each id stands for.
    sizes: np.ndarray


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_blanks: bool = True
    escape_blanks: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls([])
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        model.kind = v
                    elif n == 24:
                        model.suffix_marker = bool(v)
                    elif n == 35:
                        model.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        model.charsmap = v
                    elif n == 3:
                        model.dummy_prefix = bool(v)
                    elif n == 4:
                        model.collapse_blanks = bool(v)
                    elif n == 5:
                        model.escape_blanks = bool(v)
        return model

    @property
    def unknown(self) -> int:
        return next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)

    @property
    def plain(self) -> bool:
        """Whether the normaliser does nothing but put in markers."""
        return not self.charsmap and not self.collapse_blanks

    def marked(self, texts: list[str]) -> list[str]:
        """Texts as the rebuilt tokenizer wants them."""
        if not self.plain:
            return texts
        prefix = MARK if self.dummy_prefix else ""
        return [prefix + t.replace(" ", MARK) if t else t for t in texts]

    def unmarked(self, fused: list[str]) -> list[str]:
        """Texts whose pieces were put together with their markers, as decoding gives them."""
        texts = [t.replace(MARK, " ") for t in fused]
        return [t.removeprefix(" ") for t in texts] if self.dummy_prefix else texts

    @cached_property
    def cuts(self) -> Cuts | None:
        """Where texts may be cut, if pieces are merged and each character is a piece or bytes: unknown ones are fused."""
        whole = self.byte_fallback and sum(kind == BYTE for *_, kind in self.pieces) == 256
        if not (self.plain and self.kind == BPE and whole):
            return None
        joins = np.zeros((256, 256), bool)
        texts = [b"-" if kind == BYTE else piece.replace(MARK, " ").encode() for piece, _, kind in self.pieces]
        for text in texts:
            joins[list(text[:-1]), list(text[1:])] = True
        joins[:, 0x80:0xC0] = True
        return Cuts(joins, np.array([len(t) for t in texts]))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, best score first; equal scores in order of ids."""
        usable = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        ranked = []
        for piece, i in usable.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in usable and right in usable:
                    ranked.append((-self.pieces[i][1], i, usable[left], usable[right], left, right))
        return [(left, right) for *_, left, right in sorted(ranked)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.suffix_marker or not self.escape_blanks:
            raise ValueError("models with suffix markers or without markers are not supported")
        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == BPE:
            core = models.BPE(
                {p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), fuse_unk=True,
                unk_token=self.pieces[self.unknown][0], byte_fallback=self.byte_fallback,
            )
        else:
            raise ValueError(f"model kind {self.kind} is not supported")
        tok = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.collapse_blanks:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        # Without steps before them, markers are put in by ``marked``: the library's way tracks every offset.
        if not self.plain:
            tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        if self.dummy_prefix:
            parts.append(decoders.Strip(" ", 1, 0))
        tok.decoder = decoders.Sequence(parts)
        return tok


def _restorer(model: Model, tok):
    """ids of texts -> the texts, by the rebuilt decoder, for ids that its own encoder gave.

    The decoder works piece by piece; markers are turned back at once in whole texts, as the encoder never
    spells a marker in bytes where it is a piece itself.  Ids from elsewhere may: ``decode`` goes by pieces.
    """
    from tokenizers import Tokenizer, decoders

    if not any(piece == MARK and kind == NORMAL for piece, _, kind in model.pieces):
        return lambda ids: tok.decode_batch(ids, skip_special_tokens=False)
    fused = Tokenizer(tok.model)
    fused.decoder = decoders.ByteFallback()
    return lambda ids: model.unmarked(fused.decode_batch(ids, skip_special_tokens=False))


@lru_cache(maxsize=2)
def _backends(data: bytes, threads: int):
    """The model, the rebuilt tokenizer, what restores its texts and the library it is compared with, once per worker."""
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    import sentencepiece

    model = Model.parse(data)
    tok = model.tokenizer()
    return model, tok, _restorer(model, tok), sentencepiece.SentencePieceProcessor(model_proto=data)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, ``SLICE_ROWS`` at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _chunks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` characters, or one text."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def _offsets(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _whole_ids(tok, texts: list[str]) -> pa.ListArray:
    """Ids per text, as the tokenizer wants them.  What it returns is large, so it gets a part at a time."""
    sizes, values = [], [np.empty(0, np.int32)]
    for start, stop in _chunks(texts, PART_CHARS):
        ids = [e.ids for e in tok.encode_batch_fast(texts[start:stop], add_special_tokens=False)]
        sizes += map(len, ids)
        values.append(np.fromiter(chain.from_iterable(ids), np.int32))
    return pa.ListArray.from_arrays(pa.array(_offsets(sizes)), pa.array(np.concatenate(values)))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts that are no slice."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
    return offsets, np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[-1]))


def _run_ids(cuts: Cuts, tok, runs: pa.Array) -> pa.ListArray:
    """Ids per run.  Many are encoded as one text, with a byte between those that would merge; sizes tell them apart."""
    offsets, data = _bytes(runs)
    merging = np.flatnonzero(cuts.joins[data[offsets[1:-1] - 1], data[offsets[1:-1]]]) + 1
    starts = offsets[:-1] + np.bincount(merging, minlength=len(runs)).cumsum()
    spaced = np.insert(data, offsets[merging], APART).tobytes()
    groups = [*starts[::GROUP].tolist(), len(spaced)]
    texts = [spaced[a:b].decode().replace(" ", MARK) for a, b in zip(groups, groups[1:], strict=False)]
    ids = _whole_ids(tok, texts).values.to_numpy()
    ids = np.delete(ids, np.searchsorted(np.cumsum(cuts.sizes[ids]), starts[merging] - 1, side="right"))
    at = np.searchsorted(_offsets(cuts.sizes[ids]), offsets).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(ids))


def _ids(model: Model, tok, texts: list[str]) -> pa.ListArray:
    """Ids per text."""
    cuts = model.cuts
    if cuts is None or not any(texts):
        return _whole_ids(tok, model.marked(texts))
    prefix = " " if model.dummy_prefix else ""
    held = pa.array([prefix + t.replace(MARK, " ") if t else t for t in texts], pa.string())
    offsets, data = _bytes(held)
    cut = ~cuts.joins.ravel()[data[:-1].astype(np.uint16) << 8 | data[1:]]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    cut[inner - 1] = True
    at = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(data)]]).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), held.buffers()[2]]).dictionary_encode()
    ids = _run_ids(cuts, tok, runs.dictionary).take(runs.indices)
    return pa.ListArray.from_arrays(ids.offsets.take(pa.array(np.searchsorted(at, offsets))), ids.values)


def _encode(batches: Iterator[pa.RecordBatch], model, threads: int, verify: bool, text: str) -> Iterator[pa.RecordBatch]:
    model, tok, restore, reference = _backends(model.value, threads)
    # Lists of ids share these numbers.
    numbers = np.arange(len(model.pieces)).astype(object)
    for rows in _slices(batches):
        texts = [t or "" for t in rows.column(text).to_pylist()]
        keep = [n for n in rows.schema.names if n != "__text"]
        for start, stop in _chunks(texts, BATCH_CHARS):
            encoded = _ids(model, tok, texts[start:stop])
            values, offsets = encoded.values.to_numpy(), encoded.offsets.to_numpy()
            for a, b in _chunks(texts[start:stop], PART_CHARS):
                columns = [*[rows.column(n).slice(start + a, b - a) for n in keep], encoded.slice(a, b - a)]
                names = [*keep, "__ids"]
                if verify:
                    part = texts[start + a : start + b]
                    ids = [values[x:y] for x, y in pairwise(offsets[a : b + 1])]
                    expected = reference.encode(part, num_threads=threads, return_type="numpy")
                    decoded = restore([numbers[i].tolist() for i in ids])
                    exact = [d == t for d, t in zip(decoded, part, strict=True)]
                    same = [
                        np.array_equal(x, y) and (e or d == reference.decode(y.tolist()))
                        for x, y, e, d in zip(ids, expected, exact, decoded, strict=True)
                    ]
                    digests = [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]
                    columns += [pa.array(same, pa.bool_()), pa.array(exact, pa.bool_()), pa.array(digests, pa.string())]
                    names += ["__parity", "__lossless", "__decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, verify: bool = True,
    threads: int = THREADS,
) -> DataFrame:
    """The columns ``keep`` (all, if None) plus input_ids and n_tokens, and with ``verify`` what decoding the ids gave.

    Then every text's ids go through the rebuilt decoder: ``parity`` (ids are the SentencePiece library's, and so is the
    decoded text), ``lossless`` (it is the text) and ``decoded_sha256`` (its digest, lowercase hex).
    """
    held = Guarded(docs)
    keep = list(docs.columns) if keep is None else keep
    rows = held.rows.select(*[held.col(c) for c in dict.fromkeys(keep)])
    text = held.name(text_col)
    if text_col not in keep or held.rows.schema[text].dataType != T.StringType():
        text = "__text"
        rows = held.rows.select(*rows.columns, whole_text(held.col(text_col)).alias(text))
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    checks = [("__parity", T.BooleanType()), ("__lossless", T.BooleanType()), ("__decoded_sha256", T.StringType())]
    checks = checks if verify else []
    schema = T.StructType(
        [f for f in rows.schema.fields if f.name != "__text"]
        + [T.StructField("__ids", T.ArrayType(T.IntegerType()))] + [T.StructField(*check) for check in checks]
    )
    out = rows.mapInArrow(partial(_encode, model=model, threads=threads, verify=verify, text=text), schema)
    added = {"input_ids": F.col("__ids"), "n_tokens": F.size("__ids").cast("long")}
    added |= {name.removeprefix("__"): F.col(name) for name, _ in checks}
    return out.select(*[held.col(c).alias(c) for c in dict.fromkeys(keep) if c not in added], *[c.alias(n) for n, c in added.items()])


def _decode(batches: Iterator[pa.RecordBatch], model, threads: int) -> Iterator[pa.RecordBatch]:
    _, tok, _, _ = _backends(model.value, threads)
    for batch in batches:
        ids = [i or [] for i in batch.column("__ids").to_pylist()]
        keep = [n for n in batch.schema.names if n != "__ids"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in keep], pa.array(tok.decode_batch(ids, skip_special_tokens=False), pa.string())],
            [*keep, "__decoded"],
        )


def decode(encoded: DataFrame, model_path: str, ids_col: str = "input_ids", threads: int = THREADS) -> DataFrame:
    """All columns plus ``decoded``; null ids decode to an empty text."""
    held = Guarded(encoded)
    rows = held.rows.select("*", held.col(ids_col).alias("__ids"))
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))
    schema = T.StructType([*held.rows.schema.fields, T.StructField("__decoded", T.StringType())])
    return held.restore(rows.mapInArrow(partial(_decode, model=model, threads=threads), schema), {"decoded": F.col("__decoded")})
