"""Secret scan: keyword automaton, anchored patterns at its hits, checksum validation.

One Aho-Corasick pass finds every keyword of every kind; a kind's pattern is
then tried only where its keyword starts.  Hex runs have no keyword, so they are
found by one scan for long runs.  Tokens that embed a checksum are reported only
if it is right, web tokens only if their header decodes.

Scale: map-only, so nothing is shuffled and a key or source of any size does no harm.
Time is linear in a text: a match ends where the next may start, and where a kind's
pattern fails, the hits inside the run of characters that it went through are passed over, as
they would fail at the same place.  A header is decoded only if it nests a few levels; whatever
fails to decode is no token.

Nulls: a null text is empty; a null or repeated id passes through.  Offsets
count code points, the end is exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlake.llm.common import Guarded, whole_text

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    """CRC-32 of the body in six base-62 digits."""
    n, digits = zlib.crc32(body.encode()), []
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(BASE62[d])
    return "".join(reversed(digits))


def _crc_holds(m: re.Match) -> bool:
    return crc_base62(m[1][:-6]) == m[1][-6:]


_QUOTED = re.compile(rb'"(?:[^"\\]|\\.)*"', re.DOTALL)
MAX_NESTING = 32


def _nesting(data: bytes) -> int:
    """Levels of brackets outside strings."""
    deepest = level = 0
    for byte in _QUOTED.sub(b"", data):
        if byte in b"[{":
            level += 1
            deepest = max(deepest, level)
        elif byte in b"]}":
            level -= 1
    return deepest


def _header_decodes(m: re.Match) -> bool:
    part = m[1]
    try:
        data = base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
        head = json.loads(data) if _nesting(data) <= MAX_NESTING else None
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


@dataclass(frozen=True)
class Kind:
    """Lower-case keywords that start a match, the pattern tried there, and what a match must pass.

    ``run``: characters that every match starts with and cannot give back, so that a
    failed try fails for all later hits in the same run.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: str
    valid: Callable[[re.Match], bool]
    flags: int = re.ASCII
    run: str = ""


KINDS = (
    Kind(
        "assign", ("password", "passwd", "secret", "token", "api_key", "apikey"),
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: m.end(2) - m.start(2) >= 6, re.ASCII | re.IGNORECASE,
    ),
    Kind("access", ("akia",), r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    Kind("hex", (), r"[0-9a-f]{24,}", lambda m: True),
    Kind("forge", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc_holds),
    Kind("package", ("npm_",), r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc_holds),
    Kind("web_token", ("eyj",), r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _header_decodes, run="[A-Za-z0-9_-]+"),
    Kind("private_key", ("-----begin ",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: True),
)
BASE = ("assign", "access", "hex")


@lru_cache(maxsize=1)
def _machine():
    auto, patterns, runs = ahocorasick.Automaton(), [], []
    for i, kind in enumerate(KINDS):
        patterns.append(re.compile(kind.pattern, kind.flags))
        runs.append(re.compile(kind.run) if kind.run else None)
        for word in kind.keywords:
            auto.add_word(word, (i, len(word)))
    auto.make_automaton()
    return auto, patterns, runs


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every secret in the text, by start, then kind."""
    auto, patterns, runs = _machine()
    # Lowering bytes touches A-Z alone, so offsets stay those of the text.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[int, list[int]] = {}
    for end, (i, n) in auto.iter(lowered):
        hits.setdefault(i, []).append(end - n + 1)
    found = []
    for i, starts in hits.items():
        free, match, valid = 0, patterns[i].match, KINDS[i].valid
        for start in sorted(starts):
            if start < free:
                continue
            if m := match(text, start):
                free = m.end()
                if valid(m):
                    found.append((start, i, free))
            elif runs[i] and (run := runs[i].match(text, start)):
                free = run.end()
    for i, kind in enumerate(KINDS):
        if not kind.keywords:
            found += [(m.start(), i, m.end()) for m in patterns[i].finditer(text) if kind.valid(m)]
    return sorted(found)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [
            [{"kind": KINDS[i].name, "start": a, "stop": z} for a, i, z in find_spans(text)]
            for text in batch.column("__text").to_pylist()
        ]
        rest = [batch.column(n) for n in batch.schema.names if n != "__text"]
        names = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(spans, pa.list_(_SPAN))], [*names, "__spans"])


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, if None) of every row plus ``spans``: array of (kind, start, stop)."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    held = Guarded(docs)
    narrow = held.rows.select(*[held.col(c) for c in keep], whole_text(held.col(text_col)).alias("__text"))
    span = T.StructType().add("kind", "string").add("start", "long").add("stop", "long")
    schema = T.StructType([f for f in narrow.schema.fields if f.name != "__text"]).add("__spans", T.ArrayType(span))
    scanned = narrow.mapInArrow(_scan, schema)
    return scanned.select(*[held.col(c).alias(c) for c in keep if c != "spans"], F.col("__spans").alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:stop of every span, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
        ), ",",
    )
