"""URL and host expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake import constants as K

# scheme, authority, path, query, fragment (RFC 3986 split)
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def piece(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(piece(url, 1))


def authority(url: Column) -> Column:
    return F.lower(piece(url, 2))


def host(url: Column) -> Column:
    """Lower-case host without credentials and port; IPv6 keeps its brackets."""
    return host_in(authority(url))


def host_in(auth: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(auth, "^.*@", ""), r":\d*$", "")


def path(url: Column) -> Column:
    p = piece(url, 3)
    return F.when(F.length(p) == 0, "/").otherwise(p)


def path_and_query(url: Column) -> Column:
    q = piece(url, 4)
    return F.concat(path(url), F.when(F.length(q) > 0, F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def is_wellformed(url: Column) -> Column:
    """Absolute URL with a scheme, and a host where http(s) is the scheme."""
    web = scheme(url).isin("http", "https")
    return (F.length(scheme(url)) > 0) & (~web | (F.length(host(url)) > 0) & ~host(url).rlike(r"[\s<>^|%]"))


def remove_dot_segments(p: Column) -> Column:
    """Resolve '.' and '..' of an absolute path with a stack held in an array."""
    segments = F.filter(F.split(p, "/"), lambda s, i: i > 0)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    closing = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    out = F.concat(F.lit("/"), F.array_join(kept, "/"), closing)
    return F.when(p.rlike(r"/\.{1,2}(?:/|$)"), out).otherwise(p)


_UNSAFE = r"""[\x00-\x20"<>`{}\x7F]|[^\x00-\x7F]+"""


def encode_path(p: Column) -> Column:
    """Percent-encode blanks, quotes, controls and non-ASCII characters."""
    runs = F.array_distinct(F.regexp_extract_all(p, F.lit(_UNSAFE), F.lit(0)))
    longest_first = F.array_sort(runs, lambda a, b: F.length(b) - F.length(a))

    def percent(run: Column) -> Column:
        return F.regexp_replace(F.hex(F.encode(run, "UTF-8")), "(..)", "%$1")

    coded = F.aggregate(longest_first, p, lambda acc, run: F.replace(acc, run, percent(run)))
    return F.when(p.rlike(_UNSAFE), coded).otherwise(p)


def _form(c: Column) -> Column:
    return F.url_encode(F.coalesce(F.try_url_decode(c), c))


def clean_query(q: Column) -> Column:
    """Query without tracking parameters, pairs in form encoding."""
    name = lambda kv: F.regexp_extract(kv, "^[^=]*", 0)
    value = lambda kv: F.regexp_extract(kv, "(?s)^[^=]*=(.*)$", 1)
    pairs = F.filter(
        F.split(q, "&"),
        lambda kv: (F.length(kv) > 0) & ~F.coalesce(F.try_url_decode(name(kv)), name(kv)).isin(*K.TRACKING_PARAMS),
    )
    return F.array_join(F.transform(pairs, lambda kv: F.concat(_form(name(kv)), F.lit("="), _form(value(kv)))), "&")


def is_priority(url: Column) -> Column:
    """Does the path name a contact, about or team page?"""
    words = "|".join(K.PRIORITY_WORDS)
    return F.lower(path(url)).rlike(f"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])")
