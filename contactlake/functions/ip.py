"""IPv4 / IPv6 expressions: alternative spellings to a number, restricted ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake import constants as K
from contactlake.functions.text import let

_MAX = 0xFFFFFFFF


def _radix(digits: Column, base: int) -> Column:
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    # Eleven digits of any base exceed 32 bits only; longer ones are out of range anyway.
    return F.when(F.length(plain) <= 11, F.conv(plain, base, 10).cast("bigint")).otherwise(F.lit(_MAX + 1))


def _part_value(p: Column) -> Column:
    """One dotted part in decimal, 0x hex or 0-prefixed octal; null if unreadable."""
    hex_digits = F.regexp_extract(p, "^0x([0-9a-f]+)", 1)
    octal = F.regexp_extract(p, "^[0-7]+", 0)
    return (
        F.when(p.startswith("0x"), F.when(F.length(hex_digits) > 0, _radix(hex_digits, 16)))
        .when(p.startswith("0") & (F.length(p) > 1), F.when(~p.rlike("[89]"), _radix(octal, 8)))
        .when(p.rlike("^[0-9]+$"), _radix(p, 10))
    )


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r"^\[|\]$", "")


def mapped_ipv4(host: Column) -> Column:
    """Dotted or numeric IPv4 inside ::ffff:..., else null."""

    def read(rest: Column) -> Column:
        hi, lo = F.regexp_extract(rest, "^([0-9a-f]{1,4}):", 1), F.regexp_extract(rest, ":([0-9a-f]{1,4})$", 1)
        pair = (_radix(hi, 16) * 65536 + _radix(lo, 16)).cast("string")
        return (
            F.when(rest.contains("."), rest)
            .when(rest.rlike("^[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), pair)
            .when(rest.rlike("^[0-9a-f]{1,8}$"), _radix(rest, 16).cast("string"))
        )

    return F.when(host.startswith("::ffff:"), let(F.substring(host, F.lit(8), F.length(host)), read))


def ipv4_number(host: Column) -> Column:
    """Host in any IPv4 spelling as a number; null for names and out-of-range values."""

    def combine(values: Column) -> Column:
        n = F.size(values)
        last = F.element_at(values, -1)
        # All parts but the last are octets; the last one fills the remaining bytes.
        octets = F.slice(values, 1, n - 1)
        room = F.element_at(F.array(*[F.lit(2**bits - 1) for bits in (32, 24, 16, 8)]), n)
        head = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
        scale = F.element_at(F.array(*[F.lit(2**bits) for bits in (32, 24, 16, 8)]), n)
        fits = (last <= room) & ~F.exists(octets, lambda o: o > 0xFF)
        return F.when(n <= 4, F.when(~F.exists(values, lambda x: x.isNull()) & fits, head * scale + last))

    def parse(h: Column) -> Column:
        return F.when(
            h.rlike("^[0-9a-fx.]+$"), let(F.transform(F.split(h, r"\."), _part_value), combine)
        )

    return let(F.coalesce(mapped_ipv4(host), host), parse)


def dotted(number: Column) -> Column:
    octets = [F.floor(number / d).cast("bigint") % 256 for d in (16777216, 65536, 256, 1)]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def looks_numeric(host: Column) -> Column:
    """Digits-and-dots hosts that must be valid IPv4 or are malformed."""
    return host.rlike(r"^(?:\d+\.){1,3}\d+$") | host.rlike(r"^\d+$")


def in_ranges(number: Column, cidrs=K.RESTRICTED_CIDRS) -> Column:
    """Is the address inside one of a fixed, short list of ranges?"""
    hit = F.lit(False)
    for start, bits in cidrs:
        a, b, c, d = (int(x) for x in start.split("."))
        low = a * 16777216 + b * 65536 + c * 256 + d
        hit = hit | number.between(low, low + 2 ** (32 - bits) - 1)
    return hit


# fixed values: IPv6 loopback, link-local, unique-local, multicast, documentation, discard, 6to4
_IPV6 = (
    r"^(?:::1?|0:0:0:0:0:0:0:[01])$|^fe[89ab][0-9a-f]{0,2}:|^f[cd]|^ff|^2001:db8:|^100::|^2002:"
)


def restricted_ipv6(host: Column, compat: bool = False) -> Column:
    """``compat`` applies the address prefixes to plain host names as well."""
    hit = host.rlike(_IPV6)
    return hit if compat else hit & host.contains(":")


def is_restricted(ip: Column, compat: bool = False) -> Column:
    """Private, loopback, reserved, metadata or malformed addresses; not host names."""

    def judge(h: Column) -> Column:
        return F.coalesce(
            F.when(F.length(h) == 0, F.lit(True)),
            let(ipv4_number(h), lambda n: in_ranges(n)),
            F.when(looks_numeric(h), F.lit(True)),
            restricted_ipv6(h, compat),
        )

    return F.coalesce(let(bare_host(ip), judge), F.lit(True))
