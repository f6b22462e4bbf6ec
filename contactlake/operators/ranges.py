"""Longest-prefix match of addresses against a table of ranges, IPv4 and IPv6 alike.

An address is written as its family and its bits, ``4:0000101...``; a range is the bits
that all its addresses start with.  An address lies in a range if it starts with the range's
text, so the join is one by equality, for each prefix length that the table holds.  Every
distinct address is matched once; the prefix lengths (162 at most) are the only thing collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import ip as IP
from contactlake.functions.text import let
from contactlake.operators.joins import lookup


def _groups(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ":"))


_TAIL = r"^(.*:)([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def _without_dots(host: Column) -> Column:
    """A dotted tail as two groups; what is no octet leaves a group that cannot be read."""

    def pair(octets: Column) -> Column:
        n = [F.element_at(octets, i + 1).cast("int") for i in range(4)]
        hexed = F.concat_ws(":", *[F.lower(F.hex(n[i] * 256 + n[i + 1])) for i in (0, 2)])
        return F.concat(F.regexp_extract(host, _TAIL, 1), F.when(F.exists(octets, lambda o: o.cast("int") > 255), "-").otherwise(hexed))

    octets = F.array(*[F.regexp_extract(host, _TAIL, i) for i in (2, 3, 4, 5)])
    return F.when(host.rlike(_TAIL), let(octets, pair)).otherwise(host)


def _ipv6_hex(host: Column) -> Column:
    """32 hex digits of an IPv6 address, null if it is none."""
    halves = F.split(_without_dots(host), "::")

    def fill(h: Column) -> Column:
        left, right = _groups(F.get(h, F.lit(0))), _groups(F.coalesce(F.get(h, F.lit(1)), F.lit("")))

        def joined(g: Column) -> Column:
            room = 8 - F.size(g["l"]) - F.size(g["r"])
            zeros = F.array_repeat(F.lit("0"), F.greatest(room, F.lit(0)))
            groups = F.when((F.size(h) == 2) & (room > 0), F.concat(g["l"], zeros, g["r"])).when((F.size(h) == 1) & (room == 0), g["l"])
            return F.when(
                ~F.exists(groups, lambda x: ~x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(groups, lambda x: F.lpad(x, 4, "0")), "")
            )

        return let(F.struct(left.alias("l"), right.alias("r")), joined)

    return F.when(host.contains(":"), let(halves, fill))


def _bits(hex_digits: Column) -> Column:
    return F.lpad(F.conv(hex_digits, 16, 2), 64, "0")


def address_bits(host: Column) -> Column:
    """Family and bits of an address in any spelling; null for names.  Mapped IPv4 counts as IPv4."""

    def read(h: Column) -> Column:
        six = let(_ipv6_hex(h), lambda x: F.concat(F.lit("6:"), _bits(F.substring(x, 1, 16)), _bits(F.substring(x, 17, 16))))
        mapped = F.lit("6:" + "0" * 80 + "1" * 16)
        six = let(six, lambda s: F.when(s.startswith(mapped), F.concat(F.lit("4:"), F.substring(s, 99, 32))).otherwise(s))
        four = F.lpad(F.conv(IP.ipv4_number(h).cast("string"), 10, 2), 32, "0")
        return F.coalesce(F.concat(F.lit("4:"), four), six)

    return let(F.regexp_replace(IP.bare_host(host), "%.*$", ""), read)


def _may_be_address(text: Column) -> Column:
    """Necessary condition for ``address_bits``, which spares names the reading."""
    return text.contains(":") | text.rlike(r"(?i)^ *\[?[0-9a-fx.]+(?:$|[\]% ])")


def range_prefix(cidr: Column) -> Column:
    """The text that the addresses of a range start with; null if the range cannot be read.

    A range without a length is one address.  Bits beyond the length are ignored.
    """

    def cut(c: Column) -> Column:
        bits = address_bits(F.get(c, F.lit(0)))
        given = F.get(c, F.lit(1))

        def taken(b: Column) -> Column:
            size = F.length(b) - 2
            # A mapped range is 96 bits longer than the IPv4 range it stands for.
            shift = F.when(b.startswith("4:") & F.get(c, F.lit(0)).contains(":"), 96).otherwise(0)
            length = F.when(given.isNull(), size).when(given.rlike("^[0-9]{1,3}$"), given.cast("int") - shift)
            return F.when(length.between(0, size), F.substring(b, F.lit(1), length + 2))

        return let(bits, taken)

    return let(F.split(F.trim(cidr), "/"), cut)


def longest_match(rows: DataFrame, ranges: DataFrame, ip: str = "ip", cidr: str = "cidr", add: list[str] | None = None) -> DataFrame:
    """Rows with the columns ``add`` (the range itself, if None) of the longest range that holds their address, else null.

    Of equal ranges the one with the smallest text of all its columns wins.  Null and unreadable
    addresses and ranges match nothing.
    """
    add = [cidr] if add is None else add
    # Repeated ranges and addresses are read once; the outer explode keeps filters on what was read from reading it again.
    held = ranges.select(F.col(cidr).alias("__range"), F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(add)]).alias("__add")).distinct()
    held = held.select(F.explode_outer(F.array(range_prefix(F.col("__range")))).alias("__prefix"), "__add")
    held = held.where("__prefix is not null").groupBy("__prefix").agg(F.min_by("__add", F.to_json("__add")).alias("__add"))
    lengths = {4: [], 6: []}
    for family, length in held.select(F.substring("__prefix", 1, 1), F.length("__prefix")).distinct().collect():
        lengths[int(family)].append(length)
    kind = F.substring("__bits", 1, 1)

    def cuts(family: int) -> Column:
        return F.array(*[F.substring("__bits", 1, n) for n in sorted(lengths[family])]).cast("array<string>")

    found = (
        rows.select(F.col(ip).alias("__text")).where(_may_be_address(F.col("__text"))).distinct()
        .select("__text", F.explode_outer(F.array(address_bits(F.col("__text")))).alias("__bits"))
        .select("__text", F.explode_outer(F.when(kind == "4", cuts(4)).when(kind == "6", cuts(6))).alias("__prefix"))
        .join(held, "__prefix")
        .groupBy("__text").agg(F.max_by("__add", F.length("__prefix")).alias("__add"))
    )
    out = lookup(rows.withColumn("__text", F.col(ip)), found, "__text")
    return out.select(*rows.columns, *[F.col(f"__add.v{i}").alias(c) for i, c in enumerate(add)])
