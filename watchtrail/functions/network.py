"""IP address predicates as plain expressions, so no Python runs per row."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchtrail.functions.constants import INTERNAL_PREFIXES
from watchtrail.functions.values import any_of

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_PATTERN = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6_pattern() -> str:
    """Every legal layout of eight 16-bit groups, built from the one rule.

    ``::`` stands for at least one missing group, and the last two groups may be
    written as a dotted quad.
    """
    quad = IPV4_PATTERN
    group = r"[0-9a-fA-F]{1,4}"
    layouts = [rf"(?:{group}:){{7}}{group}", rf"(?:{group}:){{6}}{quad}"]
    for before in range(8):
        head = "" if before == 0 else rf"{group}(?::{group}){{{before - 1}}}"
        room = 7 - before
        tails = [""]
        if room:
            tails.append(rf"{group}(?::{group}){{0,{room - 1}}}")
        if room >= 2:
            tails.append(rf"(?:{group}:){{0,{room - 2}}}{quad}")
        layouts.append(rf"{head}::(?:{'|'.join(tails)})")
    return rf"(?:{'|'.join(layouts)})(?:%[^%]+)?"


IP_PATTERN = rf"^(?:{IPV4_PATTERN}|{_ipv6_pattern()})\z"


def is_ip_address(value: Column) -> Column:
    """True for a well-formed IPv4 or IPv6 address."""
    return value.rlike(IP_PATTERN)


def is_internal_ip(value: Column, prefixes: tuple[str, ...] = INTERNAL_PREFIXES) -> Column:
    return any_of([value.startswith(prefix) for prefix in prefixes])


#: Flipping the top bit makes signed 64-bit order equal unsigned order.
_TOP = -(1 << 63)


def address_number(value: Column) -> Column:
    """struct(family, high, low) of an IPv4 or IPv6 address; null when ``value`` is not one.

    IPv4 is held in ``low`` (family 4); IPv6 in both halves (family 6), with ``::``, a zone
    and a trailing dotted quad understood. Each half has its top bit flipped, so comparing
    (high, low) as signed numbers orders addresses as unsigned 128-bit numbers.
    """
    text = F.lower(F.regexp_replace(value, "%.*$", ""))
    octets = F.transform(F.split(text, r"\."), lambda o: o.cast("long"))
    v4 = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    quad = F.regexp_extract(text, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    quad_octets = F.transform(F.split(quad, r"\."), lambda o: o.cast("long"))
    as_groups = F.concat(
        F.lower(F.hex(quad_octets[0] * 256 + quad_octets[1])), F.lit(":"), F.lower(F.hex(quad_octets[2] * 256 + quad_octets[3]))
    )
    v6_text = F.when(quad != "", F.concat(F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", ""), as_groups)).otherwise(text)
    halves = F.split(v6_text, "::", -1)

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    head = groups(halves[0])
    tail = F.when(F.size(halves) == 2, groups(halves[1])).otherwise(F.array().cast("array<string>"))
    filled = F.concat(head, F.array_repeat(F.lit("0"), 8 - F.size(head) - F.size(tail)), tail)
    numbers = F.transform(filled, lambda g: F.conv(g, 16, 10).cast("long"))

    def half(first: int) -> Column:
        return F.aggregate(F.slice(numbers, first, 4), F.lit(0).cast("long"), lambda acc, g: F.shiftleft(acc, 16).bitwiseOR(g))

    ipv4 = value.rlike(rf"^{IPV4_PATTERN}\z")
    ipv6 = is_ip_address(value) & ~ipv4
    top = F.lit(_TOP).cast("long")
    return (
        F.when(ipv4, F.struct(F.lit(4).alias("family"), top.alias("high"), v4.bitwiseXOR(top).alias("low")))
        .when(ipv6, F.struct(F.lit(6).alias("family"), half(1).bitwiseXOR(top).alias("high"), half(5).bitwiseXOR(top).alias("low")))
    )


def cidr_ranges(blocks: Sequence[str]) -> list[tuple[int, int, int, int, int]]:
    """Disjoint, sorted (family, first high, first low, last high, last low) of CIDR blocks.

    Parsed on the driver from the parameter list; overlapping and touching blocks are merged.
    Halves carry the flipped top bit of :func:`address_number`.
    """
    spans: dict[int, list[list[int]]] = {4: [], 6: []}
    for block in blocks:
        network = ipaddress.ip_network(block.strip(), strict=False)
        spans[network.version].append([int(network.network_address), int(network.broadcast_address)])
    found = []
    for family, pieces in spans.items():
        merged: list[list[int]] = []
        for first, last in sorted(pieces):
            if merged and first <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])

        def split(number: int) -> tuple[int, int]:
            high, low = number >> 64, number & ((1 << 64) - 1)
            flip = lambda half: (half ^ (1 << 63)) - (1 << 64) if half ^ (1 << 63) >= 1 << 63 else half ^ (1 << 63)
            return flip(high), flip(low)

        found += [(family, *split(first), *split(last)) for first, last in merged]
    return found


def in_ranges(number: Column, ranges: Sequence[tuple[int, int, int, int, int]]) -> Column:
    """True when an :func:`address_number` lies in one of the ranges, False when not, null for
    a non-address. Give it a column computed once: each range reads it three times.

    One comparison per range, so meant for short lists (a few hundred blocks at most).
    """
    high, low = number["high"], number["low"]

    def inside(family: int, first_high: int, first_low: int, last_high: int, last_low: int) -> Column:
        above = (high > first_high) | ((high == first_high) & (low >= first_low))
        below = (high < last_high) | ((high == last_high) & (low <= last_low))
        return (number["family"] == family) & above & below

    return F.when(number.isNotNull(), any_of([inside(*r) for r in ranges]) if ranges else F.lit(False))
