"""Addresses as sortable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.plan import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def is_ipv4(address: Column) -> Column:
    return address.rlike(rf"\A{_QUAD}\z")


def ipv4_to_long(address: Column) -> Column:
    """Null unless the text is a dotted quad."""
    part = F.split(address, r"\.")
    value = sum(F.get(part, F.lit(i)).cast("bigint") * (1 << shift) for i, shift in enumerate((24, 16, 8, 0)))
    return F.when(is_ipv4(address), value)


def trailing_ipv4(address: Column) -> Column:
    """The dotted quad at the end of an address, or null."""
    quad = F.regexp_extract(address, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\z", 1)
    return let(quad, lambda q: F.when(is_ipv4(q), q))


def _without_quad(address: Column) -> Column:
    """A trailing dotted quad written as two groups of hex digits."""
    head = F.regexp_replace(address, r"[0-9.]+\z", "")
    return let(
        ipv4_to_long(trailing_ipv4(address)),
        lambda q: F.when(
            q.isNotNull(), F.lower(F.concat(head, F.hex(F.shiftright(q, 16)), F.lit(":"), F.hex(q.bitwiseAND(65535))))
        ).otherwise(address),
    )


def _expand(address: Column) -> Column:
    # At most one "::" and never ":::"; groups of one to four digits with single colons between them.
    group = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
    shape = address.rlike(rf"\A(?:{group})?(?:::(?:{group})?)?\z") & (address != "")
    groups = F.transform(F.split(address, "::"), lambda half: F.filter(F.split(half, ":"), lambda g: g != ""))

    def join(halves: Column) -> Column:
        count = F.size(F.flatten(halves))
        valid = F.when(F.size(halves) == 2, count <= 7).otherwise(count == 8)
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - count, F.lit(0)))
        tail = F.coalesce(F.get(halves, F.lit(1)), F.array().cast("array<string>"))
        digits = F.transform(F.concat(F.get(halves, F.lit(0)), zeros, tail), lambda g: F.lpad(g, 4, "0"))
        return F.when(valid, F.array_join(digits, ""))

    return F.when(shape, let(groups, join))


def ipv6_to_hex(address: Column) -> Column:
    """32 hex digits, so that text order is numeric order; null when the text is no IPv6 address."""
    plain = F.lower(F.regexp_replace(address, r"%.*\z", ""))
    return F.when(F.contains(address, F.lit(":")), let(let(plain, _without_quad), _expand))


def url_protocol(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))


def url_host(url: Column) -> Column:
    """Lower-case host, brackets of an IPv6 literal removed."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\A\[|\]\z", "")
