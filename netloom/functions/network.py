"""CIDR membership as native range comparisons."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.addresses import _ANY_V6, _dotted, _groups, _hex_tail, _let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ip_number(col: Column | str) -> Column:
    """An IPv4 text as a number; null for anything else."""

    def number(d: Column) -> Column:
        p = F.split(d, r"\.")
        return sum((p[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), p[0].cast("long") * 256**3)

    return _let(_dotted(_col(col)), number)


def ip_groups(col: Column | str) -> Column:
    """An IPv6 text (also with ``::`` or an embedded IPv4 tail) as eight groups of four digits; null for anything else."""
    x = F.lower(_col(col))
    return F.when(x.rlike(_ANY_V6), _let(_hex_tail(x), _groups))


def parse_cidrs(cidrs: list[str]) -> list[ipaddress.IPv4Network | ipaddress.IPv6Network]:
    """Networks of CIDR texts; host bits may be set. A null or bad element raises ValueError."""
    out = []
    for c in cidrs:
        if c is None or "/" not in c:
            raise ValueError(f"not a CIDR block: {c!r}")
        address, _, bits = c.partition("/")
        if not bits.isdigit():
            raise ValueError(f"not a CIDR block: {c!r}")
        if ":" not in address:
            address = ".".join(str(int(o)) if o.isdigit() and len(o) <= 3 else o for o in address.split("."))
        out.append(ipaddress.ip_network(f"{address}/{bits}", strict=False))
    return out


def ip_in_cidrs(col: Column | str, cidrs: list[str] | None) -> Column:
    """Whether an address lies in any of the blocks.

    Null for a null or unreadable address and for a null list; false for an empty list. IPv4 and IPv6 never match each
    other, an IPv4-mapped IPv6 address being IPv6. Bad blocks raise at once. Numbers are compared for IPv4 and texts of
    fixed width for IPv6, so the test stays inside generated code and can be pushed through joins and aggregates.
    """
    if cidrs is None:
        return F.lit(None).cast("boolean")
    v4 = [n for n in parse_cidrs(cidrs) if n.version == 4]
    v6 = [n for n in parse_cidrs(cidrs) if n.version == 6]

    def anyof(x: Column, ranges: list[tuple]) -> Column:
        out = F.lit(False)
        for a, b in ranges:
            out = out | x.between(F.lit(a), F.lit(b))
        return F.when(x.isNotNull(), out)

    four = [(int(n.network_address), int(n.broadcast_address)) for n in v4]
    six = [(n.network_address.exploded, n.broadcast_address.exploded) for n in v6]
    return F.when(F.instr(_col(col), ":") > 0, _let(ip_groups(col), lambda x: anyof(x, six))).otherwise(_let(ip_number(col), lambda x: anyof(x, four)))
