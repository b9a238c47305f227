"""Canonical text of IP addresses and capture paths, as native Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PLAIN_V4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_PLAIN_V6 = r"^(?!0000:0000:0000:0000:0000:ffff:)(?:[0-9a-f]{4}:){7}[0-9a-f]{4}$"
_ANY_V4 = r"^\d+\.\d+\.\d+\.\d+$"
_ANY_V6 = r"^[0-9a-f:]*:[0-9a-f:]*(?::\d+\.\d+\.\d+\.\d+)?$"
_MAPPED = "0000:0000:0000:0000:0000:ffff:"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (a lambda binding instead of repeated subtrees)."""
    return F.transform(F.array(value), body)[0]


def _dotted(x: Column) -> Column:
    """Four decimal octets without leading zeros, or null."""

    def build(p: Column) -> Column:
        n = [p[i].try_cast("int") for i in range(4)]
        ok = F.lit(True)
        for v in n:
            ok = ok & v.between(0, 255)
        return F.when((F.size(p) == 4) & ok, F.concat_ws(".", *[v.cast("string") for v in n]))

    return F.when(x.rlike(_ANY_V4), _let(F.split(x, r"\."), build))


def _hex_tail(x: Column) -> Column:
    """An address whose last 32 bits are dotted, with these as two hex groups; null if they are no octets."""

    def build(v4: Column) -> Column:
        p = F.split(v4, r"\.")
        two = [F.lower(F.hex(p[i].cast("int") * 256 + p[i + 1].cast("int"))) for i in (0, 2)]
        return F.concat(F.regexp_extract(x, r"^(.*:)[^:]*$", 1), two[0], F.lit(":"), two[1])

    return F.when(F.instr(x, ".") == 0, x).otherwise(_let(_dotted(F.substring_index(x, ":", -1)), build))


def _groups(x: Column) -> Column:
    """Eight zero-padded groups of an IPv6 text with at most one ``::``, or null."""

    def count(s: Column) -> Column:
        return F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(":"), F.lit(""))) + 1)

    left, right = F.substring_index(x, "::", 1), F.substring_index(x, "::", -1)
    fill = 8 - count(left) - count(right)
    spread = F.concat_ws(
        ":",
        F.when(left != "", left),
        F.when(fill > 0, F.substring(F.repeat(F.lit("0:"), fill), F.lit(1), 2 * fill - 1)),
        F.when(right != "", right),
    )
    doubles = F.length(x) - F.length(F.replace(x, F.lit("::"), F.lit("")))
    whole = F.when(F.instr(x, "::") == 0, x).when((fill >= 1) & (doubles == 2) & (F.instr(x, ":::") == 0), spread)

    def build(w: Column) -> Column:
        p = F.split(w, ":")
        return F.when(w.rlike(r"^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"), F.concat_ws(":", *[F.lpad(p[i], 4, "0") for i in range(8)]))

    return _let(whole, build)


def _v6(x: Column) -> Column:
    def unmap(g: Column) -> Column:
        quad = F.concat_ws(".", *[F.conv(F.substring(g, at, 2), 16, 10) for at in (31, 33, 36, 38)])
        return F.when(g.startswith(_MAPPED), quad).otherwise(g)

    return F.when(x.rlike(_ANY_V6), _let(_let(_hex_tail(x), _groups), unmap))


def canonical_ip(col: Column | str) -> Column:
    """One text for all spellings of a host.

    IPv4 becomes plain dotted decimal, IPv6 eight groups of four lower-case hex digits, IPv4-mapped IPv6 the IPv4
    address; surrounding blanks are dropped. Null and anything that is no address (also ``''``) give null.
    Canonical texts, nearly all rows, pass after one regular expression; others take the slow path.
    """
    c = F.col(col) if isinstance(col, str) else col
    slow = _let(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), lambda x: F.when(F.instr(x, ":") > 0, _v6(x)).otherwise(_dotted(x)))
    return F.when(c.rlike(_PLAIN_V4) | c.rlike(_PLAIN_V6), c).otherwise(slow)


def canonical_path(col: Column | str) -> Column:
    """Absolute path of a capture: no ``file:`` scheme or percent signs, no empty, ``.`` or ``..`` parts.

    Null gives null; ``''`` gives ``'/'``; relative paths are read from the root. Percent signs are decoded only in
    ``file:`` URIs, where ``+`` is an ordinary character; a URI with broken escapes keeps them as they stand.
    """
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(c, r"^file:(?://[^/]*)?", "")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare)
    path = F.when(c.startswith("file:"), decoded).otherwise(c)

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when((part == "") | (part == "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    empty = F.array().cast("array<string>")
    slow = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))
    return F.when(c.rlike(r"^(?:/(?!\.{1,2}(?:/|$))[^/]+)+$"), c).when(c.isNotNull(), slow)
