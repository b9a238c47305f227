"""JA3, JA3S and JA4 of parsed hellos as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sixteen values that clients send to keep servers tolerant (both bytes alike, low halves ten).
GREASE = [0x0A0A + 0x1010 * i for i in range(16)]
_VERSIONS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2", 0xFEFF: "d1", 0xFEFD: "d2", 0xFEFC: "d3"}
NOTHING = "0" * 12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_grease(values: Column | str) -> Column:
    """A list without GREASE values; null for null."""
    return F.filter(_col(values), lambda x: ~x.isin(GREASE))


def _decimal(values: Column) -> Column:
    return F.coalesce(F.array_join(no_grease(values).cast("array<string>"), "-"), F.lit(""))


def _hex(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ",")


def ja3_text(version: Column | str, suites: Column | str, extensions: Column | str, groups: Column | str, points: Column | str) -> Column:
    """Numbers of a ClientHello in the order sent; null unless suites and extensions are known."""
    v, s, e, g, p = map(_col, (version, suites, extensions, groups, points))
    whole = F.concat_ws(",", v.cast("string"), _decimal(s), _decimal(e), _decimal(g), F.coalesce(F.array_join(p.cast("array<string>"), "-"), F.lit("")))
    return F.when(v.isNotNull() & s.isNotNull() & e.isNotNull(), whole)


def ja3s_text(version: Column | str, suite: Column | str, extensions: Column | str) -> Column:
    v, s, e = map(_col, (version, suite, extensions))
    return F.when(v.isNotNull() & s.isNotNull() & e.isNotNull(), F.concat_ws(",", v.cast("string"), s.cast("string"), _decimal(e)))


def _alpn(protocols: Column) -> Column:
    first = F.element_at(protocols, 1)
    ends = F.concat(F.substring(first, 1, 1), F.substring(first, -1, 1))
    digits = F.lower(F.hex(F.encode(first, "latin1")))
    odd = F.concat(F.substring(digits, 1, 1), F.substring(digits, -1, 1))
    return F.when(protocols.isNull() | (F.size(protocols) == 0), "00").when(ends.rlike("^[0-9A-Za-z]{2}$"), ends).otherwise(odd)


def ja4_parts(version: Column | str, suites: Column | str, extensions: Column | str, versions: Column | str, signatures: Column | str, alpn: Column | str) -> tuple[Column, Column, Column]:
    """Prefix, sorted suites, and sorted extensions with signature algorithms; prefix null where there is no fingerprint."""
    v, s, e, vs, sig, al = map(_col, (version, suites, extensions, versions, signatures, alpn))
    offered = F.array_max(no_grease(vs))
    best = F.when(vs.isNotNull(), offered).otherwise(v)
    name = F.coalesce(F.create_map(*[F.lit(x) for k, t in _VERSIONS.items() for x in (k, t)])[best], F.lit("00"))
    cs, es = no_grease(s), no_grease(e)

    def count(x: Column) -> Column:
        return F.lpad(F.least(F.size(x), F.lit(99)).cast("string"), 2, "0")

    prefix = F.concat(F.lit("t"), name, F.when(F.array_contains(es, 0), "d").otherwise("i"), count(cs), count(es), _alpn(al))
    signed = no_grease(sig)
    second = _hex(F.array_sort(F.filter(es, lambda x: ~x.isin(0, 16))))
    second = F.when(F.size(signed) > 0, F.concat(second, F.lit("_"), _hex(signed))).otherwise(second)
    return F.when(s.isNotNull() & e.isNotNull() & best.isNotNull(), prefix), _hex(F.array_sort(cs)), second


def short_hash(text: Column) -> Column:
    """First twelve digits of SHA-256, or zeros for an empty text."""
    return F.when(text == "", NOTHING).otherwise(F.substring(F.sha2(text, 256), 1, 12))
