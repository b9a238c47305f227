import ipaddress
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.functions.addresses import canonical_ip, canonical_path
from netloom.functions.fingerprints import ja3_text, ja4_parts, no_grease, short_hash
from netloom.functions.names import SuffixRules, encoded_ratio, normalized_entropy, suffix_parts
from netloom.functions.network import ip_in_cidrs, parse_cidrs


def plain(text):
    """The canonical address by the standard library."""
    try:
        if ":" not in text and "." in text:
            parts = text.strip().split(".")
            return ".".join(str(int(p)) for p in parts) if len(parts) == 4 and all(p.isdigit() and int(p) < 256 for p in parts) else None
        a = ipaddress.IPv6Address(text.strip())
        return str(a.ipv4_mapped) if a.ipv4_mapped else a.exploded
    except ValueError:
        return None


def test_canonical_ip(spark):
    rng = random.Random(1)
    texts = ["", " ", "x", "1.2.3", "1.2.3.4.5", "256.0.0.1", "1::2::3", ":::", "1:2", "::", "::1", "1::", " 10.0.0.1 ", "010.001.000.009", "::ffff:1.2.3.4", "::FFFF:102:304", "1:2:3:4:5:6:1.2.3.4", "fe80::1%eth0", "1:2:3:4:5:6:7:8:9", "12345::"]
    for _ in range(300):
        a = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([-1, (1 << 64) - 1, ((1 << 128) - 1) << 64]))
        texts += [a.compressed, a.exploded.upper(), f" {a}"]
        texts.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "a string").select("a", canonical_ip("a").alias("c")).collect()
    assert [(r.a, r.c) for r in rows] == [(t, plain(t)) for t in texts] + [(None, None)]


def test_canonical_path(spark):
    given_ = {
        "/a/b": "/a/b", "/a//b": "/a/b", "/a/./b": "/a/b", "/a/x/../b": "/a/b", "/a/x/y/../../b": "/a/b", "/../a": "/a", "a/b": "/a/b", "": "/", "/a/b/": "/a/b", "/a/..b/c.": "/a/..b/c.",
        "file:///a/b%5Fc": "/a/b_c", "file:/a+b": "/a+b", "file://host/a": "/a", "file:///a%zz": "/a%zz", "/a%5Fb": "/a%5Fb", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in given_], "a string").select("a", canonical_path("a").alias("c")).collect()
    assert {r.a: r.c for r in rows} == given_


def test_cidrs(spark):
    ips = ["10.1.2.3", "11.0.0.1", "::ffff:10.1.2.3", "2001:db8::1", "2001:db9::", "bad", "", None, "010.1.2.3"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = [r.m for r in df.select(ip_in_cidrs("ip", ["10.0.0.0/8", "2001:db8::/32"]).alias("m")).collect()]
    assert got == [True, False, False, True, False, None, None, None, True]
    assert [r.m for r in df.select(ip_in_cidrs("ip", None).alias("m")).collect()] == [None] * len(ips)
    assert [r.m for r in df.select(ip_in_cidrs("ip", []).alias("m")).collect()] == [False] * 5 + [None] * 3 + [False]
    for bad in (["10.0.0.0"], ["10.0.0.0/33"], [None], ["x/8"], ["::/129"]):
        with pytest.raises(ValueError):
            parse_cidrs(bad)


def test_suffixes(spark):
    rules = SuffixRules.parse(["com", "jp", "*.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "// ===BEGIN PRIVATE DOMAINS===", "blogspot.com"])
    cases = {
        "a.b.ck": ("b.ck", "a.b.ck", "", "icann", "*.ck"), "www.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp", "www", "icann", "!city.kawasaki.jp"), "foo.blogspot.com": ("blogspot.com", "foo.blogspot.com", "", "private", "blogspot.com"),
        "host.corp.internal": ("internal", "corp.internal", "host", "unknown", "*"), "COM.": ("com", "", "", "icann", "com"), "x.y.EXAMPLE.COM.": ("com", "example.com", "xy", "icann", "com"), "bad..name": ("", "", "", "unknown", "*"), "": ("", "", "", "unknown", "*"),
        "ck": ("ck", "", "", "unknown", "*"),
    }
    for n, parts in cases.items():
        assert rules.split(n) == parts, n
    rows = spark.createDataFrame([(n,) for n in [*cases, None]], "n string").select("n", suffix_parts("n", rules).alias("s")).collect()
    assert {r.n: tuple(r.s) if r.s else None for r in rows} == {**cases, None: None}


def test_name_looks(spark):
    texts = ["", "aaaa", "0123456789abcdef", "Zz7é", "a" * 1000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalized_entropy("t").alias("e"), encoded_ratio("t").alias("r")).collect()
    for r in rows:
        if r.t is None:
            assert r.e is None and r.r is None
            continue
        raw = r.t.encode()
        e = -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values()) / 6 if raw else 0
        assert r.e == pytest.approx(min(1, e)), r.t
        low = r.t.lower()
        share = max(sum(c in "0123456789abcdef" for c in low), sum(c in "abcdefghijklmnopqrstuvwxyz234567" for c in low)) / len(low.encode()) if low else 0
        assert r.r == pytest.approx(share)


def test_fingerprints(spark):
    df = spark.createDataFrame([(771, [0x0A0A, 4865, 47], [0x1A1A, 0, 10, 16], [0x2A2A, 29], [0], [772, 0x3A3A], [1027], ["h2"]), (769, [5], [], None, None, None, None, None), (None, None, None, None, None, None, None, None)], "v int, s array<int>, e array<int>, g array<int>, p array<int>, vs array<int>, sig array<int>, al array<string>")
    prefix, first, second = ja4_parts("v", "s", "e", "vs", "sig", "al")
    a, b, c = df.select(ja3_text("v", "s", "e", "g", "p").alias("ja3"), prefix.alias("x"), first.alias("y"), second.alias("z"), short_hash(second).alias("h"), no_grease("s").alias("n")).collect()
    assert a.ja3 == "771,4865-47,0-10-16,29,0" and a.x == "t13d0203h2" and a.y == "002f,1301" and a.z == "000a_0403" and a.n == [4865, 47]
    assert b.ja3 == "769,5,,," and b.x == "t10i010000" and b.y == "0005" and b.z == "" and b.h == "0" * 12
    assert c.ja3 is None and c.x is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "com", "co", "uk", "x"]), min_size=1, max_size=5))
def test_suffix_is_a_tail(labels):
    rules = SuffixRules.parse(["com", "uk", "co.uk", "*.x"])
    n = ".".join(labels)
    suffix, own, left, _, _ = rules.split(n)
    assert n == suffix or n.endswith("." + suffix)
    assert not own or (own.endswith("." + suffix) and own.count(".") == suffix.count(".") + 1)
    assert left == "".join(labels[: len(labels) - own.count(".") - 1]) if own else left == ""


def test_values_equal_pylist():
    import pyarrow as pa

    from netloom.sources.columns import values

    for a in (
        pa.array([1, None, 3]), pa.array([], pa.int32()), pa.array([True, None, False]), pa.array(["a", None, "", "a"]), pa.array([b"x", None, b"", b"yz"]), pa.array([b"x", b"yy", b"z"]).slice(1), pa.array([[1], None]),
        pa.array(["a", "b", "c"]).slice(2), pa.array([None, None], pa.binary()), pa.array([5, 6, None], pa.int16()).slice(1),
    ):
        assert values(a) == a.to_pylist()
