import hashlib
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netloom.operators.flows import FLOW_COLUMNS, read_flows
from netloom.operators.handshakes import read_tls
from netloom.operators.ordered import CLOCK, with_clock
from netloom.operators.streams import NEEDED, read_dns_messages, read_tcp_streams
from netloom.sources import build as B
from netloom.sources import tls, x509
from netloom.sources.captures import read_packets
from netloom.streaming.captures import session_traffic, stream_packets, windowed_traffic

T0 = 1_700_000_000_000_000
FLOW = ["filename", "input_index", "section_number", "interface_id", "packet_number", "timestamp", "captured_length", "original_length", "vlan_ids", "ip_version", "ip_protocol", "ip_fragment_offset", "ip_more_fragments", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "tcp_seq", "tcp_ack", "payload_length"]


def save(folder, name, data):
    p = os.path.join(folder, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def capture(folder, frames, name="x.pcap", step=1000):
    return save(folder, name, B.pcap([f if isinstance(f, tuple) else (T0 + i * step, f) for i, f in enumerate(frames)]))


# --- flows: a model that walks all packets in file order with every open session at hand --------------------------------
def model(packets, tcp_idle, udp_idle):
    out, open_, clock, section = [], {}, {}, None

    def close(k, why):
        s = open_.pop(k)
        out.append((s["first"], s["last"], s["n"], s["late"], s["missing"], s["done"], s["both"], s["basis"], why))

    for p in packets:
        if section is not None and p["section_number"] != section:
            for k in list(open_):
                close(k, "section_boundary")
            clock = {}
        section = p["section_number"]
        face, t = p["interface_id"], p["t"]
        late = t is not None and face in clock and t < clock[face]
        if t is not None:
            clock[face] = max(clock.get(face, t), t)
        for k, s in list(open_.items()):
            idle = tcp_idle if k[1] == 6 else udp_idle
            if k[0] == face and idle and not s["missing"] and s["high"] is not None and face in clock and s["high"] + idle < clock[face]:
                close(k, "idle_timeout")
        if p["src_port"] is None:
            continue
        a, b = (p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])
        k = (face, p["ip_protocol"], min(a, b), max(a, b))
        fl = p["tcp_flags"] or 0
        if k in open_ and fl & 18 == 2:
            s = open_[k]
            opening = not s["closed"] and not s["done"] and not s["fin"]
            if not (opening and ((a in s["syn"] and s["seq"][a] == p["tcp_seq"]) or (a not in s["syn"] and b in s["syn"] and a not in s["ack"]))):
                close(k, "tuple_reuse")
        if k not in open_:
            open_[k] = dict(first=p["packet_number"], n=0, late=0, missing=0, high=None, syn=set(), ack=set(), seq={}, done=False, both=False, closed=False, fin=False, basis="syn_ack" if fl & 18 == 18 else "syn" if fl & 2 else "first_packet")
        s = open_[k]
        s["n"] += 1
        s["last"] = p["packet_number"]
        if t is None:
            s["missing"] += 1
        else:
            s["high"] = t if s["high"] is None else max(s["high"], t)
            s["late"] += late
        if p["ip_protocol"] == 6:
            if not fl & 2 and (fl & 16 or p["payload_length"]):
                s["closed"] = True
            s["fin"] |= bool(fl & 1)
            if fl & 18 == 2:
                s["both"] |= b in s["syn"]
                s["syn"].add(a)
                s["seq"][a] = p["tcp_seq"]
            elif fl & 18 == 18:
                if b in s["syn"] and p["tcp_ack"] == s["seq"][b] + 1:
                    s["ack"].add(a)
                    s["seq"][a] = p["tcp_seq"]
            elif fl & 16 and a in s["syn"] and b in s["ack"] and p["tcp_ack"] == s["seq"][b] + 1 and p["tcp_seq"] == s["seq"][a] + 1:
                s["done"] = True
            if fl & 4:
                close(k, "reset")
    for k in list(open_):
        close(k, "eof")
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_flows_match_the_model(spark, seed):
    rng = random.Random(seed)
    rows, t, n = [], 0, 0
    for section in range(1, rng.choice([2, 4])):
        for _ in range(rng.choice([1, 40, 400])):
            n += 1
            t += rng.choice([0, 1, 5, 30, 61, 301]) * 1_000_000
            now = None if rng.random() < 0.02 else t - rng.choice([0, 0, 0, 20, 100]) * 1_000_000
            proto = rng.choice([6, 6, 17, 1])
            ends = [("10.0.0.1", 1000), ("10.0.0.2", rng.choice([53, 80]))]
            rng.shuffle(ends)
            none = proto == 1
            rows.append(
                dict(
                    filename="f", input_index=0, section_number=section, interface_id=rng.choice([0, 0, 1]), packet_number=n, timestamp=None if now is None else datetime(2024, 1, 1) + timedelta(microseconds=now), captured_length=60, original_length=61, vlan_ids=[], ip_version=4, ip_protocol=proto,
                    ip_fragment_offset=0, ip_more_fragments=False, src_ip=ends[0][0], dst_ip=ends[1][0], src_port=None if none else ends[0][1], dst_port=None if none else ends[1][1], tcp_flags=rng.choice([2, 2, 18, 16, 16, 24, 17, 4]) if proto == 6 else None, tcp_seq=rng.choice([5, 6]) if proto == 6 else None, tcp_ack=rng.choice([6, 7]) if proto == 6 else None, payload_length=None if none else rng.choice([0, 9]),
                    t=now,
                )
            )
    schema = "filename string, input_index long, section_number long, interface_id long, packet_number long, timestamp timestamp_ntz, captured_length long, original_length long, vlan_ids array<int>, ip_version short, ip_protocol short, ip_fragment_offset int, ip_more_fragments boolean, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, tcp_seq long, tcp_ack long, payload_length long"
    df = spark.createDataFrame([tuple(r[c] for c in FLOW) for r in rows], schema)
    got = sorted((r.first_packet_number, r.last_packet_number, r.orig_packets + r.resp_packets, r.late_packets, r.missing_timestamp_packets, bool(r.handshake_complete), bool(r.simultaneous_open), r.originator_basis, r.finalized_by) for r in read_flows(df).collect())
    assert got == model(rows, 300_000_000, 60_000_000)


def test_clocks_of_the_reader(spark, tmp_path):
    rng = random.Random(8)
    data = b""
    for _ in range(3):
        data += B.section() + B.interface() + B.interface()
        for _ in range(150):
            f = B.packet(f"10.0.0.{rng.randint(1, 3)}", "192.0.2.1", 17, B.udp(1, rng.randint(1, 3), b"x"))
            data += B.simple(f) if rng.random() < 0.1 else B.enhanced(T0 + rng.randint(0, 400) * 1_000_000, f, rng.randint(0, 1))
    p = save(tmp_path, "c.pcapng", data)
    own = read_packets(spark, p, [*FLOW_COLUMNS, *CLOCK])
    derived = read_packets(spark, p, FLOW_COLUMNS)
    cols = ["packet_number", *CLOCK[:-1]]
    assert with_clock(derived).select(*cols).exceptAll(own.select(*cols)).count() == 0
    assert read_flows(own).exceptAll(read_flows(derived)).count() == 0 and read_flows(own).count() == read_flows(derived).count() > 20
    some = read_packets(spark, p, [*FLOW_COLUMNS, *CLOCK], where=[("dst_port", "=", 2)])
    assert own.filter("dst_port = 2").exceptAll(some).count() == 0


def test_flow_columns(spark, tmp_path):
    p = capture(tmp_path, [*B.conversation("10.0.0.1", "192.0.2.1", 5000, 80, b"a" * 10, b"b" * 20), B.packet("10.0.0.1", "10.0.0.1", 17, B.udp(7, 7, b"z"), vlans=(3,))])
    df = read_packets(spark, [p, p], FLOW)
    rows = read_flows(df).orderBy("flow_id").collect()
    assert [r.flow_id for r in rows] == [1, 2, 15, 16]
    a, u = rows[0], rows[2]
    assert (a.orig_ip, a.resp_port, a.orig_packets, a.resp_packets, a.orig_payload_bytes, a.resp_payload_bytes, a.handshake_complete, a.partial_session, a.ambiguous, a.finalized_by) == ("10.0.0.1", 80, 4, 3, 10, 20, True, False, False, "eof")
    assert a.duration == timedelta(microseconds=6000) and a.duration_us == 6000 and a.orig_tcp_flags == 0x1B
    assert (u.vlan_ids, u.equal_endpoints, u.ambiguous, u.partial_session, u.handshake_complete, u.orig_tcp_flags) == ([3], True, True, True, None, None)
    assert read_flows(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        read_flows(df, tcp_idle_timeout=timedelta(seconds=-1))


# --- streams -------------------------------------------------------------------------------------------------------------
def c(seq, flags, data=b"", ack=0, port=4000):
    return B.packet("10.0.0.1", "192.0.2.1", 6, B.tcp(port, 80, seq, ack, flags, data))


def s(seq, flags, data=b"", ack=0, port=4000):
    return B.packet("192.0.2.1", "10.0.0.1", 6, B.tcp(80, port, seq, ack, flags, data))


def streams(spark, tmp_path, frames, **kw):
    p = capture(tmp_path, frames)
    return read_tcp_streams(read_packets(spark, p, NEEDED), **kw).orderBy("first_packet_number").collect()


def test_stream_cases(spark, tmp_path):
    one = streams(spark, tmp_path, [c(99, 2), c(103, 24, b"def"), c(100, 24, b"abc"), c(100, 24, b"abc"), c(102, 24, b"cde"), c(106, 17)])
    assert len(one) == 1 and one[0].stream_data == b"abcdef" and (one[0].reassembly_status, one[0].finalized_by, one[0].tcp_sequence, one[0].fin_seen) == ("contiguous", "eof", 100, True)
    assert [(x.offset, x.data, x.first_packet_number, x.last_packet_number) for x in one[0].chunks] == [(0, b"abcdef", 2, 3)]
    gap = streams(spark, tmp_path, [c(99, 2), c(100, 24, b"abc"), c(108, 24, b"x")])[0]
    assert (gap.reassembly_status, gap.stream_data, gap.expected_bytes, gap.captured_bytes, [(g.offset, g.length) for g in gap.gaps]) == ("gapped", None, 9, 4, [(3, 5)])
    clash = streams(spark, tmp_path, [c(99, 2), c(100, 24, b"abc"), c(101, 24, b"XX")])[0]
    assert (clash.reassembly_status, clash.tcp_sequence, clash.chunks) == ("conflict", None, [])
    loose = streams(spark, tmp_path, [c(105, 24, b"f"), c(100, 24, b"abcde")])[0]
    assert (loose.reassembly_status, loose.stream_data, loose.syn_seen) == ("unanchored", b"abcdef", False)
    wrap = streams(spark, tmp_path, [c(0xFFFFFFFD, 2), c(1, 24, b"def"), c(0xFFFFFFFE, 24, b"abc")])[0]
    assert wrap.stream_data == b"abcdef"
    past = streams(spark, tmp_path, [c(99, 2), c(100, 17, b"ab"), c(102, 24, b"cd")])[0]
    assert past.reassembly_status == "conflict"
    fins = streams(spark, tmp_path, [c(99, 2), c(100, 17, b"ab"), c(100, 17, b"abc")])[0]
    assert fins.reassembly_error == "conflicting TCP FIN positions"
    assert streams(spark, tmp_path, [c(99, 2), s(1, 18, ack=100), c(100, 16)]) == []
    reset = streams(spark, tmp_path, [c(99, 2), s(1, 18), c(100, 24, b"q"), s(2, 24, b"r"), s(3, 4), c(200, 24, b"z")])
    assert [(r.finalized_by, r.stream_data, r.stream_id) for r in reset] == [("reset", b"q", 1), ("reset", b"r", 2), ("eof", b"z", 3)]
    reuse = streams(spark, tmp_path, [c(99, 2), c(100, 24, b"q"), s(7, 24, b"r"), c(500, 2), c(501, 24, b"w")])
    assert [(r.finalized_by, r.stream_data) for r in reuse] == [("tuple_reuse", b"q"), ("tuple_reuse", b"r"), ("eof", b"w")]
    idle = streams(spark, tmp_path, [(T0, c(99, 2)), (T0, c(100, 24, b"q")), (T0 + 301_000_000, c(101, 24, b"w")), (T0 + 302_000_000, c(9, 2, port=1))])
    assert [(r.finalized_by, r.stream_data, r.reassembly_status) for r in idle] == [("idle_timeout", b"q", "contiguous"), ("eof", b"w", "unanchored")]
    assert len(streams(spark, tmp_path, [(T0, c(99, 2)), (T0, c(100, 24, b"q")), (T0 + 301_000_000, c(101, 24, b"w"))], tcp_idle_timeout=timedelta(0))) == 1
    far = streams(spark, tmp_path, [c(99, 2), c(100 + (1 << 20), 24, b"q")])[0]
    assert far.reassembly_status == "limit"


def test_streams_put_random_segments_together(spark, tmp_path):
    rng = random.Random(4)
    frames, want = [], {}
    for k in range(40):
        data = rng.randbytes(rng.randint(1, 3000))
        base = rng.getrandbits(32)
        parts = []
        at = 0
        while at < len(data):
            n = rng.randint(1, 200)
            parts.append((at, data[at : at + n]))
            at += n
        parts += [(a, data[a : a + rng.randint(1, 300)]) for a in rng.sample(range(len(data)), min(5, len(data)))]
        rng.shuffle(parts)
        frames.append(c(base, 2, port=2000 + k))
        frames += [c(base + 1 + a, 24, d, port=2000 + k) for a, d in parts]
        want[2000 + k] = hashlib.sha256(data).hexdigest()
    order = sorted(range(len(frames)), key=lambda i: (i + rng.randint(0, 30)) if frames[i][47] & 2 == 0 else i)
    got = streams(spark, tmp_path, [frames[i] for i in order])
    anchored = {r.src_port: hashlib.sha256(r.stream_data).hexdigest() for r in got if r.reassembly_status == "contiguous"}
    assert all(want[p] == h for p, h in anchored.items()) and len(anchored) > 20


def test_dns_messages(spark, tmp_path):
    q = [B.dns_query(i, f"n{i}.example") for i in range(3)]
    raw = b"".join(len(x).to_bytes(2, "big") + x for x in q)
    to53 = lambda seq, flags, data=b"", port=4000: B.packet("10.0.0.1", "192.0.2.1", 6, B.tcp(port, 53, seq, 0, flags, data))
    frames = [to53(99, 2), to53(100 + 40, 24, raw[40:]), to53(100, 24, raw[:40]), to53(9, 2, port=1), to53(10, 24, b"\0\5hello", port=1), to53(9, 2, port=2), to53(10, 24, raw[:50], port=2), to53(10, 24, raw, port=3)]
    frames += [B.packet("10.0.0.1", "192.0.2.1", 17, B.udp(5, 53, q[0])), B.packet("10.0.0.1", "192.0.2.1", 17, B.udp(5, 53, q[0]))[:-4], B.packet("10.0.0.1", "192.0.2.1", 17, B.udp(5, 54, q[0]))]
    p = read_packets(spark, capture(tmp_path, frames), NEEDED)
    rows = sorted(read_dns_messages(p).collect(), key=lambda r: (r.transport, r.src_port, r.message_number or 9, r.first_packet_number))
    assert [(r.transport, r.src_port, r.message_number, r.reassembly_status, r.dns_question_name, r.first_packet_number, r.last_packet_number) for r in rows] == [
        ("tcp", 1, None, "invalid", None, 4, 5), ("tcp", 2, 1, "complete", "n0.example", 7, 7), ("tcp", 2, None, "incomplete", None, 6, 7), ("tcp", 3, None, "unanchored", None, 8, 8),
        ("tcp", 4000, 1, "complete", "n0.example", 3, 3), ("tcp", 4000, 2, "complete", "n1.example", 2, 3), ("tcp", 4000, 3, "complete", "n2.example", 2, 2),
        ("udp", 5, 1, "complete", "n0.example", 9, 9), ("udp", 5, None, "incomplete", None, 10, 10),
    ]
    assert rows[0].dns_error and rows[4].message_data == q[0] and rows[4].tcp_sequence == 100


# --- TLS -----------------------------------------------------------------------------------------------------------------
def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | ((n.bit_length() + 7) // 8)]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def oid(text):
    a, b, *rest = map(int, text.split("."))
    out = b""
    for v in (a * 40 + b, *rest):
        part = [v & 127]
        while v := v >> 7:
            part.append(v & 127 | 128)
        out += bytes(reversed(part))
    return der(6, out)


def certificate():
    name = der(0x30, der(0x31, der(0x30, oid("2.5.4.6"), der(19, b"XX"))), der(0x31, der(0x30, oid("2.5.4.3"), der(12, "Ä, b".encode()))))
    alg = der(0x30, oid("1.2.840.113549.1.1.11"), der(5))
    key = der(0x30, der(0x30, oid("1.2.840.113549.1.1.1"), der(5)), der(3, b"\0" + der(0x30, der(2, b"\0" + b"\xff" * 256), der(2, b"\1\0\1"))))
    ext = lambda o, v, crit=b"": der(0x30, oid(o), crit, der(4, v))
    exts = [
        ext("2.5.29.17", der(0x30, der(0x82, b"a.example"), der(0x87, bytes([192, 0, 2, 1])), der(0x87, bytes(15) + b"\1"))), ext("2.5.29.19", der(0x30, der(1, b"\xff"), der(2, b"\2")), der(1, b"\xff")), ext("2.5.29.15", der(3, b"\5\xa0")),
        ext("2.5.29.37", der(0x30, oid("1.3.6.1.5.5.7.3.1"), oid("1.2.3"))), ext("2.5.29.14", der(4, b"\xab\xcd")), ext("2.5.29.35", der(0x30, der(0x80, b"\x01\x02"))), ext("2.5.29.32", der(0x30, der(0x30, oid("2.23.140.1.2.1")))),
        ext("1.3.6.1.5.5.7.1.1", der(0x30, der(0x30, oid("1.3.6.1.5.5.7.48.1"), der(0x86, b"http://o")), der(0x30, oid("1.3.6.1.5.5.7.48.2"), der(0x86, b"http://i")))), ext("2.5.29.31", der(0x30, der(0x30, der(0xA0, der(0xA0, der(0x86, b"http://c")))))),
    ]
    body = der(0x30, der(0xA0, der(2, b"\2")), der(2, b"\x0f\xff"), alg, name, der(0x30, der(23, b"240101000000Z"), der(24, b"20500101000000Z")), name, key, der(0xA3, der(0x30, *exts)))
    return der(0x30, body, alg, der(3, b"\0sig"))


def test_certificate():
    raw = certificate()
    p = x509.parse(raw)
    assert (p["subject"], p["serial"], p["not_before"], p["not_after"]) == ("CN=Ä\\, b,C=XX", "0fff", datetime(2024, 1, 1), datetime(2050, 1, 1))
    assert (p["signature_algorithm"], p["public_key_algorithm"], p["public_key_bits"], p["is_ca"], p["path_length"]) == ("sha256WithRSAEncryption", "rsaEncryption", 2048, True, 2)
    assert (p["san_dns"], p["san_ip"], p["key_usage"], p["extended_key_usage"]) == (["a.example"], ["192.0.2.1", "::1"], ["digitalSignature", "keyEncipherment"], ["serverAuth", "1.2.3"])
    assert (p["subject_key_id"], p["authority_key_id"], p["ocsp_urls"], p["ca_issuers_urls"], p["crl_urls"], p["policies"]) == ("abcd", "0102", ["http://o"], ["http://i"], ["http://c"], ["2.23.140.1.2.1"])
    assert p["sha256"] == hashlib.sha256(raw).hexdigest() and p["ja4x"] is None
    rng = random.Random(1)
    for _ in range(3000):
        x = bytearray(raw)
        for _ in range(rng.randint(1, 4)):
            x[rng.randrange(len(x))] = rng.randrange(256)
        x509.parse(bytes(x[: rng.randint(0, len(x))]))
    assert x509.parse(b"") is None and x509.parse(raw + b"\0") is None


def test_handshakes(spark, tmp_path):
    suites = [0x0A0A, 49195, 47]
    hello = B.client_hello("a.example", suites, alpn=["h2"], session=b"s" * 8)
    cert = certificate()
    chain = (len(cert) + 3 + 5).to_bytes(3, "big") + len(cert).to_bytes(3, "big") + cert + b"\0\0\2xx"
    answer = B.tls_record(B.server_hello(47, None, b"s" * 8)) + B.tls_record(b"\x0b" + len(chain).to_bytes(3, "big") + chain)
    cut = len(hello) // 2
    frames = B.conversation("10.0.0.1", "192.0.2.1", 1, 443, B.tls_record(hello[:cut]) + B.tls_record(hello[cut:]), answer, 50)
    frames += B.conversation("10.0.0.2", "192.0.2.1", 2, 443, b"\5\1\0" + b"\5\1\0\3\x06b.test\x01\xbb" + B.tls_record(hello), b"\5\0" + b"\5\0\0\1\0\0\0\0\0\0" + answer)
    frames += B.conversation("10.0.0.3", "192.0.2.1", 3, 443, b"EHLO x\r\nSTARTTLS\r\n" + B.tls_record(hello), b"220 hi\r\n250 ok\r\n220 go\r\n" + answer)
    frames += B.conversation("10.0.0.4", "192.0.2.1", 4, 443, b"?" + B.tls_record(hello), b"no tls here")
    frames += B.conversation("10.0.0.5", "192.0.2.1", 5, 443, B.tls_record(hello)[:-9], b"x")
    frames += B.conversation("10.0.0.6", "192.0.2.1", 6, 443, b"GET / HTTP/1.1\r\n\r\n", b"plain")
    rows = {r.client_port: r for r in read_tls(read_packets(spark, capture(tmp_path, frames), NEEDED)).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    a = rows[1]
    assert (a.tls_sni, a.reassembly_status, a.session_resumed, a.cipher_suite, a.negotiated_version, a.client_cipher_suites_no_grease, a.client_alpn, a.tunnel) == ("a.example", "complete", True, 47, 771, [49195, 47], ["h2"], None)
    assert a.server_certificates[0].subject == "CN=Ä\\, b,C=XX" and a.server_certificates[1] is None and a.warnings == ["server_certificate_malformed"]
    assert a.ja3 == hashlib.md5(a.ja3_full.encode()).hexdigest() and a.ja3_full == "771,49195-47,0-10-11-13-16,29-23,0" and a.ja4.startswith("t12d0205h2_")
    assert (rows[2].tunnel.protocol, rows[2].tunnel.destination, rows[2].tunnel.client_prefix_bytes, rows[2].tunnel.server_prefix_bytes) == ("socks5", "b.test:443", 16, 12)
    assert (rows[3].tunnel.protocol, rows[3].tunnel.destination) == ("smtp", None)
    assert rows[4].reassembly_status == "one-sided" and rows[4].warnings == ["server_hello_missing", "client_tunnel_unrecognized"]
    assert rows[5].reassembly_status == "incomplete" and rows[5].tls_sni is None


def test_prefixes():
    assert tls.client_prefix(b"CONNECT h:1 HTTP/1.1\r\nA: b\r\n\r\n") == ("http_connect", "h:1")
    assert tls.client_prefix(b"\4\1\0\x50\1\2\3\4user\0") == ("socks4", "1.2.3.4:80") and tls.client_prefix(b"\4\1\0\x50\0\0\0\1\0host\0") == ("socks4a", "host:80")
    assert tls.client_prefix(b"a1 STARTTLS\r\n")[0] == "imap" and tls.client_prefix(b"CAPA\r\nSTLS\r\n")[0] == "pop3" and tls.client_prefix(b"FEAT\r\nAUTH TLS\r\n")[0] == "ftp"
    assert tls.client_prefix(b"junk") == (None, None) and tls.client_prefix(b"\5\1") == (None, None)
    rng = random.Random(1)
    good = B.tls_record(B.client_hello("a", [1, 2], versions=[772]))
    for _ in range(3000):
        x = bytearray(good)
        for _ in range(3):
            x[rng.randrange(len(x))] = rng.randrange(256)
        tls.read_side(bytes(x[: rng.randint(0, len(x))]), True, False)


# --- streaming -----------------------------------------------------------------------------------------------------------
def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    frames = [B.packet(f"10.0.0.{i % 3}", "192.0.2.1", 17, B.udp(1, 9000 + i % 2, b"x" * i)) for i in range(60)]
    for k in range(3):
        capture(folder, [(T0 + (20 * k + i) * 7_000_000, f) for i, f in enumerate(frames[20 * k : 20 * k + 20])], f"{k}.pcap")
        time.sleep(0.01)

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    src = stream_packets(spark, str(folder), files_at_once=1)
    batch = read_packets(spark, f"{folder}/*.pcap")
    got = run(src.select("packet_number", "src_ip", "dst_port"), "raw", "append")
    assert got.count() == 60 and got.exceptAll(batch.select("packet_number", "src_ip", "dst_port")).count() == 0
    windows = {(r.window_start, r.dst_port): (r.packets, r.captured_bytes) for r in run(windowed_traffic(src, ["dst_port"], "1 minute"), "w", "complete").collect()}
    want = {(r.s, r.dst_port): (r.n, r.b) for r in batch.groupBy(F.date_trunc("minute", "timestamp").cast("timestamp").alias("s"), "dst_port").agg(F.count("*").alias("n"), F.sum("captured_length").alias("b")).collect()}
    assert windows == want
    sessions = run(session_traffic(src, ["src_ip"], "1 minute", "0 seconds"), "s", "append")
    assert sessions.columns == ["src_ip", "start_time", "end_time", "packets"]


def test_ids_differ_between_inputs(spark, tmp_path):
    """Rows without the reader's input columns: every file name is an input, numbered from 1 in order of name."""
    frames = B.conversation("10.0.0.1", "192.0.2.1", 5000, 80, b"a", b"b")
    one, two = capture(tmp_path, frames), str(tmp_path / "other.pcap")
    with open(one, "rb") as f, open(two, "wb") as g:
        g.write(f.read())
    cols = [c for c in FLOW_COLUMNS if c not in ("input_index", "input_count")]
    df = read_packets(spark, [one, two], cols)
    rows = read_flows(df.union(df.filter("packet_number = 1").withColumn("filename", F.lit(None)))).collect()
    named = {name: i for i, name in enumerate(sorted([one, two]), 2)}
    assert {(r.filename, r.input_index) for r in rows} == {(None, 1), *named.items()}
    assert len({r.flow_id for r in rows}) == len(rows) and {r.flow_id for r in rows} == {1, 2, 3}
    own = read_flows(read_packets(spark, [one, one], FLOW_COLUMNS)).collect()
    assert sorted((r.input_index, r.flow_id) for r in own) == [(1, 1), (2, 2)]


def test_machines_of_colliding_keys(spark, monkeypatch):
    """Keys with one hash share a sorted run, each with a machine of its own."""
    from netloom.operators import ordered

    class Count:
        def __init__(self):
            self.n, self.key = 0, None

        def row(self, p):
            self.n, self.key = self.n + 1, p.k
            return []

        def end(self):
            return [(self.key, self.n)]

    monkeypatch.setattr(ordered.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([(f"k{i % 5}", i) for i in range(100)], "k string, n long")
    got = ordered.along(df, ["k"], ["n"], Count, "k string, n long").collect()
    assert sorted(map(tuple, got)) == [(f"k{i}", 20) for i in range(5)]
