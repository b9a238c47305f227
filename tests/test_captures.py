import os
import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netloom.operators.inventory import capture_inventory
from netloom.sources import build as B
from netloom.sources import dns
from netloom.sources.captures import expand, read_dns, read_packets, read_pcap
from netloom.sources.export import write_pcap, write_pcap_parts
from netloom.sources.framing import Capture, CaptureError, open_bytes

T0 = 1_700_000_000_000_000


def when(us):
    return datetime(1970, 1, 1) + timedelta(microseconds=us)


def save(folder, name, data):
    p = os.path.join(folder, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)
    return p


def udp(i=0, port=9000, data=b"hello"):
    return B.packet("10.0.0.1", "192.0.2.1", 17, B.udp(1000 + i, port, data))


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("nano", [False, True])
def test_classic(spark, tmp_path, order, nano):
    p = save(tmp_path, "a.pcap", B.pcap([(T0, udp()), (T0 + 1, udp(1)[:50], 90)], order=order, nanoseconds=nano))
    rows = read_pcap(spark, p).orderBy("packet_number").collect()
    assert [(r.timestamp, r.captured_length, r.original_length, r.packet_offset, r.capture_format, r.section_number) for r in rows] == [(when(T0), 47, 47, 40, "pcap", 1), (when(T0 + 1), 47, 90, 103, "pcap", 1)]
    assert rows[0].packet_data == udp() and rows[0].filename == p


@pytest.mark.parametrize("order", "<>")
def test_blocks(spark, tmp_path, order):
    data = B.section(order) + B.interface(1, 0, 9, order) + B.interface(101, 20, 0x80 | 20, order) + B.block(99, b"unknown", order)
    data += B.enhanced(T0 * 1000 + 999, udp(), 0, 99, order) + B.enhanced(5 << 20, udp()[14:], 1, None, order) + B.simple(udp(), None, order)
    data += B.section("<") + B.interface(1, 10) + B.simple(udp()[:10], 47)
    rows = read_pcap(spark, save(tmp_path, "b.pcapng", data)).orderBy("packet_number").collect()
    assert [(r.timestamp, r.captured_length, r.original_length, r.link_type, r.interface_id, r.section_number) for r in rows] == [(when(T0), 47, 99, 1, 0, 1), (when(5_000_000), 33, 33, 101, 1, 1), (None, 47, 47, 1, 0, 1), (None, 10, 47, 1, 0, 2)]


def frames(data):
    c = Capture("x", data)
    n = sum(len(b["ts"]) for b in c.batches())
    return n, c.truncated


def test_truncation(tmp_path):
    whole = B.pcap([(T0, udp()), (T0, udp())])
    for cut, want in ((1, (1, True)), (47, (1, True)), (50, (1, True)), (63, (1, False))):
        assert frames(open_bytes(save(tmp_path, "t", whole[:-cut]))) == want
    ng = B.section() + B.interface() + B.enhanced(1, udp()) + B.enhanced(1, udp())
    for cut in (1, 4, 40, 79):
        assert frames(open_bytes(save(tmp_path, "t", ng[:-cut]))) == (1, True)
    bad = {
        "empty": b"", "magic": b"\xd4\xc3", "other": b"not a capture", "header": whole[:20], "first": whole[:60], "version": whole[:4] + b"\x03" + whole[5:], "huge": whole[:32] + b"\xff\xff\xff\x7f" + whole[36:],
        "trailer": ng[:-2] + b"\x09\x00", "length": B.section() + struct.pack("<II", 5, 13) + bytes(20), "interface": B.section() + B.enhanced(1, udp(), 3), "order": B.section()[:8] + b"abcd" + B.section()[12:], "simple": B.section() + B.simple(udp()),
    }
    for name, data in bad.items():
        with pytest.raises(CaptureError, match="byte cursor"):
            frames(open_bytes(save(tmp_path, name, data)))


def test_decoding_matrix(spark, tmp_path):
    tcp = B.tcp(1, 2, 0xFFFFFFFF, 7, 0x12, b"xyz", b"\x01" * 4)
    ok = B.ipv4("1.2.3.4", "5.6.7.8", 6, tcp, ident=9)
    frag6 = struct.pack(">BBHI", 17, 0, 8 << 3 | 1, 77)
    cases = {
        "tcp": B.ethernet(ok, 0x0800), "vlan": B.ethernet(ok, 0x0800, (5, 4095)), "eight": B.ethernet(ok, 0x0800, tuple(range(8))), "nine": B.ethernet(ok, 0x0800, tuple(range(9))), "short": b"\0" * 13, "tagcut": B.ethernet(b"\0\1", 0x8100),
        "arp": B.ethernet(b"\0" * 28, 0x0806), "icmp": B.packet("1.1.1.1", "2.2.2.2", 1, b"\x08" * 8), "badihl": B.ethernet(b"\x44" + ok[1:], 0x0800), "version": B.ethernet(b"\x65" + ok[1:], 0x0800), "total": B.ethernet(B.ipv4("1.1.1.1", "2.2.2.2", 6, tcp, total=10), 0x0800),
        "fragment": B.packet("1.1.1.1", "2.2.2.2", 17, B.udp(1, 2, b""), fragment=0x2000), "later": B.packet("1.1.1.1", "2.2.2.2", 17, b"abc", fragment=3), "udplong": B.packet("1.1.1.1", "2.2.2.2", 17, B.udp(1, 2, b"abc")[:-1]), "tcpoff": B.packet("1.1.1.1", "2.2.2.2", 6, tcp[:12] + b"\x40" + tcp[13:]),
        "cut": B.ethernet(ok, 0x0800)[:-2], "six": B.packet("2001:db8::1", "2001:db8::2", 6, tcp), "hop": B.ethernet(B.ipv6("::1", "::2", 0, b"\x11\0" + b"\0" * 6 + B.udp(8, 9, b"q")), 0x86DD), "frag6": B.ethernet(B.ipv6("::1", "::2", 44, frag6 + b"abcd"), 0x86DD),
        "twofrag": B.ethernet(B.ipv6("::1", "::2", 44, struct.pack(">BBHI", 44, 0, 0, 1) + struct.pack(">BBHI", 17, 0, 0, 2) + B.udp(1, 2, b"")), 0x86DD), "many": B.ethernet(B.ipv6("::1", "::2", 60, (b"\x3c\0" + b"\0" * 6) * 17), 0x86DD), "auth": B.ethernet(B.ipv6("::1", "::2", 51, b"\x11\x01" + b"\0" * 10 + B.udp(3, 4, b"")), 0x86DD),
    }
    p = save(tmp_path, "m.pcap", B.pcap([(T0 + i, f) for i, f in enumerate(cases.values())]))
    cols = ["packet_number", "decode_outcome", "ether_type", "vlan_ids", "ip_version", "src_ip", "ip_id", "ip_fragment_offset", "ip_more_fragments", "src_port", "tcp_flags", "tcp_seq", "tcp_header_length", "payload_length", "payload_declared_length", "udp_length", "src_mac", "tcp_syn", "tcp_fin"]
    rows = dict(zip(cases, read_packets(spark, p, cols).orderBy("packet_number").collect(), strict=True))
    outcome = {k: r.decode_outcome for k, r in rows.items()}
    assert [k for k, v in outcome.items() if v == "decoded"] == ["tcp", "vlan", "eight", "cut", "six", "hop", "auth"]
    assert [k for k, v in outcome.items() if v == "unsupported"] == ["nine", "arp", "icmp", "many"]
    assert [k for k, v in outcome.items() if v == "fragment"] == ["fragment", "later", "frag6"]
    t = rows["tcp"]
    assert (t.src_ip, t.ip_id, t.tcp_flags, t.tcp_seq, t.tcp_header_length, t.payload_length, t.src_mac, t.tcp_syn, t.tcp_fin, t.vlan_ids) == ("1.2.3.4", 9, 18, 0xFFFFFFFF, 24, 3, "02:00:00:00:00:01", True, False, [])
    assert rows["vlan"].vlan_ids == [5, 4095] and rows["nine"].vlan_ids is None and rows["nine"].ether_type is None and rows["short"].src_mac is None
    assert (rows["cut"].payload_length, rows["cut"].payload_declared_length) == (1, 3)
    assert rows["six"].src_ip == "2001:0db8:0000:0000:0000:0000:0000:0001" and rows["six"].ip_id is None
    assert (rows["frag6"].ip_fragment_offset, rows["frag6"].ip_more_fragments, rows["frag6"].ip_id, rows["frag6"].src_port) == (64, True, 77, None)
    assert (rows["icmp"].src_ip, rows["icmp"].src_port) == ("1.1.1.1", None) and rows["badihl"].src_ip is None and rows["badihl"].ether_type == 0x0800


def test_hostile_bytes_never_fail(spark, tmp_path):
    rng = random.Random(5)
    seeds = [udp(), B.packet("2001:db8::1", "::2", 6, B.tcp(1, 53, 1, 2, 24, b"\x16\x03\x01\x00\x05hello")), B.packet("1.1.1.1", "2.2.2.2", 17, B.udp(53, 53, B.dns_query(1, "a.b")))]
    recs = []
    for i in range(1500):
        f = bytearray(rng.choice(seeds))
        for _ in range(rng.randint(1, 6)):
            f[rng.randrange(len(f))] = rng.randrange(256)
        recs.append((T0 + i, bytes(f[: rng.randint(0, len(f))])))
    p = save(tmp_path, "h.pcap", B.pcap(recs))
    assert read_packets(spark, p).select(F.count("packet_number"), F.count("src_ip"), F.count("is_tls")).first()[0] == 1500
    read_dns(spark, p).collect()


def test_links(spark, tmp_path):
    ip = udp()[14:]
    cases = {101: ip, 228: ip, 113: b"\0" * 14 + b"\x08\0" + ip, 276: b"\x08\0" + b"\0" * 18 + ip, 999: ip, 229: B.ipv6("::1", "::2", 17, B.udp(1, 9000, b""))}
    for link, frame in cases.items():
        r = read_packets(spark, save(tmp_path, f"{link}", B.pcap([(T0, frame)], link)), ["dst_port", "src_mac"]).first()
        assert (r.dst_port, r.src_mac) == (None if link == 999 else 9000, None)


def test_conditions_and_files(spark, tmp_path):
    for d in ("2024-01-01", "2024-01-02"):
        for h in ("a", "b"):
            save(tmp_path, f"dt={d}/host={h}/x.pcap", B.pcap([(T0 + i, udp(i, 9000 + i)) for i in range(5)]))
    files = f"{tmp_path}/dt=*/host=*/*.pcap"
    df = read_packets(spark, files, hive_partitioning=True)
    assert df.count() == 20 and dict(df.dtypes)["dt"] == "date" and dict(df.dtypes)["host"] == "string"
    assert read_packets(spark, files, ["dst_port", "dt"], hive_partitioning=True, where=[("dt", "=", "2024-01-01"), ("dst_port", ">=", 9003)]).count() == 4
    assert read_packets(spark, files, ["dst_port", "dt"], hive_partitioning=True, where=[("host", "in", ["b"]), ("filename", "contains", "01-02")]).count() == 5
    twice = [f"{tmp_path}/dt=2024-01-01/host=a/x.pcap"] * 2
    assert read_packets(spark, twice, ["input_index"]).groupBy("input_index").count().count() == 2
    p = read_packets(spark, twice[0], ["src_port", "dst_port"])
    assert p.filter("dst_port = 9000").union(p.filter("dst_port = 9001")).count() == 2
    for bad in (dict(columns=["nope"]), dict(where=[("vlan_ids", "=", 1)]), dict(where=[("dst_port", "~", 1)]), dict(catalog_validation="x")):
        with pytest.raises(ValueError):
            read_packets(spark, twice[0], **bad)
    with pytest.raises(FileNotFoundError):
        expand(f"{tmp_path}/none*")
    save(tmp_path, "dt=2024-01-03/y.pcap", B.pcap([]))
    with pytest.raises(ValueError):
        read_packets(spark, [files, f"{tmp_path}/dt=2024-01-03/y.pcap"], hive_partitioning=True)


def test_inventory_and_catalog(spark, tmp_path):
    a = save(tmp_path, "a.pcap", B.pcap([(T0, udp()), (T0 + 10, B.packet("::1", "::2", 6, B.tcp(1, 2, 3, 4, 2))), (T0 + 5, b"\0")]))
    b = save(tmp_path, "b.pcap", B.pcap([(T0 + 1000, udp())])[:-3] + b"")
    c = save(tmp_path, "c.pcap", B.pcap([(T0 + 2000, udp()), (T0 + 2000, udp())])[:-3])
    with pytest.raises(Exception, match="byte cursor"):
        capture_inventory(spark, [a, b]).collect()
    inv = capture_inventory(spark, [a, b, c], "protocols", "report")
    rows = {os.path.basename(r.filename): r for r in inv.collect()}
    r = rows["a.pcap"]
    assert (r.packet_count, r.ipv4_packets, r.ipv6_packets, r.tcp_packets, r.udp_packets, r.malformed_packets, r.min_timestamp, r.max_timestamp, r.scan_status) == (3, 1, 1, 1, 1, 1, when(T0), when(T0 + 10), "complete")
    assert r.tcp_packets + r.udp_packets + r.malformed_packets + r.unsupported_packets + r.fragment_packets == r.packet_count
    assert rows["b.pcap"].scan_status == "error" and rows["b.pcap"].packet_count is None and rows["c.pcap"].scan_status == "truncated" and rows["c.pcap"].packet_count == 1
    inv.write.parquet(f"{tmp_path}/cat")
    old = spark.read.parquet(f"{tmp_path}/cat")
    again = {os.path.basename(r.filename): r for r in capture_inventory(spark, [a, c], previous_catalog=old, catalog_validation="immutable").collect()}
    assert (again["a.pcap"].reused, again["a.pcap"].reuse_reason, again["a.pcap"].packet_count, again["a.pcap"].ipv4_packets) == (True, "immutable_metadata_match", 3, None)
    assert again["c.pcap"].reuse_reason == "incompatible_summary" and again["c.pcap"].reused is False
    assert {r.reuse_reason for r in capture_inventory(spark, [a], previous_catalog=old).collect()} == {"strict_requires_scan"}
    late = [("timestamp", ">", str(when(T0 + 1500)))]
    pruned = read_pcap(spark, [a, c], ["timestamp"], catalog=f"{tmp_path}/cat", catalog_validation="immutable", where=late)
    assert pruned.count() == 1 and read_pcap(spark, [a, c], ["timestamp"], where=late).count() == 1
    os.utime(a, ns=(1, 1))
    assert read_pcap(spark, [a], ["timestamp"], catalog=f"{tmp_path}/cat", catalog_validation="immutable", where=late).count() == 0
    assert {r.reuse_reason for r in capture_inventory(spark, [a], previous_catalog=old, catalog_validation="immutable").collect()} == {"identity_changed_or_unavailable"}


def test_export(spark, tmp_path):
    p = save(tmp_path, "a.pcap", B.pcap([(T0 + (i * 37) % 100, udp(i)) for i in range(100)]))
    cols = ["timestamp", "captured_length", "original_length", "link_type", "packet_data"]
    df = read_pcap(spark, p, cols)
    out = f"{tmp_path}/out.pcap"
    assert write_pcap(df.repartition(5).orderBy("timestamp"), out) == 100
    back = read_pcap(spark, out).orderBy("packet_number").collect()
    assert [r.timestamp for r in back] == sorted(r.timestamp for r in back) and open(out, "rb").read()[16:20] == struct.pack("<I", 47)
    assert read_pcap(spark, out, cols).exceptAll(df).count() == 0
    before = open(out, "rb").read()
    null = F.lit(None)
    for bad in (df.withColumn("timestamp", null.cast("timestamp_ntz")), df.withColumn("link_type", F.lit(5).cast("long")), df.withColumn("original_length", F.lit(1).cast("long")), df.withColumn("captured_length", F.lit(1).cast("long")), df.withColumn("timestamp", F.lit("1960-01-01").cast("timestamp_ntz"))):
        with pytest.raises(Exception, match="PCAP export"):
            write_pcap(bad, out)
    with pytest.raises(Exception, match="SNAPLEN"):
        write_pcap(df, out, snaplen=10)
    for bad in (dict(use_tmp_file=False), dict(other=True), dict(snaplen=0), dict(link_type=-1)):
        with pytest.raises(ValueError):
            write_pcap(df, out, **bad)
    with pytest.raises(ValueError):
        write_pcap(df.drop("link_type"), out)
    assert open(out, "rb").read() == before and sorted(os.listdir(tmp_path)) == ["a.pcap", "out.pcap"]
    assert write_pcap(df.limit(0), out) == 0 and read_pcap(spark, out).count() == 0
    assert sum(r.packets for r in write_pcap_parts(df.repartition(3), f"{tmp_path}/parts").collect()) == 100
    assert read_pcap(spark, f"{tmp_path}/parts/*.pcap").count() == 100


def test_dns_messages_decoded():
    name = b"\x03www\x07example\x03com\0"
    a = b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([1, 2, 3, 4])
    cname = b"\xc0\x0c" + struct.pack(">HHIH", 5, 1, 60, 4) + b"\x01a\xc0\x10"
    v6 = b"\xc0\x0c" + struct.pack(">HHIH", 28, 1, 60, 16) + bytes(15) + b"\1"
    txt = b"\xc0\x0c" + struct.pack(">HHIH", 16, 1, 60, 2) + b"\1x"
    head = struct.pack(">6H", 7, 0x8183, 1, 4, 0, 0)
    good = head + name + struct.pack(">HH", 1, 1) + a + cname + v6 + txt
    m = dns.decode(good)
    assert m["dns_valid"] and (m["dns_id"], m["dns_response"], m["dns_rcode"], m["dns_question_name"]) == (7, True, 3, "www.example.com")
    assert [r["value"] for r in m["dns_answers"]] == ["1.2.3.4", "a.example.com", "0000:0000:0000:0000:0000:0000:0000:0001", None] and m["dns_answers"][3]["data"] == b"\1x"
    root = dns.decode(struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\0" + struct.pack(">HH", 2, 1))
    assert root["dns_question_name"] == "."
    odd = dns.decode(struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\x04a.\\\xff\0" + struct.pack(">HH", 2, 1))
    assert odd["dns_question_name"] == "a\\046\\092\\255"
    for bad in (b"", good[:-1], good + b"\0", head + b"\xc0\x0c" + struct.pack(">HH", 1, 1), head + b"\x40" + b"a" * 64 + b"\0" + struct.pack(">HH", 1, 1), head + (b"\x3f" + b"a" * 63) * 4 + b"\0" + struct.pack(">HH", 1, 1)):
        assert dns.decode(bad)["dns_error"] == dns.BAD and dns.decode(bad)["dns_valid"] is False
    assert "limit" in dns.decode(struct.pack(">6H", 1, 0, 4096, 1, 0, 0))["dns_error"]
    rng = random.Random(2)
    for _ in range(3000):
        x = bytearray(good)
        for _ in range(rng.randint(1, 5)):
            x[rng.randrange(len(x))] = rng.randrange(256)
        dns.decode(bytes(x[: rng.randint(0, len(x))]))
