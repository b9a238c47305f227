from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netloom.functions.names import SuffixRules
from netloom.operators.analytics import analyze_beacons, analyze_dns_tunnels, analyze_long_connections, bucket_start, connection_facts, dns_facts, summarize_talkers
from netloom.operators.flows import read_flows
from netloom.operators.streams import NEEDED, read_dns_messages
from netloom.sources import build as B
from netloom.sources.captures import read_packets

T0 = 1_700_000_000_000_000
FLOW = ["captured_length", "original_length", "ip_fragment_offset", "ip_more_fragments", "tcp_ack", *NEEDED]


def read(spark, tmp_path, frames):
    p = f"{tmp_path}/x.pcap"
    with open(p, "wb") as f:
        f.write(B.pcap(sorted(frames)))
    return read_packets(spark, p, FLOW)


def udp(i, src, dst, port, size=10, at=0):
    return T0 + at, B.packet(src, dst, 17, B.udp(1000 + i, port, b"x" * size))


def test_beacons_over_captures(spark, tmp_path):
    frames = [udp(i, "10.0.0.1", "192.0.2.1", 54, at=i * 300_000_000) for i in range(8)] + [udp(i, "10.0.0.2", "192.0.2.1", 55, 10 * i * i, at=(i * i * 7 % 23) * 100_000_000) for i in range(8)]
    facts = connection_facts(read_flows(read(spark, tmp_path, frames)), ["10.0.0.0/8"])
    a, b = analyze_beacons(facts).orderBy("rank").collect()
    assert (a.local_ip, a.remote_port, a.connection_count, a.median_interval_ms, a.interval_mad_ms, a.timing_score, a.size_score, a.direction) == ("10.0.0.1", 54, 8, 300_000.0, 0.0, 100.0, 100.0, "outbound")
    assert a.score == pytest.approx(0.5 * 100 + 0.2 * 100 + 0.15 * (50 + 50 * 2 / 6) + 0.15 * 100) and len(a.evidence) == 8 and a.evidence[0].payload_bytes == 10
    assert "connection starts have low interval dispersion" in a.reasons and b.score < a.score
    assert analyze_beacons(facts, min_score=90).count() == 1 and analyze_beacons(facts, max_results=1, evidence_rows=2).first().evidence_truncated
    day = analyze_beacons(facts, window=timedelta(days=7), min_connections=2).orderBy("rank").first()
    assert day.window_start.weekday() == 0 and day.window_end - day.window_start == timedelta(days=7)
    assert analyze_beacons(facts.limit(0)).collect() == []
    for bad in (dict(scope="all"), dict(group_by="host"), dict(min_connections=1), dict(min_score=101), dict(max_results=0), dict(evidence_rows=1025), dict(profile="x"), dict(window=timedelta(0)), dict(min_span=-1)):
        with pytest.raises(ValueError):
            analyze_beacons(facts, **bad)


def test_talkers_and_long(spark, tmp_path):
    frames = [(T0 + i, f) for i, f in enumerate(B.conversation("10.0.0.1", "192.0.2.1", 1, 80, b"a" * 10, b"b" * 90))] + [udp(1, "10.0.0.1", "10.0.0.2", 53, 7, 20), udp(1, "192.0.2.9", "10.0.0.2", 53, 5, 30), udp(1, "192.0.2.9", "10.0.0.2", 53, 5, 59_000_000)]
    facts = connection_facts(read_flows(read(spark, tmp_path, frames), udp_idle_timeout=timedelta(hours=1)), ["10.0.0.0/8"])
    t = {r.endpoint_ip: r for r in summarize_talkers(facts).collect()}
    assert (t["10.0.0.1"].total_payload_bytes, t["10.0.0.1"].sent_payload_bytes, t["10.0.0.1"].peer_count, t["10.0.0.1"].direction, t["10.0.0.1"].rank) == (107, 17, 2, "mixed", 1)
    assert {(r.endpoint_ip, r.port) for r in summarize_talkers(facts, by="service", scope="inbound").collect()} == {("10.0.0.2", 53)}
    long = analyze_long_connections(facts, min_duration=timedelta(seconds=10)).collect()
    assert len(long) == 1 and long[0].duration_score == pytest.approx(100.0, abs=40) and long[0].completeness_score == 25.0 and long[0].reasons[-1] == "session completeness is limited"
    assert analyze_long_connections(facts, min_duration=10_000_000, include_partial=False).count() == 0
    assert summarize_talkers(facts.limit(0)).collect() == []
    for f, bad in ((summarize_talkers, dict(by="x")), (summarize_talkers, dict(metric="x")), (summarize_talkers, dict(scope="x")), (summarize_talkers, dict(max_results=0)), (analyze_long_connections, dict(min_duration=-1)), (analyze_long_connections, dict(profile="x"))):
        with pytest.raises(ValueError):
            f(facts, **bad)


def test_membership_is_three_valued(spark, tmp_path):
    flows = read_flows(read(spark, tmp_path, [udp(0, "10.0.0.1", "192.0.2.1", 5)]))
    assert connection_facts(flows, None).first().direction == "unknown"
    assert connection_facts(flows, ["192.0.2.0/24"]).first().direction == "inbound"
    assert connection_facts(flows, ["0.0.0.0/0"]).first().direction == "internal" and connection_facts(flows, []).first().direction == "external"


def test_tunnels_over_captures(spark, tmp_path):
    frames = []
    for i in range(24):
        name = f"{i * 7919 % 65536:04x}" * 8 + ".example.com"
        frames += [(T0 + i * 5_000_000, B.packet("192.0.2.10", "198.51.100.53", 17, B.udp(4000, 53, B.dns_query(i, name)))), (T0 + i * 5_000_000 + 1, B.packet("198.51.100.53", "192.0.2.10", 17, B.udp(53, 4000, B.dns_query(i, name, flags=0x8183))))]
        if i < 20:
            frames.append((T0 + i * 5_000_000 + 2, B.packet("192.0.2.11", "198.51.100.53", 17, B.udp(4000, 53, B.dns_query(i, "www.example.net")))))
    facts = dns_facts(read_dns_messages(read(spark, tmp_path, frames)), SuffixRules.parse(["com", "net"]))
    a, b = analyze_dns_tunnels(facts).orderBy("rank").collect()
    assert (a.client_ip, a.grouping_domain, a.query_count, a.response_count, a.distinct_name_count, a.nxdomain_ratio, a.median_left_payload_length, a.encoded_score) == ("192.0.2.10", "example.com", 24, 24, 24, 1.0, 32.0, 100.0)
    assert b.grouping_domain == "example.net" and b.score < a.score and "responses_not_observed" in b.quality_flags and "cleartext_dns_only" in a.quality_flags
    assert [tuple(x) for x in a.question_types] == [(1, 24)] and len(a.evidence) == 8
    assert analyze_dns_tunnels(facts.limit(0)).collect() == []
    for bad in (dict(min_queries=1), dict(window=-5), dict(min_score=-1), dict(profile="x"), dict(evidence_rows=-1)):
        with pytest.raises(ValueError):
            analyze_dns_tunnels(facts, **bad)


def test_buckets(spark):
    rows = [datetime(2024, 1, 1), datetime(2024, 1, 7, 23, 59, 59, 999999), datetime(1999, 12, 31), None]
    got = [r.b for r in spark.createDataFrame([(t,) for t in rows], "t timestamp_ntz").select(bucket_start(F.col("t"), 7 * 86_400_000_000).alias("b")).collect()]
    assert got == [datetime(2024, 1, 1), datetime(2024, 1, 1), datetime(1999, 12, 27), None]
