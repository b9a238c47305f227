"""Queries of the capture readers: rows of test tables become packets in capture files, which are read and decoded again.

What comes back is compared with SQL over the tables, so that any fault of writer, framing, decoder, sessionizer or
reassembler shows as a difference.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.operators.flows import FLOW_COLUMNS, read_flows
from netloom.operators.handshakes import read_tls
from netloom.operators.inventory import capture_inventory
from netloom.operators.ordered import CLOCK
from netloom.operators.streams import NEEDED, TCP_CLOCK, read_dns_messages, read_tcp_streams
from netloom.session import load, local_path, scratch
from netloom.sources import build as B
from netloom.sources.captures import read_dns, read_packets, read_pcap
from netloom.sources.export import encode, header, write_pcap

_PACKET = "timestamp timestamp_ntz, captured_length long, original_length long, link_type long, packet_data binary"
START_US = 1_700_000_000_000_000
SEGMENT, MISSING = 100, 3


def _packets(rows: DataFrame, make) -> DataFrame:
    """Packet rows from rows: ``make(row)`` gives (microseconds, frame) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [x for r in b.to_pylist() for x in make(r)]
            size = pa.array([len(f) for _, f in made], pa.int64())
            yield pa.record_batch([pa.array([t for t, _ in made], pa.int64()).cast(pa.timestamp("us")), size, size, pa.array([1] * len(made), pa.int64()), pa.array([f for _, f in made], pa.binary())], names=[c.split()[0] for c in _PACKET.split(", ")])

    return rows.mapInArrow(run, _PACKET)


def _file(spark: SparkSession, packets: DataFrame, name: str) -> str:
    folder = local_path(scratch(spark, name))
    os.makedirs(folder)
    write_pcap(packets, f"{folder}/{name}.pcap")
    return f"{folder}/{name}.pcap"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows in order of time; each will be a datagram of its user to a port of its type."""
    kinds = F.dense_rank().over(Window.orderBy("event_type"))
    e = load(spark, sf, "events").filter("ts is not null and user_id is not null and event_type is not null")
    types = e.select("event_type").distinct().withColumn("port", 8000 + kinds)
    return e.join(F.broadcast(types), "event_type").select("event_id", "ts", "user_id", "port").orderBy("ts", "event_id")


def _datagram(r: dict):
    import datetime

    us = (r["ts"] - datetime.datetime(1970, 1, 1)) // timedelta(microseconds=1)
    u = r["user_id"]
    yield us, B.packet(f"10.{u >> 16 & 255}.{u >> 8 & 255}.{u & 255}", "192.0.2.1", 17, B.udp(40000, r["port"], str(r["event_id"]).encode()))


def _event_file(spark: SparkSession, sf: str) -> str:
    return _file(spark, _packets(_events(spark, sf), _datagram), "events")


def pcap_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records in the order of the export."""
    return read_pcap(spark, _event_file(spark, sf), ["packet_number", "timestamp", "captured_length", "original_length", "link_type", "capture_format"])


def packet_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded header fields of all packets, with a condition tested inside the reader."""
    return read_packets(spark, _event_file(spark, sf), ["packet_number", "timestamp", "src_ip", "dst_port", "payload_length", "udp_length"], where=[("dst_port", ">", 8001)])


def pushdown_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by which a filtered read and a filter over a full read differ, both ways: none."""
    path, cols = _event_file(spark, sf), ["packet_number", "timestamp", "src_ip", "dst_port", "ip_ttl", "is_tls"]
    inside = read_packets(spark, path, cols, where=[("dst_port", "in", [8001, 8003]), ("src_ip", "starts with", "10.0.0.1"), ("timestamp", ">=", "2024-01-05 00:00:00")])
    after = read_packets(spark, path, cols).filter("dst_port in (8001, 8003) and src_ip like '10.0.0.1%' and timestamp >= timestamp_ntz'2024-01-05 00:00:00'")
    return inside.exceptAll(after).unionByName(after.exceptAll(inside)).agg(F.count(F.lit(1)).alias("differences"))


def flow_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """UDP sessions of the events, with counters and how they ended."""
    p = read_packets(spark, _event_file(spark, sf), [*FLOW_COLUMNS, *CLOCK])
    f = read_flows(p, udp_idle_timeout=timedelta(hours=6))
    return f.select("orig_ip", "resp_port", "first_timestamp", "last_timestamp", "duration_us", "orig_packets", "resp_packets", "orig_captured_bytes", "orig_payload_bytes", "late_packets", "finalized_by", "flow_id")


def flows_of_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the decoded packets of the test table; a repeated packet counts once."""
    p = load(spark, sf, "read_packets").dropDuplicates(["filename", "packet_number"])
    return read_flows(p)


def _pieces(r: dict) -> list[bytes]:
    raw = r["text"].encode()
    return [raw[i : i + SEGMENT] for i in range(0, len(raw), SEGMENT)]


def _shuffled(r: dict):
    """A document as a TCP stream: segments out of order, every fifth one sent twice."""
    d, parts = r["doc_id"], _pieces(r)
    src = f"10.{d >> 16 & 255}.{d >> 8 & 255}.{d & 255}"
    seq = [0xFFFFFF00 + 1 + SEGMENT * i for i in range(len(parts))]  # sequence numbers wrap
    order = sorted(range(len(parts)), key=lambda i: (i * 7919 + d) % 104_729)
    order += order[::5]
    frames = [B.tcp(40000, 80, 0xFFFFFF00, 0, 2), *[B.tcp(40000, 80, seq[i], 0, 24, parts[i]) for i in order], B.tcp(40000, 80, 0xFFFFFF01 + len(r["text"].encode()), 0, 17)]
    for i, f in enumerate(frames):
        yield START_US + i * 1000, B.packet(src, "192.0.2.1", 6, f)


def _lossy(r: dict):
    """A document as a TCP stream of which every third segment is missing."""
    d, parts = r["doc_id"], _pieces(r)
    src = f"10.{d >> 16 & 255}.{d >> 8 & 255}.{d & 255}"
    frames = [B.tcp(40000, 80, 99, 0, 2), *[B.tcp(40000, 80, 100 + SEGMENT * i, 0, 24, p) for i, p in enumerate(parts) if i % MISSING != MISSING - 1], B.tcp(40000, 80, 100 + len(r["text"].encode()), 0, 17)]
    for i, f in enumerate(frames):
        yield START_US + i * 1000, B.packet(src, "192.0.2.1", 6, f)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").filter("text <> '' and doc_id is not null").select("doc_id", "text")


def _doc_id() -> Column:
    p = F.split("src_ip", r"\.")
    return p[1].cast("long") * 65536 + p[2].cast("long") * 256 + p[3].cast("long")


def tcp_stream_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents put together again from shuffled and repeated segments."""
    p = read_packets(spark, _file(spark, _packets(_documents(spark, sf), _shuffled), "streams"), [*NEEDED, *TCP_CLOCK])
    return read_tcp_streams(p).select(_doc_id().alias("doc_id"), F.sha2("stream_data", 256).alias("digest"), "expected_bytes", "captured_bytes", "reassembly_status", "finalized_by", "has_gaps")


def tcp_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of documents whose every third segment is missing."""
    p = read_packets(spark, _file(spark, _packets(_documents(spark, sf), _lossy), "gaps"), NEEDED)
    return read_tcp_streams(p).select(_doc_id().alias("doc_id"), "expected_bytes", "captured_bytes", F.size("chunks").alias("n_chunks"), F.size("gaps").alias("n_gaps"), "reassembly_status")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "read_dns_messages").filter("dns_question_name is not null").select("dns_question_name").distinct()
    return n.withColumn("k", F.xxhash64("dns_question_name"))  # each name gets a client address of its own


def _asked(r: dict):
    """A name asked by UDP and, in two segments, by TCP."""
    k = r["k"] & (1 << 64) - 1
    src = "fd00:" + ":".join(f"{k >> s & 0xFFFF:x}" for s in (48, 32, 16, 0)) + ":0:0:1"
    q = B.dns_query(k & 0xFFFF, r["dns_question_name"])
    at = START_US + k % 1_000_000
    yield at, B.packet(src, "fd00::53", 17, B.udp(50000, 53, q))
    whole = len(q).to_bytes(2, "big") + q
    for i, f in enumerate((B.tcp(50001, 53, 99, 0, 2), B.tcp(50001, 53, 109, 0, 24, whole[9:]), B.tcp(50001, 53, 100, 0, 24, whole[:9]))):
        yield at + i, B.packet(src, "fd00::53", 6, f)


def dns_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Names that come back from UDP datagrams and TCP streams."""
    p = read_packets(spark, _file(spark, _packets(_names(spark, sf), _asked), "dns"), [*NEEDED, *TCP_CLOCK])
    return read_dns_messages(p).select("transport", "dns_question_name", "dns_valid", "message_number", "reassembly_status")


def dns_packets(spark: SparkSession, sf: str) -> DataFrame:
    """The packet-level view of the same: one datagram or two segments, of which none holds a whole message."""
    d = read_dns(spark, _file(spark, _packets(_names(spark, sf), _asked), "dns"), ["ip_protocol", "dns_valid", "dns_question_name"])
    return d.groupBy("ip_protocol", "dns_valid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dns_question_name").alias("n_names"))


def _hello(r: dict):
    d = r["doc_id"]
    ch = B.tls_record(B.client_hello(f"d{d}.example", [0x0A0A, 4865 + d % 3, 49195], [0x1A1A, 29, 23 + d % 2], [1027, 2052], [0x3A3A, 772, 771], ["h2"]))
    frames = B.conversation(f"10.{d >> 16 & 255}.{d >> 8 & 255}.{d & 255}", "192.0.2.7", 50000, 443, ch, B.tls_record(B.server_hello(4865 + d % 3, 772)), mss=60)
    for i, f in enumerate(frames):
        yield START_US + i * 1000, f


def tls_ja3(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints, names and versions of handshakes that are cut into small segments."""
    docs = load(spark, sf, "documents").filter("doc_id is not null").select("doc_id")
    p = read_packets(spark, _file(spark, _packets(docs, _hello), "tls"), [*NEEDED, *TCP_CLOCK])
    return read_tls(p).select("tls_sni", "ja3", "ja3_full", "ja3s_full", "ja4_r", "negotiated_version", "cipher_suite", "reassembly_status", F.size("warnings").alias("n_warnings"))


def _day_files(folder: str):
    """Writes rows that are sorted by ``dt`` into one capture per day, each put in place when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, out = None, None

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, f"{folder}/dt={day}/day.pcap")

        for b in batches:
            days = b.column("dt").to_pylist()
            cuts = [i for i, d in enumerate(days) if i == 0 or d != days[i - 1]]
            for i, j in zip(cuts, [*cuts[1:], len(days)], strict=True):
                if days[i] != day:
                    close()
                    day = days[i]
                    os.makedirs(f"{folder}/dt={day}", exist_ok=True)
                    out = open(f"{folder}/dt={day}/{uuid.uuid4().hex}.part", "wb")
                    out.write(header(1, 65_535))
                out.write(encode(b.slice(i, j - i), 1, None)[0])
        close()
        yield pa.record_batch({"n": pa.array([0], pa.int32())})

    return run


def _daily(spark: SparkSession, sf: str) -> str:
    """A capture per day of events in folders dt=..., written side by side."""
    folder = local_path(scratch(spark, "daily"))
    packets = _packets(_events(spark, sf), _datagram).withColumn("dt", F.date_format("timestamp", "yyyy-MM-dd"))
    packets.repartition("dt").sortWithinPartitions("dt", "timestamp").mapInArrow(_day_files(folder), "n int").write.format("noop").mode("overwrite").save()
    return folder


def inventory_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of the daily captures."""
    inv = capture_inventory(spark, f"{_daily(spark, sf)}/dt=*/*.pcap", "protocols")
    return inv.select(F.regexp_extract("filename", "dt=([0-9-]+)", 1).alias("dt"), "packet_count", "captured_bytes", "reported_bytes", "min_timestamp", "max_timestamp", "timestamp_null_count", "ipv4_packets", "udp_packets", "tcp_packets", "scan_status", "capture_format")


def hive_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Packets per day folder, of which a condition opens only some."""
    p = read_packets(spark, f"{_daily(spark, sf)}/dt=*/*.pcap", ["dt", "dst_port"], hive_partitioning=True, where=[("dt", ">=", "2024-01-10"), ("dt", "<", "2024-01-13")])
    return p.groupBy(F.col("dt").cast("string").alias("dt"), "dst_port").agg(F.count(F.lit(1)).alias("n"))


def catalog_pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Packets of a time range from captures that a stored inventory doesn't exclude."""
    files, at = f"{_daily(spark, sf)}/dt=*/*.pcap", scratch(spark, "catalog")
    capture_inventory(spark, files).write.parquet(at)
    p = read_pcap(spark, files, ["timestamp"], catalog=local_path(at), catalog_validation="immutable", where=[("timestamp", ">=", "2024-01-20 12:00:00"), ("timestamp", "<", "2024-01-21 12:00:00")])
    return p.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))


QUERIES = {
    f.__name__: f
    for f in (pcap_roundtrip, packet_fields, pushdown_parity, flow_sessions, flows_of_packets, tcp_stream_bytes, tcp_gaps, dns_messages, dns_packets, tls_ja3, inventory_totals, hive_partitions, catalog_pruned_scan)
}

_E = "with e as (select event_id, ts, user_id, 8000 + dense_rank() over (order by event_type) as port, row_number() over (order by ts, event_id) as pn, length(cast(event_id as varchar)) as size from events where ts is not null and user_id is not null and event_type is not null)"
_IP = "'10.' || ((user_id >> 16) & 255) || '.' || ((user_id >> 8) & 255) || '.' || (user_id & 255)"
_GAP = 6 * 3600 * 1_000_000
_PARTS = f"cast(ceil(octet_length(encode(text)) / {SEGMENT}.0) as bigint)"

ORACLE = {
    "pcap_roundtrip": f"{_E} select pn as packet_number, ts as \"timestamp\", 42 + size as captured_length, 42 + size as original_length, cast(1 as bigint) as link_type, 'pcap' as capture_format from e",
    "packet_fields": f"{_E} select pn as packet_number, ts as \"timestamp\", {_IP} as src_ip, port as dst_port, size as payload_length, size + 8 as udp_length from e where port > 8001",
    "pushdown_parity": "select 0 as differences",
    "flow_sessions": f"""{_E}, l as (select *, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id, port order by pn)) as pause from e),
      s as (select *, sum(case when pause is null or pause > {_GAP} then 1 else 0 end) over (partition by user_id, port order by pn) as k from l),
      g as (select user_id, port, k, min(ts) as a, max(ts) as b, min(pn) as p0, max(pn) as p1, count(*) as n, cast(sum(42 + size) as bigint) as bytes, cast(sum(size) as bigint) as payload, row_number() over (partition by user_id, port order by k desc) as back from s group by user_id, port, k)
      select {_IP} as orig_ip, port as resp_port, a as first_timestamp, b as last_timestamp, epoch_us(b) - epoch_us(a) as duration_us, n as orig_packets, cast(0 as bigint) as resp_packets, bytes as orig_captured_bytes, payload as orig_payload_bytes, cast(0 as bigint) as late_packets,
        case when back > 1 or epoch_us(b) + {_GAP} < (select max(epoch_us(ts)) from e) then 'idle_timeout' else 'eof' end as finalized_by, p0 as flow_id from g""",
    "tcp_stream_bytes": "select doc_id, sha256(text) as digest, octet_length(encode(text)) as expected_bytes, octet_length(encode(text)) as captured_bytes, 'contiguous' as reassembly_status, 'eof' as finalized_by, false as has_gaps from documents where text <> '' and doc_id is not null",
    "tcp_gaps": f"""with d as (select doc_id, octet_length(encode(text)) as n, {_PARTS} as parts from documents where text <> '' and doc_id is not null), g as (select *, parts // {MISSING} as lost, case when parts % {MISSING} = 0 then n - (parts - 1) * {SEGMENT} else {SEGMENT} end as tail from d)
      select doc_id, n as expected_bytes, n - greatest(0, lost - 1) * {SEGMENT} - case when lost > 0 then tail else 0 end as captured_bytes, lost + case when parts % {MISSING} = 0 then 0 else 1 end as n_chunks, lost as n_gaps, case when lost > 0 then 'gapped' else 'contiguous' end as reassembly_status from g""",
    "dns_messages": "with n as (select distinct dns_question_name as q from read_dns_messages where dns_question_name is not null) select t as transport, case when q = '.' then '.' else regexp_replace(q, '\\.$', '') end as dns_question_name, true as dns_valid, cast(1 as bigint) as message_number, 'complete' as reassembly_status from n, (values ('udp'), ('tcp')) as v(t)",
    "dns_packets": "with n as (select distinct dns_question_name as q from read_dns_messages where dns_question_name is not null), m as (select count(*) as c, count(distinct regexp_replace(q, '\\.$', '')) as d from n) select cast(17 as smallint) as ip_protocol, true as dns_valid, c as n, d as n_names from m union all select cast(6 as smallint), false, 2 * c, cast(0 as bigint) from m",
    "tls_ja3": """with h as (select doc_id, 4865 + doc_id % 3 as s, 23 + doc_id % 2 as g from documents where doc_id is not null), j as (select *, '771,' || s || '-49195,0-10-11-13-16-43,29-' || g || ',0' as t from h)
      select 'd' || doc_id || '.example' as tls_sni, md5(t) as ja3, t as ja3_full, '771,' || s || ',43' as ja3s_full, 't13d0206h2_' || lpad(lower(to_hex(s)), 4, '0') || ',c02b_000a,000b,000d,002b_0403,0804' as ja4_r, 772 as negotiated_version, cast(s as int) as cipher_suite, 'complete' as reassembly_status, 0 as n_warnings from j""",
    "inventory_totals": f"{_E} select strftime(ts, '%Y-%m-%d') as dt, count(*) as packet_count, cast(sum(42 + size) as bigint) as captured_bytes, cast(sum(42 + size) as bigint) as reported_bytes, min(ts) as min_timestamp, max(ts) as max_timestamp, cast(0 as bigint) as timestamp_null_count, count(*) as ipv4_packets, count(*) as udp_packets, cast(0 as bigint) as tcp_packets, 'complete' as scan_status, 'pcap' as capture_format from e group by 1",
    "hive_partitions": f"{_E} select strftime(ts, '%Y-%m-%d') as dt, port as dst_port, count(*) as n from e where strftime(ts, '%Y-%m-%d') >= '2024-01-10' and strftime(ts, '%Y-%m-%d') < '2024-01-13' group by 1, 2",
    "catalog_pruned_scan": f"{_E} select count(*) as n, min(ts) as first_time, max(ts) as last_time from e where ts >= timestamp '2024-01-20 12:00:00' and ts < timestamp '2024-01-21 12:00:00'",
}
