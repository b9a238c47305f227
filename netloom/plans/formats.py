"""Round trips of capture formats, link layers, TCP endings, DNS records, export rules, reuse of summaries and streams.

As in ``roundtrips``, rows of the test tables become packets, are written, read back and compared with SQL over the tables.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.operators.flows import FLOW_COLUMNS, read_flows
from netloom.operators.inventory import capture_inventory
from netloom.operators.ordered import CLOCK
from netloom.operators.streams import NEEDED, TCP_CLOCK, read_tcp_streams
from netloom.plans.roundtrips import _E, START_US, _datagram, _events, _file, _names, _packets
from netloom.session import load, local_path, scratch
from netloom.sources import build as B
from netloom.sources.captures import read_dns, read_packets, read_pcap
from netloom.sources.export import header, write_pcap
from netloom.streaming.captures import session_traffic, stream_packets, windowed_traffic

_EPOCH = datetime(1970, 1, 1)


def _write_blobs(folder: str, suffix: str, make):
    """Writes rows sorted by ``part`` into one file a part, bytes by ``make(row)``, each put in place when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = None, None

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, f"{folder}/{part}{suffix}")

        for b in batches:
            for r in b.to_pylist():
                if r["part"] != part:
                    close()
                    part = r["part"]
                    out = open(f"{folder}/{uuid.uuid4().hex}.part", "wb")
                out.write(make(r))
        close()
        yield pa.record_batch({"n": pa.array([0], pa.int32())})

    return run


def _blob_files(spark: SparkSession, rows: DataFrame, make, name: str, suffix: str) -> str:
    """A file of each ``part`` of ``rows``, in order of ``n``; the folder is given back."""
    folder = local_path(scratch(spark, name))
    os.makedirs(folder)
    rows.repartition("part").sortWithinPartitions("part", "n").mapInArrow(_write_blobs(folder, suffix, make), "n int").write.format("noop").mode("overwrite").save()
    return folder


def _us(t: datetime) -> int:
    return (t - _EPOCH) // timedelta(microseconds=1)


def _frame(r: dict) -> bytes:
    ((_, frame),) = _datagram(r)
    return frame


def _record(r: dict, link: int = 1, frame: bytes | None = None) -> bytes:
    """A record of a classic capture, before the first one the file's header."""
    us, frame = _us(r["ts"]), frame or _frame(r)
    return (header(link, 65_535) if r["n"] == 1 else b"") + struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(frame), len(frame)) + frame


# --- PCAPNG ----------------------------------------------------------------------------------------------------------------
IN_SECTION = 50


def _blocks(r: dict) -> bytes:
    """The blocks of an event: sections of both byte orders begin every so often; enhanced and simple packets, interfaces in
    micro- and nanoseconds, blocks of no known kind, and a block cut short at the end of a file."""
    order = "<" if (r["n"] - 1) // IN_SECTION % 2 == 0 else ">"
    out = B.section(order) + B.interface(1, 0, None, order) + B.interface(1, 0, 9, order) if (r["n"] - 1) % IN_SECTION == 0 else b""
    kind, us, frame = r["event_id"] % 4, _us(r["ts"]), _frame(r)
    if kind == 3:
        out += B.block(0x0BAD, str(r["event_id"]).encode(), order)
    if kind == 2:
        out += B.simple(frame, None, order)
    else:
        out += B.enhanced(us * 1000, frame, 1, len(frame) + 7, order) if kind == 1 else B.enhanced(us, frame, 0, None, order)
    return out + (B.enhanced(us, frame, 0, None, order)[:10] if r["n"] == r["of"] else b"")


def _days(spark: SparkSession, sf: str) -> DataFrame:
    day = Window.partitionBy("part")
    e = _events(spark, sf).withColumn("part", F.date_format("ts", "yyyy-MM-dd"))
    return e.withColumn("n", F.row_number().over(day.orderBy("ts", "event_id"))).withColumn("of", F.count(F.lit(1)).over(day))


def pcapng_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Records of block captures, one a day: sections, interfaces, places in the file."""
    folder = _blob_files(spark, _days(spark, sf), _blocks, "blocks", ".pcapng")
    p = read_pcap(spark, f"{folder}/*.pcapng", ["filename", "packet_number", "section_number", "interface_id", "timestamp", "captured_length", "original_length", "packet_offset", "capture_format"])
    return p.withColumn("dt", F.regexp_extract("filename", r"([0-9-]+)\.pcapng$", 1)).drop("filename")


# --- Link layers -------------------------------------------------------------------------------------------------------------
#: Link types of events by their number modulo eight: four kinds of Ethernet frames, cooked, raw, cooked 2, and one that isn't decoded.
LINKS = (1, 1, 1, 1, 113, 101, 276, 147)
_OPTIONS = b"\x01\x04\0\0\0\0"


def _layered(r: dict) -> bytes:
    e, kind = r["event_id"], r["event_id"] % 8
    segment = B.udp(4000, 5000, str(e).encode())
    src, dst = f"10.{e >> 16 & 255}.{e >> 8 & 255}.{e & 255}", "192.0.2.1"
    if kind == 1:
        six = B.ipv6(f"fd00::{e >> 16 & 0xFFFF:x}:{e & 0xFFFF:x}", "fd00::1", 0, bytes([60, 0]) + _OPTIONS + bytes([17, 0]) + _OPTIONS + segment)
        frame = B.ethernet(six, 0x86DD)
    elif kind < 4:
        four = B.ipv4(src, dst, 17, segment, fragment={2: 0x2000, 3: 185}.get(kind, 0))
        frame = B.ethernet(four, 0x0800, (100 + e % 3, 200) if kind == 0 else ())
    else:
        before = {4: b"\0\0\0\1\0\6" + bytes(8) + b"\x08\0", 6: b"\x08\0" + bytes(18)}.get(kind, b"")
        frame = before + B.ipv4(src, dst, 17, segment, ttl=33)
    return _record(r, LINKS[kind], frame)


def link_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded fields behind tags, extension headers and other link layers, of fragments, and of what can't be decoded."""
    link = F.element_at(F.array(*map(F.lit, LINKS)), (F.col("event_id") % 8 + 1).cast("int"))
    e = _events(spark, sf).withColumn("part", link.cast("string")).withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("ts", "event_id")))
    folder = _blob_files(spark, e, _layered, "links", ".pcap")
    cols = ["link_type", "packet_number", "src_mac", "dst_mac", "ether_type", "vlan_ids", "ip_version", "src_ip", "ip_protocol", "ip_ttl", "ip_fragment_offset", "ip_more_fragments", "src_port", "udp_length", "payload_length", "tcp_flags", "decode_outcome"]
    return read_packets(spark, f"{folder}/*.pcap", cols).withColumn("vlan_ids", F.when(F.col("vlan_ids").isNotNull(), F.concat_ws(",", F.col("vlan_ids").cast("array<string>"))))


# --- TLS records and DNS records in one packet ------------------------------------------------------------------------------
def _secured(r: dict):
    e = r["event_id"]
    data = (B.tls_record(B.client_hello(f"h{e} x\\y", [4865])), B.tls_record(str(e).encode(), 23), str(e).encode())[e % 3]
    yield _us(r["ts"]), B.packet(f"10.{e >> 16 & 255}.{e >> 8 & 255}.{e & 255}", "192.0.2.1", 6, B.tcp(4000, 443, 1, 1, 24, data))


def tls_records(spark: SparkSession, sf: str) -> DataFrame:
    """What one packet shows of a TLS record, names with signs that are escaped."""
    p = _file(spark, _packets(_events(spark, sf), _secured), "records")
    return read_packets(spark, p, ["packet_number", "is_tls", "tls_record_type", "tls_record_version", "tls_handshake_type", "tls_sni", "tls_truncated"])


def _answered(r: dict):
    k = len(r["dns_question_name"]) & 0xFF
    to_name = b"\xc0\x0c"

    def rr(kind: int, ttl: int, data: bytes) -> bytes:
        return to_name + struct.pack(">HHIH", kind, 1, ttl, len(data)) + data

    records = rr(1, 60, bytes([192, 0, 2, k])) + rr(28, 61, bytes([0xFD, 0]) + bytes(13) + bytes([k])) + rr(5, 62, b"\x05alias" + to_name) + rr(16, 63, b"\x02hi")
    q = B.dns_query(k, r["dns_question_name"], 255, 0x8180, records, 4)
    yield START_US + k, B.packet("192.0.2.53", "10.0.0.1", 17, B.udp(53, 40000, q))


def dns_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the records in responses; names are compressed."""
    d = read_dns(spark, _file(spark, _packets(_names(spark, sf), _answered), "answers"), ["dns_question_name", "dns_answers", "dns_response", "dns_rcode"])
    return d.select("dns_question_name", "dns_response", "dns_rcode", F.explode("dns_answers").alias("a")).select("dns_question_name", "dns_response", "dns_rcode", F.col("a.type").alias("rr_type"), F.col("a.ttl").alias("rr_ttl"), F.col("a.name").alias("rr_name"), F.col("a.value").alias("rr_value"), F.length("a.data").alias("n_data"))


# --- TCP sessions and streams -----------------------------------------------------------------------------------------------
def _sides(r: dict):
    e = r["event_id"]
    host = f"10.{e >> 16 & 255}.{e >> 8 & 255}.{e & 255}"

    def c(at: int, flags: int, seq: int, ack: int = 0, data: bytes = b""):
        return START_US + e * 1_000_000 + at, B.packet(host, "192.0.2.1", 6, B.tcp(40000, 80, seq, ack, flags, data))

    def s(at: int, flags: int, seq: int, ack: int = 0, data: bytes = b""):
        return START_US + e * 1_000_000 + at, B.packet("192.0.2.1", host, 6, B.tcp(80, 40000, seq, ack, flags, data))

    return c, s, str(e).encode()


def _lives(r: dict):
    """Packets of a connection, by the event's number modulo five: whole, reset and begun anew, reused, answered first, and seen halfway with a late packet."""
    c, s, data = _sides(r)
    opened = [c(0, 2, 100), s(1000, 18, 500, 101), c(2000, 16, 101, 501)]
    kind = r["event_id"] % 5
    if kind == 0:
        return [*opened, c(3000, 24, 101, 501, data), c(4000, 17, 101 + len(data), 501), s(5000, 17, 501, 102 + len(data)), c(6000, 16, 102 + len(data), 502)]
    if kind == 1:
        return [*opened, s(3000, 20, 501, 101), c(4000, 2, 900)]
    if kind == 2:
        return [c(0, 2, 100), c(1000, 24, 101, 1, data), c(2000, 2, 7777)]
    return [s(0, 18, 500, 101), c(1000, 16, 101, 501)] if kind == 3 else [c(0, 24, 5, 5, data), c(-500, 24, 9, 5, data)]


def tcp_flows(spark: SparkSession, sf: str) -> DataFrame:
    """How TCP sessions begin and end, of a capture that is named twice."""
    e = load(spark, sf, "events").filter("event_id is not null").select("event_id").orderBy("event_id")
    p = _file(spark, _packets(e, _lives), "lives")
    f = read_flows(read_packets(spark, [p, p], [*FLOW_COLUMNS, *CLOCK]), tcp_idle_timeout=timedelta(0))
    return f.select("input_index", "flow_id", "orig_ip", "orig_port", "resp_port", "originator_basis", "orig_packets", "resp_packets", "orig_payload_bytes", "resp_payload_bytes", "late_packets", "handshake_complete", "syn_seen", "fin_seen", "reset_seen", "simultaneous_open", "partial_session", "ambiguous", "finalized_by", "duration_us")


def _ends(r: dict):
    """Segments of a direction, by the event's number modulo five: reused, reset, in conflict, empty, without a SYN."""
    c, _, data = _sides(r)
    kind = r["event_id"] % 5
    syn, segment = c(0, 2, 99), c(1000, 24, 100, 0, data)
    return {0: [syn, segment, c(2000, 2, 5000), c(3000, 24, 5001, 0, data + data)], 1: [syn, segment, c(2000, 4, 100 + len(data))], 2: [syn, segment, c(2000, 24, 100, 0, b"#" * len(data))], 3: [syn, c(1000, 17, 100)], 4: [segment]}[kind]


def tcp_endings(spark: SparkSession, sf: str) -> DataFrame:
    """How TCP directions end, and what is left of them."""
    e = load(spark, sf, "events").filter("event_id is not null").select("event_id").orderBy("event_id")
    p = read_packets(spark, _file(spark, _packets(e, _ends), "ends"), [*NEEDED, *TCP_CLOCK])
    d = read_tcp_streams(p, tcp_idle_timeout=timedelta(0))
    return d.select("src_ip", "stream_id", "tcp_sequence", "syn_seen", "fin_seen", "reset_seen", "finalized_by", "reassembly_status", "reassembly_error", F.sha2("stream_data", 256).alias("digest"), F.size("chunks").alias("n_chunks"), "first_packet_number", "last_packet_number")


# --- Export, damaged captures, reuse, streams -------------------------------------------------------------------------------
def export_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What the export says of bad rows and options, and that the target stays as it was."""
    rows = _packets(_events(spark, sf), _datagram)
    path = _file(spark, rows, "rules")
    with open(path, "rb") as f:
        before = f.read(1 << 16)
    cases = {
        "captured": (rows.withColumn("captured_length", F.col("captured_length") + 1), {}), "original": (rows.withColumn("original_length", F.col("captured_length") - 1), {}), "link": (rows.withColumn("link_type", F.lit(101).cast("long")), {}),
        "null": (rows.withColumn("packet_data", F.lit(None).cast("binary")), {}), "time": (rows.withColumn("timestamp", F.lit("1960-01-01 00:00:00").cast("timestamp_ntz")), {}), "snaplen": (rows, {"snaplen": 20}),
        "columns": (rows.drop("link_type"), {}), "option": (rows, {"preserve_order": False}), "unknown": (rows, {"compress": True}), "good": (rows, {}),
    }
    out = []
    for name, (df, options) in cases.items():
        try:
            write_pcap(df, path, **options)
            said = "written"
        except Exception as e:  # what a task raised comes wrapped
            said = re.search(r"(?m)^(?:ValueError: )?(PCAP export[^\n]*)", str(e))[1].strip()
        with open(path, "rb") as f:
            same = f.read(1 << 16) == before
        out.append((name, said, same, sorted(os.listdir(os.path.dirname(path))) == [os.path.basename(path)]))
    return spark.createDataFrame(out, "rule string, outcome string, target_same boolean, nothing_left boolean")


def _damaged(r: dict) -> bytes:
    frame = B.packet("10.0.0.1", "192.0.2.1", 17, B.udp(1, 2, r["name"].encode()))
    whole = B.pcap([(START_US, frame)])
    kind = r["n"] % 7
    if kind == 1:
        return b"ABCD" + whole[4:]
    if kind == 2:
        return whole[:20]
    if kind == 3:
        return whole + struct.pack("<IIII", 1, 0, 1 << 30, 1 << 30)
    if kind == 4:
        return whole + whole[24:50]
    if kind == 5:
        return whole[:4] + b"\3\0" + whole[6:]
    return b"" if kind == 6 else whole


def damaged_captures(spark: SparkSession, sf: str) -> DataFrame:
    """What the inventory reports of a capture a nation, most of them damaged in some way."""
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name")).withColumn("part", F.col("n").cast("string"))
    folder = _blob_files(spark, n, _damaged, "damaged", ".pcap")
    inv = capture_inventory(spark, f"{folder}/*.pcap", "framing", on_error="report")
    where = r"^Capture '[^']*', packet cursor (\d+), byte cursor (\d+): (.*)$"
    return inv.select(F.regexp_extract("filename", r"(\d+)\.pcap$", 1).cast("int").alias("nation"), "scan_status", "packet_count", *[F.when(F.col("scan_error").isNotNull(), F.regexp_extract("scan_error", where, i)).alias(c) for i, c in ((1, "packet_cursor"), (2, "byte_cursor"), (3, "said"))])


def inventory_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Which summaries a second run takes over, after captures of odd days have grown by a packet."""
    folder = _blob_files(spark, _days(spark, sf), _record, "reuse", ".pcap")
    at = scratch(spark, "catalog")
    capture_inventory(spark, f"{folder}/*.pcap", "protocols").write.parquet(at)
    for name in os.listdir(folder):
        if name.endswith(".pcap") and int(name[8:10]) % 2:
            with open(f"{folder}/{name}", "ab") as f:
                f.write(struct.pack("<IIII", 1, 0, 4, 4) + b"more")
    inv = capture_inventory(spark, f"{folder}/*.pcap", "protocols", previous_catalog=spark.read.parquet(at), catalog_validation="immutable")
    return inv.select(F.regexp_extract("filename", r"([0-9-]+)\.pcap$", 1).alias("dt"), "packet_count", "udp_packets", "reused", "reuse_reason", "metadata_unchanged", "scan_status")


def _streamed(spark: SparkSession, sf: str, view) -> DataFrame:
    folder = _blob_files(spark, _days(spark, sf), _record, "live", ".pcap")
    out, marks = scratch(spark, "windows"), scratch(spark, "marks")
    q = view(stream_packets(spark, folder)).writeStream.outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True)
    q.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of captures as a stream: traffic by six hours and port."""
    w = _streamed(spark, sf, lambda p: windowed_traffic(p, ["dst_port"], "6 hours"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "dst_port", "packets", "captured_bytes")


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """The same by windows of six hours that begin every two."""
    w = _streamed(spark, sf, lambda p: windowed_traffic(p, ["dst_port"], "6 hours", "2 hours"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "dst_port", "packets", "captured_bytes")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The same by sessions of a host, closed after pauses of two hours."""
    s = _streamed(spark, sf, lambda p: session_traffic(p, ["src_ip"], "2 hours"))
    return s.select("src_ip", F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("end_time").cast("timestamp_ntz").alias("end_time"), "packets")


QUERIES = {f.__name__: f for f in (pcapng_blocks, link_layers, tls_records, dns_answers, tcp_flows, tcp_endings, export_rules, damaged_captures, inventory_reuse, stream_tumbling, stream_sliding, stream_sessions)}

_HOST = "'10.' || ((event_id >> 16) & 255) || '.' || ((event_id >> 8) & 255) || '.' || (event_id & 255)"
_USER = "'10.' || ((user_id >> 16) & 255) || '.' || ((user_id >> 8) & 255) || '.' || (user_id & 255)"
_DAILY = f"{_E}, d as (select *, strftime(ts, '%Y-%m-%d') as dt, row_number() over (partition by strftime(ts, '%Y-%m-%d') order by ts, event_id) as n, 42 + size as len from e)"
_NAME = "case when q = '.' then '.' else regexp_replace(q, '\\.$', '') end"
_WINDOW = "select w as window_start, w + interval 6 hour as window_end, port as dst_port, count(*) as packets, cast(sum(42 + size) as bigint) as captured_bytes"

ORACLE = {
    "pcapng_blocks": f"""{_DAILY},
      z as (select *, event_id % 4 as k, case when (n - 1) % {IN_SECTION} = 0 then 80 else 0 end + case when event_id % 4 = 3 then 12 + (size + 3) // 4 * 4 else 0 end as before, case when event_id % 4 = 2 then 16 else 32 end + (len + 3) // 4 * 4 as own from d)
      select dt, n as packet_number, 1 + (n - 1) // {IN_SECTION} as section_number, cast(k = 1 as bigint) as interface_id, case when k <> 2 then ts end as "timestamp", len as captured_length, len + case when k = 1 then 7 else 0 end as original_length,
        cast(sum(before + own) over (partition by dt order by n) - own + case when k = 2 then 12 else 28 end as bigint) as packet_offset, 'pcapng' as capture_format from z""",
    "link_layers": f"""{_E}, k as (select *, event_id % 8 as k, case event_id % 8 when 4 then 113 when 5 then 101 when 6 then 276 when 7 then 147 else 1 end as link from e)
      select cast(link as bigint) as link_type, row_number() over (partition by link order by ts, event_id) as packet_number, case when k < 4 then '02:00:00:00:00:01' end as src_mac, case when k < 4 then '02:00:00:00:00:02' end as dst_mac,
        case when k = 1 then 34525 when k < 4 then 2048 end as ether_type, case when k = 0 then (100 + event_id % 3) || ',200' when k < 4 then '' end as vlan_ids, case when k = 1 then 6 when k < 7 then 4 end as ip_version,
        case when k = 1 then 'fd00:0000:0000:0000:0000:0000:' || lpad(lower(to_hex((event_id >> 16) & 65535)), 4, '0') || ':' || lpad(lower(to_hex(event_id & 65535)), 4, '0') when k < 7 then {_HOST} end as src_ip, case when k < 7 then 17 end as ip_protocol,
        case when k < 4 then 64 when k < 7 then 33 end as ip_ttl, case when k = 3 then 1480 when k < 7 then 0 end as ip_fragment_offset, case when k < 7 then k = 2 end as ip_more_fragments, case when k not in (2, 3, 7) then 4000 end as src_port, case when k not in (2, 3, 7) then 8 + size end as udp_length,
        case when k not in (2, 3, 7) then size end as payload_length, cast(null as int) as tcp_flags, case when k in (2, 3) then 'fragment' when k = 7 then 'unsupported' else 'decoded' end as decode_outcome from k""",
    "tls_records": f"""{_E} select pn as packet_number, event_id % 3 < 2 as is_tls, case event_id % 3 when 0 then 22 when 1 then 23 end as tls_record_type, case when event_id % 3 < 2 then 771 end as tls_record_version, case when event_id % 3 = 0 then 1 end as tls_handshake_type,
      case when event_id % 3 = 0 then 'h' || event_id || '\\032x\\092y' end as tls_sni, case when event_id % 3 = 0 then false end as tls_truncated from e""",
    "dns_answers": f"""with n as (select distinct dns_question_name as q from read_dns_messages where dns_question_name is not null), m as (select {_NAME} as name, length(q) % 256 as k from n)
      select name as dns_question_name, true as dns_response, cast(0 as smallint) as dns_rcode, t as rr_type, cast(s as bigint) as rr_ttl, name as rr_name,
        case t when 5 then case when name = '.' then 'alias' else 'alias.' || name end when 1 then '192.0.2.' || k when 28 then 'fd00:0000:0000:0000:0000:0000:0000:' || lpad(lower(to_hex(k)), 4, '0') end as rr_value, size as n_data
      from m, (values (1, 60, 4), (28, 61, 16), (5, 62, 8), (16, 63, 3)) as v(t, s, size)""",
    "tcp_flows": f"""with e as (select event_id, event_id % 5 as k, length(cast(event_id as varchar)) as size, case event_id % 5 when 0 then 7 when 1 then 5 when 2 then 3 else 2 end as n from events where event_id is not null),
      f as (select *, cast(sum(n) over (order by event_id) - n as bigint) as before from e),
      r as (select *, 1 as life from f union all select *, 2 from f where k in (1, 2))
      select i as input_index, (before + case when life = 1 then 0 when k = 1 then 4 else 2 end) * 2 + i as flow_id, {_HOST} as orig_ip, 40000 as orig_port, 80 as resp_port, case when k = 3 then 'syn_ack' when k = 4 then 'first_packet' else 'syn' end as originator_basis,
        cast(case when life = 2 then 1 when k = 0 then 5 when k = 1 then 2 when k = 3 then 1 else 2 end as bigint) as orig_packets, cast(case when life = 2 then 0 when k in (0, 1) then 2 when k = 3 then 1 else 0 end as bigint) as resp_packets,
        case when life = 2 or k in (1, 3) then 0 when k = 4 then 2 * size else size end as orig_payload_bytes, cast(0 as bigint) as resp_payload_bytes, cast(k = 4 as bigint) as late_packets, life = 1 and k in (0, 1) as handshake_complete, k <> 4 as syn_seen, k = 0 as fin_seen, life = 1 and k = 1 as reset_seen, false as simultaneous_open,
        not (life = 1 and k in (0, 1)) as partial_session, k = 4 as ambiguous, case when life = 1 and k = 1 then 'reset' when life = 1 and k = 2 then 'tuple_reuse' else 'eof' end as finalized_by,
        cast(case when life = 2 then 0 when k = 0 then 6000 when k = 1 then 3000 when k = 4 then 500 else 1000 end as bigint) as duration_us from r, (values (1), (2)) as v(i)""",
    "tcp_endings": f"""with e as (select event_id, event_id % 5 as k, cast(event_id as varchar) as t, case event_id % 5 when 0 then 4 when 3 then 2 when 4 then 1 else 3 end as n, case event_id % 5 when 0 then 2 else 1 end as dirs from events where event_id is not null),
      f as (select *, cast(sum(n) over (order by event_id) - n as bigint) as before, cast(sum(dirs) over (order by event_id) - dirs as bigint) as earlier from e),
      r as (select *, 1 as life from f union all select *, 2 from f where k = 0)
      select {_HOST} as src_ip, earlier + life as stream_id, cast(case when k = 2 then null when life = 2 then 5001 else 100 end as bigint) as tcp_sequence, k <> 4 as syn_seen, false as fin_seen, k = 1 as reset_seen, case when k = 1 then 'reset' when k = 0 and life = 1 then 'tuple_reuse' else 'eof' end as finalized_by,
        case when k = 2 then 'conflict' when k = 4 then 'unanchored' else 'contiguous' end as reassembly_status, case when k = 2 then 'overlapping TCP segments contain different bytes' when k = 4 then 'TCP SYN was not captured; offsets start at the earliest observed sequence' end as reassembly_error,
        case when k <> 2 then sha256(case when life = 2 then t || t else t end) end as digest, case when k = 2 then 0 else 1 end as n_chunks, before + case when life = 2 then 3 else 1 end as first_packet_number, before + case when k = 0 then 2 * life when k = 4 then 1 else 3 end as last_packet_number from r where k <> 3""",
    "export_rules": """select * from (values ('captured', 'PCAP export: captured_length exceeds original_length', true, true), ('original', 'PCAP export: captured_length exceeds original_length', true, true), ('link', 'PCAP export: link_type is not 1', true, true), ('null', 'PCAP export: packet_data is null', true, true),
      ('time', 'PCAP export: timestamp is outside what a capture can hold', true, true), ('snaplen', 'PCAP export: captured_length exceeds SNAPLEN 20', true, true), ('columns', 'PCAP export needs exactly the columns [''captured_length'', ''link_type'', ''original_length'', ''packet_data'', ''timestamp'']', true, true),
      ('option', 'PCAP export: preserve_order can''t be false', true, true), ('unknown', 'PCAP export: no option ''compress''', true, true), ('good', 'written', true, true)) as v(rule, outcome, target_same, nothing_left)""",
    "damaged_captures": "select n_nationkey as nation, case when n_nationkey % 7 in (1, 2, 3, 5, 6) then 'error' when n_nationkey % 7 = 4 then 'truncated' else 'complete' end as scan_status, cast(case when n_nationkey % 7 in (0, 4) then 1 end as bigint) as packet_count, "
    "case n_nationkey % 7 when 3 then '1' when 1 then '0' when 2 then '0' when 5 then '0' when 6 then '0' end as packet_cursor, case n_nationkey % 7 when 3 then cast(24 + 16 + 42 + length(n_name) as varchar) when 1 then '0' when 2 then '0' when 5 then '0' when 6 then '0' end as byte_cursor, "
    "case n_nationkey % 7 when 1 then 'not a PCAP or PCAPNG capture' when 2 then 'the file ends inside its headers or first record' when 3 then 'a packet of 1073741824 bytes exceeds the limit' when 5 then 'unsupported PCAP version 3' when 6 then 'the file is empty' end as said from nation",
    "inventory_reuse": f"{_DAILY}, c as (select dt, count(*) as n, cast(substr(dt, 9, 2) as int) % 2 = 1 as odd from d group by dt) select dt, n + cast(odd as bigint) as packet_count, n as udp_packets, not odd as reused, case when odd then 'identity_changed_or_unavailable' else 'immutable_metadata_match' end as reuse_reason, true as metadata_unchanged, 'complete' as scan_status from c",
    "stream_tumbling": f"{_E}, w as (select *, time_bucket(interval 6 hour, ts, timestamp '2000-01-03') as w from e) {_WINDOW} from w group by w, port",
    "stream_sliding": f"{_E}, w as (select *, time_bucket(interval 2 hour, ts, timestamp '2000-01-03') - h * interval 2 hour as w from e, (values (0), (1), (2)) as v(h)) {_WINDOW} from w group by w, port",
    "stream_sessions": f"""{_E}, l as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 7200000000 then 0 else 1 end as fresh from e), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from l)
      select {_USER} as src_ip, min(ts) as start_time, max(ts) as end_time, count(*) as packets from g group by user_id, k""",
}
