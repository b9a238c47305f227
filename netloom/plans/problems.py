"""Queries of the general training-data problems, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.addresses import canonical_ip, canonical_path
from netloom.operators.changefeed import replay_runs
from netloom.operators.compaction import Compacted, compact, disagreeing_captures
from netloom.operators.intervals import periods_and_gaps
from netloom.operators.keyed import Measure, aggregate_by_key, heavy_keys
from netloom.operators.sessions import sessionize
from netloom.plans.sql import ip_map, path
from netloom.session import epoch_us, load, scratch

PAUSE_US = 30 * 60 * 1_000_000
GAP_US = 6 * 3600 * 1_000_000


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts and stream numbers that hold at least 2 % of all rows."""
    hosts = heavy_keys(load(spark, sf, "read_packets"), F.col("src_ip"), 2, canonical_ip)
    streams = heavy_keys(load(spark, sf, "read_tcp_streams"), F.col("stream_id"), 2)
    return hosts.select(F.lit("src_ip").alias("key_kind"), "key_value").union(streams.select(F.lit("stream_id"), F.col("key_value").cast("string")))


def p1_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of every source host and stream number."""
    hosts = aggregate_by_key(
        load(spark, sf, "read_packets"), F.col("src_ip"),
        [Measure("n_rows", "count"), Measure("n_bytes", "sum", "captured_length"), Measure("first_seen", "min", "timestamp"), Measure("last_seen", "max", "timestamp")], canonical_ip,
    )
    streams = aggregate_by_key(
        load(spark, sf, "read_tcp_streams"), F.col("stream_id"),
        [Measure("n_rows", "count"), Measure("n_bytes", "sum", "captured_bytes"), Measure("first_seen", "min", "first_timestamp"), Measure("last_seen", "max", "last_timestamp")],
    )
    return hosts.select(F.lit("src_ip").alias("key_kind"), "*").union(streams.select(F.lit("stream_id"), F.col("key_value").cast("string"), "n_rows", "n_bytes", "first_seen", "last_seen"))


def _consolidate(spark: SparkSession, sf: str) -> Compacted:
    pcap = load(spark, sf, "read_pcap")
    return compact(pcap, canonical_path("filename"), "packet_number", scratch(spark, "p2"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Captures whose consolidated records disagree in number with the inventory."""
    inventory = load(spark, sf, "capture_inventory").select("run_number", canonical_path("filename").alias("filename"), "packet_count")
    return disagreeing_captures(_consolidate(spark, sf), inventory).select("filename")


def p2_files(spark: SparkSession, sf: str) -> DataFrame:
    """What the consolidation wrote: records and repeats per capture."""
    done = _consolidate(spark, sf).manifest()
    return done.groupBy(F.col("capture").alias("filename")).agg(F.sum("n_records").alias("n_records"), F.sum("n_repeats").alias("n_repeats"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Captures each inventory run hands on as new or changed."""
    inv = load(spark, sf, "capture_inventory").filter(F.col("scan_status").isin("complete", "truncated"))
    seconds = F.floor(epoch_us(F.col("modification_time")) / 1_000_000)
    rows = inv.select("run_number", canonical_path("filename").alias("filename"), "file_size", seconds.alias("mtime"))
    return replay_runs(rows, "run_number", "filename", ["file_size", "mtime"], scratch(spark, "p5"))


def p6_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the packets of each source host to each destination port."""
    keys = {"src_ip": canonical_ip("src_ip"), "dst_port": F.col("dst_port")}
    return sessionize(load(spark, sf, "read_packets"), keys, F.col("timestamp"), PAUSE_US)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_sessions(spark, sf).select("src_ip", "dst_port", "start_us", "end_us")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Unbroken periods of each local host and the gaps of at most six hours between them."""
    facts = load(spark, sf, "connection_facts")
    out = periods_and_gaps(facts, canonical_ip("local_ip"), F.col("first_timestamp"), F.col("last_timestamp"), GAP_US)
    return out.withColumnRenamed("entity", "local_ip")


QUERIES = {f.__name__: f for f in (p1_found, p1_per_key, p2_found, p2_files, p5_found, p6_found, p6_sessions, p7_found)}

_SESSIONS = f"""
  with ips as ({ip_map([("read_packets", "src_ip")])}),
  e as (select host as src_ip, dst_port, epoch_us("timestamp") as us from read_packets join ips on raw = src_ip where "timestamp" is not null and dst_port is not null and host is not null),
  n as (select *, case when us - lag(us) over (partition by src_ip, dst_port order by us) <= {PAUSE_US} then 0 else 1 end as fresh from e),
  g as (select *, sum(fresh) over (partition by src_ip, dst_port order by us rows unbounded preceding) as k from n)
"""

ORACLE = {
    "p1_found": f"""
      with ips as ({ip_map([("read_packets", "src_ip")])}),
      h as (select host, count(*) as n from read_packets join ips on raw = src_ip group by host),
      s as (select stream_id, count(*) as n from read_tcp_streams where stream_id is not null group by stream_id)
      select 'src_ip' as key_kind, host as key_value from h where n * 100 >= 2 * (select count(*) from read_packets)
      union all select 'stream_id', cast(stream_id as varchar) from s where n * 100 >= 2 * (select count(*) from read_tcp_streams)""",
    "p1_per_key": f"""
      with ips as ({ip_map([("read_packets", "src_ip")])})
      select 'src_ip' as key_kind, host as key_value, count(*) as n_rows, cast(sum(captured_length) as bigint) as n_bytes, min("timestamp") as first_seen, max("timestamp") as last_seen
      from read_packets left join ips on raw = src_ip group by host
      union all select 'stream_id', cast(stream_id as varchar), count(*), cast(sum(captured_bytes) as bigint), min(first_timestamp), max(last_timestamp) from read_tcp_streams group by stream_id""",
    "p2_found": f"""
      with f as (select {path("filename")} as filename, count(distinct packet_number) as n from read_pcap group by 1),
      i as (select filename, packet_count, row_number() over (partition by filename order by run_number desc, packet_count desc) as k from capture_inventory where packet_count is not null)
      select i.filename as filename from i left join f on f.filename = i.filename where k = 1 and coalesce(n, 0) <> packet_count""",
    "p2_files": f"""
      with f as (select {path("filename")} as filename, packet_number from read_pcap)
      select filename, count(distinct packet_number) + count(*) filter (where packet_number is null) as n_records, count(packet_number) - count(distinct packet_number) as n_repeats from f group by filename""",
    "p5_found": """
      with ok as (select run_number, filename, max(file_size) as size, max(date_trunc('second', modification_time)) as m from capture_inventory where scan_status in ('complete', 'truncated') group by 1, 2),
      p as (select *, row_number() over w as k, lag(size) over w as size0, lag(m) over w as m0 from ok window w as (partition by filename order by run_number))
      select run_number, filename from p where k = 1 or size0 is null or m0 is null or size is null or m is null or size <> size0 or m <> m0""",
    "p6_found": f"{_SESSIONS} select src_ip, dst_port, min(us) as start_us, max(us) as end_us from g group by src_ip, dst_port, k",
    "p6_sessions": f"{_SESSIONS} select src_ip, dst_port, min(us) as start_us, max(us) as end_us, max(us) - min(us) as duration_us, count(*) as n_events from g group by src_ip, dst_port, k",
    "p7_found": f"""
      with ips as ({ip_map([("connection_facts", "local_ip")])}),
      s as (select host as local_ip, epoch_us(first_timestamp) as a, epoch_us(last_timestamp) as b from connection_facts join ips on raw = local_ip where last_timestamp >= first_timestamp),
      o as (select *, max(b) over (partition by local_ip order by a, b rows between unbounded preceding and 1 preceding) as reach from s),
      k as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by local_ip order by a, b rows unbounded preceding) as n from o),
      p as (select local_ip, n, min(a) as a, max(b) as b from k group by local_ip, n),
      g as (select local_ip, b, lead(a) over (partition by local_ip order by a) as c from p)
      select local_ip, 'period' as span_kind, a as start_us, b as end_us from p
      union all select local_ip, 'gap', b, c from g where c - b <= {GAP_US}""",
}
