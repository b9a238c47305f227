"""Queries of the language-model data problems on packet tables and the tokenizer, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.addresses import canonical_ip
from netloom.llm.distinct import count_state, pair_state
from netloom.llm.frequent import frequent_items
from netloom.llm.tokenizer import encode_corpus
from netloom.plans.sql import ip_map
from netloom.session import load, materialize

LEAST_SOURCES = 60


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    packets = load(spark, sf, "read_packets")
    return pair_state(packets, canonical_ip("src_ip"), {"capture_day": F.date_format("timestamp", "yyyy-MM-dd"), "dst_ip": canonical_ip("dst_ip")})


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Days and destination hosts reached by at least 60 different source hosts."""
    return count_state(_pairs(spark, sf), ["capture_day", "dst_ip"]).filter(F.col("n_distinct") >= LEAST_SOURCES).select("capture_day", "dst_ip")


def p3_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Different source hosts per day, per destination host and per both; a null stands for all."""
    state = materialize(_pairs(spark, sf), "p3")
    day, dst, both = (count_state(state, g) for g in (["capture_day"], ["dst_ip"], ["capture_day", "dst_ip"]))
    cols = ["capture_day", "dst_ip", "n_distinct"]
    return both.select(*cols).union(day.withColumn("dst_ip", F.lit(None).cast("string")).select(*cols)).union(dst.withColumn("capture_day", F.lit(None).cast("string")).select(*cols))


def p4_frequent(spark: SparkSession, sf: str) -> DataFrame:
    """Question names and source hosts with at least 1 % of all, with approximate and exact counts."""
    asked = load(spark, sf, "read_dns_messages").select(F.explode("dns_questions.name").alias("name")).filter("name is not null")
    names = asked.select(F.regexp_replace(F.lower("name"), r"\.$", "").alias("name"))
    packets = load(spark, sf, "read_packets")
    hosts = packets.select(canonical_ip("src_ip").alias("src_ip"))
    one = frequent_items(names, 10, asked.agg(F.count(F.lit(1))).scalar())
    two = frequent_items(hosts, 10, packets.agg(F.count(F.lit(1))).scalar())
    return one.select(F.lit("dns_name").alias("item_kind"), "*").union(two.select(F.lit("src_ip").alias("item_kind"), "*"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_frequent(spark, sf).select("item_kind", "item")


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The frequent items with their exact counts of the second pass."""
    return p4_frequent(spark, sf).select("item_kind", "item", "n_rows")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(load(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_distinct, p4_found, p4_frequent, p4_counts, p8_ids)}

_DISTINCT = f"""
  with ips as ({ip_map([("read_packets", "src_ip"), ("read_packets", "dst_ip")])}),
  p as (select distinct strftime("timestamp", '%Y-%m-%d') as capture_day, d.host as dst_ip, s.host as src_ip from read_packets r
        join ips s on s.raw = r.src_ip join ips d on d.raw = r.dst_ip where "timestamp" is not null and s.host is not null and d.host is not null)
"""

def _frequent(count: str) -> str:
    return f"""
      with ips as ({ip_map([("read_packets", "src_ip")])}),
      q as (select unnest(dns_questions) as q from read_dns_messages),
      n as (select regexp_replace(lower(q.name), '\\.$', '') as item from q where q.name is not null)
      select 'dns_name' as item_kind, item{count} from n group by item having count(*) * 100 >= (select count(*) from n)
      union all select 'src_ip', host{count} from read_packets join ips on raw = src_ip where host is not null group by host having count(*) * 100 >= (select count(*) from read_packets)"""


ORACLE = {
    "p3_found": f"{_DISTINCT} select capture_day, dst_ip from p group by 1, 2 having count(distinct src_ip) >= {LEAST_SOURCES}",
    "p3_distinct": f"{_DISTINCT} select capture_day, dst_ip, count(distinct src_ip) as n_distinct from p group by grouping sets ((capture_day, dst_ip), (capture_day), (dst_ip))",
    "p4_found": _frequent(""),
    "p4_counts": _frequent(", count(*) as n_rows"),
}
