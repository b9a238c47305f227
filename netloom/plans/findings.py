"""Queries of the scalar functions and analytic relations over the fact tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.addresses import canonical_ip
from netloom.functions.names import SuffixRules, encoded_ratio, normalized_entropy, suffix_parts
from netloom.functions.network import ip_in_cidrs
from netloom.operators.analytics import analyze_beacons, analyze_dns_tunnels, analyze_long_connections, connection_facts, dns_facts, summarize_talkers
from netloom.plans.sql import ip_map
from netloom.session import load

#: Rules for the reserved names of the test tables: an exact, a wildcard, an exception and a private one.
RULES = SuffixRules.parse(["test", "*.example", "!golige.example", "// ===BEGIN PRIVATE DOMAINS===", "miravem.invalid"], "test rules")
NETWORKS = ["10.0.0.0/8", "fd3a:91c0::/32"]
_ENDS = ("endpoint_a_ip", "endpoint_b_ip", "local_ip", "remote_ip")
DAY_US = 86_400_000_000


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Connection facts of the test table, one row per different row; it has no reported bytes, captured ones stand in."""
    f = load(spark, sf, "connection_facts").dropDuplicates(["source_locator", "source_record_id", "source_occurrence"])
    f = f.withColumns({c: canonical_ip(c) for c in _ENDS})
    return f.withColumns({f"{s}_reported_bytes": F.col(f"{s}_captured_bytes") for s in "ab"})


def _rounded(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to six places, arrays of texts as one text: what two engines can be compared on."""
    out = []
    for name, kind in df.dtypes:
        if name in drop:
            continue
        c = F.col(name)
        out.append((F.round(c, 6) if kind == "double" else F.array_join(c, "|") if kind == "array<string>" else c).alias(name))
    return df.select(*out)


def ip_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of the packets as written, and whether they lie in the local networks."""
    ips = load(spark, sf, "read_packets").select(F.col("src_ip").alias("ip")).distinct()
    return ips.select("ip", ip_in_cidrs(F.trim("ip"), NETWORKS).alias("is_local"))


def psl_features(spark: SparkSession, sf: str) -> DataFrame:
    """Suffix parts of the different question names."""
    names = load(spark, sf, "read_dns_messages").select(F.lower("dns_question_name").alias("name")).distinct()
    return names.select("name", suffix_parts("name", RULES).alias("s")).select("name", "s.*")


def name_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy and encoded share of the different question names."""
    names = load(spark, sf, "read_dns_messages").select("dns_question_name").distinct()
    return _rounded(names.select(F.col("dns_question_name").alias("name"), normalized_entropy("dns_question_name").alias("entropy"), encoded_ratio("dns_question_name").alias("encoded")))


def flow_connection_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Direction and flags of the rows of the fact table, taken anew as flows of endpoints a and b."""
    f = load(spark, sf, "connection_facts").dropDuplicates(["source_locator", "source_record_id", "source_occurrence"])
    none: Column = F.lit(None).cast("boolean")
    flows = f.select(
        F.col("source_locator").alias("filename"), F.col("source_occurrence").alias("input_index"), F.substring_index("source_record_id", ":", -1).cast("long").alias("flow_id"), "transport",
        canonical_ip("endpoint_a_ip").alias("orig_ip"), canonical_ip("endpoint_b_ip").alias("resp_ip"), F.col("endpoint_a_port").alias("orig_port"), F.col("endpoint_b_port").alias("resp_port"), F.col("initiator_basis").alias("originator_basis"),
        "first_timestamp", "last_timestamp", F.lit(None).cast("interval day to second").alias("duration"), "duration_us",
        *[F.col(f"{a}_{x}").alias(f"{o}_{x}") for a, o in (("a", "orig"), ("b", "resp")) for x in ("packets", "captured_bytes", "payload_bytes")],
        *[F.col(f"{a}_captured_bytes").alias(f"{o}_reported_bytes") for a, o in (("a", "orig"), ("b", "resp"))],
        "handshake_complete", "partial_session", "ambiguous", "finalized_by", none.alias("simultaneous_open"), (F.col("endpoint_a_port") == F.col("endpoint_b_port")).alias("equal_endpoints"),
        F.lit(0).cast("long").alias("missing_timestamp_packets"), F.lit(0).cast("long").alias("late_packets"),
    )
    return _rounded(connection_facts(flows, NETWORKS), ("duration",))


def talkers_host(spark: SparkSession, sf: str) -> DataFrame:
    return summarize_talkers(_facts(spark, sf), max_results=1000)


def talkers_service(spark: SparkSession, sf: str) -> DataFrame:
    return summarize_talkers(_facts(spark, sf), by="service", metric="peers", scope="local_remote", max_results=500)


def long_connections(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(analyze_long_connections(_facts(spark, sf)))


def beacons(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(analyze_beacons(_facts(spark, sf), scope="local_remote", min_connections=2), ("finding_id", "evidence"))


def beacons_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(analyze_beacons(_facts(spark, sf), window=DAY_US, min_connections=2, max_results=100_000), ("finding_id", "evidence"))


def _dns(spark: SparkSession, sf: str) -> DataFrame:
    m = load(spark, sf, "read_dns_messages").dropDuplicates(["filename", "section_number", "interface_id", "stream_id", "message_number", "first_packet_number", "transport"])
    return dns_facts(m.withColumns({c: canonical_ip(c) for c in ("src_ip", "dst_ip")}), RULES)


def dns_fact_features(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the DNS messages."""
    return _rounded(_dns(spark, sf).select("source_locator", "source_record_id", "client_ip", "resolver_ip", "client_port", "resolver_port", "message_direction", "grouping_domain", "suffix_section", "suffix_rule", "left_payload_length", "normalized_entropy", "encoded_character_ratio", "answer_count", "quality_flags"))


def dns_tunnels(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(analyze_dns_tunnels(_dns(spark, sf), min_queries=3, max_results=100_000), ("finding_id", "evidence", "question_types", "suffix_list_version"))


QUERIES = {f.__name__: f for f in (ip_membership, psl_features, name_looks, flow_connection_facts, talkers_host, talkers_service, long_connections, beacons, beacons_windowed, dns_fact_features, dns_tunnels)}

# --- Oracle SQL --------------------------------------------------------------------------------------------------------
_ORIGIN = 946_857_600_000_000


def _flags(pairs: list[tuple[str, str]]) -> str:
    return "concat_ws('|', " + ", ".join(f"case when {c} then '{t}' end" for c, t in pairs) + ")"


_CONN = f"""
  with ips as ({ip_map([("connection_facts", c) for c in _ENDS])}),
  u as (select *, row_number() over (partition by source_locator, source_record_id, source_occurrence order by first_timestamp) as dup from connection_facts),
  f as (select u.* exclude ({", ".join(_ENDS)}, dup), {", ".join(f"m{i}.host as {c}" for i, c in enumerate(_ENDS))}, a_captured_bytes as a_reported_bytes, b_captured_bytes as b_reported_bytes
        from u {" ".join(f"left join ips m{i} on m{i}.raw = u.{c}" for i, c in enumerate(_ENDS))} where dup = 1)
"""


def _talkers(by: str, metric: str, scope: str, k: int) -> str:
    counts = ("packets", "captured_bytes", "reported_bytes", "payload_bytes")

    def end(me: str, peer: str, away: str) -> str:
        cond = "true" if scope == "all" else f"direction in ('internal', 'external', '{away}') or (direction = 'unknown' and endpoint_{me}_ip = local_ip)"
        cols = ", ".join(f"{me}_{c} as sent_{c}, {peer}_{c} as received_{c}" for c in counts)
        return f"select direction, first_timestamp, last_timestamp, endpoint_{me}_ip as endpoint_ip, endpoint_{peer}_ip as peer_ip, transport, endpoint_{me}_port as port, {cols} from s where {cond}"

    where = {"all": "true", "local_remote": "local_ip is not null and remote_ip is not null"}[scope]
    t, p = ("transport", "port") if by == "service" else ("cast(null as varchar)", "cast(null as integer)")
    sums = ", ".join(f"cast(sum(sent_{c}) as bigint) as sent_{c}, cast(sum(received_{c}) as bigint) as received_{c}, cast(sum(sent_{c} + received_{c}) as bigint) as total_{c}" for c in counts)
    chosen = {"peers": "peer_count", "connections": "connection_count"}.get(metric, f"total_{metric}")
    return f"""{_CONN}, s as (select * from f where {where}), e as ({end("a", "b", "outbound")} union all {end("b", "a", "inbound")}),
      t as (select endpoint_ip, {t} as transport, {p} as port, case when count(distinct direction) = 1 then min(direction) else 'mixed' end as direction, {sums}, count(*) as connection_count, count(distinct peer_ip) as peer_count, min(first_timestamp) as first_seen, max(last_timestamp) as last_seen from e group by endpoint_ip, {t}, {p}),
      r as (select row_number() over (order by {chosen} desc nulls last, endpoint_ip nulls last, transport nulls first, port nulls first) as rank, '{by}' as grouping, '{metric}' as metric, {chosen} as selected_metric_value, * from t)
      select * from r where rank <= {k}"""


def _beacons(scope: str, window: int | None, least: int, k: int) -> str:
    where = "local_ip is not null and remote_ip is not null" if scope == "local_remote" else f"direction = '{scope}'"
    us = "epoch_us(first_timestamp)"
    bucket = "cast(null as bigint)" if window is None else f"cast(floor(({us} - {_ORIGIN}) / {window}.0) as bigint) * {window} + {_ORIGIN}"
    keys = "local_ip, remote_ip, remote_port, transport, direction, bucket"
    on = " and ".join(f"g.{c} is not distinct from {{0}}.{c}" for c in keys.split(", "))
    has = ", ".join(f"bool_or(list_contains(quality_flags, '{x}')) as has_{x}" for x in ("missing_timestamps", "late_packets", "partial_session", "ambiguous_orientation", "capture_boundary"))
    stamp = "make_timestamp({0})"
    return f"""{_CONN}, s as (select *, {bucket} as bucket, a_payload_bytes + b_payload_bytes as size from f where {where}),
      g as (select {keys}, count(*) as connection_count, count(first_timestamp) as timed_connection_count, min(first_timestamp) as first_seen, max(first_timestamp) as last_seen, max(last_timestamp) as last_observed,
            cast(median(size) as double) as median_payload_bytes, cast(mad(size) as double) as payload_mad_bytes, {has} from s group by {keys} having count(*) >= {least}),
      d as (select distinct {keys}, {us} as us from s where first_timestamp is not null),
      v as (select {keys}, (us - lag(us) over (partition by {keys} order by us)) / 1000.0 as ms from d),
      i as (select {keys}, count(ms) as n, cast(median(cast(ms as double)) as double) as q2, cast(mad(cast(ms as double)) as double) as dev, quantile_cont(cast(ms as double), 0.25) as q1, quantile_cont(cast(ms as double), 0.75) as q3 from v where ms is not null group by {keys}),
      m as (select g.*, n, q1, q2, q3, dev, epoch_us(last_seen) - epoch_us(first_seen) as span from g left join i on {on.format("i")}),
      c as (select *, case when n >= 3 and q2 > 0 then 100.0 * greatest(0.0, least(1.0, 1.0 - 4.0 * dev / q2)) end as timing_score, 100.0 * greatest(0.0, least(1.0, 1.0 - 2.0 * payload_mad_bytes / greatest(1.0, median_payload_bytes))) as size_score,
            least(100.0, 50.0 + 50.0 * (connection_count - {least}) / {float(least)}) as support_score, least(100.0, 50.0 * span / 300000000.0) as span_score from m),
      z as (select *, case when timing_score is not null then 0.5 * timing_score + 0.2 * size_score + 0.15 * support_score + 0.15 * span_score end as score from c),
      r as (select *, row_number() over (order by score desc nulls last, connection_count desc, local_ip nulls last, remote_ip nulls last, transport nulls last, remote_port nulls last, direction nulls last, bucket nulls first) as rank from z)
      select 'beacon' as detector, 'pq-beacon-v1' as detector_version, 'balanced-v1' as profile, rank, local_ip, remote_ip, remote_port, transport, direction,
        coalesce({stamp.format("bucket")}, first_seen) as window_start, coalesce({stamp.format(f"bucket + {window or 0}")}, last_observed) as window_end, first_seen, last_seen, connection_count, timed_connection_count, span as observation_span_us,
        round(q2, 6) as median_interval_ms, round(dev, 6) as interval_mad_ms, round(q1, 6) as interval_q1_ms, round(q3, 6) as interval_q3_ms, round(case when q3 > q1 then (q3 + q1 - 2.0 * q2) / (q3 - q1) end, 6) as interval_bowley_skew,
        round(median_payload_bytes, 6) as median_payload_bytes, round(payload_mad_bytes, 6) as payload_mad_bytes, round(cast(timing_score as double), 6) as timing_score, round(cast(size_score as double), 6) as size_score, round(cast(support_score as double), 6) as support_score, round(cast(span_score as double), 6) as span_score, round(cast(score as double), 6) as score,
        {_flags([("timing_score >= 75", "connection starts have low interval dispersion"), ("size_score >= 75", "connection payload sizes have low dispersion"), ("support_score >= 75", "connection count provides strong support"), ("span_score >= 75", "observations span the configured minimum")])} as reasons,
        {_flags([*[(f"has_{x}", x) for x in ("missing_timestamps", "late_packets", "partial_session", "ambiguous_orientation", "capture_boundary")], ("coalesce(n, 0) < 3", "insufficient_intervals"), ("span < 300000000", "insufficient_span"), ("connection_count > 8", "evidence_truncated")])} as quality_flags,
        connection_count > 8 as evidence_truncated from r where rank <= {k}"""


def _psl(name: str) -> str:
    """CTE bodies p (name parts) from a relation ``names`` with column ``name``."""
    return f"""
      l as (select {name} as name, string_split(rtrim(lower({name}), '.'), '.') as x from names),
      k as (select *, case when name is null then null when list_contains(x, '') then 0 when x[-2] = 'golige' and x[-1] = 'example' then 1 when x[-1] = 'example' and len(x) > 1 then 2 when x[-2] = 'miravem' and x[-1] = 'invalid' then 2 else 1 end as n,
            case when list_contains(x, '') then '*' when x[-2] = 'golige' and x[-1] = 'example' then '!golige.example' when x[-1] = 'example' and len(x) > 1 then '*.example' when x[-2] = 'miravem' and x[-1] = 'invalid' then 'miravem.invalid' when x[-1] = 'test' then 'test' else '*' end as rule from l),
      p as (select name, case when n is null then null when n = 0 then '' else array_to_string(x[len(x) - n + 1 : len(x)], '.') end as public_suffix, case when n is null then null when n = 0 or len(x) <= n then '' else array_to_string(x[len(x) - n : len(x)], '.') end as registrable_domain,
            case when n is null then null when n = 0 or len(x) <= n + 1 then '' else array_to_string(x[1 : len(x) - n - 1], '') end as left_payload, case when n is null then null when rule = '*' then 'unknown' when rule = 'miravem.invalid' then 'private' else 'icann' end as suffix_section, case when n is null then null else rule end as suffix_rule from k)"""


def _looks(table: str, column: str, key: str) -> str:
    """CTE bodies: entropy h and encoded share per different text of a column."""
    return f"""
      t_{key} as (select distinct {column} as v from {table} where {column} is not null),
      c_{key} as (select v, ch, count(*) as n from (select v, unnest(string_split(v, '')) as ch from t_{key} where v <> '') group by v, ch),
      h_{key} as (select t.v, least(1.0, coalesce(h, 0) / 6) as entropy, case when t.v = '' then 0 else greatest(length(regexp_replace(lower(t.v), '[^0-9a-f]', '', 'g')), length(regexp_replace(lower(t.v), '[^a-z2-7]', '', 'g'))) / cast(length(t.v) as double) end as encoded
            from t_{key} t left join (select v, sum(-(n / cast(length(v) as double)) * log2(n / cast(length(v) as double))) as h from c_{key} group by v) e on e.v = t.v)"""


_SAME = "filename, section_number, interface_id, stream_id, message_number, first_packet_number, transport"
_ALIKE = "filename, section_number, interface_id, first_packet_number, last_packet_number, stream_id, message_number, src_ip, dst_ip, src_port, dst_port, dns_id, dns_response, dns_question_name, dns_question_type, dns_question_class"


def _either(kind: str, client: bool) -> str:
    a, b = (f"src_{kind}", f"dst_{kind}") if client else (f"dst_{kind}", f"src_{kind}")
    return f"case when dns_response = false then {a} when dns_response = true then {b} when dst_port = 53 then {a} when src_port = 53 then {b} end"


_DNS = f"""
  with ips as ({ip_map([("read_dns_messages", "src_ip"), ("read_dns_messages", "dst_ip")])}),
  u as (select *, row_number() over (partition by {_SAME} order by filename) as dup from read_dns_messages),
  m as (select u.* exclude (src_ip, dst_ip, dup), s.host as src_ip, d.host as dst_ip, lower(dns_question_name) as qn from u left join ips s on s.raw = u.src_ip left join ips d on d.raw = u.dst_ip where dup = 1),
  names as (select distinct qn from m), {_psl("qn")}, {_looks("p", "left_payload", "lp")},
  o as (select m.*, row_number() over (partition by {_ALIKE} order by filename) as ordinal, p.* exclude (name), h.entropy, h.encoded from m left join p on p.name is not distinct from m.qn left join h_lp h on h.v = p.left_payload),
  f as (select filename as source_locator, concat_ws(':', cast(section_number as varchar), cast(interface_id as varchar), coalesce(cast(first_packet_number as varchar), ''), coalesce(cast(last_packet_number as varchar), ''), coalesce(cast(stream_id as varchar), 'udp'), coalesce(cast(message_number as varchar), ''), cast(ordinal as varchar)) as source_record_id,
    {_either("ip", True)} as client_ip, {_either("ip", False)} as resolver_ip, {_either("port", True)} as client_port, {_either("port", False)} as resolver_port,
    case when dns_response = false then 'query' when dns_response = true then 'response' else 'unknown' end as message_direction, coalesce(nullif(registrable_domain, ''), qn) as grouping_domain, nullif(public_suffix, '') as public_suffix, nullif(registrable_domain, '') as registrable_domain, suffix_section, suffix_rule,
    left_payload, length(left_payload) as left_payload_length, length(qn) as name_length, entropy as normalized_entropy, encoded as encoded_character_ratio, cast(len(dns_answers) as bigint) as answer_count, qn, dns_valid, dns_rcode, first_timestamp, last_timestamp, dns_truncated,
    {_flags([("first_timestamp is null", "missing_timestamp"), ("not dns_valid", "invalid_dns"), ("reassembly_status <> 'complete'", "incomplete_reassembly"), ("dns_truncated", "dns_truncated"), ("suffix_section = 'unknown'", "unknown_suffix"), ("dns_question_name is null", "missing_question")])} as quality_flags from o)
"""
_TUNNEL_SCORES = ("length", "entropy", "encoded", "uniqueness", "failure", "rate", "support", "span")
_KEYS = "client_ip, resolver_ip, grouping_domain, public_suffix, registrable_domain, suffix_section, suffix_rule"
_Q = "filter (where message_direction = 'query')"

ORACLE = {
    "ip_membership": f"""
      with ips as ({ip_map([("read_packets", "src_ip")])}), i as (select distinct src_ip as ip from read_packets)
      select ip, case when ip is null then null when strpos(ip, ':') > 0 then regexp_matches(host, '^fd3a:91c0:') else host like '10.%' end as is_local from i left join ips on raw = ip""",
    "psl_features": f"with names as (select distinct lower(dns_question_name) as qn from read_dns_messages), {_psl('qn')} select * from p",
    "name_looks": f"with {_looks('read_dns_messages', 'dns_question_name', 'q')}, n as (select distinct dns_question_name as name from read_dns_messages) select name, round(entropy, 6) as entropy, round(encoded, 6) as encoded from n left join h_q on v = name",
    "flow_connection_facts": f"""{_CONN}, l as (select f.* exclude (quality_flags, direction, initiator, local_ip, remote_ip, local_port, remote_port), case when endpoint_a_ip is null then null else endpoint_a_ip like '10.%' or endpoint_a_ip like 'fd3a:91c0:%' end as la, case when endpoint_b_ip is null then null else endpoint_b_ip like '10.%' or endpoint_b_ip like 'fd3a:91c0:%' end as lb, endpoint_a_port = endpoint_b_port as eq from f)
      select source_locator, cast(source_occurrence as varchar) || ':' || split_part(source_record_id, ':', 2) as source_record_id, source_occurrence, transport, endpoint_a_ip, endpoint_b_ip, endpoint_a_port, endpoint_b_port, case when eq then 'unknown' else 'a' end as initiator, initiator_basis, first_timestamp, last_timestamp, duration_us,
        {", ".join(f"{s}_{x}" for x in ("packets", "captured_bytes", "reported_bytes", "payload_bytes") for s in "ab")}, handshake_complete, partial_session, ambiguous, finalized_by,
        case when la is null or lb is null then 'unknown' when la and lb then 'internal' when not la and not lb then 'external' when eq then 'unknown' when la then 'outbound' else 'inbound' end as direction,
        {", ".join(f"case when la then endpoint_a_{x} when lb then endpoint_b_{x} end as local_{x}, case when la then endpoint_b_{x} when lb then endpoint_a_{x} end as remote_{x}" for x in ("ip", "port"))},
        {", ".join(f"case when la then a_{x} when lb then b_{x} end as local_{x}, case when la then b_{x} when lb then a_{x} end as remote_{x}" for x in ("packets", "captured_bytes", "reported_bytes", "payload_bytes"))},
        {_flags([("first_timestamp is null", "missing_timestamps"), ("partial_session", "partial_session"), ("ambiguous", "ambiguous_orientation"), ("finalized_by in ('eof', 'section_boundary')", "capture_boundary"), ("la is null or lb is null", "invalid_address")])} as quality_flags from l""",
    "talkers_host": _talkers("host", "payload_bytes", "all", 1000),
    "talkers_service": _talkers("service", "peers", "local_remote", 500),
    "long_connections": f"""{_CONN}, a as (select *, least(100.0, 50.0 + 25.0 * log2(greatest(1.0, duration_us / 3600000000.0))) as duration_score, case when not partial_session then 100.0 when finalized_by in ('eof', 'section_boundary') then 25.0 else 40.0 end as completeness_score from f where local_ip is not null and remote_ip is not null and duration_us >= 3600000000),
      s as (select *, cast(0.8 * cast(duration_score as double) + 0.2 * cast(completeness_score as double) as double) as score from a),
      r as (select *, row_number() over (order by score desc, duration_us desc, source_locator, source_record_id) as rank from s)
      select md5(concat_ws('|', 'pq-long-v1', 'balanced-v1', source_locator, source_record_id)) as finding_id, 'long_connection' as detector, 'pq-long-v1' as detector_version, 'balanced-v1' as profile, rank, source_locator, source_record_id, direction, local_ip, remote_ip, local_port, remote_port, endpoint_a_ip, endpoint_b_ip, endpoint_a_port, endpoint_b_port, transport, first_timestamp, last_timestamp, duration_us,
        {", ".join(f"{s}_{x}" for x in ("packets", "captured_bytes", "reported_bytes", "payload_bytes") for s in "ab")}, handshake_complete, partial_session, ambiguous, finalized_by, round(cast(duration_score as double), 6) as duration_score, round(cast(completeness_score as double), 6) as completeness_score, round(score, 6) as score,
        concat_ws('|', case when duration_score >= 100 then 'observed duration is at least four times the threshold' else 'observed duration meets the configured threshold' end, case when partial_session then 'session completeness is limited' end) as reasons, array_to_string(quality_flags, '|') as quality_flags from r where rank <= 1000""",
    "beacons": _beacons("local_remote", None, 2, 1000),
    "beacons_windowed": _beacons("outbound", DAY_US, 2, 100_000),
    "dns_fact_features": f"{_DNS} select source_locator, source_record_id, client_ip, resolver_ip, client_port, resolver_port, message_direction, grouping_domain, suffix_section, suffix_rule, left_payload_length, round(normalized_entropy, 6) as normalized_entropy, round(encoded_character_ratio, 6) as encoded_character_ratio, answer_count, quality_flags from f",
    "dns_tunnels": f"""{_DNS}, s as (select * from f where dns_valid and qn is not null and client_ip is not null and resolver_ip is not null),
      g as (select {_KEYS}, count(*) {_Q} as query_count, count(*) filter (where message_direction = 'response') as response_count, count(distinct qn) {_Q} as distinct_name_count, count(distinct left_payload) {_Q} as distinct_left_payload_count, min(first_timestamp) {_Q} as first_seen, max(first_timestamp) {_Q} as last_seen, max(last_timestamp) as last_observed,
        cast(median(name_length) {_Q} as double) as median_name_length, max(name_length) {_Q} as max_name_length, cast(median(left_payload_length) {_Q} as double) as median_left_payload_length, max(left_payload_length) {_Q} as max_left_payload_length,
        round(avg(normalized_entropy) filter (where message_direction = 'query' and left_payload_length > 0), 12) as mean_normalized_entropy, round(avg(encoded_character_ratio) filter (where message_direction = 'query' and left_payload_length > 0), 12) as mean_encoded_character_ratio,
        count(*) filter (where message_direction = 'response' and dns_rcode = 3) as nxdomain_count, count(*) filter (where message_direction = 'response' and answer_count = 0) as no_answer_count, bool_or(first_timestamp is null) as hm, bool_or(dns_truncated) as ht, bool_or(suffix_section = 'unknown') as hu from s group by {_KEYS} having count(*) {_Q} >= 3),
      w as (select *, epoch_us(last_seen) - epoch_us(first_seen) as active_span_us, distinct_name_count / cast(greatest(1, query_count) as double) as unique_name_ratio, nxdomain_count / cast(greatest(1, response_count) as double) as nxdomain_ratio, no_answer_count / cast(greatest(1, response_count) as double) as no_answer_ratio from g),
      c as (select *, query_count / greatest(1.0, floor(active_span_us / 1000.0) / 60000.0) as queries_per_minute, 100.0 * greatest(0.0, least(1.0, (median_left_payload_length - 12.0) / 40.0)) as length_score, 100.0 * coalesce(mean_normalized_entropy, 0.0) as entropy_score, 100.0 * coalesce(mean_encoded_character_ratio, 0.0) * greatest(0.0, least(1.0, (median_left_payload_length - 12.0) / 20.0)) as encoded_score,
        100.0 * unique_name_ratio as uniqueness_score, 100.0 * greatest(nxdomain_ratio, no_answer_ratio) as failure_score, least(100.0, 50.0 + 50.0 * (query_count - 3) / 3.0) as support_score, least(100.0, 100.0 * active_span_us / 60000000.0) as span_score from w),
      d as (select *, 100.0 * greatest(0.0, least(1.0, queries_per_minute / 30.0)) as rate_score from c),
      z as (select *, cast(0.2 * length_score + 0.2 * entropy_score + 0.1 * encoded_score + 0.2 * uniqueness_score + 0.1 * failure_score + 0.1 * rate_score + 0.05 * support_score + 0.05 * span_score as double) as score from d),
      r as (select *, row_number() over (order by score desc, query_count desc, client_ip, resolver_ip, grouping_domain) as rank from z where score >= 0)
      select 'dns_tunnel' as detector, 'pq-dns-tunnel-v1' as detector_version, 'balanced-v1' as profile, rank, {_KEYS}, first_seen as window_start, last_observed as window_end, first_seen, last_seen, active_span_us, query_count, response_count, distinct_name_count, distinct_left_payload_count, median_name_length, max_name_length, median_left_payload_length, max_left_payload_length,
        {", ".join(f"round(cast({x} as double), 6) as {x}" for x in ("mean_normalized_entropy", "mean_encoded_character_ratio", "nxdomain_ratio", "no_answer_ratio", "queries_per_minute", "unique_name_ratio", *[f"{s}_score" for s in _TUNNEL_SCORES], "score"))}, nxdomain_count, no_answer_count,
        {_flags([("length_score >= 75", "left-of-domain payloads are long"), ("entropy_score >= 75", "left-of-domain payloads have high character entropy"), ("encoded_score >= 90", "left-of-domain payloads resemble hex or base32 text"), ("uniqueness_score >= 75", "most queried names are distinct"), ("failure_score >= 50", "responses frequently fail or contain no answers"), ("rate_score >= 75", "query rate is high")])} as reasons,
        {_flags([("hm", "missing_timestamp"), ("ht", "dns_truncated"), ("hu", "unknown_suffix"), ("active_span_us < 60000000", "insufficient_span"), ("response_count = 0", "responses_not_observed"), ("query_count > 8", "evidence_truncated"), ("true", "cleartext_dns_only")])} as quality_flags, query_count > 8 as evidence_truncated from r""",
}
