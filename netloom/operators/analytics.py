"""Explainable behavioural findings over connection and DNS facts from any source."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.names import SuffixRules, encoded_ratio, normalized_entropy, suffix_parts
from netloom.functions.network import ip_in_cidrs
from netloom.session import epoch_us, materialize

# The vocabularies below, and the detector versions, profile, reasons and flags named in the functions.
SCOPES = ("all", "outbound", "inbound", "local_remote", "internal", "external")
METRICS = ("payload_bytes", "captured_bytes", "reported_bytes", "packets", "connections", "peers")
_COUNTS = ("packets", "captured_bytes", "reported_bytes", "payload_bytes")
_ORIGIN_US = 946_857_600_000_000  # 2000-01-03, from which windows of a fixed width are counted
_DAY_US = 86_400_000_000


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _us(t: timedelta | int) -> int:
    return t if isinstance(t, int) else (t.days * 86_400 + t.seconds) * 1_000_000 + t.microseconds


def _timestamp(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def bucket_start(ts: Column, width_us: int) -> Column:
    """Start of the window of fixed width that holds a time, counted from Monday 2000-01-03; null for null."""
    us = epoch_us(ts)
    return _timestamp(us - F.pmod(us - F.lit(_ORIGIN_US), F.lit(width_us)))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _flags(**named: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))


def _texts(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))


def _top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows in order, with their ``rank``: each task keeps k rows, and only these meet in one place."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def in_scope(scope: str) -> Column:
    """Rows of connection facts that a scope admits."""
    if scope == "all":
        return F.lit(True)
    if scope == "local_remote":
        return F.col("local_ip").isNotNull() & F.col("remote_ip").isNotNull()
    return F.col("direction") == scope


def connection_facts(flows: DataFrame, local_networks: list[str] | None) -> DataFrame:
    """Flows as connections between endpoint a, which began it, and b, with direction and local and remote side."""
    a, b = ip_in_cidrs("orig_ip", local_networks), ip_in_cidrs("resp_ip", local_networks)
    f = flows.withColumn("_a", a).withColumn("_b", b)
    both_ways = F.col("simultaneous_open") | F.col("equal_endpoints")
    la, lb = F.col("_a"), F.col("_b")
    direction = F.when(la.isNull() | lb.isNull(), "unknown").when(la & lb, "internal").when(~la & ~lb, "external").when(both_ways, "unknown").when(la, "outbound").otherwise("inbound")

    def side(when_a: str, when_b: str) -> Column:
        return F.when(la, F.col(when_a)).when(lb, F.col(when_b))

    sides = [side(f"orig_{x}", f"resp_{x}").alias(f"local_{x}") for x in ("ip", "port", *_COUNTS)]
    others = [side(f"resp_{x}", f"orig_{x}").alias(f"remote_{x}") for x in ("ip", "port", *_COUNTS)]
    return f.select(
        F.col("filename").alias("source_locator"), F.concat_ws(":", "input_index", "flow_id").alias("source_record_id"), F.col("input_index").alias("source_occurrence"), "transport",
        F.col("orig_ip").alias("endpoint_a_ip"), F.col("resp_ip").alias("endpoint_b_ip"), F.col("orig_port").alias("endpoint_a_port"), F.col("resp_port").alias("endpoint_b_port"),
        F.when(both_ways, "unknown").otherwise("a").alias("initiator"), F.col("originator_basis").alias("initiator_basis"),
        "first_timestamp", "last_timestamp", "duration", "duration_us",
        *[F.col(f"{s}_{x}").alias(f"{n}_{x}") for x in _COUNTS for s, n in (("orig", "a"), ("resp", "b"))],
        "handshake_complete", "partial_session", "ambiguous", "finalized_by", direction.alias("direction"),
        *[x for pair in zip(sides, others, strict=True) for x in pair],
        _flags(
            missing_timestamps=(F.col("missing_timestamp_packets") > 0) | F.col("first_timestamp").isNull(), late_packets=F.col("late_packets") > 0, partial_session=F.col("partial_session"),
            ambiguous_orientation=F.col("ambiguous"), capture_boundary=F.col("finalized_by").isin("eof", "section_boundary"), invalid_address=la.isNull() | lb.isNull(),
        ).alias("quality_flags"),
    )


def summarize_talkers(facts: DataFrame, by: str = "host", metric: str = "payload_bytes", scope: str = "all", max_results: int = 100) -> DataFrame:
    """Totals of the busiest hosts or services (host, transport, port), ranked by a metric.

    Each connection counts for the endpoints on the side its scope looks at. Facts are read once, both endpoints of a row
    come out of one generator, and totals are combined on the map side. Empty facts give no rows.
    """
    _check(by in ("host", "service"), "summarize_talkers: by must be host or service")
    _check(metric in METRICS, f"summarize_talkers: metric must be one of {METRICS}")
    _check(scope in SCOPES, f"summarize_talkers: scope must be one of {SCOPES}")
    _check(max_results > 0, "summarize_talkers: max_results must be positive")

    def end(me: str, peer: str, away: str) -> Column:
        counts = [F.col(f"{s}_{x}").alias(f"{n}_{x}") for x in _COUNTS for s, n in ((me, "sent"), (peer, "received"))]
        row = F.struct(F.col(f"endpoint_{me}_ip").alias("endpoint_ip"), F.col(f"endpoint_{peer}_ip").alias("peer_ip"), F.col(f"endpoint_{me}_port").alias("port"), *counts)
        mine = F.col("direction").isin("internal", "external", away) | ((F.col("direction") == "unknown") & (F.col(f"endpoint_{me}_ip") == F.col("local_ip")))
        return F.when(F.lit(True) if scope == "all" else F.coalesce(mine, F.lit(False)), row)

    ends = facts.filter(in_scope(scope)).select("transport", "direction", "first_timestamp", "last_timestamp", F.explode(F.array_compact(F.array(end("a", "b", "outbound"), end("b", "a", "inbound")))).alias("e"))
    rows = ends.select("direction", "first_timestamp", "last_timestamp", "e.*", "transport")
    keys = ["endpoint_ip"] + (["transport", "port"] if by == "service" else [])
    sums = [F.sum(f"{n}_{x}").alias(f"{n}_{x}") for x in _COUNTS for n in ("sent", "received")]
    totals = rows.groupBy(*keys).agg(
        *sums, *[F.sum(F.col(f"sent_{x}") + F.col(f"received_{x}")).alias(f"total_{x}") for x in _COUNTS],
        F.when((F.min("direction") == F.max("direction")), F.min("direction")).otherwise("mixed").alias("direction"),
        F.count(F.lit(1)).alias("connection_count"), F.countDistinct("peer_ip").alias("peer_count"), F.min("first_timestamp").alias("first_seen"), F.max("last_timestamp").alias("last_seen"),
    )
    if by == "host":
        totals = totals.withColumn("transport", F.lit(None).cast("string")).withColumn("port", F.lit(None).cast("int"))
    chosen = {"connections": "connection_count", "peers": "peer_count"}.get(metric, f"total_{metric}")
    out = totals.withColumn("selected_metric_value", F.col(chosen)).withColumn("grouping", F.lit(by)).withColumn("metric", F.lit(metric))
    order = [F.col("selected_metric_value").desc_nulls_last(), F.col("endpoint_ip").asc_nulls_last(), F.col("transport").asc_nulls_first(), F.col("port").asc_nulls_first()]
    return _top(out, order, max_results).select(
        "rank", "grouping", "metric", "selected_metric_value", "endpoint_ip", "transport", "port", "direction",
        *[f"{n}_{x}" for x in _COUNTS for n in ("sent", "received", "total")], "connection_count", "peer_count", "first_seen", "last_seen",
    )


def analyze_long_connections(facts: DataFrame, scope: str = "local_remote", min_duration: timedelta | int = timedelta(hours=1), include_partial: bool = True, min_score: float = 0, max_results: int = 1000, profile: str = "balanced-v1") -> DataFrame:
    """Connections at least as long as ``min_duration``, scored by duration and completeness."""
    limit = _us(min_duration)
    _check(scope in SCOPES, f"analyze_long_connections: scope must be one of {SCOPES}")
    _check(limit >= 0, "analyze_long_connections: min_duration must be nonnegative")
    _check(0 <= min_score <= 100, "analyze_long_connections: min_score must be between 0 and 100")
    _check(max_results > 0, "analyze_long_connections: max_results must be positive")
    _check(profile == "balanced-v1", "analyze_long_connections: profile must be balanced-v1")
    rows = facts.filter(in_scope(scope) & (F.col("duration_us") >= limit))
    if not include_partial:
        rows = rows.filter(~F.col("partial_session"))
    length = F.least(F.lit(100.0), 50.0 + 25.0 * F.log2(F.greatest(F.lit(1.0), F.col("duration_us").cast("double") / max(1.0, float(limit)))))
    whole = F.when(~F.col("partial_session"), 100.0).when(F.col("finalized_by").isin("eof", "section_boundary"), 25.0).otherwise(40.0)
    rows = rows.withColumn("duration_score", length).withColumn("completeness_score", whole).withColumn("score", 0.8 * F.col("duration_score") + 0.2 * F.col("completeness_score"))
    order = [F.col("score").desc(), F.col("duration_us").desc(), F.col("source_locator"), F.col("source_record_id")]
    top = _top(rows.filter(F.col("score") >= min_score), order, max_results)
    keep = [c for c in (
        "direction", "local_ip", "remote_ip", "local_port", "remote_port", "endpoint_a_ip", "endpoint_b_ip", "endpoint_a_port", "endpoint_b_port", "transport", "first_timestamp", "last_timestamp", "duration", "duration_us",
        *[f"{s}_{x}" for x in _COUNTS for s in "ab"], "handshake_complete", "partial_session", "ambiguous", "finalized_by",
    ) if c in facts.columns]
    return top.select(
        F.md5(F.concat_ws("|", F.lit("pq-long-v1"), F.lit(profile), "source_locator", "source_record_id")).alias("finding_id"), F.lit("long_connection").alias("detector"), F.lit("pq-long-v1").alias("detector_version"),
        F.lit(profile).alias("profile"), "rank", "source_locator", "source_record_id", *keep, "duration_score", "completeness_score", "score",
        F.array_compact(F.array(
            F.when(F.col("duration_score") >= 100, "observed duration is at least four times the threshold").otherwise("observed duration meets the configured threshold"),
            F.when(F.col("partial_session"), "session completeness is limited"),
        )).alias("reasons"), "quality_flags",
    )


def _spread(rows: DataFrame, keys: list[str], value: str, quartiles: bool = False) -> DataFrame:
    """Exact median and median absolute deviation (and quartiles) of a value per group.

    Values are first counted, on the map side too, so a hot group shuffles each different value once.
    """
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    marks = {"median": 0.5} | ({"q1": 0.25, "q3": 0.75} if quartiles else {})
    middle = counted.groupBy(*keys).agg(F.percentile(value, list(marks.values()), F.col("_n")).alias("_p"), F.sum("_n").alias(f"{value}_count"))
    middle = middle.select(*keys, f"{value}_count", *[F.col("_p")[i].alias(f"{value}_{m}") for i, m in enumerate(marks)])
    a, b = counted.alias("a"), middle.alias("b")
    both = a.join(b, _same(a, b, keys, "a", "b")).select(*[F.col(f"a.{k}") for k in keys], F.abs(F.col(f"a.{value}") - F.col(f"b.{value}_median")).alias("_d"), "a._n")
    off = both.groupBy(*keys).agg(F.percentile("_d", 0.5, F.col("_n")).alias(f"{value}_mad"))
    return _join(middle, off, keys)


def _same(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}"))
    return out


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null (null equals null), keeping the left keys once."""
    a, b = left.alias("l"), right.alias("r")
    return a.join(b, _same(a, b, keys, "l", "r"), how).select("l.*", *[F.col(f"r.`{c}`") for c in right.columns if c not in keys])


def _pauses(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Milliseconds between neighbouring different times of each group, one row each, as ``interval_ms``.

    Times are taken apart by day, so a hot group is spread; the pause between two days with times comes from the first and
    last time of each day, of which a group has one row per day.
    """
    starts = rows.filter(F.col(ts).isNotNull()).select(*keys, epoch_us(F.col(ts)).alias("_us"), F.floor(epoch_us(F.col(ts)) / _DAY_US).alias("_day")).distinct()
    inner = starts.withColumn("_d", F.col("_us") - F.lag("_us").over(Window.partitionBy(*keys, "_day").orderBy("_us")))
    days = starts.groupBy(*keys, "_day").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    across = days.withColumn("_d", F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*keys).orderBy("_day")))
    both = inner.select(*keys, "_d").unionByName(across.select(*keys, "_d")).filter("_d is not null")
    return both.select(*keys, (F.col("_d") / 1000.0).alias("interval_ms"))


def _evidence(rows: DataFrame, keys: list[str], first: list[Column], what: Column, k: int) -> DataFrame:
    """The first ``k`` rows of each group as an array; Spark's group limit keeps k rows per group and task."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*first))
    few = rows.withColumn("_k", place).filter(F.col("_k") <= k)
    return few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", what.alias("v")))), lambda x: x["v"]).alias("evidence"))


def analyze_beacons(facts: DataFrame, scope: str = "outbound", group_by: str = "service", window: timedelta | int | None = None, min_connections: int = 6, min_span: timedelta | int = timedelta(minutes=5), min_score: float = 0, max_results: int = 1000, evidence_rows: int = 8, profile: str = "balanced-v1") -> DataFrame:
    """Groups of connections of a local host to a remote service that start at regular intervals."""
    span_us, width = _us(min_span), None if window is None else _us(window)
    _check(scope in ("outbound", "inbound", "local_remote"), "analyze_beacons: scope must be outbound, inbound, or local_remote")
    _check(group_by == "service", "analyze_beacons: group_by must be service")
    _check(min_connections >= 2, "analyze_beacons: min_connections must be at least 2")
    _check(span_us >= 0, "analyze_beacons: min_span must be nonnegative")
    _check(0 <= min_score <= 100, "analyze_beacons: min_score must be between 0 and 100")
    _check(max_results > 0, "analyze_beacons: max_results must be positive")
    _check(0 <= evidence_rows <= 1024, "analyze_beacons: evidence_rows must be between 0 and 1024")
    _check(profile == "balanced-v1", "analyze_beacons: profile must be balanced-v1")
    _check(width is None or width > 0, "analyze_beacons: window must be positive")
    keys = ["local_ip", "remote_ip", "remote_port", "transport", "direction", "window_bucket"]
    bucket = F.lit(None).cast("timestamp_ntz") if width is None else bucket_start(F.col("first_timestamp"), width)
    rows = facts.filter(in_scope(scope)).withColumn("window_bucket", bucket).withColumn("payload_bytes", F.col("a_payload_bytes") + F.col("b_payload_bytes"))
    # Four aggregates read these rows: they are worked out once, in the shared folder, with only the columns needed.
    rows = materialize(rows.select(*keys, "payload_bytes", "source_locator", "source_record_id", "first_timestamp", "last_timestamp", "duration_us", "quality_flags"), "beacons")

    def has(flag: str) -> Column:
        return F.max(F.array_contains("quality_flags", flag)).alias(f"has_{flag}")

    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("connection_count"), F.count("first_timestamp").alias("timed_connection_count"), F.min("first_timestamp").alias("first_seen"), F.max("first_timestamp").alias("last_seen"), F.max("last_timestamp").alias("last_observed"),
        F.sum(F.xxhash64("source_locator", "source_record_id").cast("decimal(38,0)")).alias("evidence_digest"),
        *[has(f) for f in ("missing_timestamps", "late_packets", "partial_session", "ambiguous_orientation", "capture_boundary")],
    ).filter(F.col("connection_count") >= min_connections)
    shown = F.struct("source_locator", "source_record_id", F.col("first_timestamp").alias("started_at"), "payload_bytes", "duration_us")
    m = _join(groups, _spread(rows, keys, "payload_bytes"), keys)
    m = _join(m, _spread(_pauses(rows, keys, "first_timestamp"), keys, "interval_ms", quartiles=True), keys)
    m = _join(m, _evidence(rows, keys, [F.col("first_timestamp").asc_nulls_last(), F.col("source_locator"), F.col("source_record_id")], shown, evidence_rows), keys)
    q1, q2, q3 = F.col("interval_ms_q1"), F.col("interval_ms_median"), F.col("interval_ms_q3")
    n = F.col("connection_count")
    m = m.withColumn("observation_span_us", epoch_us(F.col("last_seen")) - epoch_us(F.col("first_seen")))
    m = m.withColumn("timing_score", F.when((F.col("interval_ms_count") >= 3) & (q2 > 0), 100.0 * _unit(1.0 - 4.0 * F.col("interval_ms_mad") / q2)))
    m = m.withColumn("size_score", 100.0 * _unit(1.0 - 2.0 * F.col("payload_bytes_mad") / F.greatest(F.lit(1.0), F.col("payload_bytes_median"))))
    m = m.withColumn("support_score", F.least(F.lit(100.0), 50.0 + 50.0 * (n - min_connections).cast("double") / max(1.0, float(min_connections))))
    m = m.withColumn("span_score", F.lit(100.0) if span_us == 0 else F.least(F.lit(100.0), 50.0 * F.col("observation_span_us").cast("double") / float(span_us)))
    m = m.withColumn("score", F.when(F.col("timing_score").isNotNull(), 0.50 * F.col("timing_score") + 0.20 * F.col("size_score") + 0.15 * F.col("support_score") + 0.15 * F.col("span_score")))
    kept = m.filter((F.col("score") >= min_score) | (F.col("score").isNull() if min_score == 0 else F.lit(False)))
    order = [F.col("score").desc_nulls_last(), n.desc(), *[F.col(c).asc_nulls_last() for c in ("local_ip", "remote_ip", "transport", "remote_port", "direction")]]
    top = _top(kept, [*order, F.col("window_bucket").asc_nulls_first()], max_results)
    ident = F.md5(F.concat_ws("|", F.lit("pq-beacon-v1"), F.lit(profile), "local_ip", "remote_ip", "transport", F.col("remote_port").cast("string"), "direction", F.coalesce(F.col("window_bucket").cast("string"), F.lit("")), F.col("evidence_digest").cast("string")))
    return top.select(
        ident.alias("finding_id"), F.lit("beacon").alias("detector"), F.lit("pq-beacon-v1").alias("detector_version"), F.lit(profile).alias("profile"), "rank", *keys[:3], "transport", "direction",
        F.coalesce("window_bucket", "first_seen").alias("window_start"), (F.col("last_observed") if width is None else F.coalesce(_timestamp(epoch_us(F.col("window_bucket")) + width), F.col("last_observed"))).alias("window_end"),
        "first_seen", "last_seen", "connection_count", "timed_connection_count", "observation_span_us", q2.alias("median_interval_ms"), F.col("interval_ms_mad").alias("interval_mad_ms"), q1.alias("interval_q1_ms"), q3.alias("interval_q3_ms"),
        F.when(q3 > q1, (q3 + q1 - 2.0 * q2) / (q3 - q1)).alias("interval_bowley_skew"), F.col("payload_bytes_median").alias("median_payload_bytes"), F.col("payload_bytes_mad").alias("payload_mad_bytes"),
        "timing_score", "size_score", "support_score", "span_score", "score",
        _texts(
            (F.col("timing_score") >= 75, "connection starts have low interval dispersion"), (F.col("size_score") >= 75, "connection payload sizes have low dispersion"),
            (F.col("support_score") >= 75, "connection count provides strong support"), (F.col("span_score") >= 75, "observations span the configured minimum"),
        ).alias("reasons"),
        _flags(
            missing_timestamps=F.col("has_missing_timestamps"), late_packets=F.col("has_late_packets"), partial_session=F.col("has_partial_session"), ambiguous_orientation=F.col("has_ambiguous_orientation"), capture_boundary=F.col("has_capture_boundary"),
            insufficient_intervals=F.coalesce(F.col("interval_ms_count"), F.lit(0)) < 3, insufficient_span=F.col("observation_span_us") < span_us, evidence_truncated=n > evidence_rows,
        ).alias("quality_flags"),
        F.coalesce("evidence", F.array().cast(m.schema["evidence"].dataType)).alias("evidence"), (n > evidence_rows).alias("evidence_truncated"),
    )


def dns_facts(messages: DataFrame, rules: SuffixRules) -> DataFrame:
    """DNS messages as facts of a client asking a resolver, with the parts and the looks of the name."""
    reply, to53, from53 = F.col("dns_response"), F.col("dst_port") == 53, F.col("src_port") == 53

    def of(kind: str, client: bool) -> Column:
        mine, other = (f"src_{kind}", f"dst_{kind}") if client else (f"dst_{kind}", f"src_{kind}")
        return F.when(reply == F.lit(False), F.col(mine)).when(reply, F.col(other)).when(to53, F.col(mine)).when(from53, F.col(other))

    same = ["filename", "section_number", "interface_id", "first_packet_number", "last_packet_number", "stream_id", "message_number", "src_ip", "dst_ip", "src_port", "dst_port", "dns_id", "dns_response", "dns_question_name", "dns_question_type", "dns_question_class"]
    m = messages.withColumn("_ordinal", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1)))).withColumn("question_name_normalized", F.lower("dns_question_name"))
    m = m.withColumn("_s", suffix_parts("question_name_normalized", rules))
    if "reassembly_error" not in m.columns:
        m = m.withColumn("reassembly_error", F.lit(None).cast("string"))

    def text(c: str, otherwise: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(otherwise))

    ident = F.concat_ws(":", F.col("section_number").cast("string"), F.col("interface_id").cast("string"), text("first_packet_number", ""), text("last_packet_number", ""), text("stream_id", "udp"), text("message_number", ""), F.col("_ordinal").cast("string"))
    left = F.col("_s.left_payload")
    return m.select(
        F.col("filename").alias("source_locator"), ident.alias("source_record_id"), "section_number", "interface_id", "first_packet_number", "last_packet_number", "first_timestamp", "last_timestamp", "transport",
        of("ip", True).alias("client_ip"), of("ip", False).alias("resolver_ip"), of("port", True).alias("client_port"), of("port", False).alias("resolver_port"),
        F.when(reply == F.lit(False), "query").when(reply, "response").otherwise("unknown").alias("message_direction"), "dns_valid", "dns_id", "dns_opcode", "dns_rcode", "dns_truncated",
        F.col("dns_question_name").alias("question_name"), "question_name_normalized", F.col("dns_question_type").alias("question_type"), F.col("dns_question_class").alias("question_class"),
        F.col("dns_answers").alias("answers"), F.when(F.col("dns_answers").isNotNull(), F.size("dns_answers").cast("long")).alias("answer_count"),
        F.nullif(F.col("_s.public_suffix"), F.lit("")).alias("public_suffix"), F.nullif(F.col("_s.registrable_domain"), F.lit("")).alias("registrable_domain"),
        F.coalesce(F.nullif(F.col("_s.registrable_domain"), F.lit("")), F.col("question_name_normalized")).alias("grouping_domain"), F.col("_s.suffix_section").alias("suffix_section"), F.col("_s.suffix_rule").alias("suffix_rule"),
        left.alias("left_payload"), F.length("question_name_normalized").cast("long").alias("name_length"), F.length(left).cast("long").alias("left_payload_length"),
        normalized_entropy(left).alias("normalized_entropy"), encoded_ratio(left).alias("encoded_character_ratio"), "reassembly_status", "reassembly_error", "dns_error",
        _flags(
            missing_timestamp=F.col("first_timestamp").isNull(), invalid_dns=~F.col("dns_valid"), incomplete_reassembly=F.col("reassembly_status") != "complete", dns_truncated=F.col("dns_truncated"),
            unknown_suffix=F.col("_s.suffix_section") == "unknown", missing_question=F.col("dns_question_name").isNull(),
        ).alias("quality_flags"),
    )


def analyze_dns_tunnels(facts: DataFrame, window: timedelta | int | None = None, min_queries: int = 20, min_span: timedelta | int = timedelta(minutes=1), min_score: float = 0, max_results: int = 1000, evidence_rows: int = 8, profile: str = "balanced-v1", suffix_list_version: str = "") -> DataFrame:
    """Groups of DNS messages of a client about one domain whose names look like carried data."""
    span_us, width = _us(min_span), None if window is None else _us(window)
    _check(width is None or width > 0, "analyze_dns_tunnels: window must be positive")
    _check(min_queries >= 2, "analyze_dns_tunnels: min_queries must be at least 2")
    _check(span_us >= 0, "analyze_dns_tunnels: min_span must be nonnegative")
    _check(0 <= min_score <= 100, "analyze_dns_tunnels: min_score must be between 0 and 100")
    _check(max_results > 0, "analyze_dns_tunnels: max_results must be positive")
    _check(0 <= evidence_rows <= 1024, "analyze_dns_tunnels: evidence_rows must be between 0 and 1024")
    _check(profile == "balanced-v1", "analyze_dns_tunnels: profile must be balanced-v1")
    keys = ["client_ip", "resolver_ip", "grouping_domain", "window_bucket"]
    more = ["public_suffix", "registrable_domain", "suffix_section", "suffix_rule"]
    bucket = F.lit(None).cast("timestamp_ntz") if width is None else bucket_start(F.col("first_timestamp"), width)
    rows = facts.filter(F.col("dns_valid") & F.col("question_name_normalized").isNotNull() & F.col("client_ip").isNotNull() & F.col("resolver_ip").isNotNull()).withColumn("window_bucket", bucket)
    rows = materialize(rows.select(
        *keys, *more, "message_direction", "source_locator", "source_record_id", "first_timestamp", "last_timestamp", "question_name", "question_name_normalized", "question_type",
        "name_length", "left_payload", "left_payload_length", "normalized_entropy", "encoded_character_ratio", "dns_rcode", "answer_count", "quality_flags",
    ), "tunnels")
    asked, told = F.col("message_direction") == "query", F.col("message_direction") == "response"

    def q(c: str) -> Column:
        return F.when(asked, F.col(c))

    def has(flag: str) -> Column:
        return F.max(F.array_contains("quality_flags", flag)).alias(f"has_{flag}")

    looks = asked & (F.col("left_payload_length") > 0)
    # Counts of different names go over one row per name, so that no group's names meet in one task before they are few.
    plain = rows.groupBy(*keys, *more).agg(
        F.count(q("message_direction")).alias("query_count"), F.count(F.when(told, 1)).alias("response_count"), F.min(q("first_timestamp")).alias("first_seen"), F.max(q("first_timestamp")).alias("last_seen"), F.max("last_timestamp").alias("last_observed"),
        F.max(q("name_length")).alias("max_name_length"), F.max(q("left_payload_length")).alias("max_left_payload_length"),
        F.round(F.avg(F.when(looks, F.col("normalized_entropy"))), 12).alias("mean_normalized_entropy"), F.round(F.avg(F.when(looks, F.col("encoded_character_ratio"))), 12).alias("mean_encoded_character_ratio"),
        F.count(F.when(told & (F.col("dns_rcode") == 3), 1)).alias("nxdomain_count"), F.count(F.when(told & (F.col("answer_count") == 0), 1)).alias("no_answer_count"),
        F.percentile(q("name_length"), 0.5).alias("median_name_length"), F.percentile(q("left_payload_length"), 0.5).alias("median_left_payload_length"),
        F.sum(F.xxhash64("source_locator", "source_record_id").cast("decimal(38,0)")).alias("evidence_digest"), *[has(f) for f in ("missing_timestamp", "dns_truncated", "unknown_suffix")],
    ).filter(F.col("query_count") >= min_queries)
    asks = rows.filter(asked)
    names = asks.select(*keys, "question_name_normalized").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_name_count"))
    lefts = asks.filter(F.col("left_payload").isNotNull()).select(*keys, "left_payload").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_left_payload_count"))
    types = asks.groupBy(*keys, "question_type").agg(F.count(F.lit(1)).alias("query_count")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("question_type", "query_count"))).alias("question_types"))
    shown = F.struct("source_locator", "source_record_id", F.col("first_timestamp").alias("observed_at"), "question_name", "question_type")
    proof = _evidence(asks, keys, [F.col("first_timestamp").asc_nulls_last(), F.col("source_locator"), F.col("source_record_id")], shown, evidence_rows)
    m = plain
    for extra in (names, lefts, types, proof):
        m = _join(m, extra, keys)
    d, length = "double", F.col("median_left_payload_length")
    m = m.withColumn("active_span_us", epoch_us(F.col("last_seen")) - epoch_us(F.col("first_seen")))
    m = m.withColumn("distinct_left_payload_count", F.coalesce("distinct_left_payload_count", F.lit(0)))
    minutes = F.floor(F.col("active_span_us") / 1000).cast(d) / 60000.0
    m = m.withColumn("queries_per_minute", F.col("query_count").cast(d) / F.greatest(F.lit(1.0), minutes)).withColumn("unique_name_ratio", F.col("distinct_name_count").cast(d) / F.greatest(F.lit(1.0), F.col("query_count").cast(d)))
    for c in ("nxdomain", "no_answer"):
        m = m.withColumn(f"{c}_ratio", F.col(f"{c}_count").cast(d) / F.greatest(F.lit(1.0), F.col("response_count").cast(d)))
    scores = {
        "length": 100.0 * _unit((length - 12.0) / 40.0), "entropy": 100.0 * F.coalesce("mean_normalized_entropy", F.lit(0.0)),
        "encoded": 100.0 * F.coalesce("mean_encoded_character_ratio", F.lit(0.0)) * _unit((length - 12.0) / 20.0), "uniqueness": 100.0 * F.col("unique_name_ratio"),
        "failure": 100.0 * F.greatest("nxdomain_ratio", "no_answer_ratio"), "rate": 100.0 * _unit(F.col("queries_per_minute") / 30.0),
        "support": F.least(F.lit(100.0), 50.0 + 50.0 * (F.col("query_count") - min_queries).cast(d) / max(1.0, float(min_queries))),
        "span": F.lit(100.0) if span_us == 0 else F.least(F.lit(100.0), 100.0 * F.col("active_span_us").cast(d) / float(span_us)),
    }
    for c, v in scores.items():
        m = m.withColumn(f"{c}_score", v)
    weights = {"length": 0.20, "entropy": 0.20, "encoded": 0.10, "uniqueness": 0.20, "failure": 0.10, "rate": 0.10, "support": 0.05, "span": 0.05}
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * F.col(f"{c}_score")
    m = m.withColumn("score", total).filter(F.col("score") >= min_score)
    order = [F.col("score").desc(), F.col("query_count").desc(), F.col("client_ip"), F.col("resolver_ip"), F.col("grouping_domain"), F.col("window_bucket").asc_nulls_first()]
    top = _top(m, order, max_results)
    ident = F.md5(F.concat_ws("|", F.lit("pq-dns-tunnel-v1"), F.lit(profile), "client_ip", "resolver_ip", "grouping_domain", F.coalesce(F.col("window_bucket").cast("string"), F.lit("")), F.col("evidence_digest").cast("string")))
    return top.select(
        ident.alias("finding_id"), F.lit("dns_tunnel").alias("detector"), F.lit("pq-dns-tunnel-v1").alias("detector_version"), F.lit(profile).alias("profile"), F.lit(suffix_list_version).alias("suffix_list_version"), "rank", *keys[:3], *more,
        F.coalesce("window_bucket", "first_seen").alias("window_start"), (F.col("last_observed") if width is None else F.coalesce(_timestamp(epoch_us(F.col("window_bucket")) + width), F.col("last_observed"))).alias("window_end"),
        "first_seen", "last_seen", "active_span_us", "query_count", "response_count", "distinct_name_count", "distinct_left_payload_count", "question_types", "median_name_length", "max_name_length", "median_left_payload_length", "max_left_payload_length",
        "mean_normalized_entropy", "mean_encoded_character_ratio", "nxdomain_count", "no_answer_count", "nxdomain_ratio", "no_answer_ratio", "queries_per_minute", "unique_name_ratio", *[f"{c}_score" for c in scores], "score",
        _texts(
            (F.col("length_score") >= 75, "left-of-domain payloads are long"), (F.col("entropy_score") >= 75, "left-of-domain payloads have high character entropy"), (F.col("encoded_score") >= 90, "left-of-domain payloads resemble hex or base32 text"),
            (F.col("uniqueness_score") >= 75, "most queried names are distinct"), (F.col("failure_score") >= 50, "responses frequently fail or contain no answers"), (F.col("rate_score") >= 75, "query rate is high"),
        ).alias("reasons"),
        _flags(
            missing_timestamp=F.col("has_missing_timestamp"), dns_truncated=F.col("has_dns_truncated"), unknown_suffix=F.col("has_unknown_suffix"), insufficient_span=F.col("active_span_us") < span_us,
            responses_not_observed=F.col("response_count") == 0, evidence_truncated=F.col("query_count") > evidence_rows, cleartext_dns_only=F.lit(True),
        ).alias("quality_flags"),
        F.coalesce("evidence", F.array().cast(m.schema["evidence"].dataType)).alias("evidence"), (F.col("query_count") > evidence_rows).alias("evidence_truncated"),
    )
