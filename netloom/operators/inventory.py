"""One summary per capture: what it is, what is in it, and whether an earlier summary still holds."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from netloom.sources import decode as D
from netloom.sources.captures import expand
from netloom.sources.framing import NO_TIME, Capture, CaptureError, open_bytes

PROTOCOLS = ("ipv4_packets", "ipv6_packets", "tcp_packets", "udp_packets", "other_protocol_packets", "malformed_packets", "unsupported_packets", "fragment_packets")
CONTENT = ("capture_format", "link_types", "packet_count", "min_timestamp", "max_timestamp", "timestamp_null_count", "captured_bytes", "reported_bytes", *PROTOCOLS)
SCHEMA = (
    "filename string, input_index long, identity_type string, identity_value string, identity_strength string, file_size long, modification_time timestamp_ntz, capture_format string, link_types array<long>, packet_count long, min_timestamp timestamp_ntz, max_timestamp timestamp_ntz, timestamp_null_count long, captured_bytes long, reported_bytes long, detail string, "
    + ", ".join(f"{c} long" for c in PROTOCOLS)
    + ", scan_status string, scan_error string, inventory_time timestamp_ntz, source_scan_time timestamp_ntz, schema_version long, semantic_version long, metadata_unchanged boolean, reused boolean, catalog_validation string, reuse_reason string"
)
_EPOCH = datetime(1970, 1, 1)


def identity(path: str) -> dict:
    """What tells whether a file is still the same: place on disk, size and modification time. Weak: contents aren't read."""
    s = os.stat(path)
    value = hashlib.sha256(f"{s.st_dev}:{s.st_ino}:{s.st_size}:{s.st_mtime_ns}".encode()).hexdigest()[:16]
    return {"identity_type": "posix", "identity_value": value, "identity_strength": "weak", "file_size": s.st_size, "modification_time": _EPOCH + timedelta(microseconds=s.st_mtime_ns // 1000)}


def scan(path: str, protocols: bool) -> dict:
    """Content columns of a capture, from one pass over it."""
    capture = Capture(path, open_bytes(path))
    total = dict.fromkeys(("packet_count", "timestamp_null_count", "captured_bytes", "reported_bytes", *(PROTOCOLS if protocols else ())), 0)
    low = high = None
    for raw in capture.batches():
        ts = raw["ts"]
        timed = ts[ts != NO_TIME]
        total["packet_count"] += len(ts)
        total["timestamp_null_count"] += len(ts) - len(timed)
        total["captured_bytes"] += int(raw["captured_length"].sum())
        total["reported_bytes"] += int(raw["original_length"].sum())
        if len(timed):
            low = int(timed.min()) if low is None else min(low, int(timed.min()))
            high = int(timed.max()) if high is None else max(high, int(timed.max()))
        if protocols:
            p = D.Packets(capture.data, raw["packet_offset"], raw["captured_length"], raw["link_type"])
            unsupported = p.outcome == D.UNSUPPORTED
            other = p.network & (p.ip_protocol != 6) & (p.ip_protocol != 17) & unsupported
            masks = (p.network & (p.ip_version == 4), p.network & (p.ip_version == 6), p.tcp, p.udp, other, p.outcome == D.MALFORMED, unsupported, p.outcome == D.FRAGMENT)
            for c, m in zip(PROTOCOLS, masks, strict=True):
                total[c] += int(np.count_nonzero(m))
    stamp = {"min_timestamp": low, "max_timestamp": high}
    return total | {k: None if v is None else _EPOCH + timedelta(microseconds=v) for k, v in stamp.items()} | {"capture_format": capture.format, "link_types": sorted(capture.link_types), "scan_status": "truncated" if capture.truncated else "complete"}


def _one(path: str, index: int, previous: list[dict], protocols: bool, immutable: bool, report: bool, any_previous: bool) -> dict:
    now = datetime.now(UTC).replace(tzinfo=None)
    row: dict = {
        "filename": path, "input_index": index, "detail": "protocols" if protocols else "framing", "inventory_time": now, "source_scan_time": now, "schema_version": 1, "semantic_version": 1, "reused": False,
        "catalog_validation": "immutable" if immutable else "strict", "reuse_reason": "no_matching_summary" if any_previous else "no_previous_catalog",
    }
    try:
        before = identity(path)
        row |= before
        if previous:
            old = previous[0]
            facts = {tuple(repr(p[c]) for c in ("identity_value", *CONTENT)) for p in previous}
            fit = old["scan_status"] == "complete" and old["schema_version"] == 1 and old["semantic_version"] == 1 and (not protocols or old["detail"] == "protocols")
            row["reuse_reason"] = "strict_requires_scan" if not immutable else "conflicting_summaries" if len(facts) > 1 else "incompatible_summary" if not fit else "identity_changed_or_unavailable"
            if immutable and len(facts) == 1 and fit and old["identity_value"] == before["identity_value"] and old["file_size"] == before["file_size"]:
                row |= {c: old[c] for c in CONTENT if protocols or c not in PROTOCOLS}
                return row | {"scan_status": "complete", "metadata_unchanged": True, "reused": True, "source_scan_time": old["source_scan_time"], "reuse_reason": "immutable_metadata_match"}
        found = scan(path, protocols)
        if identity(path) != before:
            return row | {"scan_status": "changed", "scan_error": "Capture identity changed during inventory", "metadata_unchanged": False} if report else _raise(path)
        return row | found | {"metadata_unchanged": True}
    except (CaptureError, OSError) as e:
        if not report:
            raise
        return row | {"scan_status": "error", "scan_error": str(e)}


def _raise(path: str) -> dict:
    raise CaptureError(f"Capture '{path}': its identity changed during inventory")


def capture_inventory(spark: SparkSession, paths: str | list[str], detail: str = "framing", on_error: str = "error", previous_catalog: DataFrame | None = None, catalog_validation: str = "strict") -> DataFrame:
    """One row per capture that is named (a file named twice has two rows).

    ``detail="protocols"`` decodes headers too. ``on_error="report"`` makes a bad capture a row with its error, else it fails
    the query. With ``previous_catalog`` and ``catalog_validation="immutable"`` a file whose size, time and place are as
    they were takes its summary over; ``strict`` scans all. Captures are spread over tasks by size, largest first in turn.
    """
    if detail not in ("framing", "protocols"):
        raise ValueError("detail must be framing or protocols")
    if on_error not in ("error", "report"):
        raise ValueError("on_error must be error or report")
    if catalog_validation not in ("strict", "immutable"):
        raise ValueError("catalog_validation must be strict or immutable")
    files = [(p, i + 1) for i, p in enumerate(expand(paths))]
    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    names = spark.createDataFrame(sorted(((p, i, os.path.getsize(p)) for p, i in files), key=lambda x: -x[2]), "filename string, input_index long, size long")
    protocols, immutable, report, given = detail == "protocols", catalog_validation == "immutable", on_error == "report", previous_catalog is not None
    if previous_catalog is not None:
        kept = ["identity_value", "file_size", "detail", "scan_status", "schema_version", "semantic_version", "source_scan_time", *CONTENT]
        old = previous_catalog.groupBy("filename").agg(F.collect_list(F.struct(*kept)).alias("previous"))
        names = names.join(old, "filename", "left")
    else:
        names = names.withColumn("previous", F.lit(None).cast("array<struct<x:int>>"))
    arrow = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_one(r["filename"], r["input_index"], r["previous"] or [], protocols, immutable, report, given) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    return names.repartition(tasks).mapInArrow(run, SCHEMA)
