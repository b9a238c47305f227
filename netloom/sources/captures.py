"""Captures as a Spark data source: raw records, decoded packets, and packets with a DNS message."""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from netloom.sources import decode as D
from netloom.sources.columns import values
from netloom.sources.dns import FIELDS as DNS_FIELDS
from netloom.sources.dns import decode_packet
from netloom.sources.framing import NO_TIME, Capture, open_bytes
from netloom.sources.tls_record import FIELDS as TLS_FIELDS
from netloom.sources.tls_record import TYPES, record_fields

RAW = "filename string, packet_number long, timestamp timestamp_ntz, captured_length long, original_length long, link_type long, interface_id long, packet_offset long, capture_format string, packet_data binary, section_number long"
_LINK = "src_mac string, dst_mac string, ether_type int, vlan_ids array<int>"
_NETWORK = "ip_version short, src_ip string, dst_ip string, ip_protocol short, ip_ttl short, ip_fragment_offset int, ip_more_fragments boolean, ip_id long"
_TRANSPORT = "src_port int, dst_port int, tcp_flags int, tcp_seq long, tcp_ack long, tcp_header_length int, udp_length int, payload_offset long, payload_length long, tcp_fin boolean, tcp_syn boolean, tcp_rst boolean, tcp_psh boolean, tcp_ack_flag boolean, tcp_urg boolean, tcp_ece boolean, tcp_cwr boolean"
_TLS = "is_tls boolean, tls_record_type short, tls_record_version int, tls_handshake_type short, tls_sni string, tls_truncated boolean"
_RR = "array<struct<name:string,type:int,class:int,ttl:long,value:string,data:binary>>"
DNS = f"dns_valid boolean, dns_id int, dns_response boolean, dns_opcode short, dns_rcode short, dns_truncated boolean, dns_question_name string, dns_question_type int, dns_question_class int, dns_questions array<struct<name:string,type:int,class:int>>, dns_answers {_RR}, dns_authorities {_RR}, dns_additionals {_RR}, dns_error string"
PACKETS = ", ".join([RAW, _LINK, _NETWORK, _TRANSPORT, _TLS])
LAYERS = {"pcap": RAW, "packets": PACKETS, "dns": f"{PACKETS}, {DNS}"}
#: Extra columns that other operators ask for: which input a row is from, counted from 1, and of how many; clocks (see
#: ``CLOCKS``); the transport payload as captured, and its declared size.
EXTRA = "input_index long, input_count long, tcp_clock long, tcp_final_clock long, tcp_final_packet long, payload binary, payload_declared_length long, decode_outcome string, clock long, late boolean, final_clock long, final_packet long, last_section boolean"
#: Of these, what depends on all packets of an interface: see ``netloom.operators.ordered.with_clock``.
CLOCKS = {"clock", "late", "final_clock", "final_packet", "last_section"}
#: The same, but moved by packets with a whole TCP header only: see ``netloom.operators.streams.directions``.
TCP_CLOCKS = {"tcp_clock", "tcp_final_clock", "tcp_final_packet"}
_OUTCOMES = np.array(["not_requested", "decoded", "malformed", "unsupported", "fragment"], object)


_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "integer": pa.int32(), "double": pa.float64(), "date": pa.date32(), "boolean": pa.bool_(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us")}


def _names(ddl: str) -> list[str]:
    """Column names of a schema text; its nested types hold neither a comma with a blank after it nor a blank."""
    return [c.split(" ")[0] for c in ddl.split(", ")]


_DEPTH = dict.fromkeys(_names(_LINK), D.LINK) | dict.fromkeys(_names(_NETWORK), D.NETWORK) | dict.fromkeys([*_names(_TRANSPORT), *_names(_TLS), *_names(DNS), "payload", "payload_declared_length", "decode_outcome"], D.TRANSPORT)
_RAW_NAMES = set(_names(RAW)) - {"packet_data"}
#: Bytes of captures that one task reads, about; a larger file is one task.
TASK_BYTES = 64 << 20


def expand(paths: str | list[str]) -> list[str]:
    """Files of paths and patterns, in order; patterns give theirs sorted; a file named twice is there twice."""
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else list(paths):
        p = p[7:] if p.startswith("file://") else p
        found = sorted(glob.glob(p, recursive=True)) if re.search(r"[*?\[]", p) else [p] if os.path.exists(p) else []
        if not found:
            raise FileNotFoundError(f"no capture matches {p!r}")
        out += found
    if not out:
        raise ValueError("no capture was named")
    return out


def hive_values(path: str) -> dict[str, str]:
    """Partition keys and values in the folders of a path."""
    return dict(p.split("=", 1) for p in path.split("/")[:-1] if "=" in p)


def hive_columns(files: list[str], types: dict[str, str] | None, autocast: bool, taken: list[str]) -> dict[str, str]:
    """Name and Spark type of the partition columns; all files must have the same keys, and none may hide a column."""
    keys = [list(hive_values(f)) for f in files]
    if any(set(k) != set(keys[0]) for k in keys):
        raise ValueError("the files' partition keys differ")
    out = {}
    for k in keys[0]:
        if k in taken:
            raise ValueError(f"the partition key {k!r} is the name of a column")
        values = [hive_values(f)[k] for f in files]
        if types and k in types:
            out[k] = types[k].lower()
            if out[k] not in _ARROW:
                raise ValueError(f"partition columns can't be of type {types[k]!r}")
        elif autocast and all(re.fullmatch(r"-?\d{1,18}", v) for v in values):
            out[k] = "long"
        elif autocast and all(re.fullmatch(r"\d{4}-\d\d-\d\d", v) for v in values):
            out[k] = "date"
        else:
            out[k] = "string"
    return out


@dataclass
class Files(InputPartition):
    """Files that one task reads: place in the whole list, path, partition values."""

    files: list[tuple[int, str, dict[str, str]]]


_OPS = {"=": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}


@dataclass(frozen=True)
class Test:
    """A condition on one column: ``op`` is a comparison, ``in``, ``is null``, ``is not null``, ``contains``, ``starts with`` or ``ends with``.

    Conditions are given when a capture is loaded, not gathered from the plan: Spark keeps one reader for all uses of a
    loaded DataFrame, so conditions pushed from one branch of a plan would also empty the others.
    """

    column: str
    op: str
    value: object = None

    def holds(self, x: pa.Array) -> pa.Array:
        """Three-valued truth for each value of the column."""
        if self.op == "is null":
            return pc.is_null(x)
        if self.op == "is not null":
            return pc.is_valid(x)
        if self.op == "in":
            return pc.if_else(pc.is_valid(x), pc.is_in(x, pa.array([v for v in self.value if v is not None]).cast(x.type)), None)
        if self.op in ("contains", "starts with", "ends with"):
            return {"contains": pc.match_substring, "starts with": pc.starts_with, "ends with": pc.ends_with}[self.op](x, self.value)
        return _OPS[self.op](x, pa.scalar(self.value).cast(x.type))

    def may(self, low, high, nulls: int | None) -> bool:
        """Whether a time between these bounds may satisfy it."""
        if self.op == "is null":
            return nulls is None or nulls > 0
        if low is None or high is None:
            return False
        if self.op == "is not null":
            return True
        kind = pa.timestamp("us")
        values = [pa.scalar(v).cast(kind).as_py() for v in (self.value if self.op == "in" else [self.value]) if v is not None]
        if self.op in ("=", "in"):
            return any(low <= v <= high for v in values)
        (v,) = values
        return {">": high > v, ">=": high >= v, "<": low < v, "<=": low <= v}[self.op]

    def sql(self, kind: T.DataType) -> Column:
        c = F.col(self.column)
        if self.op in ("is null", "is not null"):
            return c.isNull() if self.op == "is null" else c.isNotNull()
        if self.op in ("contains", "starts with", "ends with"):
            return {"contains": c.contains, "starts with": c.startswith, "ends with": c.endswith}[self.op](self.value)
        if self.op == "in":
            return c.isin([F.lit(v).cast(kind) for v in self.value if v is not None])
        v = F.lit(self.value).cast(kind)
        return {"=": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[self.op]


def _tests(where: list[tuple], known: dict[str, T.StructField]) -> list[Test]:
    out = []
    for column, op, *value in where:
        if column not in known or isinstance(known[column].dataType, (T.ArrayType, T.StructType, T.BinaryType)):
            raise ValueError(f"no condition can be set on {column!r}")
        if op not in (*_OPS, "in", "is null", "is not null", "contains", "starts with", "ends with"):
            raise ValueError(f"no such comparison: {op!r}")
        v = value[0] if value else None
        if op not in ("is null", "is not null") and v is None:
            raise ValueError(f"{op!r} needs a value")
        out.append(Test(column, op, [str(x) if isinstance(x, datetime) else x for x in v] if op == "in" else str(v) if isinstance(v, datetime) else v))
    return out


class CaptureReader(DataSourceReader):
    """Prunes files by name, partition and catalog, then filters rows as soon as the layer of the column is decoded."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema = schema
        self.layer = options.get("layer", "packets")
        self.paths: list[str] = json.loads(options["paths"])
        self.hive: dict[str, str] = json.loads(options.get("hive", "{}"))
        self.catalog: str | None = options.get("catalog")
        self.immutable = options.get("catalogvalidation", "strict") == "immutable"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.tests = [Test(*t) for t in json.loads(options.get("where", "[]"))]

    # --- planning ----------------------------------------------------------------------------------------------------------
    def _typed(self, name: str, value: str):
        return pa.array([value]).cast(_ARROW[self.hive[name]])

    def _kept(self, path: str) -> bool:
        parts = hive_values(path) if self.hive else {}
        for t in self.tests:
            c = t.column
            x = pa.array([path]) if c == "filename" else self._typed(c, parts[c]) if c in self.hive else None
            if x is not None and t.holds(x)[0].as_py() is not True:
                return False
        return True

    def _excluded(self) -> set[str]:
        """Files whose catalog row shows that no packet can satisfy the pushed time filters."""
        times = [t for t in self.tests if t.column == "timestamp"]
        if not self.catalog or not self.immutable or not times:
            return set()
        import pyarrow.dataset as ds

        wanted = ["filename", "file_size", "modification_time", "min_timestamp", "max_timestamp", "timestamp_null_count", "scan_status", "packet_count"]
        rows = ds.dataset(self.catalog).to_table(columns=wanted, filter=pc.field("filename").isin(sorted(set(self.paths)))).to_pylist()
        known: dict[str, list[dict]] = {}
        for r in rows:
            known.setdefault(r["filename"], []).append(r)
        out = set()
        for path, all_ in known.items():
            facts = {tuple(str(r[c]) for c in wanted) for r in all_}
            r = all_[0]
            if len(facts) > 1 or r["scan_status"] not in ("complete", "truncated"):
                continue
            stat = os.stat(path)
            if r["file_size"] != stat.st_size or r["modification_time"] is None or _utc_us(r["modification_time"]) != stat.st_mtime_ns // 1000:
                continue
            if not all(t.may(r["min_timestamp"], r["max_timestamp"], r["timestamp_null_count"]) for t in times):
                out.add(path)
        return out

    def partitions(self) -> list[Files]:
        out_of_time = self._excluded()
        groups: list[Files] = []
        room = 0
        for i, p in enumerate(self.paths):
            if p in out_of_time or not self._kept(p):
                continue
            size = os.path.getsize(p) + 4096
            if not groups or room < size:
                groups.append(Files([]))
                room = self.task_bytes
            groups[-1].files.append((i, p, hive_values(p) if self.hive else {}))
            room -= size
        return groups or [Files([])]

    # --- reading -----------------------------------------------------------------------------------------------------------
    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        want = set(self.schema.names)
        tests = [t for t in self.tests if t.column not in self.hive and t.column != "filename"]
        asked = want | {t.column for t in tests}
        depth = D.TRANSPORT if self.layer == "dns" else max((_DEPTH.get(c, D.NONE) for c in asked), default=D.NONE)
        arrow = to_arrow_schema(self.schema)
        for index, path, parts in partition.files:
            data = open_bytes(path)
            capture = Capture(path, data)
            clocks = Clocks(path, data) if asked & CLOCKS else None
            tcp = Clocks(path, data, tcp=True) if asked & TCP_CLOCKS else None
            for raw in capture.batches():
                if clocks:
                    raw |= clocks.of(raw)
                if tcp:
                    raw |= {f"tcp_{c}": v for c, v in tcp.of(raw).items() if f"tcp_{c}" in TCP_CLOCKS}
                cols = Columns(raw, capture, index, data, depth, self.layer == "dns", max(1, len(self.paths)))
                for first in (True, False):  # raw columns first, so that fewer packets are decoded
                    for t in tests:
                        if (t.column in _RAW_NAMES) == first:
                            cols.keep(pc.fill_null(t.holds(cols.get(t.column)), False).to_numpy(zero_copy_only=False))
                    if first and self.layer == "dns":
                        cols.keep(cols.has_dns())
                if not cols.n:
                    continue
                arrays = [self._typed(f.name, parts[f.name]).take(pa.array(np.zeros(cols.n, np.int64))) if f.name in parts else cols.get(f.name).cast(f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)


def _utc_us(t: datetime) -> int:
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


class Clocks:
    """Clocks of a capture's interfaces, moved by all packets or by TCP packets only. A first pass finds where they end."""

    def __init__(self, path: str, data: np.ndarray, tcp: bool = False):
        self.now: dict[int, int] = {}
        self.end: dict[int, tuple[int, int]] = {}
        self.sections = 0
        masks = []
        for raw in Capture(path, data).batches():
            moving = np.ones(len(raw["ts"]), bool)
            if tcp:
                moving = D.Packets(data, raw["packet_offset"], raw["captured_length"], raw["link_type"], D.TRANSPORT).tcp
                masks.append(np.packbits(moving))  # a bit a packet
            for scope, rows in self._scopes(raw, moving):
                top, _ = self.end.get(scope, (NO_TIME, 0))
                self.end[scope] = (max(top, int(raw["ts"][rows].max())), int(raw["packet_number"][rows[-1]]))
            self.sections = int(raw["section_number"][-1])
        self.masks = iter(masks) if tcp else None

    @staticmethod
    def _scopes(raw: dict[str, np.ndarray], moving: np.ndarray) -> list[tuple[int, np.ndarray]]:
        scope = raw["section_number"] << 32 | raw["interface_id"]
        first = scope[0]
        if moving.all() and (scope == first).all():
            return [(int(first), np.arange(len(scope)))]
        return [(int(s), np.flatnonzero((scope == s) & moving)) for s in np.unique(scope[moving])]

    def of(self, raw: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The clock columns of the next batch."""
        n = len(raw["ts"])
        out = {c: np.zeros(n, np.int64) for c in ("clock", "final_clock", "final_packet")} | {"late": np.zeros(n, bool)}
        moving = np.ones(n, bool) if self.masks is None else np.unpackbits(next(self.masks), count=n).astype(bool)
        for scope, rows in self._scopes(raw, moving):
            ts = raw["ts"][rows]
            line = np.maximum.accumulate(np.concatenate([[self.now.get(scope, NO_TIME)], ts]))
            out["clock"][rows], out["late"][rows] = line[1:], (ts != NO_TIME) & (ts < line[:-1])
            self.now[scope] = int(line[-1])
            out["final_clock"][rows], out["final_packet"][rows] = self.end[scope]
        return out | {"last_section": raw["section_number"] == self.sections}


def _slices(view: memoryview, start: np.ndarray, size: np.ndarray, there: np.ndarray) -> pa.Array:
    """Pieces of a file as binary values; null where there is none."""
    size = np.where(there, size, 0)
    ends = np.cumsum(size)
    if len(ends) and ends[-1] > np.iinfo(np.int32).max:
        return pa.array([view[a : a + n].tobytes() if t else None for a, n, t in zip(start.tolist(), size.tolist(), there.tolist(), strict=True)], pa.binary())
    whole = b"".join([view[a:b] for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    valid = None if there.all() else pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(size), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole)])


class Columns:
    """Columns of a batch, each made when first asked for."""

    def __init__(self, raw: dict[str, np.ndarray], capture: Capture, index: int, data: np.ndarray, depth: int, dns: bool, count: int = 1):
        self.raw, self.capture, self.index, self.data, self.depth, self.count = raw, capture, index, data, depth, count
        self.n = len(raw["ts"])
        self.packets: D.Packets | None = None
        self.made: dict[str, pa.Array] = {}
        self.messages: list[dict] | None = None
        self.dns = dns

    def keep(self, mask: np.ndarray) -> None:
        if not mask.all():
            self.raw = {k: v[mask] for k, v in self.raw.items()}
            self.n = int(mask.sum())
            self.packets = self.messages = None
            self.made = {}

    @property
    def p(self) -> D.Packets:
        if self.packets is None:
            r = self.raw
            self.packets = D.Packets(self.data, r["packet_offset"], r["captured_length"], r["link_type"], self.depth)
        return self.packets

    def has_dns(self) -> np.ndarray:
        p = self.p
        return p.transport & ((p.src_port == 53) | (p.dst_port == 53)) & (p.payload_length > 0)

    def get(self, name: str) -> pa.Array:
        if name not in self.made:
            self.made[name] = self._make(name)
        return self.made[name]

    def _make(self, name: str) -> pa.Array:
        r, n = self.raw, self.n
        if name in ("filename", "capture_format"):
            return pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([self.capture.path if name == "filename" else self.capture.format])).cast(pa.string())
        if name in ("input_index", "input_count"):
            return pa.array(np.full(n, self.index + 1 if name == "input_index" else self.count, np.int64))
        if name == "timestamp":
            return pa.array(r["ts"], mask=r["ts"] == NO_TIME).cast(pa.timestamp("us"))
        if name in r:
            return pa.array(r[name], mask=r[name] == NO_TIME if name.endswith("clock") else None)
        if name == "packet_data":
            return _slices(self.capture.view, r["packet_offset"], r["captured_length"], np.ones(n, bool))
        p = self.p
        if name in ("src_mac", "dst_mac"):
            return p.macs(6 if name == "src_mac" else 0)
        if name == "ether_type":
            return p.column(name, p.ethernet, pa.int32())
        if name == "vlan_ids":
            return p.vlan_lists()
        if name in ("src_ip", "dst_ip"):
            return p.addresses(0 if name == "src_ip" else 1)
        if name == "ip_id":
            return p.column(name, p.network & p.has_id, pa.int64())
        if name == "ip_more_fragments":
            return pa.array(p.more, mask=~p.network)
        if name in ("ip_version", "ip_protocol", "ip_ttl", "ip_fragment_offset"):
            return p.column(name, p.network, pa.int32() if name == "ip_fragment_offset" else pa.int16())
        if name in ("tcp_flags", "tcp_seq", "tcp_ack", "tcp_header_length"):
            return p.column(name, p.tcp, pa.int64())
        if name == "udp_length":
            return p.column(name, p.udp, pa.int64())
        if name in ("src_port", "dst_port", "payload_offset", "payload_length"):
            return p.column(name, p.transport, pa.int64())
        if name == "payload_declared_length":
            return p.column("payload_declared", p.transport, pa.int64())
        bits = ("tcp_fin", "tcp_syn", "tcp_rst", "tcp_psh", "tcp_ack_flag", "tcp_urg", "tcp_ece", "tcp_cwr")
        if name in bits:
            return pa.array(p.tcp_flags >> bits.index(name) & 1 == 1, mask=~p.tcp)
        if name == "decode_outcome":
            return pa.array(_OUTCOMES[p.outcome], pa.string())
        if name == "payload":
            return _slices(self.capture.view, p.at + p.payload_offset, p.payload_length, p.transport)
        if name in TLS_FIELDS:
            return self._tls(name)
        if name in DNS_FIELDS:
            return self._dns(name)
        raise KeyError(name)

    def _tls(self, name: str) -> pa.Array:
        p = self.p
        start = p.at + p.payload_offset
        top = len(self.data) - 1
        first, second = self.data[np.minimum(start, top)], self.data[np.minimum(start + 1, top)]
        maybe = p.tcp & (p.payload_length >= 5) & (first >= TYPES[0]) & (first <= TYPES[-1]) & (second == 3)
        empty = dict.fromkeys(TLS_FIELDS) | {"is_tls": False}
        absent = dict.fromkeys(TLS_FIELDS)
        rows = [record_fields(p.payload(i)) if m else empty if t else absent for i, (m, t) in enumerate(zip(maybe.tolist(), p.tcp.tolist(), strict=True))]
        for c, kind in TLS_FIELDS.items():
            self.made[c] = pa.array([r[c] for r in rows], kind)
        return self.made[name]

    def _dns(self, name: str) -> pa.Array:
        p = self.p
        if self.messages is None:
            payloads = values(_slices(self.capture.view, p.at + p.payload_offset, p.payload_length, p.transport))
            self.messages = [decode_packet(d or b"", t, u - 8) for d, t, u in zip(payloads, p.tcp.tolist(), p.udp_length.tolist(), strict=True)]
        return pa.array([r[name] for r in self.messages], DNS_FIELDS[name])  # only the fields that are asked for


class CaptureSource(DataSource):
    """``spark.read.format("netloom_capture")``; use the functions below, which expand paths and narrow the schema."""

    @classmethod
    def name(cls) -> str:
        return "netloom_capture"

    def schema(self) -> str:
        return LAYERS[self.options.get("layer", "packets")]

    def reader(self, schema: T.StructType) -> CaptureReader:
        return CaptureReader(schema, dict(self.options))


def _read(spark: SparkSession, layer: str, paths: str | list[str], columns: list[str] | None, hive_partitioning: bool, hive_types: dict[str, str] | None, hive_types_autocast: bool, catalog: str | None, catalog_validation: str, where: list[tuple]) -> DataFrame:
    if catalog_validation not in ("strict", "immutable"):
        raise ValueError("catalog_validation must be strict or immutable")
    files = expand(paths)
    spark.dataSource.register(CaptureSource)
    full = T.StructType.fromDDL(LAYERS[layer])
    known = {f.name: f for f in [*full.fields, *T.StructType.fromDDL(EXTRA).fields]}
    hive = hive_columns(files, hive_types, hive_types_autocast, full.names) if hive_partitioning else {}
    known |= {f.name: f for f in (T.StructType.fromDDL(", ".join(f"{k} {t}" for k, t in hive.items())).fields if hive else [])}
    names = columns if columns is not None else [*full.names, *hive]
    unknown = [c for c in names if c not in known]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    if len(set(names)) < len(names):
        raise ValueError("a column is named twice")
    r = spark.read.format("netloom_capture").schema(T.StructType([known[c] for c in names])).option("layer", layer).option("paths", json.dumps(files)).option("hive", json.dumps(hive)).option("catalogvalidation", catalog_validation)
    tests = _tests(where, known)
    r = r.option("where", json.dumps([(t.column, t.op, t.value) for t in tests]))
    df = (r.option("catalog", catalog) if catalog else r).load()
    for t in tests:
        if t.column in names:  # checked again, where it can be seen in the plan
            df = df.filter(t.sql(known[t.column].dataType))
    return df


def read_pcap(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, hive_partitioning: bool = False, hive_types: dict[str, str] | None = None, hive_types_autocast: bool = True, catalog: str | None = None, catalog_validation: str = "strict", where: list[tuple] | tuple = ()) -> DataFrame:
    """Records of captures. ``columns`` narrows what is read: only these columns are made, and only their layers decoded.

    ``where`` is a list of conditions ``(column, op[, value])`` that all must hold (see ``Test``): those on ``filename`` and
    partition columns leave out whole files before any is opened; with ``catalog``, the path of a stored inventory, and
    ``catalog_validation="immutable"``, conditions on ``timestamp`` leave out files whose summary excludes them; the others
    are tested as soon as their layer is decoded, and packets that fail are decoded no further.
    """
    return _read(spark, "pcap", paths, columns, hive_partitioning, hive_types, hive_types_autocast, catalog, catalog_validation, list(where))


def read_packets(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, hive_partitioning: bool = False, hive_types: dict[str, str] | None = None, hive_types_autocast: bool = True, catalog: str | None = None, catalog_validation: str = "strict", where: list[tuple] | tuple = ()) -> DataFrame:
    """Decoded packets; a packet that can't be decoded keeps its raw columns and has nulls for the rest."""
    return _read(spark, "packets", paths, columns, hive_partitioning, hive_types, hive_types_autocast, catalog, catalog_validation, list(where))


def read_dns(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, hive_partitioning: bool = False, hive_types: dict[str, str] | None = None, hive_types_autocast: bool = True, catalog: str | None = None, catalog_validation: str = "strict", where: list[tuple] | tuple = ()) -> DataFrame:
    """Packets to or from port 53 with a payload, each with the DNS message in it."""
    return _read(spark, "dns", paths, columns, hive_partitioning, hive_types, hive_types_autocast, catalog, catalog_validation, list(where))
