"""TCP directions put together from segments, and the DNS messages in them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.flows import ACK, FIN, RST, SYN, TCP_IDLE
from netloom.operators.ordered import SCOPE, along, vlan_list, with_clock, with_inputs, with_pair
from netloom.sources import dns
from netloom.session import epoch_us, materialize
from netloom.sources.captures import DNS
from netloom.sources.columns import values

# The bounds below, and the statuses and errors named where they arise.
#: Bounds of one direction: bytes and segments kept, and messages framed.
MOST_BYTES, MOST_SEGMENTS, MOST_MESSAGES = 1 << 20, 4096, 4096
_CHUNKS = "array<struct<offset:long,tcp_sequence:long,data:binary,first_packet_number:long,last_packet_number:long>>"
_ORIGINS = "array<struct<offset:long,length:long,packet:long,us:long>>"
_STREAM = (
    "filename string, input_index long, input_count long, section_number long, interface_id long, ip_version short, src_ip string, dst_ip string, src_port int, dst_port int, vlans string, tcp_sequence long, syn_seen boolean, fin_seen boolean, reset_seen boolean, finalized_by string, reassembly_status string, reassembly_error string, "
    f"first_packet_number long, last_packet_number long, first_us long, last_us long, expected_bytes long, captured_bytes long, chunks {_CHUNKS}, gaps array<struct<offset:long,length:long>>, origins {_ORIGINS}, has_row boolean"
)


def relative(seq: int, base: int) -> int:
    """Distance of a sequence number from another, the short way round."""
    d = (seq - base) & 0xFFFFFFFF
    return d if d < 1 << 31 else d - (1 << 32)


class Direction:
    """Segments of one direction of a connection, kept until it ends."""

    def __init__(self, p):
        self.key, self.first, self.last = p, p, p
        self.syn: int | None = None
        self.fin: int | None = None
        self.reset = False
        self.untimed = False
        self.deadline: int | None = None
        self.segments: list[tuple[int, int, bytes, object]] = []
        self.seen: set[tuple[int, int, bytes]] = set()
        self.bytes = 0
        self.failure: tuple[str, str] | None = None

    def fail(self, status: str, why: str) -> None:
        if self.failure is None:
            self.failure = (status, why)
        self.segments, self.seen, self.bytes = [], set(), 0

    def add(self, p, idle: int) -> None:
        flags, seq, data, declared = p.tcp_flags, p.tcp_seq, p.payload or b"", p.payload_declared_length
        self.last = p
        if p.us is None:
            self.untimed = True
        if idle and not self.untimed:
            self.deadline = max(self.deadline or p.us + idle, p.us + idle)
        else:
            self.deadline = None
        if flags & SYN:
            self.syn = seq
            seq = (seq + 1) & 0xFFFFFFFF
        if flags & FIN:
            end = (seq + declared) & 0xFFFFFFFF
            if self.fin is not None and self.fin != end:
                self.fail("conflict", "conflicting TCP FIN positions")
            self.fin = end
        if self.failure is None and len(data) > declared:
            self.fail("conflict", "captured TCP bytes exceed declared payload length")
        if self.failure is None and declared:
            same = (seq, declared, data)
            if len(data) > MOST_BYTES:
                self.fail("limit", "TCP segment exceeds reassembly limits")
            elif same not in self.seen:
                if len(self.segments) >= MOST_SEGMENTS or self.bytes + len(data) > MOST_BYTES:
                    self.fail("limit", "TCP reassembly byte or segment limit reached")
                else:
                    self.seen.add(same)
                    self.segments.append((seq, declared, data, p))
                    self.bytes += len(data)

    def _row(self, why: str, status: str, error: str | None, seq: int = 0, extent: int = 0, captured: int = 0, chunks=(), gaps=(), origins=(), has_row: bool = True) -> tuple:
        k = self.key
        return (
            *(getattr(k, c) for c in SCOPE), k.ip_version, k.src_ip, k.dst_ip, k.src_port, k.dst_port, k.vlans, seq, self.syn is not None, self.fin is not None, why == "reset", why, status, error,
            self.first.packet_number, self.last.packet_number, self.first.us, self.last.us, extent, captured, list(chunks), list(gaps), list(origins), has_row,
        )

    def finish(self, why: str) -> tuple:
        """The direction as a row; ``has_row`` is false where it carried nothing and only its number counts."""
        if self.failure:
            return self._row(why, *self.failure)
        if not self.segments and (self.fin is None or self.syn is None):
            return self._row(why, "", None, has_row=False)
        if self.syn is not None:
            base = (self.syn + 1) & 0xFFFFFFFF
        else:
            front = self.segments[0][0]
            base = (front + min(relative(s[0], front) for s in self.segments)) & 0xFFFFFFFF
        places = [relative(s[0], base) for s in self.segments]
        if any(o < 0 or o + s[1] > MOST_BYTES for o, s in zip(places, self.segments, strict=True)):
            return self._row(why, "limit", "TCP sequence span exceeds bounded reassembly window")
        extent = max((o + s[1] for o, s in zip(places, self.segments, strict=True)), default=0)
        if self.fin is not None:
            end = relative(self.fin, base)
            if not 0 <= end <= MOST_BYTES:
                return self._row(why, "limit", "TCP FIN exceeds bounded reassembly window")
            if end < extent:
                return self._row(why, "conflict", "captured TCP data extends beyond FIN")
            extent = end
        if not extent:
            return self._row(why, "", None, has_row=False)
        image, owner = np.zeros(extent, np.uint8), np.full(extent, -1, np.int32)
        for i, (o, s) in enumerate(zip(places, self.segments, strict=True)):
            new, was, whose = np.frombuffer(s[2], np.uint8), image[o : o + len(s[2])], owner[o : o + len(s[2])]
            if ((whose >= 0) & (was != new)).any():
                return self._row(why, "conflict", "overlapping TCP segments contain different bytes")
            image[o : o + len(new)] = new
            whose[whose < 0] = i
        cut = np.flatnonzero(np.diff(owner)) + 1
        runs = [(a, b, int(owner[a])) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), extent], strict=True)]
        gaps = [{"offset": a, "length": b - a} for a, b, w in runs if w < 0]
        origins = [{"offset": a, "length": b - a, "packet": self.segments[w][3].packet_number, "us": self.segments[w][3].us} for a, b, w in runs if w >= 0]
        chunks: list[dict] = []
        for o in origins:
            if chunks and chunks[-1]["offset"] + len(chunks[-1]["data"]) == o["offset"]:
                c = chunks[-1]
                c["data"] += image[o["offset"] : o["offset"] + o["length"]].tobytes()
                c["first_packet_number"], c["last_packet_number"] = min(c["first_packet_number"], o["packet"]), max(c["last_packet_number"], o["packet"])
            else:
                chunks.append({"offset": o["offset"], "tcp_sequence": (base + o["offset"]) & 0xFFFFFFFF, "data": image[o["offset"] : o["offset"] + o["length"]].tobytes(), "first_packet_number": o["packet"], "last_packet_number": o["packet"]})
        status, error = ("unanchored", "TCP SYN was not captured; offsets start at the earliest observed sequence") if self.syn is None else ("gapped", "missing TCP bytes leave sequence gaps") if gaps else ("contiguous", None)
        return self._row(why, status, error, base, extent, sum(len(c["data"]) for c in chunks), chunks, gaps, origins)


class _Connection:
    """Both directions of one pair of endpoints."""

    def __init__(self, idle: int):
        self.idle, self.open, self.tail = idle, {}, None

    def _close(self, side: bool, why: str) -> Iterator[tuple]:
        d = self.open.pop(side, None)
        if d:
            yield d.finish(why)

    def _expire(self, clock: int | None) -> Iterator[tuple]:
        for side in [s for s, d in self.open.items() if d.deadline is not None and clock is not None and d.deadline < clock]:
            yield from self._close(side, "idle_timeout")

    def row(self, p) -> Iterator[tuple]:
        self.tail = p
        if p.us is not None:
            yield from self._expire(p.clock)
        side, flags = p.from_low, p.tcp_flags
        d = self.open.get(side)
        if flags & SYN and (d is None or (d.syn is not None and d.syn != p.tcp_seq)):
            yield from self._close(side, "tuple_reuse")
            if not flags & ACK:
                yield from self._close(not side, "tuple_reuse")
            d = None
        if d is None:
            if not flags & SYN and not p.payload_declared_length and not p.payload:
                if flags & RST:
                    yield from self._close(not side, "reset")
                return
            d = self.open[side] = Direction(p)
        d.add(p, self.idle)
        if flags & RST:
            yield from self._close(side, "reset")
            yield from self._close(not side, "reset")

    def end(self) -> Iterator[tuple]:
        for side in [True, False]:
            d = self.open.get(side)
            if d:
                late = d.deadline is not None and d.deadline < (self.tail.final_clock or d.deadline) and self.tail.final_packet > d.last.packet_number
                yield from self._close(side, "idle_timeout" if late else "eof")


#: Columns the packet reader must give.
NEEDED = [*SCOPE, "packet_number", "timestamp", "vlan_ids", "ip_version", "ip_protocol", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "tcp_seq", "payload", "payload_length", "payload_declared_length"]


#: The clock of TCP packets, which the packet reader gives if asked for.
TCP_CLOCK = ["tcp_clock", "tcp_final_clock", "tcp_final_packet"]


def _stamp(c: str):
    return F.timestamp_add("MICROSECOND", F.col(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def directions(packets: DataFrame, tcp_idle_timeout: timedelta = TCP_IDLE) -> DataFrame:
    """Every direction that was seen, numbered within its input by its first packet; ``has_row`` tells those that carried data."""
    if tcp_idle_timeout < timedelta(0):
        raise ValueError("tcp_idle_timeout must be nonnegative")
    packets = with_inputs(packets)
    given = set(TCP_CLOCK) <= set(packets.columns)  # the reader's, which is not sorted and joined
    tcp = packets.select(*NEEDED, *(F.col(c).alias(c[4:]) for c in TCP_CLOCK if given)).filter("ip_protocol = 6 and src_port is not null")
    tcp = tcp.withColumn("us", epoch_us(F.col("timestamp"))) if given else with_clock(tcp)
    tcp = with_pair(tcp).drop("timestamp", "vlan_ids", "ip_protocol", "payload_length")
    keys = [*SCOPE, "ip_version", "vlans", "low_ip", "low_port", "high_ip", "high_port"]
    idle = int(tcp_idle_timeout / timedelta(microseconds=1))
    d = along(tcp, keys, ["packet_number"], lambda: _Connection(idle), _STREAM)
    # Directions are numbered without their bytes, and a capture's numbers are joined to them.
    d = materialize(d, "directions")
    number = F.row_number().over(Window.partitionBy("filename", "input_index").orderBy("first_packet_number"))
    ids = d.select("filename", "input_index", "input_count", "first_packet_number").withColumn("stream_id", (number - 1) * F.col("input_count") + F.col("input_index"))
    ids = ids.select(F.col("filename").alias("_f"), F.col("input_index").alias("_i"), F.col("first_packet_number").alias("_p"), "stream_id")
    return d.join(ids, F.col("filename").eqNullSafe(F.col("_f")) & (F.col("input_index") == F.col("_i")) & (F.col("first_packet_number") == F.col("_p"))).drop("_f", "_i", "_p")


def read_tcp_streams(packets: DataFrame, tcp_idle_timeout: timedelta = TCP_IDLE) -> DataFrame:
    """One row per TCP direction that carried data, with its bytes, chunks and gaps.

    ``packets`` are rows of the packet reader with ``NEEDED`` columns. A connection's two directions are put together side
    by side, as a SYN or reset of one ends the other; a direction ends at a reset, a new SYN, when the interface's clock
    passes it by more than the timeout, or with the capture. Bytes, segments and messages of one direction are bounded;
    beyond, its status is ``limit``. The clock never runs back, and directions of one capture aren't limited in number.
    """
    d = directions(packets, tcp_idle_timeout).filter("has_row")
    bad = F.col("reassembly_status").isin("conflict", "limit")
    return d.select(
        "filename", "section_number", "interface_id", "ip_version", "src_ip", "dst_ip", "src_port", "dst_port", "stream_id", F.when(~bad, F.col("tcp_sequence")).alias("tcp_sequence"), "syn_seen", "fin_seen", "reset_seen", "finalized_by", "reassembly_status", "reassembly_error",
        "first_packet_number", "last_packet_number", _stamp("first_us").alias("first_timestamp"), _stamp("last_us").alias("last_timestamp"), "expected_bytes", "captured_bytes", (F.size("gaps") > 0).alias("has_gaps"),
        F.when((F.size("gaps") == 0) & (F.size("chunks") > 0), F.col("chunks")[0]["data"]).alias("stream_data"), "chunks", "gaps", vlan_list().alias("vlan_ids"),
    )


def frame_dns(row: dict) -> list[dict]:
    """DNS messages in a direction: each after its length, until bytes are missing; diagnostics where alignment is unknown."""

    def message(status: str, error: str | None, at: int = 0, number: int | None = None, data: bytes | None = None, stamps=None) -> dict:
        first, last = stamps or ((row["first_packet_number"], row["first_us"]), (row["last_packet_number"], row["last_us"]))
        known = status in ("complete", "incomplete", "invalid")
        return {
            "message_number": number, "first_packet_number": first[0], "last_packet_number": last[0], "first_us": first[1], "last_us": last[1],
            "tcp_sequence": (row["tcp_sequence"] + at) & 0xFFFFFFFF if known else None, "reassembly_status": status, "reassembly_error": error, "message_data": data,
        }

    if row["reassembly_status"] in ("conflict", "limit"):
        return [message(row["reassembly_status"], row["reassembly_error"])]
    if not row["syn_seen"]:
        return [message("unanchored", "TCP SYN was not captured; DNS message alignment is unknown")]
    data = row["chunks"][0]["data"] if row["chunks"] and row["chunks"][0]["offset"] == 0 else b""
    out: list[dict] = []
    at = 0
    while len(data) - at >= 2:
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 12:
            return [*out, message("invalid", "DNS TCP frame length is shorter than the DNS header", at)]
        if at + 2 + size > len(data):
            break
        if len(out) >= MOST_MESSAGES:
            return [message("limit", "DNS message count exceeds per-direction limit")]
        held = [o for o in row["origins"] if o["offset"] < at + 2 + size and o["offset"] + o["length"] > at]
        stamps = min(((o["packet"], o["us"]) for o in held), key=lambda s: s[0]), max(((o["packet"], o["us"]) for o in held), key=lambda s: s[0])
        out.append(message("complete", None, at, len(out) + 1, data[at + 2 : at + 2 + size], stamps))
        at += 2 + size
    if at != row["expected_bytes"]:
        why = "missing TCP bytes leave a sequence gap" if row["gaps"] else "incomplete DNS TCP frame at idle timeout" if row["finalized_by"] == "idle_timeout" else "incomplete DNS TCP frame at end of stream"
        out.append(message("incomplete", why, at))
    return out


_FRAME = "message_number long, first_packet_number long, last_packet_number long, first_us long, last_us long, tcp_sequence long, reassembly_status string, reassembly_error string, message_data binary"
_OF = ["filename", "section_number", "interface_id", "ip_version", "src_ip", "dst_ip", "src_port", "dst_port"]


def read_dns_messages(packets: DataFrame, tcp_idle_timeout: timedelta = TCP_IDLE) -> DataFrame:
    """One row per DNS message of port 53: UDP datagrams, and messages and diagnostics of TCP directions."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    p = packets.filter("src_port = 53 or dst_port = 53")
    frame = to_arrow_schema(T.StructType.fromDDL(_FRAME))
    streams = directions(p, tcp_idle_timeout).filter("has_row")
    names = [*_OF, "stream_id", "vlans", *frame.names]
    take = [*_OF, "stream_id", "vlans", "first_packet_number", "last_packet_number", "first_us", "last_us", "tcp_sequence", "reassembly_status", "reassembly_error", "syn_seen", "chunks", "gaps", "origins", "expected_bytes", "finalized_by"]

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, rows = [], []
            for i, r in enumerate(b.to_pylist()):
                for m in frame_dns(r):
                    place.append(i)
                    rows.append(m)
            keys = [b.column(c).take(pa.array(place, pa.int64())) for c in names[:10]]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array([m[f.name] for m in rows], f.type) for f in frame]], names=names)

    types = {f.name: f.dataType.simpleString() for f in streams.schema.fields}
    tcp = streams.select(*take).mapInArrow(framed, ", ".join(f"{c} {types[c]}" for c in names[:10]) + ", " + _FRAME).withColumn("transport", F.lit("tcp"))
    whole = F.col("payload_length") == F.col("payload_declared_length")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp"))
    udp = p.filter("ip_protocol = 17").select(
        *_OF, F.lit(None).cast("long").alias("stream_id"), F.coalesce(F.concat_ws(",", F.col("vlan_ids").cast("array<string>")), F.lit("")).alias("vlans"), F.when(whole, 1).cast("long").alias("message_number"), F.col("packet_number").alias("first_packet_number"), F.col("packet_number").alias("last_packet_number"),
        us.alias("first_us"), us.alias("last_us"), F.lit(None).cast("long").alias("tcp_sequence"), F.when(whole, "complete").otherwise("incomplete").alias("reassembly_status"), F.when(~whole, "truncated UDP DNS payload").alias("reassembly_error"),
        F.when(whole, F.coalesce("payload", F.lit(b""))).alias("message_data"), F.lit("udp").alias("transport"),
    )
    all_ = tcp.unionByName(udp)
    fields = to_arrow_schema(T.StructType.fromDDL(DNS))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = dict.fromkeys(fields.names)
            rows = [dns.decode(m) if s == "complete" else none | {"dns_valid": False, "dns_error": e} for m, s, e in zip(*(values(b.column(c)) for c in ("message_data", "reassembly_status", "reassembly_error")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[f.name] for r in rows], f.type) for f in fields]], names=[*b.schema.names, *fields.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in all_.schema.fields)
    m = all_.mapInArrow(parsed, f"{kinds}, {DNS}")
    return m.select(
        *_OF, "transport", "stream_id", "message_number", "first_packet_number", "last_packet_number", _stamp("first_us").alias("first_timestamp"), _stamp("last_us").alias("last_timestamp"), "tcp_sequence", "reassembly_status", "reassembly_error", "message_data", vlan_list().alias("vlan_ids"), *fields.names,
    )
