"""Bidirectional TCP and UDP sessions of decoded packets."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.ordered import CLOCK, SCOPE, along, join_null_safe, vlan_list, with_clock, with_inputs, with_pair

FIN, SYN, RST, ACK = 1, 2, 4, 16
TCP_IDLE, UDP_IDLE = timedelta(minutes=5), timedelta(minutes=1)
_SIDES = ("packets", "captured_bytes", "reported_bytes", "payload_bytes")
_STATE = (
    "filename string, input_index long, input_count long, section_number long, interface_id long, vlans string, ip_version short, ip_protocol short, orig_ip string, orig_port int, resp_ip string, resp_port int, originator_basis string, "
    + ", ".join(f"{s}_{c} long" for c in _SIDES for s in ("orig", "resp"))
    + ", first_packet_number long, last_packet_number long, first_us long, last_us long, missing_timestamp_packets long, late_packets long, orig_tcp_flags int, resp_tcp_flags int, handshake_complete boolean, syn_seen boolean, fin_seen boolean, reset_seen boolean, simultaneous_open boolean, equal_endpoints boolean, finalized_by string"
)


#: Columns that sessions are made of; read a capture with them and ``CLOCK``.
FLOW_COLUMNS = [*SCOPE, "packet_number", "timestamp", "captured_length", "original_length", "vlan_ids", "ip_version", "ip_protocol", "ip_fragment_offset", "ip_more_fragments", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "tcp_seq", "tcp_ack", "payload_length"]


class _Session:
    """Counters and handshake of one session; side 0 began it."""

    def __init__(self, p, flags: int):
        self.key, self.first = p, p.packet_number
        self.orig_low = p.from_low != (flags & (SYN | ACK) == SYN | ACK)
        self.basis = "syn_ack" if flags & (SYN | ACK) == SYN | ACK else "syn" if flags & SYN else "first_packet"
        self.counts = [[0, 0, 0, 0], [0, 0, 0, 0]]
        self.flags = [0, 0]
        self.low = self.high = None
        self.missing = self.late = 0
        self.sent_syn, self.sent_syn_ack, self.seq = [False, False], [False, False], [0, 0]
        self.closed = self.complete = self.both = False
        self.last = self.first

    def side(self, p) -> int:
        return 0 if p.from_low == self.orig_low else 1

    def reused_by(self, p) -> bool:
        """Whether a plain SYN begins a new session here: neither a repeat of the open handshake's nor its simultaneous twin."""
        side = self.side(p)
        opening = not self.closed and not self.complete and not (self.flags[0] | self.flags[1]) & FIN
        again = self.sent_syn[side] and self.seq[side] == p.tcp_seq
        twin = not self.sent_syn[side] and self.sent_syn[1 - side] and not self.sent_syn_ack[side]
        return not (opening and (again or twin))

    def add(self, p, flags: int) -> None:
        side = self.side(p)
        for i, v in enumerate((1, p.captured_length, p.original_length, p.payload_length)):
            self.counts[side][i] += v
        self.last = p.packet_number
        us = p.us
        if us is None:
            self.missing += 1
        else:
            self.low = us if self.low is None else min(self.low, us)
            self.high = us if self.high is None else max(self.high, us)
            self.late += p.late
        if p.ip_protocol != 6:
            return
        self.flags[side] |= flags
        other, seq, ack = 1 - side, p.tcp_seq, p.tcp_ack
        if not flags & SYN and (flags & ACK or p.payload_length):
            self.closed = True
        if flags & (SYN | ACK) == SYN:
            self.both |= self.sent_syn[other]
            self.sent_syn[side], self.seq[side] = True, seq
        elif flags & SYN:
            if self.sent_syn[other] and ack == (self.seq[other] + 1) & 0xFFFFFFFF:
                self.sent_syn_ack[side], self.seq[side] = True, seq
        elif flags & ACK and self.sent_syn[side] and self.sent_syn_ack[other] and ack == (self.seq[other] + 1) & 0xFFFFFFFF and seq == (self.seq[side] + 1) & 0xFFFFFFFF:
            self.complete = True

    def out(self, why: str) -> tuple:
        k = self.key
        low, high = (k.low_ip, k.low_port), (k.high_ip, k.high_port)
        orig, resp = (low, high) if self.orig_low else (high, low)
        seen = self.flags[0] | self.flags[1]
        tcp = k.ip_protocol == 6
        state = (self.flags[0], self.flags[1], self.complete, bool(seen & SYN), bool(seen & FIN), bool(seen & RST), self.both) if tcp else (None,) * 7
        return (
            *(getattr(k, c) for c in SCOPE), k.vlans, k.ip_version, k.ip_protocol, *orig, *resp, self.basis, *(self.counts[s][i] for i in range(4) for s in (0, 1)),
            self.first, self.last, self.low, self.high, self.missing, self.late, *state, low == high, why,
        )


class _Machine:
    def __init__(self, tcp_idle: int, udp_idle: int):
        self.idle = {6: tcp_idle, 17: udp_idle}
        self.open: _Session | None = None
        self.tail = None

    def _expired(self, clock: int | None) -> bool:
        s = self.open
        idle = self.idle[s.key.ip_protocol]
        return bool(idle) and not s.missing and s.high is not None and clock is not None and s.high + idle < clock

    def _close(self, why: str) -> tuple:
        row, self.open = self.open.out(why), None
        return row

    def row(self, p) -> list[tuple]:
        self.tail = p
        tcp = p.ip_protocol == 6
        flags = (p.tcp_flags or 0) if tcp else 0
        out = []
        if self.open is not None:
            if self._expired(p.clock):
                out.append(self._close("idle_timeout"))
            elif flags & (SYN | ACK) == SYN and self.open.reused_by(p):
                out.append(self._close("tuple_reuse"))
        if self.open is None:
            self.open = _Session(p, flags)
        self.open.add(p, flags)
        if flags & RST:
            out.append(self._close("reset"))
        return out

    def end(self) -> list[tuple]:
        if self.open is None:
            return []
        p = self.tail
        later = p.final_packet > self.open.last
        return [self._close("idle_timeout" if later and self._expired(p.final_clock) else "eof" if p.last_section else "section_boundary")]


def read_flows(packets: DataFrame, tcp_idle_timeout: timedelta = TCP_IDLE, udp_idle_timeout: timedelta = UDP_IDLE) -> DataFrame:
    """One row per session of decoded packets (columns of the packet reader).

    A session lives within one input, section, interface, VLAN stack and pair of endpoints. It ends when the interface's
    clock passes its last time by more than the timeout (0: never), at a reset, when a plain SYN reuses its endpoints, or
    where section or capture end. Packets that carry no whole TCP or UDP header move the clock only. Late packets and
    packets without a time join the open session and are counted; a session with a packet without a time has no duration
    and never times out. Rows with a null packet number are left out; repeated rows count each time.

    ``flow_id`` differs between all inputs: it counts first packets by inputs (see ``with_inputs``). The clock depends on an interface alone, so once it stands beside each packet, sessions are independent by key; how many
    are open at a time is not limited.
    """
    packets = with_inputs(packets)
    if tcp_idle_timeout < timedelta(0) or udp_idle_timeout < timedelta(0):
        raise ValueError("idle timeouts must be nonnegative")
    cols = list(FLOW_COLUMNS)
    given = [c for c in CLOCK if c in packets.columns]
    p = with_clock(packets.select(*cols, *given).filter("packet_number is not null"))
    if len(given) < len(CLOCK):
        last = packets.groupBy("filename", "input_index").agg(F.max("section_number").alias("_sections"))
        p = join_null_safe(p, last, ["filename", "input_index"]).withColumn("last_section", F.col("section_number") == F.col("_sections")).drop("_sections")
    p = p.filter("ip_protocol in (6, 17) and src_port is not null and coalesce(ip_fragment_offset, 0) = 0 and not coalesce(ip_more_fragments, false)")
    p = with_pair(p).drop("timestamp", "vlan_ids", "ip_fragment_offset", "ip_more_fragments", "src_ip", "dst_ip", "src_port", "dst_port")
    keys = [*SCOPE, "ip_version", "ip_protocol", "vlans", "low_ip", "low_port", "high_ip", "high_port"]
    us = [int(t / timedelta(microseconds=1)) for t in (tcp_idle_timeout, udp_idle_timeout)]
    s = along(p, keys, ["packet_number"], lambda: _Machine(*us), _STATE)
    tcp, timed = F.col("ip_protocol") == 6, F.col("first_us").isNotNull() & (F.col("missing_timestamp_packets") == 0)
    fins = (F.col("orig_tcp_flags").bitwiseAND(FIN) > 0) & (F.col("resp_tcp_flags").bitwiseAND(FIN) > 0)

    def stamp(c: str):
        return F.timestamp_add("MICROSECOND", F.col(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))

    span = F.when(timed, F.col("last_us") - F.col("first_us"))
    return s.select(
        "filename", "input_index", ((F.col("first_packet_number") - 1) * F.col("input_count") + F.col("input_index")).alias("flow_id"), "section_number", "interface_id", vlan_list().alias("vlan_ids"), "first_packet_number", "last_packet_number",
        F.when(tcp, "tcp").otherwise("udp").alias("transport"), "ip_version", "orig_ip", "orig_port", "resp_ip", "resp_port", "originator_basis", *[f"{x}_{c}" for c in _SIDES for x in ("orig", "resp")],
        stamp("first_us").alias("first_timestamp"), stamp("last_us").alias("last_timestamp"), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (span / 1_000_000).cast("decimal(18,6)")).alias("duration"), "missing_timestamp_packets", "late_packets",
        "orig_tcp_flags", "resp_tcp_flags", "handshake_complete", "syn_seen", "fin_seen", "reset_seen", "simultaneous_open", "equal_endpoints",
        (~tcp | ~F.col("handshake_complete") | (~F.col("reset_seen") & ~fins)).alias("partial_session"),
        (F.col("equal_endpoints") | F.coalesce("simultaneous_open", F.lit(False)) | (F.col("late_packets") > 0) | (F.col("missing_timestamp_packets") > 0) | (F.col("originator_basis") == "first_packet")).alias("ambiguous"),
        "finalized_by", span.alias("duration_us"),
    )
