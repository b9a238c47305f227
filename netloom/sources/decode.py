"""Header fields of many packets at once: each step reads one field of all packets still in question."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

NONE, LINK, NETWORK, TRANSPORT = 0, 1, 2, 3
DECODED, MALFORMED, UNSUPPORTED, FRAGMENT = 1, 2, 3, 4
#: Link types, ether types, extension headers.
ETHERNET, RAW, COOKED, IPV4_ONLY, IPV6_ONLY, COOKED2 = 1, 101, 113, 228, 229, 276
IP4, IP6, TAGS = 0x0800, 0x86DD, (0x8100, 0x88A8)
EXTENSIONS = (0, 43, 60, 44, 51)
MOST_TAGS, MOST_EXTENSIONS = 8, 16


class Packets:
    """Decoded fields of a batch; every array has one entry per packet, with meaning only where its layer is decoded."""

    def __init__(self, data: np.ndarray, offset: np.ndarray, captured: np.ndarray, link: np.ndarray, depth: int = TRANSPORT):
        self.data, self.at, self.size, self.n = data, offset, captured, len(offset)
        self.outcome = np.zeros(self.n, np.int8)
        self.ethernet = np.zeros(self.n, bool)
        self.network = np.zeros(self.n, bool)
        self.transport = np.zeros(self.n, bool)
        self.tcp = np.zeros(self.n, bool)
        self.udp = np.zeros(self.n, bool)
        for f in ("ether_type", "ip_version", "ip_protocol", "ip_ttl", "ip_fragment_offset", "ip_id", "src_port", "dst_port", "tcp_flags", "tcp_seq", "tcp_ack", "tcp_header_length", "udp_length", "payload_offset", "payload_length", "payload_declared"):
            setattr(self, f, np.zeros(self.n, np.int64))
        self.more = np.zeros(self.n, bool)
        self.has_id = np.zeros(self.n, bool)
        self.vlans = np.zeros((self.n, MOST_TAGS), np.int32)
        self.tags = np.zeros(self.n, np.int64)
        self.ip_at = np.zeros(self.n, np.int64)
        if depth > NONE and self.n:
            self._link(link, depth)

    def _bytes(self, rows: np.ndarray, at: np.ndarray | int, width: int) -> np.ndarray:
        """Big-endian numbers of ``width`` bytes at an offset of each row; bytes beyond the file read as 0."""
        base = self.at[rows] + at
        out = np.zeros(len(rows), np.int64)
        top = len(self.data) - 1
        for i in range(width):
            out = out << 8 | self.data[np.minimum(base + i, top)]
        return out

    def _end(self, rows: np.ndarray, outcome: int) -> None:
        self.outcome[rows] = outcome

    def _link(self, link: np.ndarray, depth: int) -> None:
        kind = np.full(self.n, -1, np.int64)  # ether type of what follows; -1 while unknown
        at = np.zeros(self.n, np.int64)
        eth = np.flatnonzero(link == ETHERNET)
        ok = self.size[eth] >= 14
        self._end(eth[~ok], MALFORMED)
        eth = eth[ok]
        kind[eth], at[eth] = self._bytes(eth, 12, 2), 14
        live = eth
        for depth_now in range(MOST_TAGS + 1):
            live = live[np.isin(kind[live], TAGS)]
            if not len(live):
                break
            if depth_now == MOST_TAGS:
                bad, what = live, UNSUPPORTED
            else:
                short = self.size[live] < at[live] + 4
                bad, what = live[short], MALFORMED
            self._end(bad, what)
            self.vlans[bad], self.tags[bad], kind[bad] = 0, 0, -1
            live = live[~np.isin(live, bad)]
            if depth_now < MOST_TAGS and len(live):
                self.vlans[live, self.tags[live]] = self._bytes(live, at[live], 2) & 0xFFF
                self.tags[live] += 1
                kind[live] = self._bytes(live, at[live] + 2, 2)
                at[live] += 4
        good = eth[self.outcome[eth] == 0]
        self.ethernet[good], self.ether_type[good] = True, kind[good]
        if depth == LINK:
            self.outcome[good] = DECODED
            self.outcome[link != ETHERNET] = UNSUPPORTED
            return
        raw = np.flatnonzero(link == RAW)
        empty = self.size[raw] < 1
        self._end(raw[empty], MALFORMED)
        raw = raw[~empty]
        version = self._bytes(raw, 0, 1) >> 4
        kind[raw] = np.where(version == 4, IP4, np.where(version == 6, IP6, 0))
        kind[link == IPV4_ONLY], kind[link == IPV6_ONLY] = IP4, IP6
        for which, length, where in ((COOKED, 16, 14), (COOKED2, 20, 0)):
            rows = np.flatnonzero(link == which)
            short = self.size[rows] < length
            self._end(rows[short], MALFORMED)
            rows = rows[~short]
            kind[rows], at[rows] = self._bytes(rows, where, 2), length
        self._end(np.flatnonzero((kind == -1) & (self.outcome == 0)), UNSUPPORTED)
        rows = np.flatnonzero(self.outcome == 0)
        self._end(rows[(kind[rows] != IP4) & (kind[rows] != IP6)], UNSUPPORTED)
        self._end(rows[(kind[rows] == 0) & (link[rows] == RAW)], MALFORMED)
        end = np.zeros(self.n, np.int64)
        four = self._ipv4(rows[kind[rows] == IP4], at, end)
        six = self._ipv6(rows[kind[rows] == IP6], at, end)
        rows = np.sort(np.concatenate([four, six]))
        self.network[rows] = True
        part = (self.ip_fragment_offset[rows] != 0) | self.more[rows]
        self._end(rows[part], FRAGMENT)
        rows = rows[~part]
        if depth == NETWORK:
            self._end(rows, DECODED)
        else:
            self._transport(rows, at, end)

    def _ipv4(self, rows: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        o = at[rows]
        first = self._bytes(rows, o, 1)
        header, total = (first & 15) * 4, self._bytes(rows, o + 2, 2)
        ok = (self.size[rows] >= o + 20) & (first >> 4 == 4) & (header >= 20) & (total >= header) & (self.size[rows] >= o + header)
        self._end(rows[~ok], MALFORMED)
        rows, o, header, total = rows[ok], o[ok], header[ok], total[ok]
        end[rows] = o + total
        self.ip_version[rows] = 4
        self.ip_protocol[rows], self.ip_ttl[rows], self.ip_id[rows] = self._bytes(rows, o + 9, 1), self._bytes(rows, o + 8, 1), self._bytes(rows, o + 4, 2)
        self.has_id[rows] = True
        word = self._bytes(rows, o + 6, 2)
        self.ip_fragment_offset[rows], self.more[rows] = (word & 0x1FFF) * 8, word & 0x2000 != 0
        self.ip_at[rows] = o + 12
        at[rows] = o + header
        return rows

    def _ipv6(self, rows: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        o = at[rows]
        ok = (self.size[rows] >= o + 40) & (self._bytes(rows, o, 1) >> 4 == 6)
        self._end(rows[~ok], MALFORMED)
        rows, o = rows[ok], o[ok]
        end[rows] = o + 40 + self._bytes(rows, o + 4, 2)
        proto, ttl = self._bytes(rows, o + 6, 1), self._bytes(rows, o + 7, 1)
        at[rows] = o + 40
        live, seen = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        offset, more, ident, has = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        bad = np.zeros(len(rows), np.int8)
        while len(live := live[np.isin(proto[live], EXTENSIONS) & (offset[live] == 0)]):
            seen[live] += 1
            many = seen[live] > MOST_EXTENSIONS
            bad[live[many]] = UNSUPPORTED
            live = live[~many]
            r, x = rows[live], at[rows[live]]
            room = np.minimum(end[r], self.size[r])
            kind = proto[live]
            length = np.where(kind == 44, 8, np.where(kind == 51, (self._bytes(r, x + 1, 1) + 2) * 4, (self._bytes(r, x + 1, 1) + 1) * 8))
            ok = (x + 8 <= room) & ~((kind == 44) & has[live]) & (length >= np.where(kind == 51, 12, 8)) & (x + length <= room)
            bad[live[~ok]] = MALFORMED
            live, r, x, kind, length = live[ok], r[ok], x[ok], kind[ok], length[ok]
            cut = kind == 44
            word = self._bytes(r[cut], x[cut] + 2, 2)
            offset[live[cut]], more[live[cut]], ident[live[cut]], has[live[cut]] = word & 0xFFF8, word & 1 != 0, self._bytes(r[cut], x[cut] + 4, 4), True
            proto[live] = self._bytes(r, x, 1)
            at[r] = x + length
        self._end(rows[bad > 0], 0)
        self.outcome[rows[bad > 0]] = bad[bad > 0]
        ok = bad == 0
        rows, o = rows[ok], o[ok]
        self.ip_version[rows], self.ip_protocol[rows], self.ip_ttl[rows] = 6, proto[ok], ttl[ok]
        self.ip_fragment_offset[rows], self.more[rows], self.ip_id[rows], self.has_id[rows] = offset[ok], more[ok], ident[ok], has[ok]
        self.ip_at[rows] = o + 8
        return rows

    def _transport(self, rows: np.ndarray, at: np.ndarray, end: np.ndarray) -> None:
        o, e = at[rows], end[rows]
        room = np.minimum(e, self.size[rows])
        proto = self.ip_protocol[rows]
        tcp, udp = proto == 6, proto == 17
        self._end(rows[~tcp & ~udp], UNSUPPORTED)
        header = np.where(tcp, (self._bytes(rows, o + 12, 1) >> 4) * 4, 8)
        length = self._bytes(rows, o + 4, 2)
        ok = (tcp & (o + 20 <= room) & (header >= 20) & (o + header <= room)) | (udp & (o + 8 <= room) & (length >= 8) & (o + length <= e))
        self._end(rows[(tcp | udp) & ~ok], MALFORMED)
        rows, o, e, header, tcp, length = rows[ok], o[ok], e[ok], header[ok], tcp[ok], length[ok]
        t, u = rows[tcp], rows[~tcp]
        self.tcp[t], self.udp[u], self.transport[rows] = True, True, True
        ot = o[tcp]
        self.tcp_flags[t], self.tcp_seq[t], self.tcp_ack[t], self.tcp_header_length[t] = self._bytes(t, ot + 13, 1), self._bytes(t, ot + 4, 4), self._bytes(t, ot + 8, 4), header[tcp]
        self.udp_length[u] = length[~tcp]
        e = np.where(tcp, e, o + length)
        self.src_port[rows], self.dst_port[rows] = self._bytes(rows, o, 2), self._bytes(rows, o + 2, 2)
        self.payload_offset[rows], self.payload_declared[rows] = o + header, e - o - header
        self.payload_length[rows] = np.minimum(e, self.size[rows]) - o - header
        self._end(rows, DECODED)

    # --- texts -----------------------------------------------------------------------------------------------------------
    def macs(self, at: int) -> pa.Array:
        """MAC addresses at an offset of the frame, in small letters."""
        rows = np.flatnonzero(self.ethernet)
        return _spread(rows, self.n, _hex_text(self._block(rows, self.at[rows] + at, 6), 1))

    def addresses(self, which: int) -> pa.Array:
        """Source (0) or destination (1) addresses: dotted IPv4, or IPv6 as eight groups of four digits."""
        four = np.flatnonzero(self.network & (self.ip_version == 4))
        six = np.flatnonzero(self.network & (self.ip_version == 6))
        numbers, back = np.unique(self._bytes(four, self.ip_at[four] + 4 * which, 4), return_inverse=True)
        names = pa.array([f"{v >> 24}.{v >> 16 & 255}.{v >> 8 & 255}.{v & 255}" for v in numbers.tolist()], pa.string())
        both = pa.concat_arrays([names.take(pa.array(back)), _hex_text(self._block(six, self.at[six] + self.ip_at[six] + 16 * which, 16), 2)])
        return _spread(np.concatenate([four, six]), self.n, both)

    def _block(self, rows: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        return self.data[np.minimum(start[:, None] + np.arange(width), len(self.data) - 1)] if len(rows) else np.empty((0, width), np.uint8)

    def vlan_lists(self) -> pa.Array:
        there = np.arange(MOST_TAGS)[None, :] < self.tags[:, None]
        ends = np.concatenate([[0], np.cumsum(np.where(self.ethernet, self.tags, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.vlans[there & self.ethernet[:, None]]))
        return lists if self.ethernet.all() else lists.take(pa.array(np.where(self.ethernet, np.arange(self.n), -1), mask=~self.ethernet))

    def column(self, name: str, mask: np.ndarray, kind: pa.DataType, values: np.ndarray | None = None) -> pa.Array:
        return pa.array(getattr(self, name) if values is None else values, mask=~mask).cast(kind)

    def payload(self, row: int) -> bytes:
        start = int(self.at[row] + self.payload_offset[row])
        return self.data[start : start + int(self.payload_length[row])].tobytes()


def _hex_text(block: np.ndarray, group: int) -> pa.Array:
    """Rows of bytes as hexadecimal text with a colon after each ``group`` bytes, built without a loop over rows."""
    n, width = block.shape
    if not n:
        return pa.array([], pa.string())
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    pairs = np.stack([digits[block >> 4], digits[block & 15]], axis=2).reshape(n, width // group, 2 * group)
    text = np.concatenate([pairs, np.full((n, width // group, 1), ord(":"), np.uint8)], axis=2).reshape(n, -1)[:, :-1]
    size = text.shape[1]
    ends = np.arange(n + 1, dtype=np.int32) * size
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(text).tobytes()))


def _spread(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Values at the given rows of n, nulls elsewhere."""
    place = np.full(n, -1, np.int64)
    place[rows] = np.arange(len(rows))
    return values.take(pa.array(place, mask=place < 0))
