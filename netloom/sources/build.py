"""Builds frames, DNS messages and capture files, for export, round trips and fixtures."""

from __future__ import annotations

import ipaddress
import struct

MAC = b"\x02\x00\x00\x00\x00\x01", b"\x02\x00\x00\x00\x00\x02"


def ethernet(payload: bytes, ether_type: int, vlans: tuple[int, ...] = (), src: bytes = MAC[0], dst: bytes = MAC[1]) -> bytes:
    tags = b"".join(struct.pack(">HH", 0x8100, v) for v in vlans)
    return dst + src + tags + struct.pack(">H", ether_type) + payload


def ipv4(src: str, dst: str, protocol: int, payload: bytes, ident: int = 0, fragment: int = 0, ttl: int = 64, total: int | None = None, options: bytes = b"") -> bytes:
    size = 20 + len(options) + len(payload) if total is None else total
    return struct.pack(">BBHHHBBH4s4s", 0x40 | (5 + len(options) // 4), 0, size & 0xFFFF, ident, fragment, ttl, protocol, 0, ipaddress.IPv4Address(src).packed, ipaddress.IPv4Address(dst).packed) + options + payload


def ipv6(src: str, dst: str, protocol: int, payload: bytes, hops: int = 64) -> bytes:
    return struct.pack(">IHBB", 0x60000000, len(payload), protocol, hops) + ipaddress.IPv6Address(src).packed + ipaddress.IPv6Address(dst).packed + payload


def udp(src: int, dst: int, payload: bytes) -> bytes:
    return struct.pack(">HHHH", src, dst, 8 + len(payload), 0) + payload


def tcp(src: int, dst: int, seq: int, ack: int, flags: int, payload: bytes = b"", options: bytes = b"") -> bytes:
    return struct.pack(">HHIIBBHHH", src, dst, seq & 0xFFFFFFFF, ack & 0xFFFFFFFF, (5 + len(options) // 4) << 4, flags, 65535, 0, 0) + options + payload


def packet(src: str, dst: str, protocol: int, segment: bytes, vlans: tuple[int, ...] = (), **ip) -> bytes:
    six = ":" in src
    return ethernet(ipv6(src, dst, protocol, segment) if six else ipv4(src, dst, protocol, segment, **ip), 0x86DD if six else 0x0800, vlans)


def dns_name(name: str) -> bytes:
    return b"".join(bytes([len(p)]) + p.encode("latin-1") for p in name.split(".") if p) + b"\0"


def dns_query(ident: int, name: str, kind: int = 1, flags: int = 0x0100, answers: bytes = b"", answer_count: int = 0) -> bytes:
    return struct.pack(">6H", ident, flags, 1, answer_count, 0, 0) + dns_name(name) + struct.pack(">HH", kind, 1) + answers


def pcap(records: list[tuple[int | None, bytes]], link: int = 1, order: str = "<", nanoseconds: bool = False, snaplen: int = 65535) -> bytes:
    """A classic capture of (microseconds, bytes) records; a third element gives the original length."""
    out = [struct.pack(order + "IHHiIII", 0xA1B23C4D if nanoseconds else 0xA1B2C3D4, 2, 4, 0, 0, snaplen, link)]
    for ts, data, *original in records:
        sec, us = divmod(ts, 1_000_000)
        out.append(struct.pack(order + "IIII", sec, us * 1000 if nanoseconds else us, len(data), original[0] if original else len(data)) + data)
    return b"".join(out)


def block(kind: int, body: bytes, order: str = "<") -> bytes:
    body += b"\0" * (-len(body) % 4)
    n = len(body) + 12
    return struct.pack(order + "II", kind, n) + body + struct.pack(order + "I", n)


def section(order: str = "<") -> bytes:
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(link: int = 1, snaplen: int = 0, resolution: int | None = None, order: str = "<") -> bytes:
    options = b"" if resolution is None else struct.pack(order + "HHB3xHH", 9, 1, resolution, 0, 0)
    return block(1, struct.pack(order + "HHI", link, 0, snaplen) + options, order)


def enhanced(ticks: int, data: bytes, face: int = 0, original: int | None = None, order: str = "<") -> bytes:
    return block(6, struct.pack(order + "IIIII", face, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data) if original is None else original) + data, order)


def simple(data: bytes, original: int | None = None, order: str = "<") -> bytes:
    return block(3, struct.pack(order + "I", len(data) if original is None else original) + data, order)


def client_hello(sni: str | None, suites: list[int], groups: list[int] = (29, 23), signatures: list[int] = (1027, 2052), versions: list[int] = (), alpn: list[str] = (), points: list[int] = (0,), session: bytes = b"") -> bytes:
    """A ClientHello message with its handshake header."""
    parts = []

    def add(kind: int, body: bytes) -> None:
        parts.append(struct.pack(">HH", kind, len(body)) + body)

    def listed(values, width: int, length: int) -> bytes:
        body = b"".join(v.to_bytes(width, "big") for v in values)
        return len(body).to_bytes(length, "big") + body

    if sni is not None:
        name = b"\0" + struct.pack(">H", len(sni)) + sni.encode("latin-1")
        add(0, struct.pack(">H", len(name)) + name)
    if groups:
        add(10, listed(groups, 2, 2))
    if points:
        add(11, listed(points, 1, 1))
    if signatures:
        add(13, listed(signatures, 2, 2))
    if alpn:
        body = b"".join(bytes([len(a)]) + a.encode() for a in alpn)
        add(16, struct.pack(">H", len(body)) + body)
    if versions:
        add(43, listed(versions, 2, 1))
    extensions = b"".join(parts)
    body = b"\x03\x03" + bytes(32) + bytes([len(session)]) + session + listed(suites, 2, 2) + b"\x01\x00" + struct.pack(">H", len(extensions)) + extensions
    return b"\x01" + len(body).to_bytes(3, "big") + body


def server_hello(suite: int, version: int | None = None, session: bytes = b"") -> bytes:
    extensions = b"" if version is None else struct.pack(">HHH", 43, 2, version)
    body = b"\x03\x03" + bytes(32) + bytes([len(session)]) + session + struct.pack(">HBH", suite, 0, len(extensions)) + extensions
    return b"\x02" + len(body).to_bytes(3, "big") + body


def tls_record(body: bytes, kind: int = 22) -> bytes:
    return struct.pack(">BHH", kind, 0x0303, len(body)) + body


def conversation(client: str, server: str, cport: int, sport: int, ask: bytes, answer: bytes, mss: int = 1400) -> list[bytes]:
    """Frames of a TCP connection with a handshake, both sides' bytes and FINs."""
    out, seqs = [], [1000, 9000]

    def send(side: int, flags: int, data: bytes = b"") -> None:
        a, b = (client, server) if side == 0 else (server, client)
        p, q = (cport, sport) if side == 0 else (sport, cport)
        out.append(packet(a, b, 6, tcp(p, q, seqs[side], seqs[1 - side] if flags & 16 else 0, flags, data)))
        seqs[side] += len(data) + bool(flags & 3)

    send(0, 2)
    send(1, 18)
    send(0, 16)
    for side, data in ((0, ask), (1, answer)):
        for i in range(0, len(data), mss):
            send(side, 24, data[i : i + mss])
    send(0, 17)
    send(1, 17)
    return out
