"""Hellos and certificates in one direction of a TCP stream."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from netloom.sources import x509
from netloom.sources.tls_record import Bytes, Short, escape, server_name, valid_header

#: Limits: bytes searched for a first hello, bytes of a message, hellos, list entries, extensions, certificates.
SEARCH, MOST_MESSAGE, MOST_HELLOS, MOST_ENTRIES, MOST_EXTENSIONS, MOST_CERTIFICATES, MOST_CERTIFICATE = 8192, 65_536, 16, 1024, 256, 16, 32_768
#: Extension numbers: server_name, supported_groups, ec_point_formats, signature_algorithms, alpn, supported_versions.
SNI, GROUPS, POINTS, SIGNATURES, ALPN, VERSIONS = 0, 10, 11, 13, 16, 43
CHANGE_CIPHER, ALERT, HANDSHAKE = 20, 21, 22
CLIENT, SERVER, CERTIFICATE = 1, 2, 11


@dataclass
class Hello:
    """A ClientHello or ServerHello; a list is None if absent or malformed, ``bad`` names the malformed ones."""

    client: bool
    span: tuple[int, int]
    version: int | None = None
    session: bytes = b""
    suites: list[int] | None = None
    suite: int | None = None
    extensions: list[int] | None = None
    sni: str | None = None
    lists: dict[int, list] = field(default_factory=dict)
    selected: int | None = None
    bad: set[int] = field(default_factory=set)
    status: str | None = None
    error: str | None = None
    certificates: list | None = None


@dataclass
class Side:
    """What one direction holds."""

    hellos: list[Hello] = field(default_factory=list)
    status: str | None = None
    error: str | None = None
    prefix: int = 0
    tunnel: str | None = None
    destination: str | None = None


def _numbers(raw: bytes, length: int, width: int) -> list[int]:
    b = Bytes(raw)
    body = b.vector(length)
    if b.left() or body.left() % width or not body.left():
        raise Short
    return [body.number(width) for _ in range(body.left() // width)]


def _alpn(raw: bytes) -> list[str]:
    b = Bytes(raw)
    body, out = b.vector(2), []
    if b.left() or not body.left():
        raise Short
    while body.left():
        one = body.vector(1).raw
        if not one:
            raise Short
        out.append(escape(one))
    return out


def _extensions(b: Bytes, h: Hello) -> None:
    h.extensions = []
    if not b.left():
        return
    body = b.vector(2)
    if b.left():
        raise Short
    while body.left():
        kind, raw = body.number(2), body.vector(2).raw
        again = kind in h.extensions
        h.extensions.append(kind)
        if len(h.extensions) > MOST_EXTENSIONS:
            h.status, h.error = "limit", "TLS extension count exceeds limit"
            return
        read = {GROUPS: lambda r: _numbers(r, 2, 2), POINTS: lambda r: _numbers(r, 1, 1), SIGNATURES: lambda r: _numbers(r, 2, 2), ALPN: _alpn, VERSIONS: lambda r: _numbers(r, 1, 2)}
        try:
            if kind == SNI and h.client:
                h.sni = server_name(raw)
                if h.sni is None:
                    raise Short
            elif kind == VERSIONS and not h.client:
                if len(raw) != 2:
                    raise Short
                h.selected = int.from_bytes(raw, "big")
            elif kind in read and (h.client or kind == ALPN):
                if again:
                    raise Short
                values = read[kind](raw)
                if len(values) > MOST_ENTRIES:
                    h.status, h.error = "limit", "TLS list exceeds limit"
                h.lists[kind] = values
        except Short:
            h.bad.add(kind)
            h.lists.pop(kind, None)


def hello(raw: bytes, client: bool, span: tuple[int, int]) -> Hello:
    h = Hello(client, span)
    b = Bytes(raw)
    try:
        h.version = b.number(2)
        b.take(32)
        h.session = b.vector(1).raw
        if client:
            suites = b.vector(2).raw
            if len(suites) % 2 or not suites:
                raise Short
            h.suites = [int.from_bytes(suites[i : i + 2], "big") for i in range(0, len(suites), 2)]
            b.vector(1)
        else:
            h.suite = b.number(2)
            b.take(1)
        _extensions(b, h)
    except Short:
        h.status, h.error = "invalid", "malformed TLS hello"
        h.suites = h.extensions = None
    return h


def certificates(raw: bytes) -> list | None:
    """The chain of a Certificate message of TLS 1.2 or before; a certificate that can't be parsed keeps its place as None."""
    b, out = Bytes(raw), []
    try:
        chain = b.vector(3)
        while chain.left():
            one = chain.vector(3).raw
            if len(out) >= MOST_CERTIFICATES:
                break
            out.append(x509.parse(one) if len(one) <= MOST_CERTIFICATE else None)
    except Short:
        return [*out, None]
    return out


def _records(data: bytes, at: int) -> tuple[bytes, list[tuple[int, int, int]], bool]:
    """Handshake bytes of records from ``at`` to the first ChangeCipherSpec; where they lie; whether a record was cut."""
    out, places, size = [], [], 0
    while at < len(data):
        head = data[at : at + 5]
        if len(head) < 5:
            return b"".join(out), places, True
        if not valid_header(head) or head[0] not in (ALERT, HANDSHAKE):
            return b"".join(out), places, False
        n = int.from_bytes(head[3:5], "big")
        body = data[at + 5 : at + 5 + n]
        if head[0] == HANDSHAKE:
            places.append((size, size + len(body), at))
            out.append(body)
            size += len(body)
        if len(body) < n:
            return b"".join(out), places, True
        at += 5 + n
    return b"".join(out), places, False


def _starts_hello(data: bytes, at: int) -> bool:
    head = data[at : at + 9]
    return len(head) == 9 and head[0] == HANDSHAKE and valid_header(head) and head[5] in (CLIENT, SERVER) and head[6] == 0


def read_side(data: bytes, anchored: bool, gapped: bool) -> Side | None:
    """Hellos of a direction's first run of bytes; None if it holds no TLS."""
    at = 0
    if not _starts_hello(data, 0):
        at = next((m.start() for m in re.finditer(rb"\x16\x03[\x00-\x04]", data[: SEARCH + 3]) if _starts_hello(data, m.start())), -1)
        if at < 0:
            return None
    side = Side(prefix=at)
    raw, places, cut = _records(data, at)
    where, pos = Bytes(raw), 0
    while where.left() >= 4 and len(side.hellos) < MOST_HELLOS:
        kind, size = raw[pos], int.from_bytes(raw[pos + 1 : pos + 4], "big")
        lies = [p for p in places if p[0] < pos + 4 + size and p[1] > pos]
        span = (lies[0][2], lies[-1][2] + 5 + lies[-1][1] - lies[-1][0]) if lies else (at, at + 5)
        if size > MOST_MESSAGE:
            side.status, side.error = "limit", "TLS handshake message exceeds limit"
            break
        where.take(4)
        pos += 4
        if size > where.left():
            if kind in (CLIENT, SERVER):
                side.hellos.append(Hello(kind == CLIENT, span, status="incomplete", error="TLS hello is cut short"))
            cut = True
            break
        body = where.take(size)
        pos += size
        if kind in (CLIENT, SERVER):
            side.hellos.append(hello(body, kind == CLIENT, span))
        elif kind == CERTIFICATE and side.hellos and side.hellos[-1].certificates is None:
            side.hellos[-1].certificates = certificates(body)
    if not side.hellos:
        return None
    if not anchored:
        side.status, side.error = "unanchored", "TCP SYN was not captured"
    elif cut and side.status is None and side.hellos[-1].status == "incomplete":
        side.status, side.error = "incomplete", "missing TCP bytes leave a sequence gap" if gapped else "TLS hello is cut short"
    if at:
        if side.hellos[0].client:
            side.tunnel, side.destination = client_prefix(data[:at])
        else:
            side.tunnel = server_prefix(data[:at])
    return side


def _address(b: Bytes, kind: int) -> str:
    import ipaddress

    if kind == 1:
        host = str(ipaddress.IPv4Address(b.take(4)))
    elif kind == 4:
        host = f"[{ipaddress.IPv6Address(b.take(16))}]"
    elif kind == 3:
        host = escape(b.vector(1).raw)
        if not host:
            raise Short
    else:
        raise Short
    return f"{host}:{b.number(2)}"


def client_prefix(raw: bytes) -> tuple[str | None, str | None]:
    """Tunnel protocol and destination that bytes before a ClientHello ask for."""
    b = Bytes(raw)
    try:
        if raw[:1] == b"\x05":
            b.take(1)
            methods = b.vector(1).raw
            if not methods:
                return None, None
            if b.left() and raw[b.at] == 1 and 2 in methods:
                b.take(1)
                if not b.vector(1).raw or not b.vector(1).raw:
                    return None, None
            if b.take(3) != b"\x05\x01\x00":
                return None, None
            to = _address(b, b.number(1))
            return (None, None) if b.left() else ("socks5", to)
        if raw[:2] == b"\x04\x01" and len(raw) >= 9:
            port, ip, rest = int.from_bytes(raw[2:4], "big"), raw[4:8], raw[8:].split(b"\0")
            if ip[:3] == b"\0\0\0" and ip[3]:
                return ("socks4a", f"{escape(rest[1])}:{port}") if len(rest) == 3 and rest[1] and not rest[2] else (None, None)
            return ("socks4", f"{'.'.join(map(str, ip))}:{port}") if len(rest) == 2 and not rest[1] else (None, None)
    except Short:
        return None, None
    found = re.fullmatch(rb"(?:CONNECT (\S+) HTTP/1\.[01]\r\n(?:[^\r\n]+\r\n)*\r\n)+", raw)
    if found:
        return "http_connect", escape(found[1])
    lines = raw.upper().split(b"\r\n")
    if lines[-1] or len(lines) < 2:
        return None, None
    *before, last = lines[:-1]
    heads = [x.split(b" ")[0] for x in before]
    if last == b"STARTTLS" and before and heads[0] in (b"EHLO", b"HELO") and all(h in (b"EHLO", b"HELO", b"NOOP", b"RSET") for h in heads):
        return "smtp", None
    if last == b"STLS" and all(h == b"CAPA" for h in heads):
        return "pop3", None
    if last.startswith(b"AUTH ") and last[5:] in (b"TLS", b"SSL", b"TLS-C", b"TLS-P") and all(h in (b"FEAT", b"SYST", b"NOOP", b"AUTH") for h in heads):
        return "ftp", None
    tags = [x.split(b" ") for x in (*before, last)]
    if all(len(t) == 2 and t[0] != b"*" for t in tags) and tags[-1][1] == b"STARTTLS" and all(t[1] in (b"CAPABILITY", b"NOOP") for t in tags[:-1]):
        return "imap", None
    return None, None


def server_prefix(raw: bytes) -> str | None:
    """Tunnel protocol that bytes before a ServerHello answer for."""
    if raw[:1] == b"\x05" and len(raw) > 2:
        rest = raw[2:] if raw[1] == 0 else raw[4:] if raw[1] == 2 and raw[2:4] == b"\x01\0" else b""
        if rest[:3] == b"\x05\0\0" and len(rest) > 4:
            size = {1: 10, 4: 22, 3: 7 + rest[4]}.get(rest[3])
            return "socks5" if size == len(rest) else None
        return None
    if raw[:2] == b"\0\x5a" and len(raw) == 8:
        return "socks4"
    if re.search(rb"(?s)(?:^|\r\n)HTTP/1\.[01] 200[^\r\n]*\r\n(?:[^\r\n]+\r\n)*\r\n$", raw) and raw.startswith(b"HTTP/1."):
        return "http_connect"
    lines = raw.split(b"\r\n")
    if lines[-1] or len(lines) < 2:
        return None
    first, last = lines[0], lines[-2]
    if first.startswith(b"220") and last.startswith(b"220"):
        return "smtp"
    if first.startswith(b"220") and last.startswith(b"234"):
        return "ftp"
    if first.startswith(b"+OK") and last.startswith(b"+OK"):
        return "pop3"
    return "imap" if first.startswith(b"* OK") and b" OK" in last.upper() else None
