"""The TLS record that begins a packet's payload, and the pieces of a hello that need no more than its bytes."""

from __future__ import annotations

import pyarrow as pa

FIELDS = {"is_tls": pa.bool_(), "tls_record_type": pa.int16(), "tls_record_version": pa.int32(), "tls_handshake_type": pa.int16(), "tls_sni": pa.string(), "tls_truncated": pa.bool_()}
#: Record types from change_cipher_spec to heartbeat, longest record, and the extension that names the server.
TYPES, LONGEST, HANDSHAKE, CLIENT_HELLO, SERVER_NAME = range(20, 25), 18_432, 22, 1, 0


def escape(raw: bytes) -> str:
    """Text of bytes; those that aren't printable, blanks and backslashes as a backslash and three digits."""
    return "".join(chr(b) if 33 <= b <= 126 and b != 0x5C else f"\\{b:03d}" for b in raw)


class Short(Exception):
    """A field runs past the bytes there are."""


class Bytes:
    """Reads fields in order; a field that isn't whole raises Short."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def left(self) -> int:
        return len(self.raw) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left():
            raise Short
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def vector(self, width: int) -> Bytes:
        return Bytes(self.take(self.number(width)))


def server_name(extension: bytes) -> str | None:
    """The first host name of a server_name extension; None if the list is malformed or has none."""
    b = Bytes(extension)
    try:
        names = b.vector(2)
        if b.left():
            return None
        found = None
        while names.left():
            kind, name = names.number(1), names.vector(2).raw
            if kind == 0 and found is None and name:
                found = escape(name)
        return found
    except Short:
        return None


def valid_header(p: bytes) -> bool:
    return len(p) >= 5 and p[0] in TYPES and p[1] == 3 and p[2] <= 4 and 0 < int.from_bytes(p[3:5], "big") <= LONGEST


def record_fields(payload: bytes) -> dict:
    """What the packet layer tells of a payload; a record that goes on in the next segment is none here."""
    none = dict.fromkeys(FIELDS) | {"is_tls": False}
    if not valid_header(payload) or int.from_bytes(payload[3:5], "big") + 5 > len(payload):
        return none
    out = none | {"is_tls": True, "tls_record_type": payload[0], "tls_record_version": int.from_bytes(payload[1:3], "big")}
    body = Bytes(payload[5 : 5 + int.from_bytes(payload[3:5], "big")])
    if payload[0] != HANDSHAKE or body.left() < 4:
        return out
    out["tls_handshake_type"] = body.number(1)
    if out["tls_handshake_type"] != CLIENT_HELLO:
        return out
    out["tls_truncated"] = False
    try:
        hello = body.vector(3)
        hello.take(34)
        for width in (1, 2, 1):
            hello.vector(width)
        if hello.left():
            extensions = hello.vector(2)
            while extensions.left() >= 4:
                kind, value = extensions.number(2), extensions.vector(2)
                if kind == SERVER_NAME:
                    out["tls_sni"] = server_name(value.raw)
                    break
    except Short:
        out["tls_truncated"], out["tls_sni"] = True, None
    return out
