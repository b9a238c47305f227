"""DNS messages: names, questions and resource records, with limits on work that hostile messages can cause."""

from __future__ import annotations

import struct
from ipaddress import IPv6Address

import pyarrow as pa

#: Limits of the format and of the work done for one message.
MOST_RECORDS, MOST_NAME, MOST_POINTERS, MOST_WORK, MOST_BYTES = 4096, 255, 127, 262_144, 65_535
BAD = "malformed or truncated DNS message"
_QUESTION = pa.struct([("name", pa.string()), ("type", pa.int32()), ("class", pa.int32())])
_RECORD = pa.struct([("name", pa.string()), ("type", pa.int32()), ("class", pa.int32()), ("ttl", pa.int64()), ("value", pa.string()), ("data", pa.binary())])
SECTIONS = {"dns_questions": _QUESTION, "dns_answers": _RECORD, "dns_authorities": _RECORD, "dns_additionals": _RECORD}
FIELDS = {
    "dns_valid": pa.bool_(), "dns_id": pa.int32(), "dns_response": pa.bool_(), "dns_opcode": pa.int16(), "dns_rcode": pa.int16(), "dns_truncated": pa.bool_(), "dns_question_name": pa.string(), "dns_question_type": pa.int32(), "dns_question_class": pa.int32(),
} | {k: pa.list_(v) for k, v in SECTIONS.items()} | {"dns_error": pa.string()}
_ESCAPED = {b: chr(b) if 33 <= b <= 126 and b not in b".\\" else f"\\{b:03d}" for b in range(256)}


class _Bad(Exception):
    pass


class _Message:
    def __init__(self, data: bytes):
        self.data, self.at, self.work = data, 12, 0

    def _take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _Bad
        self.at += n
        return self.data[self.at - n : self.at]

    def name(self) -> str:
        """A name; pointers must lead before the part they stand in, so that none can go round."""
        data, at, part, rest = self.data, self.at, self.at, None
        labels, size, pointers = [], 1, 0
        while True:
            self.work += 1
            if self.work > MOST_WORK or at >= len(data):
                raise _Bad
            n = data[at]
            at += 1
            if n >= 0xC0:
                if at >= len(data):
                    raise _Bad
                to = (n & 0x3F) << 8 | data[at]
                pointers += 1
                if not 12 <= to < part or pointers > MOST_POINTERS:
                    raise _Bad
                rest = at + 1 if rest is None else rest
                at = part = to
            elif n > 63 or at + n > len(data):
                raise _Bad
            elif n == 0:
                self.at = at if rest is None else rest
                return ".".join(labels) or "."
            else:
                size += n + 1
                if size > MOST_NAME:
                    raise _Bad
                labels.append("".join(map(_ESCAPED.__getitem__, data[at : at + n])))
                at += n

    def records(self, count: int) -> list[dict]:
        out = []
        for _ in range(count):
            name = self.name()
            kind, klass, ttl, size = struct.unpack(">HHIH", self._take(10))
            start = self.at
            raw, value = self._take(size), None
            if klass == 1 and kind in (1, 28):
                if size != (4 if kind == 1 else 16):
                    raise _Bad
                value = ".".join(map(str, raw)) if kind == 1 else IPv6Address(raw).exploded
            elif kind in (2, 5, 12):
                self.at = start
                value = self.name()
                if self.at != start + size:
                    raise _Bad
            out.append({"name": name, "type": kind, "class": klass, "ttl": ttl, "value": value, "data": raw})
        return out


def decode(data: bytes) -> dict:
    """Fields of a whole message; a message that is not well formed to its last byte has only ``dns_valid`` and an error."""
    none = dict.fromkeys(FIELDS) | {"dns_valid": False, "dns_error": BAD}
    if not 12 <= len(data) <= MOST_BYTES:
        return none
    ident, flags, *counts = struct.unpack_from(">6H", data)
    if sum(counts) > MOST_RECORDS:
        return none | {"dns_error": "DNS record count exceeds safety limit"}
    m = _Message(data)
    try:
        asked = []
        for _ in range(counts[0]):
            name = m.name()
            kind, klass = struct.unpack(">HH", m._take(4))
            asked.append({"name": name, "type": kind, "class": klass})
        parts = [m.records(n) for n in counts[1:]]
    except _Bad:
        return none
    if m.at != len(data):
        return none
    first = asked[0] if asked else dict.fromkeys(("name", "type", "class"))
    return {
        "dns_valid": True, "dns_id": ident, "dns_response": bool(flags & 0x8000), "dns_opcode": flags >> 11 & 15, "dns_rcode": flags & 15, "dns_truncated": bool(flags & 0x0200),
        "dns_question_name": first["name"], "dns_question_type": first["type"], "dns_question_class": first["class"],
        "dns_questions": asked, "dns_answers": parts[0], "dns_authorities": parts[1], "dns_additionals": parts[2], "dns_error": None,
    }


def decode_packet(payload: bytes, tcp: bool, declared: int) -> dict:
    """The message of one packet: a UDP payload, or over TCP exactly one message after its length."""
    if tcp:
        if len(payload) < 2 or int.from_bytes(payload[:2], "big") != len(payload) - 2:
            return dict.fromkeys(FIELDS) | {"dns_valid": False, "dns_error": "TCP DNS requires exactly one complete length-prefixed message per packet"}
        return decode(payload[2:])
    if len(payload) != declared:
        return dict.fromkeys(FIELDS) | {"dns_valid": False, "dns_error": "truncated UDP DNS payload"}
    return decode(payload)
