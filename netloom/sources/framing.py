"""Records of PCAP and PCAPNG files, as arrays over the file's bytes."""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the two formats.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
MOST_BYTES = 256 << 20
MOST_INTERFACES, MOST_INTERFACE_BYTES = 65_536, 16 << 20
COLUMNS = ("packet_number", "ts", "captured_length", "original_length", "link_type", "interface_id", "packet_offset", "section_number")
#: Stands for a missing time.
NO_TIME = np.iinfo(np.int64).min


class CaptureError(ValueError):
    """A capture that can't be read; the message names file, packet and byte."""


class _Cut(Exception):
    """The file ends inside what is being read."""


def open_bytes(path: str) -> np.ndarray:
    """The bytes of a file, mapped where possible."""
    if os.path.getsize(path) == 0:
        return np.empty(0, np.uint8)
    with open(path, "rb") as f:
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)


@dataclass
class Capture:
    """One pass over a capture. ``batches`` yields arrays by column; the other fields tell what has been seen so far."""

    path: str
    data: np.ndarray
    chunk: int = 16_384
    format: str = ""
    packets: int = 0
    truncated: bool = False
    link_types: set[int] = field(default_factory=set)
    sections: int = 0

    def __post_init__(self):
        self.view = memoryview(self.data)
        self.at = 0

    def _fail(self, what: str) -> CaptureError:
        return CaptureError(f"Capture '{self.path}', packet cursor {self.packets}, byte cursor {self.at}: {what}")

    def _need(self, at: int, n: int) -> None:
        if at + n > len(self.view):
            raise _Cut

    def batches(self) -> Iterator[dict[str, np.ndarray]]:
        """Records in file order. A file cut after its first whole record ends there; one cut before it is an error."""
        if not len(self.view):
            raise self._fail("the file is empty")
        magic = bytes(self.view[:4])
        if len(magic) < 4:
            raise self._fail("the file ends inside its magic number")
        if magic in CLASSIC:
            self.format, walk = "pcap", self._classic(*CLASSIC[magic])
        elif magic == b"\x0a\x0d\x0d\x0a":
            self.format, walk = "pcapng", self._chunks(self._blocks())
        else:
            raise self._fail("not a PCAP or PCAPNG capture")
        try:
            yield from walk
        except _Cut:
            if not self.packets:
                raise self._fail("the file ends inside its headers or first record") from None
            self.truncated = True
        except struct.error as e:
            raise self._fail(str(e)) from None

    def _chunks(self, rows: Iterator[tuple]) -> Iterator[dict[str, np.ndarray]]:
        """Rows of ``COLUMNS`` but the first, as arrays; what came before an error or the end of the file comes out first."""
        held: list[tuple] = []
        try:
            for row in rows:
                held.append(row)
                self.packets += 1
                if len(held) >= self.chunk:
                    yield self._arrays(np.array(held, np.int64).T)
                    held = []
        except _Cut:
            if held:
                yield self._arrays(np.array(held, np.int64).T)
            raise
        if held:
            yield self._arrays(np.array(held, np.int64).T)

    def _arrays(self, columns: np.ndarray | list[np.ndarray]) -> dict[str, np.ndarray]:
        n = len(columns[0])
        return {"packet_number": np.arange(self.packets - n + 1, self.packets + 1)} | dict(zip(COLUMNS[1:], columns, strict=True))

    def _classic(self, order: str, per_us: int) -> Iterator[dict[str, np.ndarray]]:
        """Only the captured lengths are walked one by one; the other fields of a chunk's headers are gathered together."""
        view, size = self.view, len(self.view)
        self._need(0, 24)
        major, _, _, _, _, link = struct.unpack_from(order + "HHiIII", view, 4)
        if major != 2:
            raise self._fail(f"unsupported PCAP version {major}")
        self.link_types.add(link)
        length, at, bad, cut = struct.Struct(order + "I").unpack_from, 24, None, False
        while at < size and not (bad or cut):
            starts: list[int] = []
            add = starts.append
            for _ in range(self.chunk):
                if at + 16 > size:
                    cut = at < size
                    break
                captured = length(view, at + 8)[0]
                if captured > MOST_BYTES:
                    bad = f"a packet of {captured} bytes exceeds the limit"
                    break
                if at + 16 + captured > size:
                    cut = True
                    break
                add(at)
                at += 16 + captured
            self.at = at
            if starts:
                self.packets += len(starts)
                begin = np.array(starts, np.int64)
                heads = self.data[begin[:, None] + np.arange(16)].view(order + "u4").astype(np.int64)
                ones = np.ones(len(begin), np.int64)
                yield self._arrays([heads[:, 0] * 1_000_000 + heads[:, 1] // per_us, heads[:, 2], heads[:, 3], ones * link, ones * 0, begin + 16, ones])
        if bad:
            raise self._fail(bad)
        if cut:
            raise _Cut

    def _blocks(self) -> Iterator[tuple]:
        view, size, at, order = self.view, len(self.view), 0, "<"
        interfaces: list[tuple[int, int, int, int]] = []  # link type, snap length, ticks a second, power of two or not
        while at < size:
            self.at = at
            self._need(at, 8)
            kind = struct.unpack_from("<I", view, at)[0]
            if kind == SECTION:
                self._need(at, 12)
                order = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}.get(bytes(view[at + 8 : at + 12]), "")
                if not order:
                    raise self._fail("invalid PCAPNG byte-order magic")
            kind, length = struct.unpack_from(order + "II", view, at)
            least = 28 if kind == SECTION else 12
            if length < least or length % 4:
                raise self._fail(f"invalid PCAPNG block length {length}")
            body, end = at + 8, at + length
            row = None
            if kind == SECTION:
                self._need(body, 16)
                major = struct.unpack_from(order + "H", view, body + 4)[0]
                if major != 1:
                    raise self._fail(f"unsupported PCAPNG version {major}")
                interfaces = []
                self.sections += 1
            elif kind == INTERFACE:
                interfaces.append(self._interface(order, body, length - 12))
                if len(interfaces) > MOST_INTERFACES:
                    raise self._fail(f"more than {MOST_INTERFACES} interfaces in a section")
            elif kind == ENHANCED:
                if length - 12 < 20:
                    raise self._fail("invalid PCAPNG enhanced packet block")
                self._need(body, 20)
                face, high, low, captured, original = struct.unpack_from(order + "IIIII", view, body)
                if face >= len(interfaces):
                    raise self._fail(f"the packet references missing interface {face}")
                if captured > MOST_BYTES:
                    raise self._fail(f"a packet of {captured} bytes exceeds the limit")
                if 20 + -(-captured // 4) * 4 > length - 12:
                    raise self._fail("truncated PCAPNG packet")
                link, _, ticks, _ = interfaces[face]
                row = ((high << 32 | low) * 1_000_000 // ticks, captured, original, link, face, body + 20, self.sections)
            elif kind == SIMPLE:
                if length - 12 < 4 or not interfaces:
                    raise self._fail("invalid PCAPNG simple packet block")
                self._need(body, 4)
                original = struct.unpack_from(order + "I", view, body)[0]
                link, snap, _, _ = interfaces[0]
                captured = min(original, snap or original)
                if captured > MOST_BYTES:
                    raise self._fail(f"a packet of {captured} bytes exceeds the limit")
                if -(-captured // 4) * 4 > length - 16:
                    raise self._fail("truncated PCAPNG simple packet")
                row = (NO_TIME, captured, original, link, 0, body + 4, self.sections)
            self._need(at, length)
            if struct.unpack_from(order + "I", view, end - 4)[0] != length:
                raise self._fail("the block's two lengths differ")
            if row is not None:
                yield row
            at = end

    def _interface(self, order: str, body: int, size: int) -> tuple[int, int, int, int]:
        if size < 8 or size > MOST_INTERFACE_BYTES:
            raise self._fail(f"invalid PCAPNG interface block of {size} bytes")
        self._need(body, size)
        link, _, snap = struct.unpack_from(order + "HHI", self.view, body)
        ticks, at, end = 1_000_000, body + 8, body + size
        while at + 4 <= end:
            code, n = struct.unpack_from(order + "HH", self.view, at)
            at += 4
            if code == 0:
                break
            if at + -(-n // 4) * 4 > end:
                raise self._fail("invalid PCAPNG interface option")
            if code == 9 and n == 1:
                r = int(self.view[at])
                ticks = 2 ** (r & 0x7F) if r & 0x80 else 10**r
            at += -(-n // 4) * 4
        self.link_types.add(link)
        return link, snap, ticks, 0
