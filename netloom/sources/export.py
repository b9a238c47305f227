"""Packets back into PCAP files: one file in the order of the query, or one per partition."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from netloom.session import local_path

NEEDED = {"timestamp": (T.TimestampNTZType, T.TimestampType), "captured_length": (T.LongType,), "original_length": (T.LongType,), "link_type": (T.LongType,), "packet_data": (T.BinaryType,)}
FIXED = ("use_tmp_file", "preserve_order", "write_empty_file")


def header(link_type: int, snaplen: int) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, link_type)


def encode(batch: pa.RecordBatch, link_type: int, snaplen: int | None) -> tuple[bytes, int]:
    """Records of a batch as bytes, and the longest captured length. A bad row raises ValueError that says why."""
    for name in NEEDED:
        if batch.column(name).null_count:
            raise ValueError(f"PCAP export: {name} is null")
    us = batch.column("timestamp").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
    captured, original, link = (batch.column(c).to_numpy() for c in ("captured_length", "original_length", "link_type"))
    data = batch.column("packet_data").to_pylist()
    size = np.fromiter(map(len, data), np.int64, len(data))
    for bad, why in (
        ((us < 0) | (us // 1_000_000 > 0xFFFFFFFF), "timestamp is outside what a capture can hold"), (link != link_type, f"link_type is not {link_type}"),
        (captured > original, "captured_length exceeds original_length"), (captured != size, "captured_length is not the length of packet_data"),
        ((captured < 0) | (original > 0xFFFFFFFF), "a length is outside what a capture can hold"), (captured > (snaplen or 0xFFFFFFFF), f"captured_length exceeds SNAPLEN {snaplen}"),
    ):
        if bad.any():
            raise ValueError(f"PCAP export: {why}")
    heads = np.stack([us // 1_000_000, us % 1_000_000, captured, original], axis=1).astype("<u4").tobytes()
    return b"".join(heads[16 * i : 16 * i + 16] + d for i, d in enumerate(data)), int(captured.max(initial=0))


def _checked(df: DataFrame, link_type: int, snaplen: int | None, options: dict) -> None:
    fields = {f.name: f.dataType for f in df.schema.fields}
    if set(fields) != set(NEEDED):
        raise ValueError(f"PCAP export needs exactly the columns {sorted(NEEDED)}")
    for name, kinds in NEEDED.items():
        if not isinstance(fields[name], kinds):
            raise ValueError(f"PCAP export: {name} must be {kinds[0].typeName()}")
    for k, v in options.items():
        if k not in FIXED:
            raise ValueError(f"PCAP export: no option {k!r}")
        if v is not True:
            raise ValueError(f"PCAP export: {k} can't be false")
    if not 0 <= link_type <= 0xFFFF:
        raise ValueError("PCAP export: LINKTYPE is out of range")
    if snaplen is not None and not 0 < snaplen <= 0xFFFFFFFF:
        raise ValueError("PCAP export: SNAPLEN must be positive")


_PART = "part int, file string, packets long, longest long"


def _parts(folder: str, link_type: int, snaplen: int | None, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}" + (".pcap" if whole else ".records")
        os.makedirs(folder, exist_ok=True)
        packets = longest = 0
        with open(os.path.join(folder, name), "wb") as f:
            if whole:
                f.write(header(link_type, 0))
            for b in batches:
                if b.num_rows:
                    raw, n = encode(b, link_type, snaplen)
                    f.write(raw)
                    packets, longest = packets + b.num_rows, max(longest, n)
            if whole:
                f.seek(16)
                f.write(struct.pack("<I", snaplen or max(1, longest)))
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "file": [name], "packets": pa.array([packets], pa.int64()), "longest": pa.array([longest], pa.int64())})

    return run


def write_pcap(df: DataFrame, path: str, link_type: int = 1, snaplen: int | None = None, **options: bool) -> int:
    """Write ``df`` as one classic capture, in its order (give it an ``orderBy``); the number of packets is returned.

    Tasks encode their partitions side by side into a folder next to the target; the driver only joins the parts in
    order, whatever their number, through a staging file that replaces the target in one step. Any failure leaves the
    target as it was. An empty query writes a file without packets.
    """
    _checked(df, link_type, snaplen, options)
    target = local_path(path)
    if os.path.exists(target) and not os.path.isfile(target):
        raise ValueError(f"PCAP export: {target} is not a regular file")
    work = f"{target}.{uuid.uuid4().hex}"
    try:
        parts = sorted(df.mapInArrow(_parts(f"{work}.parts", link_type, snaplen, False), _PART).collect(), key=lambda r: r.part)
        with open(os.open(f"{work}.staging", os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644), "wb") as out:
            out.write(header(link_type, snaplen or max([1, *(r.longest for r in parts)])))
            for r in parts:
                with open(os.path.join(f"{work}.parts", r.file), "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.flush()
            os.fsync(out.fileno())
        os.replace(f"{work}.staging", target)
    finally:
        shutil.rmtree(f"{work}.parts", ignore_errors=True)
        if os.path.exists(f"{work}.staging"):
            os.remove(f"{work}.staging")
    return sum(r.packets for r in parts)


def write_pcap_parts(df: DataFrame, folder: str, link_type: int = 1, snaplen: int | None = None) -> DataFrame:
    """Write each partition of ``df`` as a capture of its own in ``folder``: file, packets. Nothing passes the driver."""
    _checked(df, link_type, snaplen, {})
    at = f"{folder.rstrip('/')}/_list-{uuid.uuid4().hex}"
    df.mapInArrow(_parts(local_path(folder), link_type, snaplen, True), _PART).write.parquet(at)
    return df.sparkSession.read.parquet(at).filter("packets > 0").select("file", "packets")
