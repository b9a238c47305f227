"""Clocks over packets in capture order, and state machines that run along sorted partitions."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import epoch_us, materialize
from netloom.sources.columns import values

SCOPE = ["filename", "input_index", "input_count", "section_number", "interface_id"]
#: What the reader can give of a capture's clocks (see ``with_clock``), and whether the section is the capture's last.
CLOCK = ["clock", "late", "final_clock", "final_packet", "last_section"]
#: Packets of an interface that one sort covers; longer captures are spread over as many sorts as they need.
CHUNK = 65_536


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on columns of one name, nulls being equal."""
    right = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(right[f"_key_{k}"]) for k in keys]
    return left.join(right, on).drop(*[f"_key_{k}" for k in keys])


def with_inputs(packets: DataFrame) -> DataFrame:
    """Adds ``input_index`` and ``input_count`` where they lack. Rows of the capture reader bring them along.

    Otherwise each file name is an input, numbered from 1 in order of name: names are sorted in ranges, so that no task
    holds all, and only the ranges' sizes go to the driver. Where just ``input_count`` lacks, it is the greatest index.
    """
    if "input_index" in packets.columns:
        return packets if "input_count" in packets.columns else packets.withColumn("input_count", packets.agg(F.max("input_index")).scalar())
    files = packets.select(F.col("filename").alias("_file")).distinct().repartitionByRange("_file").withColumn("_part", F.spark_partition_id())
    files = materialize(files, "inputs")
    sizes = sorted(files.groupBy("_part").count().collect())
    before = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    parts = packets.sparkSession.createDataFrame([(r["_part"], n) for r, n in zip(sizes, before, strict=False)], "_part int, _before long")  # one row a range
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_file"))
    numbered = files.withColumn("_place", place).join(F.broadcast(parts), "_part").select("_file", (F.col("_place") + F.col("_before")).alias("input_index"), F.lit(before[-1]).cast("long").alias("input_count"))
    return packets.join(numbered, packets["filename"].eqNullSafe(numbered["_file"])).drop("_file")


def with_clock(packets: DataFrame) -> DataFrame:
    """Adds ``us`` and, per interface: ``clock`` (latest time so far, this packet's included), ``late`` (this packet lies
    before the latest time of earlier ones), ``final_clock`` and ``final_packet`` of the whole interface.

    Rows of the capture reader bring all this along, if asked for the columns ``CLOCK``. For other packets, the running
    maximum is taken in chunks of packet numbers; what came before a chunk is the maximum over the chunk
    table, of one row per chunk. Packets without a time have a null ``us`` and don't move the clock.
    """
    if set(CLOCK) <= set(packets.columns):  # the reader has them from its own pass over each capture
        return packets.withColumn("us", epoch_us(F.col("timestamp")))
    df = packets.withColumn("us", epoch_us(F.col("timestamp"))).withColumn("_chunk", F.floor(F.col("packet_number") / CHUNK))
    keys = [*SCOPE, "_chunk"]
    chunks = df.groupBy(*keys).agg(F.max("us").alias("_top"), F.max("packet_number").alias("_last"))
    w = Window.partitionBy(*SCOPE)
    so_far = w.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*keys, F.max("_top").over(so_far).alias("_before"), F.max("_top").over(w).alias("final_clock"), F.max("_last").over(w).alias("final_packet"))
    inside = Window.partitionBy(*keys).orderBy("packet_number")
    df = df.withColumn("_here", F.max("us").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    df = join_null_safe(df, chunks, keys)
    earlier = F.greatest("_here", "_before")
    return df.withColumn("late", F.coalesce(F.col("us") < earlier, F.lit(False))).withColumn("clock", F.greatest("us", earlier)).drop("_here", "_before", "_chunk")


def with_pair(packets: DataFrame) -> DataFrame:
    """Adds a connection's two ends in one order whatever the direction: ``low_ip`` ... ``high_port``, ``from_low``."""
    src, dst = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    p = packets.withColumn("_a", F.least(src, dst)).withColumn("_b", F.greatest(src, dst)).withColumn("from_low", src <= dst)
    p = p.select("*", F.col("_a.ip").alias("low_ip"), F.col("_a.port").alias("low_port"), F.col("_b.ip").alias("high_ip"), F.col("_b.port").alias("high_port")).drop("_a", "_b")
    return p.withColumn("vlans", F.coalesce(F.concat_ws(",", F.col("vlan_ids").cast("array<string>")), F.lit("")))


def vlan_list(text: str = "vlans") -> Column:
    return F.when(F.col(text) == "", F.array().cast("array<int>")).otherwise(F.split(text, ",").cast("array<int>"))


def along(df: DataFrame, keys: list[str], order: list[str], machine: Callable[[], object], schema: str) -> DataFrame:
    """Runs a state machine over each key's rows in order.

    ``machine()`` makes an object with ``row(values)``, values being a named tuple, and ``end()``, both giving rows (tuples
    by ``schema``); it is made anew for each key. Rows stream through partitions sorted by a hash of the keys and the order,
    which compares numbers only and spills to disk, so a key may have any number of rows: only its state is in memory.
    """
    spread = df.withColumn("_h", F.xxhash64(*keys))
    ordered = spread.repartition("_h").sortWithinPartitions("_h", *order)
    names = ordered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live: dict[tuple, object] = {}  # the machines of one hash: one, or more where keys collide
        hashed = None
        make = namedtuple("Values", [c for c in names if c != "_h"])._make
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h = b.column("_h").to_numpy()
            cols = [values(b.column(c)) for c in names if c != "_h"]
            at = [values(b.column(k)) for k in keys]
            fresh = np.ones(n, bool)
            fresh[1:] = h[1:] != h[:-1]
            fresh[0] = h[0] != hashed
            other = fresh.copy()
            for k in keys:
                code = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                other[1:] |= code[1:] != code[:-1]
            other[0] = True
            hashed = h[-1]
            out: list[tuple] = []
            now = None
            for i, (new, turn, row) in enumerate(zip(fresh.tolist(), other.tolist(), zip(*cols, strict=True), strict=True)):
                if new:
                    for m in live.values():
                        out += m.end()
                    live = {}
                if turn:
                    key = tuple(c[i] for c in at)
                    now = live.get(key)
                    if now is None:
                        now = live[key] = machine()
                out += now.row(make(row))
            if out:
                yield batch(out)
        out = [r for m in live.values() for r in m.end()]
        if out:
            yield batch(out)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, schema)
