"""Captures that arrive in a folder, as a stream of decoded packets, and windowed and sessionized views of it."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from netloom.sources.captures import LAYERS, CaptureReader, Files


class FolderReader(DataSourceStreamReader):
    """Offsets are the modification time and name of the newest file taken; a batch is the files after it, in that order.

    A file must appear complete, by a rename into the folder, and with a time not before those already there.
    """

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.folder, self.suffixes = options["path"], tuple(options.get("suffixes", ".pcap,.pcapng").split(","))
        self.at_once = int(options.get("maxfilespertrigger", 1_000))
        self.schema, self.options = schema, options
        self.upto: list | None = None

    def _files(self) -> list[tuple[int, str]]:
        return sorted((e.stat().st_mtime_ns, e.path) for e in os.scandir(self.folder) if e.is_file() and e.name.endswith(self.suffixes))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        done = tuple(self.upto) if self.upto else (0, "")
        new = [f for f in self._files() if f > done][: self.at_once]
        if new:
            self.upto = list(new[-1])
        return {"time": (self.upto or [0, ""])[0], "path": (self.upto or [0, ""])[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        a, b = (start["time"], start["path"]), (end["time"], end["path"])
        self.upto = max(self.upto or [0, ""], list(b))
        return [Files([(0, p, {})]) for t, p in self._files() if a < (t, p) <= b]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from CaptureReader(self.schema, {"layer": self.options.get("layer", "packets"), "paths": json.dumps([]), "where": self.options.get("where", "[]")}).read(partition)


class CaptureFolder(DataSource):
    """``spark.readStream.format("netloom_capture_folder").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "netloom_capture_folder"

    def schema(self) -> str:
        return LAYERS[self.options.get("layer", "packets")]

    def streamReader(self, schema: T.StructType) -> FolderReader:  # noqa: N802
        return FolderReader(schema, dict(self.options))


def stream_packets(spark: SparkSession, folder: str, layer: str = "packets", files_at_once: int = 1_000) -> DataFrame:
    """Packets of the captures in a folder, those there and those to come.

    A batch takes at most ``files_at_once`` files; so does a whole run with the trigger ``availableNow``, as Python sources
    are asked for their end once in it.
    """
    spark.dataSource.register(CaptureFolder)
    return spark.readStream.format("netloom_capture_folder").option("layer", layer).option("maxFilesPerTrigger", files_at_once).load(folder)


def _event_time(df: DataFrame, delay: str) -> DataFrame:
    return df.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay)


def windowed_traffic(packets: DataFrame, keys: list[str], width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Packets and bytes per key and tumbling or sliding window; windows of days and weeks begin on 2000-01-03 as in batch."""
    w = F.window("event_time", width, slide or width, "4 days" if _whole_days(slide or width) else None)
    out = _event_time(packets, delay).groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias("packets"), F.sum("captured_length").alias("captured_bytes"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "packets", "captured_bytes")


def _whole_days(width: str) -> bool:
    # Weeks begin on Mondays, four days after the epoch's Thursday; shorter widths that divide a day begin alike anyway.
    return width.strip().lower() in ("7 days", "1 week")


def session_traffic(packets: DataFrame, keys: list[str], gap: str | Column, delay: str = "10 minutes") -> DataFrame:
    """Sessions per key, closed after a pause of ``gap`` by the watermark."""
    s = _event_time(packets, delay).groupBy(F.session_window("event_time", gap).alias("s"), *keys)
    return s.agg(F.count(F.lit(1)).alias("packets"), F.min("event_time").alias("start_time"), F.max("event_time").alias("end_time")).select(*keys, "start_time", "end_time", "packets")
