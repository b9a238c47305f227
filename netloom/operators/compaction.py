"""Consolidation of records spread over very many small captures into few well-filled files."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import file_system, materialize, newest, publish

#: Records of an output file, about: some 100 to 150 MB before compression.
TARGET_RECORDS = 1_000_000
#: Captures that one planning task holds, about.
PLAN_CAPTURES = 500_000
#: Records buffered by a writer before it starts a new row group.
ROW_GROUP = 131_072


def longest_first(weights: np.ndarray, groups: int) -> np.ndarray:
    """Group of each item: items in falling order of weight, each to the group with the least load so far."""
    out = np.zeros(len(weights), np.int64)
    heap = [(0, g) for g in range(groups)]
    for i in np.argsort(-weights, kind="stable"):
        load, g = heap[0]
        out[i] = g
        heapq.heapreplace(heap, (load + max(1, int(weights[i])), g))
    return out


@dataclass(frozen=True)
class Compacted:
    """A published consolidation: ``root`` holds the data files and the manifest that names them."""

    spark: SparkSession
    root: str

    @property
    def commit(self) -> dict:
        return newest(f"{self.root}/commits")

    def manifest(self) -> DataFrame:
        """One row per data file and capture in it: file, capture, n_records, n_keyed, n_repeats."""
        return self.spark.read.parquet(f"{self.root}/{self.commit['manifest']}")

    def records(self) -> DataFrame:
        """The consolidated records. Files of lost attempts stand in no manifest and aren't read."""
        at = self.commit["data"]
        files = sorted(r.file for r in self.manifest().select("file").distinct().collect())  # one name per million records
        schema = self.spark.read.parquet(f"{self.root}/{at}/{files[0]}").schema if files else None
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{at}/{f}" for f in files]) if files else self.spark.range(0).drop("id")


def _plan(groups_a_shard: int, target: int):
    def plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = np.maximum(1, -(-pdf["n"].to_numpy() // target))
        row = np.repeat(np.arange(len(pdf)), pieces)
        weight = pdf["n"].to_numpy()[row] / pieces[row]
        group = longest_first(weight, groups_a_shard) + int(key[0]) * groups_a_shard
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        return pd.DataFrame({"_capture": pdf["_capture"].to_numpy()[row], "_piece": piece, "_pieces": pieces[row], "_group": group})

    return plan


def _writer(folder: str, order: list[str], names: list[str]):
    """Streams a group's records, in order of capture and record number, into one Parquet file; yields its manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, at = file_system(folder)
        files.create_dir(at, recursive=True)
        file = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        writer, seen, held, waiting = None, [], [], 0
        last = (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            number = t.column(order[1])
            cap = t.column("_capture").combine_chunks().dictionary_encode()
            code, text = cap.indices.to_numpy(zero_copy_only=False), cap.dictionary
            num, none = number.fill_null(0).to_numpy(), number.is_null().to_numpy(zero_copy_only=False)
            repeat = np.zeros(len(num), bool)
            repeat[1:] = (code[1:] == code[:-1]) & (num[1:] == num[:-1])
            repeat[0] = last == (text[int(code[0])].as_py(), int(num[0]))
            repeat &= ~none
            last = (text[int(code[-1])].as_py(), None if none[-1] else int(num[-1]))
            size = len(text)
            seen.append(pa.table({"capture": text, "n_records": np.bincount(code[~repeat], minlength=size), "n_keyed": np.bincount(code[~repeat & ~none], minlength=size), "n_repeats": np.bincount(code[repeat], minlength=size)}))
            t = t.filter(pa.array(~repeat)).drop(["_capture"]).rename_columns(names)
            writer = writer or pq.ParquetWriter(f"{at}/{file}", t.schema, compression="zstd", filesystem=files)
            held.append(t)
            waiting += t.num_rows
            if waiting >= ROW_GROUP:
                writer.write_table(pa.concat_tables(held))
                held, waiting = [], 0
        if writer is None:
            return
        if held:
            writer.write_table(pa.concat_tables(held))
        writer.close()
        per = pa.concat_tables(seen).group_by("capture").aggregate([(c, "sum") for c in ("n_records", "n_keyed", "n_repeats")]).rename_columns(["capture", "n_records", "n_keyed", "n_repeats"])
        there = pq.read_metadata(f"{at}/{file}", filesystem=files).num_rows
        kept = int(np.sum(per.column("n_records").to_numpy()))
        if there != kept:
            raise RuntimeError(f"{file} holds {there} records, {kept} were written")
        yield from per.append_column("file", pa.array([file] * per.num_rows)).select(["file", "capture", "n_records", "n_keyed", "n_repeats"]).to_batches()

    return run


def compact(df: DataFrame, capture: Column, number: str, root: str, target_records: int = TARGET_RECORDS) -> Compacted:
    """Write each record of ``df`` once into files of about ``target_records`` records under ``root``; publish them.

    ``capture`` gives the canonical name of the capture a record belongs to, the column ``number`` its number there. Rows
    of one capture with the same number are one record: the one that comes first by the remaining columns, nulls last,
    stays. Records without a number can't be told to be repeats and all stay. Rows of a null capture form a capture of
    their own. Empty input publishes an empty manifest. Columns of ``df`` keep their names, also ``file`` or ``_group``.

    Captures are counted natively and spread over planning tasks by hash; each assigns its captures, largest first, to
    its own fixed output groups by a least-loaded heap. A capture beyond the target is cut into pieces by record number,
    so that repeats stay together and no group holds much more than the target. Each group is one partition, which
    streams through a pyarrow writer. Files carry the attempt in their name, the manifest names the good ones, and a
    commit file of a new name publishes manifest and data together; until then readers see the state before.
    """
    spark = df.sparkSession
    names = df.columns
    flat = df.select(F.coalesce(capture, F.lit("")).alias("_capture"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    num = f"c{names.index(number)}"
    rest = [f"c{i}" for i in range(len(names)) if f"c{i}" != num]
    types = dict(flat.dtypes)
    sortable = [c for c in rest if not types[c].startswith("map")]
    per = materialize(flat.groupBy("_capture").agg(F.count(F.lit(1)).alias("n")), "captures")
    size = per.agg(F.count(F.lit(1)).alias("captures"), F.coalesce(F.sum("n"), F.lit(0)).alias("records")).first()
    groups = max(1, -(-size.records // target_records))
    shards = min(groups, max(1, -(-size.captures // PLAN_CAPTURES)))
    a_shard = -(-groups // shards)
    shard = F.pmod(F.xxhash64("_capture"), F.lit(shards)).cast("int").alias("_shard")
    plan = materialize(per.groupBy(shard).applyInPandas(_plan(a_shard, target_records), "_capture string, _piece long, _pieces long, _group int"), "groups")

    # Rows find their group by a join that Spark may broadcast only below its own size threshold; AQE splits a hot capture.
    whole = plan.filter("_pieces = 1").select("_capture", "_group")
    placed = flat.join(whole, "_capture", "left")
    if size.records > target_records:  # only then can a capture have several pieces
        cut = plan.filter("_pieces > 1")
        which = F.xxhash64(F.when(F.col(num).isNotNull(), F.struct(num)).otherwise(F.struct(F.lit(None).cast(types[num]).alias(num))), *[F.when(F.col(num).isNull(), F.col(c)) for c in sortable])
        sizes = cut.select("_capture", "_pieces").distinct()
        placed = placed.join(sizes, "_capture", "left").withColumn("_piece", F.when(F.col("_pieces").isNotNull(), F.pmod(which, F.col("_pieces"))))
        placed = placed.join(cut.select("_capture", "_piece", F.col("_group").alias("_own")), ["_capture", "_piece"], "left").withColumn("_group", F.coalesce("_group", "_own"))
    placed = placed.select("_group", "_capture", *[f"c{i}" for i in range(len(names))]).repartitionById(shards * a_shard, F.col("_group"))
    ordered = placed.sortWithinPartitions("_capture", F.col(num).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in sortable]).drop("_group")

    version = uuid.uuid4().hex
    data, manifest = f"data-{version}", f"manifest-{version}"
    ordered.mapInArrow(_writer(f"{root}/{data}", ["_capture", num], names), "file string, capture string, n_records long, n_keyed long, n_repeats long").write.parquet(f"{root}/{manifest}")
    done = spark.read.parquet(f"{root}/{manifest}").agg(F.coalesce(F.sum(F.col("n_records") + F.col("n_repeats")), F.lit(0)).alias("n")).first().n
    if done != size.records:
        raise RuntimeError(f"{size.records} records were read, {done} are in the manifest; nothing was published")
    before = newest(f"{root}/commits")
    number = before["number"] + 1 if before else 1
    publish(f"{root}/commits", number, {"number": number, "data": data, "manifest": manifest, "records": size.records})
    return Compacted(spark, root)


def disagreeing_captures(done: Compacted, inventory: DataFrame) -> DataFrame:
    """Captures whose records differ in number from the latest run that counted them: filename, packet_count, n_found.

    ``inventory`` has run_number, filename (canonical) and packet_count; captures never counted are left out; a capture
    without records counts as 0.
    """
    latest = inventory.filter("packet_count is not null and filename is not null").groupBy("filename").agg(F.max_by("packet_count", F.struct("run_number", "packet_count")).alias("packet_count"))
    found = done.manifest().groupBy(F.col("capture").alias("filename")).agg(F.sum("n_keyed").alias("n_found"))
    both = latest.join(found, "filename", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return both.filter("packet_count <> n_found")
