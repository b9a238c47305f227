"""Most frequent items in bounded memory: counter summaries per partition, joined in a tree, then checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of a summary. Counts are too high by at most (items counted) / CAPACITY.
CAPACITY = 2000
#: Summaries joined by one task of a level.
FAN_IN = 32
_SCHEMA = "node long, item string, count long, error long, total long"


class SpaceSaving:
    """At most ``capacity`` counters with a common error bound; any item without a counter occurred at most ``error`` times.

    Kept in the isomorphic form in which a counter holds its certain count: when there are too many, the largest surplus
    count is taken off all, which removes it at least ``capacity + 1`` times, so ``error <= total / (capacity + 1)``
    over any sequence of additions and joins. The usual overestimate of a counter is its count plus ``error``.
    """

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.sure, self.error, self.total = capacity, {}, 0, 0

    def add(self, items: list[str], counts: np.ndarray) -> None:
        """Adds items with their numbers of occurrences; memory: the counters plus these items."""
        sure = self.sure
        for i, n in zip(items, counts.tolist(), strict=True):
            sure[i] = sure.get(i, 0) + n
        self.total += int(counts.sum())
        self._shrink()

    def join(self, items: list[str], sure: np.ndarray, error: int, total: int) -> None:
        """Joins another summary."""
        self.add(items, sure)
        self.total += total - int(sure.sum())
        self.error += error

    def _shrink(self) -> None:
        if len(self.sure) > self.capacity:
            values = np.fromiter(self.sure.values(), np.int64, len(self.sure))
            off = int(np.partition(values, -self.capacity - 1)[-self.capacity - 1])
            self.sure = {i: n - off for i, n in self.sure.items() if n > off}
            self.error += off

    def rows(self, node: int) -> pa.RecordBatch:
        """Counters as rows; a summary without counters is one row with a null item, for its total."""
        items, sure = (list(self.sure), list(self.sure.values())) if self.sure else ([None], [0])
        n = len(items)
        return pa.record_batch({"node": pa.array([node] * n, pa.int64()), "item": pa.array(items, pa.string()), "count": pa.array(sure, pa.int64()), "error": pa.array([self.error] * n, pa.int64()), "total": pa.array([self.total] * n, pa.int64())})


def _summarize(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = SpaceSaving(capacity)
        for b in batches:
            seen = pc.value_counts(b.column(0).drop_null())
            if len(seen):
                s.add(seen.field("values").to_pylist(), seen.field("counts").to_numpy())
        yield s.rows(TaskContext.get().partitionId())

    return run


def _join(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = SpaceSaving(capacity)
        for _, part in pdf.groupby("node"):
            there = part["item"].notna()
            s.join(part["item"][there].tolist(), part["count"][there].to_numpy(), int(part["error"].iloc[0]), int(part["total"].iloc[0]))
        return s.rows(int(key[0])).to_pandas()

    return run


def summarize(items: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """One summary of the single string column of ``items``: at most ``capacity`` rows of item, count, error, total.

    Nulls aren't counted. Partitions are summarized where they are; each level of the tree joins ``fan_in`` summaries per
    task, at most ``fan_in * capacity`` rows. An empty input gives one row with a null item and total 0, or none.
    """
    parts = items.rdd.getNumPartitions()
    level = items.mapInArrow(_summarize(capacity), _SCHEMA)
    while True:
        parts = -(-parts // fan_in)
        level = level.groupBy(F.pmod("node", F.lit(parts)).alias("_next")).applyInPandas(_join(capacity), _SCHEMA)
        if parts <= 1:
            return level.drop("node")


def frequent_items(items: DataFrame, per_mille: int, whole: Column, capacity: int = CAPACITY) -> DataFrame:
    """Items that make up at least ``per_mille`` thousandths of ``whole``: item, approx_count, error_bound, n_rows.

    ``items`` has one string column; ``whole`` is the number of rows the share refers to. The summary's counts are too
    high by at most ``error_bound``, so every item that reaches the share is a candidate; candidates, at most
    ``capacity``, are broadcast and counted exactly in a second pass. Nulls aren't items; repeats count each time; ties
    all stay; an empty input gives no rows.
    """
    if 1000 > per_mille * capacity:
        raise ValueError("the capacity is too small to tell such items from the rest")
    items = items.toDF("_value")  # the column may have any name
    found = summarize(items, capacity).filter(F.col("item").isNotNull() & ((F.col("count") + F.col("error")) * 1000 >= whole * per_mille))
    found = found.select("item", (F.col("count") + F.col("error")).alias("approx_count"), F.col("error").alias("error_bound"))
    exact = items.join(F.broadcast(found), F.col("_value") == F.col("item")).groupBy("item", "approx_count", "error_bound").agg(F.count(F.lit(1)).alias("n_rows"))
    return exact.filter(F.col("n_rows") * 1000 >= whole * per_mille)
