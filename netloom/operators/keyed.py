"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the partial states of a measure are joined.
_JOIN = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_START = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Measure:
    """An algebraic aggregate: its state per partition is one value that joins with others of its kind."""

    name: str
    kind: str
    of: Column | str = "*"

    def __post_init__(self):
        if self.kind not in _JOIN:
            raise ValueError(f"no mergeable state for {self.kind!r}; one of {sorted(_JOIN)}")


def aggregate_by_key(df: DataFrame, key: Column, measures: list[Measure], canonical: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per key with columns ``key_value`` and the measures, however uneven the keys are.

    Every task folds its rows into a hash table of key states (Spark's partial aggregation, bounded by execution
    memory: it sorts and spills beyond it), so that at most one state per key and task is shuffled and a hot key costs
    no task more than the number of tasks. ``canonical`` maps spellings of a key to one text; it runs on the compact
    states, not on the rows, and the states of one key's spellings are joined by a second aggregation.

    Null keys (and those that ``canonical`` makes null) form one row with a null ``key_value``; an empty input gives no
    rows; repeated rows count each time; other columns of ``df`` are ignored, whatever their names.
    """
    state = df.select(key.alias("_key"), *[(F.lit(1) if m.of == "*" else F.col(m.of) if isinstance(m.of, str) else m.of).alias(f"_m{i}") for i, m in enumerate(measures)])
    state = state.groupBy("_key").agg(*[_START[m.kind](f"_m{i}").alias(f"_m{i}") for i, m in enumerate(measures)])
    if canonical is not None:
        state = state.withColumn("_key", canonical(F.col("_key"))).groupBy("_key").agg(*[_JOIN[m.kind](f"_m{i}").alias(f"_m{i}") for i, m in enumerate(measures)])
    return state.select(F.col("_key").alias("key_value"), *[F.col(f"_m{i}").alias(m.name) for i, m in enumerate(measures)])


def heavy_keys(df: DataFrame, key: Column, percent: int, canonical: Callable[[Column], Column] | None = None) -> DataFrame:
    """Keys with at least ``percent`` % of all rows of ``df`` (rows with a null key count in the whole): key_value, n_rows."""
    whole = df.agg(F.count(F.lit(1))).scalar()
    per = aggregate_by_key(df, key, [Measure("n_rows", "count")], canonical)
    return per.filter(F.col("key_value").isNotNull() & (F.col("n_rows") * 100 >= whole * percent))
