"""Exact distinct counts over identifier sets that fit no single task, from joinable partial results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash ranges of identifiers. Each is counted on its own, so this bounds no result; it only spreads hot groups.
BUCKETS = 64


def pair_state(df: DataFrame, identifier: Column, groups: dict[str, Column], buckets: int = BUCKETS) -> DataFrame:
    """The partial result of ``df``: each identifier once per combination of groups, with the hash range it falls in.

    Columns ``bucket``, the groups, ``id``. Rows with a null identifier or group are left out; repeated rows and other
    columns change nothing; an empty input gives an empty state. Pairs are deduplicated within their hash range, on the map
    side first; the shuffle spreads by range, groups and identifier, so neither a hot identifier nor a hot group gathers in
    one task.
    """
    names = list(groups)
    rows = df.select(*[c.alias(k) for k, c in groups.items()], identifier.alias("id")).dropna()
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), *names, "id").dropDuplicates()


def join_states(*states: DataFrame) -> DataFrame:
    """The state of all rows together, from states of parts that may share identifiers (same buckets and groups)."""
    return reduce(DataFrame.unionByName, states).dropDuplicates()


def count_state(state: DataFrame, groups: list[str]) -> DataFrame:
    """Different identifiers per value of ``groups`` (some of the state's groups): the groups and ``n_distinct``.

    Hash ranges share no identifier, so each is counted exactly and the counts add up: the error bound is 0.
    """
    others = [c for c in state.columns if c not in ("bucket", "id", *groups)]
    pairs = state.select("bucket", *groups, "id")
    if others:  # an identifier may come with several values of the other groups
        pairs = pairs.dropDuplicates()
    return pairs.groupBy("bucket", *groups).agg(F.count(F.lit(1)).alias("n")).groupBy(*groups).agg(F.sum("n").alias("n_distinct"))
