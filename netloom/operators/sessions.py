"""Sessions of an entity's events, split at pauses, by closing occupancy bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.session import epoch_us

def _steps(reach: int) -> list[int]:
    """Shifts that double, and together make ``reach``."""
    out: list[int] = []
    while sum(out) < reach:
        out.append(min(sum(out) + 1, reach - sum(out)))
    return out


def close_runs(group: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Morphological closing of run-compressed bitmaps: every stretch of at most ``reach`` clear bits between set bits is set.

    ``first`` and ``last`` are the set runs of one bitmap per ``group``, in order of group and bit, without overlaps. Each
    bitmap is or-ed with itself shifted up by 1, 2, 4, ... bits until it is widened by ``reach``, then and-ed with itself
    shifted down by the same steps. On runs the one moves ends up and unites runs that touch; the other moves ends down,
    and no run vanishes, as each is longer than ``reach`` by then. Returns the row of the first run that each run of the
    closed bitmaps is made of, its first and its last bit.
    """
    row = np.arange(len(first))
    for step in (0, *_steps(reach)):
        last = last + step
        opens = np.ones(len(row), bool)
        opens[1:] = (group[1:] != group[:-1]) | (first[1:] > last[:-1] + 1)
        if not opens.all():
            at = np.flatnonzero(opens)
            row, group, first, last = row[at], group[at], first[at], last[np.append(at[1:], len(last)) - 1]
    for step in _steps(reach):
        last = last - step
    return row, first, last


def _sessionizer(keys: list[str], gap_us: int):
    names = [*keys, "start_us", "end_us", "n_events"]

    def sessions(chunk: pa.Table) -> pa.Table:
        """Sessions within rows sorted by key and start; one row each, in order."""
        group = np.zeros(chunk.num_rows, np.int64)
        for k in keys:
            code = chunk.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            group[1:] |= code[1:] != code[:-1]
        first, last, count = (chunk.column(c).to_numpy() for c in names[-3:])
        # A pause of exactly the gap has one clear bit less than the gap and is closed, a longer one is not. Closed runs
        # begin and end at set bits, so their end points are events; counts are joined by the runs they fall into.
        row, start, end = close_runs(np.cumsum(group), first, last, gap_us - 1)
        out = {k: chunk.column(k).combine_chunks().take(pa.array(row)) for k in keys}
        return pa.table(out | {"start_us": start, "end_us": end, "n_events": np.add.reduceat(count, row)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last run so far: the next rows may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch]).select(names)
            got = sessions(part if held is None else pa.concat_tables([held.cast(part.schema), part]))
            held = got.slice(got.num_rows - 1)
            yield from got.slice(0, got.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return run


def sessionize(df: DataFrame, keys: dict[str, Column], time: Column, gap_us: int) -> DataFrame:
    """Sessions of each key: the key columns, ``start_us``, ``end_us``, ``duration_us``, ``n_events``.

    A pause of more than ``gap_us`` microseconds starts a new session, one of exactly ``gap_us`` does not. Rows with a
    null time or a null in any key are left out; repeated rows count each time but move no end point; simultaneous events
    need no order; an empty input gives no sessions. Other columns of ``df`` are ignored.

    Events set bits of a bitmap per key with one bit a microsecond. It is kept in containers of ``gap_us`` bits; as the
    closing sets every bit between two events of one container, a container is the run from its first to its last event,
    with their number, and is made by a native aggregate on the map side: a hot entity costs at most one row a container
    and map task. Containers are then sorted by key and the gap-sized closing, by doubling shifts on their runs, joins
    them to sessions. An entity's containers stream through in batches, and only its open run is kept.
    """
    if gap_us < 1:
        raise ValueError("gap_us is too short")
    names = list(keys)
    t = epoch_us(time)
    rows = df.select(*[c.alias(k) for k, c in keys.items()], t.alias("_us")).filter(" and ".join(f"`{k}` is not null" for k in [*names, "_us"]))
    box = F.expr(f"(_us - pmod(_us, {gap_us}L)) div {gap_us}L")
    runs = rows.groupBy(*names, box.alias("_box")).agg(F.min("_us").alias("start_us"), F.max("_us").alias("end_us"), F.count(F.lit(1)).alias("n_events"))
    ordered = runs.repartition(*names).sortWithinPartitions(*names, "start_us")
    types = dict(ordered.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in names) + ", start_us long, end_us long, n_events long"
    return ordered.mapInArrow(_sessionizer(names, gap_us), schema).withColumn("duration_us", F.col("end_us") - F.col("start_us"))
