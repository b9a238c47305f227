"""Unbroken periods and gaps of overlapping intervals, by run bitmaps per entity and time shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import epoch_us, materialize

DAY_US = 86_400_000_000
# A run bitmap has one bit for each microsecond and one for each open space between two, so that [0, 5] and [6, 9], which
# share no instant, leave a clear bit: instant t is bit 2t. Only its runs of set bits are kept, as (first, last) bit.


def union_runs(group: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set runs of the union of bitmaps by group: row of the group, first bit, last bit; in order of group and bit."""
    order = np.lexsort((first, group))
    group, first, last = group[order], first[order], last[order]
    head = np.ones(len(group), bool)
    head[1:] = group[1:] != group[:-1]
    # A running maximum within groups: ranks of the ends are lifted above those of all earlier groups.
    rank = np.argsort(np.argsort(last, kind="stable"), kind="stable") + np.cumsum(head) * len(last)
    reach = np.sort(last)[np.maximum.accumulate(rank) % max(1, len(last))]
    opens = head.copy()
    opens[1:] |= first[1:] > reach[:-1] + 1
    at = np.flatnonzero(opens)
    return order[at], first[at], reach[np.append(at[1:], len(group)) - 1]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


#: What a row of runs is: the first or last set run of a shard, a set run between them, a clear run between two set runs
#: of a shard, a run of whole shards.
EDGE, INNER, CLEAR, WHOLE = 0, 1, 2, 3


def _map_side(shard_bits: int):
    """Cut spans at shard borders and unite them within the batch, before anything is shuffled.

    A span gives its part of the first shard, its part of the last one, and one run of all whole shards between: three rows
    at most, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            row, first, last = union_runs(_codes(t.column("entity")), t.column("first_us").to_numpy() * 2, t.column("last_us").to_numpy() * 2)
            low, high = first // shard_bits, last // shard_bits
            cut, far = high > low, high > low + 1
            src = np.concatenate([row, row[cut], row[far]])
            shard = np.concatenate([low, high[cut], low[far] + 1])
            f = np.concatenate([first, high[cut] * shard_bits, (low[far] + 1) * shard_bits])
            e = np.concatenate([np.minimum(last, (low + 1) * shard_bits - 1), last[cut], high[far] * shard_bits - 1])
            whole = np.repeat([False, True], [len(row) + int(cut.sum()), int(far.sum())])
            yield from pa.table({"entity": t.column("entity").combine_chunks().take(pa.array(src)), "shard": shard, "f": f, "e": e, "whole": whole}).to_batches()

    return run


def _shard_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set and clear runs of each shard's united bitmap; runs of whole shards, united, pass by.

    Batches are sorted by entity, whether whole, shard and first bit, so that only the last run is held for the next batch.
    """
    held: pa.Table | None = None  # with whether it is the first run of its shard

    def settle(t: pa.Table, final: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
        code, shard, whole = _codes(t.column("entity")), t.column("shard").to_numpy(), t.column("whole").to_numpy()
        new = np.ones(t.num_rows, bool)
        new[1:] = (code[1:] != code[:-1]) | (whole[1:] != whole[:-1]) | (~whole[1:] & (shard[1:] != shard[:-1]))
        group = np.cumsum(new)
        row, first, last = union_runs(group, t.column("f").to_numpy(), t.column("e").to_numpy())
        g, names = group[row], t.column("entity").combine_chunks().take(pa.array(row))
        left, right = np.ones(len(g), bool), np.ones(len(g), bool)
        left[1:], right[:-1] = g[1:] != g[:-1], g[1:] != g[:-1]
        left[0] = t.column("left")[0].as_py()
        n = len(g) if final else len(g) - 1
        rest = None if final else pa.table({"entity": names.slice(n), "shard": shard[row[n:]], "f": first[n:], "e": last[n:], "whole": whole[row[n:]], "left": left[n:]})
        kind = np.where(whole[row], WHOLE, np.where(left | right, EDGE, INNER))
        clear = np.flatnonzero(~left & ~whole[row])  # the clear run before each but a shard's first set run
        clear = clear[clear > 0]
        out = [(names.slice(0, n), shard[row[:n]], kind[:n], first[:n], last[:n]), (names.take(pa.array(clear)), shard[row[clear]], np.full(len(clear), CLEAR), last[clear - 1], first[clear])]
        return [b for e, s, k, f, x in out if len(e) for b in pa.table({"entity": e, "shard": s, "kind": pa.array(k, pa.int8()), "f": f, "e": x}).to_batches()], rest

    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch]).select(["entity", "shard", "f", "e", "whole"])
        part = part.append_column("left", pa.array(np.ones(part.num_rows, bool)))
        got, held = settle(part if held is None else pa.concat_tables([held.cast(part.schema), part]), final=False)
        yield from got
    if held is not None:
        yield from settle(held, final=True)[0]


def periods_and_gaps(df: DataFrame, entity: Column, first: Column, last: Column, max_gap_us: int | None = None, shard_us: int = DAY_US) -> DataFrame:
    """``entity``, ``span_kind`` ('period' or 'gap'), ``start_us``, ``end_us`` of each entity's united spans.

    Spans are closed: they belong together if they share at least one instant. A gap runs from the end of a period to the
    start of the next one; with ``max_gap_us`` longer gaps are left out. Rows with a null entity or time, or that end
    before they start, are left out; a span of one instant is a period of its own unless others cover it; repeated rows
    change nothing; an empty input gives no rows. Other columns of ``df`` are ignored.

    Spans are cut into their parts of the first and last shard and one run of the whole shards between, and united within
    each batch before the shuffle, so a hot entity is spread over its shards and its overlapping spans shrink first. Each
    shard's bitmap is united and gives its set and clear runs. Those inside a shard are final and are not shuffled again;
    only its first and last set run and the runs of whole shards are joined along the entity's shards. Inner runs of shards that a run of whole shards covers are dropped by a join.
    """
    spans = df.select(entity.alias("entity"), epoch_us(first).alias("first_us"), epoch_us(last).alias("last_us"))
    spans = spans.filter("entity is not null and first_us is not null and last_us >= first_us")
    pieces = spans.mapInArrow(_map_side(2 * shard_us), "entity string, shard long, f long, e long, whole boolean")
    # Whole runs of an entity meet in one place, whatever their first shard.
    parts = pieces.repartition("entity", F.when(~F.col("whole"), F.col("shard"))).sortWithinPartitions("entity", "whole", F.when(~F.col("whole"), F.col("shard")), "f")
    runs = materialize(parts.mapInArrow(_shard_side, "entity string, shard long, kind tinyint, f long, e long"), "intervals", "kind")

    edges = runs.filter(F.col("kind").isin(EDGE, WHOLE))
    w = Window.partitionBy("entity").orderBy("f", F.desc("kind"), "e")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("_reach", F.max("e").over(before)).withColumn("_last", F.lag(F.when(F.col("kind") == EDGE, F.col("shard"))).over(w))
    edges = edges.withColumn("_new", F.col("_reach").isNull() | (F.col("f") > F.col("_reach") + 1)).withColumn("_over", F.max(F.when(F.col("kind") == WHOLE, F.col("e"))).over(up_to))
    edges = edges.withColumn("_from", F.last(F.when(F.col("_new"), F.col("f")), True).over(up_to)).withColumn("_ends", F.coalesce(F.lead("_new").over(w), F.lit(True)))

    def piece(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("span_kind"), F.shiftright(a, 1).alias("start_us"), F.shiftright(b + 1, 1).alias("end_us"))

    same_shard = F.coalesce((F.col("kind") == EDGE) & (F.col("_last") == F.col("shard")), F.lit(False))  # its own clear runs give these gaps
    period = F.when(F.col("_ends"), piece("period", F.col("_from"), F.greatest("e", F.coalesce("_reach", "e"))))
    gap = F.when(F.col("_new") & F.col("_reach").isNotNull() & ~same_shard, piece("gap", F.col("_reach"), F.col("f")))
    joined = edges.select("entity", F.explode(F.array_compact(F.array(period, gap))).alias("x")).select("entity", "x.*")

    covered = edges.filter((F.col("kind") == EDGE) & (F.col("_over") >= F.col("e"))).select("entity", "shard").distinct()
    inner = runs.filter(F.col("kind").isin(INNER, CLEAR)).join(covered, ["entity", "shard"], "left_anti")
    inner = inner.select("entity", F.when(F.col("kind") == INNER, piece("period", F.col("f"), F.col("e"))).otherwise(piece("gap", F.col("f"), F.col("e"))).alias("x")).select("entity", "x.*")
    out = joined.unionByName(inner)
    return out if max_gap_us is None else out.filter((F.col("span_kind") == "period") | (F.col("end_us") - F.col("start_us") <= max_gap_us))
