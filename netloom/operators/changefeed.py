"""Only new or changed records, found by comparing Merkle trees over ranges of key hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netloom.session import exists, newest, publish, published, remove

FANOUT = 16
#: Rows of the saved state, or of runs fed together, that one key range holds, about; a range is one subtree, compared by one task.
RANGE_ROWS = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x + _ODD).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MerkleTree:
    """Digests over ``FANOUT ** depth`` leaves, each for a range of key hashes; level 0 is the root."""

    def __init__(self, leaves: np.ndarray):
        self.levels = [leaves]
        while len(self.levels[0]) > 1:
            below = self.levels[0].reshape(-1, FANOUT, 2)
            place = np.arange(1, 2 * FANOUT, 2, dtype=np.uint64)[None, :, None]
            self.levels.insert(0, mix((mix(below) * place).sum(axis=1, dtype=np.uint64)))

    def changed_leaves(self, saved: MerkleTree) -> np.ndarray:
        """Leaves that differ, visiting only children of nodes that differ."""
        at = np.array([0])
        for mine, theirs in zip(self.levels, saved.levels, strict=True):
            at = at[(mine[at] != theirs[at]).any(axis=1)]
            if mine is not self.levels[-1]:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return at


#: Columns of the feed's own tables, besides key and values.
KIND, RUN, PART, LEAF, D1, D2 = "f_kind", "f_run", "f_part", "f_leaf", "f_d1", "f_d2"


def _digests(t: pa.Table | dict[str, pa.ChunkedArray]) -> np.ndarray:
    return np.stack([t[c].to_numpy() for c in (D1, D2)], axis=1).astype(np.int64).view(np.uint64)


def _leaf_sums(leaf: np.ndarray, digests: np.ndarray, leaves: int) -> np.ndarray:
    """Digests of all leaves: sums of their rows' digests, in any order."""
    sums = np.zeros((leaves, 2), np.uint64)
    np.add.at(sums, leaf, digests)
    return sums


def _by_run(t: pa.Table) -> list[tuple[int, np.ndarray]]:
    """The runs in a table, in order, with the places of their rows."""
    runs = t.column(RUN).to_numpy()
    order = np.argsort(runs, kind="stable")
    found, at = np.unique(runs[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, at[1:]), strict=True))


def _rows(schema: pa.Schema, n: int, **columns) -> pa.Table:
    """Rows with the given columns; one value stands for all rows, and columns not given are null."""
    cols = [columns.get(f.name) for f in schema]
    return pa.table([pa.nulls(n, f.type) if c is None else pa.array([c] * n, f.type) if isinstance(c, (str, int)) else pa.chunked_array(c.chunks if isinstance(c, pa.ChunkedArray) else [pa.array(c, f.type)], f.type) for f, c in zip(schema, cols, strict=True)], schema)


def _root(leaves: np.ndarray) -> dict:
    d1, d2 = MerkleTree(leaves).levels[0][0].view(np.int64).tolist()
    return {D1: d1, D2: d2}


def _rooted(leaves: int):
    """The listed rows of a range, and for each run one row with the root of the Merkle tree over them."""

    def run(t: pa.Table) -> pa.Table:
        leaf, new, part = t.column(LEAF).to_numpy(), _digests(t), t.column(PART)[0].as_py()
        return pa.concat_tables([t, *[_rows(t.schema, 1, **{KIND: "root", RUN: r, PART: part}, **_root(_leaf_sums(leaf[at], new[at], leaves))) for r, at in _by_run(t)]])

    return run


def _compared(key: str, leaves: int, run: int):
    """Compares what runs list of a range with what is saved of it, each with what the one before left: changes, new state, leaf
    digests, root and number of rows. A run with the saved root is not descended."""

    def compare(listed: pa.Table, saved: pa.Table) -> pa.Table:
        rooted = listed.filter(pc.equal(listed.column(KIND), "root"))
        roots = dict(zip(rooted.column(RUN).to_pylist(), _digests(rooted), strict=True))
        listed = listed.filter(pc.not_equal(listed.column(KIND), "root"))
        nodes, state = (saved.filter(pc.equal(saved.column(KIND), k)) for k in ("leaf", "state"))
        before = np.zeros((leaves, 2), np.uint64)
        before[nodes.column(LEAF).to_numpy()] = _digests(nodes)
        tree = MerkleTree(before)
        both = {c: pa.chunked_array([*state.column(c).chunks, *listed.column(c).chunks], listed.schema.field(c).type) for c in (key, LEAF, D1, D2)}
        codes = both[key].combine_chunks().dictionary_encode().indices.to_numpy() if len(both[key]) else np.zeros(0, int)
        leaf, new = both[LEAF].to_numpy(), _digests(both)
        holder = np.full(codes.max(initial=-1) + 1, -1)  # of each key, the row with its latest digest
        holder[codes[: len(state)]] = np.arange(len(state))
        hits = []
        for r, at in _by_run(listed):
            at = at + len(state)
            if r in roots and (roots[r] == tree.levels[0][0]).all():
                continue
            now = _leaf_sums(leaf[at], new[at], leaves)
            differs = np.zeros(leaves, bool)
            differs[MerkleTree(now).changed_leaves(tree)] = True
            near = at[differs[leaf[at]]]  # rows of equal leaves are as they were
            was = holder[codes[near]]
            hits.append(near[(was < 0) | (new[near] != new[was]).any(axis=1)] - len(state))
            holder[codes[near]] = near
            before[leaf[at]] = now[leaf[at]]
            tree = MerkleTree(before)
        full, last = np.flatnonzero(before.any(axis=1)), np.sort(holder[holder >= 0])
        all_ = {RUN: run, PART: listed.column(PART)[0].as_py()}
        hit = listed.take(pa.array(np.concatenate([np.zeros(0, int), *hits])))
        return pa.concat_tables([
            _rows(listed.schema, len(hit), **{c: hit.column(c) for c in listed.column_names} | {KIND: "change"}),
            _rows(listed.schema, len(last), **{KIND: "state"} | all_ | {c: v.take(pa.array(last)) for c, v in both.items()}),
            _rows(listed.schema, len(full), **{KIND: "leaf", LEAF: full, D1: before[full, 0].view(np.int64), D2: before[full, 1].view(np.int64)} | all_),
            _rows(listed.schema, 1, **{KIND: "root", LEAF: len(last)} | all_ | _root(before)),
        ])

    return compare


class ChangeFeed:
    """Run after run over a growing table: each finds what is new or changed and publishes it with the new state.

    Keys are spread over ranges of their hash, each a subtree of ``16 ** depth`` leaves. The saved state of a range has a
    digest for each key, and the digest of each leaf as it was last listed. A run computes the root of every listed range;
    ranges with the saved root are taken over by name and not read. In the others the trees are descended only where
    digests differ, and only rows of differing leaves are looked up in the state. Changes, state, digests and roots are
    written to a folder of the run, and become visible together by one small file of a new name, so that a run that dies is
    simply run again: no record is skipped and none is handed on twice. There may be one writer at a time.

    Runs that wait can be fed together: a task takes the rows of a range run by run, and state is read and written once for
    all of them, not once a run.

    The number of ranges grows with the state, so that each holds about ``range_rows`` keys; the driver holds one digest a
    range. ``key`` may be of any type but a nested one.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, values: list[str], depth: int = 3, range_rows: int = RANGE_ROWS):
        self.spark, self.root, self.key, self.values, self.depth, self.range_rows = spark, root.rstrip("/"), key, list(values), depth, range_rows
        self.leaves = FANOUT**depth

    def current(self) -> dict | None:
        return newest(f"{self.root}/commits")

    def _placed(self, df: DataFrame, ranges: int) -> DataFrame:
        h = F.xxhash64(self.key)
        return df.withColumn(PART, F.pmod(F.shiftright(h, 20), F.lit(ranges)).cast("int")).withColumn(LEAF, F.pmod(h, F.lit(self.leaves)))

    def _listing(self, listing: DataFrame, ranges: int) -> DataFrame:
        """One row a run (its number is in ``f_run``) and key with its place and digest; a null is unlike anything, so its
        digest is salted. Grouped by a hash first, as rows are sorted for that and keys often begin alike."""
        rows = listing.filter(F.col(self.key).isNotNull()).groupBy(F.xxhash64(self.key).alias("f_h"), RUN, self.key).agg(F.max(F.struct(*self.values)).alias("f_v")).select(RUN, self.key, "f_v.*")
        null = F.lit(False)
        for v in self.values:
            null = null | F.col(v).isNull()
        salted = F.when(null, F.col(RUN)).otherwise(F.lit(0)).cast("long")
        rows = self._placed(rows, ranges).withColumn(D1, F.xxhash64(F.lit(1), self.key, *self.values, salted)).withColumn(D2, F.xxhash64(F.lit(2), self.key, *self.values, salted))
        return rows.select(F.lit("row").alias(KIND), RUN, PART, LEAF, D1, D2, self.key, *self.values)

    def run(self, listing: DataFrame, label: int | None = None) -> DataFrame:
        """Records of ``listing`` that are new or changed since the last published run; published with the new state.

        Of repeated keys the greatest by values counts, nulls first; rows with a null key are left out; a record is always
        handed on when one of its values is null or was; records that the listing lacks stay as they were. An empty
        listing publishes no changes. Other columns are ignored. ``label`` names the run, by default its number.
        """
        now = self._now()
        number = now["run"] + 1
        label = number if label is None else label
        version = f"run-{number:08d}-{uuid.uuid4().hex}"
        listing = listing.withColumn(RUN, F.lit(number).cast("long"))
        schema = self._listing(listing, 1).schema
        if not now["ranges"]:
            now["ranges"] = max(1, -(-listing.filter(F.col(self.key).isNotNull()).count() // self.range_rows))
        else:
            self._grow(now, f"{version}-split", number, 0, schema)
        self._listing(listing, now["ranges"]).groupBy(PART).applyInArrow(_rooted(self.leaves), schema).write.partitionBy(KIND).parquet(f"{self.root}/{version}/listing")
        roots = {str(r[PART]): [r[D1], r[D2]] for r in self._read(schema, "root", [f"{version}/listing"]).collect()}
        touched = sorted(int(p) for p, r in roots.items() if now["roots"].get(p) != r)
        if touched:
            near = self._read(schema, "row", [f"{version}/listing"])
            if len(touched) < len(roots):
                near = near.filter(F.col(PART).isin(touched))
            out = near.groupBy(PART).cogroup(self._saved(now, touched, schema).groupBy(PART)).applyInArrow(_compared(self.key, self.leaves, number), schema)
            self._write(now, out, version, number)
        publish(f"{self.root}/commits", number, now | {"run": number, "label": label, "labels": [label], "changes": f"{version}/out" if touched else None})
        remove(f"{self.root}/{version}/listing")
        return self.changes(schema, [number])

    def run_all(self, listings: DataFrame, run: str, rows: dict[int, int]) -> DataFrame:
        """What ``run`` would hand on for one listing after the other, in order of their labels in column ``run``, at once.

        ``rows`` has the labels and the number of rows of each; ranges are made for that many rows. All become visible
        together, with the state after the last. Rows with other labels are ignored.
        """
        now, labels = self._now(), sorted(rows)
        first, number, n = now["run"] + 1, now["run"] + len(labels), sum(rows.values())
        version = f"run-{number:08d}-{uuid.uuid4().hex}"
        numbers = self.spark.createDataFrame([(x, first + i) for i, x in enumerate(labels)], f"f_label long, {RUN} long")  # one row a run
        listing = listings.join(F.broadcast(numbers), F.col(run) == F.col("f_label"))
        schema = self._listing(listing, 1).schema
        if not now["ranges"]:
            now["ranges"] = max(1, -(-n // self.range_rows))
        else:
            self._grow(now, f"{version}-split", number, n, schema)
        rooted, compared = _rooted(self.leaves), _compared(self.key, self.leaves, number)

        def caught_up(listed: pa.Table, saved: pa.Table) -> pa.Table:
            return compared(rooted(listed), saved) if len(listed) else listed

        saved = self._saved(now, [int(p) for p in now["state"]], schema)
        out = self._listing(listing, now["ranges"]).groupBy(PART).cogroup(saved.groupBy(PART)).applyInArrow(caught_up, schema)
        self._write(now, out, version, number)
        publish(f"{self.root}/commits", number, now | {"run": number, "label": labels[-1], "labels": labels, "changes": f"{version}/out"})
        return self.changes(schema, range(first, number + 1))

    def _now(self) -> dict:
        return self.current() or {"run": 0, "ranges": 0, "rows": {}, "roots": {}, "state": {}}

    def _write(self, now: dict, out: DataFrame, version: str, number: int) -> None:
        """Writes changes, state, digests and roots of ranges, and notes where they are."""
        out.write.partitionBy(KIND).parquet(f"{self.root}/{version}/out")
        for r in self._read(out.schema, "root", [f"{version}/out"]).collect():
            p = str(r[PART])
            now["roots"][p], now["rows"][p], now["state"][p] = [r[D1], r[D2]], r[LEAF], [number, f"{version}/out"]

    def changes(self, schema, numbers=None) -> DataFrame:
        """``f_run`` (label), key and values of what runs with the given numbers, or all, handed on."""
        runs = []
        for c in published(f"{self.root}/commits"):
            labels = c.get("labels", [c["label"]])
            runs += [(n, x, c["changes"]) for n, x in enumerate(labels, c["run"] - len(labels) + 1) if c["changes"] and (numbers is None or n in numbers)]
        if not runs:
            return self.spark.createDataFrame([], schema).select(RUN, self.key, *self.values)
        got = self._read(schema, "change", sorted({f for _, _, f in runs}))
        labels = self.spark.createDataFrame([(n, x) for n, x, _ in runs], f"{RUN} long, f_label long")  # one row a run
        return got.join(F.broadcast(labels), RUN).select(F.col("f_label").alias(RUN), self.key, *self.values)

    def _read(self, schema, kind: str, folders: list[str]) -> DataFrame:
        """Rows of a kind in folders of this feed; a folder without such rows has none written."""
        at = [f"{self.root}/{f}/{KIND}={kind}" for f in folders]
        at = [f for f in at if exists(f)]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(StructType([f for f in schema if f.name != KIND])).parquet(*at).withColumn(KIND, F.lit(kind)).select(*schema.names)

    def _saved(self, now: dict, ranges: list[int], schema) -> DataFrame:
        """State rows and leaf digests of some ranges, from the folders that hold their latest version only."""
        where = [(p, *now["state"][str(p)]) for p in ranges if str(p) in now["state"]]
        if not where:
            return self.spark.createDataFrame([], schema)
        folders = sorted({v for _, _, v in where})
        rows = self._read(schema, "state", folders).unionByName(self._read(schema, "leaf", folders)).filter(F.col(PART).isin(ranges))
        if len(folders) == 1:
            return rows
        live = self.spark.createDataFrame([(p, r) for p, r, _ in where], f"{PART} int, {RUN} long")  # one row a range
        return rows.join(F.broadcast(live), [PART, RUN], "left_semi").select(*schema.names)

    def _grow(self, now: dict, version: str, number: int, fresh: int, schema) -> None:
        """Spreads the state over more ranges if it, with ``fresh`` rows to come, has outgrown them. Their leaf digests are not
        known until they are listed again."""
        load = sum(now["rows"].values()) + fresh
        if load <= 2 * now["ranges"] * self.range_rows:
            return
        rows = self._saved(now, [int(p) for p in now["state"]], schema).filter(F.col(KIND) == "state")
        ranges = -(-load // self.range_rows)
        self._placed(rows, ranges).withColumn(RUN, F.lit(-number).cast("long")).select(*schema.names).repartition(PART).sortWithinPartitions(PART).write.partitionBy(KIND).parquet(f"{self.root}/{version}")
        got = self._read(schema, "state", [version]).groupBy(PART).count().collect()
        now |= {"ranges": ranges, "roots": {}, "rows": {str(r[PART]): r["count"] for r in got}, "state": {str(r[PART]): [-number, version] for r in got}}


def replay_runs(df: DataFrame, run: str, key: str, values: list[str], root: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The changes of each run of ``df`` against all earlier ones, by a ``ChangeFeed`` at ``root``: ``run``, ``key``.

    ``df`` has one listing per value of ``run`` (long): ``key`` and long ``values``; only rows that were handled with
    success may be in it. A key is handed on in its first run, whenever a value differs from that in the latest earlier run
    that lists it, and whenever one of these values is null. Of repeated rows of a run and key the greatest by ``values``,
    nulls first, counts. Rows with a null run or key are left out; an empty input gives no rows.

    Runs that ``root`` has already published are passed over, so that later runs go on from there. Several that wait are fed
    together: fed one by one, each run would read and write the state of nearly all ranges again.
    """
    rows = df.filter(F.col(run).isNotNull() & F.col(key).isNotNull()).select(F.col(run).cast("long").alias(run), key, *[F.col(v).cast("long").alias(v) for v in values])
    feed = ChangeFeed(df.sparkSession, root, key, values, range_rows=range_rows)
    done = feed.current()
    waiting = rows if done is None else rows.filter(F.col(run) > done["label"])
    counts = {r[run]: r["f_n"] for r in waiting.groupBy(run).agg(F.count(F.lit(1)).alias("f_n")).collect()}  # as many as there are runs
    if len(counts) > 1:
        feed.run_all(waiting, run, counts)
    elif counts:
        feed.run(waiting, *counts)
    schema = feed._listing(rows.withColumn(RUN, F.col(run)), 1).schema
    return feed.changes(schema).select(F.col(RUN).alias(run), key)
