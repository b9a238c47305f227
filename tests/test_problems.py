"""The general operators against plain brute force, with nulls, ties, repeats, empty tables and clashing names."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions.addresses import canonical_ip
from netloom.operators.changefeed import ChangeFeed, MerkleTree, mix, replay_runs
from netloom.operators.compaction import compact, disagreeing_captures, longest_first
from netloom.operators.intervals import periods_and_gaps
from netloom.operators.keyed import Measure, aggregate_by_key, heavy_keys
from netloom.operators.sessions import close_runs, sessionize
from netloom.session import scratch

T0 = datetime(2024, 1, 1)


def at(us):
    return None if us is None else T0 + timedelta(microseconds=us)


def us(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def test_keyed(spark):
    rows = [("10.0.0.1", 5), ("010.0.0.1", 7), (None, 1), ("bad", 2), ("10.0.0.2", None), ("10.0.0.2", 3), ("10.0.0.2", 3)]
    df = spark.createDataFrame(rows, "key_value string, _key int")
    got = {r.key_value: (r.n, r.s, r.lo, r.hi) for r in aggregate_by_key(df, F.col("key_value"), [Measure("n", "count"), Measure("s", "sum", "_key"), Measure("lo", "min", "_key"), Measure("hi", "max", "_key")], canonical_ip).collect()}
    assert got == {"10.0.0.1": (2, 12, 5, 7), "10.0.0.2": (3, 6, 3, 3), None: (2, 3, 1, 2)}
    assert [(r.key_value, r.n_rows) for r in heavy_keys(df, F.col("key_value"), 40, canonical_ip).collect()] == [("10.0.0.2", 3)]
    assert heavy_keys(df.limit(0), F.col("key_value"), 2).collect() == []
    with pytest.raises(ValueError):
        Measure("x", "median")


def test_longest_first():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 1000, 500)
    g = longest_first(w, 7)
    load = np.bincount(g, w, minlength=7)
    assert load.max() <= w.sum() / 7 * 4 / 3 + w.max() / 3
    assert sorted(longest_first(np.array([5, 5, 5]), 3)) == [0, 1, 2]


@pytest.mark.parametrize("target", [1000, 40, 7])
def test_compaction(spark, target):
    rng = random.Random(target)
    rows = []
    for c, n in {"/a": 100, "/b": 3, "/c": 1, "/hot": 200}.items():
        rows += [(rng.choice([c, f"/x/..{c}"]), i, at(i), f"v{i}") for i in range(n)]
    rows += [r for r in rows if rng.random() < 0.3] + [("/b", None, None, "x"), ("/b", None, None, "x"), (None, 1, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "filename string, packet_number long, timestamp timestamp_ntz, _group string")
    from netloom.functions.addresses import canonical_path

    done = compact(df, canonical_path("filename"), "packet_number", scratch(spark, "t"), target)
    per = {r.capture: (r.n, r.k) for r in done.manifest().groupBy("capture").agg(F.sum("n_records").alias("n"), F.sum("n_keyed").alias("k")).collect()}
    assert per == {"/a": (100, 100), "/b": (5, 3), "/c": (1, 1), "/hot": (200, 200), "": (1, 1)}
    kept = done.records()
    assert kept.columns == df.columns and kept.count() == 307
    assert kept.filter("packet_number is not null").select(canonical_path("filename"), "packet_number").distinct().count() == 305
    sizes = [r.n for r in done.manifest().groupBy("file").agg(F.sum("n_records").alias("n")).collect()]
    assert max(sizes) <= 2 * target and (target < 1000 or len(sizes) == 1)
    inv = spark.createDataFrame([(1, "/a", 99), (2, "/a", 100), (1, "/b", 4), (2, "/b", None), (1, "/none", 0), (3, "/gone", 2), (1, None, 5)], "run_number long, filename string, packet_count long")
    assert sorted((r.filename, r.n_found) for r in disagreeing_captures(done, inv).collect()) == [("/b", 3), ("/gone", 0)]


def test_compaction_of_nothing(spark):
    df = spark.createDataFrame([], "filename string, packet_number long")
    done = compact(df, F.col("filename"), "packet_number", scratch(spark, "t"))
    assert done.manifest().count() == 0 and done.records().count() == 0


def brute_sessions(rows, gap):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        ts = sorted(r[1] for r in rows if r[0] == k and r[1] is not None)
        runs = []
        for t in ts:
            if runs and t - runs[-1][1] <= gap:
                runs[-1][1] = t
                runs[-1][2] += 1
            else:
                runs.append([t, t, 1])
        out[k] = [tuple(r) for r in runs]
    return {(k, *r) for k, v in out.items() for r in v}


@pytest.mark.parametrize("seed", range(4))
def test_sessions(spark, seed):
    rng = random.Random(seed)
    gap = 30 * rng.choice([1, 7, 1000]) if seed else 1
    rows = []
    for k in ["a", "b", "", None]:
        t = rng.choice([-5000, 0, 10**9])
        for _ in range(rng.choice([1, 50, 400])):
            t += rng.choice([0, 1, gap // 30, gap - 1, gap, gap + 1, 3 * gap, 100 * gap])
            rows.append((k, t if rng.random() > 0.05 else None))
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, at(t), 1) for k, t in rows], "k string, t timestamp_ntz, _cell int")
    got = {(r.k, r.start_us, r.end_us, r.n_events) for r in sessionize(df, {"k": F.col("k")}, F.col("t"), gap).collect()}
    assert got == {(k, us(at(a)), us(at(b)), n) for k, a, b, n in brute_sessions(rows, gap)}
    assert sessionize(df.limit(0), {"k": F.col("k")}, F.col("t"), gap).collect() == []


def test_closing():
    rng = random.Random(3)
    for _ in range(200):
        texts, runs, want = [], [], []
        for g in range(3):
            texts.append("".join(rng.choice("0001") for _ in range(rng.randint(1, 80))))
        reach = rng.randint(0, 9)
        for g, text in enumerate(texts):
            runs += [(g, m.start(), m.end() - 1) for m in re.finditer("1+", text)]
            closed = re.sub("(?<=1)0{1,%d}(?=1)" % reach, lambda m: "1" * len(m[0]), text) if reach else text
            want += [(g, m.start(), m.end() - 1) for m in re.finditer("1+", closed)]
        g, a, b = (np.array([r[i] for r in runs], np.int64) for i in range(3))
        row, first, last = close_runs(g, a, b, reach)
        assert list(zip(g[row].tolist(), first.tolist(), last.tolist(), strict=True)) == want
        assert (a[row] == first).all()


def test_sessions_come_from_the_closing(spark, monkeypatch):
    from netloom.operators import sessions

    monkeypatch.setattr(sessions, "close_runs", lambda group, first, last, reach: (np.arange(len(first)), first, last))
    df = spark.createDataFrame([("a", at(t)) for t in (0, 5, 10, 15, 40)], "k string, t timestamp_ntz")
    open_ = sessions._sessionizer(["k"], 10)  # bound to the module, so that this process sees the switch
    import pyarrow as pa

    rows = pa.table({"k": ["a"] * 4, "start_us": [0, 10, 15, 40], "end_us": [5, 10, 15, 40], "n_events": [2, 1, 1, 1]}).to_batches()
    assert sum(b.num_rows for b in open_(iter(rows))) == 4
    monkeypatch.undo()
    assert sum(b.num_rows for b in open_(iter(rows))) == 2
    assert sorted((r.start_us, r.end_us, r.n_events) for r in sessionize(df, {"k": F.col("k")}, F.col("t"), 10).collect()) == [(us(at(0)), us(at(15)), 4), (us(at(40)), us(at(40)), 1)]


def brute_periods(rows):
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        spans = sorted((a, b) for e, a, b in rows if e == k and a is not None and b is not None and a <= b)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged} | {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)}
    return out


@pytest.mark.parametrize("seed", range(5))
def test_intervals(spark, seed):
    rng = random.Random(seed)
    shard = rng.choice([10, 50, 10**6])
    rows = []
    for k in ["a", "b", None]:
        for _ in range(rng.choice([0, 3, 300])):
            a = rng.randint(-500, 2000)
            b = a + rng.choice([0, 0, 1, 3, 10, 49, 200 if rng.random() < 0.2 else 2, -5])
            rows.append((k, a if rng.random() > 0.03 else None, b if rng.random() > 0.03 else None))
    rows += rows[:20]
    df = spark.createDataFrame([(k, at(a), at(b), "z") for k, a, b in rows], "entity string, x timestamp_ntz, y timestamp_ntz, shard string")
    got = [(r.entity, r.span_kind, r.start_us, r.end_us) for r in periods_and_gaps(df, F.col("entity"), F.col("x"), F.col("y"), None, shard).collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, s, us(at(a)), us(at(b))) for k, s, a, b in brute_periods(rows)}
    short = {g for g in got if g[1] == "period" or g[3] - g[2] <= 7}
    assert {(r.entity, r.span_kind, r.start_us, r.end_us) for r in periods_and_gaps(df, F.col("entity"), F.col("x"), F.col("y"), 7, shard).collect()} == short


@pytest.mark.parametrize("batch", [1, 2, 1000])
def test_intervals_across_batches(spark, batch):
    from netloom.operators.intervals import _map_side, _shard_side
    import pyarrow as pa

    spans = [("a", 0, 3), ("a", 3, 4), ("a", 6, 7), ("a", 9, 9), ("a", 12, 95), ("a", 14, 15), ("a", 97, 98), ("b", 1, 1)]
    t = pa.table({"entity": [s[0] for s in spans], "first_us": [s[1] for s in spans], "last_us": [s[2] for s in spans]})
    pieces = pa.Table.from_batches(_map_side(20)(iter(t.to_batches(max_chunksize=batch)))).to_pylist()
    pieces.sort(key=lambda r: (r["entity"], r["whole"], r["shard"], r["f"]))
    rows = [r for b in _shard_side(iter(pa.Table.from_pylist(pieces).to_batches(max_chunksize=batch))) for r in b.to_pylist()]
    got = sorted((r["entity"], r["kind"], r["f"] / 2, r["e"] / 2) for r in rows)
    assert got == [("a", 0, 0, 4), ("a", 0, 9, 9), ("a", 0, 12, 19.5), ("a", 0, 90, 95), ("a", 0, 97, 98), ("a", 1, 6, 7), ("a", 2, 4, 6), ("a", 2, 7, 9), ("a", 2, 95, 97), ("a", 3, 20, 89.5), ("b", 0, 1, 1)]


def test_a_long_span_costs_three_rows(spark):
    from netloom.operators.intervals import DAY_US, _map_side
    import pyarrow as pa

    years = 8000 * 365 * DAY_US
    t = pa.table({"entity": ["a"], "first_us": [5], "last_us": [years]})
    pieces = pa.Table.from_batches(_map_side(2 * DAY_US)(iter(t.to_batches()))).to_pylist()
    assert [(r["shard"], r["whole"]) for r in pieces] == [(0, False), (years // DAY_US, False), (1, True)]
    assert pieces[2]["f"] == pieces[0]["e"] + 1 and pieces[2]["e"] == pieces[1]["f"] - 1
    df = spark.createDataFrame([("a", at(5), datetime(9999, 1, 1)), ("a", at(7), at(9)), ("a", at(2 * DAY_US), at(2 * DAY_US + 5)), ("a", at(2 * DAY_US + 9), at(2 * DAY_US + 10)), ("a", at(0), at(3))], "e string, x timestamp_ntz, y timestamp_ntz")
    got = sorted((r.span_kind, r.start_us, r.end_us) for r in periods_and_gaps(df, F.col("e"), F.col("x"), F.col("y")).collect())
    assert got == [("gap", us(at(3)), us(at(5))), ("period", us(at(0)), us(at(3))), ("period", us(at(5)), us(datetime(9999, 1, 1)))]


def brute_changes(rows):
    state, out = {}, set()
    for run in sorted({r[0] for r in rows if r[0] is not None}):
        now = {}
        for r, k, a, b in rows:
            if r == run and k is not None:
                v = (a, b)
                key = tuple((x is not None, x or 0) for x in v)
                if k not in now or key >= now[k][0]:
                    now[k] = (key, v)
        for k, (_, v) in now.items():
            if k not in state or None in v or None in state[k] or v != state[k]:
                out.add((run, k))
            state[k] = v
    return out


@pytest.mark.parametrize("seed", range(3))
def test_replay(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, 3, 5]), f"k{rng.randint(0, 60)}", rng.choice([1, 2, None]), rng.choice([7, 8, 8, 8])) for _ in range(500)]
    rows += [(None, "k1", 1, 1), (2, None, 1, 1)]
    df = spark.createDataFrame(rows, "run long, key string, a long, b long")
    at = scratch(spark, "t")
    got = [(r.run, r.key) for r in replay_runs(df, "run", "key", ["a", "b"], at, range_rows=[1000, 20, 7][seed]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_changes(rows)
    # What is published is not done again; a later run goes on from there.
    more = rows + [(9, "k1", 1, 7), (9, "fresh", 1, 7)]
    got = {(r.run, r.key) for r in replay_runs(spark.createDataFrame(more, "run long, key string, a long, b long"), "run", "key", ["a", "b"], at).collect()}
    assert got == brute_changes(more)


def test_replay_writes_the_state_once(spark, tmp_path):
    rng = random.Random(5)
    rows = [(run, f"k{k}", rng.choice([1, 1, 1, 2, None]), 7) for run in range(1, 9) for k in rng.sample(range(100), 40)]

    def replay(rows, at):
        df = spark.createDataFrame(rows, "run long, key string, a long, b long")
        return {(r.run, r.key) for r in replay_runs(df, "run", "key", ["a", "b"], at, range_rows=20).collect()}

    def state():
        return [spark.read.parquet(str(p)).count() for p in tmp_path.glob("run-*/out/f_kind=state")]

    assert replay(rows, str(tmp_path)) == brute_changes(rows)
    assert state() == [len({r[1] for r in rows})]
    # Runs that wait meet the saved state together, in ranges made for their rows, too.
    more = rows + [(run, f"{x}{k}", rng.choice([1, 2, None]), 7) for run in (9, 11, 14) for x in "kn" for k in range(0, 200, run)] + [(20, "n0", 1, 7), (21, "n0", None, 7), (22, "n0", None, 7), (23, "n0", 1, 7), (24, "n0", 1, 7)]
    assert replay(more, str(tmp_path)) == brute_changes(more) and len(state()) == 2


def test_runs_fed_together_leave_what_single_runs_leave(spark):
    rng = random.Random(6)
    runs = {label: [(f"k{k}", rng.choice([1, 2]), "x") for k in rng.sample(range(80), 30)] for label in (3, 4, 10)}
    single, together = (ChangeFeed(spark, scratch(spark, "feed"), "k", ["v", "w"], depth=2) for _ in range(2))
    one = [tuple(r) for label, rows in runs.items() for r in single.run(spark.createDataFrame(rows, "k string, v long, w string"), label).collect()]
    all_ = spark.createDataFrame([(label, *r) for label, rows in runs.items() for r in rows], "n long, k string, v long, w string")
    got = [tuple(r) for r in together.run_all(all_, "n", {label: len(rows) for label, rows in runs.items()}).collect()]
    assert sorted(got) == sorted(one) and len(one) > 30
    assert [single.current()[c] for c in ("run", "label", "ranges", "rows", "roots")] == [together.current()[c] for c in ("run", "label", "ranges", "rows", "roots")]
    rest = spark.createDataFrame([("k1", 9, "x"), *runs[10]], "k string, v long, w string")
    assert sorted(single.run(rest, 11).collect()) == sorted(together.run(rest, 11).collect())


def test_replay_of_nothing(spark):
    df = spark.createDataFrame([], "run long, key string, a long, b long")
    assert replay_runs(df, "run", "key", ["a", "b"], scratch(spark, "t")).collect() == []


def test_merkle_descends_only_where_needed():
    a = mix(np.arange(2 * 16**3, dtype=np.uint64)).reshape(-1, 2)
    b = a.copy()
    b[[5, 900]] += np.uint64(1)
    assert MerkleTree(b).changed_leaves(MerkleTree(a)).tolist() == [5, 900]
    assert len(MerkleTree(a.copy()).changed_leaves(MerkleTree(a))) == 0


def test_changes_come_from_the_descent(monkeypatch):
    import pyarrow as pa

    from netloom.operators import changefeed as c

    schema = pa.schema([(c.KIND, pa.string()), (c.RUN, pa.int64()), (c.PART, pa.int32()), (c.LEAF, pa.int64()), (c.D1, pa.int64()), (c.D2, pa.int64()), ("k", pa.string()), ("v", pa.int64())])

    def table(kind, rows):
        return pa.Table.from_pylist([dict(zip(schema.names, (kind, 1, 0, leaf, d, d, k, d), strict=True)) for leaf, d, k in rows], schema)

    saved = pa.concat_tables([table("state", [(0, 5, "a"), (1, 6, "b")]), table("leaf", [(0, 5, None), (1, 6, None)])])
    listed = table("row", [(0, 5, "a"), (1, 7, "b")])

    def changed():
        return [r["k"] for r in c._compared("k", 16, 2)(listed, saved).to_pylist() if r[c.KIND] == "change"]

    assert changed() == ["b"]
    monkeypatch.setattr(MerkleTree, "changed_leaves", lambda self, other: np.array([], np.int64))
    assert changed() == []


def test_change_feed_reads_touched_ranges_only(spark, monkeypatch):
    feed = ChangeFeed(spark, scratch(spark, "feed"), "k", ["v"], depth=1, range_rows=10)
    rows = [(f"k{i}", i) for i in range(200)]
    feed.run(spark.createDataFrame(rows, "k string, v long"))
    before, read, plain = feed.current(), [], ChangeFeed._saved
    assert before["ranges"] == 20
    monkeypatch.setattr(ChangeFeed, "_saved", lambda self, now, ranges, schema: read.append(ranges) or plain(self, now, ranges, schema))
    got = feed.run(spark.createDataFrame([(k, v + (k == "k7")) for k, v in rows], "k string, v long")).collect()
    after = feed.current()
    assert [tuple(r) for r in got] == [(2, "k7", 8)] and len(read) == 1 and len(read[0]) == 1
    assert [p for p in after["state"] if after["state"][p] != before["state"][p]] == [str(read[0][0])]
    # The next change in another range reads the state of two versions, each where it is the latest.
    got = feed.run(spark.createDataFrame([(k, v + (k in ("k7", "k8", "k9"))) for k, v in rows] + [(f"n{i}", i) for i in range(300)], "k string, v long"))
    assert sorted(r.k for r in got.collect()) == sorted(["k8", "k9", *(f"n{i}" for i in range(300))])
    # A state that has outgrown its ranges is spread over more, and nothing is handed on for that.
    got = feed.run(spark.createDataFrame([(f"n{i}", i + (i == 5)) for i in range(300)], "k string, v long"))
    assert [r.k for r in got.collect()] == ["n5"] and feed.current()["ranges"] == 50
    assert sum(feed.current()["rows"].values()) == 500


def test_change_feed(spark):
    feed = ChangeFeed(spark, scratch(spark, "feed"), "k", ["v", "w"], depth=2, range_rows=30)
    schema = "k string, v long, w string"

    def run(rows):
        return sorted((r.k, r.v, r.w) for r in feed.run(spark.createDataFrame(rows, schema)).collect())

    first = [(f"k{i}", i, "x") for i in range(100)]
    assert run(first) == sorted(first)
    assert run(first) == []
    assert run([("k3", 3, "y"), ("new", 1, "x"), ("k5", 5, "x"), (None, 1, "x")]) == [("k3", 3, "y"), ("new", 1, "x")]
    assert run([("k3", 3, "y"), ("k7", None, "x")]) == [("k7", None, "x")]
    assert run([("k7", None, "x")]) == [("k7", None, "x")]
    assert run([]) == []
    # A run that dies before it publishes leaves the state as it was, and is simply run again.
    before = feed.current()
    broken = spark.createDataFrame([("k9", 99, "x")], schema).withColumn("v", F.when(F.col("v") == 99, F.raise_error(F.lit("lost"))).cast("long"))
    with pytest.raises(Exception, match="lost"):
        feed.run(broken)
    assert feed.current() == before
    assert run([("k9", 99, "x")]) == [("k9", 99, "x")]


def test_replay_holds_one_row_of_a_run_and_key(spark, tmp_path, monkeypatch):
    from netloom.operators import changefeed

    seen = str(tmp_path / "seen")
    plain = changefeed._rooted

    def watched(*args):
        rooted = plain(*args)

        def run(t):
            with open(seen, "a") as f:
                f.write(f"{len(t)}\n")
            return rooted(t)

        return run

    monkeypatch.setattr(changefeed, "_rooted", watched)
    rows = [(1, "hot", 5, 1)] * 3000 + [(1, "hot", None, 9), (1, "cold", 1, 1), (2, "hot", 5, 1), (2, "cold", 1, 2)]
    df = spark.createDataFrame(rows, "n long, k string, size long, t long")
    got = changefeed.replay_runs(df, "n", "k", ["size", "t"], str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == [(1, "cold"), (1, "hot"), (2, "cold")]
    with open(seen) as f:
        assert sum(map(int, f)) == 4
