"""Operators against brute force on small logs."""

import random

import pytest
from pyspark.sql import functions as F

from varve.operators import batch as BA
from varve.operators import compact as C
from varve.operators import files as M
from varve.operators import ordered as O
from varve.operators import resolve as R
from varve.operators.snapshots import Snapshots
from varve.plans.version import File, Job, Limits, Version, pick, pick_range, with_boundary


def entries(spark, rows):
    return spark.createDataFrame(rows, "user_key long, seq long, vtype int, value string")


def random_log(seed, n=300, keys=20):
    rng = random.Random(seed)
    return [(rng.randrange(keys), s, int(rng.random() > 0.3), f"v{s}") for s in range(1, n + 1)]


def live(rows, at):
    out = {}
    for k, s, t, v in sorted(rows, key=lambda r: r[1]):
        if s <= at:
            out[k] = v if t else None
    return {k: v for k, v in out.items() if v is not None}


@pytest.mark.parametrize("at", [0, 1, 150, 300])
def test_resolve(spark, at):
    rows = random_log(1)
    got = {r["user_key"]: r["value"] for r in R.resolve(entries(spark, rows), at).collect()}
    assert got == live(rows, at)


def test_key_predicate_reaches_the_scan(spark, sf):
    from varve.queries import log

    plan = R.resolve(log(spark, sf)).where("user_key = 7")._jdf.queryExecution().toString()
    assert "EqualTo(user_id,7)" in plan
    plan = R.resolve(log(spark, sf)).where("value > 10")._jdf.queryExecution().toString()
    assert "PushedFilters: []" in plan


@pytest.mark.parametrize("less, equal", [(a, b) for a in (True, False) for b in (True, False)])
def test_near(spark, less, equal):
    keys, probes = [10 * i + 5 for i in range(100)], list(range(0, 1010, 7))
    got = O.near(spark.createDataFrame([(k,) for k in keys], "user_key long"), spark.createDataFrame([(p,) for p in probes], "probe long"), less, equal)
    ok = lambda k, p: (k < p or (equal and k == p)) if less else (k > p or (equal and k == p))
    want = {p: (max if less else min)((k for k in keys if ok(k, p)), default=None) for p in probes}
    assert {r["probe"]: r["found"] for r in got.collect()} == want


def test_ranks_and_neighbours(spark):
    keys = random.Random(3).sample(range(10**6), 700)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    assert {r["k"]: r["rank"] for r in O.ranked(df, "k").collect()} == {k: i + 1 for i, k in enumerate(sorted(keys))}
    s = sorted(keys)
    got = {r["k"]: (r["prev_key"], r["next_key"]) for r in O.neighbours(df, "k").collect()}
    assert got == {k: (s[i - 1] if i else None, s[i + 1] if i + 1 < len(s) else None) for i, k in enumerate(s)}
    assert O.ranked(df.where("k < 0"), "k").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_retention_keeps_every_readable_state(spark, seed):
    rows = random_log(seed)
    oldest = 150
    kept = [tuple(r) for r in C.retain(entries(spark, rows), oldest).collect()]
    for at in (150, 151, 222, 300):
        assert live(kept, at) == live(rows, at)
    head = [tuple(r) for r in C.retain(entries(spark, rows), 300).collect()]
    assert {r[0]: r[3] for r in head} == live(rows, 300)
    assert set(kept) < set(rows)


def test_retention_of_tombstones(spark):
    rows = [(1, 1, 1, "v1"), (1, 2, 0, None), (1, 3, 1, "v2")]
    deep = C.retain(entries(spark, rows[:2]), 9, F.lit(True))
    assert [r["seq"] for r in deep.collect()] == [2]
    assert C.retain(entries(spark, rows[:2]), 9).count() == 0
    assert [r["seq"] for r in C.retain(entries(spark, rows), 2).orderBy("seq").collect()] == [3]


def test_split_keeps_keys_whole(spark):
    df = C.split_outputs(entries(spark, random_log(5)), F.lit(10), 500)
    assert df.groupBy("user_key").agg(F.countDistinct("out_no").alias("n")).where("n > 1").count() == 0
    assert df.select("out_no").distinct().count() > 3


def test_batches(spark):
    ops = spark.createDataFrame([(0, 1, b"foo", "bar"), (1, 0, b"box", None), (2, 1, b"baz", "boo")], "pos long, vtype int, user_key binary, value string")
    got = BA.apply(BA.append(ops, ops), 100).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [100, 101, 102, 103, 104, 105]
    assert [bytes(r["user_key"]) for r in got] == [b"foo", b"box", b"baz"] * 2
    assert BA.room_for_write(0, False, False) == "write" and BA.room_for_write(8, False, False) == "delay"
    assert BA.room_for_write(12, True, False, delayed=True) == "wait" and BA.room_for_write(3, True, False) == "rotate"


def test_snapshots():
    s = Snapshots()
    assert s.oldest(9) == 9 and s.newest() is None
    a, b = s.acquire(3), s.acquire(3)
    s.acquire(5)
    assert (s.oldest(9), s.newest(), len(s)) == (3, 5, 2)
    with pytest.raises(ValueError):
        s.acquire(4)
    s.release(a)
    assert s.oldest(9) == 3
    s.release(b)
    assert s.oldest(9) == 5


def file(level, number, lo, hi, size=100, ls=9, hs=1):
    return File(level, number, size, lo.encode(), ls, hi.encode(), hs)


def test_versions():
    v = Version([file(1, 1, "150", "200"), file(1, 2, "250", "300"), file(0, 3, "150", "600"), file(0, 4, "400", "500")])
    assert v.counts() == [2, 2, 0, 0, 0, 0, 0]
    assert {f.number for f in v.overlapping(0, b"410", b"420")} == {3, 4}
    assert {f.number for f in v.overlapping(1, b"200", b"240")} == {1}
    assert {f.number for f in v.overlapping(1, None, None)} == {1, 2}
    assert v.edited({(0, 3)}, [file(2, 3, "150", "600")]).counts() == [1, 2, 1, 0, 0, 0, 0]
    assert v.edited({(0, 3)}, [file(0, 3, "1", "2")]).counts()[0] == 2  # an addition cancels the deletion
    with pytest.raises(ValueError, match="overlap"):
        Version([file(1, 1, "a", "c"), file(1, 2, "c", "d")])
    assert Version().flush_level(b"a", b"b", Limits()) == 2
    assert v.flush_level(b"160", b"170", Limits()) == 0
    assert v.edited({(0, 3), (0, 4)}, []).flush_level(b"160", b"170", Limits()) == 0
    assert Version([file(2, 1, "a", "c")]).flush_level(b"b", b"b", Limits()) == 1


def test_boundary_and_pick():
    chain = [file(1, 1, "100", "100", ls=6, hs=5), file(1, 2, "100", "100", ls=4, hs=3), file(1, 3, "100", "100", ls=2, hs=1), file(1, 4, "200", "300")]
    assert [f.number for f in with_boundary(chain, [chain[0]])] == [1, 2, 3]
    assert with_boundary(chain, []) == []
    v = Version([file(0, n, "a", "m") for n in range(1, 5)] + [file(1, 9, "b", "c"), file(1, 10, "x", "z")])
    job = pick(v, {}, Limits())
    assert job.reason == "size" and len(job.base) == 4 and [f.number for f in job.parent] == [9]
    assert pick(Version([file(0, 1, "a", "b")]), {}, Limits()) is None
    assert pick(Version([file(1, 1, "a", "b")]), {}, Limits(), sought=file(1, 1, "a", "b")).reason == "seek"
    assert pick_range(v, 1, b"y", None, Limits()).base[0].number == 10
    one = Job(0, (file(0, 1, "a", "b"),), (), "size")
    assert one.moves(Version([file(0, 1, "a", "b")]), Limits()) and one.moved().level == 1
    wrap = pick(Version([file(1, 1, "a", "b", 10**9), file(1, 2, "c", "d", 10**9)]), {1: b"b"}, Limits())
    assert [f.number for f in wrap.base] == [2]


def test_fold_edits(spark):
    edits = spark.createDataFrame([(1, "add", 0, 5), (2, "delete", 0, 5), (2, "add", 1, 5), (3, "delete", 1, 5), (3, "add", 1, 5), (4, "add", 0, 6), (5, "delete", 0, 6)], "edit_id long, action string, level int, file_no long")
    assert {tuple(r) for r in M.fold_edits(edits).collect()} == {(1, 5)}


def test_ranges_hold_under_hot_keys(spark):
    many = spark.range(200_000).selectExpr("id % 2000 as k", "id as seq")
    hot = spark.range(200_000).selectExpr("case when id < 20000 then 7 else id end as k", "id as seq")
    for df in (many, hot):
        sizes = [r["count"] for r in df.withColumn("p", O.ranges(df, "k", -F.col("seq"))).groupBy("p").count().collect()]
        assert len(sizes) == O.RANGES and max(sizes) < 3 * 200_000 / O.RANGES


def test_groups_of_batches(spark):
    rows = [(0, i, 400_000, False) for i in range(8)] + [(1, 0, 100, False), (1, 1, 130_000, False), (1, 2, 2_000, False), (1, 3, 10, True), (1, 4, 10, False)]
    got = {(r["queue"], r["pos"]): r["group_no"] for r in BA.group_commit(spark.createDataFrame(rows, "queue int, pos long, size long, sync boolean")).collect()}
    assert [got[0, i] for i in range(8)] == [0, 0, 1, 1, 2, 2, 3, 3] and [got[1, i] for i in range(5)] == [0, 0, 1, 2, 2]


def test_outputs_end_behind_grandparents(spark):
    from varve.operators import compact

    assert compact.grandparent_cuts([(b"b", 5), (b"d", 6), (b"f", 3)], 10) == [b"d"]
    df = spark.createDataFrame([(k, 1) for k in range(10)], "user_key long, seq long")
    got = {r["user_key"]: r["out_no"] for r in compact.split_outputs(df, F.lit(10), 30, cuts=[3]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 2, 7: 3, 8: 3, 9: 3}
