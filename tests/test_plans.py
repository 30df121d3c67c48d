"""Ordered scans, neighbour chunks and range joins against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from soundkeel.plans.halo import drop_halo, halo_window, with_halo
from soundkeel.plans.ordered import CHUNK, KEY, Running, cut, following, previous, running
from soundkeel.plans.sizes import join_small
from soundkeel.plans.rangejoin import point_in_interval


def rows_of(seed, n=400, skew=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if skew and rng.random() < 0.6 else rng.choice(["a", "b", None])
        pos = rng.choice([rng.randint(0, 50), rng.randint(0, 10**6)])
        out.append((key, pos, i, rng.choice([None, rng.randint(-5, 9)])))
    return out


@pytest.fixture
def chunks(spark, request):
    spark.conf.set("spark.soundkeel.rangeChunks", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.unset("spark.soundkeel.rangeChunks")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("chunks", [1, 7, 60], indirect=True)
@pytest.mark.parametrize("keys", [["k"], []])
def test_scan_is_exact(spark, chunks, keys):
    rows = rows_of(chunks + len(keys))
    df = spark.createDataFrame(rows, "k string, pos long, id long, v int")
    got = running(
        df, keys, [F.col("pos"), F.col("id")],
        {
            "s": Running(F.coalesce("v", F.lit(0))),
            "sx": Running(F.coalesce("v", F.lit(0)), inclusive=False),
            "hi": Running(F.col("v"), "max"),
            "lo": Running(F.col("v"), "min", inclusive=False),
            "prev": previous(F.col("v")),
            "next": following(F.col("v")),
        },
    )
    assert set(got.columns) == {"k", "pos", "id", "v", "s", "sx", "hi", "lo", "prev", "next"}
    found = {r["id"]: r for r in got.collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0] if keys else 0, []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[1], r[2]))
        for i, (_, _, ident, v) in enumerate(g):
            before = [x[3] for x in g[:i] if x[3] is not None]
            upto = before + ([v] if v is not None else [])
            after = [x[3] for x in g[i + 1 :] if x[3] is not None]
            r = found[ident]
            assert (r["s"], r["sx"]) == (sum(upto), sum(before))
            assert (r["hi"], r["lo"]) == (max(upto, default=None), min(before, default=None))
            assert (r["prev"], r["next"]) == (before[-1] if before else None, after[0] if after else None)


def largest(df, keys, order):
    return cut(df, keys, order).groupBy(KEY, CHUNK).count().agg(F.max("count")).head()[0]


@pytest.mark.parametrize("chunks", [20], indirect=True)
def test_chunks_are_even_whatever_the_positions(spark, chunks):
    """An outlier, equal positions, text keys and many hot keys give no large chunk."""
    outlier = spark.createDataFrame([("a", i if i else 10**12) for i in range(2000)], "k string, pos long")
    assert largest(outlier, ["k"], [F.col("pos")]) <= 300
    equal = spark.createDataFrame([("a", 5)] * 2000, "k string, pos long")
    assert largest(equal, ["k"], [F.col("pos")]) <= 300
    text = spark.createDataFrame([("all", f"file_{i * 7919 % 2000}.wav") for i in range(2000)], "k string, pos string")
    assert largest(text, [], [F.col("pos")]) <= 300
    many = spark.createDataFrame([(f"k{i % 8}", i) for i in range(4000)], "k string, pos long")
    assert largest(many, ["k"], [F.col("pos")]) <= 500


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_statistics(spark, limit, how):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, v long")
    small = big.filter("v < 200").groupBy("k").agg(F.max("v").alias("top"))
    got = join_small(big, small, ["k"], how=how, limit=limit)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, big.join(small, "k", how).collect()), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("_salt" in plan) == (limit == 0) and ("BroadcastHashJoin" in plan or limit == 0)


@pytest.mark.parametrize("salts", [{}, {"salts": 1}])
def test_statistics_over_the_limit_are_not_broadcast(spark, salts):
    """Their file, or that of which copies are made, may be far smaller than their rows in memory."""
    big = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    small = big.groupBy("k").agg(F.max("id").alias("top"))
    got = join_small(big, small, ["k"], limit=0, **salts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_halo_equals_plain_window(spark):
    n, before, after = 300, 3, 5
    df = spark.range(n).select("id", (F.col("id") * 7919 % 101).alias("v"), F.lit("f").alias("file"))
    w = halo_window(["file"], "id").rowsBetween(-before, after)
    got = drop_halo(with_halo(df, "id", 16, before, after).withColumn("m", F.max("v").over(w)))
    vals = [i * 7919 % 101 for i in range(n)]
    for r in got.collect():
        assert r["m"] == max(vals[max(0, r["id"] - before) : r["id"] + after + 1])
    assert got.count() == n


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(3)
    pts = [("x" if rng.random() < 0.7 else "y", rng.randint(0, 500), i) for i in range(300)]
    ivs = [(rng.choice("xy"), s, s + rng.randint(0, 90), i) for i, s in enumerate(rng.randint(0, 480) for _ in range(60))]
    p = spark.createDataFrame(pts, "k string, pos long, pid long")
    i = spark.createDataFrame(ivs, "k string, s long, e long, iid long")
    got = {(r["pid"], r["iid"]) for r in point_in_interval(p, i, ["k"], "pos", "s", "e", 40).collect()}
    want = {(p_[2], i_[3]) for p_ in pts for i_ in ivs if p_[0] == i_[0] and i_[1] <= p_[1] < i_[2]}
    assert got == want


def test_range_join_is_an_equi_join(spark):
    p = spark.createDataFrame([("x", 1, 1)], "k string, pos long, pid long")
    i = spark.createDataFrame([("x", 0, 5, 1)], "k string, s long, e long, iid long")
    plan = point_in_interval(p, i, ["k"], "pos", "s", "e", 40)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
