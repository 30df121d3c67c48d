"""Streams over several triggers: the registry that forgets, passages, counts, repeats."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from soundkeel.functions.times import micros
from soundkeel.streaming import fleet, traffic

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "ship long, ts timestamp, no long, d double, name string, seen timestamp"
T0 = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def report(ship, minutes, no, d):
    return (ship, None if minutes is None else at(minutes), no, d, f"n{no}", dt.datetime(2020, 1, 1, 0, 0, 0, 123456))


class Run:
    """A registry fed trigger by trigger; it restarts from its checkpoint each time."""

    def __init__(self, spark, folder, **options):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        self.spark, self.folder, self.options = spark, str(folder), options
        self.fold = options.pop("fold_every", 0)

    def feed(self, rows) -> int:
        """Rows of the state after a trigger."""
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in")
        told = fleet.changes(stream, "ship", "ts", "no", "d", 10.0, silence="30 minutes", delay="5 minutes")
        q = fleet.keep(told, f"{self.folder}/out", f"{self.folder}/state", "ship", every=None, fold_every=self.fold)
        q.awaitTermination()
        return [p for p in q.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"]

    def ships(self) -> dict:
        return {r.ship: (r.no, r.name, r.seen.microsecond) for r in fleet.registry(self.spark, f"{self.folder}/out", "ship", "ts", "no").collect()}

    def changes(self) -> list:
        rows = fleet.log(self.spark, f"{self.folder}/out").filter(F.col("change") != "refresh").collect()
        return sorted((r.ship, (r.ts - T0).total_seconds() / 60, r.change) for r in rows)


def test_enter_refresh_limit_leave_reenter(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.feed([report(1, 0, 1, 5.0), report(2, 1, 2, 50.0), report(3, 2, 3, 10.0), report(4, 2, 4, 1.0)])
    assert run.ships() == {1: (1, "n1", 123456), 4: (4, "n4", 123456)}
    run.feed([report(1, 8, 5, 6.0), report(4, 9, 6, 10.0), report(3, 9, 7, 9.99)])
    assert run.ships() == {1: (5, "n5", 123456), 4: (4, "n4", 123456), 3: (7, "n7", 123456)}, "at the limit a ship stays as it was"
    run.feed([report(1, 16, 8, 10.01), report(4, 17, 9, 11.0), report(4, 18, 10, 12.0), report(3, 18, 11, 2.0)])
    assert set(run.ships()) == {3}
    run.feed([report(1, 30, 12, 3.0), report(3, 31, 13, 3.0)])
    assert set(run.ships()) == {1, 3}
    assert run.changes() == [(1, 0, "enter"), (1, 16, "leave"), (1, 30, "enter"), (3, 9, "enter"), (4, 2, "enter"), (4, 17, "leave")]


def test_silent_ships_leave_and_the_state_shrinks(spark, tmp_path):
    run = Run(spark, tmp_path)
    many = run.feed([report(s, 0, s, 5.0) for s in range(1, 41)])
    run.feed([report(1, 20, 100, 5.0)])
    assert len(run.ships()) == 40
    few = run.feed([report(1, 35, 101, 5.0)])  # the watermark comes to minute 30: exactly the silence
    assert set(run.ships()) == {1} and few < many / 4
    assert run.changes() == [*[(s, 30, "silent") if k else (s, 0, "enter") for s in range(1, 41) for k in range(2) if s > 1 or not k]]
    # outside, and behind the watermark of minute 30
    run.feed([report(2, 29, 102, 5.0), report(3, 40, 103, 5.0), report(5, 41, 104, 80.0)])
    assert set(run.ships()) == {1, 3}
    last = run.feed([report(9, 400, 105, 80.0)])
    assert run.ships() == {} and last < many / 4


def test_a_gap_inside_a_trigger_and_disorder(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.feed([report(1, 40, 2, 5.0), report(1, 0, 1, 5.0), report(2, 3, 4, 50.0), report(2, 1, 3, 5.0), report(None, 1, 9, 5.0), report(7, None, 9, 5.0),
              report(8, 1, 9, None), report(8, 1, 9, float("nan"))])
    assert run.changes() == [(1, 0, "enter"), (1, 30, "silent"), (1, 40, "enter"), (2, 1, "enter"), (2, 3, "leave")]
    run.feed([report(1, 39, 5, 99.0), report(3, 38, 6, 80.0)])
    assert set(run.ships()) == {1}, "a report older than the last one taken changes nothing"
    run.feed([report(3, 37, 7, 5.0)])
    assert set(run.ships()) == {1}


@pytest.mark.parametrize("fold_every", [1, 3])
def test_folded_registry_is_that_of_all_changes(spark, tmp_path, fold_every):
    rng = random.Random(fold_every)
    plain, folded = Run(spark, tmp_path / "a"), Run(spark, tmp_path / "b", fold_every=fold_every)
    for k in range(5):
        rows = [report(rng.randint(1, 12), 20 * k + rng.random() * 20, 100 * k + i, rng.choice([5.0, 5.0, 10.0, 20.0])) for i in range(15)]
        plain.feed(rows)
        folded.feed(rows)
        assert folded.ships() == plain.ships() and plain.ships()
    left = [p.name for p in (tmp_path / "b" / "out").iterdir()]
    assert len([n for n in left if n.startswith("base=")]) <= 2
    assert len(list((tmp_path / "b" / "out" / "changes").glob("batch=*"))) < len(list((tmp_path / "a" / "out" / "changes").glob("batch=*")))


def test_passages_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(s, ["passenger", "fishing", "other"][s % 3], at(rng.random() * 3000), rng.random()) for s in range(9) for _ in range(60)]
    rows += [(50, "passenger", at(m), 1.0) for m in (0, 30, 60.0001, 90.00001)] + [(50, "passenger", None, 1.0)]
    df = spark.createDataFrame(rows, "ship long, class string, ts timestamp, d double")
    got = traffic.passages(df, ["ship", "class"], "ts", traffic.gap_of(F.col("class")), "d").collect()
    want = []
    for s in sorted({r[0] for r in rows}):
        mine = sorted((r[2], r[3], r[1]) for r in rows if r[0] == s and r[2])
        gap, part = dt.timedelta(seconds=traffic.GAPS.get(mine[0][2], traffic.OTHER_GAP)), []
        for m in mine:
            if part and m[0] - part[-1][0] > gap:
                want.append((s, part[0][0], part[-1][0], len(part), min(p[1] for p in part)))
                part = []
            part.append(m)
        want.append((s, part[0][0], part[-1][0], len(part), min(p[1] for p in part)))
    assert sorted((r.ship, r.started, r.ended, r.reports, r.nearest) for r in got) == sorted(want)


def test_counts_and_durations(spark):
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(14.9), 9.0), ("a", at(15), 2.0), ("b", at(50), 3.0)], "z string, ts timestamp, d double")
    got = {(r.z, (r.from_ts - T0).total_seconds() / 60): (r.reports, r.inside, r.nearest) for r in traffic.traffic_counts(df, ["z"], "ts", "d", 5.0, "30 minutes", "15 minutes").collect()}
    assert got == {("a", -15): (2, 1, 1.0), ("a", 0): (3, 2, 1.0), ("a", 15): (1, 1, 2.0), ("b", 30): (1, 1, 3.0), ("b", 45): (1, 1, 3.0)}
    assert (micros("30 minutes"), micros("1 hour"), micros("2 days")) == (1_800_000_000, 3_600_000_000, 172_800_000_000)
