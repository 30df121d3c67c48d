"""Every named query against its SQL, on whole tables."""

from __future__ import annotations

import math

import pytest

from conftest import SF
from soundkeel.queries import registry

REGISTRY = registry()

# Queries whose rows are cut into chunks or joined with statistics per key.
ORDERED = (
    "bout_report", "segment_calls", "merge_segments", "merge_turns", "with_prior", "background_intervals", "label_at_points",
    "window_has_label", "class_at_points", "merged_spans", "example_counts", "index_to_location", "declick", "pr_curve",
    "average_precision", "training_windows", "segment_classify", "nb_predict", "zmask", "stft_db", "peak_norm", "stereo_pick",
)


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else f + 0.0
    return v


def compare(spark, duck, name):
    query, sql = REGISTRY[name]
    df = query(spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert mine == theirs
    assert mine, "no rows compared"


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_matches_sql(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", ORDERED)
def test_matches_sql_with_hot_keys(spark, duck, small_groups, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql])
def test_runs_without_sql(spark, name):
    df = REGISTRY[name][0](spark, SF)
    assert df.columns
    df.collect()
