"""The named text queries against their SQL."""

from __future__ import annotations

import math

import pytest

from soundkeel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    mine = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    assert mine == theirs and mine
