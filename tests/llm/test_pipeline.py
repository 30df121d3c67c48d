"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from test_documents import SPACED, brute_targets, item_words, jaccard_groups  # noqa: E402

from soundkeel.llm import rules  # noqa: E402

SF = "/root/testdata/sf0.001"


def mixed(rows):
    """How often each id is in the mix."""
    size = {r.doc_id: len(SPACED.findall(r.text or "")) for r in rows}
    sums, by = Counter(), defaultdict(list)
    for r in rows:
        sums[r.source] += size[r.doc_id]
        key = hashlib.md5(f"{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}:42".encode()).hexdigest()
        by[r.source].append((key, r.doc_id))
    out = Counter()
    for s, goal in brute_targets(dict(sums)).items():
        epochs, rest = divmod(int(goal + 0.5), sums[s])
        for _, i in sorted(by[s]):
            part = max(0, min(rest, size[i]))
            out[i] += epochs + (part > 0 and 2 * part >= size[i])
            rest -= size[i]
    return +out


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(corpus_pipeline.stored(stage(spark, docs[-1], SF), "test-pipeline"))
    return docs, [d.collect() for d in docs]


def test_stages_keep_the_columns_of_documents(steps):
    docs, _ = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "simhash near-dedup", "benchmark decontamination", "mixing sources", "sharding"
    ]
    assert all(d.columns == docs[0].columns for d in docs[:-1]) and docs[-1].columns == [*docs[0].columns, "shard"]


def test_quality_and_near_duplicates(steps):
    docs, rows = steps
    kept = {r.doc_id for r in rules.judge(docs[0]).collect() if r.kept}
    assert {r.doc_id for r in rows[1]} == kept and len(rows[1]) == len(kept)
    # links are decided by the exact Jaccard index; bits may miss a small share of the candidates
    before = sorted(rows[1], key=lambda r: r.doc_id)
    group = dict(zip((r.doc_id for r in before), jaccard_groups([r.text for r in before])))
    stay = {r.doc_id for r in rows[2]}
    least = {before[g].doc_id for g in group.values()}
    assert least <= stay < set(group) and len(rows[2]) == len(stay), "no row without a copy goes"
    assert len(stay - least) <= 0.1 * (len(before) - len(least))


def test_decontamination(spark, steps):
    _, rows = steps
    windows = defaultdict(set)
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = item_words(item.text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[n].add(tuple(w[k : k + n]))

    def clean(text):
        w = item_words(text)
        return not any(tuple(w[k : k + n]) in seen for n, seen in windows.items() for k in range(len(w) - n + 1))

    assert sorted(r.doc_id for r in rows[3]) == sorted(r.doc_id for r in rows[2] if clean(r.text))


def test_mixture_and_shards(steps):
    _, rows = steps
    assert Counter(r.doc_id for r in rows[4]) == mixed(rows[3])
    assert sorted(r.doc_id for r in rows[5]) == sorted(r.doc_id for r in rows[4])
    sums = Counter()
    for r in rows[5]:
        sums[r.shard] += len(r.text.encode()) + 8
    longest = max(len(r.text.encode()) + 8 for r in rows[5])
    assert set(sums) <= set(range(24)) and max(sums.values()) - min(sums.get(i, 0) for i in range(24)) <= 3 * longest


def test_run_gives_the_last_stage(spark, steps):
    _, rows = steps
    got = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in rows[5])
