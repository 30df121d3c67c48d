"""Archives and URL filters against brute force."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from soundkeel.llm import urls, warc

SCHEMA = "page_id long, url string, html string, payload string, size long, number long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1, 2) for i, u, h in rows], SCHEMA)


ROWS = [
    (3, "http://a.org/x", "<p>same</p>"), (1, "http://b.org/y", "<p>same</p>"), (2, None, "<p>same</p>"), (4, "http://c/\r\nX: 1", None),
    (5, "x", ""), (6, "é", "é😀" * 100_000), (7, "u", "WARC/1.1\r\n\r\n\x1f"), (8, "u", "once"), (None, "n", "<p>same</p>"), (None, "n", "null id"),
]


def test_warc_round_trip(spark):
    got = warc.round_trip(pages(spark, ROWS), range_bytes=200).collect()
    raw = [(i, (h or "").encode()) for i, _, h in ROWS]
    want = []
    for i, p in raw:
        first = min(j for j, x in raw if x == p and j is not None) if any(x == p and j is not None for j, x in raw) else None
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        want.append((i, len(p), digest, "response" if i == first else "revisit", None if i == first else first))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    assert all(r.intact for r in got)


def test_repeated_rows_have_one_response(spark):
    got = warc.round_trip(pages(spark, [(1, "u", "x")] * 4 + [(1, "a", "x")])).collect()
    assert Counter(r.record_type for r in got) == {"response": 1, "revisit": 4}
    assert [r.uri for r in got if r.record_type == "response"] == ["a"]


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 10**9])
def test_ranges_own_each_record_once(tmp_path, step):
    made = [warc.encode_record(i, f"http://h/{i}", bytes([i]) * (i * 50), None, False) for i in range(12)]
    made[5] = made[5][:-20]  # damaged
    made.insert(3, b"\x1f\x8b\x08garbage" + b"\x1f\x8b")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(made))
    size = path.stat().st_size
    starts = range(0, size, step) if step > 1 else [*range(0, 400), 400]
    got = []
    for s in starts:
        e = size if step == 1 and s == 400 else min(s + step, size)
        got += [r["fields"]["warc-record-id"] for r in warc.records(str(path), s, e, size)]
    assert got == [f"<urn:page:{i}>" for i in range(12) if i != 5]


def test_listing_reads_foreign_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.warc.gz").write_bytes(warc.encode_record(1, "http://h/", b"body", None, False))
    (tmp_path / "other.txt").write_text("no")
    got = warc.read(warc.list_archives(spark, str(tmp_path)), payload=True).collect()
    assert [(r.uri, bytes(r.payload), r.payload_bytes) for r in got] == [("http://h/", b"body", 4)]


def test_empty_pages(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    none = spark.createDataFrame([], "id long, bad int")
    assert urls.judge(pages(spark, []), none).count() == 0


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.ORG", "http://example.org/es/1", "http://sub.Example.org/es/?q", "http://example.org/en/14500.html",
    "http://notexample.org/es/", "http://x.com/fr/1#t", "http://x.com/de/2", "http://x.net/a?b://c", "ftp://user@h.net:80/p/q#f", "http://org/", "a://b://c/d",
    "http://É.com/de/É", "http://x.net/" + "a/" * 5000, "http://x.net//double//slash/", "http://com/fr/",
]


def brute(u):
    if not u or "://" not in u:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://x.com/de/", None)] + [(0, None, None)]
    got = urls.judge(pages(spark, rows), spark.createDataFrame([], "id long, bad int")).collect()
    want = []
    for i, u, _ in rows:
        host, path = brute(u)
        fits = []
        for rule, verdict in urls.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, verdict))
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        want.append((i, host, path, rule, verdict))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))


def test_templates_of_bad_labels_are_rejected(spark):
    rows, marks = [], []
    for i in range(400):
        kind = ("news", "spam")[i % 4 == 0]
        rows.append((i, f"http://h.net/{kind}/{i}/view-{i}", "x"))
        if i % 2 == 0:
            marks.append((i, int(kind == "spam")))
    rows += [(1000 + i, f"http://h.net/news/{chr(97 + i % 26)}{chr(97 + i // 26)}/page", "x") for i in range(100)]
    marks += [(0, None), (None, 1), (2, 0), (2, 0)]
    got = urls.judge(pages(spark, rows), spark.createDataFrame(marks, "id long, bad int")).collect()
    by = {r.page_id: r for r in got}
    assert all(by[i].verdict == ("block" if i % 4 == 0 else "allow") for i in range(400))
    assert by[0].template.startswith("spam/") and len({by[1000 + i].template for i in range(100)}) == 1


def test_long_headers_are_records(spark):
    rng = random.Random(5)
    url = "http://h/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_") for _ in range(500_000))
    got = warc.round_trip(pages(spark, [(1, url, "long"), (2, "http://h/", "short")]), range_bytes=200).collect()
    assert sorted((r.page_id, r.uri, r.intact) for r in got) == [(1, url, True), (2, "http://h/", True)]


def plain_templates(forms: dict) -> dict:
    """{(host, form): template} from {(host, form): (n, labelled, bad)}, a level at a time."""
    names = {key: [] for key in forms}
    for level in range(max((len(f.split("/")) for _, f in forms), default=0)):
        families = defaultdict(lambda: defaultdict(list))
        for (host, form), above in names.items():
            parts = form.split("/")
            if level < len(parts):
                families[host, tuple(above)][parts[level]].append((host, form))
        for children in families.values():
            def total(keys, i):
                return sum(forms[k][i] for k in keys)

            every = [k for keys in children.values() for k in keys]
            n, labelled, bad = (total(every, i) for i in range(3))
            rate = bad / labelled if labelled else 0.0
            branches = defaultdict(list)
            for seg, keys in children.items():
                branches["*" if len(children) > urls.CHILDREN and total(keys, 0) < n * urls.RARE else seg] += keys
            for name, keys in branches.items():
                expected = total(keys, 1) * rate
                alike = abs(total(keys, 2) - expected) <= math.sqrt(expected * (1 - rate)) * urls.ALIKE + 0.5
                for k in keys:
                    names[k].append("*" if alike else name)
    return {k: "/".join(v) for k, v in names.items()}


@pytest.mark.parametrize("seed", range(3))
def test_tree_by_plain_loops(spark, seed):
    rng = random.Random(seed)
    forms = {}
    for host in ("a", "b"):
        for _ in range(150):
            form = "/".join(rng.choice([["x", "y", "z"], [f"u{rng.randint(0, 60)}"], ["spam", "blog"]][min(d, 2)]) for d in range(rng.randint(1, 4)))
            n = rng.randint(1, 9)
            labelled = rng.randint(0, n)
            forms[host, form] = (n, labelled, labelled if "spam" in form else rng.randint(0, labelled) // 3)
    forms["c", ""] = (3, 1, 1)
    df = spark.createDataFrame([(*k, *v) for k, v in forms.items()], "host string, form string, n long, labelled long, bad long")
    got = {(r.host, r.form): r.template for r in urls.templates(df).collect()}
    assert got == plain_templates(forms) and len(set(got.values())) < len(got)


@pytest.mark.parametrize("spam,blog", [(3, 7), (2, 2)])
def test_branches_below_a_wildcard_are_one_tree(spark, spam, blog):
    """Users with few pages each: what tells good from bad is the segment below."""
    kinds = [("spam", i) for i in range(spam)] + [("blog", i) for i in range(blog)]
    names = ["".join(p) for p in itertools.product("abcdefghij", repeat=2)]
    rows = [(k, f"http://h.net/{name}/{kind}/page", "x") for k, (name, (kind, _)) in enumerate(itertools.product(names, kinds))]
    marks = [(k, int("/spam/" in url)) for k, url, _ in rows]
    got = urls.judge(pages(spark, rows), spark.createDataFrame(marks, "id long, bad int")).collect()
    assert Counter((r.template, r.verdict) for r in got) == {("*/spam/*", "block"): 100 * spam, ("*/blog/*", "allow"): 100 * blog}


def test_depth_is_a_parameter(spark):
    rows = [(i, "http://h.net/a/b/" + ("good" if i % 2 else "bad"), "x") for i in range(100)]
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in range(100)], "id long, bad int")
    assert Counter(r.verdict for r in urls.judge(pages(spark, rows), marks).collect()) == {"allow": 50, "block": 50}
    assert len({r.template for r in urls.judge(pages(spark, rows), marks, max_depth=2).collect()}) == 1
