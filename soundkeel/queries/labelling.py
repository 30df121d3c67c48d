"""Interval labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import labels as L
from ..operators import levels as LV
from .common import DAY0_US, DAY_US, LABELS_SQL, labels, levels, r, table

SPLIT = 15 * DAY_US
DT = 7200.0


def _seconds(spark, sf):
    ev = levels(spark, sf)
    return ev.select(
        "user_id", "event_id", ((F.col("t") - DAY0_US) / 1e6).alias("start_s"), (F.col("value") / 10).alias("duration_s")
    )


SECONDS_SQL = f"""lab AS (SELECT user_id, event_id, (epoch_us(ts) - {DAY0_US}) / 1e6::DOUBLE AS start_s, value / 10 AS duration_s FROM events)"""


def with_prior(spark, sf):
    out = L.with_prior(_seconds(spark, sf), ["user_id"], [F.col("start_s"), F.col("event_id")], "start_s", "duration_s")
    return out.select("event_id", r("prior_start").alias("prior_start"), r("prior_duration").alias("prior_duration"))


def background_intervals(spark, sf):
    out = L.background_intervals(
        _seconds(spark, sf), ["user_id"], [F.col("start_s"), F.col("event_id")], "start_s", "duration_s", DT
    )
    return out.select("user_id", r("start_s").alias("start_s"), "duration_s")


def _sides(spark, sf):
    lab = labels(spark, sf)
    return (
        lab.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("point_id"), F.col("start").alias("at")),
        lab.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("label_id"), "start", "end"),
    )


def label_at_points(spark, sf):
    points, lab = _sides(spark, sf)
    out = L.label_at(points, lab, ["user_id"], "at", "start", "end", bucket=3600 * 1_000_000)
    return out.select("point_id", "label_id", (F.col("at") - F.col("start")).alias("offset"))


def window_has_label(spark, sf):
    points, lab = _sides(spark, sf)
    out = L.presence(points, lab, ["user_id"], "at", "start", "end", width=1800 * 1_000_000)
    return out.select("point_id", "has_label")


KINDS = ("error", "purchase", "signup")


def class_at_points(spark, sf):
    """Multi-hot target of each click: which label classes cover it."""
    points, _ = _sides(spark, sf)
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")) - 1
    lab = labels(spark, sf).withColumn("label", kind.cast("int")).filter("label >= 0")
    out = L.presence(points, lab, ["user_id"], "at", "start", "end", classes=[0, 1, 2], label="label")
    hot = [F.col(f"has_{c}").cast("int") for c in range(3)]
    return out.select(
        "point_id", *[h.alias(f"y{c}") for c, h in enumerate(hot)], F.greatest(*hot).alias("y")
    )


def clip_split(spark, sf):
    out = L.clip_intervals(labels(spark, sf), "start", "end", 0, SPLIT)
    return out.select("event_id", "start", "end", "clip_start", "clip_end")


def coverage(spark, sf):
    lab = labels(spark, sf).withColumn("length", F.lit(31 * DAY_US))
    out = L.coverage(lab, ["user_id"], "start", "end", "length", SPLIT, 3600 * 1_000_000)
    return out.withColumns({c: r(c, 4) for c in ("train_pct", "test_pct")})


def merged_spans(spark, sf):
    return L.merged_spans(labels(spark, sf).select("user_id", "start", "end"), ["user_id"], "start", "end")


def usable_labels(spark, sf):
    lab = _seconds(spark, sf).filter("duration_s > 0")
    return L.usable(lab).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_labels"), r(F.sum("duration_s")).alias("span_s"))


def time_split_counts(spark, sf):
    train, test = L.time_split(labels(spark, sf), "start", SPLIT)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side", "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("files"))


def _lengths(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("length"))


def example_counts(spark, sf):
    return L.example_counts(_lengths(spark, sf), "l_suppkey", "length", 100)


def index_to_location(spark, sf):
    bases = L.example_counts(_lengths(spark, sf), "l_suppkey", "length", 100)
    wanted = table(spark, sf, "events").select("event_id")
    return L.locate(wanted, bases, "event_id", 100)


def annotation_track(spark, sf):
    points, lab = _sides(spark, sf)
    flagged = L.presence(points, lab, ["user_id"], "at", "start", "end")
    return L.annotation_track(flagged, "point_id", "has_label", 44100.0).select("point_id", r("mark").alias("mark"))


def _boxes(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("file"),
        F.col("l_partkey").alias("t_lo"),
        F.col("l_linenumber").alias("f_lo"),
        (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("t_hi"),
        (F.col("l_linenumber") + F.round(F.col("l_discount") * 100).cast("int")).alias("f_hi"),
        F.when(F.col("l_returnflag") == "R", "None").otherwise(F.concat_ws("_", F.lit("C"), "l_returnflag")).alias("code"),
    )


BOXES_SQL = """box AS (
  SELECT l_suppkey::VARCHAR AS file, l_partkey AS t_lo, l_linenumber AS f_lo, l_partkey + l_quantity::BIGINT AS t_hi,
         l_linenumber + round(l_discount * 100)::INT AS f_hi,
         CASE WHEN l_returnflag = 'R' THEN 'None' ELSE 'C_' || l_returnflag END AS code FROM lineitem)"""


def drop_uncoded(spark, sf):
    return L.drop_uncoded(_boxes(spark, sf))


def annotation_summary(spark, sf):
    kept = L.drop_uncoded(_boxes(spark, sf))
    calls = kept.filter(X.is_call_code(F.col("code"))).withColumn("contour", X.contour(F.col("code")))
    out = L.annotation_summary(calls, ["file", "contour"])
    return out.withColumns({c: r(c) for c in ("mean_width", "mean_band")})


def annotation_cube(spark, sf):
    out = L.annotation_cube(L.drop_uncoded(_boxes(spark, sf)))
    return out.withColumns({c: r(c) for c in ("mean_width", "mean_band")})


def label_classes(spark, sf):
    docs = table(spark, sf, "conversations")
    cls = X.label_class(F.col("text"))
    return docs.groupBy("role", cls.alias("label")).agg(F.count(F.lit(1)).alias("n"))


CLASS_SQL = """CASE WHEN contains(q, 'call') OR contains(q, 'cll') OR contains(q, 'cal') THEN 0
       WHEN contains(q, 'buzz') THEN 1 WHEN contains(q, 'whistle') THEN 2 END"""


def unknown_labels(spark, sf):
    return LV.unknown_labels(table(spark, sf, "documents"), "text")


def source_counts(spark, sf):
    """Files, labels and distinct recordings per source after uniting two sets."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    truth = table(spark, sf, "labels").select("doc_id", "quality")
    train = docs.join(truth, "doc_id").select("doc_id", "source", F.lit("train").alias("part"))
    dev = docs.join(truth, "doc_id", "left_anti").select("doc_id", "source", F.lit("dev").alias("part"))
    return train.unionByName(dev).groupBy("part", "source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("files")
    )


EMPTY_AS_FALSE = f"""WITH {LABELS_SQL},
p AS (SELECT user_id, event_id AS point_id, s AS at FROM lab WHERE event_type = 'click')"""

QUERIES = {
    "with_prior": (with_prior, f"""WITH {SECONDS_SQL}
SELECT event_id, round(lag(start_s) OVER w, 6) AS prior_start, round(lag(duration_s) OVER w, 6) AS prior_duration
FROM lab WINDOW w AS (PARTITION BY user_id ORDER BY start_s, event_id)"""),
    "background_intervals": (background_intervals, f"""WITH {SECONDS_SQL},
g AS (SELECT user_id, coalesce(lag(start_s) OVER w + lag(duration_s) OVER w + {DT}::DOUBLE, 0) AS lo, start_s - {DT}::DOUBLE AS hi
      FROM lab WINDOW w AS (PARTITION BY user_id ORDER BY start_s, event_id)),
n AS (SELECT *, trunc((hi - lo) / {DT / 2}::DOUBLE)::BIGINT AS n FROM g WHERE hi - lo > {0.75 * DT}::DOUBLE)
SELECT user_id, round(lo + {DT / 4}::DOUBLE + i * {DT / 2}::DOUBLE, 6) AS start_s, {DT}::DOUBLE AS duration_s
FROM (SELECT *, unnest(range(n)) AS i FROM n)"""),
    "label_at_points": (label_at_points, EMPTY_AS_FALSE + """
SELECT p.point_id, l.event_id AS label_id, p.at - l.s AS offset FROM p JOIN lab l
ON l.user_id = p.user_id AND l.event_type = 'view' AND l.s <= p.at AND p.at < l.e"""),
    "window_has_label": (window_has_label, EMPTY_AS_FALSE + """
SELECT p.point_id, EXISTS (SELECT 1 FROM lab l WHERE l.user_id = p.user_id AND l.event_type = 'view' AND l.e > l.s
  AND l.s < p.at + 1800000000 AND l.e > p.at) AS has_label FROM p"""),
    "class_at_points": (class_at_points, EMPTY_AS_FALSE + """,
h AS (SELECT p.point_id, max(CASE WHEN l.event_type = 'error' THEN 1 ELSE 0 END) AS y0,
        max(CASE WHEN l.event_type = 'purchase' THEN 1 ELSE 0 END) AS y1, max(CASE WHEN l.event_type = 'signup' THEN 1 ELSE 0 END) AS y2
      FROM p LEFT JOIN lab l ON l.user_id = p.user_id AND l.s <= p.at AND p.at < l.e GROUP BY p.point_id)
SELECT *, greatest(y0, y1, y2) AS y FROM h"""),
    "clip_split": (clip_split, f"""WITH {LABELS_SQL}
SELECT event_id, s AS start, e AS "end", greatest(s, 0) AS clip_start, least(e, {SPLIT}) AS clip_end FROM lab WHERE s < {SPLIT} AND e > 0"""),
    "coverage": (coverage, f"""WITH {LABELS_SQL},
c AS (SELECT user_id, count(*) FILTER (s < {SPLIT}) AS train_labels, count(*) FILTER (e > {SPLIT}) AS test_labels,
        sum(CASE WHEN s < {SPLIT} THEN least(e, {SPLIT}) - s ELSE 0 END)::BIGINT AS train_span,
        sum(CASE WHEN e > {SPLIT} THEN e - greatest(s, {SPLIT}) ELSE 0 END)::BIGINT AS test_span FROM lab GROUP BY user_id)
SELECT *, train_span // 3600000000 AS train_points, test_span // 3600000000 AS test_points,
       round(100.0::DOUBLE * train_span / {SPLIT}, 4) AS train_pct, round(100.0::DOUBLE * test_span / {31 * DAY_US - SPLIT}, 4) AS test_pct FROM c"""),
    "merged_spans": (merged_spans, f"""WITH {LABELS_SQL},
a AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lab),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS span FROM a)
SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS n_labels FROM b GROUP BY user_id, span"""),
    "usable_labels": (usable_labels, """SELECT user_id, count(*) AS n_labels, round(sum(value / 10), 6) AS span_s FROM events
WHERE value / 10 >= 0.1::DOUBLE GROUP BY user_id"""),
    "time_split_counts": (time_split_counts, f"""WITH {LABELS_SQL}
SELECT CASE WHEN s < {SPLIT} THEN 'train' ELSE 'test' END AS side, event_type, count(*) AS n, count(DISTINCT user_id) AS files
FROM lab GROUP BY 1, 2"""),
    "example_counts": (example_counts, """WITH f AS (SELECT l_suppkey, sum(l_quantity)::BIGINT // 100 AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, coalesce(sum(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM f"""),
    "index_to_location": (index_to_location, """WITH f AS (SELECT l_suppkey, sum(l_quantity)::BIGINT // 100 AS n FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey, n, coalesce(sum(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM f)
SELECT event_id, l_suppkey, (event_id - base) * 100 AS sample FROM events JOIN b ON event_id >= base AND event_id < base + n"""),
    "annotation_track": (annotation_track, EMPTY_AS_FALSE + """
SELECT point_id, round(CASE WHEN EXISTS (SELECT 1 FROM lab l WHERE l.user_id = p.user_id AND l.event_type = 'view' AND l.s <= p.at AND p.at < l.e)
  THEN 0.01::DOUBLE * sin(2 * pi() * 5000 * point_id / 44100.0::DOUBLE) ELSE 0 END, 6) + 0.0 AS mark FROM p"""),
    "drop_uncoded": (drop_uncoded, f"WITH {BOXES_SQL} SELECT DISTINCT * FROM box WHERE code <> 'None'"),
    "annotation_summary": (annotation_summary, f"""WITH {BOXES_SQL}, d AS (SELECT DISTINCT * FROM box WHERE code <> 'None')
SELECT file, substr(code, 3) AS contour, count(*) AS n, round(avg(t_hi - t_lo), 6) AS mean_width, round(avg(f_hi - f_lo), 6) AS mean_band
FROM d GROUP BY 1, 2"""),
    "annotation_cube": (annotation_cube, f"""WITH {BOXES_SQL}, d AS (SELECT DISTINCT * FROM box WHERE code <> 'None')
SELECT file, code, grouping(file, code) AS level, count(*) AS n, round(avg(t_hi - t_lo), 6) AS mean_width, round(avg(f_hi - f_lo), 6) AS mean_band
FROM d GROUP BY CUBE (file, code)"""),
    "label_classes": (label_classes, f"""WITH t AS (SELECT role, replace(trim(text), ' ', '') AS q FROM conversations)
SELECT role, {CLASS_SQL} AS label, count(*) AS n FROM t GROUP BY 1, 2"""),
    "unknown_labels": (unknown_labels, f"""WITH t AS (SELECT replace(trim(text), ' ', '') AS q FROM documents), c AS (SELECT {CLASS_SQL} AS label FROM t)
SELECT count(label) AS n_labels, count(*) FILTER (label IS NULL) AS n_skipped FROM c"""),
    "source_counts": (source_counts, """SELECT CASE WHEN l.doc_id IS NULL THEN 'dev' ELSE 'train' END AS part, source, count(*) AS n,
count(DISTINCT d.doc_id) AS files FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2"""),
}
