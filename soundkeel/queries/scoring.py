"""Score combination and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import l2_normalise
from ..operators import bouts as B
from ..operators import knn as N
from ..operators import scores as S
from .common import HOPS_SQL, SCORES_SQL, VECTORS_PER_FILE, draw_sql, hops, r, scores, table

BLOCK = 4
# Bound of the labelled rows that the neighbour classifier is fitted on.
TRAIN_ROWS = 2048
WEIGHTS = [(i - 31.5) / 8 for i in range(64)]


def pr_curve(spark, sf):
    return S.pr_curve(scores(spark, sf)).select(*[r(c, 9).alias(c) for c in ("threshold", "precision", "recall")])


def average_precision(spark, sf):
    return S.average_precision(scores(spark, sf)).select(r("average_precision", 9).alias("average_precision"))


def prf(spark, sf):
    return S.prf(scores(spark, sf), 0.35).withColumns({c: r(c, 9) for c in ("precision", "recall", "f1")})


def predict_at(spark, sf):
    return S.predict_at(scores(spark, sf), 0.5).groupBy("y", "yes").agg(F.count(F.lit(1)).alias("n"))


def log_loss(spark, sf):
    return S.log_loss(scores(spark, sf)).select(r("log_loss").alias("log_loss"))


def nb_train(spark, sf):
    out = S.nb_train(hops(spark, sf, BLOCK), BLOCK)
    return out.select("offset", "is_pos", "bin", r("p", 9).alias("p"))


def nb_train_shared(spark, sf):
    out = S.nb_train(hops(spark, sf, BLOCK), BLOCK, shared=True)
    return out.select("offset", "is_pos", "bin", r("p", 9).alias("p"))


def nb_prior(spark, sf):
    return S.nb_prior(hops(spark, sf, BLOCK)).select(r("prior", 9).alias("prior"))


def _blocks(spark, sf):
    h = hops(spark, sf, BLOCK)
    return h, S.nb_predict(h, S.nb_train(h, BLOCK), BLOCK, 0.2)


def nb_predict(spark, sf):
    _, out = _blocks(spark, sf)
    return out.select("block", r("log_pos").alias("log_pos"), r("log_neg").alias("log_neg"), "yes")


def block_predict(spark, sf):
    h, blocks = _blocks(spark, sf)
    return S.block_predict(h, blocks, BLOCK).select("hop", "yes")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label"
    )


def linear_score(spark, sf):
    return S.linear_score(_vectors(spark, sf), "x", WEIGHTS, 0.1).select("id", r("yhat").alias("yhat"))


def fit_linear(spark, sf):
    """Fitted scorer of one class against the rest, and its probabilities."""
    v = _vectors(spark, sf).withColumn("y", (F.col("label") == 3).cast("int"))
    v = v.withColumn("x", l2_normalise(F.col("x")))
    model = S.fit_linear(v, "x", "y")
    return S.score_windows(model, v, "x").select("id", "y", r("yhat").alias("yhat"))


def fit_linear_weights(spark, sf):
    """Weights of a scorer of two features, against Newton's method."""
    halves = [F.aggregate(F.slice("x", a, 32), F.lit(0.0), lambda s, v: s + v) for a in (1, 33)]
    v = _vectors(spark, sf).select(F.array(*halves).alias("x"), (F.col("label") % 3 == 0).cast("int").alias("y"))
    model = S.fit_linear(v, "x", "y", max_iter=100)
    weights = [("bias", model.intercept), *zip(("first", "second"), model.coefficients.tolist())]
    n = v.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(w)).alias("w")) for k, w in weights])).alias("f"), "n", "positive").select(
        "f.name", r("f.w", 4).alias("weight"), "n", "positive"
    )


def _classified(spark, sf):
    """Every vector against labelled vectors other than itself."""
    v = _vectors(spark, sf)
    return N.knn_classify(v, v.select("id", "x"), 3, train_rows=TRAIN_ROWS, others=True)


def knn_classify(spark, sf):
    return _classified(spark, sf).select("query_id", "label", r("nearest").alias("nearest"))


def segment_classify(spark, sf):
    """Windows of each recording classified, equal neighbours merged."""
    def place(df, key):
        return df.withColumns({"file": F.floor(F.col(key) / VECTORS_PER_FILE), "win": F.col(key) % VECTORS_PER_FILE})

    rows = place(_classified(spark, sf), "query_id").select("file", "win", "label")
    return B.merge_segments(rows, ["file"], [F.col("win")], "label", F.col("win"))


_TRAIN = f"""{HOPS_SQL.format(n=BLOCK)},
cnt AS (SELECT i AS "offset", w.truth AS is_pos, s.bin, count(*) AS n FROM hop w, range(0, {BLOCK + 1}) t(i), hop s
  WHERE w.truth IS NOT NULL AND s.hop = w.hop + i GROUP BY 1, 2, 3),
grid AS (SELECT i AS "offset", p AS is_pos, b AS bin FROM range(0, {BLOCK + 1}) x(i), (VALUES (true), (false)) y(p), range(1, 51) z(b))"""
_MODEL = _TRAIN + """,
sm AS (SELECT "offset", is_pos, bin, coalesce(n, 0) + 1e-6::DOUBLE AS c FROM grid LEFT JOIN cnt USING ("offset", is_pos, bin)),
model AS (SELECT "offset", is_pos, bin, c / sum(c) OVER (PARTITION BY "offset", is_pos) AS p FROM sm)"""
_PREDICT = _MODEL + f""",
sums AS (SELECT hop // {BLOCK} AS block, ln(0.2::DOUBLE) + sum(ln(a.p)) AS log_pos, ln(0.8::DOUBLE) + sum(ln(b.p)) AS log_neg
  FROM hop JOIN model a ON a."offset" = hop % {BLOCK} AND a.bin = hop.bin AND a.is_pos
  JOIN model b ON b."offset" = hop % {BLOCK} AND b.bin = hop.bin AND NOT b.is_pos GROUP BY 1),
pred AS (SELECT block, log_pos, log_neg, (log_pos > log_neg)::INT AS yes FROM sums WHERE block * {BLOCK} < (SELECT count(*) FROM events) - {BLOCK})"""
_KNN = f"""tr AS (SELECT vec_id, embedding, label FROM embeddings
  ORDER BY {draw_sql("vec_id", 17)}, vec_id LIMIT {TRAIN_ROWS}),
d AS (SELECT e.vec_id, t.vec_id AS pid, t.label,
             list_distance(e.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS d
      FROM embeddings e, tr t WHERE e.vec_id <> t.vec_id),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, pid) <= 3),
g AS (SELECT vec_id, label, count(*) AS c, min(d) AS d FROM n GROUP BY 1, 2),
knn AS (SELECT g.vec_id, label, min(d) OVER (PARTITION BY g.vec_id) AS nearest FROM g
  QUALIFY row_number() OVER (PARTITION BY g.vec_id ORDER BY c DESC, d) = 1)"""
# ``nearest`` is the distance of the nearest neighbour, whatever its label.
_KNN = _KNN.replace(
    "knn AS (SELECT g.vec_id, label, min(d) OVER (PARTITION BY g.vec_id) AS nearest FROM g",
    "knn AS (SELECT g.vec_id, label, (SELECT min(d) FROM n WHERE n.vec_id = g.vec_id) AS nearest FROM g",
)
_CURVE = f"""WITH {SCORES_SQL},
c AS (SELECT yhat, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1),
t AS (SELECT yhat, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS p FROM c WINDOW w AS (ORDER BY yhat DESC ROWS UNBOUNDED PRECEDING))"""

QUERIES = {
    "pr_curve": (pr_curve, _CURVE + "\nSELECT round(yhat, 9) AS threshold, round(tp / seen, 9) AS \"precision\", round(tp / p, 9) AS recall FROM t"),
    "average_precision": (average_precision, _CURVE + "\nSELECT round(sum(pos * tp / seen) / sum(pos), 9) AS average_precision FROM t"),
    "prf": (prf, f"""WITH {SCORES_SQL}, c AS (SELECT count(*) FILTER (yhat > 0.35 AND y = 1) AS tp, count(*) FILTER (yhat > 0.35 AND y <> 1) AS fp,
  count(*) FILTER (yhat <= 0.35 AND y = 1) AS fn FROM sc)
SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c"""),
    "predict_at": (predict_at, f"WITH {SCORES_SQL} SELECT y, (yhat > 0.5)::INT AS yes, count(*) AS n FROM sc GROUP BY 1, 2"),
    "log_loss": (log_loss, f"""WITH {SCORES_SQL} SELECT round(avg(-(y * greatest(ln(yhat), -100) + (1 - y) * greatest(ln(1 - yhat), -100))), 6) AS log_loss FROM sc"""),
    "nb_train": (nb_train, f"""WITH {_MODEL} SELECT "offset", is_pos, bin, round(p, 9) AS p FROM model"""),
    "nb_train_shared": (nb_train_shared, f"""WITH {_TRAIN},
s AS (SELECT is_pos, bin, sum(n) AS n FROM cnt GROUP BY 1, 2),
sm AS (SELECT "offset", is_pos, bin, coalesce(n, 0) + 1e-6::DOUBLE AS c FROM grid LEFT JOIN s USING (is_pos, bin))
SELECT "offset", is_pos, bin, round(c / sum(c) OVER (PARTITION BY "offset", is_pos), 9) AS p FROM sm"""),
    "nb_prior": (nb_prior, f"WITH {HOPS_SQL.format(n=BLOCK)} SELECT round(avg(truth::INT), 9) AS prior FROM hop WHERE truth IS NOT NULL"),
    "nb_predict": (nb_predict, f"WITH {_PREDICT} SELECT block, round(log_pos, 6) AS log_pos, round(log_neg, 6) AS log_neg, yes FROM pred"),
    "block_predict": (block_predict, f"""WITH {_PREDICT} SELECT hop, coalesce(yes, 0) AS yes FROM hop LEFT JOIN pred ON block = hop // {BLOCK}"""),
    "linear_score": (linear_score, """SELECT vec_id AS id, round(1 / (1 + exp(-(0.1::DOUBLE + sum(embedding[i]::DOUBLE * (i - 32.5::DOUBLE) / 8)))), 6) AS yhat
FROM embeddings, range(1, 65) t(i) GROUP BY 1"""),
    "fit_linear": (fit_linear, None),
    "fit_linear_weights": (fit_linear_weights, """WITH RECURSIVE d AS (SELECT list_sum(embedding[1:32]::DOUBLE[]) AS a, list_sum(embedding[33:64]::DOUBLE[]) AS b, (label % 3 = 0)::INT AS y FROM embeddings),
v AS (SELECT count(*) AS n, sum(y) AS positive, 0.01::DOUBLE * var_samp(a) AS ra, 0.01::DOUBLE * var_samp(b) AS rb FROM d),
it AS (SELECT 0 AS i, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 UNION ALL
  SELECT i + 1, w0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
    w1 - (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
    w2 - (h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
    FROM (SELECT i, w0, w1, w2, avg(p - y) AS g0, avg((p - y) * a) + max(ra) * w1 AS g1, avg((p - y) * b) + max(rb) * w2 AS g2,
        avg(p * (1 - p)) AS h00, avg(p * (1 - p) * a) AS h01, avg(p * (1 - p) * b) AS h02,
        avg(p * (1 - p) * a * a) + max(ra) AS h11, avg(p * (1 - p) * a * b) AS h12, avg(p * (1 - p) * b * b) + max(rb) AS h22
      FROM (SELECT it.*, d.*, ra, rb, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS p FROM it, d, v WHERE i < 12) GROUP BY i, w0, w1, w2)))
SELECT name, round(CASE name WHEN 'bias' THEN w0 WHEN 'first' THEN w1 ELSE w2 END, 4) AS weight, n, positive
FROM it, v, (VALUES ('bias'), ('first'), ('second')) t(name) WHERE i = 12"""),
    "knn_classify": (knn_classify, f"WITH {_KNN} SELECT vec_id AS query_id, label, round(nearest, 6) AS nearest FROM knn"),
    "segment_classify": (segment_classify, f"""WITH {_KNN},
a AS (SELECT vec_id // 256 AS file, vec_id % 256 AS win, label FROM knn),
b AS (SELECT *, lag(label) OVER (PARTITION BY file ORDER BY win) AS pl FROM a),
c AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> label THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY win ROWS UNBOUNDED PRECEDING) AS seg FROM b)
SELECT file, label, min(win) AS start, max(win) AS stop, count(*) AS n FROM c GROUP BY file, label, seg"""),
}
