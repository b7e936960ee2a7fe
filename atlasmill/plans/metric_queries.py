"""Neighbour, quality-metric and statistics queries.

The first two embedding coordinates stand for a 2-D projection, so that every
metric has a plain SQL form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, linalg, metrics
from ..operators.neighbors import distance_ranks, knn
from . import benchmark
from .registry import query, r6, table

K = 15

BASE = """
  WITH p AS (SELECT vec_id AS id, label, embedding::double[] AS v, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings),
"""
LOW = """lo AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj,
     row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rl
     FROM p a JOIN p b ON a.id <> b.id),
"""
HIGH = """hi AS (SELECT a.id AS i, b.id AS j, rank() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v)) AS rh,
     row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rn
     FROM p a JOIN p b ON a.id <> b.id),
"""


def _points(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("identifier"), "label", F.col("embedding").cast("array<double>").alias("vec"),
        F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"),
    ).withColumn("low", F.array("x", "y"))


# ------------------------------------------------------------------ neighbours


@query("knn_topk", BASE + HIGH + """q AS (SELECT 1)
  SELECT hi.i, hi.j, rn AS rank, round(list_distance(a.v, b.v), 6) AS distance
  FROM hi JOIN p a ON a.id = hi.i JOIN p b ON b.id = hi.j WHERE rn <= 15""")
def knn_topk(spark, d):
    return knn(_points(spark, d), K).select("i", "j", F.col("rank").cast("bigint").alias("rank"), r6("distance").alias("distance"))


@query("knn_cosine", """
  WITH p AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings),
  h AS (SELECT a.id AS i, b.id AS j, list_cosine_distance(a.v, b.v) AS dd,
        row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_distance(a.v, b.v), b.id) AS rn FROM p a JOIN p b ON a.id <> b.id)
  SELECT i, j, rn AS rank, round(dd, 6) AS distance FROM h WHERE rn <= 5""")
def knn_cosine(spark, d):
    near = knn(_points(spark, d), 5, metric="cosine")
    return near.select("i", "j", F.col("rank").cast("bigint").alias("rank"), r6("distance").alias("distance"))


@query("knn_manhattan", """
  WITH p AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings),
  h AS (SELECT a.id AS i, b.id AS j, list_sum([abs(u[1] - u[2]) FOR u IN list_zip(a.v, b.v)]) AS dd FROM p a JOIN p b ON a.id <> b.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dd, j) AS rn FROM h)
  SELECT i, j, rn AS rank, round(dd, 6) AS distance FROM r WHERE rn <= 5""")
def knn_manhattan(spark, d):
    near = knn(_points(spark, d), 5, metric="manhattan")
    return near.select("i", "j", F.col("rank").cast("bigint").alias("rank"), r6("distance").alias("distance"))


@query("pair_ranks", BASE + LOW + HIGH + """q AS (SELECT 1)
  SELECT lo.i, lo.j, lo.rl AS rank_lo, hi.rh AS rank_hi FROM lo JOIN hi USING (i, j) WHERE lo.rl <= 10""")
def pair_ranks(spark, d):
    ranked = metrics.neighborhoods(_points(spark, d), 10)
    return ranked.select("i", "j", F.col("rank_lo").cast("bigint").alias("rank_lo"), "rank_hi")


TRUST = """n AS (SELECT count(*)::double AS n FROM p), ks AS (SELECT unnest([{ks}]) AS k)
  SELECT k, round(1 - 2.0 / (max(n) * k * (2 * max(n) - 3 * k - 1)) * sum(CASE WHEN rl <= k AND rh > k THEN rh - k ELSE 0 END), 6) AS trustworthiness
  FROM lo JOIN hi USING (i, j), n, ks GROUP BY k"""


@query("trustworthiness", BASE + LOW + HIGH + TRUST.format(ks="15"))
def trustworthiness(spark, d):
    pts = _points(spark, d)
    n = pts.count()
    k = metrics.trust_neighbors(n, K)
    out = metrics.trustworthiness(metrics.neighborhoods(pts, k), n, [k])
    return out.select("k", r6("trustworthiness").alias("trustworthiness"))


@query("trustworthiness_multi_k", BASE + LOW + HIGH + TRUST.format(ks="1, 5, 15, 30, 50"))
def trustworthiness_multi_k(spark, d):
    pts = _points(spark, d)
    n = pts.count()
    ks = sorted({min(k, n - 2) for k in (1, 5, 15, 30, 50)})
    out = metrics.trustworthiness(metrics.neighborhoods(pts, max(ks)), n, ks)
    return out.select("k", r6("trustworthiness").alias("trustworthiness"))


PRESERVED = """s AS (SELECT p.id AS identifier, count(hi.j) / 15.0 AS score FROM p LEFT JOIN lo ON lo.i = p.id AND lo.rl <= 15
     LEFT JOIN hi ON hi.i = p.id AND hi.j = lo.j AND hi.rn <= 15 GROUP BY 1)
"""


def _preserved(spark, d) -> DataFrame:
    pts = _points(spark, d)
    return metrics.preservation(knn(pts, K), knn(pts, K, vec_col="low"), pts, K)


@query("preservation", BASE + LOW + HIGH + PRESERVED + "SELECT identifier, round(score, 6) AS preservation FROM s")
def preservation(spark, d):
    return _preserved(spark, d).select("identifier", r6("preservation").alias("preservation"))


@query("outliers_p10", BASE + LOW + HIGH + PRESERVED + """
  SELECT identifier, round(score, 6) AS preservation FROM s WHERE score <= (SELECT quantile_cont(score, 0.1) FROM s)""")
def outliers_p10(spark, d):
    return metrics.outliers(_preserved(spark, d), "preservation").select("identifier", r6("preservation").alias("preservation"))


@query("group_share_outliers", BASE + LOW + HIGH + PRESERVED + """,
  o AS (SELECT label, count(*) AS n_outliers FROM s JOIN p ON p.id = identifier WHERE score <= (SELECT quantile_cont(score, 0.1) FROM s) GROUP BY 1),
  a AS (SELECT label, count(*) AS n FROM p GROUP BY 1)
  SELECT a.label, n, round(n / (SELECT sum(n) FROM a), 6) AS share, coalesce(n_outliers, 0) AS n_outliers,
         round(coalesce(n_outliers, 0) / (SELECT sum(n_outliers) FROM o), 6) AS outlier_share
  FROM a LEFT JOIN o ON o.label = a.label""")
def group_share_outliers(spark, d):
    labels = _points(spark, d).select("identifier", "label")
    out = metrics.outliers(_preserved(spark, d), "preservation").join(labels, "identifier")
    share = metrics.group_shares(out, "label").select("label", F.col("n").alias("n_outliers"), F.col("share").alias("outlier_share"))
    both = metrics.group_shares(labels, "label").join(share, "label", "left").na.fill(0, ["n_outliers", "outlier_share"])
    return both.select("label", "n", r6("share").alias("share"), "n_outliers", r6("outlier_share").alias("outlier_share"))


# ------------------------------------------------------------------ label metrics

SCALED = """
  WITH r AS (SELECT vec_id AS id, label, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings),
  p AS (SELECT id, label, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM r),
"""


@query("knn_purity", SCALED + LOW + "q AS (SELECT 1) SELECT round(avg(CASE WHEN li = lj THEN 1.0 ELSE 0.0 END), 6) AS purity FROM lo WHERE rl <= 10")
def knn_purity(spark, d):
    pts = metrics.with_low_vec(metrics.standard_scaled(_points(spark, d), ["x", "y"]))
    near = metrics.labelled_neighbors(knn(pts, 10, vec_col="low"), pts)
    return metrics.knn_purity(near).select(r6("purity").alias("purity"))


VOTES = BASE + LOW + """v AS (SELECT i, li, lj, count(*) AS votes FROM lo WHERE rl <= 15 GROUP BY 1, 2, 3),
  w AS (SELECT i, li, lj, row_number() OVER (PARTITION BY i ORDER BY votes DESC, lj) AS place FROM v)
"""


@query("loo_knn_votes", VOTES + "SELECT i, li, lj AS predicted FROM w WHERE place = 1")
def loo_knn_votes(spark, d):
    pts = _points(spark, d)
    return metrics.loo_votes(metrics.labelled_neighbors(knn(pts, K, vec_col="low"), pts))


@query("loo_knn_accuracy", VOTES + "SELECT round(avg(CASE WHEN li = lj THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM w WHERE place = 1")
def loo_knn_accuracy(spark, d):
    pts = _points(spark, d)
    return metrics.loo_accuracy(metrics.labelled_neighbors(knn(pts, K, vec_col="low"), pts)).select(r6("accuracy").alias("accuracy"))


@query("silhouette", BASE + """m AS (SELECT a.id AS i, a.label AS li, b.label AS lj, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d
     FROM p a JOIN p b ON a.id <> b.id GROUP BY 1, 2, 3),
  s AS (SELECT i, max(CASE WHEN li = lj THEN d END) AS a, min(CASE WHEN li <> lj THEN d END) AS b FROM m GROUP BY 1)
  SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def silhouette(spark, d):
    return metrics.silhouette(_points(spark, d)).select(r6("silhouette").alias("silhouette"))


@query("macro_f1_votes", VOTES + """, c AS (SELECT li AS t, lj AS g FROM w WHERE place = 1),
  k AS (SELECT DISTINCT t AS c FROM c UNION SELECT DISTINCT g FROM c),
  f AS (SELECT k.c, 2.0 * count(*) FILTER (WHERE t = k.c AND g = k.c) / (count(*) FILTER (WHERE t = k.c) + count(*) FILTER (WHERE g = k.c)) AS f1 FROM k, c GROUP BY 1)
  SELECT round(avg(f1), 6) AS macro_f1 FROM f""")
def macro_f1_votes(spark, d):
    pts = _points(spark, d)
    votes = metrics.loo_votes(metrics.labelled_neighbors(knn(pts, K, vec_col="low"), pts))
    return metrics.macro_f1_from_pairs(votes, "li", "predicted").select(r6("macro_f1").alias("macro_f1"))


@query("macro_f1")
def macro_f1(spark, d):
    return metrics.macro_f1(_points(spark, d)).select(r6("macro_f1").alias("macro_f1"))


R2 = """m AS (SELECT {by} var_samp(x) AS sxx, var_samp(y) AS syy, var_samp(t) AS stt, covar_samp(x, y) AS sxy, covar_samp(x, t) AS sxt, covar_samp(y, t) AS syt FROM j {group})
  SELECT {by} round((syy * sxt * sxt - 2 * sxy * sxt * syt + sxx * syt * syt) / ((sxx * syy - sxy * sxy) * stt), 6) AS r2 FROM m"""


@query("length_r2", BASE + "j AS (SELECT p.*, n_chars::double AS t FROM p JOIN documents ON doc_id = id), " + R2.format(by="", group=""))
def length_r2(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("identifier"), F.col("n_chars").cast("double").alias("t"))
    joined = _points(spark, d).join(docs, "identifier").dropna(subset=["x", "y", "t"])
    return metrics.two_predictor_r2(joined, "t").select(r6("r2").alias("r2"))


@query("length_r2_by_label", BASE + "j AS (SELECT p.*, n_chars::double AS t FROM p JOIN documents ON doc_id = id), " + R2.format(by="label,", group="GROUP BY label"))
def length_r2_by_label(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("identifier"), F.col("n_chars").cast("double").alias("t"))
    joined = _points(spark, d).join(docs, "identifier")
    return metrics.two_predictor_r2(joined, "t", by=["label"]).select("label", r6("r2").alias("r2"))


@query("normalize_projection", """
  WITH p AS (SELECT vec_id AS identifier, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings),
  s AS (SELECT avg(x) AS mx, avg(y) AS my, sqrt((var_pop(x) + var_pop(y)) / 2) AS sd, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS t FROM p)
  SELECT identifier, round((x - mx) / sd * cos(t) + (y - my) / sd * sin(t), 6) + 0.0 AS nx,
         round(-(x - mx) / sd * sin(t) + (y - my) / sd * cos(t), 6) + 0.0 AS ny FROM p, s""")
def normalize_projection(spark, d):
    out = linalg.normalize_projection(_points(spark, d).select("identifier", "x", "y"))
    return out.select("identifier", r6("nx").alias("nx"), r6("ny").alias("ny"))


# ------------------------------------------------------------------ resampling

TICKETS = """
  WITH p AS (SELECT vec_id AS id, label, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings),
  t AS (SELECT p.*, r.round, row_number() OVER (PARTITION BY r.round ORDER BY md5(concat(cast(id AS varchar), '#', cast(r.round AS varchar))), id) AS rn
        FROM p, (SELECT unnest(range(0, {rounds})) AS round) r),
  b AS (SELECT * FROM t WHERE rn <= (SELECT cast(floor(count(*) * 0.8) AS bigint) FROM p))
"""


@query("bootstrap_samples", TICKETS.format(rounds=100) + "SELECT round, id AS identifier FROM b")
def bootstrap_samples(spark, d):
    pts = _points(spark, d).select("identifier")
    return metrics.bootstrap_samples(pts, "identifier", 100).select(F.col("round").cast("bigint").alias("round"), "identifier")


@query("bootstrap_ci", TICKETS.format(rounds=100) + """, j AS (SELECT b.*, n_chars::double AS t FROM b JOIN documents ON doc_id = id),
  m AS (SELECT round, var_samp(x) AS sxx, var_samp(y) AS syy, var_samp(t) AS stt, covar_samp(x, y) AS sxy, covar_samp(x, t) AS sxt, covar_samp(y, t) AS syt FROM j GROUP BY 1),
  r AS (SELECT round, (syy * sxt * sxt - 2 * sxy * sxt * syt + sxx * syt * syt) / ((sxx * syy - sxy * sxy) * stt) AS r2 FROM m)
  SELECT 'length_r2' AS metric, round(avg(r2), 6) AS mean, round(quantile_cont(r2, 0.025), 6) AS ci_low, round(quantile_cont(r2, 0.975), 6) AS ci_high FROM r""")
def bootstrap_ci(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("identifier"), F.col("n_chars").cast("double").alias("t"))
    rounds = metrics.bootstrap_samples(_points(spark, d).select("identifier", "x", "y"), "identifier", 100)
    scores = metrics.two_predictor_r2(rounds.join(docs, "identifier"), "t", by=["round"]).withColumn("metric", F.lit("length_r2"))
    ci = metrics.percentile_ci(scores, "r2", ["metric"])
    return ci.select("metric", r6("mean").alias("mean"), r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


BOOT = TICKETS.format(rounds=100) + """,
  pr AS (SELECT b.round, b.id, b.label, e.embedding::double[] AS v, x, y FROM b JOIN embeddings e ON vec_id = id),
  lo AS (SELECT a.round, a.id AS i, c.id AS j, a.label AS li, c.label AS lj, row_number() OVER (PARTITION BY a.round, a.id ORDER BY (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y), c.id) AS rl,
           list_distance(a.v, c.v) AS dh, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) AS dl
         FROM pr a JOIN pr c ON a.round = c.round AND a.id <> c.id),
  hi AS (SELECT *, rank() OVER (PARTITION BY round, i ORDER BY dh) AS rh FROM lo),
  n AS (SELECT count(*)::double / 100 AS n FROM pr),
  tr AS (SELECT round, k, 1 - 2.0 / (max(n) * k * (2 * max(n) - 3 * k - 1)) * sum(CASE WHEN rl <= k AND rh > k THEN rh - k ELSE 0 END) AS value
         FROM hi, n, (SELECT unnest([1, 15]) AS k) GROUP BY 1, 2),
  v AS (SELECT round, i, li, lj, count(*) AS votes FROM lo WHERE rl <= 15 GROUP BY 1, 2, 3, 4),
  w AS (SELECT *, row_number() OVER (PARTITION BY round, i ORDER BY votes DESC, lj) AS place FROM v),
  ac AS (SELECT round, avg(CASE WHEN li = lj THEN 1.0 ELSE 0.0 END) AS value FROM w WHERE place = 1 GROUP BY 1),
  m AS (SELECT round, i, li, lj, avg(dl) AS d FROM lo GROUP BY 1, 2, 3, 4),
  s AS (SELECT round, i, max(CASE WHEN li = lj THEN d END) AS a, min(CASE WHEN li <> lj THEN d END) AS b FROM m GROUP BY 1, 2),
  si AS (SELECT round, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS value FROM s GROUP BY 1)
  SELECT round, concat('trustworthiness_', k) AS metric, round(value, 6) AS value FROM tr UNION ALL SELECT round, 'knn_accuracy', round(value, 6) FROM ac
  UNION ALL SELECT round, 'silhouette', round(value, 6) FROM si
"""


@query("bootstrap_grid", BOOT)
def bootstrap_grid(spark, d):
    grid = benchmark.bootstrap_grid(_points(spark, d), 100, [1, 15])
    return grid.select(F.col("round").cast("bigint").alias("round"), "metric", r6("value").alias("value"))


@query("bootstrap_refit")
def bootstrap_refit(spark, d):
    """PCA, contrastive PCA (against the vectors of one label) and UMAP, each fitted anew in every round."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("identifier"), F.col("embedding").alias("vec"), "label")
    grid = benchmark.bootstrap_refit(rows, 100, [1, 15], methods=("pca", "ppca", "umap"), background=rows.filter("label = 1"))
    return grid.select("method", F.col("round").cast("bigint").alias("round"), "metric", r6("value").alias("value"))


@query("relative_reduction", TICKETS.format(rounds=100) + """,
  m AS (SELECT round, avg(x) AS a, avg(y) AS b FROM b GROUP BY 1), g AS (SELECT avg(a) AS a, avg(b) AS b FROM m)
  SELECT round((a - b) / a, 6) AS relative_reduction, round(b - a, 6) AS difference FROM g""")
def relative_reduction(spark, d):
    rounds = metrics.bootstrap_samples(_points(spark, d).select("identifier", "x", "y"), "identifier", 100)
    long = rounds.groupBy("round").agg(F.avg("x").alias("a"), F.avg("y").alias("b")).select(
        "round", F.explode(F.array(F.struct(F.lit("base").alias("method"), F.col("a").alias("v")), F.struct(F.lit("other").alias("method"), F.col("b").alias("v")))).alias("e")
    ).select("e.method", F.col("e.v").alias("value"))
    out = benchmark.relative_reduction(long, "base", "other")
    return out.select(r6("relative_reduction").alias("relative_reduction"), r6("difference").alias("difference"))


EVAL = """
  WITH p AS (SELECT 'A' AS projection_name, vec_id AS id, label, embedding[1]::double AS x0, embedding[2]::double AS y0 FROM embeddings
    UNION ALL SELECT 'B', vec_id, label, embedding[3]::double, embedding[4]::double FROM embeddings),
  j AS (SELECT p.*, n_chars::double AS t, (x0 - avg(x0) OVER w) / stddev_pop(x0) OVER w AS x, (y0 - avg(y0) OVER w) / stddev_pop(y0) OVER w AS y
        FROM p JOIN documents ON doc_id = id WINDOW w AS (PARTITION BY projection_name)),
  m AS (SELECT projection_name, var_samp(x) AS sxx, var_samp(y) AS syy, var_samp(t) AS stt, covar_samp(x, y) AS sxy, covar_samp(x, t) AS sxt, covar_samp(y, t) AS syt FROM j GROUP BY 1),
  r AS (SELECT projection_name, (syy * sxt * sxt - 2 * sxy * sxt * syt + sxx * syt * syt) / ((sxx * syy - sxy * sxy) * stt) AS r2 FROM m),
  lo AS (SELECT a.projection_name, a.id AS i, b.id AS j, a.label AS li, b.label AS lj, row_number() OVER (PARTITION BY a.projection_name, a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rl
         FROM j a JOIN j b ON a.projection_name = b.projection_name AND a.id <> b.id),
  u AS (SELECT projection_name, avg(CASE WHEN li = lj THEN 1.0 ELSE 0.0 END) AS purity FROM lo WHERE rl <= 10 GROUP BY 1)
  SELECT projection_name, (SELECT count(*) // 2 FROM j) AS n, round(r2, 6) AS length_r2, round(purity, 6) AS knn_purity FROM r JOIN u USING (projection_name)
"""


def _two_projections(spark, d):
    emb = table(spark, d, "embeddings")
    pick = lambda name, a: emb.select(
        F.lit(name).alias("projection_name"), F.col("vec_id").alias("identifier"),
        F.col("embedding")[a].cast("double").alias("x"), F.col("embedding")[a + 1].cast("double").alias("y"),
    )
    labels = emb.select(F.col("vec_id").alias("identifier"), "label").join(
        table(spark, d, "documents").select(F.col("doc_id").alias("identifier"), F.col("n_chars").cast("double").alias("seq_length")), "identifier"
    )
    return pick("A", 0).unionByName(pick("B", 2)), labels


@query("evaluate_projections", EVAL)
def evaluate_projections(spark, d):
    out = benchmark.evaluate_projections(*_two_projections(spark, d), k=10)
    return out.select("projection_name", "n", r6("length_r2").alias("length_r2"), r6("knn_purity").alias("knn_purity"))


@query("evaluation_with_f1")
def evaluation_with_f1(spark, d):
    """As evaluate_projections, with the cross-validated macro F1 of every projection (no SQL; tested against a numpy fit)."""
    out = benchmark.evaluate_projections(*_two_projections(spark, d), k=10, with_f1=True)
    return out.select("projection_name", "n", r6("length_r2").alias("length_r2"), r6("knn_purity").alias("knn_purity"), r6("macro_f1").alias("macro_f1"))


@query("bootstrap_f1")
def bootstrap_f1(spark, d):
    """Macro F1 of every projection in every round, 1,000 fits in one job."""
    out = benchmark.bootstrap_evaluation(*_two_projections(spark, d), 100, with_f1=True)
    return out.filter("metric = 'macro_f1'").select(F.col("round").cast("bigint").alias("round"), "projection_name", "metric", r6("value").alias("value"))


EVAL_BOOT = """
  WITH l AS (SELECT vec_id AS id, label, n_chars::double AS t, embedding AS e FROM embeddings JOIN documents ON doc_id = vec_id),
  k AS (SELECT l.*, r.round, row_number() OVER (PARTITION BY r.round ORDER BY md5(concat(cast(id AS varchar), '#', cast(r.round AS varchar))), id) AS rn
        FROM l, (SELECT unnest(range(0, 100)) AS round) r),
  b AS (SELECT * FROM k WHERE rn <= (SELECT cast(floor(count(*) * 0.8) AS bigint) FROM l)),
  p AS (SELECT round, 'A' AS projection_name, id, label, t, e[1]::double AS x0, e[2]::double AS y0 FROM b UNION ALL SELECT round, 'B', id, label, t, e[3]::double, e[4]::double FROM b),
  j AS (SELECT p.*, (x0 - avg(x0) OVER w) / stddev_pop(x0) OVER w AS x, (y0 - avg(y0) OVER w) / stddev_pop(y0) OVER w AS y FROM p WINDOW w AS (PARTITION BY round, projection_name)),
  m AS (SELECT round, projection_name, var_samp(x) AS sxx, var_samp(y) AS syy, var_samp(t) AS stt, covar_samp(x, y) AS sxy, covar_samp(x, t) AS sxt, covar_samp(y, t) AS syt FROM j GROUP BY 1, 2),
  lo AS (SELECT a.round, a.projection_name, a.id AS i, a.label AS li, c.label AS lj, row_number() OVER (PARTITION BY a.round, a.projection_name, a.id ORDER BY (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y), c.id) AS rl
         FROM j a JOIN j c ON a.round = c.round AND a.projection_name = c.projection_name AND a.id <> c.id)
  SELECT round, projection_name, 'length_r2' AS metric, round((syy * sxt * sxt - 2 * sxy * sxt * syt + sxx * syt * syt) / ((sxx * syy - sxy * sxy) * stt), 6) AS value FROM m
  UNION ALL SELECT round, projection_name, 'knn_purity', round(avg(CASE WHEN li = lj THEN 1.0 ELSE 0.0 END), 6) FROM lo WHERE rl <= 10 GROUP BY 1, 2
"""


@query("bootstrap_evaluation", EVAL_BOOT)
def bootstrap_evaluation(spark, d):
    out = benchmark.bootstrap_evaluation(*_two_projections(spark, d), 100)
    return out.select(F.col("round").cast("bigint").alias("round"), "projection_name", "metric", r6("value").alias("value"))


# ------------------------------------------------------------------ vector statistics


@query("column_stats", """
  SELECT pos, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std
  FROM (SELECT unnest(range(0, 64)) AS pos, unnest(embedding::double[]) AS v FROM embeddings) GROUP BY 1""")
def column_stats(spark, d):
    out = linalg.column_stats(table(spark, d, "embeddings"), "embedding")
    return out.select(F.col("pos").cast("bigint").alias("pos"), "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query("covariance_cells", """
  WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding::double[]) AS v FROM embeddings)
  SELECT a.pos AS a, b.pos AS b, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY 1, 2""")
def covariance_cells(spark, d):
    out = linalg.covariance_cells(table(spark, d, "embeddings"), "embedding")
    return out.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), r6("cov").alias("cov"))


@query("standardized_vectors", """
  WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding::double[]) AS v FROM embeddings)
  SELECT vec_id, pos, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) + 0.0 AS v FROM e WINDOW w AS (PARTITION BY pos)""")
def standardized_vectors(spark, d):
    out = linalg.scale_vectors(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec")))
    return out.select("vec_id", F.posexplode("scaled").alias("pos", "v")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), r6("v").alias("v")
    )


@query("paired_delta_rows", """
  WITH f AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings WHERE vec_id % 3 <> 0),
  m AS (SELECT vec_id + 1 AS id, embedding::double[] AS v FROM embeddings WHERE vec_id % 4 <> 0),
  s AS (SELECT f.id, list_sum(f.v) - list_sum(m.v) AS t FROM f JOIN m ON f.id = m.id)
  SELECT id AS identifier, 'pos' AS part, round(0.5 * t, 6) AS total FROM s UNION ALL SELECT id, 'neg', round(-0.5 * t, 6) FROM s""")
def paired_delta_rows(spark, d):
    emb = table(spark, d, "embeddings")
    full = emb.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("identifier"), F.col("embedding").alias("vec"))
    mature = emb.filter("vec_id % 4 <> 0").select((F.col("vec_id") + 1).alias("identifier"), F.col("embedding").alias("vec"))
    rows = linalg.paired_delta(full, mature, 0.5)
    return rows.select("identifier", "part", r6(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("sim_to_distance", """
  WITH e AS (SELECT l_suppkey AS i, l_partkey % 100 AS j, max(CASE WHEN l_suppkey = l_partkey % 100 THEN 1.0 ELSE l_discount END) AS sim FROM lineitem GROUP BY 1, 2)
  SELECT i, j, round(sqrt((SELECT max(sim) FROM e) - sim), 6) AS distance FROM e""")
def sim_to_distance(spark, d):
    i, j = F.col("l_suppkey"), F.col("l_partkey") % 100
    edges = table(spark, d, "lineitem").groupBy(i.alias("i"), j.alias("j")).agg(
        F.max(F.when(i == j, F.lit(1.0)).otherwise(F.col("l_discount"))).alias("sim")
    )
    return linalg.similarity_to_distance(edges).select("i", "j", r6("distance").alias("distance"))
