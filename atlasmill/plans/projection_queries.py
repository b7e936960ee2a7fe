"""Projection methods on the embedding table (no SQL form; see the invariant tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import standardize_missing
from ..model import ReducerParams
from ..operators import embed, layout, linalg
from ..sources.vectors import similarity_edges
from . import backgrounds
from .registry import query, r6, table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("identifier"), F.col("embedding").alias("vec")
    )


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("identifier"), F.col("label").cast("string").alias("label"))
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("identifier"), "lang", F.col("text").alias("sequence"),
        F.lit("2").alias("seg_start"), F.greatest(F.lit(7), F.expr("length(text) * (doc_id % 50 + 50) div 100")).cast("string").alias("seg_end"),
    )
    return emb.join(docs, "identifier", "left")


def _out(coords: DataFrame, dims: int) -> DataFrame:
    z = r6(F.col("coords")[2]) if dims == 3 else F.lit(None).cast("double")
    return coords.select("identifier", r6(F.col("coords")[0]).alias("x"), r6(F.col("coords")[1]).alias("y"), z.alias("z"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings -> PCA -> joined with their annotation, ordered by id."""
    coords, _ = linalg.pca(_vectors(spark, d), 2)
    meta = _annotations(spark, d).select("identifier", "label", standardize_missing("lang").alias("lang"))
    return _out(coords, 2).join(meta, "identifier", "left").orderBy("identifier")


@query("pca2")
def pca2(spark, d):
    return _out(linalg.pca(_vectors(spark, d), 2)[0], 2)


@query("pca3")
def pca3(spark, d):
    return _out(linalg.pca(_vectors(spark, d), 3)[0], 3)


@query("pca_geometry", """
  WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding::double[]) AS v FROM embeddings),
  c AS (SELECT vec_id, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM e),
  norms AS (SELECT vec_id, sum(v * v) AS norm2 FROM c GROUP BY 1),
  dots AS (SELECT a.vec_id, sum(a.v * b.v) AS dot_next FROM c a JOIN c b ON b.vec_id = a.vec_id + 1 AND a.pos = b.pos GROUP BY 1)
  SELECT vec_id AS identifier, round(norm2, 6) + 0.0 AS norm2, round(dot_next, 6) + 0.0 AS dot_next FROM norms LEFT JOIN dots USING (vec_id)""")
def pca_geometry(spark, d):
    """Norms and neighbouring products of the scores on all axes: those of the centred vectors, as the axes are a rotation."""
    scores, _ = linalg.pca(_vectors(spark, d), 64)
    following = scores.select((F.col("identifier") - 1).alias("identifier"), F.col("coords").alias("other"))
    add = lambda t, v: t + v
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), add)
    return scores.join(following, "identifier", "left").select(
        "identifier", r6(dot("coords", "coords")).alias("norm2"), r6(dot("coords", "other")).alias("dot_next"))


@query("pca_total_variance", """
  SELECT round(sum(s), 6) AS total FROM (SELECT var_samp(v) AS s FROM
    (SELECT unnest(range(0, 64)) AS pos, unnest(embedding::double[]) AS v FROM embeddings) GROUP BY pos)""")
def pca_total_variance(spark, d):
    """Variance of the scores summed over all axes: the trace of the covariance."""
    scores, _ = linalg.pca(_vectors(spark, d), 64)
    axes = scores.select(F.posexplode("coords").alias("axis", "v")).groupBy("axis").agg(F.var_samp("v").alias("s"))
    return axes.agg(r6(F.sum("s")).alias("total"))


@query("ppca_explicit")
def ppca_explicit(spark, d):
    other = table(spark, d, "embeddings").filter("label = 1").select(F.col("vec_id").alias("identifier"), F.col("embedding").alias("vec"))
    rows, _ = backgrounds.explicit_background(other)
    return _out(linalg.contrastive_pca(_vectors(spark, d), rows, 2)[0], 2)


@query("ppca_annotation")
def ppca_annotation(spark, d):
    params = ReducerParams(background_annotation="label", background_values=("0",))
    vecs = _vectors(spark, d)
    rows, _ = backgrounds.annotation_background(vecs, _annotations(spark, d), params)
    return _out(linalg.contrastive_pca(vecs, rows, 2)[0], 2)


@query("ppca_derived")
def ppca_derived(spark, d):
    params = ReducerParams(derived_start_column="seg_start", derived_end_column="seg_end")
    vecs = _vectors(spark, d)
    rows, _ = backgrounds.derived_background(vecs, _annotations(spark, d), params, embed.composition(64))
    return _out(linalg.contrastive_pca(vecs, rows, 2)[0], 2)


@query("ppca_paired")
def ppca_paired(spark, d):
    vecs = _vectors(spark, d)
    mature = vecs.filter("identifier % 5 <> 0").select((F.col("identifier") + 1).alias("identifier"), "vec")
    rows, _ = backgrounds.paired_background(vecs, None, ReducerParams(), vecs, mature)
    return _out(linalg.contrastive_pca(vecs, rows, 2)[0], 2)


@query("mds2")
def mds2(spark, d):
    return _out(layout.mds(_vectors(spark, d), 2)[0], 2)


@query("mds_similarity")
def mds_similarity(spark, d):
    hits = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("query"), (F.col("l_partkey") % F.lit(97)).cast("string").alias("target"),
        F.when(F.col("l_suppkey") == F.col("l_partkey") % 97, F.lit(1.0)).otherwise(F.col("l_discount") * 5).alias("fident"),
    )
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("identifier"))
    edges = linalg.similarity_to_distance(similarity_edges(hits, nodes))
    return _out(layout.mds_from_edges(nodes, edges, 2, missing=1.0)[0], 2)


@query("tsne2")
def tsne2(spark, d):
    return _out(layout.tsne(_vectors(spark, d), 2, ReducerParams(learning_rate=50.0))[0], 2)


@query("umap2")
def umap2(spark, d):
    return _out(layout.umap(_vectors(spark, d), 2)[0], 2)


@query("pacmap2")
def pacmap2(spark, d):
    return _out(layout.pacmap(_vectors(spark, d), 2)[0], 2)


@query("localmap2")
def localmap2(spark, d):
    return _out(layout.localmap(_vectors(spark, d), 2)[0], 2)


@query("embed_sequences", r"""
  WITH c AS (SELECT doc_id, unnest(l) AS ch, unnest(generate_series(1, len(l))) AS i, len(l) AS n FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS l FROM documents)),
  w AS (SELECT doc_id, i, greatest(n - 2, 1) AS n, 961 * unicode(ch) + 31 * coalesce(lead(unicode(ch)) OVER p, 0) + coalesce(lead(unicode(ch), 2) OVER p, 0) AS code
        FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
  h AS (SELECT doc_id, code % 16 AS pos, n, count(*) AS m FROM w WHERE i <= n GROUP BY ALL)
  SELECT d.doc_id AS identifier, CAST(p.pos AS INTEGER) AS pos,
    round(CAST(CAST(CASE WHEN length(d.text) = 0 THEN CAST(p.pos = 0 AS INTEGER) ELSE coalesce(h.m / h.n, 0) END AS FLOAT) AS DOUBLE), 6) AS v
  FROM documents d, (SELECT unnest(range(0, 16)) AS pos) p LEFT JOIN h ON h.doc_id = d.doc_id AND h.pos = p.pos WHERE d.text IS NOT NULL""")
def embed_sequences(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("identifier"), F.col("text").alias("sequence"))
    out = embed.embed(docs, embed.composition(16))
    return out.select("identifier", F.posexplode("vec").alias("pos", "v")).select("identifier", "pos", r6(F.col("v").cast("double")).alias("v"))
