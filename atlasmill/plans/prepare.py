"""End-to-end job: vector sets and annotation sources in, output tables out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.cells import strip_scores_in
from ..model import MethodSpec, ReducerParams
from ..operators import align, embed, layout, linalg, style
from ..sources import bundle, tables, vectors
from ..session import cut_lineage
from . import backgrounds


@dataclass
class PrepareRequest:
    inputs: list[str]
    methods: list[str]
    output: str
    annotations: DataFrame | None = None
    custom_tables: list[str] = field(default_factory=list)
    similarity_hits: DataFrame | None = None
    sequences: DataFrame | None = None
    params: ReducerParams = ReducerParams()
    iterations: dict[str, int] = field(default_factory=dict)
    no_scores: bool = False
    bundled: bool = False
    cache: str | None = None
    refetch: frozenset[str] = frozenset()
    styles: dict | None = None
    id_col: str = "identifier"
    vec_col: str = "vec"


def load_sets(spark: SparkSession, inputs: list[str], id_col: str = "identifier", vec_col: str = "vec") -> dict[str, DataFrame]:
    """Input specs -> one cleaned set per name; same-name inputs are united."""
    grouped: dict[str, list[DataFrame]] = {}
    for n, spec in enumerate(inputs):
        path, name = model.parse_input_spec(spec)
        df = vectors.load_vectors(spark, [path], name or vectors.model_name(spark, [path]), id_col, vec_col)
        key = name or df.select("embedding_set").first()[0]
        grouped.setdefault(key, []).append(df.withColumn("set_idx", F.lit(n)))
    out = {}
    for name, frames in grouped.items():
        if len(frames) == 1:
            out[name] = frames[0].select("identifier", "vec")
            continue
        union = frames[0]
        for f in frames[1:]:
            union = union.unionByName(f)
        out[name] = align.union_same_name(union, order=["set_idx"]).select("identifier", "vec")
    return out


def align_sets(sets: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every set restricted to the identifiers all sets share."""
    frames = list(sets.values())
    if len(frames) == 1:
        return sets, frames[0].select("identifier")
    ids = cut_lineage(align.intersect_ids([f.select("identifier") for f in frames]))
    align.require_rows(ids, "No common identifiers found across embedding sets.")
    return {n: f.join(ids, "identifier", "left_semi") for n, f in sets.items()}, ids


def annotation_table(spark: SparkSession, request: PrepareRequest, headers: DataFrame) -> DataFrame:
    """Source annotations, custom tables over them, one row per header."""
    base = request.annotations
    custom = tables.read_custom_tables(spark, request.custom_tables)
    if base is None:
        base = custom
    elif custom is not None:
        base = align.overlay_left(base, custom)
    if base is None:
        return headers
    if request.no_scores:
        base = strip_scores_in(base)
    return align.attach_to_headers(headers, base)


def run_method(vecs: DataFrame, spec: MethodSpec, params: ReducerParams, request: PrepareRequest, meta: DataFrame) -> tuple[DataFrame, dict] | None:
    """One projection; an unknown method gives None."""
    k, its = spec.dims, request.iterations.get(spec.method)
    extra = {} if its is None else {"iterations": its}
    if spec.method == "pca":
        return linalg.pca(vecs, k)
    if spec.method == "ppca":
        rows, details = background_for(vecs, params, request, meta)
        coords, info = linalg.contrastive_pca(vecs, rows, k, mu=params.regularization_mu, standard_scale=params.standard_scale)
        return coords, {**info, "background_details": details}
    run: Callable | None = {
        "localmap": layout.localmap, "mds": layout.mds, "pacmap": layout.pacmap, "tsne": layout.tsne, "umap": layout.umap,
    }.get(spec.method)
    return None if run is None else run(vecs, k, params, **extra)


def background_for(vecs: DataFrame, params: ReducerParams, request: PrepareRequest, meta: DataFrame) -> tuple[DataFrame, dict]:
    spark = vecs.sparkSession
    load = lambda path: vectors.load_vectors(spark, [path], "background", request.id_col, request.vec_col).select("identifier", "vec")
    if params.ppca_mode == "annotation":
        return backgrounds.annotation_background(vecs, meta, params)
    if params.ppca_mode == "derived":
        name = params.derived_embedder
        return backgrounds.derived_background(vecs, meta, params, embed.get_model(name), request.sequences)
    if params.ppca_mode == "paired_delta":
        return backgrounds.paired_background(vecs, meta, params, load(params.paired_full_path), load(params.paired_mature_path))
    if not params.background_path:
        raise ValueError("explicit mode needs background_path")
    return backgrounds.explicit_background(load(params.background_path))


def fingerprint(df: DataFrame) -> list:
    """Row count and order-free sum of row hashes: changes with the content of a table."""
    total = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).cast("string")
    return list(df.agg(F.count("*"), total).first())


def background_content(spark: SparkSession, params: ReducerParams, request: PrepareRequest, meta: DataFrame) -> list:
    """Fingerprints of the tables from which a background comes."""
    load = lambda path: vectors.load_vectors(spark, [path], "background", request.id_col, request.vec_col).select("identifier", "vec")
    paths = [p for p in (params.background_path, params.paired_full_path, params.paired_mature_path) if p]
    tables_ = [*map(load, paths), meta, *([] if request.sequences is None else [request.sequences])]
    return [fingerprint(t) for t in tables_]


def cache_key(request: PrepareRequest, name: str, spec: MethodSpec, params: ReducerParams, content: list) -> str:
    """Key of a projection; ``content`` holds the fingerprints of the tables that it is made of."""
    payload = {
        "inputs": request.inputs, "set": name, "method": spec.method, "dims": spec.dims, "params": asdict(params),
        "iterations": request.iterations.get(spec.method), "content": content,
    }
    return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()[:12]


def _cached(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    try:
        coords = spark.read.parquet(f"{path}/coords")
        info = json.loads(spark.read.parquet(f"{path}/info").first()[0])
        return coords, info
    except Exception as err:  # noqa: BLE001 - absent cache is the normal case
        if "PATH_NOT_FOUND" in str(err):
            return None
        raise


def prepare(spark: SparkSession, request: PrepareRequest) -> dict:
    """Run the job; returns the written tables and a small run report."""
    if not request.inputs:
        raise ValueError("At least one embedding set is required.")
    specs = model.parse_methods(request.methods)
    sets, headers = align_sets(load_sets(spark, request.inputs, request.id_col, request.vec_col))
    meta = annotation_table(spark, request, headers)
    data, entries, skipped = None, [], []
    sets = {n: cut_lineage(v) for n, v in sets.items()}  # every method reads them again
    content = {n: [fingerprint(v)] for n, v in sets.items()} if request.cache else {}
    jobs = [(n, v, s) for n, v in sets.items() for s in specs]
    for name, vecs, spec in jobs:
        params = request.params.merged(spec.options)
        label = model.projection_name(name, spec.method, spec.dims, model.disambiguation_suffix(spec, specs))
        key = None
        if request.cache:
            more = background_content(spark, params, request, meta) if spec.method == "ppca" else []
            key = cache_key(request, name, spec, params, content[name] + more)
        result = None
        if key and "projections" not in request.refetch:
            result = _cached(spark, f"{request.cache}/{key}")
        if result is None:
            result = run_method(vecs, spec, params, request, meta)
            if result is None:
                skipped.append(spec.method)
                continue
            if key:
                result[0].write.mode("overwrite").parquet(f"{request.cache}/{key}/coords")
                spark.createDataFrame([(json.dumps(result[1], default=str),)], "info string").write.mode("overwrite").parquet(
                    f"{request.cache}/{key}/info"
                )
        coords, info = result
        rows = bundle.projection_rows(coords, label, spec.dims)
        data = rows if data is None else data.unionByName(rows)
        entries.append((label, spec.dims, info))
    if request.similarity_hits is not None:
        for spec in [s for s in specs if s.method == "mds"] or [MethodSpec("mds", 2)]:
            params = request.params.merged(spec.options)
            edges = linalg.similarity_to_distance(vectors.similarity_edges(request.similarity_hits, headers))
            top = edges.agg(F.max("sim")).first()[0]
            coords, info = layout.mds_from_edges(
                headers, edges, spec.dims, params, request.iterations.get("mds"), missing=None if top is None else float(top) ** 0.5
            )
            label = model.projection_name("MMseqs2", "mds", spec.dims)
            rows = bundle.projection_rows(coords, label, spec.dims)
            data = rows if data is None else data.unionByName(rows)
            entries.append((label, spec.dims, info))
    if data is None:
        raise ValueError("no projection was produced; unknown methods: " + ", ".join(skipped))
    annotations = bundle.annotations_output(meta)
    metadata = bundle.metadata_rows(spark, entries)
    settings = style.apply_styles(annotations, request.styles) if request.styles else None
    bundle.write_tables(request.output, annotations, metadata, data, settings)
    report = {
        "rows": headers.count(), "sets": list(sets), "projections": [e[0] for e in entries], "skipped": skipped,
        "output": request.output,
    }
    if request.bundled:
        report["bundle"] = bundle.pack(request.output, *bundle.read_tables(spark, request.output)[:3], settings)
    return report


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Diagnostics of every projection read from its stored parameters."""
    meta = spark.read.parquet(f"{folder}/projections_metadata.parquet")
    get = lambda path: F.get_json_object("info_json", path)
    return meta.select(
        "projection_name", "dimensions", get("$.explained_variance_ratio").alias("explained_variance_ratio"),
        get("$.eigenvalue_ratios").alias("eigenvalue_ratios"), get("$.background_details.mode").alias("background_mode"),
        get("$.n_background_samples").cast("bigint").alias("n_background"),
    )
