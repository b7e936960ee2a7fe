"""The four ways to obtain the background of contrastive PCA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_truthy, normalize_value, safe_identifier, segment_outcome, squeeze_segment, value_in
from ..model import ReducerParams
from ..operators import embed as embedding
from ..operators import linalg
from ..operators.align import first_row, first_wins, require_rows


def _selector(params: ReducerParams) -> Column | None:
    column = params.background_annotation
    if not column:
        return None
    return value_in(column, list(params.background_values)) if params.background_values else is_truthy(column)


def _aligned(vectors: DataFrame, annotations: DataFrame) -> DataFrame:
    meta = first_row(annotations, "identifier")
    return vectors.select("identifier").join(meta, "identifier", "left")


def _need(df: DataFrame, columns: list[str]) -> None:
    for c in filter(None, columns):
        if c not in df.columns:
            raise ValueError(f"Annotation column {c!r} not found. Available columns: {', '.join(df.columns)}")


def _at_least_two(df: DataFrame, what: str) -> int:
    n = df.count()
    if n < 2:
        raise ValueError(f"{what} gives {n} row(s); need at least 2")
    return n


def annotation_background(vectors: DataFrame, annotations: DataFrame, params: ReducerParams) -> tuple[DataFrame, dict]:
    """Rows of the data set itself, selected by an annotation."""
    if not params.background_annotation:
        raise ValueError("annotation mode needs background_annotation")
    _need(annotations, [params.background_annotation])
    chosen = _aligned(vectors, annotations).filter(_selector(params)).select("identifier")
    rows = vectors.join(chosen, "identifier", "left_semi")
    rule = "isin" if params.background_values else "truthy_non_missing"
    return rows, {
        "mode": "annotation",
        "selector": {"column": params.background_annotation, "values": list(params.background_values), "rule": rule},
        "n_background": _at_least_two(rows, "the annotation background"),
    }


def derived_segments(vectors: DataFrame, annotations: DataFrame, params: ReducerParams, sequences: DataFrame | None = None) -> DataFrame:
    """(identifier, reason, segment) of every candidate row."""
    _need(annotations, [
        params.background_annotation, params.derived_segment_column, params.derived_start_column, params.derived_end_column
    ])
    if not (params.derived_segment_column or params.derived_end_column) and params.derived_fixed_end <= params.derived_fixed_start:
        raise ValueError("derived mode needs a segment column, an end column or fixed_end > fixed_start")
    rows = _aligned(vectors, annotations)
    selector = _selector(params)
    if selector is not None:
        rows = rows.filter(selector)
    if params.derived_segment_column:
        piece = squeeze_segment(normalize_value(params.derived_segment_column))
        short = F.length(piece) < params.derived_min_length
        return rows.select(
            "identifier", F.when(short, "short").otherwise("ok").alias("reason"), F.when(~short, piece).alias("segment")
        )
    own = F.when(is_truthy("sequence"), normalize_value("sequence")) if "sequence" in rows.columns else F.lit(None).cast("string")
    if sequences is not None:
        rows = rows.join(sequences.select("identifier", F.col("sequence").alias("_fasta")), "identifier", "left")
        own = F.coalesce("_fasta", own)
    start = F.col(params.derived_start_column) if params.derived_start_column else F.lit(params.derived_fixed_start)
    end = F.col(params.derived_end_column) if params.derived_end_column else F.lit(params.derived_fixed_end)
    outcome = segment_outcome(own, start, end, params.derived_min_length)
    return rows.select("identifier", outcome.alias("o")).select("identifier", "o.*")


def derived_background(vectors: DataFrame, annotations: DataFrame, params: ReducerParams, model: embedding.Model, sequences: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Separately embedded nuisance segments."""
    segments = derived_segments(vectors, annotations, params, sequences)
    counts = {r["reason"]: r["n"] for r in segments.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    usable = segments.filter("reason = 'ok'").select(
        F.concat(safe_identifier("identifier"), F.lit("__derived_nuisance")).alias("identifier"), F.col("segment").alias("sequence")
    )
    if counts.get("ok", 0) < 2:
        raise ValueError(f"derived mode gives {counts.get('ok', 0)} usable segment(s); need at least 2")
    return embedding.embed(usable, model), {
        "mode": "derived",
        "n_derived_segments": counts.get("ok", 0),
        "skipped_missing_sequence": counts.get("missing_sequence", 0),
        "skipped_bad_coordinates": counts.get("bad_coordinates", 0),
        "skipped_short": counts.get("short", 0),
    }


def paired_background(vectors: DataFrame, annotations: DataFrame | None, params: ReducerParams, full: DataFrame, mature: DataFrame) -> tuple[DataFrame, dict]:
    """Signed differences of paired embeddings, re-centred by construction."""
    ids = vectors.select("identifier")
    selector = _selector(params)
    if selector is not None:
        _need(annotations, [params.background_annotation])
        ids = _aligned(vectors, annotations).filter(selector).select("identifier")
    report = linalg.pairing_report(ids, full, mature).first().asDict()
    if report["n_pairs"] < 2:
        raise ValueError(f"paired mode finds {report['n_pairs']} usable pair(s); need at least 2")
    wanted = full.join(ids.distinct(), "identifier", "left_semi")
    rows = linalg.paired_delta(wanted, mature, params.paired_delta_scale)
    return rows.select("identifier", "vec"), {"mode": "paired_delta", "delta_scale": params.paired_delta_scale, **report}


def explicit_background(background: DataFrame) -> tuple[DataFrame, dict]:
    return require_rows(background, "the background is empty"), {"mode": "explicit", "n_background": _at_least_two(background, "the background")}


def unique_rows(vectors: DataFrame) -> DataFrame:
    return first_wins(vectors.select("identifier", "vec"), "identifier", ["vec"])
