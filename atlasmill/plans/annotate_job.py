"""Annotation job: only the sources a request needs are read and joined."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.scalars import is_accession
from ..operators import align, annotate


@dataclass
class SourceTables:
    """Raw source tables (results of the public services stored as tables).

    entries(accession, json), archive(uniparc_id, sequence),
    secondary(secondary_accession, json), lineages(doc), matches(doc),
    match_names(db, accession, name), domains(identifier, doc),
    fold_names(code, name), predictions(identifier, model_name, value, pos),
    enzyme_names(code, name), clans(accession, clan).
    """

    entries: DataFrame | None = None
    archive: DataFrame | None = None
    secondary: DataFrame | None = None
    lineages: DataFrame | None = None
    matches: DataFrame | None = None
    match_names: DataFrame | None = None
    domains: DataFrame | None = None
    fold_names: DataFrame | None = None
    predictions: DataFrame | None = None
    enzyme_names: DataFrame | None = None
    clans: DataFrame | None = None


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def annotate_headers(
    headers: DataFrame,
    fields: list[str] | None,
    sources: SourceTables,
    sequences: DataFrame | None = None,
    cached: DataFrame | None = None,
    refetch: frozenset[str] = frozenset(),
) -> tuple[DataFrame, list[str]]:
    """Annotation table for ``headers(identifier)`` and the failed sources.

    A source that cannot be planned gives blank columns and is named in the
    report. Columns already in ``cached`` are reused unless their source is in
    ``refetch``.
    """
    spark = headers.sparkSession
    wanted = model.resolve_fields(fields)
    split = model.fields_by_source(wanted)
    reuse: list[str] = []
    if cached is not None:
        stale = {f for s in refetch for f in model.SOURCE_FIELDS.get(s, [])}
        reuse = [c for c in wanted if c in cached.columns and c not in stale]
    need = model.sources_to_load(set(reuse), set(wanted))
    failed: list[str] = []

    def attempt(name: str, build: Callable[[], DataFrame]) -> DataFrame | None:
        try:
            out = build()
            out.schema  # analysis errors surface here
            return out
        except Exception:  # noqa: BLE001 - one failing source must not lose the others
            failed.append(name)
            return None

    unique = headers.select("identifier").distinct()
    base = unique.withColumn("organism_id", F.lit("")).withColumn("sequence", F.lit(""))
    if need["uniprot"] and sources.entries is not None:
        def entries() -> DataFrame:
            valid = unique.filter(is_accession("identifier"))
            resolved = annotate.resolve_entries(
                valid,
                sources.entries,
                sources.archive or _empty(spark, "uniparc_id string, sequence string"),
                sources.secondary or _empty(spark, "secondary_accession string, json string"),
            )
            names = sorted(set(split["uniprot"]) | {"organism_id", "sequence"})
            return unique.join(annotate.entry_annotations(resolved, names), "identifier", "left").na.fill("")

        base = attempt("uniprot", entries) or base
    if sequences is not None:
        given = sequences.select("identifier", F.col("sequence").alias("_s"))
        base = base.join(given, "identifier", "left").withColumn("sequence", F.coalesce("_s", "sequence")).drop("_s")
    taxonomy = matches = domains = predictions = None
    if need["taxonomy"] and sources.lineages is not None:
        taxonomy = attempt("taxonomy", lambda: annotate.taxonomy_ranks(sources.lineages).select("taxon_id", *split["taxonomy"]))
    if need["interpro"] and sources.matches is not None:
        seqs = base.select("identifier", "sequence").filter("sequence <> ''")
        matches = attempt("interpro", lambda: annotate.domain_match_annotations(sources.matches, seqs, sources.match_names))
    if need["ted"] and sources.domains is not None:
        names = sources.fold_names or _empty(spark, "code string, name string")
        domains = attempt("ted", lambda: annotate.structure_domains(sources.domains, names))
    if need["predictions"] and sources.predictions is not None:
        predictions = attempt("predictions", lambda: annotate.predictions_wide(sources.predictions))
    merged = annotate.merge_sources(base, taxonomy, matches, domains, predictions)
    out = annotate.finish_annotations(merged, [w for w in wanted if w not in reuse], sources.enzyme_names, sources.clans)
    if reuse:
        out = out.join(align.first_wins(cached.select("identifier", *reuse), "identifier", reuse), "identifier", "left")
    return headers.join(out.select("identifier", *wanted), "identifier", "left").na.fill(""), failed
