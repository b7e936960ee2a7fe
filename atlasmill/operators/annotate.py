"""Annotation sources merged into one wide table."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import split_last_pipe, with_evidence
from ..functions.entry import PROPERTIES, as_text, entry_struct
from ..functions.scalars import sequence_digest
from ..functions.transforms import transform_annotations
from ..model import SOURCE_FIELDS
from ..session import cut_lineage
from .align import spread_nulls

# Annotation -> library name in domain match documents.
MATCH_LIBRARIES = {
    "cath": "cath-gene3d",
    "cdd": "cdd",
    "panther": "panther",
    "pfam": "pfam",
    "prints": "prints",
    "prosite": "prosite patterns",
    "signal_peptide": "phobius",
    "smart": "smart",
    "superfamily": "superfamily",
}
MATCH_SCHEMA = (
    "struct<md5:string,found:boolean,matches:array<struct<signature:struct<accession:string,name:string,"
    "signatureLibraryRelease:struct<library:string>>,score:string>>>"
)
TAXON_SCHEMA = (
    "struct<taxonId:int,rank:string,scientificName:string,lineage:array<struct<rank:string,scientificName:string>>>"
)
DOMAIN_SCHEMA = "struct<annotations:array<struct<ted_domain_no:int,cath_label:string,plddt:double>>>"


def _by_text(cells: DataFrame, id_col: str, cell_col: str, resolve) -> DataFrame:
    """Cells resolved once per distinct text and joined back: ``resolve(texts)`` turns (_id, cell) rows into (_id, result) rows.

    One side of the join has every text once, so a text that very many rows share can be split.
    """
    texts = cells.select(F.col(cell_col).alias("_id"), F.col(cell_col)).distinct()
    done = cut_lineage(resolve(texts))
    result = next(c for c in done.columns if c != "_id")
    rows = cells.select(id_col, F.col(cell_col).alias("_text"))
    return rows.join(done, F.col("_text").eqNullSafe(F.col("_id")), "left").select(id_col, result)


def name_items(cells: DataFrame, names: DataFrame, key: str, value: str, id_col: str = "identifier", cell_col: str = "cell") -> DataFrame:
    """Append ``(name)`` to the items of a cell by a join (any dictionary size); every distinct cell text is resolved once.

    Item order and evidence are kept, blank items are dropped.
    """
    return _by_text(cells, id_col, cell_col, lambda texts: _named_items(texts, names, key, value, "_id", cell_col))


def _named_items(cells: DataFrame, names: DataFrame, key: str, value: str, id_col: str, cell_col: str) -> DataFrame:
    exploded = cells.select(id_col, F.posexplode_outer(F.split(cell_col, ";")).alias("pos", "item"))
    code, evidence = split_last_pipe(F.trim("item"))
    exploded = exploded.select(id_col, "pos", code.alias(key), evidence.alias("_evidence"))
    # items without a code would otherwise all meet in one task
    spread = exploded.withColumn("_key", spread_nulls(F.nullif(F.col(key), F.lit("")), id_col))
    joined = spread.join(names.select(F.col(key).alias("_key"), F.col(value).alias("_name")), "_key", "left")
    named = F.when(
        F.coalesce("_name", F.lit("")) != "", F.concat(F.col(key), F.lit(" ("), "_name", F.lit(")"))
    ).otherwise(F.col(key))
    text = with_evidence(named, F.col("_evidence"))
    grouped = joined.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.coalesce(key, F.lit("")) != "", F.struct("pos", text.alias("t"))))).alias("_items")
    )
    return grouped.select(id_col, F.array_join(F.transform("_items", lambda e: e["t"]), ";").alias(cell_col))


def clans_by_join(cells: DataFrame, clans: DataFrame, id_col: str = "identifier", cell_col: str = "pfam") -> DataFrame:
    """Sorted distinct clans of the accessions in a cell, by a join on ``clans(accession, clan)``; every distinct text is resolved once."""
    return _by_text(cells, id_col, cell_col, lambda texts: _clans(texts, clans, "_id", cell_col))


def _clans(cells: DataFrame, clans: DataFrame, id_col: str, cell_col: str) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce(cell_col, F.lit("")), F.lit(r"(PF\d+)"), F.lit(1))
    exploded = cells.select(id_col, F.explode_outer(F.array_distinct(found)).alias("accession"))
    spread = exploded.withColumn("accession", spread_nulls("accession", id_col))
    joined = spread.join(clans.select("accession", "clan"), "accession", "left")
    return joined.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("clan")), ";").alias("pfam_clan"))


def group_scores(matches: DataFrame, id_col: str = "identifier") -> DataFrame:
    """Matches ``(id, db, accession, name, score, pos)`` -> one cell per id and db.

    Scores of an accession keep their order, its first non-blank name is used
    and accessions are sorted.
    """
    score = F.when(F.coalesce("score", F.lit("")) != "", F.struct("pos", F.col("score").cast("string").alias("s")))
    named = F.when(F.coalesce("name", F.lit("")) != "", F.struct("pos", "name"))
    per_acc = matches.filter(F.coalesce("accession", F.lit("")) != "").groupBy(id_col, "db", "accession").agg(
        F.array_sort(F.collect_list(score)).alias("scores"), F.min(named).getField("name").alias("label")
    )
    head = F.when(F.col("label").isNotNull(), F.concat("accession", F.lit(" ("), "label", F.lit(")"))).otherwise(F.col("accession"))
    text = F.when(
        F.size("scores") > 0,
        F.concat(head, F.lit("|"), F.array_join(F.transform("scores", lambda e: e["s"]), ",")),
    ).otherwise(head)
    return per_acc.select(id_col, "db", "accession", text.alias("text")).groupBy(id_col, "db").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("accession", "text"))), lambda e: e["text"]), ";").alias("cell")
    )


def match_rows(documents: DataFrame, sequences: DataFrame, json_col: str = "doc") -> DataFrame:
    """Match documents joined to every identifier that has the sequence.

    ``documents(doc)`` are JSON texts keyed by MD5, ``sequences(identifier,
    sequence)`` the requested proteins. Identical sequences all get the matches.
    """
    keyed = sequences.select("identifier", sequence_digest("sequence").alias("md5"))
    docs = documents.select(F.from_json(json_col, MATCH_SCHEMA).alias("d")).filter("d.found").select(
        F.upper("d.md5").alias("md5"), F.posexplode("d.matches").alias("pos", "m")
    )
    library = F.create_map(*[F.lit(x) for k, v in MATCH_LIBRARIES.items() for x in (v, k)])
    db = F.try_element_at(library, F.lower("m.signature.signatureLibraryRelease.library"))
    flat = docs.select(
        "md5", "pos", db.alias("db"), F.col("m.signature.accession").alias("accession"),
        F.col("m.signature.name").alias("name"), F.col("m.score").alias("score"),
    ).filter("db is not null")
    return keyed.join(flat, "md5").drop("md5")


def domain_match_annotations(documents: DataFrame, sequences: DataFrame, names: DataFrame | None = None, json_col: str = "doc") -> DataFrame:
    """Wide table with one column per match database.

    ``names(db, accession, name)`` supplies labels the documents leave out.
    """
    rows = match_rows(documents, sequences, json_col)
    if names is not None:
        extra = names.select("db", F.col("accession"), F.col("name").alias("_label"))
        rows = rows.join(extra, ["db", "accession"], "left").withColumn(
            "name", F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.col("_label"))
        ).drop("_label")
    wide = group_scores(rows).groupBy("identifier").pivot("db", sorted(MATCH_LIBRARIES)).agg(F.first("cell"))
    full = sequences.select("identifier").join(wide, "identifier", "left")
    return full.na.fill("", sorted(MATCH_LIBRARIES))


def taxonomy_ranks(documents: DataFrame, json_col: str = "doc") -> DataFrame:
    """Lineage documents -> (taxon_id, root, domain, ..., species)."""
    d = F.from_json(json_col, TAXON_SCHEMA)
    parsed = documents.select(d.alias("d"))

    def rank(name: str) -> Column:
        hits = F.filter("d.lineage", lambda e: e["rank"] == name)
        own = F.when(F.col("d.rank") == name, F.col("d.scientificName"))
        return F.coalesce(F.when(F.size(hits) > 0, F.element_at(hits, -1)["scientificName"]), own, F.lit(""))

    columns = {r: rank(r) for r in SOURCE_FIELDS["taxonomy"]}
    columns["root"] = rank("no rank")
    domain = rank("domain")
    columns["domain"] = F.when(domain != "", domain).otherwise(rank("realm"))
    return parsed.select(F.col("d.taxonId").alias("taxon_id"), *[c.alias(n) for n, c in columns.items()])


def structure_domains(documents: DataFrame, fold_names: DataFrame, id_col: str = "identifier", json_col: str = "doc") -> DataFrame:
    """Domain documents -> ``code (name)|confidence;...`` per identifier."""
    d = F.from_json(json_col, DOMAIN_SCHEMA)
    flat = documents.select(id_col, F.posexplode_outer(d["annotations"]).alias("pos", "a")).select(
        id_col, "pos", F.coalesce("a.cath_label", F.lit("-")).alias("code"), F.coalesce("a.plddt", F.lit(0.0)).alias("plddt"),
        F.col("a").isNotNull().alias("real"),
    )
    # domains without a fold would otherwise all meet in one task
    known = F.when(~F.col("code").isin("-", ""), F.col("code"))
    spread = flat.withColumn("_key", spread_nulls(known, id_col))
    joined = spread.join(fold_names.select(F.col("code").alias("_key"), F.col("name").alias("_name")), "_key", "left")
    label = (
        F.when(F.col("code").isin("-", ""), F.lit("unclassified"))
        .when(F.coalesce("_name", F.lit("")) != "", F.concat("code", F.lit(" ("), "_name", F.lit(")")))
        .otherwise(F.col("code"))
    )
    text = F.concat(label, F.lit("|"), F.format_string("%.1f", "plddt"))
    grouped = joined.withColumn("_text", F.when(F.col("real"), text)).groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("real"), F.struct("pos", "_text")))).alias("_i")
    )
    return grouped.select(id_col, F.array_join(F.transform("_i", lambda e: e["_text"]), ";").alias("ted_domains"))


def predicted_topology(topology: Column | str) -> tuple[Column, Column]:
    """(signal peptide, transmembrane class) of a residue topology string."""
    t = F.col(topology) if isinstance(topology, str) else topology
    helix, strand = t.rlike("[Hh]"), t.rlike("[Bb]")
    signal = F.when(t.isNull(), F.lit("")).when(F.contains(t, F.lit("S")), F.lit("True")).otherwise(F.lit("False"))
    membrane = (
        F.when(t.isNull(), F.lit(""))
        .when(helix & strand, F.lit("alpha-helical;beta-barrel"))
        .when(helix, F.lit("alpha-helical"))
        .when(strand, F.lit("beta-barrel"))
        .otherwise(F.lit("none"))
    )
    return signal, membrane


def predictions_wide(predictions: DataFrame, id_col: str = "identifier") -> DataFrame:
    """Long predictions ``(id, model_name, value, pos)`` -> the four predicted columns."""
    models = {"loc": "LightAttentionSubcellularLocalization", "mem": "LightAttentionMembrane", "top": "TMbed"}
    wide = predictions.groupBy(id_col).agg(*[
        F.max(F.when(F.col("model_name") == m, F.struct((-F.col("pos")).alias("p"), F.coalesce("value", F.lit("")).alias("v")))).getField("v").alias(a)
        for a, m in models.items()
    ])
    signal, membrane = predicted_topology("top")
    return wide.select(
        id_col,
        F.coalesce("mem", F.lit("")).alias("predicted_membrane"),
        signal.alias("predicted_signal_peptide"),
        F.coalesce("loc", F.lit("")).alias("predicted_subcellular_location"),
        membrane.alias("predicted_transmembrane"),
    )


def match_by_sequence(headers: DataFrame, results: DataFrame) -> DataFrame:
    """Results keyed by sequence digest, falling back to the identifier.

    ``headers(identifier, sequence)``, ``results(result_key, value)``.
    """
    digest = spread_nulls(F.sha2(F.col("sequence").cast("binary"), 256), "identifier")
    by_hash = results.select(F.col("result_key").alias("_h"), F.col("value").alias("_vh"))
    by_name = results.select(F.col("result_key").alias("identifier"), F.col("value").alias("_vn"))
    return headers.withColumn("_h", digest).join(by_hash, "_h", "left").join(by_name, "identifier", "left").select(
        "identifier", F.coalesce("_vh", "_vn").alias("value")
    )


def resolve_entries(
    headers: DataFrame, entries: DataFrame, archive: DataFrame, secondary: DataFrame
) -> DataFrame:
    """Entry JSON for every accession, following merges.

    ``entries(accession, json)`` are direct hits, ``archive(uniparc_id, sequence)``
    archived sequences, ``secondary(secondary_accession, json)`` hits by old
    accession. Ladder: active entry, merge target, archived sequence, secondary
    accession, nothing. Returns ``(identifier, json, sequence, outcome)``.
    """
    direct = headers.join(entries.withColumnRenamed("accession", "identifier"), "identifier", "left").withColumn(
        "_e", entry_struct("json")
    )
    inactive = F.contains(F.coalesce("_e.entryType", F.lit("")), F.lit("Inactive"))
    target = F.when(
        inactive & (F.col("_e.inactiveReason.inactiveReasonType") == "MERGED"),
        F.get(F.col("_e.inactiveReason.mergeDemergeTo"), 0),
    )
    # most rows have no merge target or archive id: spread their empty keys
    step = direct.select(
        "identifier", "json", inactive.alias("_inactive"), spread_nulls(target, "identifier").alias("_target"),
        spread_nulls(F.col("_e.extraAttributes.uniParcId"), "identifier").alias("_parc"),
    )
    merged = entries.filter(~F.contains(F.coalesce(F.get_json_object("json", "$.entryType"), F.lit("")), F.lit("Inactive")))
    step = step.join(merged.select(F.col("accession").alias("_target"), F.col("json").alias("_merged")), "_target", "left")
    step = step.join(archive.select(F.col("uniparc_id").alias("_parc"), F.col("sequence").alias("_seq")), "_parc", "left")
    old = secondary.groupBy("secondary_accession").agg(F.min("json").alias("_old"))
    step = step.join(old.withColumnRenamed("secondary_accession", "identifier"), "identifier", "left")
    active = F.col("json").isNotNull() & ~F.col("_inactive")
    outcome = (
        F.when(active, "active")
        .when(F.col("_merged").isNotNull(), "merged")
        .when(F.col("json").isNotNull() & F.col("_seq").isNotNull(), "archived")
        .when(F.col("json").isNull() & F.col("_old").isNotNull(), "secondary")
        .otherwise("deleted")
    )
    return step.select(
        "identifier",
        F.when(active, F.col("json")).when(F.col("_merged").isNotNull(), F.col("_merged"))
        .when(F.col("json").isNull(), F.col("_old")).alias("json"),
        F.when(outcome == "archived", F.col("_seq")).alias("sequence"),
        outcome.alias("outcome"),
    )


def entry_annotations(resolved: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Annotation-table columns of resolved entries (all text)."""
    names = names or SOURCE_FIELDS["uniprot"]
    parsed = resolved.withColumn("_e", entry_struct("json"))
    cols = []
    for n in names:
        value = F.when(F.col("json").isNotNull(), as_text(n, PROPERTIES[n](F.col("_e")))).otherwise(F.lit(""))
        if n == "sequence":
            value = F.coalesce("sequence", value)
        elif n == "length":
            value = F.when(F.col("sequence").isNotNull(), F.length("sequence").cast("string")).otherwise(value)
        cols.append(value.alias(n))
    return parsed.select("identifier", *cols)


def merge_sources(
    base: DataFrame,
    taxonomy: DataFrame | None = None,
    matches: DataFrame | None = None,
    domains: DataFrame | None = None,
    predictions: DataFrame | None = None,
) -> DataFrame:
    """Left joins in fixed precedence; a later source replaces same-named columns."""
    from .align import overlay_left

    out = base
    if taxonomy is not None:
        ranks = [c for c in taxonomy.columns if c != "taxon_id"]
        out = out.drop(*[r for r in ranks if r in out.columns]).withColumn(
            "_taxon", spread_nulls(F.col("organism_id").try_cast("int").cast("string"), "identifier")
        ).join(
            taxonomy.withColumn("_taxon", F.col("taxon_id").cast("string")).drop("taxon_id"), "_taxon", "left"
        ).drop("_taxon")
    for extra in (matches, domains, predictions):
        if extra is not None:
            out = overlay_left(out, extra)
    return out


def finish_annotations(
    merged: DataFrame, requested: list[str], enzyme_names: DataFrame | None = None, clans: DataFrame | None = None
) -> DataFrame:
    """Field transforms, then the requested columns with the identifier first.

    ``enzyme_names(code, name)`` and ``clans(accession, clan)`` are joined in.
    """
    done = transform_annotations(merged)
    if enzyme_names is not None or clans is not None:
        done = cut_lineage(done)  # read once here, joined back below
    if enzyme_names is not None and "ec" in done.columns:
        done = done.drop("ec").join(name_items(done.select("identifier", "ec"), enzyme_names, "code", "name", cell_col="ec"), "identifier", "left")
    if clans is not None and "pfam" in done.columns:
        done = done.drop("pfam_clan").join(clans_by_join(done.select("identifier", "pfam"), clans), "identifier", "left")
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in done.columns else F.lit("").alias(c) for c in requested]
    return done.select("identifier", *cols)


def taxon_counts(annotations: DataFrame) -> DataFrame:
    ids = annotations.select(F.col("organism_id").try_cast("int").alias("taxon_id")).filter("taxon_id is not null")
    return ids.groupBy("taxon_id").agg(F.count("*").alias("n"))
