"""Projection of nested protein-entry JSON to annotation columns.

``entry_struct`` parses the JSON text once with an explicit schema; every
property is then a plain nested-field expression over that struct, so Catalyst
prunes the fields nobody asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import with_evidence
from .scalars import as_col

_EVIDENCES = "evidences ARRAY<STRUCT<evidenceCode STRING>>"
_EC = f"ecNumbers ARRAY<STRUCT<value STRING, {_EVIDENCES}>>"
ENTRY_SCHEMA = f"""
  primaryAccession STRING, uniProtkbId STRING, entryType STRING, proteinExistence STRING,
  annotationScore DOUBLE,
  entryAudit STRUCT<firstPublicDate STRING, lastAnnotationUpdateDate STRING,
                    lastSequenceUpdateDate STRING, entryVersion INT>,
  extraAttributes STRUCT<uniParcId STRING>,
  inactiveReason STRUCT<inactiveReasonType STRING, mergeDemergeTo ARRAY<STRING>, deletedReason STRING>,
  organism STRUCT<scientificName STRING, taxonId INT, lineage ARRAY<STRING>>,
  organismHosts ARRAY<STRUCT<scientificName STRING>>,
  genes ARRAY<STRUCT<geneName STRUCT<value STRING>>>,
  proteinDescription STRUCT<flag STRING,
      recommendedName STRUCT<fullName STRING, {_EC}>,
      alternativeNames ARRAY<STRUCT<{_EC}>>>,
  sequence STRUCT<value STRING, length INT, molWeight INT>,
  keywords ARRAY<STRUCT<id STRING, name STRING>>,
  comments ARRAY<STRUCT<commentType STRING,
      subcellularLocations ARRAY<STRUCT<location STRUCT<value STRING, {_EVIDENCES}>>>,
      texts ARRAY<STRUCT<value STRING, {_EVIDENCES}>>>>,
  annotations ARRAY<STRUCT<type STRING, description STRING,
      location STRUCT<start STRUCT<value INT>, `end` STRUCT<value INT>>>>,
  uniProtKBCrossReferences ARRAY<STRUCT<database STRING, id STRING,
      properties ARRAY<STRUCT<key STRING, value STRING>>>>
"""

# Evidence ontology id -> short code.
EVIDENCE_CODES = {
    "ECO:0000244": "COMB",
    "ECO:0000250": "ISS",
    "ECO:0000255": "SAM",
    "ECO:0000256": "SAM",
    "ECO:0000259": "SAM",
    "ECO:0000269": "EXP",
    "ECO:0000303": "TAS",
    "ECO:0000305": "IC",
    "ECO:0000312": "IMP",
    "ECO:0000313": "IEA",
    "ECO:0007669": "IEA",
    "ECO:0007744": "HDA",
}
# Strongest evidence first.
EVIDENCE_ORDER = ["EXP", "HDA", "IDA", "TAS", "NAS", "IC", "ISS", "SAM", "COMB", "IMP", "IEA"]


def entry_struct(json_text: Column | str) -> Column:
    return F.from_json(as_col(json_text), ENTRY_SCHEMA)


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def short_code(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EVIDENCE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def best_evidence(codes: Column) -> Column:
    """Strongest short code of an array of ontology ids; an unranked list gives
    its first code, no list gives ''."""
    short = F.transform(codes, lambda c: short_code(F.coalesce(c, F.lit(""))))
    order = F.array(*[F.lit(c) for c in EVIDENCE_ORDER])
    ranked = F.get(F.filter(order, lambda c: F.array_contains(short, c)), 0)
    return F.coalesce(ranked, F.get(short, 0), F.lit(""))


def _evidence(evidences: Column) -> Column:
    return best_evidence(F.transform(evidences, lambda e: e["evidenceCode"]))


def _features(e: Column, kind: str) -> Column:
    return F.filter(e["annotations"], lambda f: f["type"] == kind)


def _span(feature: Column) -> Column:
    loc = feature["location"]
    return F.concat_ws("-", loc["start"]["value"].cast("string"), loc["end"]["value"].cast("string"))


def _spans(kind: str) -> Callable[[Column], Column]:
    return lambda e: F.transform(_features(e, kind), _span)


def _sites(kind: str) -> Callable[[Column], Column]:
    return lambda e: F.transform(
        _features(e, kind),
        lambda f: F.create_map(f["location"]["start"]["value"], _blank(f["description"])),
    )


def _xrefs(e: Column, database: str) -> Column:
    return F.filter(e["uniProtKBCrossReferences"], lambda x: x["database"] == database)


def _property(xref: Column, key: str) -> Column:
    hit = F.filter(xref["properties"], lambda p: p["key"] == key)
    return _blank(F.element_at(F.when(F.size(hit) > 0, hit), -1)["value"])


def go_terms(e: Column) -> Column:
    return F.transform(
        _xrefs(e, "GO"),
        lambda x: F.struct(
            _blank(x["id"]).alias("id"),
            _property(x, "GoTerm").alias("term"),
            _property(x, "GoEvidenceType").alias("evidence"),
        ),
    )


def _go_aspect(aspect: str) -> Callable[[Column], Column]:
    return lambda e: F.transform(
        F.filter(go_terms(e), lambda t: t["term"].startswith(f"{aspect}:")),
        lambda t: with_evidence(t["term"], F.substring_index(t["evidence"], ":", 1)),
    )


def _reviewed(e: Column) -> Column:
    kind = F.lower(_blank(e["entryType"]))
    yes = F.contains(kind, F.lit("swiss-prot")) | (
        F.contains(kind, F.lit("reviewed")) & ~F.contains(kind, F.lit("unreviewed"))
    )
    return F.when(yes, F.lit("Swiss-Prot")).otherwise(F.lit("TrEMBL"))


def _locations(e: Column) -> Column:
    comments = F.filter(e["comments"], lambda c: c["commentType"] == "SUBCELLULAR LOCATION")
    places = F.flatten(F.transform(comments, lambda c: F.coalesce(
        F.transform(c["subcellularLocations"], lambda s: s["location"]),
        F.array().cast(f"array<struct<value:string,evidences:array<struct<evidenceCode:string>>>>"),
    )))
    named = F.filter(places, lambda p: _blank(p["value"]) != "")
    return F.transform(named, lambda p: with_evidence(p["value"], _evidence(p["evidences"])))


def _families(e: Column) -> Column:
    comments = F.filter(e["comments"], lambda c: c["commentType"] == "SIMILARITY")
    texts = F.flatten(F.filter(F.transform(comments, lambda c: c["texts"]), lambda t: t.isNotNull()))
    first = F.get(texts, 0)
    name = F.substring_index(F.regexp_replace(_blank(first["value"]), "^Belongs to the ", ""), ".", 1)
    return F.when(first.isNotNull(), with_evidence(name, _evidence(first["evidences"]))).otherwise(F.lit(""))


def _enzyme_codes(e: Column) -> Column:
    empty = F.array().cast("array<struct<value:string,evidences:array<struct<evidenceCode:string>>>>")
    desc = e["proteinDescription"]
    others = F.flatten(F.transform(desc["alternativeNames"], lambda a: F.coalesce(a["ecNumbers"], empty)))
    codes = F.concat(F.coalesce(desc["recommendedName"]["ecNumbers"], empty), F.coalesce(others, empty))
    return F.transform(codes, lambda c: with_evidence(_blank(c["value"]), _evidence(c["evidences"])))


def _protein_name(e: Column) -> Column:
    full = e["proteinDescription"]["recommendedName"]["fullName"]
    # fullName may be an object {"value": ...} or plain text
    return _blank(F.when(full.startswith("{"), F.get_json_object(full, "$.value")).otherwise(full))


PROPERTIES: dict[str, Callable[[Column], Column]] = {
    "annotation_score": lambda e: F.coalesce(e["annotationScore"], F.lit(0.0)),
    "cc_subcellular_location": _locations,
    "date_created": lambda e: _blank(e["entryAudit"]["firstPublicDate"]),
    "date_modified": lambda e: _blank(e["entryAudit"]["lastAnnotationUpdateDate"]),
    "date_sequence_modified": lambda e: _blank(e["entryAudit"]["lastSequenceUpdateDate"]),
    "ec": _enzyme_codes,
    "entry": lambda e: _blank(e["primaryAccession"]),
    "entry_name": lambda e: _blank(e["uniProtkbId"]),
    "fragment": lambda e: F.when(
        F.contains(_blank(e["proteinDescription"]["flag"]), F.lit("Fragment")), F.lit("fragment")
    ).otherwise(F.lit("")),
    "ft_disulfid": _spans("Disulfide bond"),
    "ft_glycosylation": _sites("Glycosylation"),
    "ft_lipidation": _sites("Lipidation"),
    "ft_mod_res": _sites("Modified residue"),
    "ft_non_adj": _spans("Non-adjacent residues"),
    "ft_non_std": lambda e: F.transform(
        _features(e, "Non-standard residue"), lambda f: f["location"]["start"]["value"]
    ),
    "ft_non_ter": lambda e: F.get(_features(e, "Non-terminal residue"), 0)["location"]["start"]["value"],
    "ft_signal": lambda e: _blank(F.get(_spans("Signal")(e), 0)),
    "gene_name": lambda e: _blank(F.get(e["genes"], 0)["geneName"]["value"]),
    "gene_primary": lambda e: _blank(F.get(e["genes"], 0)["geneName"]["value"]),
    "go": go_terms,
    "go_bp": _go_aspect("P"),
    "go_cc": _go_aspect("C"),
    "go_id": lambda e: F.transform(go_terms(e), lambda t: t["id"]),
    "go_mf": _go_aspect("F"),
    "keyword": lambda e: F.transform(
        e["keywords"], lambda k: F.concat(_blank(k["id"]), F.lit(" ("), _blank(k["name"]), F.lit(")"))
    ),
    "keyword_id": lambda e: F.transform(e["keywords"], lambda k: _blank(k["id"])),
    "length": lambda e: F.coalesce(e["sequence"]["length"], F.lit(0)),
    "lineage": lambda e: e["organism"]["lineage"],
    "mass": lambda e: F.coalesce(e["sequence"]["molWeight"], F.lit(0)),
    "organism_id": lambda e: F.coalesce(e["organism"]["taxonId"], F.lit(0)),
    "organism_name": lambda e: _blank(e["organism"]["scientificName"]),
    "protein_existence": lambda e: _blank(e["proteinExistence"]),
    "protein_families": _families,
    "protein_name": _protein_name,
    "reviewed": _reviewed,
    "sequence": lambda e: _blank(e["sequence"]["value"]),
    "uniparc_id": lambda e: _blank(e["extraAttributes"]["uniParcId"]),
    "uniprot_kb_id": lambda e: _blank(e["uniProtkbId"]),
    "version": lambda e: F.coalesce(e["entryAudit"]["entryVersion"], F.lit(0)),
    "virus_hosts": lambda e: F.transform(e["organismHosts"], lambda h: _blank(h["scientificName"])),
    "xref_pdb": lambda e: F.transform(_xrefs(e, "PDB"), lambda x: x["id"]),
    "xref_proteomes": lambda e: F.transform(_xrefs(e, "Proteomes"), lambda x: _blank(x["id"])),
}
TEXT_LISTS = {
    "cc_subcellular_location", "ec", "ft_disulfid", "ft_non_adj", "ft_non_std", "go_bp", "go_cc", "go_id",
    "go_mf", "keyword", "keyword_id", "lineage", "virus_hosts", "xref_pdb", "xref_proteomes",
}


def as_text(name: str, value: Column) -> Column:
    """Annotation-table form: lists joined by ``;``, nothing becomes ''."""
    if name in TEXT_LISTS:
        return _blank(F.array_join(value.cast("array<string>"), ";"))
    if name in {"ft_glycosylation", "ft_lipidation", "ft_mod_res", "go"}:
        return _blank(F.to_json(value))
    return _blank(value.cast("string"))


def select_properties(
    df: DataFrame, json_column: str, names: list[str], id_column: str = "identifier", text: bool = True
) -> DataFrame:
    """One row per entry with the requested properties as columns."""
    unknown = [n for n in names if n not in PROPERTIES]
    if unknown:
        raise ValueError(f"unknown properties: {', '.join(unknown)}")
    parsed = df.withColumn("_entry", entry_struct(json_column))
    e = F.col("_entry")
    build = (lambda n: as_text(n, PROPERTIES[n](e))) if text else (lambda n: PROPERTIES[n](e))
    return parsed.select(id_column, *[build(n).alias(n) for n in names])
