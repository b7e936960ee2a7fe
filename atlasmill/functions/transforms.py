"""Per-field annotation clean-up rules, each a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import items, split_last_pipe, with_evidence
from .scalars import as_col


def score_as_integer(value: Column | str) -> Column:
    """``5.0`` -> ``5``; text that is no number is kept."""
    value = as_col(value)
    number = value.try_cast("double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("string")
    return F.coalesce(whole, value)


def first_family(value: Column | str) -> Column:
    """First family name, cut at the first comma (else semicolon), evidence kept."""
    main, evidence = split_last_pipe(as_col(value))
    head = (
        F.when(F.contains(main, F.lit(",")), F.trim(F.substring_index(main, ",", 1)))
        .when(F.contains(main, F.lit(";")), F.trim(F.substring_index(main, ";", 1)))
        .otherwise(main)
    )
    return with_evidence(head, evidence)


def has_structure(value: Column | str) -> Column:
    return F.when(F.trim(F.coalesce(as_col(value), F.lit(""))) != "", F.lit("True")).otherwise(F.lit("False"))


def fragment_flag(value: Column | str) -> Column:
    value = as_col(value)
    return F.when(F.lower(F.trim(value)) == "fragment", F.lit("yes")).otherwise(value)


def null_to_blank(value: Column | str) -> Column:
    return F.coalesce(as_col(value), F.lit(""))


def strip_aspect(value: Column | str) -> Column:
    """Drop the ``F:`` / ``P:`` / ``C:`` prefix of every ontology term."""

    def clean(term: Column) -> Column:
        term = F.trim(term)
        prefixed = (F.length(term) > 2) & (F.substring(term, 2, 1) == ":")
        return F.when(prefixed, F.substr(term, F.lit(3))).otherwise(term)

    return F.array_join(F.transform(items(value), clean), ";")


def name_enzymes(value: Column | str, names: Column) -> Column:
    """Append ``(name)`` to each code found in the map column ``names``; evidence is kept."""
    codes = F.filter(F.transform(items(value), lambda c: F.trim(c)), lambda c: c != "")

    def render(item: Column) -> Column:
        code, evidence = split_last_pipe(item)
        name = F.coalesce(F.try_element_at(names, code), F.lit(""))
        labelled = F.when(name != "", F.concat(code, F.lit(" ("), name, F.lit(")"))).otherwise(code)
        return with_evidence(labelled, evidence)

    return F.array_join(F.transform(codes, render), ";")


def clean_fold_codes(value: Column | str) -> Column:
    """Drop the ``G3DSA:`` prefix and blanks, sort."""
    kept = F.filter(items(value), lambda v: F.trim(v) != "")
    bare = F.transform(kept, lambda v: F.trim(F.replace(v, F.lit("G3DSA:"), F.lit(""))))
    return F.array_join(F.array_sort(bare), ";")


def has_signal_peptide(value: Column | str) -> Column:
    found = F.contains(F.coalesce(as_col(value), F.lit("")), F.lit("SIGNAL_PEPTIDE"))
    return F.when(found, F.lit("True")).otherwise(F.lit("False"))


def family_clans(value: Column | str, clans: Column) -> Column:
    """Sorted distinct clans of all ``PF…`` accessions in a cell; ``clans`` is a map column."""
    accessions = F.regexp_extract_all(F.coalesce(as_col(value), F.lit("")), F.lit(r"(PF\d+)"), F.lit(1))
    found = F.array_compact(F.transform(accessions, lambda a: F.try_element_at(clans, a)))
    return F.array_join(F.array_sort(F.array_distinct(found)), ";")


FIELD_RULES = {
    "annotation_score": score_as_integer,
    "cath": clean_fold_codes,
    "cc_subcellular_location": null_to_blank,
    "fragment": fragment_flag,
    "go_bp": strip_aspect,
    "go_cc": strip_aspect,
    "go_mf": strip_aspect,
    "pfam": null_to_blank,
    "protein_families": first_family,
    "signal_peptide": has_signal_peptide,
    "xref_pdb": has_structure,
}


def transform_annotations(
    df: DataFrame, enzyme_names: Column | None = None, clan_names: Column | None = None
) -> DataFrame:
    """Apply the rule of every field that is present, in one projection."""
    changes = {c: rule(c) for c, rule in FIELD_RULES.items() if c in df.columns}
    if enzyme_names is not None and "ec" in df.columns:
        changes["ec"] = name_enzymes("ec", enzyme_names)
    if clan_names is not None and "pfam" in df.columns:
        changes["pfam_clan"] = family_clans("pfam", clan_names)
    return df.withColumns(changes)
