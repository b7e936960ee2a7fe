"""Algebra of multi-valued annotation cells.

A cell is text such as ``acc (name)|score,score;acc2|score``: ``;`` separates
items, ``|`` attaches scores or evidence, ``,`` separates repeated scores and
parentheses carry a display name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import MISSING_KEY, as_col, strip_keyword_code

# Columns whose items may carry ``|score``.
SCORED_COLUMNS = [
    "cath", "cc_subcellular_location", "cdd", "ec", "go_bp", "go_cc", "go_mf", "panther", "pfam",
    "prints", "prosite", "protein_families", "signal_peptide", "smart", "superfamily",
]
# Keywords that name no function.
STRUCTURAL_KEYWORDS = [
    "3D-structure", "Alternative initiation", "Alternative splicing", "Amidation", "Cell membrane",
    "Cleavage on pair of basic residues", "Direct protein sequencing", "Disulfide bond", "Glycoprotein",
    "Hydroxylation", "Lipoprotein", "Membrane", "Phosphoprotein", "Pyrrolidone carboxylic acid",
    "Reference proteome", "Secreted", "Signal", "Toxin", "Transmembrane", "Transmembrane helix",
]
CELL_TYPE = "array<struct<accession:string,name:string,scores:array<string>>>"


def items(cell: Column | str) -> Column:
    return F.split(as_col(cell), ";")


def before_pipe(item: Column) -> Column:
    return F.substring_index(item, "|", 1)


def split_last_pipe(item: Column) -> tuple[Column, Column]:
    """(text, evidence) around the last pipe; evidence is '' when there is none."""
    has = F.contains(item, F.lit("|"))
    evidence = F.when(has, F.substring_index(item, "|", -1)).otherwise(F.lit(""))
    text = F.when(has, F.substr(item, F.lit(1), F.length(item) - F.length(evidence) - 1)).otherwise(item)
    return text, evidence


def with_evidence(text: Column, evidence: Column) -> Column:
    return F.when(evidence != "", F.concat(text, F.lit("|"), evidence)).otherwise(text)


def strip_scores(cell: Column | str) -> Column:
    """Drop every ``|score``; NULL and '' stay as they are."""
    cell = as_col(cell)
    return F.when(cell.isNull() | (cell == ""), cell).otherwise(
        F.array_join(F.transform(items(cell), before_pipe), ";")
    )


def display_values(cell: Column | str) -> Column:
    """Display labels of a cell; blanks are kept as ''."""
    return F.transform(items(cell), before_pipe)


def extract_categories(cell: Column | str) -> Column:
    """Trimmed labels without blanks and without the missing marker."""
    heads = F.transform(items(F.coalesce(as_col(cell), F.lit(""))), lambda p: F.trim(before_pipe(p)))
    return F.filter(heads, lambda h: (h != "") & (h != MISSING_KEY))


def first_functional_keyword(cell: Column | str, stop_words: list[str] | None = None) -> Column:
    """First keyword of the cell that is not in the stop list, else NULL."""
    stops = STRUCTURAL_KEYWORDS if stop_words is None else stop_words
    names = F.transform(items(cell), strip_keyword_code)
    kept = F.filter(names, lambda n: (n != "") & ~n.isin(stops))
    return F.get(kept, 0)


def parse_cell(cell: Column | str) -> Column:
    """Cell text -> array of (accession, name, scores)."""

    def parse(item: Column) -> Column:
        text, tail = split_last_pipe(item)
        named = text.rlike(r"(?s)^.*? \(.*\)$")
        accession = F.when(named, F.regexp_extract(text, r"(?s)^(.*?) \(.*\)$", 1)).otherwise(text)
        name = F.when(named, F.regexp_extract(text, r"(?s)^.*? \((.*)\)$", 1))
        scores = F.when(F.contains(item, F.lit("|")), F.split(tail, ",")).otherwise(
            F.array().cast("array<string>")
        )
        return F.struct(accession.alias("accession"), name.alias("name"), scores.alias("scores"))

    return F.transform(items(cell), parse)


def format_cell(parsed: Column | str) -> Column:
    """Inverse of :func:`parse_cell`."""

    def render(entry: Column) -> Column:
        head = F.when(
            entry["name"].isNotNull(), F.concat(entry["accession"], F.lit(" ("), entry["name"], F.lit(")"))
        ).otherwise(entry["accession"])
        return F.when(
            F.size(entry["scores"]) > 0, F.concat(head, F.lit("|"), F.array_join(entry["scores"], ","))
        ).otherwise(head)

    return F.array_join(F.transform(as_col(parsed), render), ";")


def strip_scores_in(df, columns: list[str] | None = None):
    """Strip scores from every score-bearing column that is present."""
    targets = [c for c in (columns or SCORED_COLUMNS) if c in df.columns]
    return df.withColumns({c: strip_scores(c) for c in targets})


def register_sql_functions(spark) -> None:
    """Expose the cell algebra to SQL text as session functions."""
    bodies = {
        "strip_scores": ("STRING", "array_join(transform(split(cell, ';'), x -> substring_index(x, '|', 1)), ';')"),
        "display_values": ("ARRAY<STRING>", "transform(split(cell, ';'), x -> substring_index(x, '|', 1))"),
    }
    for name, (returns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(cell STRING) RETURNS {returns} RETURN {body}")
