"""Scalar string, missing-value and sequence expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings treated as "not set" by the truthy selector.
FALSY_SPELLINGS = ["", "0", "<n/a>", "false", "n/a", "na", "nan", "no", "none", "null"]
# Spellings shown as <N/A> (case-sensitive).
DISPLAY_MISSING = ["", "NA", "NaN", "nan", "none", "null"]
# Labels that style settings treat as the missing category.
STYLE_MISSING = ["", "<NA>", "NaN", "__NA__"]
MISSING_DISPLAY = "<N/A>"
MISSING_KEY = "__NA__"
# Public UniProt accession grammar.
ACCESSION = r"[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2}"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_identifier(key: Column | str) -> Column:
    """Accession of an ``sp|ACC|NAME`` / ``tr|ACC|NAME`` key, else the second
    pipe field, else the key itself."""
    key = as_col(key)
    accession = F.regexp_extract(key, rf"^(?:sp|tr)\|({ACCESSION})\|", 1)
    return F.when(accession != "", accession).when(
        F.contains(key, F.lit("|")), F.split_part(key, F.lit("|"), F.lit(2))
    ).otherwise(key)


def is_accession(key: Column | str) -> Column:
    """Whether the whole key is a valid accession."""
    return as_col(key).rlike(rf"^(?:{ACCESSION})$")


def normalize_value(value: Column | str) -> Column:
    """NULL (and a floating NaN already rendered as NULL) becomes '', rest is trimmed."""
    return F.trim(F.coalesce(as_col(value).cast("string"), F.lit("")))


def is_truthy(value: Column | str) -> Column:
    return ~F.lower(normalize_value(value)).isin(FALSY_SPELLINGS)


def value_in(value: Column | str, allowed: list[str]) -> Column:
    return F.lower(normalize_value(value)).isin([a.strip().lower() for a in allowed])


def standardize_missing(value: Column | str) -> Column:
    text = as_col(value).cast("string")
    return F.when(text.isNull() | text.isin(DISPLAY_MISSING), F.lit(MISSING_DISPLAY)).otherwise(text)


def safe_identifier(identifier: Column | str) -> Column:
    """Everything but letters, digits and ``._-`` becomes an underscore."""
    return F.regexp_replace(as_col(identifier), r"[^\p{L}\p{N}._-]", "_")


def strip_keyword_code(keyword: Column | str) -> Column:
    """``KW-0123 (Name)`` -> ``Name``; other text is only trimmed."""
    text = F.trim(as_col(keyword))
    at = F.instr(text, "(")
    inner = F.trim(F.substr(text, at + 1, F.length(text) - at - 1))
    return F.when((at > 0) & F.endswith(text, F.lit(")")), inner).otherwise(text)


def is_valid_label(label: Column | str) -> Column:
    text = F.trim(as_col(label).cast("string"))
    return as_col(label).isNotNull() & (text != "") & (F.lower(text) != "nan")


def sequence_digest(sequence: Column | str) -> Column:
    """Upper-case MD5, the join key of the domain match service."""
    return F.upper(F.md5(as_col(sequence).cast("binary")))


def clean_residues(sequence: Column | str) -> Column:
    """Upper-case a sequence, spell rare residues as X."""
    return F.regexp_replace(F.upper(as_col(sequence)), "[BJOUZ]", "X")


def space_residues(sequence: Column | str, prefix: str = "") -> Column:
    """Blank-separated residues, with the optional model prefix in front."""
    spaced = F.trim(F.regexp_replace(clean_residues(sequence), "(.)", "$1 "))
    return F.concat(F.lit(prefix + " "), spaced) if prefix else spaced


def wrap_text(sequence: Column | str, width: int = 80) -> Column:
    """FASTA body: a line break after every ``width`` characters."""
    return F.regexp_replace(as_col(sequence), f"(.{{{width}}})(?=.)", "$1\n")


def natural_sort_key(text: Column | str) -> Column:
    """Sortable text in which ``a2`` precedes ``a10``.

    Digit runs lose leading zeros, get their length in front (ten digits, which
    any string's length fits, so longer runs sort later) and letters are lower-cased.
    """
    pieces = F.regexp_extract_all(F.lower(as_col(text)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def piece_key(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(pieces, piece_key), "")


def signal_bounds(feature: Column | str) -> Column:
    """``struct(sp_start, sp_end)`` when exactly one clean ``SIGNAL a..b`` exists, else NULL."""
    feature = as_col(feature)
    pattern = r"SIGNAL\s+(\d+)\.\.(\d+)"
    starts = F.regexp_extract_all(feature, F.lit(pattern), F.lit(1))
    ends = F.regexp_extract_all(feature, F.lit(pattern), F.lit(2))
    return F.when(
        F.size(starts) == 1,
        F.struct(starts[0].cast("int").alias("sp_start"), ends[0].cast("int").alias("sp_end")),
    )


def mature_sequence(sequence: Column | str, sp_end: Column | str) -> Column:
    """What remains after the signal peptide."""
    return F.substr(as_col(sequence), as_col(sp_end) + 1)


def segment_outcome(sequence: Column, start: Column, end: Column, min_length: int) -> Column:
    """Slice ``[start, end)`` of a sequence and say why a row is unusable.

    Returns ``struct(reason, segment)``; reason is ``ok``, ``missing_sequence``,
    ``bad_coordinates`` or ``short``. Coordinates may be any castable text;
    they are truncated toward zero. The end is clamped to the sequence.
    """
    first = F.floor(F.expr("0")) if start is None else _whole(start)
    last = _whole(end)
    seq = normalize_value(sequence)
    piece = F.substr(seq, first + 1, F.least(last, F.length(seq)) - first)
    piece = squeeze_segment(piece)
    return (
        F.when(seq == "", _outcome("missing_sequence"))
        .when(
            first.isNull() | last.isNull() | (first < 0) | (last <= first) | (first >= F.length(seq)),
            _outcome("bad_coordinates"),
        )
        .when(F.length(piece) < min_length, _outcome("short"))
        .otherwise(F.struct(F.lit("ok").alias("reason"), piece.alias("segment")))
    )


def squeeze_segment(piece: Column) -> Column:
    return F.upper(F.regexp_replace(piece, r"\s+", ""))


def _whole(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("int")


def _outcome(reason: str) -> Column:
    return F.struct(F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("segment"))
