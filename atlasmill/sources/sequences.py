"""FASTA text in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_identifier, wrap_text
from ..operators.align import first_wins, last_wins


def is_fasta(path: str) -> bool:
    return path.lower().endswith((".fa", ".faa", ".fasta"))


#: Order of records: place of the path in the list, file, split of the file, row in the split.
_ORDER = ["list_idx", "file_path", "split_start", "row_idx"]


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per ``>`` record, split by the reader so large files stay splittable.

    Records are separated by a line break followed by ``>``; gzip is read as is.
    """
    def one(n: int, path: str) -> DataFrame:
        return spark.read.option("lineSep", "\n>").text(path).select(
            F.regexp_replace("value", "^>", "").alias("record"), F.lit(n).alias("list_idx"), "_metadata.file_path",
            F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("row_idx"),
        )

    return reduce(DataFrame.unionByName, [one(n, p) for n, p in enumerate(paths)])


def read_fasta(spark: SparkSession, paths: str | list[str], normalize: bool = False) -> DataFrame:
    """(identifier, sequence): first token of the header, first record of a header
    wins, empty sequences are skipped.

    ``normalize`` maps headers to accessions; then the later duplicate wins, as
    normalised headers overwrite each other.
    """
    paths = [paths] if isinstance(paths, str) else paths
    header = F.split_part("record", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"[ \t\r\f]*\n[ \t\r\f]*", "")
    rows = _records(spark, paths).select(
        F.regexp_extract(header, r"^\s*(\S+)", 1).alias("identifier"), F.trim(F.regexp_replace(body, r"\s+$", "")).alias("sequence"),
        *_ORDER,
    ).filter("identifier <> '' and sequence <> ''")
    out = first_wins(rows, "identifier", _ORDER)
    if normalize:
        out = last_wins(out.withColumn("identifier", parse_identifier("identifier")), "identifier", _ORDER)
    return out.select("identifier", "sequence")


def read_fasta_ids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Normalised header ids, duplicates kept."""
    lines = spark.read.text(paths)
    return lines.filter(F.col("value").startswith(">")).select(
        parse_identifier(F.regexp_extract("value", r"^>\s*(\S+)", 1)).alias("identifier")
    )


def fasta_lines(df: DataFrame, width: int | None = 80) -> DataFrame:
    """One text value per record, sequence wrapped."""
    body = wrap_text("sequence", width) if width else F.col("sequence")
    return df.select(F.concat(F.lit(">"), "identifier", F.lit("\n"), body).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int | None = 80) -> None:
    fasta_lines(df, width).write.mode("overwrite").text(path)


def read_signal_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated feature table -> (identifier, sequence, sp_start, sp_end) for
    rows with exactly one clean signal feature."""
    from ..functions.scalars import signal_bounds

    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(
        F.col("Entry").alias("identifier"), F.col("Sequence").alias("sequence"), signal_bounds("`Signal peptide`").alias("b")
    ).filter("b is not null").select("identifier", "sequence", "b.*")


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """Distinct accessions of ``SP|acc|...`` lines, sorted."""
    parts = F.split("value", r"\|")
    return (
        spark.read.text(path)
        .filter(F.upper(F.substring("value", 1, 3)) == "SP|")
        .select(parts[1].alias("identifier"))
        .distinct()
        .orderBy("identifier")
    )
