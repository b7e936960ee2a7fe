"""Reference dictionaries in their public flat formats."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _versions(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Complete versions below ``path``, oldest first: folder and the second it was published."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.ready")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
    named = sorted((m.getPath().getName(), m.getModificationTime() / 1000) for m in found)
    return [(f"{path}/{name.removesuffix('.ready')}", at) for name, at in named]


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], max_age_days: float = 7.0) -> DataFrame:
    """A dictionary kept as Parquet; rebuilt when older than ``max_age_days``.

    Each build is a folder of its own below ``path``, published by a mark written last, so the copy in use is never touched
    and an interrupted build is never read. When the rebuild fails a stale copy is used if there is one. The version before
    the newest is kept for those that still read it; older ones are deleted.
    """
    ready = _versions(spark, path)
    if ready and time.time() - ready[-1][1] < max_age_days * 86400:
        return spark.read.parquet(ready[-1][0])
    fresh = f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    file = spark._jvm.org.apache.hadoop.fs.Path
    try:
        build().write.parquet(fresh)
        mark = file(f"{fresh}.ready")
        files = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.create(mark).close()
    except Exception:  # noqa: BLE001 - fall back to what is there
        if not ready:
            raise
        return spark.read.parquet(ready[-1][0])
    for old, _ in ready[:-1]:
        files.delete(file(f"{old}.ready"), False)
        files.delete(file(old), True)
    return spark.read.parquet(fresh)


def read_enzyme_names(spark: SparkSession, path: str) -> DataFrame:
    """Enzyme flat file (``ID`` / ``DE`` lines, ``//`` between entries) -> (code, name)."""
    entry = spark.read.option("lineSep", "//\n").text(path)
    text = F.concat(F.lit("\n"), "value", F.lit("\n"))
    code = F.trim(F.regexp_extract(text, r"\nID   ([^\n]*)", 1))
    lines = F.transform(F.regexp_extract_all(text, F.lit(r"\nDE   ([^\n]*)"), F.lit(1)), lambda x: F.trim(x))
    name = F.regexp_replace(F.array_join(lines, " "), r"\.$", "")
    return entry.select(code.alias("code"), name.alias("name"), F.size(lines).alias("n")).filter(
        "code <> '' and n > 0"
    ).drop("n")


def read_enzyme_classes(spark: SparkSession, path: str) -> DataFrame:
    """Class list: padded partial codes (``1. 1. -.-   Name.``) -> (code, name)."""
    pattern = r"^([\d\s.\-]+?)\s{2,}(.+)\.\s*$"
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return rows.select(
        F.replace(F.regexp_extract("value", pattern, 1), F.lit(" "), F.lit("")).alias("code"),
        F.trim(F.regexp_extract("value", pattern, 2)).alias("name"),
    ).filter("code <> '' and name <> ''")


def enzyme_dictionary(classes: DataFrame, enzymes: DataFrame) -> DataFrame:
    """Class names overlaid by enzyme names."""
    e = enzymes.withColumnRenamed("name", "_e")
    return classes.join(e, "code", "outer").select("code", F.coalesce("_e", "name").alias("name"))


def read_family_clans(spark: SparkSession, path: str) -> DataFrame:
    """Family-to-clan TSV -> (accession, clan) with clan ``id (name)``; rows without clan skipped."""
    raw = spark.read.csv(path, sep="\t", schema="accession string, clan_id string, clan_name string, short string, description string")
    named = F.coalesce("clan_name", F.lit("")) != ""
    clan = F.when(named, F.concat("clan_id", F.lit(" ("), "clan_name", F.lit(")"))).otherwise(F.col("clan_id"))
    return raw.filter(F.coalesce("clan_id", F.lit("")) != "").select("accession", clan.alias("clan"))


def families_of_clans(spark: SparkSession, path: str, clans: list[str]) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", schema="accession string, clan_id string, clan_name string, short string, description string")
    return raw.filter(F.col("clan_id").isin(clans)).select("clan_id", "accession")


def clan_queries(families: DataFrame, size: int = 100) -> DataFrame:
    """OR-joined search terms in batches of ``size``: (batch, query)."""
    from ..operators.align import batch_ids

    term = F.concat(F.lit("(xref:pfam-"), "accession", F.lit(")"))
    batched = batch_ids(families.select("accession").distinct(), "accession", size)
    return batched.groupBy("batch").agg(F.array_sort(F.collect_list(term)).alias("t")).select(
        "batch", F.array_join("t", " OR ").alias("query")
    )


def read_fold_names(spark: SparkSession, path: str) -> DataFrame:
    """Fold names file -> (code, name); unnamed four-level codes inherit their three-level parent."""
    rows = spark.read.text(path).select(F.trim("value").alias("value")).filter(
        "value <> '' and value not like '#%' and contains(value, ':')"
    )
    head = F.substring_index("value", ":", 1)
    rows = rows.select(
        F.regexp_extract(head, r"^(\S+)", 1).alias("code"),
        F.trim(F.expr("substr(value, locate(':', value) + 1)")).alias("name"),
    )
    return inherit_fold_names(rows)


def inherit_fold_names(rows: DataFrame) -> DataFrame:
    named = rows.filter("name <> ''")
    parents = named.select(F.col("code").alias("_p"), F.col("name").alias("_pn"))
    orphans = rows.filter((F.col("name") == "") & (F.size(F.split("code", r"\.")) == 4)).select(
        "code", F.substring_index("code", ".", 3).alias("_p")
    )
    inherited = orphans.join(parents, "_p").select("code", F.col("_pn").alias("name"))
    return named.select("code", "name").unionByName(inherited)


# Databases whose labels the domain XML supplies.
XML_DATABASES = {"CATHGENE3D": "cath", "PANTHER": "panther", "SSF": "superfamily"}
XML_SCHEMA = (
    "name string, member_list struct<db_xref:array<struct<_db:string,_dbkey:string,_name:string>>>"
)


def read_domain_names(spark: SparkSession, path: str) -> DataFrame:
    """Domain XML (gzip allowed) -> (db, accession, name): own label else the entry's name."""
    docs = spark.read.format("xml").option("rowTag", "interpro").schema(XML_SCHEMA).load(path)
    x = docs.select(F.trim("name").alias("entry"), F.explode("member_list.db_xref").alias("x")).filter(
        F.col("x._db").isin(list(XML_DATABASES))
    )
    table = F.create_map(*[F.lit(v) for p in XML_DATABASES.items() for v in p])
    label = F.coalesce(F.nullif(F.trim("x._name"), F.lit("")), "entry")
    return x.select(
        F.element_at(table, F.col("x._db")).alias("db"), F.col("x._dbkey").alias("accession"), label.alias("name")
    ).filter("coalesce(accession, '') <> '' and coalesce(name, '') <> ''")
