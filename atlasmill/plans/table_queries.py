"""Alignment, join, aggregate, style and view queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import align, annotate, metrics, style, view
from ..sources import tables as table_io
from ..sources.bundle import annotations_output
from ..sources.vectors import first_rows, inspect_vectors, similarity_edges, subset_limit
from .registry import query, r6, table

# ------------------------------------------------------------------ alignment


@query("first_wins", """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events)
  SELECT user_id, event_id, event_type, value FROM r WHERE nth = 1""")
def first_wins(spark, d):
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return align.first_wins(ev, "user_id", ["ts", "event_id"]).drop("ts")


@query("last_wins", """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS nth FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE nth = 1""")
def last_wins(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return align.last_wins(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])


@query("duplicate_report", """
  SELECT count(*) AS n_unique, cast(sum(c) AS bigint) AS n_rows, cast(sum(c - 1) AS bigint) AS n_duplicates
  FROM (SELECT text, count(*) AS c FROM documents GROUP BY text)""")
def duplicate_report(spark, d):
    return align.duplicate_report(table(spark, d, "documents"), "text")


def _two_sets(spark, d) -> tuple[DataFrame, DataFrame]:
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("identifier"), F.col("embedding").alias("vec"))
    return emb.filter("identifier % 3 <> 0"), emb.filter("identifier % 3 <> 1")


@query("clean_vectors", """
  SELECT vec_id AS identifier, round(list_sum(embedding::double[]), 6) AS total FROM embeddings WHERE vec_id % 10 NOT IN (3, 7)""")
def clean_vectors(spark, d):
    emb = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("identifier"),
        F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 5))
        .when(F.col("vec_id") % 10 == 7, F.transform("embedding", lambda v: F.lit("NaN").cast("float")))
        .otherwise(F.col("embedding")).alias("vec"),
        F.lit(0).alias("file_idx"), F.col("vec_id").alias("row_idx"),
    )
    again = emb.withColumns({"file_idx": F.lit(1), "vec": F.transform("vec", lambda v: v + F.lit(1.0).cast("float"))})
    kept = align.clean_vectors(emb.unionByName(again))
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return kept.select("identifier", r6(total).alias("total"))


@query("union_same_name", """
  SELECT vec_id AS identifier, round(list_sum(embedding::double[]), 6) AS total FROM embeddings""")
def union_same_name(spark, d):
    a, b = _two_sets(spark, d)
    both = a.withColumn("set_idx", F.lit(0)).unionByName(b.withColumn("set_idx", F.lit(1))).withColumn("row_idx", F.col("identifier"))
    merged = align.union_same_name(both)
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda x, v: x + v)
    return merged.select("identifier", r6(total).alias("total"))


@query("intersect_sets", """
  SELECT vec_id AS identifier FROM embeddings WHERE vec_id % 3 = 2
    AND vec_id IN (SELECT doc_id FROM documents) AND vec_id IN (SELECT doc_id FROM labels)""")
def intersect_sets(spark, d):
    a, b = _two_sets(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("identifier"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("identifier"))
    return align.intersect_ids([a.select("identifier"), b, docs, labels])


@query("missing_headers_anti", """
  SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_headers_anti(spark, d):
    return align.missing_ids(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("paired_inner", """
  SELECT count(*) FILTER (WHERE vec_id % 3 = 2) AS n_pairs, count(*) FILTER (WHERE vec_id % 3 = 0) AS missing_full,
         count(*) FILTER (WHERE vec_id % 3 = 1) AS missing_mature FROM embeddings""")
def paired_inner(spark, d):
    from ..operators.linalg import pairing_report

    a, b = _two_sets(spark, d)
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("identifier"))
    return pairing_report(ids, a, b)


# ------------------------------------------------------------------ joins


@query("merge_lineage", """
  SELECT c_custkey, coalesce(n_name, '') AS species, coalesce(r_name, '') AS kingdom
  FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END
  LEFT JOIN region ON r_regionkey = n_regionkey""")
def merge_lineage(spark, d):
    cust = table(spark, d, "customer").select(
        F.col("c_custkey").alias("identifier"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("unknown")).otherwise(F.col("c_nationkey").cast("string")).alias("organism_id"),
    )
    lineage = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("taxon_id"), F.col("n_name").alias("species"), F.col("r_name").alias("kingdom")
    )
    merged = annotate.merge_sources(cust, taxonomy=lineage)
    return merged.select(
        F.col("identifier").alias("c_custkey"), F.coalesce("species", F.lit("")).alias("species"), F.coalesce("kingdom", F.lit("")).alias("kingdom")
    )


@query("taxon_counts", """
  SELECT c_nationkey AS taxon_id, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1""")
def taxon_counts(spark, d):
    cust = table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_nationkey").cast("string")).alias("organism_id")
    )
    return annotate.taxon_counts(cust)


@query("overlay_csv_wins", """
  SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN NULL ELSE concat('q', cast(l.quality AS varchar)) END AS source, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def overlay_csv_wins(spark, d):
    base = table(spark, d, "documents").select("doc_id", "lang", "source")
    extra = table(spark, d, "labels").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"), "toxic"
    )
    return align.overlay_left(base, extra, "doc_id", ["toxic", "source"])


@query("outer_merge_csv", """
  SELECT coalesce(e.vec_id, l.doc_id) AS doc_id, l.quality AS label, l.toxic
  FROM embeddings e FULL JOIN labels l ON l.doc_id = e.vec_id""")
def outer_merge_csv(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    b = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    return align.overlay_outer(a, b, "doc_id")


@query("headers_left_join", """
  SELECT e.vec_id AS identifier, coalesce(cast(l.quality AS varchar), '') AS quality, coalesce(cast(l.toxic AS varchar), '') AS toxic
  FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id""")
def headers_left_join(spark, d):
    headers = table(spark, d, "embeddings").select(F.col("vec_id").alias("identifier"))
    return align.attach_to_headers(headers, table(spark, d, "labels").withColumnRenamed("doc_id", "identifier"))


@query("md5_match", """
  WITH r AS (SELECT upper(md5(text)) AS md5, min(doc_id) AS first_id FROM documents WHERE lang <> 'de' GROUP BY 1)
  SELECT d.doc_id, r.first_id FROM documents d JOIN r ON r.md5 = upper(md5(d.text))""")
def md5_match(spark, d):
    docs = table(spark, d, "documents")
    keyed = docs.select("doc_id", scalars.sequence_digest("text").alias("md5"))
    results = docs.filter("lang <> 'de'").groupBy(scalars.sequence_digest("text").alias("md5")).agg(F.min("doc_id").alias("first_id"))
    return keyed.join(results, "md5").select("doc_id", "first_id")


@query("digest_or_name_match", """
  WITH r AS (SELECT DISTINCT sha256(text) AS h, length(text) AS v FROM documents WHERE doc_id % 2 = 0)
  SELECT cast(d.doc_id AS varchar) AS identifier, coalesce(cast(r.v AS varchar), CASE WHEN d.doc_id % 3 = 0 THEN d.lang END) AS value
  FROM documents d LEFT JOIN r ON r.h = sha256(d.text)""")
def digest_or_name_match(spark, d):
    docs = table(spark, d, "documents").withColumn("identifier", F.col("doc_id").cast("string"))
    by_hash = docs.filter("doc_id % 2 = 0").select(
        F.sha2(F.col("text").cast("binary"), 256).alias("result_key"), F.length("text").cast("string").alias("value")
    ).distinct()
    by_name = docs.filter("doc_id % 3 = 0").select(F.col("identifier").alias("result_key"), F.col("lang").alias("value"))
    headers = docs.select("identifier", F.col("text").alias("sequence"))
    return annotate.match_by_sequence(headers, by_hash.unionByName(by_name))


@query("seq_dedup_fanout", """
  WITH u AS (SELECT text, min(doc_id) AS representative, count(*) AS copies FROM documents GROUP BY text)
  SELECT d.doc_id, u.representative, u.copies, length(d.text) AS n FROM documents d JOIN u ON u.text = d.text""")
def seq_dedup_fanout(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("identifier"), F.col("text").alias("sequence"))
    work = align.unique_sequences(docs).withColumn("n", F.length("sequence").cast("bigint"))
    return align.fan_out(work, docs).select(F.col("identifier").alias("doc_id"), "representative", "copies", "n")


@query("batch_ids", """
  SELECT doc_id, cast(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) AS bigint) AS batch FROM documents""")
def batch_ids(spark, d):
    return align.batch_ids(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("resume_anti", """
  SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def resume_anti(spark, d):
    done = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return align.remaining(table(spark, d, "documents").select("doc_id"), done, "doc_id")


@query("similarity_edges", """
  WITH h AS (SELECT l_suppkey AS a, l_partkey AS b, max(l_discount) AS s FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2),
  k AS (SELECT least(a, b) AS x, greatest(a, b) AS y, max(s) AS sim FROM h
        WHERE a IN (SELECT s_suppkey FROM supplier) AND b IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2)
  SELECT cast(x AS varchar) AS i, cast(y AS varchar) AS j, sim FROM k UNION ALL SELECT cast(y AS varchar), cast(x AS varchar), sim FROM k""")
def similarity_edges_query(spark, d):
    hits = table(spark, d, "lineitem").filter("l_suppkey <> l_partkey").select(
        F.concat(F.lit("x|"), F.col("l_suppkey").cast("string")).alias("query"), F.col("l_partkey").cast("string").alias("target"),
        F.col("l_discount").alias("fident"),
    )
    # numeric order of the pair, as the SQL has it
    known = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("identifier"))
    return similarity_edges(hits, known)


# ------------------------------------------------------------------ grouped cells

@query("group_scores_by_accession", """
  WITH m AS (SELECT l_orderkey AS id, l_returnflag AS db, p_brand AS acc, CASE WHEN l_linenumber % 2 = 0 THEN p_type ELSE '' END AS name,
      CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE cast(cast(l_quantity AS integer) AS varchar) END AS score,
      l_linenumber * 100000000 + l_suppkey * 10000 + l_partkey AS pos
    FROM lineitem JOIN part ON p_partkey = l_partkey),
  a AS (SELECT id, db, acc, string_agg(score, ',' ORDER BY pos, score) FILTER (WHERE score <> '') AS scores,
      first(name ORDER BY pos, name) FILTER (WHERE name <> '') AS label FROM m GROUP BY 1, 2, 3)
  SELECT id AS l_orderkey, db, string_agg(concat(acc, coalesce(' (' || label || ')', ''), coalesce('|' || scores, '')), ';' ORDER BY acc) AS cell
  FROM a GROUP BY 1, 2""")
def group_scores_by_accession(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = joined.select(
        "l_orderkey", F.col("l_returnflag").alias("db"), F.col("p_brand").alias("accession"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("p_type")).otherwise("").alias("name"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("score"),
        (F.col("l_linenumber") * F.lit(100000000) + F.col("l_suppkey") * 10000 + F.col("l_partkey")).alias("pos"),
    )
    return annotate.group_scores(rows, "l_orderkey")


@query("match_documents", """
  SELECT cast(d.doc_id AS varchar) AS identifier, concat('PF', cast(length(d.text) AS varchar), ' (', m.lang, ')|', cast(length(d.text) % 50 AS varchar), '.5,7.0') AS pfam,
         concat('SM', m.lang) AS smart
  FROM documents d LEFT JOIN (SELECT text, min(lang) AS lang FROM documents GROUP BY text) m ON m.text = d.text""")
def match_documents(spark, d):
    docs = table(spark, d, "documents")
    one = docs.groupBy("text").agg(F.min("lang").alias("lang"))
    sig = lambda acc, name, lib: F.struct(acc.alias("accession"), name.alias("name"), F.struct(F.lit(lib).alias("library")).alias("signatureLibraryRelease"))
    hit = lambda s, score: F.struct(s.alias("signature"), score.cast("string").alias("score"))
    pf = F.concat(F.lit("PF"), F.length("text").cast("string"))
    none = F.lit(None).cast("string")
    payload = F.struct(
        F.md5(F.col("text").cast("binary")).alias("md5"), F.lit(True).alias("found"),
        F.array(
            hit(sig(pf, none, "Pfam"), F.concat((F.length("text") % 50).cast("string"), F.lit(".5"))),
            hit(sig(pf, F.col("lang"), "PFAM"), F.lit("7.0")),
            hit(sig(F.concat(F.lit("SM"), "lang"), none, "smart"), none),
            hit(sig(F.lit("X1"), none, "unlisted"), none),
        ).alias("matches"),
    )
    seqs = docs.select(F.col("doc_id").cast("string").alias("identifier"), F.col("text").alias("sequence"))
    wide = annotate.domain_match_annotations(one.select(F.to_json(payload).alias("doc")), seqs)
    return wide.select("identifier", "pfam", "smart")


@query("taxonomy_ranks", """
  SELECT n_nationkey AS taxon_id, 'cellular' AS root, r_name AS domain, concat('K', r_name) AS kingdom, '' AS phylum, n_name AS species
  FROM nation JOIN region ON r_regionkey = n_regionkey""")
def taxonomy_ranks(spark, d):
    pair = lambda rank, name: F.struct(F.lit(rank).alias("rank"), name.alias("scientificName"))
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    doc = F.struct(
        F.col("n_nationkey").alias("taxonId"), F.lit("species").alias("rank"), F.col("n_name").alias("scientificName"),
        F.array(
            pair("no rank", F.lit("cellular")),
            F.when(F.col("n_nationkey") % 2 == 0, pair("realm", F.col("r_name"))).otherwise(pair("domain", F.col("r_name"))),
            pair("kingdom", F.concat(F.lit("K"), "r_name")),
        ).alias("lineage"),
    )
    ranks = annotate.taxonomy_ranks(joined.select(F.to_json(doc).alias("doc")))
    return ranks.select("taxon_id", "root", "domain", "kingdom", "phylum", "species")


@query("structure_domains", """
  SELECT p_partkey AS identifier, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE concat(
      CASE WHEN n_name IS NULL THEN cast(p_size AS varchar) ELSE concat(cast(p_size AS varchar), ' (', n_name, ')') END, '|', cast(p_size AS varchar), '.3;unclassified|88.0') END AS ted_domains
  FROM part LEFT JOIN nation ON n_nationkey = p_size""")
def structure_domains(spark, d):
    doc = F.struct(F.when(F.col("p_partkey") % 10 != 0, F.array(
        F.struct(F.lit(1).alias("ted_domain_no"), F.col("p_size").cast("string").alias("cath_label"), (F.col("p_size") + 0.25001).alias("plddt")),
        F.struct(F.lit(2).alias("ted_domain_no"), F.lit("-").alias("cath_label"), F.lit(88.0).alias("plddt")),
    )).alias("annotations"))
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("identifier"), F.to_json(doc).alias("doc"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return annotate.structure_domains(docs, names)


@query("predictions_wide", """
  SELECT doc_id AS identifier, lang AS predicted_subcellular_location, '' AS predicted_membrane,
    CASE WHEN contains(text, 'S') THEN 'True' ELSE 'False' END AS predicted_signal_peptide,
    CASE WHEN regexp_matches(text, '[Hh]') AND regexp_matches(text, '[Bb]') THEN 'alpha-helical;beta-barrel'
         WHEN regexp_matches(text, '[Hh]') THEN 'alpha-helical' WHEN regexp_matches(text, '[Bb]') THEN 'beta-barrel'
         ELSE 'none' END AS predicted_transmembrane
  FROM documents""")
def predictions_wide(spark, d):
    docs = table(spark, d, "documents")
    pick = lambda model, value, pos: docs.select(F.col("doc_id").alias("identifier"), F.lit(model).alias("model_name"), F.col(value).alias("value"), F.lit(pos).alias("pos"))
    rows = pick("LightAttentionSubcellularLocalization", "lang", 0).unionByName(
        pick("LightAttentionSubcellularLocalization", "source", 1)
    ).unionByName(pick("TMbed", "text", 2))
    return annotate.predictions_wide(rows)


@query("inherit_fold_names", """
  WITH c AS (SELECT concat('1.10.', cast(p_size AS varchar), '.', cast(p_partkey AS varchar)) AS code, concat('1.10.', cast(p_size AS varchar)) AS parent,
      CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name FROM part),
  t AS (SELECT parent AS code, concat('T', parent) AS name FROM c WHERE parent <> '1.10.7' GROUP BY 1)
  SELECT code, name FROM t UNION ALL SELECT code, name FROM c WHERE name <> ''
  UNION ALL SELECT c.code, t.name FROM c JOIN t ON t.code = c.parent WHERE c.name = ''""")
def inherit_fold_names(spark, d):
    from ..sources.dictionaries import inherit_fold_names as inherit

    p = table(spark, d, "part")
    parent = F.concat(F.lit("1.10."), F.col("p_size").cast("string"))
    leaf = p.select(
        F.concat(parent, F.lit("."), F.col("p_partkey").cast("string")).alias("code"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("name"),
    )
    top = p.select(parent.alias("code")).distinct().filter("code <> '1.10.7'").select("code", F.concat(F.lit("T"), "code").alias("name"))
    return inherit(top.unionByName(leaf))


@query("enzyme_dictionary", """
  SELECT coalesce(p_brand, s) AS code, coalesce(e, c) AS name FROM
    (SELECT p_brand, min(p_name) AS e FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) x
    FULL JOIN (SELECT p_brand AS s, max(p_type) AS c FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) y ON x.p_brand = y.s""")
def enzyme_dictionary(spark, d):
    from ..sources.dictionaries import enzyme_dictionary as overlay

    p = table(spark, d, "part")
    enzymes = p.filter("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("code")).agg(F.min("p_name").alias("name"))
    classes = p.filter("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("code")).agg(F.max("p_type").alias("name"))
    return overlay(classes, enzymes)


@query("resolve_entries", """
  WITH h AS (SELECT s_suppkey AS k, concat('A', cast(s_suppkey AS varchar)) AS identifier FROM supplier)
  SELECT identifier,
    CASE k % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'merged' WHEN 2 THEN 'archived' WHEN 3 THEN 'secondary' ELSE 'deleted' END AS outcome,
    CASE WHEN k % 5 = 0 THEN cast(k AS varchar) WHEN k % 5 = 1 THEN cast(k - 1 AS varchar) WHEN k % 5 = 3 THEN 'old' ELSE '' END AS protein_name,
    CASE WHEN k % 5 = 2 THEN concat('SEQ', cast(k AS varchar)) ELSE '' END AS sequence
  FROM h""")
def resolve_entries(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").withColumn("accession", F.concat(F.lit("A"), k.cast("string")))
    name = F.struct(F.struct(k.cast("string").alias("fullName")).alias("recommendedName")).alias("proteinDescription")
    active = F.to_json(F.struct(F.lit("UniProtKB reviewed").alias("entryType"), name))
    gone = lambda kind, to: F.to_json(F.struct(
        F.lit("Inactive").alias("entryType"), F.struct(F.concat(F.lit("UPI"), k.cast("string")).alias("uniParcId")).alias("extraAttributes"),
        F.struct(F.lit(kind).alias("inactiveReasonType"), to.alias("mergeDemergeTo")).alias("inactiveReason"),
    ))
    before = F.array(F.concat(F.lit("A"), (k - 1).cast("string")))
    entries = s.filter(k % 5 <= 2).select("accession", F.when(k % 5 == 0, active).when(k % 5 == 1, gone("MERGED", before)).otherwise(
        gone("DELETED", F.lit(None).cast("array<string>"))).alias("json"))
    archive = s.filter(k % 5 == 2).select(F.concat(F.lit("UPI"), k.cast("string")).alias("uniparc_id"), F.concat(F.lit("SEQ"), k.cast("string")).alias("sequence"))
    old = F.to_json(F.struct(F.lit("reviewed").alias("entryType"), F.struct(F.struct(F.lit("old").alias("fullName")).alias("recommendedName")).alias("proteinDescription")))
    secondary = s.filter(k % 5 == 3).select(F.col("accession").alias("secondary_accession"), old.alias("json"))
    resolved = annotate.resolve_entries(s.select(F.col("accession").alias("identifier")), entries, archive, secondary)
    wide = annotate.entry_annotations(resolved, ["protein_name", "sequence"])
    return wide.join(resolved.select("identifier", "outcome"), "identifier")


# ------------------------------------------------------------------ counts and styles

FREQ = """
  WITH u AS (SELECT 'kind' AS annotation, concat(p_type, ';', p_brand, '|', cast(p_size AS varchar)) AS cell FROM part
    UNION ALL SELECT 'size', CASE WHEN p_size % 9 = 0 THEN '' ELSE concat('s', cast(p_size AS varchar)) END FROM part
    UNION ALL SELECT 'name', CASE WHEN p_size % 11 = 0 THEN '<NA>' ELSE p_name END FROM part),
  f AS (SELECT annotation, split_part(v, '|', 1) AS value, count(*) AS n FROM (SELECT annotation, unnest(string_split(cell, ';')) AS v FROM u) GROUP BY 1, 2)
"""


def _annotation_table(spark, d) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select(
        "p_partkey",
        F.concat("p_type", F.lit(";"), "p_brand", F.lit("|"), size).alias("kind"),
        F.when(F.col("p_size") % 9 == 0, "").otherwise(F.concat(F.lit("s"), size)).alias("size"),
        F.when(F.col("p_size") % 11 == 0, "<NA>").otherwise(F.col("p_name")).alias("name"),
    )


@query("value_frequencies", FREQ + "SELECT annotation, value, n FROM f")
def value_frequencies(spark, d):
    return style.value_frequencies(_annotation_table(spark, d))


@query("lineitem_value_frequencies", """
  SELECT 'flag' AS annotation, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2
  UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'pair', v, count(*) FROM (SELECT unnest([l_returnflag, cast(l_linenumber AS varchar)]) AS v FROM lineitem) GROUP BY 2""")
def lineitem_value_frequencies(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("flag"), F.concat("l_linestatus", F.lit("|EXP")).alias("status"),
        F.concat("l_returnflag", F.lit(";"), F.col("l_linenumber").cast("string"), F.lit("|9")).alias("pair"),
    )
    return style.value_frequencies(li)


ZORDER = FREQ + """
  SELECT annotation, value, n, cast(row_number() OVER (PARTITION BY annotation
    ORDER BY CASE WHEN value IN ('', '<NA>', 'NaN') THEN 1 ELSE 0 END, {order}) - 1 AS integer) AS zorder FROM f"""


@query("zorder_size_desc", ZORDER.format(order="n DESC, value"))
def zorder_size_desc(spark, d):
    return style.zorder(style.value_frequencies(_annotation_table(spark, d)), "size-desc")


@query("zorder_size_asc", ZORDER.format(order="n, value"))
def zorder_size_asc(spark, d):
    return style.zorder(style.value_frequencies(_annotation_table(spark, d)), "size-asc")


@query("zorder_alpha_asc", ZORDER.format(order="value"))
def zorder_alpha_asc(spark, d):
    return style.zorder(style.value_frequencies(_annotation_table(spark, d)), "alpha-asc")


@query("zorder_alpha_desc", ZORDER.format(order="value DESC"))
def zorder_alpha_desc(spark, d):
    return style.zorder(style.value_frequencies(_annotation_table(spark, d)), "alpha-desc")


@query("style_template", FREQ + """
  SELECT annotation, value, CASE WHEN value IN ('', '<NA>', 'NaN') THEN '#C0C0C0' ELSE '' END AS color,
    cast(row_number() OVER (PARTITION BY annotation ORDER BY n DESC, value) - 1 AS integer) AS position FROM f""")
def style_template(spark, d):
    return style.style_template(style.value_frequencies(_annotation_table(spark, d)))


@query("rest_autofill", FREQ + """,
  pin AS (SELECT annotation, 0 AS slot, value, 0 AS place FROM f WHERE value = 'Brand#7'
    UNION ALL SELECT annotation, 2, min(value), 0 FROM f WHERE value IN ('', '<NA>', 'NaN', '__NA__') GROUP BY 1),
  used AS (SELECT annotation, count(*) AS c FROM pin GROUP BY 1),
  cand AS (SELECT annotation, value, row_number() OVER (PARTITION BY annotation ORDER BY n DESC, value) AS place FROM f
    WHERE value NOT IN ('', '<NA>', 'NaN', '__NA__', 'Brand#7')),
  al AS (SELECT * FROM pin UNION ALL SELECT cand.annotation, 1, value, place FROM cand LEFT JOIN used ON used.annotation = cand.annotation WHERE place <= 6 - coalesce(c, 0))
  SELECT annotation, value, cast(row_number() OVER (PARTITION BY annotation ORDER BY slot, place) - 1 AS integer) AS zorder FROM al""")
def rest_autofill(spark, d):
    return style.rest_autofill(style.value_frequencies(_annotation_table(spark, d)), ["Brand#7", style.REST, ""], 6)


@query("top9_categories", """
  WITH c AS (SELECT [trim(split_part(x, '|', 1)) FOR x IN string_split(concat(p_name, '|1; ', p_brand), ';')] AS v FROM part WHERE p_partkey % 13 <> 0),
  n AS (SELECT value, count(*) AS n FROM (SELECT unnest(v) AS value FROM c) GROUP BY 1),
  r AS (SELECT value, n, cast(row_number() OVER (ORDER BY n DESC, value) - 1 AS integer) AS zorder FROM n)
  SELECT value, n, zorder FROM r WHERE zorder < 9
  UNION ALL SELECT '__NA__', count(*), 9 FROM part WHERE p_partkey % 13 = 0""")
def top9_categories(spark, d):
    cell = F.when(F.col("p_partkey") % 13 == 0, " ;__NA__|3").otherwise(F.concat("p_name", F.lit("|1; "), "p_brand"))
    return style.top_categories(table(spark, d, "part").select(cell.alias("cell")))


@query("label_summary", """
  SELECT count(*) AS n_total, count(quality) AS n_labelled, count(DISTINCT quality) AS n_classes
  FROM documents LEFT JOIN labels USING (doc_id)""")
def label_summary(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return metrics.label_summary(joined, "quality")


@query("min_class_filter", """
  SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) >= 30 THEN p_name END AS label FROM part""")
def min_class_filter(spark, d):
    return metrics.min_class_labels(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("label")), "label", 30)


@query("min_class_rows", """
  SELECT p_partkey, p_name AS label FROM part QUALIFY count(*) OVER (PARTITION BY p_name) >= 30""")
def min_class_rows(spark, d):
    return metrics.min_class_labels(
        table(spark, d, "part").select("p_partkey", F.col("p_name").alias("label")), "label", 30, drop_rows=True
    )


@query("annotation_maps", """
  SELECT doc_id, lang, source, '' AS absent FROM documents""")
def annotation_maps(spark, d):
    maps = table_io.maps_from_wide(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return table_io.wide_from_maps(maps, ["lang", "source", "absent"], "doc_id")


@query("annotation_output", """
  SELECT cast(doc_id AS varchar) AS protein_id, coalesce(lang, '') AS lang, cast(n_chars AS varchar) AS n_chars FROM documents""")
def annotation_output(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("identifier"), "lang", "n_chars", F.col("text").alias("sequence"), F.col("source").alias("organism_id")
    )
    return annotations_output(docs)


@query("length_report", """
  WITH l AS (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) - 1 AS rn, count(*) OVER () AS n FROM documents)
  SELECT max(n) AS n, min(len) AS min_len, max(CASE WHEN rn = n // 2 THEN len END) AS median_len, max(len) AS max_len FROM l""")
def length_report(spark, d):
    return table_io.length_report(table(spark, d, "documents"), "text")


@query("table_sizes", """
  SELECT 'documents' AS dataset, count(*) AS entries FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings
  UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'pages', count(*) FROM pages""")
def table_sizes(spark, d):
    return table_io.table_sizes({n: table(spark, d, n) for n in ("documents", "embeddings", "conversations", "pages")})


@query("mean_pool", """
  SELECT conv_id, round(avg(length(text)), 6) AS mean_chars, round(avg(turn), 6) AS mean_turn FROM conversations GROUP BY 1""")
def mean_pool(spark, d):
    turns = table(spark, d, "conversations").select(
        "conv_id", F.array(F.length("text").cast("double"), F.col("turn").cast("double")).alias("vec")
    )
    pooled = align.mean_pool_rows(turns, "conv_id")
    return pooled.select("conv_id", r6(F.col("vec")[0]).alias("mean_chars"), r6(F.col("vec")[1]).alias("mean_turn"))


@query("mature_lengths", """
  SELECT doc_id, length(substr(text, cast(10 + doc_id % 30 AS integer) + 1)) AS length, source FROM documents""")
def mature_lengths(spark, d):
    docs = table(spark, d, "documents")
    values = docs.select("doc_id", F.length(scalars.mature_sequence("text", F.col("doc_id") % 30 + 10)).cast("bigint").alias("length"))
    base = docs.select("doc_id", F.lit(0).cast("bigint").alias("length"), "source", "lang")
    return align.keep_columns(align.replace_column(base, values, "length", "doc_id"), ["doc_id", "length", "gone", "source"])


@query("inspect_vectors", """
  SELECT count(*) AS entries, min(len(embedding)) AS dim_min, max(len(embedding)) AS dim_max,
         round(min(list_min(embedding))::double, 6) AS value_min, round(max(list_max(embedding))::double, 6) AS value_max FROM embeddings""")
def inspect_vectors_query(spark, d):
    out = inspect_vectors(table(spark, d, "embeddings"), "embedding")
    return out.select("entries", "dim_min", "dim_max", r6("value_min").alias("value_min"), r6("value_max").alias("value_max"))


@query("first_rows", """
  SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT greatest(1, least(300, cast(ceil(0.1 * count(*)) AS bigint))) FROM documents)""")
def first_rows_query(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return first_rows(docs, "doc_id", subset_limit(docs.count(), 0.1, 300))


@query("labels_from_annotations", """
  WITH k AS (SELECT doc_id, [x FOR x IN ['Signal', CASE WHEN doc_id % 3 = 0 THEN 'Toxin' ELSE source END, lang] IF x NOT IN ('Signal', 'Toxin')][1] AS label FROM documents),
  m AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY label) >= 20 THEN label END AS label FROM k)
  SELECT vec_id AS identifier, m.label FROM embeddings LEFT JOIN m ON doc_id = vec_id""")
def labels_from_annotations(spark, d):
    kw = F.concat(
        F.lit("KW-1 (Signal);KW-2 ("), F.when(F.col("doc_id") % 3 == 0, F.lit("Toxin")).otherwise(F.col("source")), F.lit(");"), "lang"
    )
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("identifier"), kw.alias("keyword"))
    headers = table(spark, d, "embeddings").select(F.col("vec_id").alias("identifier"))
    return metrics.labels_from_annotations(docs, headers, min_class_size=20)


@query("pinned_settings", FREQ + """,
  cand AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS place FROM f WHERE annotation = 'name' AND value NOT IN ('', '<NA>', 'NaN', '__NA__')),
  pal AS (SELECT ['#F3C300', '#875692', '#F38400', '#A1CAF1', '#BE0032', '#C2B280', '#008856'] AS c)
  SELECT 'name' AS annotation, value, cast(place AS integer) AS zorder, c[place + 1] AS color, 'circle' AS shape FROM cand, pal WHERE place < 7
  UNION ALL SELECT 'name', '__NA__', 7, '#DDDDDD', 'circle'""")
def pinned_settings(spark, d):
    freq = style.value_frequencies(_annotation_table(spark, d))
    settings = style.build_settings(freq, overrides={"name": {"pinnedValues": [style.REST, ""], "maxVisibleValues": 8}})
    return style.settings_rows(settings, spark)


# ------------------------------------------------------------------ views

PLOT = "SELECT vec_id AS identifier, round(embedding[1]::double, 6) AS x, round(embedding[2]::double, 6) AS y, "


def _points(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("identifier"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
    )


@query("plot_frame", PLOT + """CASE WHEN l.lang IS NULL THEN '<N/A>' ELSE l.lang END AS lang
  FROM embeddings LEFT JOIN documents l ON l.doc_id = vec_id AND l.doc_id % 4 <> 0""")
def plot_frame(spark, d):
    docs = table(spark, d, "documents").filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("identifier"), "lang")
    frame = view.plot_frame(_points(spark, d), docs, "lang")
    return frame.select("identifier", r6("x").alias("x"), r6("y").alias("y"), "lang")


@query("projection_long", """
  WITH p AS (SELECT 'A 2' AS projection_name, cast(vec_id AS varchar) AS identifier, embedding[1] AS x, embedding[2] AS y, NULL::float AS z FROM embeddings
    UNION ALL SELECT 'B 3', cast(vec_id AS varchar), embedding[3], embedding[4], embedding[5] FROM embeddings)
  SELECT projection_name, identifier, round(x::double, 6) AS x, round(y::double, 6) AS y, round(z::double, 6) AS z FROM p""")
def projection_long(spark, d):
    from ..sources.bundle import projection_rows

    emb = table(spark, d, "embeddings").withColumn("identifier", F.col("vec_id"))
    a = projection_rows(emb.withColumn("coords", F.slice("embedding", 1, 2)), "A 2", 2)
    b = projection_rows(emb.withColumn("coords", F.slice("embedding", 3, 3)), "B 3", 3)
    both = a.unionByName(b)
    return both.select("projection_name", "identifier", *[r6(c).alias(c) for c in "xyz"])


@query("bbox", """
  SELECT round(min(embedding[1]::double) * 1.05, 6) AS x_min, round(max(embedding[1]::double) * 1.05, 6) AS x_max,
         round(min(embedding[2]::double) * 1.05, 6) AS y_min, round(max(embedding[2]::double) * 1.05, 6) AS y_max,
         round(min(embedding[3]::double) * 1.05, 6) AS z_min, round(max(embedding[3]::double) * 1.05, 6) AS z_max FROM embeddings""")
def bbox(spark, d):
    box = view.bounding_box(_points(spark, d))
    return box.select(*[r6(c).alias(c) for c in box.columns])


@query("coordinate_range", """
  SELECT label, round(min(embedding[1]::double), 6) AS x_min, round(max(embedding[1]::double), 6) AS x_max,
         round(min(embedding[2]::double), 6) AS y_min, round(max(embedding[2]::double), 6) AS y_max FROM embeddings GROUP BY 1""")
def coordinate_range(spark, d):
    pts = _points(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("identifier"), "label"), "identifier")
    box = view.coordinate_range(pts, ["label"])
    return box.select("label", *[r6(c).alias(c) for c in box.columns if c != "label"])


@query("annotation_values", "SELECT DISTINCT lang AS value FROM documents")
def annotation_values(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return view.AtlasView(docs, None, None).distinct_values("lang")


@query("highlight", "SELECT vec_id AS identifier, round(embedding[1]::double, 6) AS x FROM embeddings WHERE vec_id IN (3, 14, 159)")
def highlight(spark, d):
    return view.highlight(_points(spark, d), [3, 14, 159]).select("identifier", r6("x").alias("x"))


@query("category_legend", """
  WITH v AS (SELECT DISTINCT source AS value FROM documents)
  SELECT value, cast(row_number() OVER (ORDER BY cast(substr(value, 4) AS integer)) - 1 AS integer) AS position FROM v""")
def category_legend(spark, d):
    return view.category_legend(table(spark, d, "documents"), "source").select("value", "position")
