"""Queries of the text operators: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chunk_dedup,
    decontaminate,
    language_id,
    lexical_search,
    line_dedup,
    quality_classifier,
    quality_rules,
    records,
    sentencepiece_codec,
    sharding,
    simhash,
    toxicity,
    vector_codes,
)
from .common import read


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines removed from every document as cross-site boilerplate, and the text that is left."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "source")
    text = F.col("text")
    out = line_dedup.clean_lines(docs, extra={"n_removed": F.coalesce(F.size("bad"), F.lit(0)).cast("bigint")})
    return out.select("doc_id", "n_removed", F.length(text).cast("bigint").alias("n_chars_left"), F.md5(text).alias("text_md5"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op3_fertility_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts, tokeniser fertility and verdict of every document."""
    return quality_rules.judge(read(spark, folder, "documents"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Number and checksum of every document's piece ids, and whether decoding them gives the text back."""
    done = sentencepiece_codec.decode(sentencepiece_codec.encode(read(spark, folder, "documents")))
    return done.select("doc_id", "n_tokens", "ids_crc32", (F.md5("text") == F.col("version")).alias("round_trip"))


def op5_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from framed record files."""
    return records.read_records(*records.write_records(read(spark, folder, "documents")))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of good quality for every document."""
    return quality_classifier.score(read(spark, folder, "documents"), read(spark, folder, "labels")).drop("version")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identify(read(spark, folder, "documents"))


def op8_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage that repeats an earlier one: its bytes, words and first occurrence."""
    return chunk_dedup.repeated_spans(read(spark, folder, "documents")).drop("version")


def op9_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.assign_shards(read(spark, folder, "documents"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontaminate.report(decontaminate.hits(read(spark, folder, "documents"), read(spark, folder, "benchmark")))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector, the error of its label and the digest of the codebooks."""
    return vector_codes.encode(read(spark, folder, "embeddings")).drop("label")


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Chance that a document is toxic, for every document."""
    return toxicity.score(read(spark, folder, "documents"), read(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_simhash, op3_fertility_rules, op4_sentencepiece, op5_token_records, op6_quality_classifier,
                            op7_language_id, op8_chunk_dedup, op9_sampled_splitters, op10_decontaminate, op11_lexical_search, op12_vector_codes,
                            op13_toxicity)
}


def _codes_sql() -> str:
    """Two rounds of learning and the final assignment, a component a row."""
    rounds = []
    for k in range(vector_codes.ROUNDS + 1):
        rounds.append(f"""
        apart{k} AS (SELECT c.vec_id, c.p, b.e, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM parts c JOIN book{k} b USING (p, j) GROUP BY ALL),
        owner{k} AS (SELECT vec_id, p, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM apart{k} GROUP BY ALL),
        mean{k} AS (SELECT p, e, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM parts JOIN owner{k} USING (vec_id, p) GROUP BY ALL),
        book{k + 1} AS (SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (p, e, j))""")
    last = vector_codes.ROUNDS
    return f"""
        WITH kept AS (
            SELECT vec_id, label, [CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
            WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
        ), parts AS (
            SELECT vec_id, (i - 1) // (len(v) // 16) AS p, (i - 1) % (len(v) // 16) AS j, x
            FROM (SELECT vec_id, v, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i FROM kept)
        ), first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
        book0 AS (SELECT p, e, j, x FROM parts JOIN first USING (vec_id)), {",".join(rounds)},
        coded AS (
            SELECT vec_id, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM owner{last} GROUP BY vec_id
        ), hashed AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book{last}),
        by_label AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label)
        SELECT c.vec_id, c.code, c.error, l.label_error, h.codebooks_sha256
        FROM coded c JOIN kept k USING (vec_id) JOIN by_label l ON l.label IS NOT DISTINCT FROM k.label, hashed h"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op11_lexical_search": f"""
        WITH docs AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
        sizes AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
        asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL),
        weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), sizes),
        impact AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)) AS i FROM tf, sizes),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(times * w * i) AS BIGINT) AS score FROM asked JOIN weight USING (term) JOIN impact USING (term) GROUP BY ALL
        ), ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op12_vector_codes": _codes_sql(),
    "op1_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos
            FROM documents WHERE text IS NOT NULL
        ), trimmed AS (SELECT doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM lines),
        spread AS (
            SELECT bare, min((doc_id, pos)) AS first_place FROM trimmed WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10
        ), marked AS (
            SELECT t.doc_id, t.line, t.pos, s.bare IS NOT NULL AND (t.doc_id, t.pos) <> s.first_place AS gone
            FROM trimmed t LEFT JOIN spread s ON t.bare = s.bare
        ), cleaned AS (
            SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(c.n_removed, 0) AS n_removed, length(c.text) AS n_chars_left, md5(c.text) AS text_md5
        FROM documents d LEFT JOIN cleaned c USING (doc_id)""",
    "op10_decontaminate": r"""
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), item_windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item_words WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT n FROM item_windows),
        found AS (
            SELECT x.doc_id, x.i, x.n, iw.item_id
            FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
                  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc_words, sizes WHERE len(w) >= n)) x
            JOIN item_windows iw ON iw.win = x.win AND iw.n = x.n
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
               sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN items t USING (doc_id)""",
}
