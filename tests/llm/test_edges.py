"""Every operator on odd rows, on an empty table, and on rows whose extra columns clash with working names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from atlasmill.llm import chunk_dedup, decontaminate, language_id, line_dedup, quality_classifier, quality_rules, records, sentencepiece_codec, sharding, simhash


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_line_dedup(odd, none):
    out = line_dedup.clean_lines(odd, min_sites=2)
    assert out.columns == odd.columns and ids(out) == ids(odd)
    text = {(r["doc_id"], r["source"]): r["text"] for r in out.collect()}
    assert text[1, "a"] and text[2, None] == "" and text[None, "b"] == "" and text[None, None] is None  # the first occurrence stays
    assert text[7, "e"] == [r["text"] for r in odd.where("doc_id = 7").collect()][0]
    assert out.where("text = '' and doc_id = 2").first()["n_chars"] == 0
    assert line_dedup.clean_lines(none).collect() == [] and line_dedup.clean_lines(none).columns == odd.columns


def test_simhash(odd, none):
    out = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert {c for (_, f), c in out.items() if f == "0" * 16} == {3}
    assert {c for (d, _), c in out.items() if d in (1, 2)} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id is null").count() == 0
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).collect() == []


def test_no_id_at_all(odd):
    lone = odd.where("doc_id is null")
    assert {r["component_id"] for r in simhash.near_duplicates(lone).collect()} == {None}
    assert simhash.keep_one(lone).count() == 2


def test_quality_rules(odd, none):
    out = quality_rules.judge(odd)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd.count() and got[4]["n_words"] == 0 and got[4]["base_failed"] and not got[4]["kept"]
    assert got[5]["n_words"] == got[5]["n_dup_lines"] == 0 and got[8]["n_words"] == 120_000 and got[9]["word_chars"] == 200_000
    assert quality_rules.judge(none).collect() == []
    assert quality_rules.judge(odd.drop("lang")).count() == odd.count()


def test_codec(odd, none):
    done = sentencepiece_codec.decode(sentencepiece_codec.encode(odd))
    assert done.count() == odd.count() and done.where(F.md5("text") != F.col("version")).count() == 0
    assert {r["n_tokens"] for r in done.where("doc_id = 4").collect()} == {0}
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(none)).collect() == []


def test_records(odd, none):
    out = records.read_records(*records.write_records(odd)).collect()
    assert len(out) == odd.count() and sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)
    by = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] or 0 for r in by] == sorted(r["doc_id"] or 0 for r in out) and by[0]["doc_id"] is None
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(by, by[1:], strict=False))
    assert records.read_records(*records.write_records(none)).collect() == []


def test_classifier(odd, none, labels):
    out = quality_classifier.score(odd, labels)
    got = out.collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert quality_classifier.score(none, labels).collect() == []
    assert {round(r["score"], 6) for r in quality_classifier.score(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality_classifier.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_language(odd, none):
    got = {(r["doc_id"]): r for r in language_id.identify(odd).collect()}
    assert len(language_id.identify(odd).collect()) == odd.count()
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[7]["lang_pred"] != "und"
    assert language_id.identify(none).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_chunks(odd, none):
    spans = chunk_dedup.repeated_spans(odd)
    assert {r["doc_id"] for r in spans.collect()} <= {2, None, 8, 9}
    out = chunk_dedup.remove_repeated(odd)
    assert out.columns == odd.columns and ids(out) == ids(odd) and out.where("doc_id = 1 and text = ''").count() == 0
    assert chunk_dedup.repeated_spans(none).collect() == [] and chunk_dedup.remove_repeated(none).collect() == []


def test_shards(odd, none, spark, tmp_path):
    out = sharding.assign_shards(odd)
    assert out.count() == odd.count() and {r["text_crc32"] for r in out.where("size = 8").collect()} == {0}
    assert sharding.assign_shards(none).collect() == []
    sharding.write_shards(odd, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).drop("_shard").count() == odd.count()


def test_decontaminate(odd, none, items):
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.report(decontaminate.hits(odd, items)).collect()}
    assert got[6, 2]["n_hit"] == 2 and got[6, 2]["n_items"] == 1 and not got[4, 0]["contaminated"]
    assert got[1, 180]["n_hit"] >= 20
    for block in (1, 3):
        again = {(r["doc_id"], r["n_words"]): r for r in decontaminate.report(decontaminate.hits(odd, items, block=block)).collect()}
        assert again == got
    out = decontaminate.decontaminate(odd, items)
    assert out.columns == odd.columns and out.where("doc_id = 6").count() == 0 and out.where("doc_id in (4, 5)").count() == 2
    assert decontaminate.report(decontaminate.hits(none, items)).collect() == [] and decontaminate.decontaminate(none, items).collect() == []
    assert decontaminate.report(decontaminate.hits(odd, items.limit(0))).where("contaminated").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, odd, none, labels, items, tmp_path, k):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (odd, none):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == docs.columns
        assert out.count() <= docs.count()


def test_items_without_an_id_and_windows_of_many_items(spark, odd):
    """Passages of items without an id are hit and cut, but not listed; a window that a third of the items share lists them all."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[:30]) + " c d"), (2, "x " + " ".join(words[25:40])), (None, " ".join(words[:12])), (3, "clean text")],
                                 "doc_id bigint, text string")
    unnamed = spark.createDataFrame([(None, " ".join(words[:30]))], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(decontaminate.hits(docs, unnamed)).collect()}
    assert got[1]["n_hit"] == 30 and got[1]["n_items"] == 0 and got[1]["contaminated"] and got[None]["n_hit"] == 12 and not got[3]["contaminated"]
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, unnamed, drop_share=1.0).collect()}
    assert left[1] == "a b  c d"
    many = spark.createDataFrame([(i, " ".join(words[28:40]) + (f" tail{i}" if i % 2 else "")) for i in range(200)] + [(500 + i, f"other {i} item") for i in range(400)],
                                 "item_id bigint, text string")
    for block in (200_000, 60):
        found = {r["doc"]: r for r in decontaminate.hits(docs, many.unionByName(unnamed), block=block).collect()}
        assert found[2]["items"] == sorted(str(i) for i in range(200)) and found[1]["items"] == []
