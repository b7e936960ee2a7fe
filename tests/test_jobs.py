import json

import numpy as np
from pyspark.sql import functions as F

from atlasmill import cli
from atlasmill.model import ReducerParams
from atlasmill.operators.embed import composition
from atlasmill.plans.prepare import PrepareRequest, prepare, run_log
from atlasmill.sources import bundle
from atlasmill.streaming.resume import embed_incremental


def write_vectors(spark, path, ids, dim=6, seed=0):
    rows = []
    for i in ids:
        rng = np.random.default_rng([seed, *i.encode()])
        rows.append((i, [float(v) for v in rng.normal(size=dim)]))
    spark.createDataFrame(rows, "identifier string, vec array<float>").write.mode("overwrite").parquet(path)
    return path


def test_prepare(spark, tmp_path):
    ids = [f"x{n:02d}" for n in range(30)]
    a = write_vectors(spark, str(tmp_path / "a.parquet"), ids[:20])
    b = write_vectors(spark, str(tmp_path / "b.parquet"), ids[10:])
    c = write_vectors(spark, str(tmp_path / "c.parquet"), ids[5:], dim=4, seed=1)
    meta = spark.createDataFrame(
        [(i, "fam|EXP" if n % 2 else "", "MKTAYIAKQR", "s") for n, i in enumerate(ids)],
        "identifier string, protein_families string, sequence string, note string",
    )
    custom = tmp_path / "c.csv"
    custom.write_text("id,note,extra\nx05,new,e\n")
    hits = spark.createDataFrame([("x05", "x06", 0.9), ("x05", "x05", 1.0)], "query string, target string, fident double")
    request = PrepareRequest(
        inputs=[f"{a}:prot_t5", f"{b}:prot_t5", f"{c}:other"],
        methods=["pca2,pca3,ppca2:ppca_mode=annotation;background_annotation=protein_families,nothing2"],
        output=str(tmp_path / "out"), annotations=meta, custom_tables=[str(custom)], similarity_hits=hits,
        iterations={"mds": 2}, no_scores=True, bundled=True, cache=str(tmp_path / "cache"),
        styles={"protein_families": {"colors": {"fam": "#FF0000"}}},
    )
    report = prepare(spark, request)
    assert report["rows"] == 25 and report["skipped"] == ["nothing", "nothing"] and len(report["projections"]) == 7
    ann, info, data, settings = bundle.read_tables(spark, request.output)
    assert ann.columns == ["protein_id", "protein_families", "note", "extra"]
    got = {r["protein_id"]: tuple(r)[1:] for r in ann.collect()}
    assert got["x05"] == ("fam", "new", "e") and got["x06"] == ("", "", "")
    assert data.groupBy("projection_name").count().filter("count <> 25").count() == 0
    assert data.filter("projection_name = 'ProtT5 — PCA 3' and z is null").count() == 0
    assert settings["protein_families"]["categories"]["fam"]["color"] == "#FF0000"
    log = {r["projection_name"]: r for r in run_log(spark, request.output).collect()}
    assert log["ProtT5 — PPCA 2"]["background_mode"] == "annotation" and log["ProtT5 — PPCA 2"]["n_background"] == 13
    parts, packed = bundle.read_parts(report["bundle"])
    assert len(parts) == 3 and packed == settings
    again = prepare(spark, request)
    assert again["projections"] == report["projections"]


def test_prepare_needs_common_ids(spark, tmp_path):
    import pytest

    a = write_vectors(spark, str(tmp_path / "a.parquet"), ["a", "b"])
    b = write_vectors(spark, str(tmp_path / "b.parquet"), ["c", "d"])
    with pytest.raises(ValueError, match="No common"):
        prepare(spark, PrepareRequest([f"{a}:x", f"{b}:y"], ["pca2"], str(tmp_path / "o")))


def test_benchmark_command(spark, tmp_path):
    ids = [f"x{n:02d}" for n in range(20)]
    a = write_vectors(spark, str(tmp_path / "a.parquet"), ids)
    labels = str(tmp_path / "labels.parquet")
    rows = [(i, "even" if n % 2 == 0 else "odd" if n < 19 else "rare") for n, i in enumerate(ids)] + [("absent", "even"), ("x00", None)]
    spark.createDataFrame(rows, "identifier string, family string").write.parquet(labels)
    out = str(tmp_path / "bench")
    assert cli.main(["benchmark", "-i", f"{a}:m", "-l", labels, "--label-col", "family", "-m", "pca,nothing", "-k", "3", "--min-class-size", "2", "-o", out]) == 0
    found = {(r["method"], r["metric"]): r["value"] for r in spark.read.csv(f"{out}/metrics.csv", header=True, inferSchema=True).collect()}
    assert {m for _, m in found} == {"trustworthiness", "silhouette", "knn_accuracy", "seconds", "error"} and ("nothing", "error") in found
    assert 0.5 < found["pca", "trustworthiness"] <= 1 and 0 <= found["pca", "knn_accuracy"] <= 1
    placed = spark.read.parquet(f"{out}/projections_data.parquet").collect()
    assert {r["identifier"] for r in placed} == set(ids) - {"x19"}


def test_command_line(spark, tmp_path, capsys):
    ids = [f"x{n:02d}" for n in range(12)]
    a = write_vectors(spark, str(tmp_path / "a.parquet"), ids)
    table = tmp_path / "t.csv"
    table.write_text("id,kind\n" + "".join(f"{i},k{n % 3}|5\n" for n, i in enumerate(ids)))
    out = str(tmp_path / "out")
    assert cli.main(["prepare", "-i", f"{a}:m", "-m", "pca2", "-a", str(table), "-o", out, "--no-bundled"]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == 12
    cli.main(["style", out, "--styles", json.dumps({"kind": {"pinnedValues": ["__REST__"], "maxVisibleValues": 2}})])
    cli.main(["style", out, "--dump"])
    assert list(json.loads(capsys.readouterr().out)["kind"]["categories"]) == ["k0", "k1"]
    cli.main(["style", out, "--template"])
    assert "k2" in json.loads(capsys.readouterr().out)["kind"]["colors"]
    cli.main(["inspect", out])
    assert "selected_annotations" in capsys.readouterr().out
    cli.main(["bundle", out, "-o", str(tmp_path / "b.parquetbundle")])
    assert bundle.count_entries(str(tmp_path / "b.parquetbundle")) == 12
    cli.main(["project", "-i", f"{a}:m", "-m", "pca2,pca3", "-o", str(tmp_path / "proj")])
    assert spark.read.parquet(str(tmp_path / "proj" / "projections_data.parquet")).count() == 24
    fasta = tmp_path / "f.fasta"
    fasta.write_text(">sp|P12345|X\nMKT\n>b\nACD\n")
    cli.main(["annotate", "-i", str(fasta), "-a", "default,pfam", "-o", str(tmp_path / "ann")])
    assert spark.read.parquet(str(tmp_path / "ann")).count() == 2


def test_incremental_embedding(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("src", "dst", "chk"))
    put = lambda rows: spark.createDataFrame(rows, "identifier string, sequence string").coalesce(1).write.mode("append").parquet(source)
    put([("a", "MKT"), ("a", "MKT"), ("b", "ACDE")])
    embed_incremental(spark, source, target, check, composition(4))
    assert spark.read.parquet(target).count() == 2
    put([("b", "ZZZZ"), ("c", "GGG")])
    embed_incremental(spark, source, target, check, composition(4))
    got = spark.read.parquet(target)
    assert sorted(r[0] for r in got.select("identifier").collect()) == ["a", "b", "c"]
    assert got.filter(F.col("identifier") == "b").count() == 1


def test_params_reach_the_command_line():
    args = cli.build_parser().parse_args(["project", "-i", "x", "-m", "pca2", "-o", "o", "--no-standard-scale", "--eps", "0.5"])
    assert cli._params(args) == ReducerParams(standard_scale=False, eps=0.5)


def test_cache_key_follows_the_content(spark):
    from atlasmill.model import MethodSpec, ReducerParams
    from atlasmill.plans.prepare import PrepareRequest, cache_key, fingerprint

    request = PrepareRequest(inputs=["x"], methods=["pca2"], output="o")
    rows = lambda *values: spark.createDataFrame([(str(i), [v]) for i, v in enumerate(values)], "identifier string, vec array<float>")
    key = lambda df: cache_key(request, "s", MethodSpec("pca", 2), ReducerParams(), [fingerprint(df)])
    assert key(rows(1.0, 2.0)) == key(rows(1.0, 2.0).repartition(3)) != key(rows(1.0, 3.0))


def test_entries_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    from atlasmill.plans import text_queries

    rows = [(k, f"name {k}", "Brand#1", "TYPE", k % 50) for k in range(100)]
    parts = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = text_queries.entry_properties(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r["mass"] for r in out.collect()} == {str(3 * k) for k in range(100)}
