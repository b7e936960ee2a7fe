import json

import pytest
from pyspark.sql import functions as F

from atlasmill.operators import align, annotate, embed, ordering, style, view
from atlasmill.plans.annotate_job import SourceTables, annotate_headers


def vec_df(spark, rows, extra="set_idx int, row_idx int"):
    return spark.createDataFrame(rows, f"identifier string, vec array<double>, {extra}")


def test_union(spark):
    ok = vec_df(spark, [("A", [1.0, 2.0], 0, 0), ("B", [3.0, 4.0], 0, 1), ("B", [3.0, 4.0 + 1e-7], 1, 0), ("C", [5.0, 6.0], 1, 1)])
    got = {r["identifier"]: r["vec"] for r in align.union_same_name(ok).collect()}
    assert got == {"A": [1.0, 2.0], "B": [3.0, 4.0], "C": [5.0, 6.0]}
    again = align.union_same_name(ok.unionByName(ok))
    assert again.count() == 3
    with pytest.raises(Exception, match="conflicting"):
        align.union_same_name(ok.unionByName(vec_df(spark, [("A", [9.0, 9.0], 2, 0)]))).collect()
    with pytest.raises(Exception, match="dimension"):
        align.union_same_name(ok.unionByName(vec_df(spark, [("Z", [9.0], 2, 0)]))).collect()


def test_intersect(spark):
    ids = lambda s: spark.createDataFrame([(c,) for c in s], "identifier string")
    a = align.intersect_ids([ids("ABC"), ids("BCD"), ids("CB")])
    b = align.intersect_ids([ids("BCD"), ids("ABC"), ids("CB")])
    assert sorted(r[0] for r in a.collect()) == ["B", "C"] == sorted(r[0] for r in b.collect())
    with pytest.raises(ValueError):
        align.require_rows(align.intersect_ids([ids("A"), ids("B")]), "none")


def test_overlays(spark):
    base = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "identifier string, k string, l string")
    extra = spark.createDataFrame([("a", "9"), ("a", "8"), ("z", "7")], "identifier string, k string")
    got = {r["identifier"]: (r["k"], r["l"]) for r in align.overlay_left(base, extra, order=["k"]).collect()}
    assert got == {"a": ("8", "x"), "b": (None, "y")}
    got = {r["identifier"]: (r["k"], r["l"]) for r in align.overlay_outer(base, extra.filter("k <> '8'")).collect()}
    assert got == {"a": ("9", "x"), "b": (None, "y"), "z": ("7", None)}
    heads = spark.createDataFrame([("a",), ("q",)], "identifier string")
    got = {r["identifier"]: (r["k"], r["l"]) for r in align.attach_to_headers(heads, base).collect()}
    assert got == {"a": ("1", "x"), "q": ("", "")}


def test_first_last_and_positions(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert sorted(tuple(r) for r in align.first_wins(df, "k", ["o"]).collect()) == [("a", 1, "x"), ("b", 1, "z")]
    assert sorted(tuple(r) for r in align.last_wins(df, "k", ["o"]).collect()) == [("a", 2, "y"), ("b", 1, "z")]
    assert tuple(align.duplicate_report(df, "k").first()) == (2, 3, 1)
    wide = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("s"))
    rows = ordering.position_in_group(wide, ["g"], ["s", "id"]).collect()
    for g in (0, 1):
        mine = sorted((r["s"], r["id"], r["pos"]) for r in rows if r["g"] == g)
        assert [p for _, _, p in mine] == list(range(len(mine)))


def test_embedding_dedup_and_fan_out(spark):
    df = spark.createDataFrame([("a", "MKT"), ("b", "MKT"), ("c", "AC"), ("d", "A" * 50)], "identifier string, sequence string")
    out = {r["identifier"]: r["vec"] for r in embed.embed(df, embed.composition(8), max_length=20).collect()}
    assert set(out) == {"a", "b", "c"} and out["a"] == out["b"] and abs(sum(out["a"]) - 1) < 1e-6
    assert embed.probe(embed.composition(8))["dim"] == 8
    assert embed.resolve_model_key("esm2_8m") == "ESM_8M"
    with pytest.raises(ValueError, match="nearest"):
        embed.resolve_model_key("esm2_8")
    with pytest.raises(ValueError):
        embed.get_model("unregistered")


def test_mean_pool(spark):
    df = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 6.0]])], "identifier string, residues array<array<float>>")
    assert align.mean_pool(df).first()["vec"] == [2.0, 4.0]


MATCH = {
    "md5": "", "found": True, "matches": [
        {"signature": {"accession": "PF00002", "name": "7tm_2", "signatureLibraryRelease": {"library": "Pfam"}}, "score": 60.5},
        {"signature": {"accession": "PF00001", "name": None, "signatureLibraryRelease": {"library": "PFAM"}}, "score": 50.2},
        {"signature": {"accession": "PF00001", "name": "7tm_1", "signatureLibraryRelease": {"library": "Pfam"}}, "score": 52.1},
        {"signature": {"accession": "SSF1", "signatureLibraryRelease": {"library": "SUPERFAMILY"}}},
        {"signature": {"accession": "", "signatureLibraryRelease": {"library": "SMART"}}, "score": 1},
    ],
}


def test_match_documents(spark):
    import hashlib

    doc = dict(MATCH, md5=hashlib.md5(b"MKT").hexdigest().upper())
    docs = spark.createDataFrame([(json.dumps(doc),), (json.dumps({"md5": "x", "found": False}),)], "doc string")
    seqs = spark.createDataFrame([("a", "MKT"), ("b", "MKT"), ("c", "AC")], "identifier string, sequence string")
    names = spark.createDataFrame([("superfamily", "SSF1", "Named")], "db string, accession string, name string")
    got = {r["identifier"]: r for r in annotate.domain_match_annotations(docs, seqs, names).collect()}
    for i in "ab":
        assert got[i]["pfam"] == "PF00001 (7tm_1)|50.2,52.1;PF00002 (7tm_2)|60.5"
        assert got[i]["superfamily"] == "SSF1 (Named)" and got[i]["smart"] == ""
    assert got["c"]["pfam"] == ""


def test_taxonomy(spark):
    docs = [
        {"taxonId": 9606, "rank": "species", "scientificName": "Homo sapiens", "lineage": [{"rank": "no rank", "scientificName": "cellular"}, {"rank": "domain", "scientificName": "Eukaryota"}]},
        {"taxonId": 1, "rank": "no rank", "scientificName": "V", "lineage": [{"rank": "realm", "scientificName": "Riboviria"}, {"rank": "species", "scientificName": "W"}]},
    ]
    rows = annotate.taxonomy_ranks(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")).orderBy("taxon_id").collect()
    assert (rows[1]["species"], rows[1]["domain"], rows[1]["root"], rows[1]["genus"]) == ("Homo sapiens", "Eukaryota", "cellular", "")
    assert (rows[0]["species"], rows[0]["domain"], rows[0]["root"]) == ("W", "Riboviria", "V")


def test_domains_and_predictions(spark):
    docs = spark.createDataFrame(
        [
            ("a", json.dumps({"annotations": [{"ted_domain_no": 1, "cath_label": "2.60", "plddt": 95.12}, {"cath_label": "-", "plddt": 50}, {"cath_label": "9.9", "plddt": 1}]})),
            ("b", "{}"),
        ],
        "identifier string, doc string",
    )
    names = spark.createDataFrame([("2.60", "Ig")], "code string, name string")
    got = {r[0]: r[1] for r in annotate.structure_domains(docs, names).collect()}
    assert got == {"a": "2.60 (Ig)|95.1;unclassified|50.0;9.9|1.0", "b": ""}
    preds = spark.createDataFrame(
        [("a", "TMbed", "SSSHHHiBo", 0), ("a", "LightAttentionMembrane", "Membrane", 1), ("b", "TMbed", "iiio", 0)],
        "identifier string, model_name string, value string, pos int",
    )
    got = {r["identifier"]: r for r in annotate.predictions_wide(preds).collect()}
    assert got["a"]["predicted_signal_peptide"] == "True" and got["a"]["predicted_transmembrane"] == "alpha-helical;beta-barrel"
    assert got["a"]["predicted_membrane"] == "Membrane" and got["a"]["predicted_subcellular_location"] == ""
    assert got["b"]["predicted_signal_peptide"] == "False" and got["b"]["predicted_transmembrane"] == "none"


def test_annotation_job(spark):
    entry = {"entryType": "UniProtKB reviewed", "organism": {"taxonId": 5}, "keywords": [{"id": "KW-1", "name": "T"}],
             "sequence": {"value": "MKT", "length": 3}, "proteinDescription": {"recommendedName": {"ecNumbers": [{"value": "1.1"}]}}}
    entries = spark.createDataFrame([("P12345", json.dumps(entry))], "accession string, json string")
    lineage = spark.createDataFrame([(json.dumps({"taxonId": 5, "rank": "species", "scientificName": "S", "lineage": []}),)], "doc string")
    headers = spark.createDataFrame([("P12345",), ("weird",), ("P99999",)], "identifier string")
    names = spark.createDataFrame([("1.1", "Enz")], "code string, name string")
    broken = spark.createDataFrame([("x",)], "wrong string")
    out, failed = annotate_headers(
        headers, ["ec", "keyword", "species", "length", "ted_domains"],
        SourceTables(entries=entries, lineages=lineage, enzyme_names=names, domains=broken),
    )
    got = {r["identifier"]: r for r in out.collect()}
    assert failed == ["ted"]
    assert (got["P12345"]["ec"], got["P12345"]["keyword"], got["P12345"]["species"]) == ("1.1 (Enz)", "KW-1 (T)", "S")
    assert got["weird"]["ec"] == "" and got["P99999"]["species"] == "" and got["weird"]["ted_domains"] == ""
    cached = spark.createDataFrame([("P12345", "old", "kept")], "identifier string, ec string, keyword string")
    out, _ = annotate_headers(headers, ["ec", "keyword"], SourceTables(entries=entries), cached=cached)
    assert {r["identifier"]: r["ec"] for r in out.collect()}["P12345"] == "old"
    out, _ = annotate_headers(headers, ["ec", "keyword"], SourceTables(entries=entries), cached=cached, refetch=frozenset({"uniprot"}))
    assert {r["identifier"]: r["ec"] for r in out.collect()}["P12345"] == "1.1"


def ann(spark):
    rows = [("1", "PF_A|10"), ("2", "PF_A|10"), ("3", "PF_A|9;PF_C"), ("4", "PF_B|10"), ("5", "PF_B|10"), ("6", "")]
    return spark.createDataFrame(rows, "protein_id string, fam string")


def test_style(spark):
    freq = style.value_frequencies(ann(spark))
    assert {r["value"]: r["n"] for r in freq.collect()} == {"PF_A": 3, "PF_B": 2, "PF_C": 1, "": 1}
    order = lambda mode: [r["value"] for r in sorted(style.zorder(freq, mode).collect(), key=lambda r: r["zorder"])]
    assert order("size-desc") == ["PF_A", "PF_B", "PF_C", ""]
    assert order("size-asc") == ["PF_C", "PF_B", "PF_A", ""]
    assert order("alpha-desc") == ["PF_C", "PF_B", "PF_A", ""]
    assert order("manual") == ["PF_A", "PF_B", "PF_C", ""]
    top = {r["value"]: r["zorder"] for r in style.top_categories(ann(spark).select(F.col("fam").alias("cell")), top=2).collect()}
    assert top == {"PF_A": 0, "PF_B": 1, "__NA__": 2}


def test_settings(spark):
    freq = style.value_frequencies(ann(spark))
    styles = {"fam": {"colors": {"PF_A": "#FF0000", "<NA>": "#111111"}, "shapes": {"PF_B": "square"}, "sortMode": "alpha-asc"}}
    style.check_style_values(styles, freq)
    with pytest.raises(ValueError, match="does not exist for"):
        style.check_style_values({"fam": {"colors": {"nope": "#1"}}}, freq)
    with pytest.raises(ValueError, match="'zzz' does not exist"):
        style.check_style_values({"zzz": {}}, freq)
    settings = style.apply_styles(ann(spark), styles)["fam"]
    assert settings["sortMode"] == "alpha-asc" and settings["includeShapes"] and settings["maxVisibleValues"] == 10
    assert settings["categories"]["PF_A"] == {"zOrder": 0, "color": "#FF0000", "shape": "circle"}
    assert settings["categories"]["PF_B"]["shape"] == "square" and "__NA__" in settings["categories"]
    state = style.settings_to_state({"fam": settings}, spark)
    assert state["annotation_colors"]["fam"]["PF_A"] == "rgba(255, 0, 0, 0.8)" and state["marker_shapes"]["fam"]["PF_B"] == "square"
    pinned = style.build_settings(freq, overrides={"fam": {"pinnedValues": ["__REST__", ""], "maxVisibleValues": 3}})["fam"]
    assert list(pinned["categories"]) == ["PF_A", "PF_B", "__NA__"]
    assert pinned["categories"]["__NA__"]["color"] == "#DDDDDD" and pinned["categories"]["PF_A"]["color"] == "#F3C300"
    assert "pinnedValues" not in pinned
    kept = style.build_settings(freq, {"annotation_colors": {"fam": {"PF_A": "rgba(0, 0, 255, 0.8)"}}}, {"fam": {**settings, "shapeSize": 99}})["fam"]
    assert kept["shapeSize"] == 99 and kept["categories"]["PF_A"]["color"] == "#0000FF"
    template = style.template_dict(freq)["fam"]
    assert list(template["colors"]) == ["PF_A", "PF_B", "", "PF_C"] and template["colors"][""] == "#C0C0C0"
    re = style.restyle_top(ann(spark), {"fam": {"sortMode": "manual", "categories": {}}, "other": {"x": 1}}, ["fam", "gone"], 2)
    assert re["other"] == {"x": 1} and re["fam"]["sortMode"] == "manual" and list(re["fam"]["categories"]) == ["PF_A", "PF_B", "__NA__"]


def test_view(spark):
    data = spark.createDataFrame(
        [("P", "1", 1.0, 2.0, None), ("P", "2", -3.0, 4.0, None), ("Q", "1", 1.0, 1.0, 1.0)],
        "projection_name string, identifier string, x float, y float, z float",
    )
    meta = spark.createDataFrame([("P", 2, "{}"), ("Q", 3, "{}")], "projection_name string, dimensions int, info_json string")
    v = view.AtlasView(ann(spark), meta, data)
    assert v.projection_names() == ["P", "Q"] and v.annotation_names() == ["fam"] and v.is_3d("Q") and not v.is_3d("P")
    assert v.annotations_of("3") == {"fam": "PF_A|9;PF_C"} and v.annotations_of("none") == {}
    assert v.values("fam").count() == 6 and v.distinct_values("fam").count() == 4 and v.ids().count() == 6
    w = v.with_color("fam", "PF_A", "red").with_shape("fam", "PF_A", "square")
    assert w.colors("fam") == {"PF_A": "red"} and w.shapes("fam") == {"PF_A": "square"} and v.colors("fam") == {}
    with pytest.raises(ValueError):
        v.projection_data("none")
    frame = v.plot_frame("P", "fam")
    assert {r["identifier"]: r["fam"] for r in frame.collect()} == {"1": "PF_A|10", "2": "PF_A|10"}
    box = view.bounding_box(frame, 2).first()
    assert abs(box["x_min"] + 3.15) < 1e-6 and abs(box["y_max"] - 4.2) < 1e-6
    assert view.highlight(frame, ["2"]).count() == 1
    assert [r["value"] for r in view.category_legend(ann(spark), "fam").orderBy("position").collect()][0] == ""


def test_replace_column_and_pooling(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "identifier string, n int, s string")
    new = spark.createDataFrame([("a", 10), ("b", 20)], "identifier string, n int")
    assert sorted(tuple(r) for r in align.replace_column(base, new, "n").collect()) == [("a", 10, "x"), ("b", 20, "y")]
    with pytest.raises(Exception, match="no n for b"):
        align.replace_column(base, new.filter("n < 15"), "n").collect()
    assert align.keep_columns(base, ["s", "gone", "n"]).columns == ["s", "n"]
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [0.0, 1.0])], "identifier string, vec array<double>")
    assert {r["identifier"]: r["vec"] for r in align.mean_pool_rows(rows).collect()} == {"a": [2.0, 4.0], "b": [0.0, 1.0]}


def test_labels_from_annotations(spark):
    from atlasmill.operators import metrics

    rows = [("1", "KW-1 (Signal);KW-2 (Kinase)"), ("2", "Kinase"), ("3", "Ligase"), ("4", ""), ("5", "Secreted")]
    table = spark.createDataFrame(rows, "protein_id string, keyword string")
    heads = spark.createDataFrame([(str(i),) for i in range(1, 7)], "identifier string")
    got = {r["identifier"]: r["label"] for r in metrics.labels_from_annotations(table, heads, min_class_size=2).collect()}
    assert got == {"1": "Kinase", "2": "Kinase", "3": None, "4": None, "5": None, "6": None}
    with pytest.raises(ValueError, match="not found"):
        metrics.labels_from_annotations(table, heads, "gone")


def test_first_metadata_row_counts(spark):
    heads = spark.createDataFrame([("a",), ("b",)], "identifier string")
    rows = [("a", f"v{i}") for i in range(50)]
    meta = spark.createDataFrame(rows, "identifier string, k string").repartition(1).sortWithinPartitions(F.length("k"), "k")
    got = {r["identifier"]: r["k"] for r in align.attach_to_headers(heads, meta).collect()}
    assert got == {"a": "v0", "b": ""}


def test_rows_without_a_key_do_not_meet(spark):
    """Nine rows in ten without a label: the join spreads them."""
    from atlasmill.operators import metrics

    rows = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("c"), F.col("id") % 30)).alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = metrics.min_class_labels(rows, "label", 2)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 2000 and max(sizes) < 1200
    assert out.filter("label is null").count() == 1800
