from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasmill.functions import cells, colors, entry, scalars, transforms


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.withColumn("o", fn("v")).orderBy("i").collect()]


def test_parse_identifier(spark):
    keys = ["sp|P12345|NAME_HUMAN", "tr|A0A0B4J2F0|X", "gb|XYZ|foo", "plain", "P12345-2", "a|b", "", "sp|bad", "sp|P12345"]
    assert run(spark, keys, scalars.parse_identifier) == [
        "P12345", "A0A0B4J2F0", "XYZ", "plain", "P12345-2", "b", "", "bad", "P12345"
    ]


def test_accession(spark):
    assert run(spark, ["P12345", "A0A0B4J2F0", "P1234", "P12345-2"], scalars.is_accession) == [True, True, False, False]


def test_missing(spark):
    assert run(spark, ["", "nan", "None", None, "NA", "na", "x"], scalars.standardize_missing) == [
        "<N/A>", "<N/A>", "None", "<N/A>", "<N/A>", "na", "x"
    ]
    assert run(spark, ["", " False ", "0", "no", "N/A", None, "yes", "0.0"], scalars.is_truthy) == [
        False, False, False, False, False, False, True, True
    ]
    assert run(spark, ["a/b c", "ä_1.x-2"], scalars.safe_identifier) == ["a_b_c", "ä_1.x-2"]


def test_natural_sort(spark):
    long = ["z1234567890123456789012345", "z1234567890123456789012346", "z99"]
    values = ["a10", "a2", "A1", "b", "10", "9", "a2b", *long]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["v"] for r in df.orderBy(scalars.natural_sort_key("v")).collect()]
    assert got == ["9", "10", "A1", "a2", "a2b", "a10", "b", "z99", *long[:2]]


def test_signal_bounds(spark):
    whole = ["SIGNAL 4..37", 'SIGNAL 2..118; /note="made up"', "SIGNAL 7..9; /evidence=ECO:1 > 0"]
    open_or_twice = ["SIGNAL ?..44", "SIGNAL 3..?", "SIGNAL <6..52", "SIGNAL 6..>52", "SIGNAL >8..61", "SIGNAL 5..8; SIGNAL 11..14"]
    got = run(spark, [*whole, *open_or_twice, "CHAIN 3..9", "signal", "", None], scalars.signal_bounds)
    assert [(g["sp_start"], g["sp_end"]) for g in got[:3]] == [(4, 37), (2, 118), (7, 9)]
    assert got[3:] == [None] * 10


def test_segment_outcome(spark):
    rows = [
        ("ABCDEFGHIJ", "0", "5"), ("ABCDEFGHIJ", "2", "99"), ("ABCDEFGHIJ", "-1", "5"), ("ABCDEFGHIJ", "5", "5"),
        ("ABCDEFGHIJ", "10", "12"), ("ABCDEFGHIJ", "x", "5"), ("", "0", "5"), ("ABCDEFGHIJ", "0", "3"), ("a b c d e f", "0.9", "11.2"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, a string, b string")
    out = df.withColumn("o", scalars.segment_outcome(F.col("s"), F.col("a"), F.col("b"), 5)).orderBy("i").collect()
    assert [(r["o"]["reason"], r["o"]["segment"]) for r in out] == [
        ("ok", "ABCDE"), ("ok", "CDEFGHIJ"), ("bad_coordinates", None), ("bad_coordinates", None), ("bad_coordinates", None),
        ("bad_coordinates", None), ("missing_sequence", None), ("short", None), ("ok", "ABCDEF"),
    ]


def test_cells(spark):
    assert run(spark, ["a (b)|1.5,2;c|EXP", "", None, "x|y|z"], cells.strip_scores) == ["a (b);c", "", None, "x"]
    assert run(spark, ["a|1;;b", ""], cells.display_values) == [["a", "", "b"], [""]]
    assert run(spark, [" a |1; ;__NA__;b|2", "", None], cells.extract_categories) == [["a", "b"], [], []]
    assert run(
        spark, ["KW-1 (Toxin);KW-2 (Ion channel impairing toxin)", "Signal", "", "Secreted; Neurotoxin "], cells.first_functional_keyword
    ) == ["Ion channel impairing toxin", None, None, "Neurotoxin"]
    assert run(spark, ["KW-12 (A (b))", " x ", "KW-1 (x", "()"], scalars.strip_keyword_code) == ["A (b)", "x", "KW-1 (x", ""]


def test_sql_functions(spark):
    cells.register_sql_functions(spark)
    assert spark.sql("SELECT strip_scores('a|1;b') AS x").first()["x"] == "a;b"
    assert spark.sql("SELECT display_values('a|1;b') AS x").first()["x"] == ["a", "b"]


name = st.text(alphabet="abcXYZ 12-", min_size=1, max_size=8).map(str.strip).filter(bool)
item = st.tuples(
    st.text(alphabet="PF0123456789", min_size=1, max_size=6), st.none() | name,
    st.lists(st.text(alphabet="0123456789.", min_size=1, max_size=4), max_size=3),
)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(item, min_size=1, max_size=4), min_size=1, max_size=20))
def test_cell_round_trip(spark, rows):
    texts = [
        ";".join(f"{a}{f' ({n})' if n else ''}{'|' + ','.join(s) if s else ''}" for a, n, s in row) for row in rows
    ]
    assert run(spark, texts, lambda v: cells.format_cell(cells.parse_cell(v))) == texts


def test_transforms(spark):
    assert run(spark, ["5.0", "3", "abc", "", None, "-1.5"], transforms.score_as_integer) == ["5", "3", "abc", "", None, "-1"]
    assert run(
        spark, ["Lantern family, Subfamily 1|ISS", "A; B", "Only", "A|B, C|EXP", ""], transforms.first_family
    ) == ["Lantern family|ISS", "A", "Only", "A|B|EXP", ""]
    assert run(spark, ["7QRS;8TUV", " ", None], transforms.has_structure) == ["True", "False", "False"]
    assert run(spark, ["Fragment", "x", ""], transforms.fragment_flag) == ["yes", "x", ""]
    assert run(spark, ["F:kinase; P:x|IDA;C:", "plain"], transforms.strip_aspect) == ["kinase;x|IDA;C:", "plain"]
    assert run(spark, ["G3DSA:3.40;;G3DSA:1.10 ", ""], transforms.clean_fold_codes) == ["1.10;3.40", ""]
    assert run(spark, ["SIGNAL_PEPTIDE_N", "x", None], transforms.has_signal_peptide) == ["True", "False", "False"]
    table = F.create_map(F.lit("PF1"), F.lit("CL2 (b)"), F.lit("PF2"), F.lit("CL1"), F.lit("PF3"), F.lit("CL1"))
    assert run(spark, ["PF1 (x)|1;PF2;PF3;PF9", "", None], lambda v: transforms.family_clans(v, table)) == ["CL1;CL2 (b)", "", ""]
    ecs = F.create_map(F.lit("1.1"), F.lit("Name"))
    assert run(spark, ["1.1|EXP; ;2.2", "1.1", ""], lambda v: transforms.name_enzymes(v, ecs)) == ["1.1 (Name)|EXP;2.2", "1.1 (Name)", ""]


def test_colors(spark):
    assert run(spark, ["#FF8000", "red", "rgba(1, 2, 3, 0.8)"], colors.hex_to_rgba) == ["rgba(255, 128, 0, 0.8)", "red", "rgba(1, 2, 3, 0.8)"]
    assert run(spark, ["rgba(255, 128, 0, 0.8)", "rgb(1,2,3)", "#ABCDEF"], colors.rgba_to_hex) == ["#FF8000", "#010203", "#ABCDEF"]
    import colorsys

    df = spark.range(7).select(F.col("id"), colors.default_color("id", F.lit(7)).alias("c")).orderBy("id")
    want = ["rgba({}, {}, {}, 0.8)".format(*[int(c * 255) for c in colorsys.hsv_to_rgb(i / 7, 0.8, 0.8)]) for i in range(7)]
    assert [r["c"] for r in df.collect()] == want


ENTRY = """{"primaryAccession":"P1","uniProtkbId":"X_HUMAN","entryType":"UniProtKB reviewed (Swiss-Prot)","annotationScore":5.0,
"organism":{"scientificName":"Homo sapiens","taxonId":9606,"lineage":["A","B"]},
"proteinDescription":{"flag":"Precursor,Fragment","recommendedName":{"fullName":{"value":"Prot"},"ecNumbers":[{"value":"1.1.1.1",
 "evidences":[{"evidenceCode":"ECO:0000256"},{"evidenceCode":"ECO:0000269"}]}]},"alternativeNames":[{"ecNumbers":[{"value":"2.2"}]},{}]},
"keywords":[{"id":"KW-1","name":"Toxin"}],"sequence":{"value":"MKT","length":3,"molWeight":300},
"comments":[{"commentType":"SUBCELLULAR LOCATION"},{"commentType":"SUBCELLULAR LOCATION","subcellularLocations":[{"location":{"value":"Cytoplasm","evidences":[{"evidenceCode":"ECO:0000269"}]}},
 {"location":{"value":"Nucleus"}}]},{"commentType":"SIMILARITY","texts":[{"value":"Belongs to the lantern family. Extra."}]}],
"annotations":[{"type":"Signal","location":{"start":{"value":1},"end":{"value":20}}},{"type":"Glycosylation","description":"N-linked","location":{"start":{"value":5},"end":{"value":5}}}],
"uniProtKBCrossReferences":[{"database":"GO","id":"GO:1","properties":[{"key":"GoTerm","value":"P:growth"},{"key":"GoEvidenceType","value":"IDA:X"}]},
 {"database":"GO","id":"GO:2","properties":[{"key":"GoTerm","value":"F:binding"}]},{"database":"PDB","id":"1ABC"},{"database":"PDB","id":"2ABC"}]}"""


def test_entry_accessors(spark):
    df = spark.createDataFrame([("a", ENTRY), ("b", "{}"), ("c", "not json")], "identifier string, json string")
    names = sorted(entry.PROPERTIES)
    a, b, c = entry.select_properties(df, "json", names).orderBy("identifier").collect()
    assert a["ec"] == "1.1.1.1|EXP;2.2"
    assert a["cc_subcellular_location"] == "Cytoplasm|EXP;Nucleus"
    assert a["protein_families"] == "lantern family"
    assert a["go_bp"] == "P:growth|IDA" and a["go_mf"] == "F:binding" and a["go_cc"] == "" and a["go_id"] == "GO:1;GO:2"
    assert a["keyword"] == "KW-1 (Toxin)" and a["xref_pdb"] == "1ABC;2ABC" and a["fragment"] == "fragment"
    assert a["protein_name"] == "Prot" and a["organism_id"] == "9606" and a["lineage"] == "A;B" and a["ft_signal"] == "1-20"
    assert a["ft_glycosylation"] == '[{"5":"N-linked"}]' and a["reviewed"] == "Swiss-Prot"
    for row in (b, c):
        assert row["reviewed"] == "TrEMBL" and row["length"] == "0" and row["annotation_score"] == "0.0"
        assert all(v is not None for v in row)


def test_best_evidence(spark):
    cases = [["ECO:0000313", "ECO:0000269"], ["ECO:1", "ECO:2"], [], ["ECO:0000250", "ECO:0007744"], ["ECO:9", "ECO:0000313"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<string>")
    got = [r["o"] for r in df.withColumn("o", entry.best_evidence(F.col("c"))).orderBy("i").collect()]
    assert got == ["EXP", "ECO:1", "", "HDA", "IEA"]


def test_residues_and_wrap(spark):
    assert run(spark, ["mbjouzk"], scalars.clean_residues) == ["MXXXXXK"]
    assert run(spark, ["MK"], lambda v: scalars.space_residues(v, "<AA2fold>")) == ["<AA2fold> M K"]
    assert run(spark, ["A" * 12], lambda v: scalars.wrap_text(v, 5)) == ["AAAAA\nAAAAA\nAA"]
    assert run(spark, ["A" * 10], lambda v: scalars.wrap_text(v, 5)) == ["AAAAA\nAAAAA"]
