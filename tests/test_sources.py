import gzip

import pytest
from pyspark.sql import functions as F

from atlasmill.sources import bundle, dictionaries, sequences, tables, vectors


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_text(">sp|P12345|A desc > here\nMKT\n AYI \n>x\n\n>dup\nAAA\n>dup\nCCC\n>last\nGG\n\n")
    got = {r[0]: r[1] for r in sequences.read_fasta(spark, str(path)).collect()}
    assert got == {"sp|P12345|A": "MKTAYI", "dup": "AAA", "last": "GG"}
    got = {r[0]: r[1] for r in sequences.read_fasta(spark, str(path), normalize=True).collect()}
    assert got["P12345"] == "MKTAYI"
    ids = [r[0] for r in sequences.read_fasta_ids(spark, str(path)).collect()]
    assert ids == ["P12345", "x", "dup", "dup", "last"]


def test_fasta_gz_and_normalized_duplicates(spark, tmp_path):
    path = tmp_path / "a.fasta.gz"
    with gzip.open(path, "wt") as handle:
        handle.write(">sp|P12345|A\nAAA\n>tr|P12345|B\nCCC\n")
    got = {r[0]: r[1] for r in sequences.read_fasta(spark, str(path), normalize=True).collect()}
    assert got == {"P12345": "CCC"}


def test_fasta_write(spark, tmp_path):
    df = spark.createDataFrame([("a", "M" * 170), ("b", "AC")], "identifier string, sequence string")
    sequences.write_fasta(df, str(tmp_path / "out"))
    got = {r[0]: r[1] for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": "M" * 170, "b": "AC"}
    assert sequences.is_fasta("X.FAA") and not sequences.is_fasta("x.txt")


def test_signal_table_and_accessions(spark, tmp_path):
    path = tmp_path / "f.tsv"
    path.write_text("Entry\tSequence\tSignal peptide\nA\tMKTAA\tSIGNAL 1..2; /x\nB\tMK\tSIGNAL ?..2\nC\tMK\t\n")
    rows = sequences.read_signal_table(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("A", "MKTAA", 1, 2)]
    path = tmp_path / "acc.csv"
    path.write_text("SP|B2|x\nsp|A1|y\nTR|C3|z\nSP|B2|again\n")
    assert [r[0] for r in sequences.read_accessions(spark, str(path)).collect()] == ["A1", "B2"]


def test_enzyme_dictionaries(spark, tmp_path):
    dat = tmp_path / "enzyme.dat"
    dat.write_text("CC   header\n//\nID   1.1.1.1\nDE   Alcohol\nDE   dehydrogenase.\nAN   x\n//\nID   1.1.1.2\n//\nID   2.7.11.1\nDE   Kinase.\n//\n")
    got = {r["code"]: r["name"] for r in dictionaries.read_enzyme_names(spark, str(dat)).collect()}
    assert got == {"1.1.1.1": "Alcohol dehydrogenase", "2.7.11.1": "Kinase"}
    cls = tmp_path / "enzclass.txt"
    cls.write_text("header\n1. -. -.-  Oxidoreductases.\n3. 4.21.-    Serine endopeptidases.\nnot a line\n")
    classes = dictionaries.read_enzyme_classes(spark, str(cls))
    assert {r["code"]: r["name"] for r in classes.collect()} == {"1.-.-.-": "Oxidoreductases", "3.4.21.-": "Serine endopeptidases"}
    over = spark.createDataFrame([("1.-.-.-", "New"), ("9", "Nine")], "code string, name string")
    both = {r["code"]: r["name"] for r in dictionaries.enzyme_dictionary(classes, over).collect()}
    assert both == {"1.-.-.-": "New", "3.4.21.-": "Serine endopeptidases", "9": "Nine"}


def test_clans_and_folds(spark, tmp_path):
    tsv = tmp_path / "clans.tsv"
    tsv.write_text("PF1\tCL1\tNameA\ts\td\nPF2\t\t\ts\td\nPF3\tCL2\t\ts\td\n")
    assert {r[0]: r[1] for r in dictionaries.read_family_clans(spark, str(tsv)).collect()} == {"PF1": "CL1 (NameA)", "PF3": "CL2"}
    fam = dictionaries.families_of_clans(spark, str(tsv), ["CL1", "CL2"])
    assert dictionaries.clan_queries(fam).first()["query"] == "(xref:pfam-PF1) OR (xref:pfam-PF3)"
    names = tmp_path / "cath.txt"
    names.write_text("# c\n1.10.8  1abc  :Topo\n1.10.8.10  2abc  :\n1.10.9.10  2abc  :\n2.60   x  :Sandwich: beta\n")
    got = {r["code"]: r["name"] for r in dictionaries.read_fold_names(spark, str(names)).collect()}
    assert got == {"1.10.8": "Topo", "1.10.8.10": "Topo", "2.60": "Sandwich: beta"}


def test_domain_xml(spark, tmp_path):
    path = tmp_path / "i.xml"
    path.write_text(
        '<interprodb><interpro id="I1"><name>Entry one</name><member_list>'
        '<db_xref db="SSF" dbkey="SSF1" name="  "/><db_xref db="PANTHER" dbkey="PTHR1" name="Pan"/><db_xref db="PFAM" dbkey="PF1" name="x"/>'
        "</member_list></interpro></interprodb>"
    )
    rows = {(r["db"], r["accession"]): r["name"] for r in dictionaries.read_domain_names(spark, str(path)).collect()}
    assert rows == {("superfamily", "SSF1"): "Entry one", ("panther", "PTHR1"): "Pan"}


def test_custom_tables(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.tsv"
    a.write_text('ID,k,v\nx,1,p\nx,2,q\ny,3,"a,b"\n')
    b.write_text("name\tv\nx\tnew\nz\tother\n")
    got = {r["identifier"]: (r["k"], r["v"]) for r in tables.read_custom_tables(spark, [str(a), str(b)]).collect()}
    assert got == {"x": ("2", "new"), "y": ("3", None), "z": (None, "other")}


def test_result_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"results": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "2.json").write_text('{"results": [{"id": 3}]}')
    rows = tables.read_result_pages(spark, str(tmp_path), "struct<id:int>").select("result.id").collect()
    assert sorted(r[0] for r in rows) == [1, 2, 3]


def test_append_absent_and_lengths(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "identifier string, v int")
    tables.append_absent(spark, path, one)
    tables.append_absent(spark, path, one.withColumn("v", F.col("v") + 10).union(spark.createDataFrame([("c", 3)], one.schema)))
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    seqs = spark.createDataFrame([("A" * n,) for n in (1, 2, 3, 10)], "sequence string")
    assert tuple(tables.length_report(seqs).first()) == (4, 1, 3, 10)


def test_vectors(spark, tmp_path):
    p1, p2 = str(tmp_path / "1.parquet"), str(tmp_path / "2.parquet")
    nan = float("nan")
    spark.createDataFrame(
        [("a", [1.0, 2.0]), ("b", [3.0, nan]), ("c", [1.0, 2.0, 3.0])], "identifier string, vec array<double>"
    ).coalesce(1).write.parquet(p1)
    spark.createDataFrame([("a", [9.0, 9.0]), ("d", [4.0, 5.0])], "identifier string, vec array<double>").withColumn(
        "model_name", F.lit("m")
    ).coalesce(1).write.parquet(p2)
    got = {r["identifier"]: r["vec"] for r in vectors.load_vectors(spark, [p1, p2], "x").collect()}
    assert got == {"a": [1.0, 2.0], "d": [4.0, 5.0]}
    assert vectors.model_name(spark, [p1, p2]) == "m"
    with pytest.raises(ValueError, match="name the set"):
        vectors.model_name(spark, [p1])
    info = vectors.inspect_vectors(spark.read.parquet(p2)).first()
    assert (info["entries"], info["dim_min"], info["value_max"]) == (2, 2, 9.0)
    p3 = str(tmp_path / "3.parquet")
    spark.createDataFrame([("n", [[1.0, 2.0]])], "identifier string, vec array<array<double>>").write.parquet(p3)
    assert vectors.load_vectors(spark, [p3], "x").first()["vec"] == [1.0, 2.0]
    p4 = str(tmp_path / "4.parquet")
    spark.createDataFrame([("n", [[1.0], [2.0]])], "identifier string, vec array<array<double>>").write.parquet(p4)
    with pytest.raises(Exception, match="per-residue"):
        vectors.load_vectors(spark, [p4], "x").collect()
    assert vectors.subset_limit(101, 0.1, 300) == 11 and vectors.subset_limit(1, 0.0, 5) == 1


def test_similarity_edges(spark):
    hits = spark.createDataFrame(
        [("sp|P12345|A", "b", 0.5, 0), ("b", "P12345", 0.7, 1), ("b", "b", 1.0, 2), ("b", "zzz", 0.9, 3)],
        "query string, target string, fident double, hit_idx int",
    )
    known = spark.createDataFrame([("P12345",), ("b",)], "identifier string")
    got = sorted(tuple(r) for r in vectors.similarity_edges(hits, known).collect())
    assert got == [("P12345", "b", 0.7), ("b", "P12345", 0.7), ("b", "b", 1.0)]


def test_bundle(spark, tmp_path):
    meta = spark.createDataFrame([("a", None, "1", "S"), ("b", "y", "2", "T")], "identifier string, k string, organism_id string, sequence string")
    ann = bundle.annotations_output(meta)
    assert ann.columns == ["protein_id", "k"]
    coords = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "identifier string, coords array<double>")
    data = bundle.projection_rows(coords, "P", 2)
    info = bundle.metadata_rows(spark, [("P", 2, {"k": [1, 2]})])
    folder = str(tmp_path / "out")
    bundle.write_tables(folder, ann, info, data, {"k": {"x": 1}})
    a, m, d, settings = bundle.read_tables(spark, folder)
    assert settings == {"k": {"x": 1}} and d.filter("z is null").count() == 2
    packed = bundle.pack(str(tmp_path / "f.txt"), a, m, d)
    assert packed.endswith("f.parquetbundle") and bundle.bundle_path("dir") == "dir/data.parquetbundle"
    parts, none = bundle.read_parts(packed)
    assert len(parts) == 3 and none is None and bundle.count_entries(packed) == 2
    styled = str(tmp_path / "g.parquetbundle")
    bundle.replace_settings(packed, styled, {"s": []})
    again, settings = bundle.read_parts(styled)
    assert again == parts and settings == {"s": []}
    bundle.replace_settings(styled, styled, {"s": [1]})
    assert bundle.read_parts(styled) == (parts, {"s": [1]})
    un = bundle.unpack(styled, str(tmp_path / "un"))
    assert spark.read.parquet(f"{un}/{bundle.PART_NAMES[0]}").count() == 2
    assert bundle.inspect(spark, folder, 1)[bundle.PART_NAMES[2]]["rows"] == 2
    with pytest.raises(ValueError):
        bundle.split_parts(b"only one")


def test_cached_dictionary(spark, tmp_path):
    path, calls = str(tmp_path / "d"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", str(len(calls)))], "code string, name string")

    def broken():
        raise RuntimeError("source is down")

    with pytest.raises(RuntimeError):
        dictionaries.cached_table(spark, path, broken)
    assert dictionaries.cached_table(spark, path, build).first()["name"] == "1"
    assert dictionaries.cached_table(spark, path, build).first()["name"] == "1" and len(calls) == 1
    assert dictionaries.cached_table(spark, path, broken, max_age_days=0).first()["name"] == "1"
    held = dictionaries.cached_table(spark, path, build)
    assert dictionaries.cached_table(spark, path, build, max_age_days=0).first()["name"] == "2"
    assert held.first()["name"] == "1"  # the copy in use outlives the next build

    def halfway():
        return build().withColumn("name", F.raise_error(F.lit("lost while writing")))

    assert dictionaries.cached_table(spark, path, halfway, max_age_days=0).first()["name"] == "2"
    assert dictionaries.cached_table(spark, path, broken).first()["name"] == "2"  # what was written halfway is not read
    for n in ("4", "5"):
        assert dictionaries.cached_table(spark, path, build, max_age_days=0).first()["name"] == n
    assert len(dictionaries._versions(spark, path)) == 2


def test_structures(spark, tmp_path):
    import base64
    import zipfile

    from atlasmill.sources import structures

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "A.1.pdb").write_text("ATOM")
    (tmp_path / "s" / "note.txt").write_text("x")
    row = structures.read_structures(spark, str(tmp_path / "s")).collect()
    assert [(r["identifier"], r["kind"], base64.b64decode(r["content"])) for r in row] == [("A_1", "pdb", b"ATOM")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("dir/B.cif", "data_B")
        z.writestr("readme.md", "x")
    row = structures.read_structure_archives(spark, str(tmp_path / "z.zip")).collect()
    assert [(r["identifier"], base64.b64decode(r["content"])) for r in row] == [("B", b"data_B")]


def test_first_fasta_of_the_list_wins(spark, tmp_path):
    """The place in the list decides, not the size by which the reader packs files."""
    (tmp_path / "small.fasta").write_text(">X1\nMKV\n")
    (tmp_path / "large.fasta").write_text(">X1\nAAA\n" + "".join(f">Y{i}\nMKVL\n" for i in range(4000)))
    small, large = str(tmp_path / "small.fasta"), str(tmp_path / "large.fasta")
    pick = lambda *paths: sequences.read_fasta(spark, list(paths)).filter("identifier = 'X1'").first()["sequence"]
    assert pick(small, large) == "MKV" and pick(large, small) == "AAA"
