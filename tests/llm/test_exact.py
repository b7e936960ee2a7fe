"""Operators against brute force, the libraries' own results, planted cases and held-out labels."""

from __future__ import annotations

import random
import struct
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from conftest import SF, plain
from pyspark.sql import functions as F

import corpus_pipeline
from atlasmill.llm import (chunk_dedup, decontaminate, language_id, near_text, quality_classifier, quality_rules, queries, records, sentencepiece_codec, sharding,
                           simhash)
from atlasmill.llm.components import components
from atlasmill.llm.wfst import BPE, BYTE, MARK, NORMAL, UNIGRAM, UNKNOWN, USER, Model, Transducer


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def same_parts(found: dict, wanted: dict) -> bool:
    return len({(found[n], wanted[n]) for n in wanted}) == len(set(found.values())) == len(set(wanted.values()))


def slow_print(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == roots([e for e in edges if e[0] != e[1]], nodes)


def test_simhash_groups_of_documents(documents, spark):
    got = simhash.near_duplicates(documents).collect()
    prints = {r["doc_id"]: slow_print(r["text"]) for r in documents.collect()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == prints
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {r["doc_id"]: r["component_id"] for r in got} == roots(near, ids)


def shingle_set(text: str) -> set[bytes]:
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("tile", [16, 1024])
def test_near_texts_in_crowded_groups(spark, tile):
    """Hundreds of texts around one passage, some alike and some not, copies and repeated rows; searched in tiles."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(9000)}"
    core, rows = [word() for _ in range(60)], []
    for i in range(150):
        body = core + [word() for _ in range(rng.randrange(0, 60))]
        rows.append((i, " ".join(body)))
        if i % 3 == 0:
            body[rng.randrange(len(body))] = word()
            rows.append((1000 + i, " ".join(body)))
    rows += [(5, rows[5][1]), (2000, rows[5][1]), (None, rows[5][1]), (None, None), (3000, ""), (3001, " \n")]
    sets = {(i, d): shingle_set(t) for i, (d, t) in enumerate(rows)}
    keys = sorted(sets, key=lambda k: (k[1] is None, k[1] or 0, k[0]))
    rank = {k: r for r, k in enumerate(keys)}
    same = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = roots([(rank[a], rank[b]) for x, a in enumerate(keys) for b in keys[x + 1:] if same(a, b)], list(rank.values()))
    wanted = sorted((keys[r][1] for r in set(root.values())), key=str)
    kept = near_text.keep_one(plain([(d, t, "en", "a", 0) for d, t in rows], spark).repartition(3), tile=tile)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == wanted


def test_near_texts_of_the_pipeline_are_all_pairs_at_four_fifths(spark, documents):
    """Near copies with a few edited words, of which fingerprints within four bits missed most, against all pairs."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for g in range(40):
        base = [word() for _ in range((100, 200, 400)[g % 3])]
        rows.append((10_000 + 100 * g, " ".join(base)))
        for c in range(1, 6):
            copy = list(base)
            for _ in range(rng.choice((1, 1, 2, 4, 9, 16))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((10_000 + 100 * g + c, " ".join(copy)))
    sets = {d: shingle_set(t) for d, t in rows}
    ids = sorted(sets)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    wanted = set(roots(near, ids).values())
    docs = plain([(d, t, "en", "a", 0) for d, t in rows], spark)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == wanted and len(near) > 100


@pytest.mark.parametrize("tile", [8, 64, 2048])
def test_simhash_links_in_crowded_cells(spark, tile):
    rng = random.Random(9)
    centers = [rng.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for c in centers for _ in range(120)} | {rng.getrandbits(64) for _ in range(200)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.links(nodes, tile=tile).collect()]
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(distance(a, b) <= 4 for a, b in found)
    wanted = roots([(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if distance(a, b) <= 4], signed)
    assert same_parts(roots(found, signed), wanted)


def test_bit_counts_bound_the_distance():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    assert (np.bitwise_count(simhash._unary(a) ^ simhash._unary(b)) <= np.bitwise_count(a ^ b)).all()


def test_base_counts():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", "é ", "c\n", "\n", " ", "# ", "<x>\n", "日 ", "\t"]) for _ in range(rng.randrange(0, 80)))
        words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if line.strip(" \t"):
                dup += line in seen
                seen.add(line)
        wanted = (sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside))
        assert quality_rules.base_counts(text.encode(), text.encode().split()) == wanted


def test_fertility_rejects_junk_and_keeps_prose(spark):
    folder = SF.replace("0.001", "0.01")
    out = queries.op3_fertility_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert not [r for r in out if r["quality"] == 1 and not r["base_failed"] and not r["kept"]]
    bad = [r for r in out if r["quality"] == 0]
    assert sum(not r["kept"] for r in bad) >= 0.7 * len(bad)  # token statistics don't show every kind of junk
    measure = quality_rules.fertility(*quality_rules.default_vocabularies()).measure
    assert measure([]) == (0, 0.0, 0.0) and measure(["ༀ".encode()])[1] > 0.5


def test_transducer_is_the_library():

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    codec = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    rng = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "▁", "\n", "é", "日本", "😀", "ing", "\t", "1", "!!", "<s>", "<0x0A>", *rng.sample(sorted(codec.machine.id), 300)]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        ids = library.encode(text)
        assert np.frombuffer(codec.encode(text), np.uint32).tolist() == ids, text
        assert codec.decode(ids).decode() == library.decode(ids)


def model_file(pieces: list[tuple[str, float, int]], kind: int, rule: str | None, fallback: bool) -> bytes:
    """A model made by hand, with the character map of a public rule."""

    def field(number: int, value) -> bytes:
        def varint(v: int) -> bytes:
            return bytes([v & 127 | 128]) + varint(v >> 7) if v > 127 else bytes([v])

        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    head = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256) if fallback]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in head + pieces)
    out += field(2, field(3, kind) + field(35, int(fallback)))
    return out + (sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto() if rule else field(3, field(1, b"identity") + field(4, 0)))


@pytest.mark.parametrize("kind", [UNIGRAM, BPE])
@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("fallback", [True, False])
def test_models_with_symbols_and_character_maps_are_the_library(kind, rule, fallback):
    rng = random.Random(kind)
    parts = ["a", "b", "c", "x", "<", ">", MARK, "½", "é", "1", "2"]
    normal = {c: -9.0 - i for i, c in enumerate(parts)}
    made = list(normal)
    for i in range(60):  # each longer piece is made of two others, as merging needs
        piece = rng.choice(made) + rng.choice(made)
        if piece not in normal and len(piece) < 6 and MARK not in piece[1:]:
            normal[piece] = -0.1 * i - 0.05
            made.append(piece)
    symbols = ["<x>", "<xy>", "ab", "½2"]
    pieces = [(p, s, NORMAL) for p, s in normal.items() if p not in symbols] + [(p, 0.0, USER) for p in symbols]
    data = model_file(pieces, kind, rule, fallback)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_codec.Codec(Model.parse(data))
    alphabet = ["a", "b", "c", "x", "<", ">", "<x>", "<xy>", "ab", " ", "  ", "\t", "½", "ｆ", "ﬁ", "É", "é", "e\u0301", "ｶﾞ", "12", "\u200b", "z", "日"]
    for _ in range(700):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25)))
        ids = np.frombuffer(own.encode(text), np.uint32).tolist()
        assert ids == library.encode(text), text
        assert own.decode(ids).decode() == library.decode(ids), text


def test_shortest_path_of_a_unigram_model():
    rng = random.Random(3)
    pieces = [("<unk>", 0.0, UNKNOWN)] + [(f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)]
    words = ["".join(p) for n in (1, 2, 3) for p in product("ab" + MARK, repeat=n)]
    pieces += [(w, -rng.random() * 3 - 0.5, NORMAL) for w in words if len(w) == 1 or rng.random() < 0.5]
    machine = Transducer(Model(pieces, UNIGRAM))
    score = {p: s for p, s, k in pieces if k == NORMAL}

    def best(text):
        if not text:
            return 0.0
        return max(score[text[:n]] + best(text[n:]) for n in range(1, 4) if text[:n] in score)

    for _ in range(200):
        text = "".join(rng.choice("ab" + MARK) for _ in range(rng.randrange(1, 9)))
        ids = machine.encode(text)
        assert "".join(pieces[i][0] for i in ids) == text
        assert sum(pieces[i][1] for i in ids) == pytest.approx(best(text))
    assert machine.encode("é") == [1 + b for b in "é".encode()]


def test_codec_over_documents(spark):

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    out = {r["doc_id"]: r for r in queries.op4_sentencepiece(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r["text"])
        assert (out[r["doc_id"]]["n_tokens"], out[r["doc_id"]]["ids_crc32"], out[r["doc_id"]]["round_trip"]) == (
            len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_records_over_documents(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    index, folder = records.write_records(documents, str(tmp_path / "records"), file_bytes=50_000)
    got = {r["doc_id"]: r for r in records.read_records(index, folder).collect()}
    start = 0
    for r in documents.orderBy("doc_id").collect():
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
        mine = got[r["doc_id"]]
        assert (mine["start"], mine["n_tokens"], mine["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    first = index.orderBy("start").first()
    path = tmp_path / "records" / first["file"]
    data = bytearray(path.read_bytes())
    assert struct.unpack("<Q", data[:8])[0] == first["length"]
    data[14] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        records.read_records(index, folder).collect()


def test_encoder_is_the_library():
    encoder = records.encoder(records.default_vocabulary())
    rng = random.Random(2)
    parts = ["a", "don't", " 's", "th", " ", "  ", "\n", "é", "日本", "😀", "12", "\t", " ", "!!", "<|endoftext|>", "\r\n", "\x1c", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(0, 12)))
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_encoder_takes_added_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(records.default_vocabulary())
    encoder, rng = records.encoder(records.default_vocabulary()), random.Random(4)
    parts = ["a", "see", "<|endoftext|>", "<|endof", "text|>", "é", "\n", "  ", "日本"]
    some = ["see a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|>"]
    some += ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 9))) for _ in range(1000)]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in some]
    assert wanted[0] == [3826, 257, 220, 50256, 275]
    assert [np.frombuffer(encoder.encode(t), encoder.kind).tolist() for t in some] == wanted
    index, folder = records.write_records(plain([(i, t, "en", "a", 0) for i, t in enumerate(some[:40])], spark), str(tmp_path / "r"))
    start = 0
    for r in sorted(records.read_records(index, folder).collect(), key=lambda r: r["doc_id"]):
        ids = [*wanted[r["doc_id"]], 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_context_sums(spark):
    rng = random.Random(6)
    lists = [[f"w{rng.randrange(40)}" for _ in range(n)] for n in (0, 1, 2, 5, 700, 1500)]
    place, sign = quality_classifier.random_vectors()
    wanted, words = np.zeros((quality_classifier.BUCKETS, quality_classifier.DIMENSIONS)), quality_classifier.Words()
    texts = [" ".join(x) for x in lists]
    for t in texts:
        ids = words(t.encode())
        for i, j in ((i, j) for i in range(len(ids)) for j in range(max(0, i - 2), min(len(ids), i + 3)) if i != j):
            for p in range(quality_classifier.PLACES):
                wanted[ids[i], place[ids[j], p]] += sign[ids[j], p]
    docs = plain([(i, t, "en", "a", 0) for i, t in enumerate(texts)], spark)
    used = np.abs(wanted).sum(axis=1) > 0
    unit = np.divide(wanted, np.linalg.norm(wanted, axis=1, keepdims=True), out=np.zeros_like(wanted), where=used[:, None])
    unit[used] -= unit[used].mean(axis=0)
    before = quality_classifier.SLICE
    got = quality_classifier.word_vectors(docs)
    assert np.allclose(got, unit, atol=1e-5) and before == quality_classifier.SLICE


def test_long_texts_in_slices(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{i * i % 23}" for i in range(101)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([text, b"w1 w2", text], pa.binary())], ["t"])
    sums = lambda: {b: v for out in quality_classifier._contexts(iter([batch])) for b, v in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    whole = sums()
    monkeypatch.setattr(quality_classifier, "SLICE", 16)
    assert sums() == whole


def test_quality_of_held_out_documents(spark):
    folder = SF.replace("0.001", "0.01")
    out = queries.op6_quality_classifier(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out)


def test_language_of_held_out_documents(spark):
    folder = SF.replace("0.001", "0.01")
    out = queries.op7_language_id(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)


def test_gear_is_local_and_chunks_cover():
    rng = random.Random(8)
    text = bytes(rng.randrange(97, 123) for _ in range(5000))
    h, state = chunk_dedup.gear(np.frombuffer(text, np.uint8)), 0
    for b, got in zip(text, h.tolist(), strict=True):
        state = (state << 1) + int(chunk_dedup._GEAR[b]) & 0xFFFFFFFF
        assert got == state
    ends = chunk_dedup.cuts(np.frombuffer(text, np.uint8))
    assert ends[-1] == len(text) and all(b - a <= chunk_dedup.MOST for a, b in zip([0, *ends], ends, strict=False))
    moved = chunk_dedup.cuts(np.frombuffer(b"inserted" + text, np.uint8))
    assert len({e + 8 for e in ends} & set(moved)) >= 0.9 * len(ends)


def test_planted_passages(spark):
    rng = random.Random(10)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [prose(55) for _ in range(30)]
    line = prose(12)
    rows = [(i, f"{prose(80)} {passages[i % 30]} {prose(60)}", "en", "a", 0) for i in range(90)] + [(1000 + i, f"{prose(150)}\n{line}", "en", "a", 0) for i in range(60)]
    spans = chunk_dedup.repeated_spans(plain(rows, spark)).collect()
    found = {r["doc_id"] for r in spans}
    assert found <= set(range(30, 90)) and len(found) >= 58
    text = {r[0]: r[1] for r in rows}
    for r in spans:
        assert text[r["doc_id"]][r["start"]:r["stop"]] in passages[r["doc_id"] % 30] + " " + text[r["doc_id"]]
        assert r["first_doc_id"] < r["doc_id"] and r["first_doc_id"] % 30 == r["doc_id"] % 30


def test_repeated_spans_are_runs_of_known_chunks(spark, documents):
    docs = documents.select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 5 = 0")).unionByName(docs.where("doc_id % 40 = 0").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = {(r["doc"] is None, r["doc"] or 0, r["version"], r["start"]): r for r in chunk_dedup.chunks(docs).collect()}
    first: dict = {}
    for place in sorted(rows):
        first.setdefault((rows[place]["d1"], rows[place]["d2"]), place)
    wanted, run = set(), []

    def close():
        words = sum(r["words"] for r in run)
        if words >= chunk_dedup.INNER and words + run[0]["left"] + run[-1]["right"] >= chunk_dedup.OUTER:
            head = first[run[0]["d1"], run[0]["d2"]]
            wanted.add((run[0]["doc"], run[0]["version"], run[0]["start"], run[-1]["stop"], len(run), words, None if head[0] else head[1], head[3]))
        run.clear()

    for place in sorted(rows):
        r = rows[place]
        if run and (run[-1]["doc"], run[-1]["version"], run[-1]["seq"] + 1) != (r["doc"], r["version"], r["seq"]):
            close()
        if first[r["d1"], r["d2"]] != place:
            run.append(r)
    close() if run else None
    found = [tuple(r) for r in chunk_dedup.repeated_spans(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 50


def test_shards_are_even_and_groups_stay(spark):
    rng = random.Random(12)
    rows = [(i, f"text {i} " + "x" * rng.randrange(10, 900), "en", "a", 0) for i in range(6000)] + [(10_000 + i, "hot " * 60, "en", "b", 0) for i in range(3000)]
    rows += [(20_000 + i, f"pair {i // 2}", "en", "c", 0) for i in range(400)]
    out = sharding.assign_shards(plain(rows, spark)).collect()
    size, slots, homes = [0] * 24, [[] for _ in range(24)], {}
    for r in out:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert max(size) <= 1.03 * sum(size) / 24 and min(size) >= 0.97 * sum(size) / 24
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    hot = zlib.crc32(("hot " * 60).encode())
    assert all(len(s) == 1 for c, s in homes.items() if c != hot) and len(homes[hot]) > 3


def test_shards_stay_even_with_rows_alike_in_every_key(spark):
    """A third of the rows is one row; every shard is within three per cent of an equal share, and every row has a place."""
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(20, 60) + str(i), "en", "a", 0) for i in range(24_000)] + [(5, "y" * 40, "en", "a", 0)] * 6_000 + [(None, "z" * 40, "en", "a", 0)] * 6_000
    out = sharding.assign_shards(plain(rows, spark).repartition(7)).toPandas()
    assert len(out) == 36_000
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 24 and (size / size.mean() - 1).abs().max() < 0.03
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_decontaminated_texts_are_clean(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = decontaminate.decontaminate(documents, items)
    assert decontaminate.report(decontaminate.hits(out, items)).where("contaminated").count() == 0
    hit = {r["doc_id"] for r in queries.op10_decontaminate(spark, SF).where("contaminated").collect()}
    before = {r["doc_id"]: r["text"] for r in documents.collect()}
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert hit and all(after[d] == (t, len(t)) for d, t in before.items() if d not in hit)
    assert all(n == len(t) < len(before[d]) for d, (t, n) in after.items() if d in hit)


def test_pipeline(spark, documents):
    """Each stage against a plain version over the same rows; the last against the library."""

    docs, before = documents, {r["doc_id"]: r["text"] for r in documents.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), documents.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == documents.columns and set(after) <= set(before)
        if k == 0:
            assert sum(labels[d] == 1 for d in labels if d in after) >= 0.95 * sum(labels.values())
        if k == 1:
            site = {r["doc_id"]: r["source"] for r in docs.collect()}
            carried: dict[str, set] = {}
            for d, t in before.items():
                for line in t.split("\n"):
                    if line.strip(" \t\r"):
                        carried.setdefault(line.strip(" \t\r"), set()).add(site[d])
            seen, wanted = set(), {}
            for d in sorted(before):
                keep = []
                for line in before[d].split("\n"):
                    bare = line.strip(" \t\r")
                    if bare in seen and len(carried[bare]) >= 10:
                        continue
                    seen.add(bare) if bare else None
                    keep.append(line)
                wanted[d] = "\n".join(keep)
            assert after == wanted
        if k == 2:
            ids, sets = sorted(before), {d: shingle_set(t) for d, t in before.items()}
            root = roots([(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], ids)
            assert set(after) == set(root.values())
        before = after
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    out = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()}
    assert out == {d: library.encode(t) for d, t in before.items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(out)


def test_groups_of_the_same_texts_are_searched_once():
    import pyarrow as pa

    from atlasmill.llm.near_text import _apart

    # keys 1 and 2 hold the same two sets, key 3 one more, key 4 sets that are joined already
    keys, nodes = [1, 1, 2, 2, 3, 3, 3, 4, 4], [7, 8, 7, 8, 7, 8, 9, 5, 6]
    labels = [None] * 7 + [5, 5]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array([10] * 9, pa.int32()), pa.array(labels, pa.int64())], ["key", "node", "n", "label"]
    )
    out = pa.Table.from_batches(_apart((4, 5))(iter([batch.slice(0, 3), batch.slice(3)]))).to_pylist()
    groups = {}
    for r in out:
        groups.setdefault(r["key"], set()).add((r["node"], r["total"]))
    assert sorted(map(sorted, groups.values())) == [[(7, 2), (8, 2)], [(7, 3), (8, 3), (9, 3)]]
