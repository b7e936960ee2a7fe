"""Ranked search, vector codes and toxicity against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from atlasmill.llm import lexical_search, toxicity, vector_codes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHES = ["row", "k", "v", "doc", "version", "n", "terms", "tf", "parts", "of", "error", "code", "ids", "labels"]

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    held = [(d, terms_of(t)) for d, t in docs]
    held = [(d, w, Counter(w)) for d, w in held if w]
    n, length = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, w, c in held:
            m = 75 + 25 * len(w) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=str)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("query_terms", [16_384, 300])
def test_search_is_the_plain_ranking(spark, documents, query_terms):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = lexical_search.search(documents, items, query_terms=query_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    pairs = lambda df, k: [(r[k], r["text"]) for r in df.collect()]
    assert rows_of(found) == plain_search(pairs(documents, "doc_id"), pairs(items, "item_id"), 20)


def test_search_with_first_pass_copies_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "FIRST_ROWS", 100)
    monkeypatch.setattr(lexical_search, "CELLS", 1)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 40), p=np.arange(120, 0, -1) / 7260))) for i in range(900)]
    docs += [(900 + i, docs[7][1]) for i in range(400)]  # a third is one text: ties by id
    items = [(0, docs[7][1]), (1, "w3 w3 w90 w118"), (2, "W1, w2; w119 nowhere"), (3, "!?"), (4, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    found = lexical_search.search(df, spark.createDataFrame(items, "item_id bigint, text string"), top=7)
    assert rows_of(found) == plain_search(docs, items, 7)


def test_search_edges(odd, none, items):
    found = rows_of(lexical_search.search(odd, items))
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert found == plain_search(docs, [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(odd, items.limit(0)).count() == 0


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[list[tuple], str]:
    """Rows (id, vector, label) that are kept, coded with loops over all entries."""
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    edges = [x.shape[1] * i // parts for i in range(parts + 1)]
    books, codes, error = [], [], np.zeros(len(rows), np.int64)
    for a, b in zip(edges, edges[1:], strict=False):
        book = x[order, a:b].copy()
        near = lambda: ((x[:, None, a:b] - book[None]) ** 2).sum(axis=2)  # noqa: B023, E731
        for _ in range(rounds):
            owner = near().argmin(axis=1)
            for e in range(len(book)):
                if (owner == e).any():
                    book[e] = x[owner == e, a:b].sum(axis=0) // (owner == e).sum()
        codes.append(near().argmin(axis=1))
        error += near().min(axis=1)
        books.append(book)
    by_label = Counter()
    for (_, _, label), e in zip(rows, error.tolist(), strict=True):
        by_label[label] += e
    out = [(i, "".join(f"{c[k]:02x}" for c in codes), int(error[k]), label, by_label[label]) for k, (i, _, label) in enumerate(rows)]
    return out, hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


@pytest.mark.parametrize("block", [8192, 150])
def test_codes_are_the_plain_ones(spark, block):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(0, 0.2, (700, 32)), 2)  # coarse values: many ties
    v[200:420] = v[5]  # a third is one vector
    rows = [(i, [float(x) for x in v[i]], None if i % 9 == 0 else i % 3) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    wanted, sha = plain_codes(rows, 16, 64, 2)
    assert rows_of(vector_codes.encode(df, block=block)) == sorted(((*r, sha) for r in wanted), key=str)


def test_codes_edges(spark):
    good = [(3, [0.5, -0.25, 1.0], 1), (1, [0.1, 0.2, 0.3], None), (1, [0.1, 0.2, 0.3], None), (None, [-1.0, 0.0, 0.001], 2), (7, [9.0, 9.0, -9.0], 1)]
    bad = [(4, None, 1), (5, [], 1), (6, [1.0, None, 2.0], 1), (8, [float("nan"), 0.0, 0.0], 1), (9, [float("inf"), 0.0, 0.0], None), (10, [1.0, 2.0], 1)]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<float>, label int")
    df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    as_float = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in good]
    for parts, entries in ((16, 64), (2, 2)):
        wanted, sha = plain_codes(as_float, parts, entries, 2)
        assert rows_of(vector_codes.encode(df, parts=parts, entries=entries)) == sorted(((*r, sha) for r in wanted), key=str)
    assert vector_codes.encode(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="out of reach"):
        vector_codes.encode(spark.createDataFrame([(1, [1e30], 1)], df.schema["vec_id"].name + " bigint, embedding array<double>, label int")).collect()


def test_balls_are_owned_whole(spark):
    """Around far entries whole balls go over by their sums; the result is that of a full comparison."""
    rng = np.random.default_rng(4)
    book = rng.integers(-20_000, 20_000, (64, 4))
    x = (book[rng.integers(0, 64, 4000)] + rng.integers(-300, 300, (4000, 4))).astype(np.int64)
    points, weight = np.unique(x, axis=0, return_counts=True)
    tree = vector_codes.grow(points, weight)
    whole = sum(int(tree.count[at].sum()) for kind, at, _ in vector_codes.descend(tree, points, book) if kind == "ball")
    assert whole > 3000
    owner = ((points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (vector_codes.nearest(tree, points, book) == owner).all()
    sums = np.zeros((64, 5), np.int64)
    np.add.at(sums, owner, np.column_stack((points * weight[:, None], weight)))
    assert (vector_codes.sums_by_entry(tree, points, weight, book) == sums).all()


def edits(a: str, b: str) -> int:
    """Levenshtein distance of a word to a term; signs that stand for the term's letter are that letter."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (y not in x + toxicity.LOOKS_LIKE.get(x, "")))
    return row[-1]


def test_speller_is_the_edit_distance():
    terms = ["abracadabra", "bacab", "cabby", "abc", "dabbed", "stem*", "cadabra"]
    speller, rng = toxicity.Speller(terms), np.random.default_rng(8)
    words = {"".join(rng.choice(list("abcd4"), rng.integers(1, 12))) for _ in range(4000)}
    for t in terms[:-2]:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(0, len(w))
                w[at:at + rng.integers(0, 2)] = rng.choice(list("abcdx@"), rng.integers(0, 2)).tolist()
                if not w:
                    w = ["a"]
            words.add("".join(w))
    met = 0
    for w in sorted(words):
        good = [(edits(w, t), k) for k, t in enumerate(terms) if not t.endswith("*") and edits(w, t) <= speller.edits[k]]
        assert speller.find(w) == (min(good) if good else None), w
        met += bool(good)
    assert met > 250
    assert speller.find("stemming") == (0, 5) and speller.find("stem") == (0, 5) and speller.find("stam") is None


def model(**more) -> toxicity.Model:
    return toxicity.Model(["nitwit", "blockhead"], [5.0, 4.0], frozenset(), {}, **more)


def test_window_tells_quotation_from_abuse():
    def kinds(text: str) -> list[bool]:
        x = toxicity.Reader(model()).features(text.encode())
        return [bool(v) for v in (x[0], x[3], x[5], x[6])]

    assert kinds("you are a nitwit and nothing else") == [True, False, False, False]
    assert kinds("what a n1twit you are, a real blokhead") == [True, True, False, False]
    assert kinds('the sign read "nitwit" in large letters') == [False, False, True, False]
    assert kinds("the headline „nitwitt“ was printed") == [False, False, False, True]
    assert kinds("the word nitwit comes from two others") == [False, False, True, False]
    assert kinds("nitwiiiiiit !") == [False, True, False, False]
    assert kinds("a clean text") == [False] * 4 and kinds("") == [False] * 4


def test_toxicity_is_learned(spark):
    """Held-out documents, copies of one marked text, misspelt terms and quotations."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), 5))
    rows, marks = [], []
    for i in range(1200):
        words = [word() for _ in range(30)]
        bad = i % 8 == 0
        if bad:
            words[10], words[20] = rng.choice(["blockhead", "nincompoop"], 2)
        if i % 50 == 0 and bad:
            words[10] = words[20] = "blokhead"
        rows.append((i, " ".join(words)))
        marks.append((i, 0, int(bad)))
    for i in range(1200, 1300):  # copies of one text that is marked by mistake
        rows.append((i, "copied words about gardens and many other things that are in them " + str(i % 40)))
        marks.append((i, 0, 1))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    learned = toxicity.train(docs, labels)
    assert {"blockhead", "nincompoop"} <= set(learned.terms) and not {"gardens", "copied"} & set(learned.terms)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 1300 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    fresh = [i for i in range(1200) if got[i]["held_out"]]
    assert len(fresh) > 200
    assert np.mean([got[i]["predicted"] for i in fresh if i % 8 == 0]) >= 0.95
    assert np.mean([got[i]["predicted"] for i in fresh if i % 8]) <= 0.01


def test_toxicity_fold_and_sample_data(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    swapped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = rows_of(toxicity.score(docs, labels)), rows_of(toxicity.score(docs, swapped))
    assert first == second and len(first) == docs.count()  # labels of the held-out fold teach nothing
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    fresh = [(known[d], p) for d, held, _, p, _ in first if held and d in known]
    assert np.mean([y == p for y, p in fresh]) >= 0.85


def test_toxicity_edges(odd, none, labels):
    out = toxicity.score(odd, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "hits"] and out.count() == odd.count()
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(odd, labels.limit(0)).where("predicted = 1").count() == 0
