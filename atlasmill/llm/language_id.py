"""Language identification in two levels: the family first, then one-versus-one machines within it.

Texts become hashed counts of byte pairs and triples over lower-cased letters. Linear support vector machines (squared
hinge) tell each family from the rest, and each pair of languages of a family apart. They are fitted on the driver to
a sample bounded per language; every document is scored over its whole text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import floats, held_out, raw, texts

#: Buckets for pairs and triples, documents per language for the fit, cost of an error, descent steps.
PAIRS, TRIPLES, SAMPLE, COST, STEPS = 1024, 2048, 800, 30.0, 150
#: Family of each language code (fixed values); a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"], "baltic": ["lt", "lv"], "turkic": ["az", "kk", "ky", "tr", "tk", "uz"],
    "iranian": ["fa", "ku", "ps", "tg"], "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"], "semitic": ["ar", "he", "mt"],
    "dravidian": ["kn", "ml", "ta", "te"], "malayic": ["id", "jv", "ms", "su", "tl"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Capital ASCII letters to small ones, other ASCII bytes that are no letters to blanks.
_TABLE = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_ASCII_LETTER, _BLANKS = re.compile(rb"[A-Za-z]"), re.compile(rb" +")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode(errors="replace")))


def grams(text: bytes) -> np.ndarray:
    """Square roots of the hashed counts, scaled to length one."""
    if not text.isascii():
        text = text.decode(errors="replace").lower().encode()
    clean = b" " + _BLANKS.sub(b" ", text.translate(_TABLE)).strip(b" ") + b" "
    out = np.zeros(PAIRS + TRIPLES)
    for at in range(0, len(clean), 1 << 20):  # long texts in slices that overlap by two bytes
        data = np.frombuffer(clean, np.uint8)[max(0, at - 2):at + (1 << 20)].astype(np.uint32)
        pair = (data[:-1] << np.uint32(8)) | data[1:]
        triple = (pair[:-1] << np.uint32(8)) | data[2:]
        pair = pair[1:] if at else pair
        out[:PAIRS] += np.bincount((pair * np.uint32(2654435761)) >> np.uint32(22), minlength=PAIRS)
        out[PAIRS:] += np.bincount((triple * np.uint32(2246822519)) >> np.uint32(21), minlength=TRIPLES)
    out = np.sqrt(out)
    return out / max(1e-12, np.linalg.norm(out))


def machine(x: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = STEPS) -> np.ndarray:
    """Weights (the last one constant) of a linear machine for y = +1 or -1, classes weighed alike, by accelerated descent."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    y = y.astype(x.dtype)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    weight, fixed = weight.astype(x.dtype), np.append(np.ones(x.shape[1] - 1, x.dtype), x.dtype.type(0))
    rate = x.dtype.type(1 / (1 + 4 * cost))
    w = before = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        ahead = w + x.dtype.type(k / (k + 3)) * (w - before)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        slope = ahead * fixed - (2 * weight * slack * y) @ x
        before, w = w, ahead - rate * slope
    return w


class Tree:
    """Machines of both levels."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.members: dict[str, list[str]] = defaultdict(list)
        for code in sorted(set(lang.tolist())):
            self.members[FAMILY_OF.get(code, code)].append(code)
        self.families = sorted(self.members)
        family = np.array([FAMILY_OF.get(c, c) for c in lang.tolist()])
        self.first = {f: machine(x, np.where(family == f, 1.0, -1.0)) for f in self.families} if len(self.families) > 1 else {}
        self.pairs = {}
        for codes in self.members.values():
            for a, b in combinations(codes, 2):
                rows = (lang == a) | (lang == b)
                self.pairs[a, b] = machine(x[rows], np.where(lang[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: chance of the family times the mean chance of the language in its duels."""
        chance = lambda w: 1 / (1 + np.exp(-np.clip(3 * (x @ w[:-1] + w[-1]), -30, 30)))
        of = np.stack([chance(self.first[f]) if self.first else np.ones(len(x)) for f in self.families], axis=1)
        best = of.argmax(axis=1)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for i, f in enumerate(self.families):
            rows, codes = best == i, self.members[f]
            votes, sure = np.zeros((len(x), len(codes))), np.zeros((len(x), len(codes)))
            for a, b in combinations(range(len(codes)), 2):
                p = chance(self.pairs[codes[a], codes[b]])
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                sure[:, a] += p
                sure[:, b] += 1 - p
            duels = max(1, len(codes) - 1)
            won = (votes + sure / (duels + 1)).argmax(axis=1)
            lang[rows] = np.array(codes, object)[won[rows]]
            within = sure[np.arange(len(x)), won] / duels if len(codes) > 1 else np.ones(len(x))
            score[rows] = (of[:, i] * within)[rows]
        return lang, score


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Tree | None:
    """Machines from about ``sample`` documents per language, chosen by a hash of the id outside the held-out fold."""
    known = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{lang}`").cast("string").alias("lang"), raw(text).alias("t")).where(
        F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("doc")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(v) for code, n in sorted(counts.items()) for v in (code, min(1.0, sample / n))])
    drawn = F.shiftrightunsigned(F.xxhash64("doc", F.lit("language")), 11) / float(1 << 53) < shares[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(code, grams(t)) for code, t in zip(batch.column("lang").to_pylist(), texts(batch.column("t")), strict=True) if has_letter(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows]), floats(np.array([g for _, g in rows]))], ["lang", "x"])

    found = map_arrow(known.where(drawn).select("lang", "t"), run, "lang string, x binary").toArrow()
    rows = sorted(zip(found.column("lang").to_pylist(), found.column("x").to_pylist(), strict=True))  # whatever order the tasks ended in
    if not rows:
        return None
    x = np.frombuffer(b"".join(v for _, v in rows), np.float32).reshape(len(rows), -1)
    return Tree(x, np.array([code for code, _ in rows], object))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``.

    ``und`` with score 0 if the text is null or holds no letter, or if no document has a language to learn from. Languages
    are learned from the rows outside the held-out fold only; a prediction uses the text alone.
    """
    tree = fit(docs, doc_id, text, lang, sample)
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"), raw(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 512):
                values = list(texts(batch.column("t").slice(at, 512)))
                rows = [i for i, t in enumerate(values) if model is not None and has_letter(t)]
                if rows:
                    there = np.array(rows) + at
                    lang[there], score[there] = model.predict(np.array([grams(values[i]) for i in rows]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(frame, run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
