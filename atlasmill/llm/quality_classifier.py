"""Quality scores from random-indexing word vectors and a small network.

Random indexing: every word bucket has a fixed sparse random vector; a bucket's word vector is the sum of the random
vectors of its neighbours over the whole corpus, accumulated in tasks as a matrix of constant size and added up by
blocks. A document is the mean and the spread of its words' vectors. A two-layer network is fitted on the driver
to a bounded sample of labelled documents and its temperature to a part of them kept apart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow
from .common import arrow_task, floats, held_out, packed, raw, sample_of, texts, unpacked

#: Word buckets, dimensions, places set in a random vector, neighbours on each side, words handled at once.
BUCKETS, DIMENSIONS, PLACES, REACH, SLICE = 1 << 14, 64, 2, 2, 1 << 18
#: Buckets of a block of the matrix, and words remembered per task.
BLOCK, REMEMBERED = 512, 300_000
#: Labelled documents used for the fit at most; hidden units, passes, rows of a step, rate, weight decay.
SAMPLE, HIDDEN, PASSES, STEP, RATE, DECAY = 20_000, 32, 60, 256, 3e-3, 1e-4
#: Score from which a document is kept.
THRESHOLD = 0.3
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]")


def random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's random vector."""
    rng = np.random.Generator(np.random.PCG64(61))
    return rng.integers(0, DIMENSIONS, (BUCKETS, PLACES)), rng.integers(0, 2, (BUCKETS, PLACES)) * 2.0 - 1.0


class Words:
    """Bucket numbers of a text's words, with a bounded memory."""

    def __init__(self):
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = _WORD.findall(text)
        new = set(words).difference(self.kept)
        if new:
            if len(self.kept) + len(new) > REMEMBERED:
                self.kept.clear()
                new = set(words)
            self.kept.update((w, zlib.crc32(w) % BUCKETS) for w in new)
        return np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the neighbours' random vectors over one task's texts, in blocks of buckets."""
    place, sign = random_vectors()
    total = np.zeros(BUCKETS * DIMENSIONS, np.float64)
    words, waiting, held = Words(), [], 0

    def add(ids: np.ndarray, text: np.ndarray) -> None:
        for reach in range(1, REACH + 1):
            same = text[reach:] == text[:-reach]
            a, b = ids[:-reach][same], ids[reach:][same]
            for here, there in ((a, b), (b, a)):
                for p in range(PLACES):
                    total[:] += np.bincount(here * DIMENSIONS + place[there, p], sign[there, p], BUCKETS * DIMENSIONS)

    def flush() -> None:
        nonlocal held
        if waiting:
            ids = np.concatenate(waiting)
            text = np.repeat(np.arange(len(waiting)), [len(w) for w in waiting])
            add(ids, text)
        waiting.clear()
        held = 0

    for batch in batches:
        for value in texts(batch.column("t")):
            ids = words(value)
            for at in range(0, len(ids), SLICE - REACH):  # slices of long texts overlap by the reach on one side only
                part = ids[max(0, at - REACH):at + SLICE - REACH]
                if at:
                    flush()
                    add(part, np.zeros(len(part), np.int8))
                    head = part[:REACH]
                    if len(head) > 1:  # pairs inside the overlap were counted before
                        total[:] -= _pairs(head, place, sign)
                else:
                    waiting.append(part)
                    held += len(part)
            if held >= SLICE:
                flush()
    flush()
    blocks = total.reshape(-1, BLOCK * DIMENSIONS)
    used = [i for i, b in enumerate(blocks) if b.any()]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), floats(blocks[used])], ["block", "sums"])


def _pairs(ids: np.ndarray, place: np.ndarray, sign: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS * DIMENSIONS)
    for reach in range(1, REACH + 1):
        for i in range(len(ids) - reach):
            for here, there in ((ids[i], ids[i + reach]), (ids[i + reach], ids[i])):
                for p in range(PLACES):
                    out[here * DIMENSIONS + place[there, p]] += sign[there, p]
    return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, value in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            part = np.frombuffer(value.as_buffer(), np.float32).astype(np.float64)
            sums[block] = sums[block] + part if block in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), floats(np.array(list(sums.values())))] if sums else
                                     [pa.array([], pa.int32()), pa.array([], pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Vectors of all word buckets from all texts: one row of length one per bucket that occurs beside another, else zero.

    What reaches the driver has a constant size (4 MB).
    """
    parts = map_arrow(docs.select(raw(text).alias("t")), _contexts, "block int, sums binary")
    done = map_arrow(parts.repartition(BUCKETS // BLOCK, "block"), _added, "block int, sums binary").collect()
    out = np.zeros((BUCKETS // BLOCK, BLOCK * DIMENSIONS))
    for r in done:
        out[r["block"]] = np.frombuffer(r["sums"], np.float32)
    out = out.reshape(BUCKETS, DIMENSIONS)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
    used = size[:, 0] > 0
    if used.any():
        out[used] -= out[used].mean(axis=0)
    return out.astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors and the logarithm of their number."""
    first, second = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for at in range(0, len(ids), 1 << 14):
        rows = vectors[ids[at:at + (1 << 14)]]
        first += rows.sum(axis=0, dtype=np.float64)
        second += np.einsum("ij,ij->j", rows, rows)
    n = max(1, len(ids))
    mean = first / n
    return np.concatenate((mean, np.sqrt(np.maximum(second / n - mean * mean, 0)), [np.log1p(len(ids))]))


def features(docs: DataFrame, vectors: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, x): pooled vector of each row; texts without words pool to zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("version"), raw(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(), shared.value
        for batch in batches:
            x = [pool(words(t), table).astype(np.float32).tobytes() for t in texts(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("version"), pa.array(x, pa.binary())], ["doc", "version", "x"])

    return map_arrow(frame, run, f"doc {frame.schema['doc'].dataType.simpleString()}, version bigint, x binary")


@dataclass(frozen=True)
class Network:
    """Standardised inputs, one hidden layer of tanh units, one output; the logit is divided by the temperature."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Network:
    """Adam on the logistic loss over the rows not kept apart, then the temperature of least loss on those kept apart.

    Without rows of both classes the score is the share of label 1 (0.5 without any row).
    """
    rng = np.random.Generator(np.random.PCG64(7))
    width = x.shape[1]
    center, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    share = (y.sum() + 1) / (len(y) + 2)
    params = [rng.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.array(np.log(share / (1 - share)))]
    train = np.nonzero(~apart)[0]
    if not 0 < y[train].sum() < len(train):
        return Network(center, scale, params[0] * 0, params[1], params[2] * 0, float(params[3]), 1.0)
    z = (x - center) / scale
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for k in range(PASSES):
        order = rng.permutation(train)
        for at in range(0, len(order), STEP):
            rows = order[at:at + STEP]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            inner = np.outer(error, params[2]) * (1 - hidden * hidden)
            slopes = [z[rows].T @ inner + DECAY * params[0], inner.sum(axis=0), hidden.T @ error + DECAY * params[2], error.sum()]
            step += 1
            for i, g in enumerate(slopes):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                rate = RATE * (1 - k / PASSES)
                params[i] = params[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(center, scale, *params[:3], float(params[3]), 1.0)
    check = apart if apart.any() else np.ones(len(y), bool)
    logit, target = net.logit(x[check]), y[check]
    warm = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, -np.where(target == 1, logit, -logit) / t).mean() for t in warm]
    return Network(center, scale, *params[:3], float(params[3]), float(warm[int(np.argmin(loss))]))


def train(found: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Network:
    """The network for pooled vectors, from labelled documents outside the held-out fold (about ``sample`` at most).

    A document with several labels counts with the smallest; null labels and ids teach nothing.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{label}`").cast("int").alias("y")).where("doc is not null and y is not null")
    known = known.groupBy("doc").agg(F.min("y").alias("y"))
    taught = sample_of(known.where(~held_out(F.col("doc"))), F.col("doc"), sample)
    rows = found.join(taught, "doc").dropDuplicates(["doc"]).orderBy(F.xxhash64("doc"), "doc").select(
        "x", "y", (F.pmod(F.xxhash64("doc", F.lit("apart")), F.lit(5)) == 0).alias("apart")).toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, 2 * DIMENSIONS + 1).astype(np.float64)
    return fit(x, rows.column("y").to_numpy().astype(np.float64), rows.column("apart").to_numpy().astype(bool))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, version): one row per row of ``docs``.

    ``score`` is the chance of label 1 from the text alone (null is read as empty; a text without words gets the score of
    zero vectors); ``predicted`` is 1 from ``threshold`` on. Repeated rows get equal scores.
    """
    found = cut_lineage(features(docs, word_vectors(docs, text), doc_id, text))
    net = train(found, labels, label=label, sample=sample)

    def rows(batch: pa.RecordBatch) -> list:
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1)
        return [batch.column("doc"), batch.column("version"), np.round(net.score(x), 9)]  # the same in batches of any size

    kind = found.schema["doc"].dataType.simpleString()
    scored = arrow_task(found, f"doc {kind}, version bigint, score double", rows)
    return scored.select(F.col("doc").alias("doc_id"), held_out(F.col("doc")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "version")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
              sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, unchanged."""
    good = score(docs, labels, doc_id, text, label, sample, threshold).where("predicted = 1").select(
        F.col("doc_id").alias("doc"), "version").dropDuplicates()
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{doc_id}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("v"))
    return unpacked(rows.join(good, F.col("k").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")), "left_semi"), docs)
