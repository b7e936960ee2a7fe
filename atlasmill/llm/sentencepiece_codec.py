"""SentencePiece encoding and decoding of document texts by transducer shortest paths.

No piece has a mark behind another character, so white space cuts a text into stretches that are encoded
independently; so does a line end where no piece contains one. Each task keeps the encodings of short stretches
it has met, in a table of bounded size. Ids travel as arrays; the encoding is the library's own, id by id.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_task, raw, texts
from .wfst import BYTE, CONTROL, MARK, UNKNOWN, Model, Normalizer, Transducer

#: Stretches remembered per task, and the longest that is.
REMEMBERED, LONGEST = 400_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder of one model; made once per worker by :func:`codec`."""

    def __init__(self, model: Model):
        self.model = model
        self.normalizer, self.machine = Normalizer(model), Transducer(model)
        inner = [p for p, _, kind in model.pieces if kind not in (BYTE, CONTROL, UNKNOWN)]
        self.by_space = not any(MARK in p.lstrip(MARK) for p in inner)
        self.by_line = self.by_space and not any("\n" in p for p in inner)
        self.kept: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.line_end = self._ids("\n")
        mark = MARK.encode()
        self.out = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN
                    else p.encode().replace(mark, b" ") for p, _, kind in model.pieces]

    def _ids(self, marked: str) -> bytes:
        return np.array(self.machine.encode(marked), np.uint32).tobytes()

    def _stretches(self, parts: list[str], marked: bool) -> list[bytes]:
        """Encodings of stretches without white space, all with a mark in front or all without."""
        table = self.kept[marked]
        new = set(parts).difference(table)
        if new:
            if len(table) + len(new) > REMEMBERED:
                table.clear()
                new = set(parts)
            front = MARK if marked else ""
            fresh = {p: self._ids(front + p) for p in new}
            table.update((p, ids) for p, ids in fresh.items() if len(p) <= LONGEST)
            if any(len(p) > LONGEST for p in fresh) or len(table) > 2 * REMEMBERED:
                return [table[p] if len(p) <= LONGEST else fresh[p] for p in parts]
        return list(map(table.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; without byte fallback a run of unknown characters is one id."""
        ids = self._encoded(text) if text else b""
        if self.model.byte_fallback or not ids:
            return ids
        values = np.frombuffer(ids, np.uint32)
        unknown = values == self.machine.unknown
        return values[~(unknown & np.concatenate(([False], unknown[:-1])))].tobytes()

    def _encoded(self, text: str) -> bytes:
        marked = self.normalizer(text)
        if not marked:
            return b""
        if not self.by_space:
            return self._ids(marked)
        out: list[bytes] = []
        for i, line in enumerate(marked.split("\n") if self.by_line else [marked]):
            if i:
                out.append(self.line_end)
            first, *rest = line.split(MARK)
            if first:
                out += self._stretches([first], False)
            if "" not in rest:
                out += self._stretches(rest, True)
                continue
            run = 0
            for part in rest:  # runs of white space belong to the stretch behind them
                run += 1
                if part:
                    out += self._stretches([part], True) if run == 1 else [self._ids(MARK * run + part)]
                    run = 0
            if run:
                out.append(self._ids(MARK * run))
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 text of ids; bytes that are no UTF-8 become the replacement character."""
        parts = list(map(self.out.__getitem__, ids))
        if self.model.squeeze or self.model.dummy_prefix:  # the mark in front is not part of the text
            for k, i in enumerate(ids):
                if self.model.pieces[i][2] == UNKNOWN:
                    break
                marked = parts[k].startswith(b" ")
                parts[k] = parts[k][marked:]
                if parts[k] or (marked and not self.model.squeeze):
                    break
        text = b"".join(parts)
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode(errors="replace").encode()
        return text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(Model.load(path))


def _lists(values: list[bytes]) -> pa.Array:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) // 4 for v in values], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), np.int32)))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, version, ids): piece ids of every row's whole text; ``version`` is the md5 of the text.

    Null and empty texts have no ids; repeated rows come back as often as they are given. Every worker reads the model from its own ``model`` path.
    """
    path = model or default_model()

    def rows(batch: pa.RecordBatch) -> list:
        encode_one = codec(path).encode
        return [batch.column("doc_id"), batch.column("version"), _lists([encode_one(t.decode(errors="replace")) for t in texts(batch.column("t"))])]

    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.md5(F.coalesce(raw(text), F.lit(b""))).alias("version"), raw(text).alias("t"))
    return arrow_task(frame, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, version string, ids array<int>", rows)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The rows of :func:`encode` with ``text`` decoded from the ids, their number and their crc32."""
    path = model or default_model()

    def rows(batch: pa.RecordBatch) -> list:
        decode_one = codec(path).decode
        ids = batch.column("ids")
        flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        parts = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        return [batch.column("doc_id"), batch.column("version"), pa.array([decode_one(p.tolist()).decode() for p in parts], pa.string()),
                pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())]

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return arrow_task(encoded.select("doc_id", "version", "ids"), f"doc_id {kind}, version string, text string, n_tokens bigint, ids_crc32 bigint", rows)
