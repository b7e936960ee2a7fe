"""Token ids as length-delimited binary records with an offset index.

A record is an 8-byte length, the masked checksum of those bytes, the serialized ids and their masked checksum
(all little endian). Documents are range-partitioned by id and sorted, so each task streams its range into files of
its own; the files in order of range and sequence hold the documents in ascending order. The index (one row per
record: file, offset, length, ids before it) is a table of its own, so that shuffled reads can seek to any record.

A task never overwrites another's file: names carry a random part, and only names that reach the index through
Spark's own commit count, so retried and speculative attempts leave unreferenced files at most. Ids are written as
16-bit integers if the vocabulary allows it. The mask is TFRecord's; the checksum under it is CRC-32, for which
there is a native implementation at hand.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow, shared_folder
from .common import raw, texts

#: Bytes after which a task goes on in a new file, and most bytes read at once.
FILE_BYTES, READ_BYTES = 256 << 20, 8 << 20
#: Words remembered per task, and the longest that is.
REMEMBERED, LONGEST = 800_000, 48
#: Bytes of a record beside its ids.
_FRAME = 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


class Encoder:
    """A byte-level vocabulary of the tokenizers library, with a bounded memory of words.

    Its splitting pattern never joins what stands before a single blank or line end with what follows, if there is no
    other white space beside it. Such words are given to the library once, many in one text with line ends
    between them, and remembered; a line end before a word is part of its key. Texts with other or with
    neighbouring white space, and texts that hold an added token (such as ``<|endoftext|>``), are given to the
    library as they are.
    """

    _OTHER = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _NEIGHBOURS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.added = tuple(t.content for t in added)
        # such tokens could be met in normalised or joined text alone
        self.whole = any(re.search(r"\s", t.content) or (t.normalized and self.library.normalizer is not None) for t in added)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.kept: dict[str, bytes] = {}
        self.line_end = self._library("\n")
        if len(self.line_end) != 1:
            raise ValueError("the vocabulary has no token for a line end")

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that hold no line end but one in front; the others have a blank before them."""
        out = {}
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            ids = self._library("".join(w if w[0] == "\n" else "\n " + w for w in part))
            edges = [*np.nonzero(ids == self.line_end[0])[0].tolist(), len(ids)]
            if len(edges) != len(part) + 1:
                raise ValueError("a word holds the token of a line end")
            data, width = ids.tobytes(), self.kind.itemsize
            for w, a, b in zip(part, edges, edges[1:], strict=False):
                out[w] = data[(a + (w[0] != "\n")) * width:b * width]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as the library gives them by default: none is put around it, an added token in the text is one id."""
        if not text:
            return b""
        if self.whole or any(x in text for x in self.added) or text[0].isspace() or text[-1].isspace() or any(x in text for x in self._NEIGHBOURS) or (not text.isascii() and self._OTHER.search(text)):
            return self._library(text).tobytes()
        words = ("\n" + text.replace("\n", " \n")).split(" ")
        table = self.kept
        new = set(words).difference(table)
        if new:
            if len(table) + len(new) > REMEMBERED:
                table.clear()
                new = set(words)
            fresh = self._learn(list(new))
            long = [w for w in fresh if len(w) > LONGEST]
            table.update(fresh)
            out = b"".join(map(table.__getitem__, words))
            for w in long:
                del table[w]
        else:
            out = b"".join(map(table.__getitem__, words))
        return out[self.kind.itemsize:]  # the line end put in front


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _filesystem(uri: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)


def _writer(folder: str, vocabulary: str, end_id: int, file_bytes: int, kind: str):
    schema = pa.schema([("doc_id", kind), ("file", pa.string()), ("part", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()),
                        ("before", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], enc.kind).tobytes()
        out, name, at, before = None, "", 0, 0
        for batch in batches:
            rows = []
            for text in texts(batch.column("t")):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    store.create_dir(root, recursive=True)
                    name, at = f"ids-{part:06d}-{uuid.uuid4().hex}.rec", 0
                    out = store.open_output_stream(f"{root}/{name}")
                data = enc.encode(text.decode(errors="replace")) + end
                size = struct.pack("<Q", len(data))
                out.write(b"".join((size, struct.pack("<I", masked(size)), data, struct.pack("<I", masked(data)))))
                n = len(data) // enc.kind.itemsize
                rows.append((name, part, at, len(data), before, n))
                at, before = at + len(data) + _FRAME, before + n
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)] if rows else None
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(schema.field(0).type), *columns], schema=schema)
        if out is not None:
            out.close()

    return run


def write_records(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text",
                  vocabulary: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Write every row's ids, each ending with ``end_id``; the index and the folder.

    Index: doc_id, file, part, offset, length, start (ids before the record), n_tokens. Rows come in ascending
    order of id (nulls first), equal ids by text. Null and empty texts are records with the end id alone; an empty table
    gives no file and an empty index. ``folder`` must be reachable from all executors (default: in the shared one).
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), raw(text).alias("t")).repartitionByRange("doc_id", F.xxhash64("t"))
    kind = frame.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    run = _writer(folder, vocabulary or default_vocabulary(), end_id, file_bytes, to_arrow_type(kind))
    schema = f"doc_id {kind.simpleString()}, file string, part int, offset bigint, length bigint, before bigint, n_tokens bigint"
    index = cut_lineage(map_arrow(frame.sortWithinPartitions("doc_id", "t"), run, schema))
    sizes = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    firsts = [0, *accumulate(n for _, n in sizes)]
    # one row per task of the write
    base = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, firsts, strict=False)] or [(0, 0)], "part int, base bigint")
    placed = index.join(F.broadcast(base), "part").select("doc_id", "file", "part", "offset", "length", (F.col("base") + F.col("before")).alias("start"), "n_tokens")
    return placed, folder


def _reader(folder: str, width: int):
    kind = np.dtype(f"<u{width}")

    def record(data: memoryview, at: int, length: int) -> np.ndarray:
        head = bytes(data[at:at + 8])
        size, check = struct.unpack("<QI", data[at:at + 12])
        body = bytes(data[at + 12:at + 12 + length])
        if size != length or check != masked(head) or struct.unpack("<I", data[at + 12 + length:at + _FRAME + length])[0] != masked(body):
            raise ValueError(f"damaged record at offset {at}")
        return np.frombuffer(body, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        name, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            counts, sums, i = [], [], 0
            while i < len(files):
                j = i + 1  # neighbouring records are read at once
                while j < len(files) and files[j] == files[i] and offsets[j] == offsets[j - 1] + lengths[j - 1] + _FRAME and offsets[j] - offsets[i] < READ_BYTES:
                    j += 1
                if files[i] != name:
                    if source is not None:
                        source.close()
                    name, source = files[i], store.open_input_file(f"{root}/{files[i]}")
                source.seek(offsets[i])
                data = memoryview(source.read(offsets[j - 1] + lengths[j - 1] + _FRAME - offsets[i]))
                for k in range(i, j):
                    ids = record(data, offsets[k] - offsets[i], lengths[k])
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                i = j
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])
        if source is not None:
            source.close()

    return run


def read_records(index: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, checksums verified; ids counted as 32-bit integers."""
    width = encoder(vocabulary or default_vocabulary()).kind.itemsize
    frame = index.select("doc_id", "start", "file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return map_arrow(frame, _reader(folder, width), f"doc_id {index.schema['doc_id'].dataType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint")
