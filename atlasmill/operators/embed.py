"""Sequences to vectors through a pluggable model.

A model is a plain callable ``list[str] -> (n, D) array`` that runs inside
Arrow batches on the executors. Every distinct sequence is embedded once and
the result fanned out; sequences of similar length are put together so that
padded batches waste little.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import refuse_unknown
from ..session import map_arrow, task_width
from .align import fan_out, unique_sequences
from .arrays import list_column

Model = Callable[[list[str]], np.ndarray]

# Short model keys and the public model each stands for.
MODEL_KEYS = {
    "ankh3_large": "ElnaggarLab/ankh3-large",
    "ankh_base": "ElnaggarLab/ankh-base",
    "ankh_large": "ElnaggarLab/ankh-large",
    "esm2_150m": "facebook/esm2_t30_150M_UR50D",
    "esm2_35m": "facebook/esm2_t12_35M_UR50D",
    "esm2_3b": "ESM2_3B",
    "esm2_650m": "ESM2_650M",
    "esm2_8m": "ESM_8M",
    "esmc_300m": "Synthyra/ESMplusplus_small",
    "esmc_600m": "Synthyra/ESMplusplus_large",
    "prost_t5": "ProstT5",
    "prot_t5": "ProtT5",
}
_MODELS: dict[str, Model] = {}


def resolve_model_key(name: str) -> str:
    refuse_unknown("embedder", [name], MODEL_KEYS)
    return MODEL_KEYS[name]


def register_model(name: str, model: Model) -> None:
    _MODELS[name] = model


def get_model(name: str) -> Model:
    if name not in _MODELS:
        raise ValueError(f"no model registered as {name!r}; call register_model first")
    return _MODELS[name]


def composition(dim: int) -> Model:
    """A stand-in model: hashed 3-mer frequencies, for runs without a language model.

    A 3-mer's code is 961 a + 31 b + c of its code points (0 behind the end of a short sequence), modulo ``dim``.
    """
    return partial(_composition, dim=dim)


def _composition(sequences: list[str], dim: int) -> np.ndarray:
    out = np.zeros((len(sequences), dim))
    for row, s in enumerate(sequences):
        points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        points = np.concatenate((points, np.zeros(max(0, 3 - len(points)), np.int64)))
        codes = (961 * points[:-2] + 31 * points[1:-1] + points[2:]) % dim
        out[row] = np.bincount(codes, minlength=dim) / len(codes)
    return out


def embed(df: DataFrame, model: Model, id_col: str = "identifier", seq_col: str = "sequence", max_length: int | None = None) -> DataFrame:
    """(identifier, vec) for every row; sequences beyond ``max_length`` are left out."""
    rows = df.filter(F.length(seq_col) <= max_length) if max_length else df
    work = unique_sequences(rows, id_col, seq_col).select(seq_col)
    # range partitions by length give equally long batches; the hash spreads a frequent length
    spread = work.repartitionByRange(task_width(df.sparkSession), F.length(seq_col), F.xxhash64(seq_col))
    ordered = spread.sortWithinPartitions(F.length(seq_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vecs = np.asarray(model(batch.column(0).to_pylist()), dtype=np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), list_column(vecs, pa.float32())], names=[seq_col, "vec"]
                )

    done = map_arrow(ordered, run, f"`{seq_col}` string, vec array<float>")
    return fan_out(done, rows.select(id_col, seq_col), seq_col).select(id_col, "vec")


def probe(model: Model, sequences: list[str] = ("MKTAYIAKQR", "GAVLIPFMW")) -> dict:
    """Shape and range of two embedded rows."""
    out = np.asarray(model(list(sequences)))
    return {"rows": out.shape[0], "dim": out.shape[1], "min": float(out.min()), "max": float(out.max())}
