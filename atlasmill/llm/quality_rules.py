"""Quality rules on word statistics and tokeniser fertility.

Two public vocabularies are applied to every word (with one blank in front, repeats included): a multilingual
byte-level one measures characters per token, one with byte fallback the share of fallback bytes and the entropy
of its tokens. A document is rejected outside the bands of its language or, without one listed, its script.
"""

from __future__ import annotations

import base64
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_task, raw, texts

REMEMBERED, LONGEST = 300_000, 48
#: Base rules: least words, and the percentage of words in repeated three-word windows from which a text fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Characters per token (least, most), most fallback share, token entropy in bits (least, most); by language.
LANGUAGE_BANDS = {
    "de": (2.2, 9.0, 0.05, 5.2, 11.0), "en": (2.2, 9.0, 0.05, 5.2, 11.0),
    "es": (2.0, 9.0, 0.05, 5.2, 11.0), "fr": (2.0, 9.0, 0.05, 5.2, 11.0),
}
#: The same by script; ``other`` holds for all that are not named.
SCRIPT_BANDS = {
    "latin": (1.8, 9.0, 0.15, 5.0, 11.0), "greek": (0.8, 6.0, 0.4, 4.0, 11.0), "cyrillic": (1.0, 8.0, 0.3, 4.5, 11.0),
    "cjk": (0.3, 3.0, 0.8, 4.0, 12.0), "other": (0.2, 9.0, 0.95, 3.0, 12.0),
}
#: Ranges of code points by script.
SCRIPTS = {"greek": [(0x370, 0x400)], "cyrillic": [(0x400, 0x530)], "cjk": [(0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7B0)]}
_SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
_BLANKS = [bytes([c]) for c in b" \t\n\v\f\r"]


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Fertility:
    """Tokens of words under both vocabularies, with a bounded memory of words."""

    def __init__(self, pieces: str, ranks: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.fallback = np.array([self.pieces.IsByte(i) for i in range(self.pieces.GetPieceSize())])
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.ids: dict[bytes, bytes] = {}
        self.count: dict[bytes, int] = {}

    def measure(self, words: list[bytes]) -> tuple[int, float, float]:
        """Tokens (plain vocabulary), share of fallback bytes, and entropy of the tokens in bits."""
        new = set(words).difference(self.ids)
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids.clear()
            self.count.clear()
            new = set(words)
        order = list(new)
        decoded = [w.decode(errors="replace") for w in order]
        for w, text, ids in zip(order, decoded, self.pieces.encode(decoded, num_threads=1) if order else [], strict=True):
            self.ids[w] = np.array(ids, np.uint32).tobytes()
            self.count[w] = len(self.plain.encode_ordinary(" " + text))
        ids = np.frombuffer(b"".join(map(self.ids.__getitem__, words)), np.uint32)
        tokens = sum(map(self.count.__getitem__, words))
        for w in order:
            if len(w) > LONGEST:
                del self.ids[w], self.count[w]
        if not len(ids):
            return tokens, 0.0, 0.0
        each = np.bincount(ids)
        used = np.nonzero(each)[0]
        p = each[used] / len(ids)
        return tokens, float(each[used][self.fallback[used]].sum() / len(ids)), float(-(p * np.log2(p)).sum())


@lru_cache(maxsize=2)
def fertility(pieces: str, ranks: str) -> Fertility:
    return Fertility(pieces, ranks)


def script_of(text: bytes) -> str:
    """Script of most letters outside ASCII, if they outnumber the ASCII letters; else latin."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.decode(errors="replace").encode("utf-32-le"), np.uint32)
    latin = ((points >= 65) & (points <= 90) | (points >= 97) & (points <= 122) | (points >= 0xC0) & (points < 0x250)).sum()
    counts = {name: sum(((points >= a) & (points < b)).sum() for a, b in ranges) for name, ranges in SCRIPTS.items()}
    counts["other"] = (points >= 0x250).sum() - sum(counts.values())
    name = max(counts, key=counts.get)
    return name if counts[name] > latin else "latin"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:len(words) - 2 + k] |= twice
    return int(inside.sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    points = len(text) if text.isascii() else len(text.decode(errors="replace"))
    lines = Counter(line for line in text.split(b"\n") if line and not line.isspace())
    return (points - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)), sum(lines.values()) - len(lines), repeated_words(words))


def _band(lang: str | None, text: bytes, by_language: dict, by_script: dict) -> tuple:
    band = by_language.get(lang) if lang else None
    return band or by_script.get(script_of(text), by_script["other"])


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", vocabularies: tuple[str, str] | None = None,
          language_bands: dict | None = None, script_bands: dict | None = None) -> DataFrame:
    """Counts, fertility and verdict of every row.

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_per_token, byte_share,
    token_entropy). Null texts have no words; a text without words fails the base rules and has zeros. Without a
    language column, or with a null there, the script decides.
    """
    paths = vocabularies or default_vocabularies()
    by_language, by_script = language_bands or LANGUAGE_BANDS, script_bands or SCRIPT_BANDS

    def rows(batch: pa.RecordBatch) -> list:
        measure, out = fertility(*paths).measure, []
        for value, code in zip(texts(batch.column("t")), batch.column("lang").to_pylist(), strict=True):
            words = value.split()
            chars, symbols, dup, repeat = base_counts(value, words)
            tokens, share, entropy = measure(words)
            per_token = (chars + len(words)) / tokens if tokens else 0.0
            failed = len(words) < LEAST_WORDS or 100 * repeat > MOST_REPEATED * len(words)
            low, high, most, least_bits, most_bits = _band(code, value, by_language, by_script)
            fits = low <= per_token <= high and share <= most and least_bits <= entropy <= most_bits
            out.append((len(words), chars, symbols, dup, repeat, failed, not failed and fits, per_token, share, entropy))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
        return [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 10, kinds, strict=True)]]

    code = F.col(f"`{lang}`").cast("string") if lang and lang in docs.columns else F.lit(None).cast("string")
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), code.alias("lang"), raw(text).alias("t"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    return arrow_task(frame, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                             "base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double", rows)
