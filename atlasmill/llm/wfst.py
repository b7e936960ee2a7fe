"""SentencePiece models as weighted finite-state transducers over the tropical semiring.

Three machines are compiled from a model file: the normaliser (the model's character map, white space squeezed where the model
asks for it and turned to its mark, one mark in front), the lexicon (a trie whose final states emit a piece) and byte
fallback (a character outside the lexicon emits its bytes). Composed with an input they give a lattice of positions whose arcs are
pieces; the encoding is the shortest path from the first to the last position. User-defined symbols pass the
normaliser unchanged; in byte-pair models they are cut out before anything merges.

Arc weights are negated piece scores for unigram models. For byte-pair models the sum of scores does not
decide; there the lattice is also composed with an acceptor of piece bigrams: an arc weighs nothing after a piece
beside which its own piece would survive all merges, and is infinite after any other. A segmentation is the one that
merging gives exactly if each neighbouring pair is (the merge order is local), so the only finite path is the
model's encoding.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")
#: Distance of an unknown character's score below the lowest score, as unigram models have it.
UNKNOWN_PENALTY = 10.0
#: Neighbouring pieces whose verdict is remembered.
REMEMBERED_PAIRS = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialized protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces, scores and switches of a model file."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool = True, dummy_prefix: bool = True,
                 charsmap: bytes = b"", squeeze: bool = False):
        self.pieces, self.kind, self.byte_fallback, self.dummy_prefix = pieces, kind, byte_fallback, dummy_prefix
        self.charsmap, self.squeeze = charsmap, squeeze

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, kind, fallback, prefix, charsmap, squeeze = [], UNIGRAM, False, True, b"", True
        for number, value in _fields(data):
            if number == 1:
                part = dict(_fields(value))
                pieces.append((part.get(1, b"").decode(), struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0], part.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                kind, fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                if spec.get(24):
                    raise ValueError("models that put white space behind words are not supported")
            elif number == 3:
                spec = dict(_fields(value))
                if not spec.get(5, 1):
                    raise ValueError("only models that mark white space are supported")
                prefix, charsmap, squeeze = bool(spec.get(3, 1)), spec.get(2, b""), bool(spec.get(4, 1))
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} is not supported")
        return cls(pieces, kind, fallback, prefix, charsmap, squeeze)

    def symbols(self) -> dict[str, int]:
        """User-defined symbols and their ids."""
        return {piece: i for i, (piece, _, kind) in enumerate(self.pieces) if kind == USER}


def _longest_first(symbols) -> re.Pattern | None:
    return re.compile("|".join(re.escape(p) for p in sorted(symbols, key=lambda p: (-len(p), p)))) if symbols else None


class Normalizer:
    """The first machine: from raw text to marked text.

    A character map is a trie over UTF-8 bytes, stored as a double array (a unit has a label, an offset to its children and
    a flag that a value follows), and the strings that its values point to. At each place the longest match is rewritten; what
    nothing matches is copied. States of the trie are walked in the array itself.
    """

    def __init__(self, model: Model):
        self.prefix, self.squeeze = model.dummy_prefix, model.squeeze
        self.symbol = _longest_first(model.symbols())
        self.units: tuple[int, ...] = ()
        self.strings, self.single = b"", {}
        if model.charsmap:
            size = struct.unpack_from("<I", model.charsmap)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", model.charsmap, 4)
            self.strings = model.charsmap[4 + size:]

    def _match(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Behind the longest match at a place, and what it becomes."""
        units, found = self.units, None
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = offset(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units) or units[node] & 0x800000FF != data[end]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = end + 1, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start:self.strings.index(0, start)]

    def _pieces(self, text: str) -> Iterator[str]:
        """The rewritten text in small parts."""
        at = 0
        while at < len(text):
            symbol = self.symbol and self.symbol.match(text, at)
            if symbol:
                yield symbol.group()
                at = symbol.end()
                continue
            if not self.units:
                yield text[at]
                at += 1
                continue
            data = text[at:at + 32].encode("utf-8", "replace")  # keys of a map are short
            found = self._match(data, 0)
            if found is None:
                yield text[at]
                at += 1
            else:
                yield found[1].decode(errors="replace")
                at += len(data[:found[0]].decode())

    def __call__(self, text: str) -> str:
        if not self.units and not self.squeeze:
            return (MARK if self.prefix and text else "") + text.replace(" ", MARK)
        if not self.squeeze:
            text = "".join(self._pieces(text))
            return (MARK if self.prefix and text else "") + text.replace(" ", MARK)
        out, space = [], True
        for part in self._pieces(text):
            if space:
                part = part.lstrip(" ")
            if part:
                out.append(part)
                space = part.endswith(" ")
        text = "".join(out).rstrip(" ")
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)


class Transducer:
    """The compiled machines. ``encode`` takes marked text and returns piece ids."""

    def __init__(self, model: Model):
        self.model = model
        self.bytes = [0] * 256
        self.unknown = 0
        self.text: list[str] = [p for p, _, _ in model.pieces]
        self.score: list[float] = [s for _, s, _ in model.pieces]
        self.id: dict[str, int] = {}
        for i, (piece, _, kind) in enumerate(model.pieces):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind == NORMAL or (kind == USER and model.kind == UNIGRAM):
                self.id[piece] = i
        self.symbols = model.symbols() if model.kind == BPE else {}
        self.symbol = _longest_first(self.symbols)
        self.emit: list[tuple[int, ...]] = [(i,) for i in range(len(self.text))]
        known = [self.score[i] for i in self.id.values()]
        self.unknown_weight = UNKNOWN_PENALTY - min(known, default=0.0)
        # a character that only longer pieces hold still is a symbol; it emits its bytes
        for c in {c for piece in self.id for c in piece}:
            if c not in self.id:
                self.id[c] = len(self.text)
                self.text.append(c)
                self.score.append(-self.unknown_weight)
                self.emit.append(self._fallback(c))
        self.parts: dict[int, tuple[int, int]] = {}
        self._pairs: dict[int, bool] = {}
        if model.kind == BPE:
            self._split()
        self.trie: dict = {}
        for piece, i in self.id.items():
            if model.kind == BPE and len(piece) > 1 and i not in self.parts:
                continue  # merging never makes it
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i

    def _fallback(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in c.encode("utf-8", "surrogatepass")) if self.model.byte_fallback else (self.unknown,)

    # --- the bigram acceptor of byte-pair models

    def _merge(self, left: int, right: int) -> int | None:
        return self.id.get(self.text[left] + self.text[right])

    def _split(self) -> None:
        """The two pieces each longer piece is merged from, found by merging its characters in order of score."""
        for piece, i in sorted(self.id.items(), key=lambda x: len(x[0])):
            if len(piece) == 1:
                continue
            row = [self.id[c] for c in piece]
            while len(row) > 2:
                best, at = -INFINITE, -1
                for k in range(len(row) - 1):
                    made = self._merge(row[k], row[k + 1])
                    if made is not None and self.score[made] > best:
                        best, at = self.score[made], k
                if at < 0:
                    break
                row[at:at + 2] = [self._merge(row[at], row[at + 1])]
            if len(row) == 2:
                self.parts[i] = (row[0], row[1])

    def accepts(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces survive: no merge across the border comes before both sides are complete.

        Merges are undone from the last one back. At each step the two pieces at the border exist side by side until the
        earlier of the merges that took them in; a merge of the two that is due before that is fatal.
        On equal scores the leftmost merge comes first.
        """
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._survive(left, right)
        return known

    def _survive(self, x: int, y: int) -> bool:
        score, parts = self.score, self.parts
        end_x = end_y = -INFINITE  # score of the merge that takes a side in; later merges score lower
        while True:
            made = self._merge(x, y)
            if made is not None and score[made] > end_x and score[made] >= end_y:
                return False
            undo_x, undo_y = parts.get(x), parts.get(y)
            if undo_x is None and undo_y is None:
                return True
            # the merge made last is undone first; of equal ones the right one was
            if undo_y is None or (undo_x is not None and score[x] < score[y]):
                end_x, x = score[x], undo_x[1]
            else:
                end_y, y = score[y], undo_y[0]

    # --- composition with an input and shortest path

    def encode(self, text: str) -> list[int]:
        """Piece ids of marked text."""
        if self.symbol is None:
            return self._path(text)
        out, at = [], 0
        for found in self.symbol.finditer(text):
            out += self._path(text[at:found.start()])
            out.append(self.symbols[found.group()])
            at = found.end()
        return out + self._path(text[at:])

    def _path(self, text: str) -> list[int]:
        n, trie, score = len(text), self.trie, self.score
        weight = [INFINITE] * (n + 1)
        back: list[tuple[int, int]] = [(-1, -1)] * (n + 1)  # position before, piece (-1: a character outside the lexicon)
        weight[0] = 0.0
        bpe, accepts = self.model.kind == BPE, self.accepts
        for at in range(n):
            here = weight[at]
            if here == INFINITE:
                continue
            last = back[at][1]
            node, end = trie.get(text[at]), at + 1
            if node is None or (not bpe and "" not in node):
                if here + self.unknown_weight < weight[end]:
                    weight[end], back[end] = here + self.unknown_weight, (at, -1)
            while node is not None:
                piece = node.get("")
                if piece is not None:
                    if bpe:
                        if weight[end] > here and (last < 0 or accepts(last, piece)):
                            weight[end], back[end] = here, (at, piece)
                    elif here - score[piece] < weight[end]:
                        weight[end], back[end] = here - score[piece], (at, piece)
                if end == n:
                    break
                node, end = node.get(text[end]), end + 1
        path, at = [], n
        while at:
            before, piece = back[at]
            path.append(self.emit[piece] if piece >= 0 else self._fallback(text[before]))
            at = before
        return [i for part in reversed(path) for i in part]
