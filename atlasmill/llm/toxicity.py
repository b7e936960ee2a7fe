"""Toxicity by a learned lexicon, caught misspellings and the words around a hit.

The lexicon is learned from labelled texts: words, and stems of words (``stem*``), that toxic documents hold far more often than
others, in many different surroundings (copies of one text are one surrounding). Its terms form a trie, and the Levenshtein automata of all words
are intersected with it at once: a state is a set of (trie node, edits so far), made deterministic state by state as words ask for
it, so that most words die after two or three characters. Digits and signs that stand for letters cost no edit.

A hit is judged by its window: between quotation marks, or next to a word of reporting, it counts as quoted; words around hits in toxic
and in clean documents give a context score. Misspelt forms that labelled clean documents hold as well are ordinary words.
A logistic model over counts of these kinds of hits, with a prior that keeps kinds nobody has seen near their usual
meaning, gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, map_arrow
from .common import arrow_task, raw, sample_of, texts

#: Labelled documents of each class used for the fit at most; terms of the lexicon; misspelt forms and context words remembered.
SAMPLE, LEXICON, FORMS, CONTEXTS = 10_000, 400, 20_000, 5_000
#: Toxic documents that hold a term at least (number, share), share of them with a surrounding of their own, letters of a stem.
LEAST, LEAST_SHARE, OWN_SHARE, STEMS = 3, 0.005, 0.5, range(4, 9)
#: Toxic documents from which the context words and the weights are learned from two halves.
HALVES = 200
#: Words on each side of a hit; words to a quotation mark; edits for terms of that length or more; score from which a text counts as toxic.
WINDOW, QUOTE_REACH, EDITS, THRESHOLD = 6, 12, ((9, 2), (5, 1)), 0.3
#: Strongest words whose misspellings are sought; words remembered by a task, words counted at once, pairs kept in the automaton's states.
SPELLED, REMEMBERED, COUNTED, PAIRS = 100, 200_000, 200_000, 500_000
#: Characters that stand for letters, quotation marks, words of reporting.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "il", "*": "aeiou"}
QUOTES = set("\"“”„«»")
REPORTING = set("said says say quote quoted quotes quoting called calls calling word words term terms wrote writes insult insults slur slurs dit mot terme sagte sagt wort dijo dice palabra".split())
_TOKEN = re.compile(r"[\"“”„«»]|[^\W_][\w@$]*(?:[!*'’-][\w@$]+)*|[@$][\w@$!*]+")
_RUN = re.compile(r"(.)\1{2,}")


def tokens(text: bytes) -> list[str]:
    """Lower-cased words and quotation marks."""
    return _TOKEN.findall(text.decode(errors="replace").lower())


class Speller:
    """The trie of a lexicon and its intersection with the Levenshtein automata of words.

    A term that ends in ``*`` is a stem: it stands for all words that begin so, without edits.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        words = [t for t in terms if not t.endswith("*")]
        self.edits = [self.allowed(t) if t in set(words[:SPELLED]) else 0 for t in terms]
        self.child: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.limit = [0]
        self.stem: set[int] = set()
        for number, term in enumerate(terms):
            allowed, node = self.edits[number], 0
            self.limit[0] = max(self.limit[0], allowed)
            for c in term.removesuffix("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term.append(-1)
                    self.limit.append(0)
                node = self.child[node][c]
                self.limit[node] = max(self.limit[node], allowed)
            self.term[node] = number if self.term[node] < 0 else min(number, self.term[node])
            if term.endswith("*"):
                self.stem.add(node)
        self._forget()

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if term.endswith("*") else next((edits for length, edits in EDITS if len(term) >= length), 0)

    def _forget(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.pairs = 0
        self.accepts: list[tuple[int, int] | None] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """Number of the state with these least edits by node; missing letters of the term are tried at once."""
        todo = list(least.items())
        while todo:
            node, edits = todo.pop()
            if least[node] < edits:
                continue
            for to in self.child[node].values():
                if edits + 1 <= self.limit[to] and edits + 1 < least.get(to, 99):
                    least[to] = edits + 1
                    todo.append((to, edits + 1))
        key = frozenset(4 * node + edits for node, edits in least.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.pairs += len(key)
            good = [(p % 4, self.term[p // 4]) for p in key if self.term[p // 4] >= 0 and p % 4 <= self.edits[self.term[p // 4]]]
            self.accepts.append(min(good) if good else None)
            self.steps.append({})
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        same = c + LOOKS_LIKE.get(c, "")
        for pair in self.states[state]:
            node, edits = divmod(pair, 4)
            if node in self.stem and edits < least.get(node, 99):  # the rest of a stem's word
                least[node] = edits
            if edits < self.limit[node]:
                if edits + 1 < least.get(node, 99):  # a letter too many
                    least[node] = edits + 1
                for letter, to in self.child[node].items():
                    now = edits if letter in same else edits + 1
                    if now <= self.limit[to] and now < least.get(to, 99):
                        least[to] = now
            else:
                for letter in same:
                    to = self.child[node].get(letter)
                    if to is not None and edits <= self.limit[to] and edits < least.get(to, 99):
                        least[to] = edits
        return self._state(least) if least else -1

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within its edits, by the order of the lexicon on ties."""
        if self.pairs > PAIRS:
            self._forget()
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            if to is None:
                to = self.steps[state][c] = self._step(state, c)
            if to < 0:
                return None
            state = to
        return self.accepts[state]


#: Prior mean and precision of the logistic weights: strength of the strongest exact hit, sum of strengths (log), their sum per 100 words (log);
#: strongest misspelt hit, number of those (log); quoted exact, quoted misspelt; context score; bias.
PRIOR = np.array([0.8, 0.3, 0.3, 0.5, 0.2, 0.0, 0.0, 0.3, -4.0])
PRECISION = np.array([2.0, 2.0, 2.0, 4.0, 4.0, 2.0, 2.0, 2.0, 0.1])


@dataclass(frozen=True)
class Model:
    """What scoring needs: terms by falling strength (log-odds less their deviation), forms that are no misspellings, context weights, logistic weights (bias last)."""

    terms: list[str]
    strength: list[float]
    ordinary: frozenset[str]
    context: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: PRIOR)


class Reader:
    """Features of texts under a model, with a bounded memory of words."""

    def __init__(self, model: Model):
        self.model, self.speller = model, Speller(model.terms)
        self.known: set[str] = set()
        self.hit: dict[str, tuple[int, int]] = {}

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(place, edits, term) of the words that are terms or misspelt ones."""
        new = set(words) - self.known
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.hit.clear()
            new = set(words)
        for w in new:
            found = self.speller.find(w)
            if found is None and (short := _RUN.sub(r"\1", w)) != w:
                found = self.speller.find(short)
                found = found and (max(1, found[0]), found[1])
            if found is not None and not (found[0] and w in self.model.ordinary):
                self.hit[w] = found
        self.known |= new
        if self.hit.keys().isdisjoint(words):
            return []
        return [(i, *self.hit[w]) for i, w in enumerate(words) if w in self.hit]

    def features(self, text: bytes) -> np.ndarray:
        words = tokens(text)
        found = self.hits(words)
        out = np.zeros(len(PRIOR) - 1)
        if not found:
            return out
        exact, wrong, best = [], [], -math.inf
        for place, edits, term in found:
            if quoted(words, place):
                out[5 if edits == 0 else 6] = 1
            else:
                (wrong if edits else exact).append(self.model.strength[term])
            best = max(best, sum(self.model.context.get(w, 0.0) for w in window(words, place)))
        total = sum(exact)
        out[:5] = max(exact, default=0), math.log1p(total), math.log1p(100 * total / len(words)), max(wrong, default=0), math.log1p(len(wrong))
        out[7] = max(-5.0, min(5.0, best))
        return out


def window(words: list[str], place: int) -> list[str]:
    return words[max(0, place - WINDOW):place] + words[place + 1:place + 1 + WINDOW]


def quoted(words: list[str], place: int) -> bool:
    """Between quotation marks not far away, with an open one before it, or beside a word of reporting."""
    before, after = words[max(0, place - QUOTE_REACH):place], words[place + 1:place + 1 + QUOTE_REACH]
    mark = next((w for w in reversed(before) if w in QUOTES), None)
    if mark is not None and any(w in QUOTES for w in after):
        if mark in "„“«" or (mark == '"' and sum(w == '"' for w in words[:place]) % 2):
            return True
    return not REPORTING.isdisjoint(window(words, place))


def _forms(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _spread(taught: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many documents of each class every word, and every stem, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[1] for v in total.values()], pa.int64()),
                                              pa.array([v[0] for v in total.values()], pa.int64())], ["word", "toxic", "clean"])
            total.clear()
            return out

        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), texts(batch.column("t")), strict=True):
                for w in _forms(set(tokens(t))):
                    total.setdefault(w, [0, 0])[y] += 1
                if len(total) > COUNTED:
                    yield counted()
        yield counted()

    rows = map_arrow(taught.select("y", "t"), run, "word string, toxic bigint, clean bigint")
    return rows.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> tuple[Column, Column]:
    """Log-odds ratio less its standard deviation, and the ratio over the deviation."""
    a, b, c, d = toxic + 0.5, F.lit(n_toxic + 0.5) - toxic, clean + 0.5, F.lit(n_clean + 0.5) - clean
    ratio, deviation = F.log(a / b) - F.log(c / d), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return ratio - deviation, ratio / deviation


def _lexicon(taught: DataFrame, spread: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[float], float]:
    """Terms by falling strength, the strengths, and the z-score asked for: so high that chance would let about one word through."""
    able = spread.where(F.col("toxic") >= max(LEAST, int(LEAST_SHARE * n_toxic))).where((F.length("word") >= 3) & ~F.col("word").isin(*QUOTES))
    z = NormalDist().inv_cdf(1 - 1 / (able.count() + 20))
    ratio, score = _odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    rows = able.select("word", "toxic", ratio.alias("strength"), score.alias("z")).where(F.col("z") >= z).orderBy(
        F.desc("z"), F.col("word").endswith("*"), F.desc(F.length("word")), "word").limit(4 * LEXICON).collect()
    own = _surroundings(taught, [r["word"] for r in rows])
    chosen: dict[str, tuple[float, int]] = {}
    for r in rows:
        word, many = r["word"], r["toxic"]
        if own.get(word, 0) < OWN_SHARE or len(chosen) >= LEXICON:
            continue
        if word.endswith("*") and any(w.startswith(word[:-1]) and many <= 1.2 * n for w, (_, n) in chosen.items()):
            continue  # hardly more than a term that is there already
        chosen[word] = r["strength"], many
    order = sorted(chosen, key=lambda w: (-chosen[w][0], w))
    return order, [chosen[w][0] for w in order], z


def _surroundings(taught: DataFrame, words: list[str]) -> dict[str, float]:
    """For each word the share of the toxic documents holding it that have a neighbourhood of their own around it."""
    wanted = frozenset(words)

    def rows(batch: pa.RecordBatch) -> list:
        word, around = [], []
        for t in texts(batch.column("t")):
            found, seen = tokens(t), set()
            for i, x in enumerate(found):
                for w in (_forms({x}) & wanted) - seen:
                    seen.add(w)
                    word.append(w)
                    around.append("\n".join(found[max(0, i - 2):i + 3]))
        return [pa.array(word, pa.string()), pa.array(around, pa.string())]

    pairs = arrow_task(taught.where("y = 1").select("t"), "word string, around string", rows)
    alike = pairs.groupBy("word", "around").agg(F.count("*").alias("n"))
    return {r["word"]: r["own"] / r["n"] for r in alike.groupBy("word").agg(F.count("*").alias("own"), F.sum("n").alias("n")).collect()}


def _contexts(taught: DataFrame, terms: list[str]) -> dict[str, float]:
    """Log-ratio of words around exact hits, toxic documents against clean ones; empty if either is hardly met."""
    known = frozenset(w for w in terms if not w.endswith("*"))

    def rows(batch: pa.RecordBatch) -> list:
        total: dict[str, list[int]] = {"": [0, 0]}
        for y, t in zip(batch.column("y").to_pylist(), texts(batch.column("t")), strict=True):
            found = tokens(t)
            if known.isdisjoint(found):
                continue
            near = {w for i, x in enumerate(found) if x in known for w in window(found, i) if w not in known}
            for w in near | {""}:
                total.setdefault(w, [0, 0])[y] += 1
        return [pa.array(list(total), pa.string()), pa.array([v[1] for v in total.values()], pa.int64()), pa.array([v[0] for v in total.values()], pa.int64())]

    met = arrow_task(taught.select("y", "t"), "word string, toxic bigint, clean bigint", rows).groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    top = met.where("toxic + clean >= 5 or word = ''").orderBy(F.desc(F.col("word") == ""), F.desc(F.col("toxic") + F.col("clean")), "word").limit(CONTEXTS + 1).collect()
    if not top or min(top[0]["toxic"], top[0]["clean"]) < 20:
        return {}
    a, b = top[0]["toxic"], top[0]["clean"]
    return {r["word"]: max(-3.0, min(3.0, math.log((r["toxic"] + 1) / (a + 2)) - math.log((r["clean"] + 1) / (b + 2)))) for r in top[1:]}


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of greatest posterior density (damped Newton steps)."""
    x = np.column_stack((x, np.ones(len(x)))) if len(x) else np.zeros((0, len(PRIOR)))

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).sum() + (PRECISION * (w - PRIOR) ** 2).sum() / 2)

    w, now = PRIOR.copy(), loss(PRIOR)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + PRECISION * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(PRECISION), slope)
        size = 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-10:
            break
        w, now = w - size * step, new
    return w


def held_out(doc_id: Column) -> Column:
    """Rows kept from every fit: crc32 of the id as text leaves 2 when divided by four."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon, forms, contexts and weights from labelled documents outside the held-out fold.

    A document with several labels counts with the largest; null labels and ids teach nothing; equal texts of one label
    teach once. Without labelled rows the lexicon is empty and the score that of the prior.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{label}`").cast("int").alias("y")).where("doc is not null and y in (0, 1)")
    known = known.groupBy("doc").agg(F.max("y").alias("y")).where(~held_out(F.col("doc")))
    drawn = [sample_of(known.where(F.col("y") == y), F.col("doc"), sample) for y in (0, 1)]
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("version"), raw(text).alias("t"))
    taught = cut_lineage(frame.join(drawn[0].unionByName(drawn[1]), "doc").dropDuplicates(["doc"]).dropDuplicates(["version", "y"]).select("doc", "y", "t"))
    size = {r["y"]: r["n"] for r in taught.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    spread = cut_lineage(_spread(taught))
    terms, strength, z = _lexicon(taught, spread, n_toxic, n_clean)

    def near(batch: pa.RecordBatch) -> list:
        speller = Speller(terms)
        return [batch.column("word").filter(pa.array([(speller.find(w) or (0, 0))[0] > 0 for w in batch.column("word").to_pylist()], pa.bool_()))]

    met = spread.where((F.col("clean") > 0) & (_odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean)[1] < z) & ~F.col("word").endswith("*"))
    met = met.orderBy(F.desc("clean"), "word").select("word")
    ordinary = frozenset(r["word"] for r in arrow_task(met, "word string", near).limit(FORMS).collect()) if terms else frozenset()
    half = F.pmod(F.xxhash64("doc", F.lit("half")), F.lit(2)) == 0
    context = _contexts(taught.where(half), terms) if n_toxic >= HALVES else {}
    model = Model(terms, strength, ordinary, context)
    fit = taught.where(~half) if n_toxic >= HALVES else taught
    rows = _features(fit.select("doc", F.lit(0).cast("bigint").alias("version"), "t", "y"), model, "y int").orderBy("doc").select("x", "y").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float64).reshape(-1, len(PRIOR) - 1)
    return Model(terms, strength, ordinary, context, _fitted(x, rows.column("y").to_numpy().astype(float)))


def _features(frame: DataFrame, model: Model, more: str = "") -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON, FORMS and CONTEXTS
    names = [c for c in frame.columns if c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            x = [reader.features(t).tobytes() for t in texts(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.binary())], [*names, "x"])

    kinds = [f"doc {frame.schema['doc'].dataType.simpleString()}", "version bigint", *([more] if more else []), "x binary"]
    return map_arrow(frame, run, ", ".join(kinds))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits): one row per row of ``docs``.

    ``score`` is the chance that the text is toxic, from the text alone; null and empty texts, and texts without a hit, get
    that of no hit. ``predicted`` is 1 from ``threshold`` on; ``hits`` tells whether exact, misspelt or only quoted terms were met.
    Repeated rows get equal scores.
    """
    model = train(docs, labels, doc_id, text, label, sample)
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("version"), raw(text).alias("t"))
    kind = frame.schema["doc"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> list:
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(batch.num_rows, -1)
        p = 1 / (1 + np.exp(-np.clip((x * model.weights[:-1]).sum(axis=1) + model.weights[-1], -30, 30)))
        found = np.select([x[:, 0] > 0, x[:, 3] > 0, (x[:, 5] > 0) | (x[:, 6] > 0)], ["exact", "misspelt", "quoted"], "none")
        return [batch.column("doc"), np.round(p, 9), pa.array(found.tolist(), pa.string())]

    scored = arrow_task(_features(frame, model), f"doc {kind}, score double, hits string", rows)
    return scored.select(F.col("doc").alias("doc_id"), held_out(F.col("doc")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
