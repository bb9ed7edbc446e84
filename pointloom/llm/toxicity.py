"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and context windows that part quotation from abuse."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pointloom.llm.common import batches, crc_mod, kept, staged

#: Labelled rows that the model is fitted on, at most: those whose ids hash lowest.
SAMPLE_ROWS = 20_000
#: Letters of a lexicon's words at least.
MIN_LETTERS = 4
#: Documents with a word that make it an entry, and its least log odds.
SUPPORT, WORD_ODDS = 5, 2.5
#: Different words that must stand before a term in toxic documents (of 64 classes). Near copies of one document, all with one
#: label, would else make entries of its rare words.
CONTEXTS, CONTEXT_SHARE = 4, 0.3
#: Words that a worker remembers the matches of, and parts that the sample's terms are counted in.
REMEMBERED, PARTS = 300_000, 16
#: Words to each side of a match that its context score looks at.
WINDOW = 8
#: Words of direct address, and words that report what others say.
ADDRESS = frozenset("you your youre yours u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú tus ti usted ustedes eres".split())
REPORT = frozenset("said says say called calls quote quoted quotes word term wrote writes sagte sagt nannte wort zitat dit disait appelé mot cite dijo dice llamó palabra cita".split())
TOKEN = re.compile(r"[^\W_]+")
#: A line's passages in quotation marks; an apostrophe opens one only where no letter stands before, and ends one where none follows.
QUOTED = re.compile(r"""\"[^\"\n]*\"|[“„][^“”\n]*[“”]|«[^«»\n]*»|»[^«»\n]*«|‹[^‹›\n]*›|(?<!\w)['‘‚](?=\w)[^\n]*?(?<=\S)['’‘](?!\w)""")


def max_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 10 else 2


class Automaton:
    """The Levenshtein automaton of a word: a state is the tuple of (position, errors) that some alignment can be in."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits
        self.start = self._closure({(i, i) for i in range(min(edits, len(word)) + 1)})

    def _closure(self, pairs: set[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
        best: dict[int, int] = {}
        for i, e in sorted(pairs):
            while i <= len(self.word) and e <= self.edits and best.get(i, self.edits + 1) > e:
                best[i] = e  # and letters of the word that the other lacks
                i, e = i + 1, e + 1
        return tuple(sorted(best.items()))

    def step(self, state: tuple[tuple[int, int], ...], letter: str) -> tuple[tuple[int, int], ...]:
        after = set()
        for i, e in state:
            if i < len(self.word) and self.word[i] == letter:
                after.add((i + 1, e))
            elif e < self.edits:
                after.add((i, e + 1))
                if i < len(self.word):
                    after.add((i + 1, e + 1))
        return self._closure(after)

    def errors(self, state: tuple[tuple[int, int], ...]) -> int | None:
        """Errors at the word's end; None if the state doesn't accept."""
        return next((e for i, e in state if i == len(self.word)), None)


@dataclass
class Lexicon:
    """Entries with weights; words match them with max_edits errors by their length."""

    words: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trie: dict = {}
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        self.middles: dict[tuple[int, int], set[str]] = {}
        self.longest = max(map(len, self.words), default=0)
        for word in self.words:
            node = self.trie
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = word
            if (k := max_edits(len(word))) == 0:
                continue
            cut = [len(word) * i // (k + 1) for i in range(k + 2)]
            parts = [word[a:b] for a, b in zip(cut, cut[1:])]
            self.heads.setdefault(len(parts[0]), set()).add(parts[0])
            self.tails.setdefault(len(parts[-1]), set()).add(parts[-1])
            for at, part in zip(cut[1:-1], parts[1:-1]):
                for i in range(max(0, at - k), at + k + 1):  # errors before it move a part by no more than their number
                    self.middles.setdefault((i, len(part)), set()).add(part)
        self.seen: dict[str, tuple[str, float, int] | None] = {}

    def possible(self, word: str) -> bool:
        """False only if no entry is near: k errors leave one of a term's k + 1 parts whole."""
        return (
            any(word[:n] in found for n, found in self.heads.items())
            or any(word[-n:] in found for n, found in self.tails.items())
            or any(word[i : i + n] in found for (i, n), found in self.middles.items())
        )

    def nearest(self, word: str) -> tuple[str, float, int] | None:
        """The entry with fewest errors (ties: the heaviest, then the first by name), by walking trie and automaton together."""
        automaton = Automaton(word, 2 if len(word) >= 8 else 1)
        best: tuple[int, float, str] | None = None
        todo = [(self.trie, automaton.start)]
        while todo:
            node, state = todo.pop()
            if (entry := node.get("")) is not None:
                e = automaton.errors(state)
                if e is not None and e <= max_edits(len(entry)):
                    best = min(best or (9, 0.0, ""), (e, -self.words[entry], entry))
            for letter, below in node.items():
                if letter and (after := automaton.step(state, letter)):
                    todo.append((below, after))
        return None if best is None else (best[2], -best[1], best[0])

    def match(self, word: str) -> tuple[str, float, int] | None:
        """(entry, weight, errors) of a word."""
        if word in self.words:
            return word, self.words[word], 0
        if 4 <= len(word) <= self.longest + 2 and self.possible(word):
            return self.nearest(word)
        return None

    def hits(self, words: list[str]) -> set[str]:
        distinct = set(words)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        for word in distinct.difference(self.seen):
            self.seen[word] = self.match(word)
        return {w for w in distinct if self.seen[w]}


def features(lexicon: Lexicon, text: str) -> list[float]:
    """What a text's matches say, each weighed by its window: abuse counts more with direct address and other terms around,
    less inside a quoted passage or after a word that reports speech."""
    low = text.lower()
    words = TOKEN.findall(low)
    found = lexicon.hits(words)
    if not found:
        return [0.0] * 6
    spans = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(low)]
    at = [i for i, (w, _, _) in enumerate(spans) if w in found]
    passages = [m.span() for m in QUOTED.finditer(low)]
    begins = [a for a, _ in passages]
    exact = near = quoted = abuse = heaviest = 0.0
    for k, i in enumerate(at):
        _, weight, errors = lexicon.seen[spans[i][0]]
        around = [w for w, _, _ in spans[max(0, i - WINDOW) : i + WINDOW + 1]]
        passage = bisect_right(begins, spans[i][1]) - 1
        told = (passage >= 0 and spans[i][2] <= passages[passage][1]) or any(w in REPORT for w in around[: min(i, WINDOW)])
        others = sum(1 for j in (k - 1, k + 1) if 0 <= j < len(at) and abs(at[j] - i) <= WINDOW)
        score = weight * (0.3 if told else 1.0) * (1.0 + 0.25 * others + 0.5 * any(w in ADDRESS for w in around))
        exact, near = exact + weight * (errors == 0), near + weight * (errors > 0)
        quoted, abuse, heaviest = quoted + told, abuse + score, max(heaviest, score * (errors == 0))
    return [*(float(np.log1p(x)) for x in (exact, near, quoted, abuse)), heaviest, 10.0 * len(at) / len(spans)]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        x = np.array([features(self.lexicon, t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the constant first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean, before): documents of the sample with each word, and the classes of the words before it in toxic documents
    as bits."""
    from xxhash import xxh3_64_intdigest

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        before: dict[str, int] = {}
        for batch in batches(it):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                order = TOKEN.findall((text or "").lower())
                counts[toxic].update({w for w in order if len(w) >= MIN_LETTERS})
                if toxic:
                    for last, w in zip(["", *order], order):
                        if len(w) >= MIN_LETTERS:
                            before[w] = before.get(w, 0) | 1 << xxh3_64_intdigest(last) % 63
        terms = list(counts[0].keys() | counts[1].keys())
        for k in range(0, len(terms), 50_000):
            part = terms[k : k + 50_000]
            cols = [pa.array(part, pa.string()), *(pa.array([counts[x][t] for t in part], pa.int64()) for x in (1, 0)), pa.array([before.get(t, 0) for t in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["term", "toxic", "clean", "before"])

    made = sample.select("text", "toxic").repartition(PARTS).mapInArrow(run, "term string, toxic long, clean long, before long")
    return made.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("before").alias("before"))


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 0, modulus: int = 5, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of labels.toxic, from rows whose crc32(doc_id) mod modulus isn't held_out; None without both kinds of labels.

    Labels without id or value are left out; of several for an id the largest counts. Of the labelled rows, the sample_rows
    whose ids hash lowest are used, equal texts once; so the driver gets entries and features of a bounded sample only."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(crc_mod("doc_id", modulus) != held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])
    sample = sample.groupBy(F.xxhash64("text").alias("hash"), "toxic").agg(F.min("text").alias("text"))
    sample = staged(sample.select("text", "toxic"), "sample")  # is read for the terms and for the features
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1.0))
    wanted = (F.col("toxic") >= SUPPORT) & (F.col("odds") >= WORD_ODDS)
    wanted &= F.bit_count("before") >= F.greatest(F.lit(CONTEXTS), CONTEXT_SHARE * F.least("toxic", F.lit(40)))
    entries = term_counts(sample).withColumn("odds", odds).where(wanted).collect()
    lexicon = Lexicon({r["term"]: r["odds"] for r in sorted(entries, key=lambda r: r["term"])})

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            rows = [features(lexicon, t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    got = sample.mapInArrow(measured, "x array<double>, toxic int").toArrow()
    x = np.array(got.column("x").to_pylist())
    lexicon.seen.clear()
    return Model(lexicon, logistic(x, got.column("toxic").to_numpy().astype(float)))


def with_score(docs: DataFrame, model: Model | None, column: str = "score", text: str = "text") -> DataFrame:
    """docs and their scores; without a model all are 0."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    key = uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(f"toxicity {key}", lambda: model)
        for batch in batches(it, column=text):
            scores = own.score([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def without_toxic(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text scores less than 0.5; without a model all."""
    if model is None:
        return docs
    key = uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(f"toxicity {key}", lambda: model)
        for batch in batches(it, column=text):
            yield batch.filter(pa.array(own.score([t or "" for t in batch.column(text).to_pylist()]) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0, modulus: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row; the score is computed from the text alone.

    Null and empty texts score as a text without matches. A null doc_id counts as the empty text in the crc. Repeated rows are
    scored each. Without labels of both kinds, scores are 0. An empty table gives no rows."""
    model = fit(docs, labels, held_out, modulus)
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id", (crc_mod("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
