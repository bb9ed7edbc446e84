"""Language identification by unigrams over a fixed vocabulary of pieces, summed over all segmentations of each word."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import batches, crc_mod, kept, mix64

#: Words of more letters are scored in runs of so many.
RUN = 24
#: Probability of a letter that no piece covers, and the weight of the pooled counts in a language's piece probabilities.
UNKNOWN, POOLED = 1e-7, 50.0
#: Words that a worker remembers, and distinct words of a language that it counts before it folds them into piece counts.
REMEMBERED, FOLD = 500_000, 200_000
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3 | 1)


def words_of(text: str) -> list[str]:
    return [run for w in LETTERS.findall(text.lower()) for run in ([w] if len(w) <= RUN else [w[i : i + RUN] for i in range(0, len(w), RUN)])]


def vocabulary_pieces(path: str) -> list[str]:
    """The lower-case letter pieces of a sentencepiece vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in found if p == p.lower() and p.removeprefix(START).isalpha()})


class Segmentations:
    """Sums over all ways to cut words into pieces; many words of one length at a time."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.size = keys[order], order.astype(np.int64), len(pieces)
        self.near = np.zeros(1 << 20, bool)
        self.near[self.keys >> np.uint64(44)] = True
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(RUN + 2, _BASE, np.uint64)) * pow(int(_BASE), -1, 1 << 64)

    @staticmethod
    def _key(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) % (1 << 64)
        return mix64(np.array([h], np.uint64) + np.uint64(len(piece)))[0]

    def spans(self, words: list[str], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, which words, which pieces) of each span of words of n letters that is a piece; the start mark is letter 0."""
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n + 1).astype(np.uint64)
        prefix = np.zeros((n + 2, len(words)), np.uint64)
        for j in range(n + 1):
            prefix[j + 1] = prefix[j] * _BASE + codes[:, j]
        for j in range(1, n + 2):
            for i in range(max(0, j - self.longest), j):
                key = mix64(prefix[j] - prefix[i] * self.powers[j - i] + np.uint64(j - i))
                rows = np.flatnonzero(self.near[key >> np.uint64(44)])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.keys, key[rows]), self.size - 1)
                    same = self.keys[at] == key[rows]
                    yield i, j, rows[same], self.ids[at[same]]

    def forward(self, words: list[str], n: int, probability: np.ndarray) -> np.ndarray:
        """log of the summed probability of all segmentations: (words, languages)."""
        a = np.zeros((n + 2, len(words), probability.shape[1]))
        a[0] = 1
        last = 0
        for i, j, rows, ids in self.spans(words, n):
            if j != last:
                last = j
                a[j] += a[j - 1] * UNKNOWN
            a[j, rows] += a[i, rows] * probability[ids]
        for j in range(last + 1, n + 2):
            a[j] += a[j - 1] * UNKNOWN
        return np.log(np.maximum(a[n + 1], 1e-300))

    def expected(self, counts: Counter) -> np.ndarray:
        """Expected piece counts of words, all pieces being equally likely beforehand: one step of expectation maximisation."""
        out = np.zeros(self.size)
        flat = 1.0 / max(1, self.size)
        lengths: dict[int, list[str]] = {}
        for w in counts:
            lengths.setdefault(len(w), []).append(w)
        for n, every in lengths.items():
            for k in range(0, len(every), 20_000):
                words = every[k : k + 20_000]
                weight = np.array([counts[w] for w in words], float)
                found = list(self.spans(words, n))
                a, b = np.zeros((2, n + 2, len(words)))
                a[0], b[n + 1] = 1, 1
                by_end: dict[int, list] = {}
                by_begin: dict[int, list] = {}
                for span in found:
                    by_end.setdefault(span[1], []).append(span)
                    by_begin.setdefault(span[0], []).append(span)
                for j in range(1, n + 2):
                    a[j] += a[j - 1] * UNKNOWN
                    for i, _, rows, _ in by_end.get(j, ()):
                        a[j, rows] += a[i, rows] * flat
                for i in range(n, -1, -1):
                    b[i] += b[i + 1] * UNKNOWN
                    for _, j, rows, _ in by_begin.get(i, ()):
                        b[i, rows] += b[j, rows] * flat
                total = np.maximum(a[n + 1], 1e-300)
                for i, j, rows, ids in found:
                    np.add.at(out, ids, a[i, rows] * flat * b[j, rows] / total[rows] * weight[rows])
        return out


class Model:
    """Languages in order, the log share of documents that each has, and piece probabilities (pieces, languages)."""

    def __init__(self, pieces: list[str], languages: list[str], prior: np.ndarray, probability: np.ndarray):
        self.pieces, self.languages, self.prior, self.probability = pieces, languages, prior, probability
        self.key = uuid.uuid4().hex

    def open(self) -> Model:
        self.cut, self.rows = Segmentations(self.pieces), {}
        self.logs = np.zeros((0, len(self.languages)))
        self.letters = np.zeros(0, bool)
        return self

    def learn(self, words: set[str]) -> None:
        """Adds the scores of words that haven't been seen."""
        if len(self.rows) + len(words) > REMEMBERED:
            self.rows, self.logs, self.letters = {}, self.logs[:0], self.letters[:0]
        new = [w for w in words if w not in self.rows]
        lengths: dict[int, list[str]] = {}
        for w in new:
            lengths.setdefault(len(w), []).append(w)
        logs, letters = [self.logs], [self.letters]
        for n, every in lengths.items():
            for k in range(0, len(every), 20_000):
                part = every[k : k + 20_000]
                self.rows.update(zip(part, range(len(self.rows), len(self.rows) + len(part))))
                alpha = np.array([any(map(str.isalpha, w)) for w in part])
                logs.append(self.cut.forward(part, n, self.probability) * alpha[:, None])
                letters.append(alpha)
        self.logs, self.letters = np.concatenate(logs), np.concatenate(letters)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lists = [words_of(t) if t else [] for t in texts]
        self.learn({w for words in lists for w in words})
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter((self.rows[w] for words in lists for w in words), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(lists)), sizes)
        known = np.bincount(doc, weights=self.letters[at], minlength=len(lists)) > 0
        if not self.languages:
            return ["und"] * len(lists), np.zeros(len(lists))
        total = np.column_stack([np.bincount(doc, weights=self.logs[at, k], minlength=len(lists)) + self.prior[k] for k in range(len(self.languages))])
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, share, 0.0)


def fit(docs: DataFrame, pieces: list[str]) -> Model:
    """Piece probabilities of each language from all rows of docs that have text and lang.

    Each task adds up expected counts of its rows; a row per task, language and piece is shuffled, and the driver gets sums, as
    many as there are pieces times languages."""
    size = len(pieces)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segmentations(pieces)
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def fold(lang: str) -> None:
            sums.setdefault(lang, np.zeros(size + 1))[:size] += cut.expected(words.pop(lang))

        for batch in batches(it):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counter = words.setdefault(lang, Counter())
                counter.update(words_of(text))
                sums.setdefault(lang, np.zeros(size + 1))[size] += 1
                if len(counter) > FOLD:
                    fold(lang)
        for lang in list(words):
            fold(lang)
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(row[at])], ["lang", "piece", "n"])

    counted = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(run, "lang string, piece int, n double")
    got = counted.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    table = np.zeros((size + 1, len(languages)))
    where = {lang: k for k, lang in enumerate(languages)}
    table[got.column("piece").to_numpy(), [where[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    counts, docs_of = table[:size], table[size]
    pooled = (counts.sum(axis=1) + 0.1) / (counts.sum() + 0.1 * size)
    probability = (counts + POOLED * pooled[:, None]) / (counts.sum(axis=0) + POOLED)
    return Model(pieces, languages, np.log(docs_of / max(1.0, docs_of.sum())) if languages else docs_of, probability)


def identify(docs: DataFrame, vocabulary_path: str, held_out: int = 2, modulus: int = 4) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row; predicted from the text alone.

    Learns from rows whose crc32(doc_id) mod modulus isn't held_out. Null texts and texts without letters are und with score 0;
    with nothing to learn from all are. score is the language's share of the probability. Ties go to the first by name. Null
    langs teach nothing; a null doc_id counts as the empty text in the crc; repeated rows are predicted each."""
    pieces = vocabulary_pieces(vocabulary_path)
    model = fit(docs.where(crc_mod("doc_id", modulus) != held_out), pieces)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(f"language {model.key}", model.open)
        for batch in batches(it, rows=2048, megabytes=8):
            langs, scores = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", modulus) == held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
