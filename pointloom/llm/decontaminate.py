"""Benchmark decontamination: SimHash of item-sized windows, an index that finds all within a Hamming radius, exact checks."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import WordIds, batches, kept, mix64, window_hashes

WIDTH, PERCENT = 5, 80
#: At a weighted similarity of 0.8 fingerprints differ in 9.7 of 64 bits, with a deviation of 2.9; 20 is 3.6 deviations more.
RADIUS, BLOCKS = 20, 8
#: Bytes of items that one pass over the documents takes along, and so are broadcast at once; more items are more passes.
ITEM_BYTES = 16 << 20
#: Fingerprints up to which an index remembers what it found near a block's value.
REMEMBERED = 4096

WORD = re.compile(r"\w+")
LEAK = "doc_id long, item_id long, similarity double, start long"


def word_list(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes; a shingle weighs as often as it occurs."""
    bits = (shingles[..., None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    votes = 2 * bits.sum(axis=-2, dtype=np.int64) > shingles.shape[-1]
    return (votes.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=-1, dtype=np.uint64)


class HammingIndex:
    """Fingerprints by 8-bit blocks. Two within RADIUS bits have a block within RADIUS // BLOCKS bits, by counting; so the
    union over blocks of what is that near in the block holds all of them, and the full distance leaves just them.

    Each block has the fingerprints' numbers in the order of its values, and where each value begins."""

    NEAR = [np.flatnonzero(np.bitwise_count(np.arange(256) ^ v) <= RADIUS // BLOCKS) for v in range(256)]

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        blocks = [((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64) for b in range(BLOCKS)]
        self.order = [np.argsort(mine, kind="stable").astype(np.int32) for mine in blocks]
        self.start = [np.searchsorted(np.sort(mine), np.arange(257)).tolist() for mine in blocks]
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def near(self, b: int, value: int) -> np.ndarray:
        """Numbers of the fingerprints whose block b is near a value."""
        found = self.held.get((b, value))
        if found is None:
            order, start = self.order[b], self.start[b]
            found = np.concatenate([order[start[v] : start[v + 1]] for v in self.NEAR[value].tolist()])
            if len(self.prints) <= REMEMBERED:
                self.held[b, value] = found
        return found

    def within(self, fingerprint: np.uint64) -> np.ndarray:
        hit, whole = np.zeros(len(self.prints), bool), int(fingerprint)
        for b in range(BLOCKS):
            hit[self.near(b, whole >> 8 * b & 255)] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.prints[found] ^ fingerprint) <= RADIUS]


class Benchmark:
    """Items of one pass: word numbers, shingles, and for each length in words the index of its items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        ids = WordIds()
        self.by_length: dict[int, tuple[list[int], list[Counter], HammingIndex]] = {}
        lengths: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            words = word_list(text)
            if len(words) < WIDTH:
                continue
            for w in words:
                self.vocabulary.setdefault(w, ids[w.encode()])
            numbers = np.array([self.vocabulary[w] for w in words], np.uint64)
            lengths.setdefault(len(words), []).append((item, window_hashes(numbers, WIDTH)))
        for n, group in lengths.items():
            prints = np.array([fingerprints(s) for _, s in group], np.uint64)
            self.by_length[n] = [i for i, _ in group], [Counter(s.tolist()) for _, s in group], HammingIndex(prints)
        every = [s for group in lengths.values() for _, s in group]
        self.shingles = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        self.near = np.zeros(1 << 16, bool)
        self.near[self.shingles >> np.uint64(48)] = True

    def known(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles are some item's."""
        out = np.zeros(len(shingles), bool)
        at = np.flatnonzero(self.near[shingles >> np.uint64(48)])
        place = np.minimum(np.searchsorted(self.shingles, shingles[at]), len(self.shingles) - 1)
        out[at] = self.shingles[place] == shingles[at]
        return out

    def leaks(self, shingles: np.ndarray, known: np.ndarray, shorter: bool = False) -> dict[int, tuple[float, int]]:
        """item -> (best similarity, first window that has it), of a document's shingles.

        A window that is PERCENT like an item of its size shares that part of its shingles at least, so a window is
        fingerprinted only where so many are items'; no window that could pass is left out. With shorter, a document with
        fewer shingles than an item is one window, held against it over the union of the two."""
        total = np.concatenate(([0], np.cumsum(known)))
        found: dict[int, tuple[float, int]] = {}
        for n, (items, counts, index) in self.by_length.items():
            m = n - WIDTH + 1
            size = min(m, len(shingles))
            if size < m and not shorter:
                continue
            starts = np.flatnonzero(100 * (total[size:] - total[:-size]) >= PERCENT * m)
            for k in range(0, len(starts), 4096):
                part = starts[k : k + 4096]
                windows = np.lib.stride_tricks.sliding_window_view(shingles, size)[part]
                for start, window, fingerprint in zip(part.tolist(), windows, fingerprints(windows), strict=True):
                    candidates = index.within(fingerprint)
                    if not len(candidates):
                        continue
                    own = Counter(window.tolist())
                    for c in candidates.tolist():
                        shared = sum((own & counts[c]).values())
                        if 100 * shared >= PERCENT * (size + m - shared):
                            s = shared / (size + m - shared)
                            if s > found.get(items[c], (0.0, 0))[0]:
                                found[items[c]] = s, start
        return found


def _passes(benchmark: DataFrame, item_bytes: int) -> Iterator[Callable[[], Benchmark]]:
    """For each pass over the documents what gives a worker its items; the driver holds those of one pass at a time."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    passes = max(1, -(-size // item_bytes))
    part = items.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    for k in range(passes):
        rows = [(r["item_id"], r["text"]) for r in part.where(F.col("pass") == k).select("item_id", "text").toLocalIterator()]
        shared, key = benchmark.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
        yield lambda shared=shared, key=key: kept(f"benchmark {key}", lambda: Benchmark(shared.value))


def _found(benchmark: Benchmark, texts: list[str | None], shorter: bool) -> Iterator[tuple[int, dict[int, tuple[float, int]]]]:
    """The place of each text that has leaks, and them."""
    if not len(benchmark.shingles):
        return
    get, other = benchmark.vocabulary.get, int(mix64(np.array([1], np.uint64))[0])
    lists = [[get(w, other) for w in word_list(t)] if t else [] for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.cumsum(sizes)
    flat = np.fromiter((x for one in lists for x in one), np.uint64, int(ends[-1]) if len(ends) else 0)
    # shingles over the whole batch; those that reach into the next document are left out below
    shingles = window_hashes(flat, WIDTH)
    known = benchmark.known(shingles) if len(shingles) else np.empty(0, bool)
    for d in np.unique(np.searchsorted(ends, np.flatnonzero(known), "right")).tolist():
        a, b = int(ends[d] - sizes[d]), int(ends[d]) - WIDTH + 1
        if b > a and (got := benchmark.leaks(shingles[a:b], known[a:b], shorter)):
            yield d, got


def without_leaks(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs, with all columns, whose text has no leak by the measure of leaks(), documents shorter than an item included.

    Each row is judged by its own text: ids may be null or repeat. Nothing is shuffled."""
    for give in _passes(benchmark, item_bytes):

        def run(it: Iterator[pa.RecordBatch], give: Callable[[], Benchmark] = give) -> Iterator[pa.RecordBatch]:
            own = give()
            for batch in batches(it, rows=2048, megabytes=8):
                stays = np.ones(batch.num_rows, bool)
                stays[[d for d, _ in _found(own, batch.column("text").to_pylist(), True)]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _pass(docs: DataFrame, give: Callable[[], Benchmark], shorter: bool) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = give()
        for batch in batches(it, rows=2048, megabytes=8):
            who = batch.column("doc_id")
            rows = [(who[d].as_py(), item, s, start) for d, got in _found(own, batch.column("text").to_pylist(), shorter) for item, (s, start) in got.items()]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in LEAK.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LEAK)


def leaks(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES, shorter: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, start): the items that a document has a near copy of, and where the best one starts (in
    words; ties: the first).

    Words are runs of word characters, in lower case. A window of as many words as an item is a near copy if the weighted
    Jaccard similarity of their five-word shingles, each weighing as often as it occurs, is 0.8 or more. With shorter, a
    document of fewer words than an item is held against it as a whole, by the same measure. Items of less than
    five words have no shingle and identify nothing. Null ids, null and empty texts of either side match nothing. Repeated rows
    and items give one row for an (doc_id, item_id). The benchmark is broadcast, item_bytes a pass at most: a benchmark of any
    size is taken whole, in so many passes."""
    found = None
    for give in _passes(benchmark, item_bytes):
        one = _pass(docs.where("doc_id is not null"), give, shorter)
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", (-F.col("b.start")).alias("start"))
