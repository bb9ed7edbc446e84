"""Language-model scores by prediction by partial matching over bytes: a context trie, escapes, and exclusion of symbols."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import as_bytes, batches, crc_mod, estimated_bytes, give_back, mix64, staged

#: Bytes of context at most. A text is preceded by ORDER pads and ended by one; 0xFF never occurs in UTF-8.
ORDER, PAD = 6, 0xFF
#: Counts up to this order go to all, whole: 2^24 cells at most, of which texts use some ten thousand. Longer contexts are dealt
#: to shards by their last LOW + 1 bytes, so a shard has all counts that end in them.
LOW = 2
#: Bytes in files that make a block, the unit whose words are counted and looked up together. A text of STEP times the mean and
#: more is in blocks of such texts, of that many fewer rows.
BLOCK_BYTES, STEP = 8 << 20, 128
#: Bytes in files for each shard; more where there are many shards, up to what one task can hold.
SHARD_BYTES, MANY_SHARDS, LARGE_SHARD_BYTES = 12 << 20, 20_000, 96 << 20
#: Bytes of a long text that are turned into keys at once.
PIECE = 1 << 20
#: Grams of a block or shard that wait to be added up, at least; as many as half of those added up already.
WAITING = 1_000_000
#: Words and grams of blocks that a task holds when another block begins; beyond that the oldest are sent on.
HELD = 1_000_000
#: Bytes of short texts that are turned into keys together.
TOGETHER = 1 << 18
WORDS, GRAMS, STATS = 0, 1, 2

PARTIAL = "kind int, shard int, blk string, keys binary, counts binary"
#: V and N of words and the rows learned from have columns of their own, so that reading them reads no grams.
MERGED = "kind int, blk string, keys binary, counts binary, distinct_words long, words long, trained long"


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


def pieces(text: bytes) -> list[tuple[bytes, bytes]]:
    """A text and its end in pieces of PIECE bytes, each with the ORDER bytes before it."""
    whole = text + bytes([PAD])
    return [(whole[max(0, i - ORDER) : i].rjust(ORDER, bytes([PAD])), whole[i : i + PIECE]) for i in range(0, len(whole), PIECE)]


def gram_keys(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDER + 1 bytes up to each symbol as an integer, for all symbols of all pieces; and where each piece starts."""
    blob = np.frombuffer(b"".join(lead + body for lead, body in parts), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(body) for _, body in parts), np.int64, len(parts))
    # runs of bytes that end at each place: twice as many at each step, and the rest by two runs that overlap
    keys, width = blob, 1
    while width < ORDER + 1:
        step = min(width, ORDER + 1 - width)
        longer = keys.copy()
        longer[step:] |= keys[: len(blob) - step] << np.uint64(8 * step)
        keys, width = longer, width + step
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(blob), bool)
    for k in range(ORDER):
        keep[starts + ORDER * np.arange(len(parts)) + k] = False
    return keys[keep], starts


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)


def rolled(keys: np.ndarray) -> np.ndarray:
    """Keys with the context's bytes in reverse, the nearest one highest, so that contexts with an ending in common are together."""
    return ((keys >> np.uint64(8)) << np.uint64(16)).byteswap() << np.uint64(8) | (keys & np.uint64(255))


def unrolled(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(8)).byteswap() >> np.uint64(16) << np.uint64(8) | (keys & np.uint64(255))


def pressed(values: np.ndarray) -> bytes:
    """Values byte by byte of all of them, compressed: few bytes each, as sorted keys and counts have most bytes in common."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpressed(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


class Sums:
    """Distinct keys and the sums of their counts, folded whenever WAITING and half as many as there are folded wait."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(WAITING, len(self.held[0][0]) // 2):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(c) for c in zip((np.empty(0, np.uint64), np.empty(0, np.int64)), *self.held))
        self.held = []  # what was held needn't be there beside what is sorted
        self.held, self.waiting = [summed(keys, counts)], 0
        return self.held[0]

    def __len__(self) -> int:
        return sum(len(keys) for keys, _ in self.held)


def cells_of(keys: np.ndarray, counts: np.ndarray, top: int, bottom: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The cells of the orders from top to bottom, none left out, of keys of order top and their counts."""
    out = {}
    for order in range(top, bottom - 1, -1):
        keys, counts = summed(keys & _mask(order), counts)
        _, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        out[order] = keys, counts, np.bincount(of, weights=counts).astype(np.int64)[of]
    return out


class Table:
    """uint64 keys -> their index, by open addressing; many lookups at a time. Missing keys give -1."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros(1 << bits, np.uint64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = todo[free]
            self.keys[at[free]] = keys[todo[free]]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def hold(self, values: np.ndarray) -> Table:
        """Puts each key's value beside it."""
        self.values = values[np.maximum(self.slots, 0)]
        del self.slots  # value() goes without
        return self

    def value(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys all of which are there."""
        at = self._slot(keys)
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.last
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.slots[at]
        wrong = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.last
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != keys[wrong]) & (out[wrong] >= 0)]
        return out


class Ppm:
    """Code lengths in bits. At a context with T counts of kept symbols and E for escape, a kept symbol of count n costs
    log2((T + E) / n) and an escape log2((T + E) / E); E is the number of kept symbols and the counts of the others. After an
    escape the symbols kept at the longer context are excluded from T and E of the shorter one. As a symbol kept at a context is
    kept at all its suffixes, what is excluded depends on the longer context alone, and T and E after it are stored with it.
    Below order 0 the symbols not kept there are equally likely."""

    def __init__(self, cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], low: Ppm | None = None):
        """cells: for each order the kept keys (context and symbol) in order, their counts, and the counts of all symbols of the
        context. low: a model that has the orders up to LOW."""
        self.cells, self.low = cells, low
        self.opened = False

    def open(self) -> Ppm:
        if self.opened:
            return self
        self.opened = True
        self.level: list[dict] = self.low.open().level[: LOW + 1] if self.low else []
        for order in range(len(self.level), ORDER + 1):
            keys, n, every = self.cells.get(order, (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)))
            contexts, first, of = np.unique(keys >> np.uint64(8), return_index=True, return_inverse=True)
            kinds = np.bincount(of, minlength=len(contexts)).astype(float)
            total = np.bincount(of, weights=n, minlength=len(contexts))
            rest = every[first] - total
            escape = kinds + rest
            here = {"cell": Table(keys), "context": Table(contexts), "of": of.astype(np.int32), "T": total, "raw": n, "kinds": kinds, "rest": rest}
            # what a kept symbol and an escape cost at each context, without exclusion and, by the longer context, with it
            here["n"] = np.log2(np.maximum(n, 1)).astype(np.float32)
            space, here["escape"] = _costs(total, escape)
            here["cost"] = space[of] - here["n"]
            if order:
                low = self.level[-1]
                below = low["cell"].find(keys & _mask(order - 1))
                shorter = low["context"].find(contexts & (_mask(order - 1) >> np.uint64(8)))
                gone = np.bincount(of, weights=low["raw"][below], minlength=len(contexts))
                here["space_below"], here["escape_below"] = _costs(low["T"][shorter] - gone, low["kinds"][shorter] - kinds + low["rest"][shorter])
            self.level.append(here)
        self.base = np.log2(256 - (self.level[0]["kinds"][0] if len(self.level[0]["kinds"]) else 0))
        return self

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The code length of each symbol, given as by gram_keys."""
        out = np.zeros(len(keys))
        todo, above = np.arange(len(keys)), np.empty(0, np.int32)
        for order in range(ORDER, -1, -1):
            if not len(todo):
                return out
            level = self.level[order]
            mine = keys[todo] & _mask(order)
            cell = level["cell"].find(mine)
            hits = np.flatnonzero(cell >= 0)
            found = cell[hits]
            cost = level["cost"][found]
            if len(above):
                up = above[hits]
                longer = np.flatnonzero(up >= 0)
                cost[longer] = self.level[order + 1]["space_below"][up[longer]] - level["n"][found[longer]]
            out[todo[hits]] += cost
            misses = np.flatnonzero(cell < 0)
            context = level["context"].find(mine[misses] >> np.uint64(8))
            known = np.flatnonzero(context >= 0)
            cost = level["escape"][context[known]]
            if len(above):
                up = above[misses[known]]
                longer = np.flatnonzero(up >= 0)
                cost[longer] = self.level[order + 1]["escape_below"][up[longer]]
            todo = todo[misses]
            out[todo[known]] += cost
            above = context
        out[todo] += self.base
        return out


def _costs(total: np.ndarray, escape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2(T + E), and log2((T + E) / E), 0 where there is no way to escape."""
    space = np.log2(np.maximum(total + escape, 1e-9))
    return space.astype(np.float32), np.where(escape > 0, space - np.log2(np.maximum(escape, 1e-9)), 0).astype(np.float32)


def with_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, blk, text), and the files' bytes: blk names each row's block, by its file and place there, so that it doesn't depend on how a scan is split
    or which executors there are. A table that isn't a scan of files is written to the shared folder first.

    Blocks hold BLOCK_BYTES on average and STEP times that at most, or one text: longer texts have blocks of fewer rows."""
    own = docs.select("doc_id", "text")
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column hides the files' own")
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = own = staged(own, "documents")
    size = estimated_bytes(docs)
    mean = max(1, size // max(1, own.count()))
    rows = max(1, BLOCK_BYTES // mean)
    above = F.greatest(F.lit(0), F.floor(F.log(float(STEP), F.greatest(F.lit(1), F.octet_length(as_bytes("text"))) / mean)))
    place = F.floor(F.col("_metadata.row_index") / F.greatest(F.lit(1), F.floor(rows / F.pow(F.lit(float(STEP)), above))))
    return docs.select("doc_id", F.concat_ws(":", "_metadata.file_path", above.cast("string"), place.cast("string")).alias("blk"), "text"), size


def shards_for(size: int) -> int:
    """How many shards a corpus of a size in bytes gets, so that a task can hold one."""
    return max(8, min(size // SHARD_BYTES, MANY_SHARDS), -(-size // LARGE_SHARD_BYTES))


def _low_grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each symbol with the LOW bytes before it, counted, of one task's texts."""
    sums = Sums()
    lead, end = bytes([PAD]) * LOW, bytes([PAD])
    for batch in batches(it, rows=1024, megabytes=2):
        blob = np.frombuffer(b"".join(lead + t.lower() + end for t in batch.column("text").to_pylist()), np.uint8).astype(np.uint32)
        grams = np.zeros(len(blob), np.uint32)
        for k in range(LOW + 1):
            grams[k:] |= blob[: len(blob) - k] << np.uint32(8 * k)
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + LOW + 1
        keep = np.ones(len(blob), bool)
        for k in range(LOW):
            keep[np.cumsum(sizes) - sizes + k] = False
        keys, counts = summed(grams[keep])
        sums.add(keys.astype(np.uint64), counts)
    keys, counts = sums.fold()
    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["gram", "n"])


def _count(shards: int):
    from xxhash import xxh3_64_intdigest

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        grams: dict[str, Sums] = {}
        trained = 0

        def rows(kind: int, blk: str, made: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            n = len(made)
            cols = [pa.array([kind] * n, pa.int32()), pa.array([s for s, _, _ in made], pa.int32()), pa.array([blk] * n, pa.string()), pa.array([k for _, k, _ in made], pa.binary()), pa.array([c for _, _, c in made], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["kind", "shard", "blk", "keys", "counts"])

        def send(blk: str) -> Iterator[pa.RecordBatch]:
            split: dict[int, list[bytes]] = {}
            own = words.pop(blk)
            for w in own:
                split.setdefault(xxh3_64_intdigest(w) % shards, []).append(w)
            yield rows(WORDS, blk, [(s, b"\n".join(ws), np.array([own[w] for w in ws], np.int64).tobytes()) for s, ws in split.items()])
            keys, counts = grams.pop(blk).fold()
            shard = (mix64(keys >> np.uint64(8 * (ORDER - LOW))) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            found, first = np.unique(shard[by], return_index=True)
            yield rows(GRAMS, blk, [(s, pressed(keys[by[a:b]]), pressed(counts[by[a:b]])) for s, a, b in zip(found.tolist(), first.tolist(), [*first.tolist()[1:], len(by)])])

        for batch in batches(it, rows=1024, megabytes=0.5):
            low = [t.lower() for t in batch.column("text").to_pylist()]
            train, blks = batch.column("train").to_pylist(), batch.column("blk").to_pylist()
            trained += sum(train)
            keys = rolled(gram_keys([p for t in low for p in pieces(t)])[0])
            here = {blk: k for k, blk in enumerate(dict.fromkeys(blks))}
            sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
            of, learned = np.repeat([here[blk] for blk in blks], sizes), np.repeat(train, sizes)
            for blk, k in here.items():
                while blk not in words and sum(len(words[b]) + len(grams[b]) for b in words) > HELD:
                    yield from send(next(iter(words)))
                own, sums = words.setdefault(blk, Counter()), grams.setdefault(blk, Sums())
                for b, learn, text in zip(blks, train, low, strict=True):
                    if b == blk:
                        own.update(text.split() if learn else dict.fromkeys(text.split(), 0))
                sums.add(*summed(keys[(of == k) & learned]))
                new = summed(keys[(of == k) & ~learned])[0]
                sums.add(new, np.zeros(len(new), np.int64))
        for blk in list(words):
            yield from send(blk)
        if trained:
            yield rows(STATS, "", [(0, b"", np.array([0, 0, trained], np.int64).tobytes())])

    return run


def _merge(low: Broadcast[Ppm]):
    """One shard of one kind: words get their counts over all blocks, and of them V and N; grams are added up and get their code
    lengths. The grams of a shard have an ending in common with all cells that their code length depends on but the low ones."""

    def run(table: pa.Table) -> pa.Table:
        give_back()  # what the shard before took
        kind = table.column("kind")[0].as_py()
        blks, keys, counts = (table.column(c).to_pylist() for c in ("blk", "keys", "counts"))
        one = lambda k, b, w, c: (k, b, w, c, None, None, None)
        said = lambda *stats: (STATS, "", None, None, *map(int, stats))
        if kind == STATS:
            out = [said(0, 0, sum(np.frombuffer(c, np.int64)[2] for c in counts))]
        elif kind == GRAMS:
            sums = Sums()
            for k, c in zip(keys, counts, strict=True):
                sums.add(unpressed(k, np.uint64), unpressed(c, np.int64))
            every, n = sums.fold()
            plain = unrolled(every)
            ppm = Ppm(cells_of(plain[n > 0], n[n > 0], ORDER, LOW + 1), low.value).open()
            bits = np.concatenate([ppm.bits(plain[a : a + PIECE]) for a in range(0, len(plain), PIECE)]).astype(np.float32)
            out = [one(GRAMS, b, k, pressed(bits[np.searchsorted(every, unpressed(k, np.uint64))])) for b, k in zip(blks, keys, strict=True)]
        else:
            total: dict[bytes, int] = {}
            for w, c in zip(keys, counts, strict=True):
                for word, n in zip(w.split(b"\n"), np.frombuffer(c, np.int64).tolist(), strict=True):
                    total[word] = total.get(word, 0) + n
            out = [one(WORDS, b, w, np.fromiter(map(total.__getitem__, w.split(b"\n")), np.int64).tobytes()) for b, w in zip(blks, keys, strict=True)]
            values = np.fromiter(total.values(), np.int64, len(total))
            out.append(said((values > 0).sum(), values.sum(), 0))
        types = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [x.split()[0] for x in MERGED.split(", ")])

    return run


def score(docs: DataFrame, held_out: int = 2, modulus: int = 7, shards: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per input row.

    Learns from rows whose crc32(doc_id) mod modulus isn't held_out, from all of them. A-Z are lower-cased first. base_score is
    that of words (runs of non-space bytes) and one end, with one added to each count; score is the model's log10 probability of
    the lower-cased text and its end. Null and empty texts consist of the end. With nothing to learn from, all symbols are
    equally likely and the base divides by one. A null doc_id counts as the empty text in the crc. Repeated rows count and are
    scored each.

    A first pass counts grams up to order LOW, which go to all. A second counts words and whole grams: each block of a file keeps
    its own, shards add up the blocks' counts and send each block its words' totals and its grams' code lengths, so neither the
    vocabulary, nor the contexts, nor a hot word is ever in one place, and no context is left out at any size of corpus. A third
    pass scores."""
    placed, size = with_blocks(docs)
    shards = shards or shards_for(size)
    rows = placed.select(F.col("doc_id").cast("long").alias("doc_id"), "blk", (crc_mod("doc_id", modulus) != held_out).alias("train"), as_bytes("text").alias("text"))
    grams = rows.where("train").select("text").mapInArrow(_low_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    low = Ppm(cells_of(grams.column("gram").to_numpy().astype(np.uint64), grams.column("n").to_numpy().astype(np.int64), LOW, 0))
    partial = rows.mapInArrow(_count(shards), PARTIAL)
    merge = _merge(docs.sparkSession.sparkContext.broadcast(low))
    # one file a task; folders by kind would sort all grams by kind as they are written, and make three
    merged = staged(partial.groupBy("kind", "shard").applyInArrow(lambda table: merge(table), MERGED), "counts")
    stats = merged.where(F.col("kind") == STATS).agg(*(F.sum(c) for c in ("distinct_words", "words", "trained"))).first()
    distinct, tokens, trained = (x or 0 for x in stats)
    ends = trained  # the end is a token of its own kind, one a text
    distinct, tokens = distinct + (ends > 0), tokens + ends
    totals = merged.where(F.col("kind") != STATS).select("blk", F.col("kind").alias("tag"), F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("train"), F.col("keys").alias("text"), "counts")
    whole = totals.unionByName(rows.select("blk", F.lit(STATS).alias("tag"), "doc_id", "train", "text", F.lit(None).cast("binary").alias("counts")))
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, counts, held, lengths = None, {}, [], None
        for batch in batches(it, rows=1024, megabytes=1):
            tags, blks, texts = (batch.column(c).to_pylist() for c in ("tag", "blk", "text"))
            n_known, base, take, bits, mine = [], [], [], [], []

            def measure() -> None:
                """Code lengths of the texts that wait, all of one block."""
                parts = [(i, p) for i, text in enumerate(mine) for p in pieces(text)]
                total = np.zeros(len(mine))
                for at in range(0, len(parts), 256):
                    for some in _cut(parts[at : at + 256]):
                        keys, starts = gram_keys([p for _, p in some])
                        np.add.at(total, [i for i, _ in some], np.add.reduceat(lengths.value(keys), starts, dtype=float))
                bits.append(total)
                mine.clear()

            for k, (tag, b, text) in enumerate(zip(tags, blks, texts, strict=True)):
                if b != blk:
                    if mine:
                        measure()
                    blk, counts, held, lengths = b, {}, [], None
                if tag == WORDS:
                    counts.update(zip(text.split(b"\n"), np.frombuffer(batch.column("counts")[k].as_py(), np.int64).tolist(), strict=True))
                    continue
                if tag == GRAMS:
                    held.append((unpressed(text, np.uint64), unpressed(batch.column("counts")[k].as_py(), np.float32)))
                    continue
                if lengths is None:
                    keys, costs = (np.concatenate(c) for c in zip(*held))
                    held = []
                    keys = unrolled(keys)
                    lengths = Table(keys).hold(costs)
                    del keys, costs
                text = text.lower()
                words = text.split()
                c = np.fromiter(map(counts.__getitem__, words), np.int64, len(words))
                take.append(k)
                mine.append(text)
                n_known.append((len(words) + 1, int((c > 0).sum()) + (ends > 0), len(text) + 1))
                base.append(float(np.log10(c + 1.0).sum() + np.log10(ends + 1.0) - (len(words) + 1) * np.log10(tokens + distinct + 1.0)))
            if mine:
                measure()
            if not take:
                continue
            total, n, rows_in = np.concatenate(bits), np.array(n_known, np.int64), pa.array(take)
            cols = [batch.column("doc_id").take(rows_in), pc.invert(batch.column("train").take(rows_in)), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(np.full(len(take), tokens, np.int64))]
            cols += [pa.array(x, pa.float64()) for x in (base, -total * np.log10(2.0), total / n[:, 2])]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in result.split(", ")])

    return whole.repartition("blk").sortWithinPartitions("blk", "tag").mapInArrow(run, result)


def _cut(parts: list[tuple[int, tuple[bytes, bytes]]]) -> Iterator[list[tuple[int, tuple[bytes, bytes]]]]:
    """Runs of pieces of about TOGETHER bytes, or of one longer piece."""
    run, size = [], 0
    for part in parts:
        if run and size + len(part[1][1]) > TOGETHER:
            yield run
            run, size = [], 0
        run.append(part)
        size += len(part[1][1])
    if run:
        yield run
