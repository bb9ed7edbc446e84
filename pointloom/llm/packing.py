"""Best-fit packing of tokenized documents by the sum-of-squares rule."""

from __future__ import annotations

import codecs
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import as_bytes, batches, kept, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Pieces that one packing task gets: enough for the open bins it leaves to be few, and few enough to hold.
GROUP_PIECES = 40_000
SEPARATOR = b"\x00\x00\x00\x00"
#: Marks that the tokenizer parts from the letters before them; an apostrophe may belong to what follows.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MARK_BYTES = MARKS.encode()
#: Byte-level vocabularies write a byte as the character of that number if it is printable, and else as the next one from 256 on.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_LETTERS = "".join(chr(256 + _OTHERS.index(b) if b in _OTHERS else b) for b in range(256))


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkIds(dict):
    """A run of non-space bytes -> its token ids as little-endian unsigned 32-bit integers.

    The tokenizer never merges over white space, nor over the edge between letters and a mark after them, and lowers case;
    so a text's ids are those of its runs, end to end, and a run's are those of its parts. Strings of special tokens have no
    white space, so they too are found within a run."""

    #: Runs, and words in lower case, that are remembered before all are forgotten; those over 64 bytes never are.
    LIMIT = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # by themselves, as runs with capitals and marks fill the others sooner, and words take longer to make
        self.words: dict[bytes, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        value = self.made(chunk)
        if len(chunk) <= 64:
            self[chunk] = value
        return value

    def made(self, chunk: bytes) -> bytes:
        # runs of ASCII letters are quick to take apart
        letters = chunk.rstrip(MARK_BYTES)
        if letters.isalpha():
            ids = self.word(letters.lower())
            return ids + self[chunk[len(letters) :]] if len(letters) < len(chunk) else ids
        word = chunk.decode("utf-8", "replace")
        body = word.rstrip(MARKS)
        low = body.lower()
        if self.letters(body) and self.letters(low):
            ids = self.word(low.encode())
            return ids + self[chunk[len(body.encode()) :]] if len(body) < len(word) else ids
        return packed_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def word(self, chunk: bytes) -> bytes:
        """The ids of Latin letters in lower case."""
        value = self.words.get(chunk)
        if value is None:
            spelled, _ = codecs.charmap_decode(chunk, "strict", BYTE_LETTERS)
            value = packed_ids([t.id for t in self.model.tokenize(spelled)])
            if len(chunk) <= 64:
                self.words[chunk] = value
        return value

    @staticmethod
    def letters(word: str) -> bool:
        """Whether all are Latin letters, which the tokenizer keeps together."""
        return word.isalpha() and max(word) < "\u0250"

    def text(self, data: bytes) -> bytes:
        for known in (self, self.words):
            if len(known) > self.LIMIT:
                known.clear()
        return b"".join(map(self.__getitem__, data.split()))


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: its document's ids, the separator id 0 at the end, cut every capacity ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, step = kept(f"chunks {tokenizer_path}", lambda: ChunkIds(tokenizer_path)), 4 * capacity
        for batch in batches(it):
            ids, out = batch.column("doc_id").to_pylist(), ([], [], [], [], [])
            for who, data in zip(ids, batch.column("text").to_pylist(), strict=True):
                stream = chunks.text(data) + SEPARATOR
                for k, at in enumerate(range(0, len(stream), step)):
                    piece = stream[at : at + step]
                    for column, value in zip(out, (who, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text).alias("text"))
    return rows.mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins for items in the given order: (bin of each item, offset in it, fill of each bin).

    counts[g] is the number of open bins with residual gap g. Putting an item of length s into a bin of gap g takes that
    bin from counts[g] to counts[g - s]; of all gaps, and of a new bin, the one after which the sum of counts squared is
    least is taken (ties: the tightest gap, a new bin last). Full bins are closed and not counted."""
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, s in enumerate(lengths.tolist()):
        old = counts[s : capacity + 1]
        # the change of the sum of squares is 2 * (counts[g - s] - counts[g] + 1); filling a bin changes it by 1 - 2 * counts[g]
        change = 2 * (counts[: capacity + 1 - s] - old + 1)
        change[0] = 1 - 2 * old[0]
        change[old == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        fresh = 2 * counts[capacity - s] + 1 if s < capacity else 0
        if old[best] and change[best] <= fresh:
            gap = best + s
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            b, gap = len(fill), capacity
            fill.append(0)
        where[k], offset[k] = b, fill[b]
        fill[b] += s
        if gap > s:
            counts[gap - s] += 1
            open_bins[gap - s].append(b)
    return where, offset, np.asarray(fill, np.int64)


def pack_group(lengths: np.ndarray, keys: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Long pieces go first, by length and then key, as a rule that
    looks at residual gaps wastes least when small pieces are left for the end."""
    order = np.lexsort((keys, -lengths))
    where, offset, fill = sum_of_squares(lengths[order], capacity)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return where[back], offset[back], len(fill)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """All documents as token sequences of at most capacity ids, in as few as the rule gets.

    Null and empty texts are the single id 0. Repeated rows are packed as often as they occur. A null doc_id stays null.
    An empty table gives no rows. Pieces of full length are sequences by themselves. The others are dealt out evenly by a
    hash of all they are and their place in the staged table, and each task packs its share by sum_of_squares; a share's size doesn't depend on the input's,
    so the open bins left are the same small part of it. Only lengths and checksums are shuffled, never ids."""
    pieces = staged(tokenized(docs, tokenizer_path, capacity, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "pieces")
    part = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_pieces))
    mixed = F.xxhash64("doc_id", "piece", "length", "ids_crc32", "row")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        share = whole.column("share").to_numpy()
        for g in np.unique(share):  # hash partitions may hold several shares, or none
            table = whole.filter(pa.array(share == g))
            where, offset, _ = pack_group(table.column("length").to_numpy(), table.column("key").to_numpy(), capacity)
            table = table.drop_columns(["share", "key", "row"])
            table = table.append_column("sequence_id", pa.array(where * np.int64(2 * groups) + 2 * int(g), pa.int64()))
            yield from table.append_column("offset", pa.array(offset, pa.int64())).combine_chunks().to_batches()

    dealt = part.withColumn("key", mixed).withColumn("share", F.pmod("key", F.lit(groups)).cast("int")).repartition(groups, "share")
    # full pieces have odd numbers, by their place in the staged table, and sequences of others even ones
    whole = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.shiftleft("row", 1).bitwiseOR(F.lit(1).cast("long")), "offset": F.lit(0).cast("long")})
    return dealt.mapInArrow(run, PACKED).unionByName(whole.drop("row"))
