"""Helpers that the text operators share: hashing of words, splitting by id, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: ASCII white space, the separators of the word pattern [^\x20\x09-\x0D]+; bytes.split() splits on just these.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Entries a worker's word cache may hold before it is emptied.
CACHE_ENTRIES = 200_000
#: Spark's setting by which a query's shuffle files go when it ends.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine is set if
    the executors run in this process, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pointloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, and outlives a lost executor. With free, the shuffle
    files of the write go when it ends; else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(FREES, None)
    if free:
        spark.conf.set(FREES, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.set(FREES, before) if before is not None else spark.conf.unset(FREES)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path  # type: ignore[attr-defined]
    return made


def discard(*tables: DataFrame) -> None:
    """Removes the files of staged tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)  # type: ignore[attr-defined]
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def as_bytes(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("binary"), F.lit(b""))


_live: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What make() made for this name, if it was the last that this worker asked for; else it is made now. A worker serves many
    tasks, of one operator after the other, and so holds the cache of one at a time."""
    if name not in _live:
        _live.clear()
        _live[name] = make()
    return _live[name]  # type: ignore[return-value]


class WordIds(dict):
    """bytes -> 64-bit hash, remembered; a stable hash, the same on all executors."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width word ids, in order: len(ids) - width + 1 values (none if shorter)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return acc


def shingle_set(ids: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words than width the whole sequence is one; none without words."""
    if not len(ids):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(ids, min(width, len(ids))))


def packed(arrays: Iterable[np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def give_back() -> None:
    """Returns memory that a task no longer needs to the machine: an idle worker is kept for the tasks to come."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(it: Iterator[pa.RecordBatch], rows: int = 4096, column: str = "text", megabytes: float = 16) -> Iterator[pa.RecordBatch]:
    """The record batches cut so that none exceeds the given rows or, roughly, the bytes of the named column."""
    for batch in it:
        start, n = 0, batch.num_rows
        if not n:
            continue
        sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        while start < n:
            base = sizes[start - 1] if start else 0
            end = int(np.searchsorted(sizes, base + megabytes * 2**20, "right"))
            end = min(max(end, start + 1), start + rows, n)
            yield batch.slice(start, end - start)
            start = end
    give_back()


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by one aggregate."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df (for file tables the files' size); used for partition counts only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
