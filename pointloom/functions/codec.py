"""Codecs: quantisation and deltas as expressions, Huffman and blob sizes as grouped functions."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quantise(c: Column, scale: float = 10000.0) -> Column:
    """Coordinates on disk: scaled and rounded."""
    return F.round(c * scale).cast("int")


def quantise_even(c: Column, scale: float = 1000.0) -> Column:
    """The older codec's coordinates: scaled and rounded half to even."""
    return F.bround(c * scale).cast("long")


def intensity_code(c: Column, scale: float = 32767.0) -> Column:
    """Intensity on disk: scaled and cut off."""
    return F.floor(c * scale).cast("int")


def decode(points: DataFrame, coordinate_scale: float = 10000.0, intensity_scale: float = 32767.0) -> DataFrame:
    """xq, yq, zq, iq -> x, y, z, intensity."""
    made = {c: F.col(f"{c}q") / coordinate_scale for c in "xyz"} | {"intensity": F.col("iq") / intensity_scale}
    return points.withColumns(made).drop("xq", "yq", "zq", "iq")


def encode(points: DataFrame, coordinate_scale: float = 10000.0, intensity_scale: float = 32767.0) -> DataFrame:
    """x, y, z, intensity -> xq, yq, zq, iq."""
    made = {f"{c}q": quantise(F.col(c), coordinate_scale) for c in "xyz"} | {"iq": intensity_code(F.col("intensity"), intensity_scale)}
    return points.withColumns(made).drop("x", "y", "z", "intensity")


def frame_of_reference(rows: DataFrame, value: str, group: str) -> DataFrame:
    """value less its group's least, which is base; the least is aggregated and joined, so a large group is no single task's."""
    low = rows.groupBy(group).agg(F.min(value).alias("base"))
    return rows.join(low, group).withColumn("delta", F.col(value) - F.col("base"))


def byte_counts(rows: DataFrame, value: str, group: str) -> DataFrame:
    """How often each byte occurs in the 32-bit little-endian integers of a group: (group, byte, n)."""
    v = F.col(value).cast("long")
    four = F.array(*(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(4)))
    return rows.select(group, F.explode(four).alias("byte")).groupBy(group, "byte").agg(F.count("*").alias("n"))


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code length of each symbol. A lone symbol gets one bit, so that it can be decoded."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, s, (s,)) for s, n in sorted(counts.items())]
    heapq.heapify(heap)
    depth = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        (n, s, left), (m, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for symbol in left + right:
            depth[symbol] += 1
        heapq.heappush(heap, (n + m, s, left + right))
    return depth


def huffman_codes(counts: dict[int, int]) -> dict[int, str]:
    """Canonical codes: by length, then by symbol."""
    code, last, out = 0, 0, {}
    for symbol, length in sorted(huffman_lengths(counts).items(), key=lambda x: (x[1], x[0])):
        code <<= length - last
        out[symbol], last = format(code, f"0{length}b"), length
        code += 1
    return out


def huffman_encode(data: bytes) -> tuple[bytes, int, dict[int, str]]:
    """(packed bits, number of bits, codes)."""
    codes = huffman_codes(dict(zip(*(x.tolist() for x in np.unique(np.frombuffer(data, np.uint8), return_counts=True))))) if data else {}
    bits = "".join(map(codes.__getitem__, data))
    return int(bits or "0", 2).to_bytes((len(bits) + 7) // 8, "big"), len(bits), codes


def huffman_decode(packed: bytes, n_bits: int, codes: dict[int, str]) -> bytes:
    symbols = {code: s for s, code in codes.items()}
    bits, out, at = (format(int.from_bytes(packed, "big"), f"0{n_bits}b") if n_bits else ""), bytearray(), 0
    for end in range(1, n_bits + 1):
        if (s := symbols.get(bits[at:end])) is not None:
            out.append(s)
            at = end
    return bytes(out)


def huffman_size(counts: DataFrame, group: str) -> DataFrame:
    """Bits and bytes of each group's Huffman code, from its byte counts (256 rows a group at most)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(pdf["byte"].tolist(), pdf["n"].tolist()))
        lengths = huffman_lengths(n)
        bits = sum(n[s] * lengths[s] for s in n)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "symbols": [len(n)], "bits": [bits], "bytes": [-(-bits // 8)]})

    kind = dict(counts.dtypes)[group]
    return counts.groupBy(group).applyInPandas(run, f"{group} {kind}, symbols long, bits long, bytes long")


def group_codec_sizes(stored: DataFrame, scale: float = 1000.0, intensity_scale: float = 32767.0) -> DataFrame:
    """The older codec over a whole store: coordinates of sensor-space patches, those of world-space ones, and intensities are
    each quantised, taken as differences from their least, and Huffman coded byte by byte: (grp, symbols, bits, bytes)."""
    space = F.when(F.col("transposed"), F.lit("world")).otherwise(F.lit("sensor"))
    xyz = stored.select(space.alias("grp"), F.explode(F.array(*(quantise_even(F.col(c), scale) for c in "xyz"))).alias("v"))
    shades = stored.select(F.lit("intensity").alias("grp"), F.explode(F.transform("intensities", lambda i: F.floor(i * intensity_scale).cast("long"))).alias("v"))
    return huffman_size(byte_counts(frame_of_reference(xyz.unionByName(shades), "v", "grp"), "delta", "grp"), "grp")


def delta_blob(values: Iterable[int]) -> bytes:
    """Integers as differences in turn, deflated: the payload whose size stands for a stored channel."""
    v = np.asarray(values, np.int64)
    return zlib.compress(np.diff(v, prepend=0).astype("<i4").tobytes(), 6)


def ordered(rows: DataFrame, group: list[str], by: list[str], name: str = "ord") -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*by)) - 1).cast("int"))
