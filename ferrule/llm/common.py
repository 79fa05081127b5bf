"""Shared pieces: tables, shared scratch folders, vectorised word hashing.

A *word* is a maximal run of bytes outside ``\\x20\\x09-\\x0D`` (equal to
``[^\\x20\\x09-\\x0D]+`` on the text, as those code points are single bytes
in UTF-8).  Word and shingle hashes are 64-bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.session import scratch_path

CHUNK_BYTES = 1 << 20

WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True
IDENT = np.arange(256, dtype=np.uint8)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240901).integers(1, 1 << 63, 256, dtype=np.uint64)
_pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read
    back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``written`` gave, once all that was made of it is
    written itself."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


PREFILTER_BITS = 1 << 24


def prefilter(df: DataFrame, id_col: str, ids: DataFrame, bits: int = PREFILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: the rows whose id may be among ``ids`` (a long
    column of the same name), and the rest, surely not among them (nulls too).
    The ids are hashed into a bit table of ``bits`` bits; that table alone is
    broadcast, at most bits / 64 rows, so a join with ``ids`` that follows
    shuffles little more than the rows it is about."""
    place = F.pmod(F.xxhash64(id_col), F.lit(bits))
    table = (
        ids.select(place.alias("_prefilter_h")).groupBy(F.shiftright("_prefilter_h", 6).alias("_prefilter_w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_prefilter_h % 64 as int)))").alias("_prefilter_bits"))
    )
    table = F.broadcast(written(table, "prefilter"))
    hashed = df.withColumn("_prefilter_h", F.when(F.col(id_col).isNotNull(), place))
    cond = (F.shiftright(hashed["_prefilter_h"], 6) == table["_prefilter_w"]) & (
        F.expr("shiftright(_prefilter_bits, cast(_prefilter_h % 64 as int)) & 1") == 1)
    return hashed.join(table, cond, "left_semi").drop("_prefilter_h"), hashed.join(table, cond, "left_anti").drop("_prefilter_h")


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["up"]) < n:
        size = 1 << (n - 1).bit_length()
        inv = pow(_P, -1, 1 << 64)
        for key, base in (("up", _P), ("down", inv)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _pow[key] = np.multiply.accumulate(out)
    return _pow["up"], _pow["down"]


class Prefix:
    """Polynomial prefix sums over a byte buffer: the hash of any slice in O(1)."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def slices(self, start: np.ndarray, stop: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        return mix64(h + np.uint64((salt * 0xD6E8FEB86659FD93) & _MASK))


class Chunk:
    """Whole texts of some rows as one byte buffer.

    ``rows``: their positions in the batch; ``offsets``: len(rows) + 1 byte
    offsets; a null text is empty."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.rows)

    def spans(self, space: np.ndarray = WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, stops, first): byte spans of the words, and per row the
        index of its first word (len(rows) + 1 entries)."""
        n = len(self.data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(self.rows) + 1, np.int64)
        gap = space[self.data]
        edge = np.ones(n + 1, bool)
        edge[1:] = gap
        edge[self.offsets] = True
        starts = np.flatnonzero(edge[:-1] & ~gap)
        edge = np.ones(n + 1, bool)
        edge[:-1] = gap
        edge[self.offsets] = True
        stops = np.flatnonzero(edge[1:] & ~gap) + 1
        return starts, stops, np.searchsorted(starts, self.offsets)


def chunks(texts: pa.Array, target: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a column of texts into chunks of about ``target`` bytes; a text is
    never cut, so a longer one is a chunk of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    _, off, raw = texts.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + target, "right")) - 1)
        b = min(b, n)
        yield Chunk(np.arange(a, b), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words inside each row, and each row's first
    entry (len(rows) + 1).  A row of 1 to k-1 words has one shingle, its whole
    word sequence; a row without words has none."""
    counts = np.diff(first)
    out_counts = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(out_counts)])
    total = int(out_first[-1])
    pos = np.arange(total) + np.repeat(first[:-1] - out_first[:-1], out_counts)
    mult = seeds(k, 77)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    acc = np.zeros(total, np.uint64)
    short = np.repeat(counts < k, out_counts)
    left = np.repeat(counts, out_counts)
    for j in range(k):
        w = padded[pos + j]
        if short.any():
            w = np.where(short & (left <= j), np.uint64(j + 1), w)
        acc += w * mult[j]
    return mix64(acc), out_first


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, concatenated."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts)
