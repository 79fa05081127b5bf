"""Token ids in a fixed-width bit-packed file format.

Texts are encoded by a public tokenizer, an end id closes every document, and
each id is stored in the fewest bits that hold every id of the vocabulary.
A *block* (one row of the file) holds whole documents in ascending id order:

* ``doc_ids``, ``ends``: the documents and where each ends, in ids from the
  block's start;
* ``shard``, ``seq``, ``shard_offset``: the file, the block's place in it, and
  the ids of that file before the block, so an id's global place is the
  shard's offset + ``shard_offset`` + its place in the block;
* ``payload``: 16-byte header (magic, version, width, number of ids), then
  lanes of 64 ids in ``width`` 64-bit little-endian words.  Every lane has the
  same size, so id ``i`` lies in lane ``i // 64`` at a computed byte: any run
  of ids is unpacked with numpy without reading the rest.

The container is Parquet, so blocks are committed by Spark's writers to any
store, a lost task leaves nothing behind, and its statistics on ``first_doc``
serve look-ups by document.

Edge cases: a null or empty text is one document of the end id alone; rows of
equal or null id are kept, in text order, nulls first; a document longer than
a block's usual size is a block of its own.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm import common as C
from ferrule.llm.op9_bpe import CHUNK, WordTable
from ferrule.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1 << 18
LANE = 64
HEADER = struct.Struct("<4sBBxxQ")
MAGIC = b"BPK1"

FILE_SCHEMA = (
    "shard int, seq int, first_doc long, shard_offset long, n_ids long, "
    "doc_ids array<bigint>, ends array<bigint>, payload binary"
)


def width_for(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    n = len(ids)
    lanes = -(-n // LANE)
    src = np.zeros(lanes * LANE, np.uint64)
    src[:n] = ids
    if n and int(src.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    src = np.ascontiguousarray(src.reshape(lanes, LANE).T)
    out = np.zeros((width, lanes), np.uint64)
    for j in range(LANE):
        word, shift = divmod(j * width, 64)
        out[word] |= src[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= src[j] >> np.uint64(64 - shift)
    return HEADER.pack(MAGIC, 1, width, n) + np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start .. stop`` (default: all); only their lanes are touched."""
    magic, version, width, n = HEADER.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a bit-packed block")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    lo, hi = start // LANE, -(-stop // LANE)
    raw = np.frombuffer(payload, "<u8", (hi - lo) * width, HEADER.size + lo * width * 8)
    raw = np.ascontiguousarray(raw.reshape(hi - lo, width).T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((LANE, hi - lo), np.uint32)
    for j in range(LANE):
        word, shift = divmod(j * width, 64)
        v = raw[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (raw[word + 1] << np.uint64(64 - shift))
        out[j] = v & mask
    return out.T.ravel()[start - lo * LANE : stop - lo * LANE]


# --- encoding -------------------------------------------------------------

# What the tokenizer's own rules make separate pieces: white space always
# separates; inside a run of plain bytes (ASCII, and the letters U+00C0-00FF)
# a letter run, each digit and each punctuation run are pieces.  A run with an
# apostrophe, "<" or any other character goes to the tokenizer as one slice.
LETTER, DIGIT, PUNCT, OPAQUE, GAP = range(5)
_KIND = np.full(256, OPAQUE, np.uint8)
_KIND[33:127] = PUNCT
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[C.WS] = GAP
_KIND[[ord("'"), ord("<")]] = OPAQUE
_LOWER = C.IDENT.copy()
_LOWER[65:91] += 32


def slices(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, stops, first slice of every row (len + 1)): slices that
    the tokenizer encodes independently of what surrounds them."""
    data = chunk.data
    n = len(data)
    starts, stops, first = chunk.spans()
    if not len(starts):
        return data, starts, stops, first
    kind = _KIND[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < n]
    nxt = data[lead + 1]
    ok = lead[(nxt != 0x97) & (nxt != 0xB7)]  # the signs for times and division are no letters
    kind[ok] = kind[ok + 1] = LETTER
    edge = np.zeros(n, bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    lower = _LOWER[data]
    for w in np.unique(np.searchsorted(starts, np.flatnonzero(kind == OPAQUE), "right") - 1).tolist():
        a, b = starts[w], stops[w]
        edge[a:b] = False
        lower[a:b] = data[a:b]
        kind[a:b] = OPAQUE
    edge[starts] = True
    at = np.flatnonzero(edge & (kind != GAP))
    word = np.searchsorted(starts, at, "right") - 1
    ends = np.minimum(np.append(at[1:], n), stops[word])
    return lower, at, ends, np.searchsorted(at, starts[np.minimum(first, len(starts) - 1)] + (first == len(starts)) * n)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = width_for(self.tokenizer.get_vocab_size(with_added_tokens=True))
        ends = [t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])]
        self.ends_word = np.array(ends)
        self.words = WordTable(self._encode_all)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_all(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Plain letter runs are one piece each, and a piece's last token alone
        ends with the word mark; so many are encoded as one text and cut there."""
        plain = [k for k, w in enumerate(words) if w.decode("utf-8").isalpha()]
        runs: list[list[int] | None] = [None] * len(words)
        for a in range(0, len(plain), 5000):
            part = plain[a : a + 5000]
            ids = np.array(self._ids(" ".join(words[k].decode() for k in part)), np.int64)
            cut = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cut) == len(part):
                ids = ids.tolist()
                for k, x, y in zip(part, [0, *cut.tolist()], cut.tolist()):
                    runs[k] = ids[x:y]
        runs = [self._ids(w.decode("utf-8")) if r is None else r for w, r in zip(words, runs)]
        return [i for run in runs for i in run], [len(run) for run in runs]

    def encode(self, chunk: C.Chunk, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids with an end id after every row, ids of each row)."""
        data, starts, stops, first = slices(chunk)
        ids, counts = self.words.expand(data, starts, stops)
        cut = np.concatenate([[0], np.cumsum(counts)])[first]
        out = np.insert(ids, cut[1:], end_id)
        return out, np.diff(cut) + 1


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(df: DataFrame, path: str, vocabulary: str, end_id: int = END_ID,
          id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encodes every text and writes the file format at ``path``, documents in
    ascending id order over all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        shard, state = TaskContext.get().partitionId(), {"seq": 0, "offset": 0}
        held: list = []  # (doc ids, ids, counts)

        def flush():
            docs = [d for x in held for d in x[0]]
            ids = np.concatenate([x[1] for x in held])
            ends = np.cumsum(np.concatenate([x[2] for x in held]))
            row = (shard, state["seq"], docs[0], state["offset"], len(ids), docs, ends.tolist(), pack(ids, own.width))
            state["seq"] += 1
            state["offset"] += len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (
                pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))],
                names=["shard", "seq", "first_doc", "shard_offset", "n_ids", "doc_ids", "ends", "payload"])

        n = 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for chunk in C.chunks(batch.column(1), CHUNK):
                ids, counts = own.encode(chunk, end_id)
                held.append((docs[chunk.rows[0] : chunk.rows[0] + len(chunk)], ids, counts))
                n += len(ids)
                if n >= block_ids:
                    n = 0
                    yield flush()
        if held:
            yield flush()

    (
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, FILE_SCHEMA)
        .write.parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start (ids of
    all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row per file: the ids of all files before it
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select(
        "shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, docs, ends, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack(payload).astype("<u4")
                stop = np.array(ends)
                start = np.concatenate([[0], stop[:-1]])
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array(start + base), pa.array(stop - start),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), stop.tolist())], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per file of this run on the joined side: bounded by the number of files
    return (
        blocks.join(F.broadcast(files), "shard")
        .select((F.col("file_offset") + F.col("shard_offset")).alias("base"), "doc_ids", "ends", "payload")
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def read_tokens(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of one document (one array per row of that id);
    only blocks whose range can hold it are read, and only its lanes unpacked."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path).filter(
        (F.col("first_doc") <= doc_id) & F.array_contains("doc_ids", doc_id))
    out = []
    for r in blocks.orderBy("shard", "seq").toLocalIterator():
        for k, d in enumerate(r["doc_ids"]):
            if d == doc_id:
                out.append(unpack(bytes(r["payload"]), r["ends"][k - 1] if k else 0, r["ends"][k]))
    return out


def op2_bitpacked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, f"op2-{uuid.uuid4().hex}")
    write(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return read(spark, path)


# no SQL: tested against the tokenizers library on whole texts
QUERIES = {"op2_bitpacked_tokens": (op2_bitpacked_tokens, None)}
