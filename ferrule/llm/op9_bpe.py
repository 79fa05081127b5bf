"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Text is cut where ``public_tokenizers.PATTERN`` ends its matches, without a
regex.  Every code point gets a class (letter, number, other, apostrophe that
can open a contraction, white space by what follows it).  A class is a
*transition function* over the few states "what the current match is"; such
functions compose associatively, so the state before every code point comes
from a blocked scan: each block folds its functions, a log-step scan composes
the blocks, and one more pass inside the blocks writes the cut flags.  Slices
between cuts feed a cached pair-merge by the vocabulary's ranks.  Token ids
are expanded by offset tables, and the same tables decode them.

Edge cases: a null or empty text has no token; a very long word is merged with
a heap (n log n) and not cached; repeated rows and null ids are returned like
any other row.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import common as C

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# classes
L, N, O, A1, A2, SP, SL, S = range(8)
# states: what the match that holds the previous code point is
LET, NUM, OTH, RUN, JOIN, DONE, ONE, TWO = range(8)
# words of at most WORD_BYTES are kept, CACHE_BYTES of them in all, counting
# WORD_COST for the table's own objects
WORD_BYTES, WORD_COST, CACHE_BYTES = 64, 200, 64 << 20
CHUNK = C.CHUNK_BYTES // 4
BLOCK = 256


def _step(state: int, cls: int) -> tuple[int, bool]:
    """(next state, whether a match starts here)."""
    if state == TWO:
        return ONE, False
    if state == ONE:
        return DONE, False
    if cls == L:
        return LET, state not in (LET, JOIN)
    if cls == N:
        return NUM, state not in (NUM, JOIN)
    if cls == O or (cls in (A1, A2) and state in (OTH, JOIN)):
        return OTH, state not in (OTH, JOIN)
    if cls in (A1, A2):
        return (ONE if cls == A1 else TWO), True
    if cls == S:
        return RUN, state != RUN
    return (JOIN if cls == SP else DONE), True


# class + 8: the first code point of a text, a constant function
_NEXT = np.array([[_step(s if c < 8 else DONE, c % 8)[0] for s in range(8)] for c in range(16)], np.uint8)
_CUT = np.array([[c >= 8 or _step(s, c % 8)[1] for s in range(8)] for c in range(16)], bool)
_NEXT_FLAT, _CUT_FLAT = _NEXT.ravel(), _CUT.ravel()

WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def code_point_classes() -> np.ndarray:
    kind = {"L": L, "N": N}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)], np.uint8)
    out[WHITE] = S
    return out


def classify(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Class of every code point; ``firsts``: positions where a text begins."""
    cls = code_point_classes()[points]
    n = len(points)
    begins = np.zeros(n + 3, bool)
    begins[firsts[firsts < n]] = True
    begins[n:] = True
    # white space followed by something else in the same text
    more = np.zeros(n, bool)
    more[:-1] = (cls[1:] != S) & ~begins[1:n]
    last = (cls == S) & more
    cls[last] = np.where(points[last] == 0x20, SP, SL)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        ext = np.concatenate([points, np.zeros(2, points.dtype)])
        one = np.where(begins[at + 1], 0, ext[at + 1])
        two = np.where(begins[at + 1] | begins[at + 2], 0, ext[at + 2])
        is1 = np.isin(one, [ord(x) for x in "stmd"])
        is2 = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        cls[at[is1]] = A1
        cls[at[is2]] = A2
    cls[firsts[firsts < n]] += 8
    return cls


def cuts(cls: np.ndarray) -> np.ndarray:
    """Positions where a match starts, by an associative scan of the classes'
    transition functions."""
    n = len(cls)
    if not n:
        return np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, 8 + O, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) << 3  # one row per step; 127 at most
    # fold: the function of every block
    fold = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in grid:
        fold = _NEXT_FLAT[row[:, None] + fold]
    # scan over the blocks: after step d, fold[i] covers 2d blocks up to i
    d = 1
    while d < blocks:
        fold[d:] = np.take_along_axis(fold[d:], fold[:-d].astype(np.int64), 1)
        d *= 2
    state = np.full(blocks, DONE, np.uint8)
    state[1:] = fold[:-1, DONE]
    flags = np.empty((BLOCK, blocks), bool)
    for j, row in enumerate(grid):
        at = row + state
        flags[j] = _CUT_FLAT[at]
        state = _NEXT_FLAT[at]
    return np.flatnonzero(flags.T.ravel()[:n])


def pieces(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and stops of the matches, and per row the index of its
    first match (len + 1)."""
    lead = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    row_points = np.searchsorted(lead, chunk.offsets)
    starts_cp = cuts(classify(points, row_points[:-1][np.diff(row_points) > 0]))
    starts = lead[starts_cp]
    stops = np.append(starts[1:], len(chunk.data))[: len(starts)]
    return starts, stops, np.searchsorted(starts_cp, row_points)


def merge_pairs(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: merge the adjacent pair of lowest rank, leftmost
    first, until none is in the vocabulary.  A heap holds the pairs, a linked
    list the parts."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # part starting at i stops at end[i]
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            r = ranks.get(word[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0:
            r = ranks.get(word[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class WordTable:
    """word -> its run of ids; words not seen before are encoded together by
    ``encode(words) -> (ids of all, number of ids of each)``.  Short ones are kept,
    up to ``CACHE_BYTES`` in all; longer ones are encoded where they occur."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.first, self.ids = array("q", [0]), array("I")
        self.size = 0

    def _add(self, words: list[bytes]) -> list[int]:
        """Places of these short words, now kept."""
        ids, counts = self.encode(words)
        at = len(self.first) - 1
        self.ids.extend(ids)
        end = self.first[-1]
        for n in counts:
            end += n
            self.first.append(end)
        self.place.update((w, at + k) for k, w in enumerate(words))
        self.size += sum(map(len, words)) + 4 * len(ids) + WORD_COST * len(words)
        return list(range(at, at + len(words)))

    def expand(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the given slices in order, number of ids of each slice).
        Equal slices, told by a 64-bit hash, are looked up once."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.size > CACHE_BYTES:
            self.clear()
        _, one, where = np.unique(C.Prefix(data).slices(starts, stops), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[one].tolist(), stops[one].tolist())]
        long = np.flatnonzero(stops[one] - starts[one] > WORD_BYTES)
        found = list(map(self.place.get, words))
        missing = [k for k, at in enumerate(found) if at is None and len(words[k]) <= WORD_BYTES]
        for k, at in zip(missing, self._add([words[k] for k in missing])):
            found[k] = at
        at = np.array([0 if x is None else x for x in found], np.int64)
        bounds = np.append(np.frombuffer(self.first, np.int64), self.first[-1])
        lo, counts = bounds[at], bounds[at + 1] - bounds[at]
        ids = np.frombuffer(self.ids, np.uint32)
        if len(long):
            # this chunk's long words follow the kept ones, for this call only
            more, n = self.encode([words[k] for k in long.tolist()])
            counts[long] = n
            lo[long] = len(ids) + np.cumsum(n) - n
            ids = np.concatenate([ids, np.array(more, np.uint32)])
        lo, counts = lo[where], counts[where]
        out = ids[np.repeat(lo, counts) + C.ramp(counts)]
        return out, counts


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = WordTable(self._merge_all)
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            by_id[i] = token
        self.token_len = np.array([len(t) for t in by_id], np.int64)
        self.token_first = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def _merge_all(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        runs = [merge_pairs(w, self.ranks) for w in words]
        return [i for run in runs for i in run], [len(run) for run in runs]

    def encode(self, chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of every row (len + 1))."""
        starts, stops, first = pieces(chunk)
        ids, counts = self.words.expand(chunk.data, starts, stops)
        return ids, np.concatenate([[0], np.cumsum(counts)])[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, first byte of every row (len + 1))."""
        n = self.token_len[ids]
        data = self.token_bytes[np.repeat(self.token_first[ids], n) + C.ramp(n)]
        return data, np.concatenate([[0], np.cumsum(n)])[first]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per input row: the id column, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` (of the bytes decoded from the ids) and, with ``ids``,
    the token ids themselves.  Every executor reads the rank file at ``path``
    (installed there like the package itself)."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for chunk in C.chunks(batch.column(1), CHUNK):
                tokens, first = own.encode(chunk)
                raw, cut = own.decode(tokens, first)
                spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
                cols = [
                    batch.column(0).slice(int(chunk.rows[0]), len(chunk)),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.sha256(tokens[a:b].astype("<u4")).hexdigest() for a, b in spans], pa.string()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.string()),
                ]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)
        pa.default_memory_pool().release_unused()

    return df.select(id_col, text_col).mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(C.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


# no SQL: tested against the tiktoken library
QUERIES = {"op9_byte_bpe": (op9_byte_bpe, None)}
