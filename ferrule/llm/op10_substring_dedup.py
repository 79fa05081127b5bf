"""Substring dedup by paragraph MinHash banding.

Passages are pasted anywhere, so a *paragraph* is not a line but ``WORDS``
consecutive words that begin at an anchor: a position whose three-word hash is
the least of some ``REACH`` positions in a row.  Anchors depend on the words
around them alone, so a passage of ``WORDS + REACH + 2`` words (51) holds one
whole paragraph at least, the same one in every document that has it.

*Banding.*  ``bands`` gives the fewest bands (of one min-hash over the
paragraph's five-word shingles) that let paragraphs at the threshold collide
with the wanted recall; equal paragraphs collide in all.  Equal paragraphs are
one class, told by a 64-bit hash and counted where they are read, so a passage
in a third of all documents is one row.  Classes that share a band's key are
compared by the exact Jaccard similarity of their shingles, in cells of two
blocks (``blocks.py``); components of the similar ones are clusters.

*Extension.*  A change in the middle of a longer passage leaves few windows
equal, so passages are also seeded: ``SEED_WORDS`` words from denser anchors, of
which every ``SEED_WORDS + SEED_REACH - 1`` words (22) in a row hold one.  Words of
Jaccard similarity 0.8 or more to others have 22 equal ones in a row (the worst
is one inserted word in the middle of 44).  Equal seeds, and equal paragraphs,
link each document to the one of smallest id that has them; overlapping links
on one diagonal are a run.  From each run the chain of equal shingles is
followed over ``CONTEXT`` shingles on both sides, and the longest extent whose
shingles, counted along the chain, have the threshold's Jaccard similarity is
taken if a paragraph of ``WORDS`` words that holds it, all else in it unlike the
other's, has that similarity still: 23 equal words in a row at least, of 19
different shingles.

*Removal.*  In a cluster of two documents at least, the document of smallest
id keeps its paragraphs and all others lose them; so does the later document
of an extent, in full.  Overlapping ones merge to spans.  Whole texts are used,
and only spans leave a text.  The kept span of an extent is its run.

Edge cases: null, empty and short texts (under ``WORDS`` words) have no
paragraph; rows of one id count as one document; rows of null id have no
paragraph and stay as they are; very long texts are read whole, a text at a
time; empty tables give no spans; further columns are not looked at.  A
*stretch* repeats fewer than ``WORDS`` words over and over (one word, a pair, a
sentence), at least twice and over ``WORDS`` words or more.  It has anchors in its
first and last repetition only, and is also a record of the words that it
repeats, wherever it begins among them; it goes whole where a document of
smaller id has such a stretch.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm import blocks as B
from ferrule.llm import common as C
from ferrule.llm.components import components
from ferrule.llm.op1_ngram_join import intersections

WORDS, REACH, K = 25, 24, 5
SEED_WORDS, SEED_REACH, CONTEXT = 12, 11, 120
THRESHOLD, RECALL, SEED = 0.8, 0.95, 10
BLOCK = 512
FEW = 32  # cells of so many rows are compared pair by pair

LINK_SCHEMA = "doc_id long, start int, stop int, keeper long, kstart int, kstop int"


def bands(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Fewest bands of one min-hash that reach the recall at the threshold."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold) - 1e-9))


def least_words(threshold: float = THRESHOLD) -> int:
    """Fewest equal words in a row that make two paragraphs of ``WORDS`` words
    similar, if they share nothing else."""
    return math.ceil(2 * (WORDS - K + 1) * threshold / (1 + threshold) - 1e-9) + K - 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` entries in a row (len(x) - width + 1)."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def periodic(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the words ``w``: first word, word after the last, and period
    (the least one).  Rows begin at ``first``."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    a, z, period = (np.zeros(0, np.int64) for _ in range(3))
    for p in range(1, min(WORDS, len(w))):
        # so many equal entries in a row hold one whose number divides by them,
        # and half of them lie before or after that one
        run = max(WORDS - p, p)
        later, sooner = w[p:], w[:-p]
        mark = np.flatnonzero(later[::run] == sooner[::run]) * run
        near, far = mark, mark
        for j in range(1, run // 2 + 1):
            near = near[near + j < len(later)]
            near = near[later[near + j] == sooner[near + j]]
            far = far[far >= j]
            far = far[later[far - j] == sooner[far - j]]
        if not len(near) and not len(far):
            continue
        at = np.flatnonzero((later == sooner) & (row[p:] == row[:-p]))
        if len(at) < run:
            continue
        cut = np.flatnonzero(np.diff(at) != 1)
        i, j = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + p + 1
        long = j - i >= max(WORDS, 2 * p)
        i, j = i[long], j[long]
        if len(i) and len(a):
            order = np.argsort(a, kind="stable")
            known = np.searchsorted(a[order], i, "right") - 1
            new = (known < 0) | (np.maximum.accumulate(z[order])[known] < j)
            i, j = i[new], j[new]
        a, z, period = np.append(a, i), np.append(z, j), np.append(period, np.full(len(i), p))
    return a, z, period


class Read:
    """A chunk's words: where they start and stop, the first of each row, their
    hashes, their stretches, and the code points before each byte and row."""

    def __init__(self, c: C.Chunk):
        self.starts, self.stops, self.first = c.spans()
        self.w = C.Prefix(c.data).slices(self.starts, self.stops)
        self.stretches = periodic(self.w, self.first)
        self.chars = np.cumsum((c.data & 0xC0) != 0x80)
        self.base = np.concatenate([[0], self.chars])[c.offsets[:-1]]

    def places(self, row: np.ndarray, a: np.ndarray, z: np.ndarray) -> dict[str, np.ndarray]:
        """Start and stop (code points of the row's text) of the words a to z."""
        return {"row": row, "start": self.chars[self.starts[a]] - 1 - self.base[row], "stop": self.chars[self.stops[z] - 1] - self.base[row]}


def paragraphs(c: C.Chunk, n_bands: int, words: int = WORDS, reach: int = REACH, read: Read | None = None) -> dict[str, np.ndarray]:
    """Of the chunk's paragraphs: row (in the chunk), start and stop (code
    points of the text), hash, and per band a 32-bit key."""
    r = read or Read(c)
    first, w = r.first, r.w
    n = len(w)
    counts = np.diff(first)
    valid = np.maximum(counts - words + 1, 0)
    none = {"row": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "stop": np.zeros(0, np.int64),
            "hash": np.zeros(0, np.uint64), "keys": np.zeros((0, n_bands), np.uint32)}
    total = int(valid.sum())
    if not total:
        return none
    m = C.seeds(3, SEED)
    three = C.mix64(w[:-2] * m[0] + w[1:-1] * m[1] + w[2:] * m[2])
    # places where a paragraph fits, one segment per row
    seg = np.concatenate([[0], np.cumsum(valid)])
    pos = np.arange(total) + np.repeat(first[:-1] - seg[:-1], valid)
    low = np.uint64((1 << 28) - 1)
    key = (three[pos] & ~low) | np.arange(total, dtype=np.uint64)
    picked = []
    if total >= reach:
        least = sliding_min(key, reach)
        row_of = np.repeat(np.arange(len(valid)), valid)
        inside = row_of[: len(least)] == row_of[reach - 1 :]
        picked.append(least[inside] & low)
    short = np.flatnonzero((valid > 0) & (valid < reach))
    if len(short):
        one = np.stack([seg[short], seg[short + 1]], axis=1).ravel()
        picked.append(np.minimum.reduceat(np.append(key, np.uint64(2**64 - 1)), one)[::2] & low)
    at = pos[np.unique(np.concatenate(picked)).astype(np.int64)]
    before = np.maximum(at - 1, 0)
    row = np.searchsorted(first, at, "right") - 1
    at = at[(three[at] != three[before]) | (at == first[row])]
    # inside a stretch: anchors of its first and last repetition only
    a, z, period = r.stretches
    a, z = a + period, z - words - period + 1
    deep = np.zeros(n + 1, np.int64)
    np.add.at(deep, a[a < z], 1)
    np.add.at(deep, z[a < z], -1)
    at = at[np.cumsum(deep)[at] == 0]
    row = np.searchsorted(first, at, "right") - 1
    # hash of the paragraph's words, and min-hashes of its shingles
    up, down = C._powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[:n])])
    whole = C.mix64((sums[at + words] - sums[at]) * down[at])
    k = C.seeds(K, 77)
    five = C.mix64(sum((w[j : n - K + 1 + j] * k[j] for j in range(K)), np.zeros(n - K + 1, np.uint64)))
    keys = [(sliding_min(C.mix64(five * s), words - K + 1)[at] >> np.uint64(32)).astype(np.uint32) for s in C.seeds(n_bands, SEED + 1)]
    return r.places(row, at, at + words - 1) | {
        "hash": whole, "keys": np.stack(keys, axis=1) if keys else np.zeros((len(at), 0), np.uint32)}


def stretches(r: Read) -> dict[str, np.ndarray]:
    """Of the chunk's stretches: row (in the chunk), start and stop (code points
    of the text), and hash of the words repeated, whichever of them comes first."""
    w = r.w
    a, z, period = r.stretches
    up, down = C._powers(len(w) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)])])
    turn = np.repeat(a, period) + C.ramp(period)
    each = C.mix64((sums[turn + np.repeat(period, period)] - sums[turn]) * down[turn])
    least = np.minimum.reduceat(each, np.cumsum(period) - period) if len(a) else each
    row = np.searchsorted(r.first, a, "right") - 1
    return r.places(row, a, z - 1) | {"hash": least}


def _stretches(found: DataFrame) -> DataFrame:
    """(doc_id, start, stop, keeper, removed) of the stretches that two documents
    have; ``found``: doc_id, start, stop, hash of all."""
    first = found.groupBy("hash").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_last")).filter("keeper < _last")
    return found.join(C.written(first.select("hash", "keeper"), "op10-stretch-keepers"), "hash").select(
        "doc_id", "start", "stop", "keeper", (F.col("doc_id") != F.col("keeper")).alias("removed"))


def _table(docs: DataFrame, n_bands: int, words: int = WORDS, reach: int = REACH, whole: bool = False) -> DataFrame:
    """(doc_id, start, stop, hash, keys) of all paragraphs; ``whole``: and of all
    stretches, whose keys are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "stop", "hash", *[f"k{b}" for b in range(n_bands)]]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for c in C.chunks(batch.column(1)):
                read = Read(c)
                for p in [paragraphs(c, n_bands, words, reach, read)] + ([stretches(read)] if whole else []):
                    cols = [pa.array(ids[c.rows[p["row"]]]), pa.array(p["start"].astype(np.int32)), pa.array(p["stop"].astype(np.int32)), pa.array(p["hash"].view(np.int64))]
                    cols += [pa.array(p["keys"][:, b].view(np.int32)) if "keys" in p else pa.nulls(len(cols[0]), pa.int32()) for b in range(n_bands)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = ", ".join(["doc_id long, start int, stop int, hash long", *[f"k{b} int" for b in range(n_bands)]])
    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def common_sizes(codes: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the common sets of the rows ``i`` and ``j``, pair by pair; a row
    of ``codes`` is a small set of numbers from 0 on."""
    size = np.diff(first)
    place = np.arange(max(int(size.max()), 1))
    inside = place < size[:, None]
    grid = np.full(inside.shape, -1, np.int32)
    grid[inside] = codes
    out = np.zeros(len(i), np.int64)
    for x in range(0, len(i), 4096):
        left, right = grid[i[x : x + 4096]], grid[j[x : x + 4096]]
        out[x : x + 4096] = ((left[:, :, None] == right[:, None, :]) & (left >= 0)[:, :, None]).sum(axis=(1, 2))
    return out


def similar_rows(cell: np.ndarray, mine: np.ndarray, sets: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sets are similar, within whole cells (``cell``: sorted
    numbers); of a cell of two blocks, pairs between these."""
    n = len(cell)
    first = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + n + 1]
    flat = np.frombuffer(sets.buffers()[2], np.uint8)[first[0] : first[-1]].view(np.uint64)
    first = (first - first[0]) // 8
    size = np.diff(first)
    alike = lambda both, x, y: both >= threshold * (x + y - both) - 1e-6
    begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    stop = np.append(begin[1:], n)
    one = np.minimum.reduceat(mine, begin) == np.maximum.reduceat(mine, begin)
    small = one & (stop - begin <= FEW)
    # cells of few rows, nearly all: all their pairs at once
    row = np.flatnonzero(np.repeat(small, stop - begin))
    later = np.repeat(stop, stop - begin)[row] - row - 1
    i = np.repeat(row, later)
    j = i + 1 + C.ramp(later)
    both = common_sizes(np.unique(flat, return_inverse=True)[1].astype(np.int32), first, i, j)
    good = alike(both, size[i], size[j])
    left, right = [i[good]], [j[good]]
    for x, y, single in zip(begin[~small].tolist(), stop[~small].tolist(), one[~small].tolist()):
        own, block = np.arange(y - x), mine[x:y]
        a, b = (own, own) if single else (own[block == block.min()], own[block == block.max()])
        both = intersections(flat[first[x] : first[y]], first[x : y + 1] - first[x], a, b)
        i, j = np.nonzero(alike(both, size[x:y][a][:, None], size[x:y][b][None, :]))
        left.append(x + a[i])
        right.append(x + b[j])
    return np.concatenate(left), np.concatenate(right)


def _similar(near: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between classes of paragraphs; ``near``: spot, hash, shingles.
    Cells come sorted, and a task holds one batch of them and a cell at most."""
    dealt = B.cells(near, ["spot"], F.col("hash"), BLOCK, near.groupBy("spot").agg(F.count(F.lit(1)).alias("_m")))
    key = ["spot", "_lo", "_hi"]
    rows = dealt.select("cell.*", "hash", "mine", "shingles").repartition(*key).sortWithinPartitions(*key, "hash")

    def links(t: pa.Table) -> pa.RecordBatch:
        cell = np.cumsum(_begins(t))
        ids = t.column("hash").to_numpy()
        i, j = similar_rows(cell, t.column("mine").to_numpy(), pa.concat_arrays(t.column("shingles").chunks), threshold)
        root = ids[B.roots(len(ids), i, j)]
        keep = root != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            last = int(np.flatnonzero(_begins(t))[-1])  # the last cell may go on
            if last:
                yield links(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield links(held)

    return rows.mapInArrow(run, "a long, b long")


def _begins(t: pa.Table) -> np.ndarray:
    """Where a cell begins in rows sorted by cell."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in ("spot", "_lo", "_hi"):
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _shingles(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(hash, shingles) of the classes in ``reps`` (doc_id, at: array of hash,
    start, stop), read from their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, parts = [], []
            for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in at:
                    hashes.append(x["hash"])
                    parts.append((text or "")[x["start"] : x["stop"]])
            out = []
            for c in C.chunks(pa.array(parts, pa.string())):
                starts, stops, first = c.spans()
                sh, cut = C.shingles(C.Prefix(c.data).slices(starts, stops), first, K)
                out += [np.unique(sh[x:y]).tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(out, pa.binary())], names=["hash", "shingles"])

    return docs.join(reps, "doc_id").select("text", "at").mapInArrow(run, "hash long, shingles binary").dropDuplicates(["hash"])


def _recurring(found: DataFrame, name: str) -> DataFrame:
    """The rows of ``found`` whose hash two documents have, and ``keeper``, the
    smallest of them.  Rows of other hashes, nearly all, are not shuffled."""
    of_two = found.groupBy("hash").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_last")).filter("keeper < _last")
    # written first, so that a join only joins, and Spark can split a hot hash
    of_two = C.written(of_two.select("hash", "keeper"), f"{name}-hashes")
    maybe, _ = C.prefilter(found, "hash", of_two.select("hash"))
    return C.written(maybe.join(of_two, "hash").select("doc_id", "start", "stop", "hash", "keeper"), name)


def _links(found: DataFrame, name: str) -> DataFrame:
    """(``LINK_SCHEMA``): each place of ``found`` (doc_id, start, stop, hash) with
    the first place of its hash, if that is in a document of smaller id."""
    places = _recurring(found, name)
    # places of one hash have equally many words: the first to begin ends first
    first = places.filter("doc_id = keeper").groupBy("hash").agg(F.min("start").alias("kstart"), F.min("stop").alias("kstop"))
    return places.filter("doc_id > keeper").join(C.written(first, f"{name}-first"), "hash").select(
        "doc_id", "start", "stop", "keeper", "kstart", "kstop")


def _islands(rows: DataFrame, group: list[str], alone: Column) -> DataFrame:
    """``rows`` with ``_island``: a number for those of a group that overlap or
    touch, one after the other; rows that are ``alone`` have each their own."""
    order = Window.partitionBy(*group).orderBy("start", "stop")
    top = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("_new", (alone | top.isNull() | (F.col("start") > top)).cast("int"))
    return begins.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _runs(links: DataFrame) -> DataFrame:
    """Links merged where they overlap on one diagonal of two documents; one
    whose spaces differ in length is a run of its own."""
    group = ["doc_id", "keeper", "_shift", "_ends"]
    laid = links.select("doc_id", "keeper", "start", "stop", (F.col("start") - F.col("kstart")).alias("_shift"), (F.col("stop") - F.col("kstop")).alias("_ends"))
    merged = _islands(laid, group, F.col("_shift") != F.col("_ends")).groupBy(*group, "_island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.select(
        "doc_id", "start", "stop", "keeper", (F.col("start") - F.col("_shift")).alias("kstart"), (F.col("stop") - F.col("_ends")).alias("kstop"))


def _places(batch: pa.RecordBatch, names: tuple[str, str]):
    """Of a batch (text, at: array of structs with a start and a stop in
    ``names``), per place that lies on words of its text: its entry in the
    array's values, (starts, stops) of the text's words, their shingles, and
    the place's first word and the word after its last."""
    at = batch.column(1)
    off, a, b = at.offsets.to_numpy(), at.values.field(names[0]).to_numpy(), at.values.field(names[1]).to_numpy()
    for c in C.chunks(batch.column(0)):
        starts, stops, first = c.spans()
        n = len(starts)
        if n < K:
            continue
        w = C.Prefix(c.data).slices(starts, stops)
        k = C.seeds(K, 77)
        five = C.mix64(sum((w[j : n - K + 1 + j] * k[j] for j in range(K)), np.zeros(n - K + 1, np.uint64)))
        five = (five >> np.uint64(32)).astype(np.uint32)
        chars = np.cumsum((c.data & 0xC0) != 0x80)
        base = np.concatenate([[0], chars])[c.offsets[:-1]]
        for r, row in enumerate(c.rows.tolist()):
            x, y = first[r], first[r + 1]
            if y - x < K:
                continue
            begin, end = chars[starts[x:y]] - 1 - base[r], chars[stops[x:y] - 1] - base[r]
            mine = np.arange(off[row], off[row + 1])
            p, q = np.searchsorted(begin, a[mine]), np.searchsorted(end, b[mine])
            fits = (p < q) & (q < y - x)
            fits[fits] = (begin[p[fits]] == a[mine[fits]]) & (end[q[fits]] == b[mine[fits]])
            for m, u, v in zip(mine[fits].tolist(), p[fits].tolist(), (q[fits] + 1).tolist()):
                if v - u >= K:
                    yield m, begin, end, five[x : y - K + 1], u, v


def _sides(five: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that end left of the run of words p..q, and right of it, going away from it."""
    return five[max(p - CONTEXT, 0) : p][::-1], five[q - K + 1 : q - K + 1 + CONTEXT]


def chain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest chain of equal entries of x and y, in the order of both: how
    many entries of x, and of y, it takes to hold 0, 1, 2, ... of them."""
    i, j = np.nonzero(x[:, None] == y[None, :])
    if len(i):
        order = np.lexsort((-j, i))
        i, j = i[order].tolist(), j[order].tolist()
    tails: list = []
    last: list = []
    before = [-1] * len(i)
    for n, b in enumerate(j):
        k = bisect_left(tails, b)
        before[n] = last[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            last.append(n)
        else:
            tails[k], last[k] = b, n
    path = []
    n = last[-1] if last else -1
    while n >= 0:
        path.append(n)
        n = before[n]
    path.reverse()
    return np.array([0, *[i[n] + 1 for n in path]]), np.array([0, *[j[n] + 1 for n in path]])


def extent(inside: int, mine: tuple, other: tuple, threshold: float) -> tuple[int, int]:
    """Words by which a run of ``inside`` equal shingles extends to the left and
    to the right: the longest extent of the wanted Jaccard similarity."""
    gain, length = [], []
    for x, y in zip(mine, other):
        a, b = chain(x, y)
        gain.append((1 + threshold) * np.arange(len(a)) - threshold * (a + b))
        length.append(a)
    good = gain[0][:, None] + gain[1][None, :] + (1 - threshold) * inside >= -1e-6
    u, v = np.unravel_index(np.argmax(np.where(good, length[0][:, None] + length[1][None, :], -1)), good.shape)
    return int(length[0][u]), int(length[1][v])


def _extended(docs: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """The extents (``LINK_SCHEMA``) of the runs that make paragraphs similar."""
    fewest = least_words(threshold)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("kstart", "kstop")
            held, left, right = [], [], []
            for m, begin, _, five, p, q in _places(batch, names):
                if len(begin) < WORDS:
                    continue
                x, y = _sides(five, p, q)
                held.append(m)
                left.append(x.tobytes())
                right.append(y.tobytes())
            place = batch.column(1).values.take(pa.array(held, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [place.field("keeper"), place.field("kstart"), place.field("kstop"), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["keeper", *names, "left", "right"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "start", "stop", "keeper", "kstart", "kstop")
        for batch in batches:
            values = batch.column(1).values
            left, right = values.field("left"), values.field("right")
            held, start, stop = [], [], []
            for m, begin, end, five, p, q in _places(batch, ("start", "stop")):
                if len(begin) < WORDS:
                    continue
                other = tuple(np.frombuffer(side[m].as_py(), np.uint32) for side in (left, right))
                u, v = extent(q - p - K + 1, _sides(five, p, q), other, threshold)
                alike = len(np.unique(five[p - u : q + v - K + 1]))
                if q - p + u + v >= WORDS or alike > fewest - K:
                    held.append(m)
                    start.append(int(begin[p - u]))
                    stop.append(int(end[q + v - 1]))
            place = values.take(pa.array(held, pa.int64()))
            cols = {c: place.field(c) for c in names}
            cols |= {"start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=list(names))

    spots = ["keeper", "kstart", "kstop"]
    reps = C.written(
        runs.select(*spots).distinct().groupBy(F.col("keeper").alias("doc_id")).agg(F.collect_list(F.struct(*spots)).alias("at")), "op10-run-keepers")
    maybe, _ = C.prefilter(docs, "doc_id", reps.select("doc_id"))
    sides = C.written(
        maybe.join(reps, "doc_id").select("text", "at")
        .mapInArrow(around, "keeper long, kstart int, kstop int, left binary, right binary").dropDuplicates(spots), "op10-sides")
    asked = C.written(
        runs.join(sides, spots).groupBy("doc_id")
        .agg(F.collect_list(F.struct("doc_id", "start", "stop", *spots, "left", "right")).alias("at")), "op10-asked")
    maybe, _ = C.prefilter(docs, "doc_id", asked.select("doc_id"))
    return C.written(maybe.join(asked, "doc_id").select("text", "at").mapInArrow(extend, LINK_SCHEMA), "op10-extents")


def repeats(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per span of a document that repeats in another one: doc_id,
    start, stop (code points), removed, keepers (documents that keep it).
    Input columns: doc_id, text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bands = bands(threshold, recall)
    both = C.written(_table(docs, n_bands, whole=True), "op10-paragraphs")
    found = both.filter("k0 is not null")
    repeated = C.written(_stretches(both.filter("k0 is null").select("doc_id", "start", "stop", "hash")), "op10-stretches")
    keys = [f"k{b}" for b in range(n_bands)]
    classes = C.written(
        found.groupBy("hash").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), *[F.min(k).alias(k) for k in keys]), "op10-classes")
    # a spot: a band and its key
    spots = F.array(*[F.lit(b << 32) + F.col(k) for b, k in enumerate(keys)])
    keyed = classes.select("hash", "d0", F.explode(spots).alias("spot"))
    # a link of classes that begin in one document can't change who keeps them:
    # overlapping paragraphs of a document don't make company
    company = C.written(
        keyed.groupBy("spot").agg(F.min("d0").alias("_a"), F.max("d0").alias("_b")).filter("_a < _b").select("spot"), "op10-company")
    maybe, _ = C.prefilter(keyed, "spot", company)
    near = C.written(maybe.join(company, "spot").select("spot", "hash"), "op10-near")
    # written first, so that a join only joins, and Spark can split a hot hash
    wanted = C.written(classes.filter("d0 < d1").select("hash").union(near.select("hash")).distinct(), "op10-wanted")
    maybe, _ = C.prefilter(found.select("doc_id", "start", "stop", "hash"), "hash", wanted)
    hits = C.written(maybe.join(wanted, "hash"), "op10-hits")
    C.discard(both)
    C.discard(classes)
    seeds = C.written(_table(docs, 0, SEED_WORDS, SEED_REACH), "op10-seeds")
    links = _links(seeds, "op10-seed-links").unionByName(_links(hits, "op10-hit-links"))
    runs = C.written(_runs(links), "op10-runs")
    C.discard(seeds)
    extents = _extended(docs, runs, threshold)
    # near classes: exact similarity, from one occurrence of each
    reps = hits.join(near.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(
        F.min(F.struct("doc_id", "start", "stop")).alias("o"))
    reps = C.written(
        reps.groupBy(F.col("o.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("hash", "o.start", "o.stop")).alias("at")), "op10-reps")
    maybe, _ = C.prefilter(docs, "doc_id", reps.select("doc_id"))
    shingles = C.written(_shingles(maybe, reps), "op10-shingles")
    comp = C.written(components(_similar(near.join(shingles, "hash"), threshold)), "op10-clusters")
    hits = hits.join(comp.withColumnRenamed("id", "hash"), "hash", "left").withColumn("component", F.coalesce("component", "hash"))
    clusters = hits.groupBy("component").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_last")).filter("keeper < _last")
    clusters = C.written(clusters.select("component", "keeper"), "op10-keepers")
    hits = hits.join(clusters, "component").select(
        "doc_id", "start", "stop", "keeper", (F.col("doc_id") != F.col("keeper")).alias("removed"))
    kept = extents.select(F.col("keeper").alias("doc_id"), F.col("kstart").alias("start"), F.col("kstop").alias("stop"), "keeper").distinct()
    hits = hits.unionByName(extents.select("doc_id", "start", "stop", "keeper", F.lit(True).alias("removed"))).unionByName(
        kept.withColumn("removed", F.lit(False))).unionByName(repeated)

    merged = _islands(hits, ["doc_id", "removed"], F.lit(False)).groupBy("doc_id", "removed", "_island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sort_array(F.collect_set("keeper")).alias("keepers"))
    return merged.select("doc_id", "start", "stop", "removed", "keepers")


def cleaned(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (all its columns) without the removed spans; what is left of a
    text is joined as it stands, and n_chars, if there, is its new length."""
    cuts = C.written(
        spans.filter("removed").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_removed_spans")), "op10-cuts")
    names = docs.columns
    at = names.index("text")
    some, rest = C.prefilter(docs, "doc_id", cuts.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if text is not None and cut:
                    ends = [0, *[x["stop"] for x in cut]]
                    text = "".join(text[a:b] for a, b in zip(ends, [*[x["start"] for x in cut], len(text)]))
                texts.append(text)
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    done = some.join(cuts, "doc_id", "left").select(*names, "_removed_spans").mapInArrow(run, T.StructType(docs.schema.fields))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*names).unionByName(rest.select(*names))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(C.table(spark, sf_dir, "documents"))


# no SQL for the anchors: tested against planted passages and brute force
QUERIES = {"op10_substring_dedup": (op10_substring_dedup, None)}
