"""Exact dedup by a tree-merge of sorted digest runs.

Two texts are equal when they are identical after replacing every run of
``[\\x20\\x09-\\x0D]`` by one space.  A text's *key* is the SHA-256 of that
normalised text followed by an independent 64-bit BLAKE2b of it: rows are held
equal where both agree, at every level, so a collision of one digest alone
would not join two texts.

*Runs.*  One pass over the texts writes (leaf, id, key); a *leaf* is at most
``RUN_ROWS`` rows of one input partition.  A leaf sorted by key, with equal keys
folded to (smallest id, rows), is a run: a group holding a third of all rows is
one entry a leaf from there on.

*Merging.*  Runs are merged in binomial rounds.  In round r every partition
exchanges with the ``FAN`` - 1 partners whose number differs from its own in
digit r (base ``FAN``): it keeps the keys whose digit r equals its own and sends
each partner the keys of that partner's digit.  What comes in are sorted runs;
their blocks arrive in the order of their first keys, are merged, and equal
keys are folded to the smallest id again.  After the last round a partition
holds one range of keys for the whole table, however the rows lay, and no task
ever held more than its share of distinct keys.

*Answer.*  Keys of more than one row go back to the leaves that hold them, and
from there to the rows by (leaf, key): at most ``RUN_ROWS`` rows meet one key.

Edge cases: a null text is an empty one; texts of white space only are equal
to each other (one space) and not to empty ones.  A null id is never the
smallest unless its group has no other (then ``keep_id`` is null); such rows are
kept only there.  Repeated rows count one each; those of the smallest id are all
kept.  Very long texts are hashed whole, one at a time.  Other columns, whatever
their names, play no part; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import common as C

FAN = 8
RUN_ROWS = 1 << 16
SHARE_ROWS = 1 << 20
BLOCK = 1024
KEY_BYTES, DIGEST_BYTES = 40, 32
NO_ID = np.iinfo(np.int64).max
KEY = f"S{KEY_BYTES}"
RUN_SCHEMA = "target int, head binary, keys binary, ids binary, named binary, counts binary"
GROUP_SCHEMA = "key binary, keep_id long, group_size long"


def squeezed(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with every run of white space as one space."""
    space = C.WS[chunk.data]
    before = np.zeros(len(space), bool)
    before[1:] = space[:-1]
    starts = chunk.offsets[:-1]
    before[starts[starts < len(space)]] = False
    stay = ~(space & before)
    data = np.where(space, np.uint8(0x20), chunk.data)[stay]
    return data, np.concatenate([[0], np.cumsum(stay)])[chunk.offsets]


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """(leaf, id, key) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        seen = 0
        for batch in batches:
            for chunk in C.chunks(batch.column(1)):
                data, offsets = squeezed(chunk)
                spans = zip(offsets[:-1].tolist(), offsets[1:].tolist())
                texts = (data[a:b] for a, b in spans)
                keys = [hashlib.sha256(t).digest() + hashlib.blake2b(t, digest_size=8).digest() for t in texts]
                leaf = part + (seen + np.arange(len(chunk))) // run_rows
                seen += len(chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf, pa.int64()), batch.column(0).slice(int(chunk.rows[0]), len(chunk)), pa.array(keys, pa.binary())],
                    names=["leaf", "id", "key"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "leaf long, id long, key binary")


class Run:
    """Distinct keys in ascending order with, for each, the smallest id, the
    rows that have an id, and all rows."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, named: np.ndarray, counts: np.ndarray):
        self.keys, self.ids, self.named, self.counts = keys, ids, named, counts

    def __len__(self) -> int:
        return len(self.keys)

    def cut(self, a: int, b: int) -> Run:
        return Run(self.keys[a:b], self.ids[a:b], self.named[a:b], self.counts[a:b])


def fold(runs: list[Run]) -> Run:
    """The runs merged into one; equal keys become one with the smallest id."""
    keys = np.concatenate([r.keys for r in runs])
    order = np.argsort(keys, kind="stable")  # merges runs that are sorted already
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return Run(keys, *(np.zeros(0, np.int64) for _ in range(3)))
    ids, named, counts = (np.concatenate([getattr(r, c) for r in runs])[order] for c in ("ids", "named", "counts"))
    return Run(keys[first], np.minimum.reduceat(ids, first), np.add.reduceat(named, first), np.add.reduceat(counts, first))


def digit(keys: np.ndarray, r: int, fan: int = FAN) -> np.ndarray:
    """Digit ``r`` (base ``fan``, a power of two; from the top bits) of every key."""
    head = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, KEY_BYTES)[:, :8].copy().view(">u8").ravel()
    bits = fan.bit_length() - 1
    return (head >> np.uint64(64 - bits * (r + 1))) & np.uint64(fan - 1)


def sent(run: Run, place: int, r: int, fan: int = FAN) -> pa.RecordBatch:
    """Blocks of ``run`` for the partners of partition ``place`` in round ``r``."""
    own = place // fan**r % fan
    digits = digit(run.keys, r, fan)
    rows = []
    for d in range(fan):
        a, b = np.searchsorted(digits, [d, d + 1])
        for at in range(int(a), int(b), BLOCK):
            part = run.cut(at, min(at + BLOCK, int(b)))
            rows.append((place + (d - own) * fan**r, part.keys[:1].tobytes(), *(
                np.ascontiguousarray(x).tobytes() for x in (part.keys, part.ids, part.named, part.counts))))
    columns = list(zip(*rows)) or [[]] * 6
    types = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                      names=["target", "head", "keys", "ids", "named", "counts"])


def first_runs(rows: DataFrame, width: int, fan: int = FAN) -> DataFrame:
    """The leaves' runs, sent into round 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Run] = []
        place = None
        for batch in batches:
            leaf = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(leaf)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(leaf)]):
                if a == b:
                    continue
                if place is not None and (leaf[a] != place or sum(map(len, held)) >= RUN_ROWS):
                    yield sent(fold(held), int(place >> 32) % width, 0, fan)
                    held = []
                place = leaf[a]
                ids = batch.column(1).slice(a, b - a)
                keys = np.frombuffer(b"".join(batch.column(2).slice(a, b - a).to_pylist()), KEY)
                named = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
                held.append(Run(keys, ids.fill_null(NO_ID).to_numpy(), named, np.ones(b - a, np.int64)))
        if held:
            yield sent(fold(held), int(place >> 32) % width, 0, fan)

    return rows.select("leaf", "id", "key").mapInArrow(run, RUN_SCHEMA)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Run]]:
    """(partition, piece of its merged run), pieces in ascending order.  Blocks
    come sorted by (target, head), so keys below the next head are final."""
    target, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for goal, head, keys, ids, named, counts in zip(*columns):
            if goal != target:
                if held:
                    yield target, fold(held)
                target, held = goal, []
            elif sum(map(len, held)) >= 16 * BLOCK:
                run = fold(held)
                done = int(np.searchsorted(run.keys, np.frombuffer(head, KEY)[0]))
                if done:
                    yield target, run.cut(0, done)
                held = [run.cut(done, len(run))]
            held.append(Run(np.frombuffer(keys, KEY), *(np.frombuffer(x, np.int64) for x in (ids, named, counts))))
    if held:
        yield target, fold(held)


def groups(rows: DataFrame, n_rows: int, share: int = SHARE_ROWS, fan: int = FAN) -> DataFrame:
    """(key, keep_id, group_size) of the keys that more than one row has.
    ``share``: distinct keys for which one partition is meant."""
    rounds = 2
    while fan**rounds * share < n_rows:
        rounds += 1
    width = fan**rounds

    def step(r: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for place, piece in merged(batches):
                yield sent(piece, place, r, fan)

        return run

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, piece in merged(batches):
            many = np.flatnonzero(piece.counts > 1)
            raw = piece.keys[many].tobytes()
            keys = [raw[k : k + KEY_BYTES] for k in range(0, len(raw), KEY_BYTES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(piece.ids[many], pa.int64(), mask=piece.named[many] == 0),
                 pa.array(piece.counts[many], pa.int64())], names=["key", "keep_id", "group_size"])

    runs = first_runs(rows, width, fan)
    for r in range(1, rounds + 1):
        runs = runs.repartitionById(width, F.col("target")).sortWithinPartitions("target", "head")
        runs = runs.mapInArrow(last, GROUP_SCHEMA) if r == rounds else runs.mapInArrow(step(r), RUN_SCHEMA)
    return runs


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE_ROWS,
               fan: int = FAN, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per row of ``df``: the id, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256``."""
    rows = C.written(keyed(df, id_col, text_col, run_rows), "op12-keys")
    many = C.written(groups(rows, rows.count(), share, fan), "op12-groups")
    # back to the leaves that hold a key, then to their rows
    held = rows.select("key", "leaf").distinct().join(many, "key")
    found = rows.join(held, ["key", "leaf"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, DIGEST_BYTES))).alias("text_sha256"),
    )


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    stay = duplicates(df, id_col, text_col).filter("kept").select(F.col(id_col).alias("_stay"), F.col("text_sha256").alias("_sha"))
    return df.join(stay.distinct(), F.col("_stay").eqNullSafe(df[id_col]) & (F.col("_sha") == digest), "left_semi")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(C.table(spark, sf_dir, "documents"))


SQL = r"""WITH n AS (
SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""

QUERIES = {"op12_exact_dedup": (op12_exact_dedup, SQL)}
