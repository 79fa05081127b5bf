"""N-gram Jaccard join with a MinHash LSH forest.

A document's set is its distinct five-word shingles (fewer than five words:
the whole word sequence is its one shingle; no word: no set, no link).

*Forest.*  Each of ``TREES`` sorted prefix tries labels a document with
``DEPTH`` min-hashes.  A pair of similarity s shares a prefix of length d in
some trie with probability 1 - (1 - s^d)^trees; prefixes are shortened from
full depth until that reaches the target recall at the threshold.  All
documents under one node of that depth lie together when the rows are grouped
by the shortened prefix, so one shuffle serves all lengths: inside a node, rows
are sorted by the full label, pairs with longer common prefixes come first, and
a pair is left to the first trie that has it.

*Nodes.*  A node's members are compared by their whole signatures in cells of
two blocks (``blocks.py``), and answer with one row per member, its smallest
partner of estimated similarity >= ``GATE`` (at the threshold an estimate below
it is over five standard deviations off).  Components of these are candidate
families.

*Verification.*  The families' documents are read again; within a family every
pair's exact Jaccard similarity is computed from the shingle sets, again in
cells, as products of incidence matrices.  No pair is ever a row.

Exact copies are one class (same text), represented by the smallest id and
counted with its weight, so copies are never expanded into pairs.

Result, one row per input row: id, class_id (smallest id of that text),
class_size, n_links (other documents of similarity >= threshold, copies
included), component_id (smallest id reachable over links), kept (id is
component_id).  Edge cases: a text without words (null, empty, white space)
has class_size 1, no links, and is kept; a null id is treated the same way,
with null class and component; repeated ids of one text are one document, and
repeated ids of different texts are joined in one class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import blocks as B
from ferrule.llm import common as C
from ferrule.llm.components import components

K, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH, GATE, SEED = 14, 5, 0.5, 1
NODE_BLOCK, FAMILY_BLOCK = 512, 192


def shortened(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Longest prefix that reaches the recall at the threshold, coming from
    the full depth."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def signatures(sh: np.ndarray, first: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Min-hashes (rows x functions, 32 bits); rows without shingles get 0."""
    n = len(first) - 1
    out = np.zeros((n, len(mult)), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        at = first[full]
        step = 1 << 16
        # shingles in pieces that stay in cache; a row may span pieces
        low = np.full((len(full), len(mult)), np.iinfo(np.uint64).max, np.uint64)
        for s in range(0, len(sh), step):
            part = sh[s : s + step]
            a = int(np.searchsorted(at, s, "right")) - 1
            b = int(np.searchsorted(at, s + len(part), "left"))
            cut = np.maximum(at[a:b] - s, 0)
            for k, m in enumerate(mult):
                low[a:b, k] = np.minimum(low[a:b, k], np.minimum.reduceat(part * m, cut))
        out[full] = (low >> np.uint64(32)).astype(np.uint32)
    return out


def signed(df: DataFrame, trees: int, depth: int, seed: int) -> DataFrame:
    """(id, digest of the text, signature) of every document that has words."""
    mult = C.seeds(trees * depth, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in C.chunks(batch.column(1)):
                starts, stops, first = c.spans()
                sh, cut = C.shingles(C.Prefix(c.data).slices(starts, stops), first, K)
                sig = signatures(sh, cut, mult)
                keep = np.flatnonzero(np.diff(cut))
                raw, off = c.data.tobytes(), c.offsets.tolist()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(c.rows[keep])),
                    pa.array([hashlib.blake2b(raw[off[k] : off[k + 1]], digest_size=16).digest() for k in keep.tolist()], pa.binary()),
                    pa.array([s.tobytes() for s in sig[keep]], pa.binary()),
                ], names=["id", "digest", "sig"])

    return df.mapInArrow(run, "id long, digest binary, sig binary")


def _nodes(reps: DataFrame, trees: int, depth: int, short: int) -> DataFrame:
    """(id, tree, node): the trie nodes of every class at the shortened depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(batch), trees, depth)
            node = C.mix64((sig[:, :, :short].astype(np.uint64) * C.seeds(short, 9)).sum(axis=2, dtype=np.uint64) + salt)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column(0).to_numpy(), trees)),
                pa.array(np.tile(np.arange(trees, dtype=np.int32), len(batch))),
                pa.array(node.view(np.int64).ravel()),
            ], names=["id", "tree", "node"])

    return reps.mapInArrow(run, "id long, tree int, node long")


def _families(reps: DataFrame, trees: int, depth: int, short: int, gate: float) -> DataFrame:
    """Edges (a, b) whose components are the candidate families."""
    need = math.ceil(gate * trees * depth)
    nodes = C.written(_nodes(reps.select("id", "sig"), trees, depth, short), "op1-nodes")
    full = nodes.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    dealt = B.cells(nodes, ["tree", "node"], F.col("id"), NODE_BLOCK, full).join(reps.select("id", "sig"), "id")

    def compare(t: pa.Table) -> pa.Table:
        tree = t.column("tree")[0].as_py()
        ids, mine = t.column("id").to_numpy(), t.column("mine").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
        label = sig.reshape(len(ids), trees, depth)
        # sorted by the trie's full label: longer common prefixes are neighbours
        order = np.lexsort((ids, *label[:, tree, ::-1].T))
        ids, mine, sig, label = ids[order], mine[order], sig[order], label[order]
        lo, hi = mine.min(), mine.max()
        pairs_a, pairs_b = [], []
        for i in range(len(ids)):
            if lo != hi and mine[i] != lo:
                continue
            j = np.flatnonzero(mine == hi) if lo != hi else np.arange(i + 1, len(ids))
            if not len(j):
                continue
            # a pair met in an earlier trie was compared there
            met = (label[j, :tree, :short] == label[i, :tree, :short]).all(axis=2).any(axis=1) if tree else np.zeros(len(j), bool)
            j = j[~met]
            j = j[(sig[j] == sig[i]).sum(axis=1) >= need]
            pairs_a.append(np.full(len(j), i))
            pairs_b.append(j)
        if not pairs_a:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        root = ids[by_id][B.roots(len(ids), place[a], place[b])][place]
        keep = root != ids
        return pa.table({"a": ids[keep], "b": root[keep]})

    return dealt.groupBy("cell").applyInArrow(compare, "a long, b long")


def intersections(sh: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the common sets, rows ``a`` x rows ``b``; each row of ``sh`` is
    a set.  Only shingles of two rows at least can count."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, col, n = np.unique(sh, return_inverse=True, return_counts=True)
    keep = n[col] > 1
    row, col = row[keep], np.unique(col[keep], return_inverse=True)[1]
    out = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for s in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        x, y = np.searchsorted(col, [s, s + width])
        grid = np.zeros((len(first) - 1, width), np.float32)
        grid[row[x:y], col[x:y] - s] = 1
        out += grid[a] @ grid[b].T
    return out


def shingle_sets(df: DataFrame, keep: str = "") -> DataFrame:
    """(id, <keep>, shingles): the distinct shingle hashes of whole texts as
    packed 64-bit integers; input columns: id, text, <keep> (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in C.chunks(batch.column(1)):
                starts, stops, first = c.spans()
                sh, cut = C.shingles(C.Prefix(c.data).slices(starts, stops), first, K)
                lo, n = int(c.rows[0]), len(c)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, n), batch.column(2).slice(lo, n),
                    pa.array([np.unique(sh[x:y]).tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()),
                ], names=["id", keep, "shingles"])

    return df.select("id", "text", keep).mapInArrow(run, f"id long, {keep} long, shingles binary")


def _verified(sets: DataFrame, weights: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root) per class and cell, from the exact sets of families."""
    dealt = B.cells(sets.join(weights, "id"), ["family"], F.col("id"), FAMILY_BLOCK, sizes)

    def compare(t: pa.Table) -> pa.Table:
        ids, mine, weight = (t.column(x).to_numpy() for x in ("id", "mine", "weight"))
        order = np.argsort(ids, kind="stable")
        ids, mine, weight = ids[order], mine[order], weight[order]
        raw = t.column("shingles").to_pylist()
        rows = [np.frombuffer(raw[k], np.uint64) for k in order.tolist()]
        size = np.array([len(r) for r in rows])
        first = np.concatenate([[0], np.cumsum(size)])
        own = np.arange(len(ids))
        lo, hi = mine.min(), mine.max()
        a, b = (own, own) if lo == hi else (own[mine == lo], own[mine == hi])
        both = intersections(np.concatenate(rows), first, a, b)
        union = size[a][:, None] + size[b][None, :] - both
        # exact in integers: 5 * both >= 4 * union for 0.8
        i, j = np.nonzero(both >= threshold * union - 1e-6)
        i, j = a[i], b[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        root = ids[B.roots(len(ids), i, j)]
        keep = links > 0
        return pa.table({"id": ids[keep], "links": links[keep], "root": root[keep]})

    return dealt.groupBy("cell").applyInArrow(compare, "id long, links long, root long")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, gate: float = GATE, seed: int = SEED) -> DataFrame:
    """See the module's text for the columns."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = C.written(signed(docs.filter("id is not null"), trees, depth, seed), "op1-signatures")
    classes = C.written(
        sig.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("sig").alias("sig")), "op1-classes")
    reps = classes.select("id", "sig")
    classes = classes.drop("sig")
    short = shortened(trees, depth, threshold, recall)
    family = C.written(components(_families(reps, trees, depth, short, gate)), "op1-families")
    members = family.select("id", F.col("component").alias("family")).union(
        family.select(F.col("component").alias("id"), F.col("component").alias("family")).distinct())
    maybe, _ = C.prefilter(docs, "id", members.select("id"))
    texts = maybe.hint("merge").join(members, "id")  # one plan at every size
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("_m"))
    found = C.written(_verified(shingle_sets(texts, "family"), classes.select("id", "weight"), sizes, threshold), "op1-links")
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = classes.join(links, "id", "left").join(comp, "id", "left").select(
        "digest", F.col("id").alias("class_id"), F.col("weight").alias("class_size"),
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    worded = sig.select("id", "digest").join(classes, "digest").drop("digest")
    bare = docs.filter(F.col("id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(
        "id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return worded.unionByName(bare).select(
        F.col("id").alias(id_col), "class_id", "class_size", "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(C.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, md5(text) AS digest, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), cls AS (
  SELECT digest, min(doc_id) AS id, count(*) AS n, any_value(w) AS w FROM w WHERE len(w) > 0 GROUP BY digest
), sh AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM cls
), size AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
pairs AS (
  SELECT a, b FROM common JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT id, id FROM cls UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT p.a AS id, sum(c.n) AS n FROM pairs p JOIN cls c ON c.id = p.b GROUP BY p.a)
SELECT w.doc_id, coalesce(c.id, w.doc_id) AS class_id, coalesce(c.n, 1)::BIGINT AS class_size,
  coalesce(c.n - 1 + coalesce(l.n, 0), 0)::BIGINT AS n_links, coalesce(k.component_id, w.doc_id) AS component_id,
  w.doc_id = coalesce(k.component_id, w.doc_id) AS kept
FROM w LEFT JOIN cls c ON c.digest = w.digest LEFT JOIN comp k ON k.id = c.id LEFT JOIN links l ON l.id = c.id
"""

QUERIES = {"op1_ngram_jaccard_join": (op1_ngram_jaccard_join, SQL)}
