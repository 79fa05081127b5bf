"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised in double precision, so cosine >= t is a distance of at
most sqrt(2 - 2t).  A table hashes a vector to ``k`` quantised random
projections floor((a.v + b) / w), b uniform in [0, w); ``k`` grows with the
logarithm of the number of distinct vectors, so the expected bucket stays the
same, and the number of tables follows from the collision probability at the
threshold and the recall wanted.  Vectors that share a bucket are compared
exactly, by cosine in double precision, in cells of two blocks (``blocks.py``).
A pair counts in the first table where its keys agree only; a cell returns its
members' link counts and smallest linked members, and components come from
those.

Equal vectors are one *class*, hashed and compared once and counted with its
weight, so a vector repeated in a third of all rows is one row.  A group of
vectors that all differ and all lie within the threshold needs all its
comparisons, since each member's links are counted; they are dealt over cells.

Edge cases: null, empty or zero vectors and those with null or non-finite
components link with nothing (0 links, their own component, kept).  Vectors of
different length are not compared.  Repeated ids: one row each, with the links
of their vectors; a row of null id links with nothing (0 links, null component,
kept).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import blocks as B
from ferrule.llm import common as C
from ferrule.llm.components import with_components

THRESHOLD, RECALL, WIDTH, BUCKET, SEED = 0.9, 0.999, 2.5, 100, 4
BLOCK = 512


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection agrees at this distance."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, bucket: int = BUCKET) -> tuple[int, int]:
    """(projections per table, tables) for ``n`` vectors: unrelated (orthogonal)
    vectors share a bucket with about ``bucket`` others, and a pair at the
    threshold shares one in some table with probability ``recall``."""
    far = collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(n, 2) / bucket) / -math.log(far)))
    near = collision(math.sqrt(2 - 2 * threshold), width) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near))


def usable(vector: str) -> F.Column:
    """Whether the vector takes part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix (all of the same length)."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow in the norm
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _keys(unit: np.ndarray, k: int, tables: int, seed: int, width: float) -> np.ndarray:
    """Keys (rows x tables) of normalised vectors."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    a = rng.standard_normal((unit.shape[1], k * tables))
    b = rng.uniform(0, width, k * tables)
    q = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    return C.mix64((q * C.seeds(k, 5)).sum(axis=2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _equal_lengths(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.list_value_length(batch.column(col)).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield batch if len(at) == len(sizes) else batch.take(pa.array(at))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL, width: float = WIDTH, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(usable(vector_col) & F.col(id_col).isNotNull(), F.transform(vector_col, lambda x: x.cast("double"))).alias("v"),
    )
    # classes of equal vectors: a digest of the components is the key
    keyed = C.written(
        rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))), "op4-rows"
    )
    sizes = keyed.filter("key is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    # one row of each class (rows of equal id and vector are one row here too)
    reps = C.written(
        keyed.filter("key is not null").join(sizes, "key").filter(F.col("id") == F.col("rep"))
        .select("key", "rep", "weight", "v")
        .groupBy("key").agg(F.first("rep").alias("rep"), F.first("weight").alias("weight"), F.first("v").alias("v")),
        "op4-classes",
    )
    n = reps.count()
    k, tables = plan(n, threshold, recall, width, bucket)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _equal_lengths(batch, 2):
                keys = _keys(_unit(_matrix(part.column(2))), k, tables, seed, width).view(np.int64)
                dim = np.int64(len(part.column(2)[0]))
                flat = pa.array((keys ^ dim).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * tables, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["rep", "weight", "v", "keys"])

    signed = C.written(
        reps.select("rep", "weight", "v").mapInArrow(hashed, "rep long, weight long, v array<double>, keys array<bigint>"),
        "op4-keys",
    )
    spread = signed.select("rep", F.posexplode("keys").alias("t", "bucket"))
    # only buckets with company are compared; partial counts meet, not rows
    full = spread.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    dealt = B.cells(spread, ["t", "bucket"], F.col("rep"), BLOCK, full)
    dealt = dealt.join(signed, "rep").select("cell", "t", "mine", "other", "rep", "weight", "v", "keys")

    def compare(table: pa.Table) -> pa.Table:
        t = table.column("t")[0].as_py()
        mine = table.column("mine").to_numpy()
        other = table.column("other").to_numpy()
        rep = table.column("rep").to_numpy()
        weight = table.column("weight").to_numpy()
        unit = _unit(_matrix(table.column("v").combine_chunks()))
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        own = np.arange(len(rep))
        lo, hi = min(mine[0], other[0]), max(mine[0], other[0])
        a, b = (own[mine == lo], own[mine == hi]) if lo != hi else (own, own)
        left, right = [], []
        for s in range(0, len(a), 256):
            i, j = np.nonzero(unit[a[s : s + 256]] @ unit[b].T >= threshold - 1e-9)
            i, j = a[s : s + 256][i], b[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            # exact, in double precision; then the first table in common only
            dot = np.einsum("ij,ij->i", unit[i], unit[j])
            ok = dot >= threshold
            i, j = i[ok], j[ok]
            ok = np.argmax(keys[i] == keys[j], axis=1) == t
            left.append(i[ok])
            right.append(j[ok])
        left, right = np.concatenate(left or [own[:0]]), np.concatenate(right or [own[:0]])
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, left, weight[right])
        np.add.at(links, right, weight[left])
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = own
        root = rep[order][B.roots(len(rep), place[left], place[right])][place]
        keep = links > 0
        return pa.table({"rep": rep[keep], "links": links[keep], "root": root[keep]})

    found = C.written(dealt.groupBy("cell").applyInArrow(compare, "rep long, links long, root long"), "op4-links")
    classes = reps.select("key", "rep", "weight").join(
        found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
    classes = with_components(classes, found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "rep")
    return keyed.select("id", "key").join(classes, "key", "left").select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a) n USING (vec_id)
"""

QUERIES = {"op4_embedding_near_dedup": (op4_embedding_near_dedup, SQL)}
