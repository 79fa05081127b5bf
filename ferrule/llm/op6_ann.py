"""Nearest vectors by inner product, with randomly rotated one-bit codes.

Every vector is centred on the mean of the candidates, normalised and rotated
by a random orthogonal matrix; its code is the signs of the result, one bit a
component, packed.  With the code go the vector's distance to the centre, its
inner product with the centre, and the cosine between it and its code.  Sign
bits and those scalars give an unbiased estimate of any inner product and a
bound that its error keeps with a probability set by ``epsilon`` (a number of
standard deviations).

Queries meet candidates in cells (block of queries x block of candidates); a
candidate is in one cell per block of queries.  In a cell, a query estimates
all candidates from the packed bits, measures the best by estimate to get a
k-th best score, and then measures every candidate whose bound reaches it.
Scores are exact: the inner product of the original vectors, in double
precision, summed in component order.  Each cell answers with k rows a query,
cut to the k best over all cells at the end.

Rows with equal vectors have equal scores; ties go to the smaller id.  Edge
cases: null, empty or zero vectors and those with null or non-finite
components take no part, neither as query nor as candidate; vectors of another
length than the query's are no candidates; rows of one id are one another's
"own row" and never paired; null ids take no part; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm import common as C
from ferrule.llm.op4_embedding_dedup import _matrix, usable

K, EPSILON, SEED = 20, 4.0, 6
QUERY_BLOCK, ROW_BLOCK = 2048, 16384
ROWS_PER_STEP = 64


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    """Codes and correction scalars of the rows of ``vectors``."""
    rest = vectors - centre
    norm = np.sqrt((rest * rest).sum(axis=1))
    turned = rest @ rotation(vectors.shape[1], seed)
    bits = turned > 0
    # cosine between a vector and its code: sum of magnitudes / (norm sqrt d)
    fit = np.abs(turned).sum(axis=1) / np.where(norm > 0, norm, 1) / np.sqrt(vectors.shape[1])
    return {"code": np.packbits(bits, axis=1), "norm": norm, "fit": np.where(norm > 0, fit, 1.0), "base": vectors @ centre}


def estimates(query: np.ndarray, codes: dict[str, np.ndarray], centre: np.ndarray, epsilon: float, seed: int = SEED):
    """(estimated inner products, error bounds), queries x candidates.

    <q, x> = <q, c> + norm * <q, u>, u the unit residual; <q, u> is estimated
    by <q, code> / fit."""
    dim = query.shape[1]
    signs = (np.unpackbits(codes["code"], axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    turned = (query @ rotation(dim, seed)).astype(np.float32)
    scale = (codes["norm"] / codes["fit"]).astype(np.float32)
    guess = (turned @ signs.T) * scale + (query @ centre).astype(np.float32)[:, None]
    lost = np.sqrt(np.maximum(0, 1 - codes["fit"] ** 2)) / codes["fit"] / np.sqrt(max(1, dim - 1))
    size = np.sqrt((query * query).sum(axis=1))
    bound = (epsilon * size)[:, None].astype(np.float32) * (codes["norm"] * lost).astype(np.float32)
    # room for single-precision rounding
    bound += np.float32(1e-4) * (np.abs(guess) + (size[:, None] * codes["norm"]).astype(np.float32))
    return guess, bound


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows (``a``: one row, or as many), summed in
    component order."""
    total = np.zeros(len(b))
    for d in range(b.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def search_block(qid, query, rid, rows, codes, centre, k: int, epsilon: float):
    """(query position, row position, score) of the k best rows of each query."""
    out = []
    single = rows.astype(np.float32)
    # room for the rounding of a single-precision inner product
    slack = 1e-5 * float(np.sqrt((rows * rows).sum(axis=1).max(initial=0)))
    for s in range(0, len(query), ROWS_PER_STEP):
        part = query[s : s + ROWS_PER_STEP]
        guess, bound = estimates(part, codes, centre, epsilon)
        own = qid[s : s + ROWS_PER_STEP, None] == rid[None, :]
        guess[own] = -np.inf
        reach = guess + bound
        for i, q in enumerate(part):
            # the best by estimate give a k-th best score to reach
            most = min(k, len(rid) - int(own[i].sum()))
            if not most:
                continue
            first = np.argpartition(-guess[i], most - 1)[:most]
            room = slack * float(np.sqrt(q @ q))
            least = float((rows[first] @ q).min()) - room if most == k else -np.inf
            j = np.flatnonzero((reach[i] >= least) & ~own[i])
            if len(j) > k:
                close = single[j] @ q.astype(np.float32)
                least = np.partition(close, len(j) - k)[len(j) - k]
                j = j[close >= least - 2 * room]
            score = exact(q[None, :], rows[j])
            order = np.lexsort((rid[j], -score))[:k]
            out.append((np.full(len(order), s + i), j[order], score[order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return [np.concatenate(x) for x in zip(*out)]


def nearest(rows: DataFrame, is_query: F.Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows but its own."""
    table = C.written(
        rows.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"),
            F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.size(vector_col).alias("dim")),
        "op6-rows",
    )
    # one row per length: how many rows, and their centre
    sums = table.select("dim", F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(F.avg("x").alias("x"))
    shapes = table.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("int")).alias("nq"))
    centres = sums.groupBy("dim").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))
    shapes = C.written(shapes.join(centres, "dim"), "op6-shapes")
    seed = F.xxhash64("id", F.lit(SEED))
    blocks = {"qb": F.ceil(F.greatest(F.col("nq"), F.lit(1)) / QUERY_BLOCK), "rb": F.ceil(F.col("n") / ROW_BLOCK)}
    # (the table of lengths has one row per vector length; Spark picks the join)
    sized = table.join(shapes.select("dim", *[c.cast("int").alias(x) for x, c in blocks.items()]), "dim")
    pick = lambda n: F.pmod(seed, F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_rows = sized.select("dim", every("qb").alias("q"), pick("rb").alias("r"), "id", F.lit(False).alias("asks"), "v")
    as_queries = sized.filter("is_query").select("dim", pick("qb").alias("q"), every("rb").alias("r"), "id", F.lit(True).alias("asks"), "v")
    dealt = as_rows.union(as_queries).join(shapes.select("dim", "centre"), "dim")

    def cell(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        ids = t.column("id").to_numpy()
        v = _matrix(t.column("v").combine_chunks())
        centre = np.array(t.column("centre")[0].as_py())
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if asks.all() or not asks.any():
            return empty
        query, rows_ = v[asks], v[~asks]
        qid, rid = ids[asks], ids[~asks]
        i, j, score = search_block(qid, query, rid, rows_, encode(rows_, centre), centre, k, epsilon)
        return pa.table({"query_id": qid[i], "vec_id": rid[j], "score": score})

    found = dealt.groupBy("dim", "q", "r").applyInArrow(cell, "query_id long, vec_id long, score double")
    # Spark cuts each task's rows to k a query before it shuffles them
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT vec_id, e FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e) AS score
  FROM ok q JOIN ok r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {"op6_nearest_vectors": (op6_nearest_vectors, SQL)}
