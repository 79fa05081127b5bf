"""Centroid clustering with ns-bounds, in exact integers.

Vectors and centroids are integers, ``floor(1024 x)`` of each component, and
squared distances are exact 64-bit integers; a centroid moves to the
componentwise floor of its members' mean.  The result is that of plain rounds
of assignment and update; bounds only spare distances.

*Bounds.*  The centroids of all rounds are kept (the *history*: rounds x k
vectors, a fixed size).  For every vector and every centroid number j the state
holds the last distance evaluated exactly, and the round T of that evaluation.
In round t that distance can have changed by no more than the centroid's
displacement since T, ``|c_j(t) - c_j(T)|``, the norm of the total
movement; it is never summed over the rounds between, so a centroid that
wanders and returns leaves its bounds tight.  A vector whose own centroid's upper
bound lies strictly below all others' lower bounds stays where it is.  For the
others the own distance is evaluated exactly, and then each centroid whose lower
bound doesn't exceed it; among equals the smaller number wins.  Bounds are
rounded outwards, and ties fail them, so every rescan that could matter is made.

*Rounds.*  State is one row per vector: vector, squared distances and rounds of
evaluation, packed as binaries.  A round is one pass without a shuffle: tasks
read the state, rescan, and give the new state and, per task and cluster, the
*change* of its members' sum and number (k rows a task, however large a
cluster is); the driver sees k sums.  The state of a round is written to the
shared folder and read by the next, so a lost executor costs its tasks of one
round; the state before it is deleted once the next is written.

Edge cases: only vectors with exactly ``dim`` components take part, none null or
not finite; of these, vectors with a component beyond ``LIMIT`` / 1024 in absolute
value are left out as well, as their squared distances have no place in 64 bits
(embeddings are far below).  Rows of a null id are vectors like others but no
first centroid; repeated rows count one each, and rows of the same id and vector
can both be first centroids.  With fewer than k kept vectors there are as many
centroids as vectors with an id; without any, and for an empty table, there is no
row.  Sums of distances beyond 64 bits are null.  Other columns, whatever their
names, play no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import common as C
from ferrule.session import scratch_path

K, ROUNDS, DIM, SEED, SCALE = 8, 10, 64, 3, 1024
LIMIT = 1 << 27
SLACK = 1e-9  # bounds are doubles: rounded outwards by this share
STATE_SCHEMA = "vec_id long, vec binary, d2 binary, seen binary, cluster int, moved int, total binary, scans long"


def grid(vector: Column, dim: int = DIM) -> Column:
    """The integer components (array<double>); null where the vector takes no part."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) <= LIMIT) & ~F.isnan(v))
    return F.when((F.size(vector) == dim) & F.coalesce(sound, F.lit(False)), x)


def packed(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(vec_id, vec): the kept vectors as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row.tobytes() for row in flat], pa.binary())], names=["vec_id", "vec"])

    plain = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("raw"))
    # a range check in doubles first: floor of a larger one has no long
    plain = plain.filter(F.coalesce(F.forall("raw", lambda v: F.abs(v.cast("double")) <= LIMIT / SCALE), F.lit(False)))
    return plain.select("vec_id", grid(F.col("raw"), dim).alias("x")).filter("x is not null").mapInArrow(run, "vec_id long, vec binary")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id is not null").orderBy(h, "vec").limit(k).select("vec").collect()  # k rows
    return np.array([np.frombuffer(r["vec"], "<i4") for r in rows], np.int64)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    diff = vectors - centroid
    return np.einsum("ij,ij->i", diff, diff)


class Round:
    """One assignment: the centroids of all rounds up to now, the newest last."""

    def __init__(self, history: np.ndarray):
        self.history = history
        self.now = len(history) - 1
        gap = (history - history[-1]).astype(float)
        # [T, j]: norm of the total displacement of centroid j since round T
        self.drift = np.sqrt(np.einsum("tjd,tjd->tj", gap, gap)) * (1 + SLACK)

    def start(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(squared distances, their rounds, cluster, number of distances)."""
        d2 = np.stack([squared(vectors, c) for c in self.history[-1]], axis=1)
        return d2, np.full(d2.shape, self.now, np.int16), d2.argmin(axis=1), d2.size

    def assign(self, vectors: np.ndarray, d2: np.ndarray, seen: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, int]:
        """The new clusters, and the number of distances evaluated; ``d2`` and
        ``seen`` are brought up to date in place."""
        k = d2.shape[1]
        at = np.arange(len(vectors))
        since = self.drift[seen, np.arange(k)]
        dist = np.sqrt(d2.astype(float))
        low = dist * (1 - SLACK) - since
        high = dist[at, cluster] * (1 + SLACK) + since[at, cluster]
        low[at, cluster] = np.inf
        scans = 0
        new = cluster.copy()
        open_rows = np.flatnonzero(low.min(axis=1, initial=np.inf) <= high)
        # the own distance first
        for j in range(k):
            rows = open_rows[(cluster[open_rows] == j) & (seen[open_rows, j] != self.now)]
            d2[rows, j] = squared(vectors[rows], self.history[-1, j])
            seen[rows, j] = self.now
            scans += len(rows)
        best = d2[open_rows, cluster[open_rows]]
        high = np.sqrt(best.astype(float)) * (1 + SLACK)
        rivals = low[open_rows] <= high[:, None]
        for j in range(k):
            mine = np.flatnonzero(rivals[:, j])
            rows = open_rows[mine]
            stale = seen[rows, j] != self.now
            d2[rows[stale], j] = squared(vectors[rows[stale]], self.history[-1, j])
            seen[rows[stale], j] = self.now
            scans += int(stale.sum())
            d = d2[rows, j]
            better = (d < best[mine]) | ((d == best[mine]) & (j < new[rows]))
            best[mine[better]] = d[better]
            new[rows[better]] = j
        return new, scans

    def settle(self, vectors: np.ndarray, d2: np.ndarray, seen: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Exact squared distance of every vector to its own centroid."""
        for j in range(d2.shape[1]):
            rows = np.flatnonzero((cluster == j) & (seen[:, j] != self.now))
            d2[rows, j] = squared(vectors[rows], self.history[-1, j])
            seen[rows, j] = self.now
        return d2[np.arange(len(vectors)), cluster]


class Change:
    """Change of each cluster's member sum and number, summed over a task."""

    def __init__(self, k: int, dim: int):
        self.total = np.zeros((k, dim + 1), np.int64)

    def add(self, vectors: np.ndarray, cluster: np.ndarray, sign: int) -> None:
        for j in range(len(self.total)):
            part = vectors[cluster == j]
            self.total[j, :-1] += sign * part.sum(axis=0)
            self.total[j, -1] += sign * len(part)


def _rows(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _binaries(x: np.ndarray) -> pa.Array:
    raw, step = x.tobytes(), x.itemsize * x.shape[1]
    return pa.array([raw[a : a + step] for a in range(0, len(raw), step)], pa.binary())


def assigned(state: DataFrame, history: np.ndarray, last: bool = False) -> DataFrame:
    """The state after this round's assignment, and k rows a task (vec null,
    ``cluster``: number, ``total``: change of its sum and number).  The first
    round takes (vec_id, vec); the ``last`` one has exact own distances."""
    k, dim = history.shape[1:]
    begun = "d2" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Round(history)
        change = Change(k, dim)
        scans = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = _rows(batch.column(1), "<i4", dim).astype(np.int64)
            if begun:
                d2, seen = _rows(batch.column(2), "<i8", k).copy(), _rows(batch.column(3), np.int16, k).copy()
                old = batch.column(4).to_numpy()
                new, done = work.assign(vectors, d2, seen, old)
                moved = np.flatnonzero(new != old)
                change.add(vectors[moved], old[moved], -1)
                change.add(vectors[moved], new[moved], 1)
            else:
                d2, seen, new, done = work.start(vectors)
                moved = np.arange(n)
                change.add(vectors, new, 1)
            scans += done
            if last:
                work.settle(vectors, d2, seen, new)
            went = np.zeros(n, np.int32)
            went[moved] = 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _binaries(d2), _binaries(seen), pa.array(new.astype(np.int32)), pa.array(went),
                 pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=STATE_NAMES)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
             pa.array(np.arange(k, dtype=np.int32)), pa.nulls(k, pa.int32()), _binaries(change.total),
             pa.array([scans] + [0] * (k - 1), pa.int64())], names=STATE_NAMES)

    return state.mapInArrow(run, STATE_SCHEMA)


STATE_NAMES = [c.split()[0] for c in STATE_SCHEMA.split(", ")]


def _changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, int]:
    """Sum of the tasks' changes per cluster (k rows), and of their scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = _rows(batch.column(1), "<i8", dim + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(total), pa.list_(pa.int64())), batch.column(2)], names=["cluster", "total", "scans"])

    wide = state.filter("vec is null").select("cluster", "total", "scans").mapInArrow(run, "cluster int, total array<long>, scans long")
    rows = wide.groupBy("cluster").agg(
        F.array(*[F.sum(F.col("total")[i]) for i in range(dim + 1)]).alias("total"), F.sum("scans").alias("scans")).collect()
    out = np.zeros((k, dim + 1), np.int64)
    for r in rows:
        out[r["cluster"]] = r["total"]
    return out, sum(r["scans"] for r in rows)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clusters(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
             dim: int = DIM, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) of every kept vector, the final centroids,
    and the number of distances evaluated in each assignment."""
    spark = df.sparkSession
    base = scratch_path(spark, f"op11-{uuid.uuid4().hex}")
    vectors = C.written(packed(df, id_col, vec_col, dim), "op11-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long"), centroids, []
    k = len(centroids)
    history = centroids[None]
    sums = np.zeros((k, dim + 1), np.int64)
    state, path, scans = vectors, None, []
    for t in range(rounds + 1):
        before, path = path, f"{base}/round-{t}"
        assigned(state, history, last=t == rounds).write.parquet(path)
        state = spark.read.schema(STATE_SCHEMA).parquet(path)
        if before:
            _drop(spark, before)  # its successor is written
        change, done = _changes(state, k, dim)
        scans.append(done)
        state = state.filter("vec is not null")
        if t < rounds:
            sums = sums + change
            members = np.maximum(sums[:, -1:], 1)
            moved = np.where(sums[:, -1:] > 0, np.floor_divide(sums[:, :-1], members), history[-1])
            history = np.concatenate([history, moved[None]])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column(1).to_numpy()
            d2 = _rows(batch.column(2), "<i8", k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(d2[np.arange(len(d2)), cluster], pa.int64())],
                names=[id_col, "cluster", "distance"])

    out = state.select("vec_id", "cluster", "d2").mapInArrow(own, f"{id_col} long, cluster int, distance long")
    return out, history[-1], scans


def digested(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The clusters with their inertias and their centroids' digests."""
    sums = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    per = sums.collect()  # one row a cluster
    inertia = None if any(r["cluster_inertia"] is None for r in per) else sum(r["cluster_inertia"] for r in per)
    if inertia is not None and inertia >= 1 << 63:
        inertia = None
    by_cluster = {r["cluster"]: r["cluster_inertia"] for r in per}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = F.col("cluster") + 1
    return found.withColumns({
        "cluster_inertia": F.element_at(F.array(*[F.lit(by_cluster.get(j)).cast("long") for j in range(len(digests))]), at),
        "inertia": F.lit(inertia).cast("long"),
        "centroid_sha256": F.element_at(F.array(*map(F.lit, digests)), at),
    })


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, _ = clusters(C.table(spark, sf_dir, "embeddings"))
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return digested(found, centroids)


def _sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> str:
    parts = [f"""WITH v AS MATERIALIZED (
SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
FROM embeddings
WHERE len(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), c0 AS MATERIALIZED (
SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS c
FROM (SELECT x, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h, x LIMIT {k})
)"""]
    near = """a{t} AS MATERIALIZED (
SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(d) AS d, arg_min(cluster, (d, cluster)) AS cluster
FROM (SELECT r, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{t})
GROUP BY r
)"""
    for t in range(rounds):
        parts.append(near.format(t=t))
        parts.append(f"""c{t + 1} AS MATERIALIZED (
SELECT cluster, coalesce(m.c, o.c) AS c FROM c{t} AS o LEFT JOIN (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT cluster, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{t}, range(1, {dim + 1}) AS g(i) GROUP BY cluster, i)
  GROUP BY cluster
) AS m USING (cluster)
)""")
    parts.append(near.format(t=rounds))
    return ", ".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


SQL = _sql()

QUERIES = {"op11_centroid_clusters": (op11_centroid_clusters, SQL)}
