"""M12/M13 for logistic regression: all candidates and folds in one scan.

A *problem* is one candidate on the rows outside one fold (or on all rows).  The
prepared rows are written once as blocks of numbers; every scan evaluates all
open problems on each block: loss, gradient and second derivatives, summed up a
tree of tasks.  What reaches the driver is one small matrix a problem, whatever
the number of rows.  There each problem takes a proximal Newton step (the l1 part
by feature signs on the quadratic model), with step halving; a dozen scans
settle all problems at once.

Objective: weighted mean of the logistic loss + reg (l1 |b|_1 + (1 - l1) / 2 |b|^2);
the intercept is free; features as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import scratch_path

MAX_WIDTH = 512  # second derivatives are width x width numbers a problem
SCANS, TOL, RIDGE = 100, 1e-9, 1e-10
CHUNK_ROWS, CHUNK_PRODUCTS = 1000, 1 << 18  # a chunk's products of columns stay in the cache


@dataclass(frozen=True)
class Problem:
    reg: float
    l1: float = 0.0
    fold: int | None = None


def blocks(rows: DataFrame, label: str, weight: str | None = None, fold: str | None = None, features: str = "features") -> DataFrame:
    """Label, weight, fold and features as a written table of number blocks."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                rest = [c.to_numpy(zero_copy_only=False).astype("<f8").tobytes() for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], pa.binary()) for c in (x.astype("<f8").tobytes(), *rest)], names=["x", "y", "w", "fold"])

    narrow = rows.select(
        vector_to_array(features).alias("x"), (F.col(label) > 0).cast("double").alias("y"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        (F.coalesce(F.col(fold), F.lit(-1)) if fold else F.lit(-1)).cast("double").alias("fold"))
    path = scratch_path(spark, f"batched-{uuid.uuid4().hex}")
    narrow.mapInArrow(run, "x binary, y binary, w binary, fold binary").write.parquet(path)
    return spark.read.parquet(path)


def _arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y, w, fold = (np.frombuffer(r[c], "<f8") for c in ("y", "w", "fold"))
    x = np.frombuffer(r["x"], "<f8").reshape(len(y), -1)
    return np.column_stack([x, np.ones(len(y))]), y, w, fold


def _derivatives(table, points: dict[int, np.ndarray], problems: list[Problem]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Mean loss, gradient and second derivatives of each open problem.  The
    products of two columns are formed once per chunk of rows and serve all
    problems: every sum is one matrix product."""
    order = sorted(points)
    theta = np.column_stack([points[p] for p in order])
    left_out = np.array([np.nan if problems[p].fold is None else problems[p].fold for p in order])
    d = theta.shape[0]
    chunk = max(16, min(CHUNK_ROWS, CHUNK_PRODUCTS // (d * (d + 1) // 2)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 + d + d * (d + 1) // 2, len(order)))
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, w, fold = _arrays({c: batch.column(c)[k].as_buffer() for c in ("x", "y", "w", "fold")})
                for at in range(0, len(y), chunk):
                    rows = slice(at, at + chunk)
                    use = w[rows, None] * (fold[rows, None] != left_out)
                    z, cols = x[rows] @ theta, np.ascontiguousarray(x[rows].T)
                    e = np.exp(-np.abs(z))
                    prob = np.where(z >= 0, 1.0, e) / (1 + e)
                    total[0] += (use * (np.maximum(z, 0) + np.log1p(e) - y[rows, None] * z)).sum(axis=0)
                    total[1] += use.sum(axis=0)
                    total[2 : 2 + d] += cols @ (use * (prob - y[rows, None]))
                    products = np.concatenate([cols[i] * cols[i:] for i in range(d)])
                    total[2 + d :] += products @ (use * prob * (1 - prob))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = table.mapInArrow(part, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]))
    total = sums.treeReduce(np.add).reshape(-1, len(order))
    upper = np.triu_indices(d)
    out = {}
    for k, p in enumerate(order):
        loss, weight = total[:2, k]
        hess = np.zeros((d, d))
        hess[upper] = total[2 + d :, k] / weight
        hess[upper[::-1]] = hess[upper]
        out[p] = (loss / weight, total[2 : 2 + d, k] / weight, hess)
    return out


def _step(theta: np.ndarray, grad: np.ndarray, hess: np.ndarray, q: Problem) -> np.ndarray:
    """Minimiser of the quadratic model plus the penalty."""
    d = len(theta)
    ridge = np.full(d, q.reg * (1 - q.l1))
    lasso = np.full(d, q.reg * q.l1)
    ridge[-1] = lasso[-1] = 0.0
    # collinear columns leave directions without curvature: a trace of it keeps
    # the minimiser single
    a = hess + np.diag(ridge) + RIDGE * np.eye(d)
    b = hess @ theta - grad  # smooth part: 1/2 t'at - b't
    if q.l1 == 0:
        return np.linalg.solve(a, b)
    return lasso_minimiser(a, b, lasso, theta)


def lasso_minimiser(a: np.ndarray, b: np.ndarray, lasso: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minimiser of 1/2 t'at - b't + sum lasso |t| by feature signs: a guessed
    support and its signs make it a linear system; the way there stops where a
    coefficient would change sign, and columns enter by the largest violation."""
    t = start.copy()
    sign = np.sign(t)

    def value(x: np.ndarray) -> float:
        return x @ (a @ x) / 2 - b @ x + lasso @ np.abs(x)

    for _ in range(50 * len(t)):
        on = np.flatnonzero((sign != 0) | (lasso == 0))
        goal = np.zeros_like(t)
        goal[on] = np.linalg.solve(a[np.ix_(on, on)], b[on] - lasso[on] * sign[on])
        move = goal - t
        cross = np.flatnonzero((t * goal < 0) & (lasso > 0))
        tries = [goal]
        for s in t[cross] / (t[cross] - goal[cross]):
            x = t + s * move
            x[np.abs(x) <= 1e-15 * np.abs(t).max()] = 0.0
            tries.append(x)
        for k, j in enumerate(cross):
            tries[1 + k][j] = 0.0
        best = min(tries, key=value)
        settled = best is goal and not len(cross)
        t = best
        sign = np.where(lasso > 0, np.sign(t), 0)
        if not settled:
            continue
        slope = b - a @ t
        over = np.where((sign == 0) & (lasso > 0), np.abs(slope) - lasso, -np.inf)
        j = int(over.argmax())
        if over[j] <= 1e-12 * max(1.0, lasso.max()):
            return t
        sign[j] = np.sign(slope[j])
    return t


def fit_many(table: DataFrame, problems: list[Problem], width: int) -> list[np.ndarray]:
    """Coefficients of every problem, the intercept last."""
    if width > MAX_WIDTH:
        raise ValueError(f"{width} features: second derivatives are kept for {MAX_WIDTH} at most")

    def penalty(t: np.ndarray, q: Problem) -> float:
        return q.reg * (q.l1 * np.abs(t[:-1]).sum() + (1 - q.l1) / 2 * (t[:-1] ** 2).sum())

    done: dict[int, np.ndarray] = {}
    here = {p: np.zeros(width + 1) for p in range(len(problems))}
    value = dict.fromkeys(here, np.inf)
    trial, size = dict(here), dict.fromkeys(here, 1.0)
    goal = dict(here)
    for _ in range(SCANS):
        for p, (loss, grad, hess) in _derivatives(table, trial, problems).items():
            q = problems[p]
            now = loss + penalty(trial[p], q)
            if now > value[p] + 1e-15 * abs(value[p]) and size[p] > 1e-6:
                size[p] /= 2  # too far: halve the step
                trial[p] = here[p] + size[p] * (goal[p] - here[p])
                continue
            here[p], value[p], size[p] = trial[p], now, 1.0
            goal[p] = trial[p] = _step(here[p], grad, hess, q)
            move = goal[p] - here[p]
            gain = -(grad @ move + move @ hess @ move / 2 + penalty(goal[p], q) - penalty(here[p], q))
            if np.abs(move).max() <= TOL * max(1.0, np.abs(here[p]).max()) or gain <= 1e-16 * max(1.0, now):
                done[p] = goal[p]
        trial = {p: t for p, t in trial.items() if p not in done}
        if not trial:
            return [done[p] for p in range(len(problems))]
    raise RuntimeError(f"{len(trial)} problems did not settle in {SCANS} scans")


def fold_f1(table: DataFrame, problems: list[Problem], found: list[np.ndarray]) -> list[float]:
    """F1 of class 1 of every problem on the rows of its fold, in one scan."""
    theta = np.column_stack(found)

    def count(r) -> np.ndarray:
        x, y, _, fold = _arrays(r)
        guess = x @ theta > 0
        out = np.zeros((len(problems), 3))
        for k, q in enumerate(problems):
            mine = fold == q.fold
            g, t = guess[mine, k], y[mine] > 0
            out[k] = (g & t).sum(), g.sum(), t.sum()
        return out

    total = table.rdd.map(count).treeReduce(np.add)
    return [2 * tp / (a + b) if a + b else 0.0 for tp, a, b in total.tolist()]
