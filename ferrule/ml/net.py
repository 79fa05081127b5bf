"""M7: the neural network fitted on blocks of numbers, one scan an evaluation.

The network, its start and its objective are those of Spark's multilayer
perceptron: sigmoid layers, softmax at the end, the mean over stacks of
``STACK`` rows (a partition's last stack may be shorter) of the stack's mean
cross-entropy.  L-BFGS with a strong Wolfe search takes the same steps, so that
the fits agree up to rounding.  A task runs a chunk of rows through matrix products
that stay in the cache.

The prepared rows are packed once into blocks (persisted).  A task adds the loss
and gradient of its blocks; they are summed up a tree of tasks, and the driver
sees one vector of the network's size per evaluation, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STACK = 128
BLOCK_ROWS = 64 * STACK  # whole stacks: only a partition's last block has a shorter one
CHUNK_ROWS = 2 * STACK  # a chunk's layers stay in the cache
PAIRS, SEARCH_STEPS, MEMORY, TOL = 10, 10, 20, 1e-6


def blocks(rows: DataFrame, label: str, width: int, classes: int, features: str = "features") -> DataFrame:
    """Label and features as blocks of BLOCK_ROWS rows, the partition's order kept."""

    def pack(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        if not np.isfinite(x).all():
            raise ValueError("a feature is NaN or infinite")
        if not ((y >= 0) & (y < classes) & (y == np.floor(y))).all():
            raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}")
        return pa.RecordBatch.from_arrays(
            [pa.array([c], pa.binary()) for c in (x.astype("<f8").tobytes(), y.astype("<i4").tobytes())], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width),
                         batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                x, y = (np.concatenate(c) for c in zip(*held))
                for at in range(0, n - BLOCK_ROWS + 1, BLOCK_ROWS):
                    yield pack(x[at : at + BLOCK_ROWS], y[at : at + BLOCK_ROWS])
                n %= BLOCK_ROWS
                held = [(x[len(x) - n :], y[len(y) - n :])]
        if n:
            yield pack(*(np.concatenate(c) for c in zip(*held)))

    narrow = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return narrow.mapInArrow(run, "x binary, y binary")


def unpacked(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix inputs x outputs, bias) of every layer, as views."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def add_gradient(total: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: list[int]) -> float:
    """Adds the gradient of these rows' stacks to ``total``; returns their loss."""
    net, grads, loss = unpacked(weights, layers), unpacked(total, layers), 0.0
    share = np.full(len(y), 1.0 / STACK)
    if rest := len(y) % STACK:
        share[len(y) - rest :] = 1.0 / rest
    for at in range(0, len(y), CHUNK_ROWS):
        outs = [x[at : at + CHUNK_ROWS]]
        for w, b in net[:-1]:
            z = outs[-1] @ w
            z += b
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1.0
            outs.append(np.reciprocal(z, out=z))
        delta = outs[-1] @ net[-1][0]
        delta += net[-1][1]
        delta -= delta.max(axis=1, keepdims=True)
        truth = (np.arange(len(delta)), y[at : at + CHUNK_ROWS])
        mine, own = delta[truth], share[at : at + CHUNK_ROWS]
        np.exp(delta, out=delta)
        mass = delta.sum(axis=1)
        loss += own @ (np.log(mass) - mine)
        delta /= mass[:, None]
        delta[truth] -= 1.0
        delta *= own[:, None]
        for k in range(len(net) - 1, -1, -1):
            grads[k][0][...] += outs[k].T @ delta
            grads[k][1][...] += delta.sum(axis=0)
            if k:
                below = delta @ net[k][0].T
                below *= outs[k]
                np.subtract(1.0, outs[k], out=outs[k])
                below *= outs[k]
                delta = below
    return float(loss)


def arrays(table: DataFrame) -> RDD:
    """(features, labels) of every block."""

    def load(r) -> tuple[np.ndarray, np.ndarray]:
        y = np.frombuffer(r["y"], "<i4")
        return np.frombuffer(r["x"], "<f8").reshape(len(y), -1), y

    return table.rdd.map(load)


def objective(data: RDD, layers: list[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Loss and gradient at given weights: one scan of the blocks a call."""

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def part(held: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
            total, loss, stacks = np.zeros(len(weights)), 0.0, 0
            for x, y in held:
                loss += add_gradient(total, x, y, weights, layers)
                stacks += -(-len(y) // STACK)
            yield np.concatenate([[loss, stacks], total])

        sums = data.mapPartitions(part).treeReduce(np.add)
        return float(sums[0] / sums[1]), sums[2:] / sums[1]

    return evaluate


class StepFailed(ArithmeticError):
    """No step is found along a direction."""


def _minimum_between(a: tuple, b: tuple) -> float:
    """Minimum of the cubic through (t, value, slope) at both ends, kept off them."""
    (ta, fa, da), (tb, fb, db) = sorted((a, b), key=lambda e: e[0])
    d1 = da + db - 3 * (fa - fb) / (ta - tb)
    root = d1 * d1 - da * db
    d2 = np.sqrt(root) if root >= 0 else np.nan
    down = db - da + 2 * d2
    t = tb - (tb - ta) * (db + d2 - d1) / down if down else np.nan
    low, high = ta + 0.1 * (tb - ta), ta + 0.9 * (tb - ta)
    return low if t < low else high if t > high else t


def wolfe_step(at: Callable[[float], tuple[float, float]], first: float) -> float:
    """A step with enough decrease and a flat enough slope (strong Wolfe, 1e-4 and
    0.9).  ``at``: value and slope after a step."""
    f0, d0 = at(0.0)
    if d0 > 0:
        raise StepFailed("the direction leads up")

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(SEARCH_STEPS):
            t = _minimum_between(low, high)
            if np.isnan(t):
                break
            f, d = at(t)
            if f > f0 + 1e-4 * t * d0 or f >= low[1]:
                high = (t, f, d)
                continue
            if abs(d) <= 0.9 * abs(d0):
                return t
            if d * (high[0] - low[0]) >= 0:
                high = low
            low = (t, f, d)
        raise StepFailed("the search between two steps doesn't end")

    t, low = first, (0.0, f0, d0)
    for i in range(SEARCH_STEPS):
        f, d = at(t)
        if not np.isfinite(f):
            t /= 2
            continue
        if f > f0 + 1e-4 * t * d0 or (f >= low[1] and i > 0):
            return zoom(low, (t, f, d))
        if abs(d) <= 0.9 * abs(d0):
            return t
        if d >= 0:
            return zoom((t, f, d), low)
        low = (t, f, d)
        t *= 1.5
    raise StepFailed("no step is long enough")


def _direction(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """-(inverse second derivatives) grad, from the last steps and gradient changes
    (newest first)."""
    scale = 1.0
    if pairs:
        s, g = pairs[0]
        scale = (s @ g) / (g @ g) if g @ g else np.nan
        if not scale >= 0:
            raise StepFailed("the last step has no curvature")
    out, parts = grad.copy(), []
    for s, g in pairs:
        part = (s @ out) / (s @ g) if s @ g else np.nan
        if np.isnan(part):
            raise StepFailed("a step has no curvature")
        parts.append(part)
        out -= part * g
    out *= scale
    for (s, g), part in zip(reversed(pairs), reversed(parts)):
        out += (part - (g @ out) / (s @ g)) * s
    return -out


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS of at most ``steps`` steps: ends when the value has moved by less than
    TOL of the first one over MEMORY steps, or the gradient is TOL of the value."""
    here, (value, grad) = start, f(start)
    first, last, pairs, failed, step = value, [np.inf], [], False, 0
    while step < steps:
        if len(last) >= 2 and abs(value - max(last)) <= TOL * first or np.linalg.norm(grad) <= max(TOL * value, 1e-8):
            break
        seen: dict[float, tuple[float, np.ndarray]] = {0.0: (value, grad)}

        def along(t: float, way: np.ndarray) -> tuple[float, float]:
            if t not in seen:
                seen[t] = f(here + t * way)
            return seen[t][0], float(seen[t][1] @ way)

        try:
            way = _direction(grad, pairs)
            t = wolfe_step(lambda t: along(t, way), 1.0 if step else 1.0 / np.linalg.norm(way))  # noqa: B023
            if t * np.linalg.norm(grad) < 1e-10:
                raise StepFailed("the step is too short")
        except StepFailed:
            if failed:
                break
            pairs, failed = [], True  # once more, straight down
            continue
        there, (after, slope) = here + t * way, seen[t]
        pairs = [(there - here, slope - grad), *pairs][:PAIRS]
        here, value, grad = there, after, slope
        last, failed, step = [*last, value][-MEMORY:], False, step + 1
    return here


class NeuralNet(Estimator):
    """Fits a network on the vectors and the labels 0 .. k-1 of a table; the model is
    Spark's.  ``layers``: inputs, hidden layers, classes."""

    def __init__(self, label: str, layers: list[int], epochs: int, seed: int, features: str = "features"):
        super().__init__()
        self.label, self.layers, self.epochs, self.seed, self.features = label, layers, epochs, seed, features

    def setFeaturesCol(self, name: str) -> NeuralNet:
        self.features = name
        return self

    def _spark_model(self, like: DataFrame, weights: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
        """Spark's model with these weights, or those that Spark starts from."""
        one = like.sparkSession.createDataFrame([(0.0, Vectors.dense([0.0] * self.layers[0]))], [self.label, self.features])
        clf = MultilayerPerceptronClassifier(
            labelCol=self.label, featuresCol=self.features, layers=self.layers, maxIter=0, blockSize=STACK, seed=self.seed)
        return (clf if weights is None else clf.setInitialWeights(Vectors.dense(weights))).fit(one)

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        start = self._spark_model(dataset).weights.toArray()
        table = blocks(dataset, self.label, self.layers[0], self.layers[-1], self.features)
        data = arrays(table).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = minimised(objective(data, self.layers), start, self.epochs)
        finally:
            data.unpersist()
        return self._spark_model(dataset, found)
