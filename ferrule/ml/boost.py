"""M4: boosted trees by mergeable histograms; many fits in one scan.

*Bins.*  One aggregate gives quantile cuts of every feature (a mergeable
sketch); each value becomes the byte of its bin.  The binned rows are written
once as blocks (a byte matrix with labels and folds) to the shared folder.

*Levels.*  A tree grows level by level.  A task adds the gradients and second
derivatives of its rows into one histogram per (fit, column); one shuffle sums
them by that key, the reducer finds the best cut of every node, and the driver
sees one candidate per fit, column and node.  Rows never move.

*Objective.*  Logistic loss; a leaf's weight is -G / (H + l2); a split's gain is
G_l^2/(H_l + l2) + G_r^2/(H_r + l2) - G^2/(H + l2); both children need
``min_child_weight`` of second derivatives.  Columns are drawn per tree, rows per
tree; the positive class weighs ``scale_pos_weight``.  Equal gains: smaller
column, then smaller cut.

*Many fits.*  All fits (search candidates x folds) share every scan: margins are
one row per fit in a block's state, and a fit leaves out the rows of its
``fold``.  State of a tree is derived from the state before it, narrowly; the
blocks are a written table, so a lost executor replays the trees for its own
blocks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import scratch_path

MAX_BINS = 256
ACCURACY = 100_000  # quantiles are off by at most rows / ACCURACY ranks
REDUCER_BYTES = 8 << 20
STATE_CELLS = 1 << 17  # margins of one block in the state
MIN_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """One fit.  ``fold``: rows of this fold are left out (None: none are).
    ``columns``: trees draw from these (None: from all)."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 5
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    scale_pos_weight: float = 1.0
    l2: float = 1.0
    min_child_weight: float = 1.0
    fold: int | None = None
    seed: int = 42
    columns: tuple[int, ...] | None = None


@dataclass
class Tree:
    """Nodes in level order; node i's children are 2i + 1 and 2i + 2.
    ``feature`` is -1 at leaves; rows with bin <= ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n))

    def route(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of every row after ``levels`` steps."""
        at = np.arange(bins.shape[1])
        node = np.zeros(bins.shape[1], np.int64)
        for _ in range(levels):
            f = self.feature[node]
            right = bins[f, at] > self.cut[node]  # leaves read some column, unused
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    @property
    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2


@dataclass
class Block:
    keys: list[tuple[int, int]]  # (key, rows) of the written blocks that it holds
    bins: np.ndarray  # columns x rows, bytes
    y: np.ndarray
    fold: np.ndarray
    margin: np.ndarray  # fits x rows


def edges(rows: DataFrame, features: str = "features", max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cuts of every slot: its distinct quantiles at k / max_bins.  The driver
    sees max_bins numbers a slot.  A sketch holds up to ACCURACY numbers, whatever
    its rows: the cores make one each, so that their number doesn't follow the rows."""
    probs = F.array(*[F.lit(k / max_bins) for k in range(1, max_bins)])
    few = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    long = few.select(F.posexplode(vector_to_array(features)).alias("i", "x"))
    found = long.groupBy("i").agg(F.percentile_approx("x", probs, ACCURACY).alias("q")).collect()
    out: list[np.ndarray] = [np.zeros(0)] * len(found)
    for r in found:
        out[r["i"]] = np.unique(np.array(r["q"], float))
    return out


def binned(matrix: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value; one row per column of the matrix."""
    return np.array([np.searchsorted(c, matrix[:, j], "left") for j, c in enumerate(cuts)], np.uint8).reshape(len(cuts), -1)


def blocks(rows: DataFrame, cuts: list[np.ndarray], label: str, features: str = "features", fold: str | None = None) -> DataFrame:
    """The binned rows as a written table of blocks."""
    spark = rows.sparkSession
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.binary()) for c in (
                    binned(x, cuts).tobytes(), batch.column(1).to_numpy().astype(np.uint8).tobytes(),
                    batch.column(2).to_numpy().astype("<i4").tobytes())], names=["bins", "y", "fold"])

    narrow = rows.select(
        vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"),
        F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("fold") if fold else F.lit(-1).alias("fold"))
    path = scratch_path(spark, f"boost-{uuid.uuid4().hex}")
    packed = narrow.mapInArrow(run, "bins binary, y binary, fold binary")
    packed.withColumn("key", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _state(table: DataFrame, width: int, fits: int) -> RDD:
    """The written blocks, a partition's joined up to STATE_CELLS margins."""
    names = ("bins", "y", "fold")

    def joined(rows: list) -> Block:
        bins, y, fold = (np.concatenate([np.frombuffer(r[c], kind).reshape(-1 if c != "bins" else (width, -1)) for r in rows], axis=-1)
                         for c, kind in zip(names, (np.uint8, np.uint8, "<i4")))
        return Block([(r["key"], len(r["y"])) for r in rows], bins, y, fold, np.zeros((fits, len(y))))

    def load(rows: Iterator) -> Iterator[Block]:
        held, cells = [], 0
        for r in rows:
            if held and cells + fits * len(r["y"]) > STATE_CELLS:
                yield joined(held)
                held, cells = [], 0
            held.append(r)
            cells += fits * len(r["y"])
        if held:
            yield joined(held)

    return table.rdd.mapPartitions(load)


def _even(table: DataFrame) -> DataFrame:
    """The blocks in whole rounds of the cores: every level is a job of its own, and
    one task more than the cores would double its time."""
    n, cores = table.rdd.getNumPartitions(), table.sparkSession.sparkContext.defaultParallelism
    return table if n <= cores or n % cores == 0 else table.repartition(-(-n // cores) * cores)


def _grown(state: RDD, trees: dict[int, Tree]) -> RDD:
    """The state with the margins of these finished trees (by fit) added."""

    def add(b: Block) -> Block:
        margin = b.margin.copy()
        for p, tree in trees.items():
            margin[p] += tree.value[tree.route(b.bins, tree.depth)]
        return Block(b.keys, b.bins, b.y, b.fold, margin)

    return state.map(add)


def _level(state: RDD, work: dict[int, tuple[Settings, Tree, np.ndarray]], level: int, round_: int, n_bins: int) -> list:
    """[(fit, column, per node: gain, cut, G_left, H_left, G, H)] of one level."""
    nodes, base = 1 << level, (1 << level) - 1

    def histograms(part: Iterator[Block]) -> Iterator[tuple]:
        sums: dict = {}
        for b in part:
            draw = None
            for p, (s, tree, columns) in work.items():
                prob = 1 / (1 + np.exp(-b.margin[p]))
                w = np.where(b.y > 0, s.scale_pos_weight, 1.0)
                if s.fold is not None:
                    w = w * (b.fold != s.fold)
                if s.subsample < 1:
                    if draw is None:
                        draw = np.concatenate([np.random.default_rng([s.seed, round_, key]).random(n) for key, n in b.keys])
                    w = w * (draw < s.subsample)
                node = tree.route(b.bins, level) - base
                live = np.flatnonzero((w > 0) & (node >= 0))
                whole = len(live) == len(w)
                place = node[live] * n_bins
                g = (w * (prob - b.y))[live]
                h = (w * prob * (1 - prob))[live]
                for j in columns:
                    code = place + (b.bins[j] if whole else b.bins[j][live])
                    if (p, int(j)) not in sums:
                        sums[p, int(j)] = np.zeros((2, nodes * n_bins))
                    both = sums[p, int(j)]
                    both[0] += np.bincount(code, g, nodes * n_bins)
                    both[1] += np.bincount(code, h, nodes * n_bins)
        return iter(sums.items())

    def best(item: tuple) -> tuple:
        (p, j), both = item
        s = work[p][0]
        return p, j, best_cuts(both.reshape(2, nodes, n_bins), s.l2, s.min_child_weight)

    n = reducers(sum(len(c) for _, _, c in work.values()), nodes * n_bins, state.getNumPartitions())
    return state.mapPartitions(histograms).reduceByKey(np.add, n).map(best).collect()


def reducers(columns: int, cells: int, tasks: int) -> int:
    """Reducers of a level's histograms, ``columns`` of ``cells`` each: every task
    sends its own, and what one reducer gets must not grow with the tasks."""
    return max(1, min(columns, -(-columns * cells * 16 * tasks // REDUCER_BYTES)))


def best_cuts(both: np.ndarray, l2: float, min_child_weight: float) -> np.ndarray:
    """Per node of one column's histogram (2 x nodes x bins): gain, cut,
    G and H left of it, G and H of the node; gain -inf where no cut is allowed."""
    total = both.sum(axis=2)
    left = np.cumsum(both, axis=2)[:, :, :-1]
    right = total[:, :, None] - left
    ok = (left[1] >= min_child_weight) & (right[1] >= min_child_weight)
    gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - (total[0] ** 2 / (total[1] + l2))[:, None]
    gain = np.where(ok, gain, -np.inf)
    cut = gain.argmax(axis=1)
    at = np.arange(len(cut))
    return np.stack([gain[at, cut], cut, left[0, at, cut], left[1, at, cut], total[0], total[1]], axis=1)


def _draw_columns(s: Settings, round_: int, width: int) -> np.ndarray:
    pool = np.arange(width) if s.columns is None else np.sort(np.array(s.columns, np.int64))
    n = max(1, int(s.colsample_bytree * len(pool)))
    if n >= len(pool):
        return pool
    return np.sort(pool[np.random.default_rng([s.seed, round_, 1 << 20]).permutation(len(pool))[:n]])


def _apply_splits(found: list, work: dict, level: int) -> dict[int, bool]:
    """Writes this level's splits and their children's leaf weights into the
    trees; whether any node of the fit was split."""
    base = (1 << level) - 1
    went = {}
    for p, (s, tree, _) in work.items():
        mine = sorted(((j, r) for q, j, r in found if q == p), key=lambda x: x[0])
        split = False
        for k in range(1 << level):
            node = base + k
            if level and tree.feature[(node - 1) // 2] < 0:
                continue
            if level == 0 and mine:
                total = mine[0][1][0]
                tree.value[0] = -total[4] / (total[5] + s.l2) * s.learning_rate
                tree.cover[0] = total[5]
            top = max(mine, key=lambda x: (x[1][k][0], -x[0]), default=None)
            if top is None or not top[1][k][0] > MIN_GAIN:
                continue
            gain, cut, gl, hl, g, h = top[1][k]
            tree.feature[node], tree.cut[node], tree.gain[node] = top[0], int(cut), gain
            for child, cg, ch in ((2 * node + 1, gl, hl), (2 * node + 2, g - gl, h - hl)):
                tree.value[child] = -cg / (ch + s.l2) * s.learning_rate
                tree.cover[child] = ch
            split = True
        went[p] = split
    return went


def fit_many(table: DataFrame, cuts: list[np.ndarray], fits: list[Settings]) -> list[list[Tree]]:
    """The trees of every fit; level by level, one scan and one shuffle for all."""
    width = len(cuts)
    n_bins = max((len(c) for c in cuts), default=0) + 1
    state = _state(_even(table), width, len(fits)).persist(StorageLevel.MEMORY_AND_DISK)
    forests: list[list[Tree]] = [[] for _ in fits]
    old = None
    try:
        for round_ in range(max((s.n_estimators for s in fits), default=0)):
            work = {p: (s, Tree.empty(s.max_depth), _draw_columns(s, round_, width))
                    for p, s in enumerate(fits) if round_ < s.n_estimators}
            open_, level = dict(work), 0
            while open_:
                went = _apply_splits(_level(state, open_, level, round_, n_bins), open_, level)
                if old is not None:  # the new state is persisted by now
                    old.unpersist()
                    old = None
                level += 1
                open_ = {p: x for p, x in open_.items() if went[p] and level < x[0].max_depth}
            for p, (_, tree, _) in work.items():
                forests[p].append(tree)
            if round_ + 1 < max(s.n_estimators for s in fits):
                old, state = state, _grown(state, {p: t for p, (_, t, _) in work.items()}).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        state.unpersist()
        if old is not None:
            old.unpersist()
    return forests


def margins(bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = np.zeros(bins.shape[1])
    for t in trees:
        out += t.value[t.route(bins, t.depth)]
    return out


def fold_f1(table: DataFrame, cuts: list[np.ndarray], fits: list[Settings], forests: list[list[Tree]]) -> list[float]:
    """F1 of class 1 of every fit on the rows of its fold, in one pass."""
    width = len(cuts)

    def count(r) -> np.ndarray:
        bins = np.frombuffer(r["bins"], np.uint8).reshape(width, -1)
        y = np.frombuffer(r["y"], np.uint8) > 0
        fold = np.frombuffer(r["fold"], "<i4")
        out = np.zeros((len(fits), 3), np.int64)
        for p, (s, trees) in enumerate(zip(fits, forests)):
            mine = fold == s.fold
            guess = margins(bins[:, mine], trees) > 0
            out[p] = (guess & y[mine]).sum(), guess.sum(), y[mine].sum()
        return out

    total = table.rdd.map(count).treeReduce(np.add) if len(fits) else np.zeros((0, 3))
    return [2 * tp / (a + b) if a + b else 0.0 for tp, a, b in total.tolist()]


def node_rows(trees: list[Tree], cuts: list[np.ndarray]) -> list[tuple]:
    """(tree, node, feature, threshold, value, gain, cover) of the nodes in use."""
    out = []
    for t, tree in enumerate(trees):
        for i in range(len(tree.feature)):
            if i and tree.feature[(i - 1) // 2] < 0:
                continue
            f = int(tree.feature[i])
            at = float(cuts[f][tree.cut[i]]) if f >= 0 else None
            out.append((t, i, f, at, float(tree.value[i]), float(tree.gain[i]), float(tree.cover[i])))
    return out


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Scores vectors with fitted trees: adds ``probability`` (two classes) and
    ``prediction``, in Arrow batches.  Saved and loaded like any stage."""

    featuresCol = Param(Params._dummy(), "featuresCol", "input vectors", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "cuts and trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", trees=None):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, forest: list[Tree], cuts: list[np.ndarray], features: str = "features") -> BoostedTreesModel:
        text = json.dumps({"cuts": [c.tolist() for c in cuts], "trees": [
            {k: getattr(t, k).tolist() for k in ("feature", "cut", "value", "gain", "cover")} for t in forest]})
        return cls(featuresCol=features, trees=text)

    def setFeaturesCol(self, name: str) -> BoostedTreesModel:
        return self._set(featuresCol=name)

    def forest(self) -> tuple[list[Tree], list[np.ndarray]]:
        d = json.loads(self.getOrDefault("trees"))
        kinds = {"feature": np.int32, "cut": np.int32, "value": float, "gain": float, "cover": float}
        return [Tree(**{k: np.array(t[k], v) for k, v in kinds.items()}) for t in d["trees"]], [np.array(c, float) for c in d["cuts"]]

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of a column's splits, as shares of 1."""
        trees, cuts = self.forest()
        gain, times = np.zeros(len(cuts)), np.zeros(len(cuts))
        for t in trees:
            inner = t.feature >= 0
            np.add.at(gain, t.feature[inner], t.gain[inner])
            np.add.at(times, t.feature[inner], 1)
        mean = gain / np.maximum(times, 1)
        return DenseVector(mean / mean.sum() if mean.sum() else mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, cuts = self.forest()

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            n = len(x)
            matrix = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            return pa.array(1 / (1 + np.exp(-margins(binned(matrix, cuts), trees))))

        p = score(vector_to_array(self.getOrDefault("featuresCol")))
        out = dataset.withColumn("_p1", p)
        return out.select(
            *dataset.columns, array_to_vector(F.array(1 - F.col("_p1"), F.col("_p1"))).alias("probability"),
            (F.col("_p1") > 0.5).cast("double").alias("prediction"))


class BoostedTrees(Estimator):
    """Fits one ``Settings`` on the vectors and 0 / 1 labels of a table.  Which rows
    a tree draws depends on the blocks of the table; reruns on it agree."""

    def __init__(self, label: str, settings: Settings, features: str = "features", max_bins: int = MAX_BINS):
        super().__init__()
        self.label, self.settings, self.features, self.max_bins = label, settings, features, max_bins

    def setFeaturesCol(self, name: str) -> BoostedTrees:
        self.features = name
        return self

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        cuts = edges(dataset, self.features, self.max_bins)
        table = blocks(dataset, cuts, self.label, self.features)
        return BoostedTreesModel.of(fit_many(table, cuts, [self.settings])[0], cuts, self.features)


# bytes of histograms that a task may hold in a scan of many fits
SCAN_BYTES = 256 << 20


def scans(fits: list[Settings], cuts: list[np.ndarray]) -> list[list[int]]:
    """The fits dealt to scans whose histograms fit a task's memory."""
    n_bins = max((len(c) for c in cuts), default=0) + 1
    out, room = [], 0
    for p, s in enumerate(fits):
        need = max(1, int(s.colsample_bytree * len(cuts))) * (1 << max(s.max_depth - 1, 0)) * n_bins * 16
        if not out or need > room:
            out.append([])
            room = SCAN_BYTES
        out[-1].append(p)
        room -= need
    return out


def cross_validated(rows: DataFrame, label: str, candidates: list[Settings], folds: int, fold: str = "fold",
                    features: str = "features", max_bins: int = MAX_BINS) -> list[float]:
    """Mean F1 of class 1 over the folds, per candidate; all candidates and
    folds share bins, blocks and scans."""
    cuts = edges(rows, features, max_bins)
    table = blocks(rows, cuts, label, features, fold)
    fits = [replace(c, fold=k) for c in candidates for k in range(folds)]
    f1 = [0.0] * len(fits)
    for group in scans(fits, cuts):
        some = [fits[p] for p in group]
        for p, v in zip(group, fold_f1(table, cuts, some, fit_many(table, cuts, some))):
            f1[p] = v
    return [float(np.mean(f1[i * folds : (i + 1) * folds])) for i in range(len(candidates))]
