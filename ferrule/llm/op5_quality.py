"""Quality classifier: naive Bayes support vectors.

*Features* are indicators of word n-grams (one to three words).  A word enters
by its shape: its runs of lower-case letters, capitals and digits shrunk to
one sign each, other characters kept ("Aa", "A!!", "a%%%" -> "a%"), with marks
for repeating the previous word or the one before.  An n-gram has one
indicator for being there and one for each of a few shares of the document's
n-grams that it reaches.  Indicators are hashed to ``BINS`` bins.

*Ratios.*  Every labelled training document counts: per bin, the log of the
smoothed share of class 1 over that of class 0.

*Support vectors.*  A linear classifier on indicators times ratios, hinge loss,
fitted by dual coordinate descent on a sample of at most ``FIT_ROWS`` labelled
documents (the smallest hashes of the id; the bound is this parameter), its
weights interpolated with their mean magnitude as usual for this model.  A
logistic curve on ``CALIBRATION_ROWS`` further labelled documents turns
margins into scores.

Whole texts are scored.  Edge cases: a null or empty text has no n-gram, and
is scored by the bias alone; labels that are null or repeat (the largest
counts) and ids without a document or label do no harm; with no labelled row,
or of one class only, every score is that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import common as C

BINS = 1 << 18
LEVELS = (0.0, 1 / 64, 1 / 16, 1 / 4)
FIT_ROWS, CALIBRATION_ROWS = 8000, 4000
COST, ROUNDS, SMOOTH, INTERPOLATE, SEED = 1.0, 12, 1.0, 0.5, 5

# byte -> sign: 1 lower case and non-ASCII, 2 capitals, 3 digits, others their own
_SIGN = np.arange(256, dtype=np.uint8)
_SIGN[97:123] = 1
_SIGN[128:] = 1
_SIGN[65:91] = 2
_SIGN[48:58] = 3


def features(c: C.Chunk, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(bins, first entry of every row (len + 1)): each row's distinct indicators."""
    starts, stops, first = c.spans()
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(c) + 1, np.int64)
    word = C.Prefix(c.data).slices(starts, stops)
    sign = _SIGN[c.data]
    keep = np.ones(len(sign), bool)
    keep[1:] = sign[1:] != sign[:-1]
    keep[starts] = True
    at = np.cumsum(keep)
    shape = C.Prefix(sign[keep]).slices(at[starts] - 1, at[stops - 1])
    row = np.repeat(np.arange(len(c)), np.diff(first))
    place = np.arange(n) - first[:-1][row]
    for back in (1, 2):
        same = np.zeros(n, bool)
        same[back:] = (word[back:] == word[:-back]) & (place[back:] >= back)
        shape = shape + same * np.uint64(0x9E37 * back)
    shape = C.mix64(shape)
    grams, rows = [shape], [row]
    for k, m in ((2, 3), (3, 5)):
        if n >= k:
            g = grams[-1][:-1] * np.uint64(m) + shape[k - 1 :]
            grams.append(C.mix64(g))
            rows.append(row)
    keys, owners = [], []
    for k, g in enumerate(grams):
        inside = place[k:] >= k
        keys.append(C.mix64(g[inside] + np.uint64(k)) >> np.uint64(24))
        owners.append(row[k:][inside])
    key = np.concatenate(keys)
    owner = np.concatenate(owners)
    # one sort: row, then gram (40 bits)
    both, count = np.unique((owner.astype(np.uint64) << np.uint64(40)) | key, return_counts=True)
    owner = (both >> np.uint64(40)).astype(np.int64)
    gram = both & np.uint64((1 << 40) - 1)
    words = np.diff(first)[owner]
    out_bin, out_row = [], []
    for k, share in enumerate(LEVELS):
        ok = count >= share * words if share else slice(None)
        out_bin.append((C.mix64(gram[ok] * np.uint64(8) + np.uint64(k)) % np.uint64(bins)).astype(np.int64))
        out_row.append(owner[ok])
    pair = np.unique(np.concatenate(out_row) * bins + np.concatenate(out_bin))
    return pair % bins, np.searchsorted(pair // bins, np.arange(len(c) + 1))


@dataclass
class Model:
    weights: np.ndarray  # per bin, ratios included
    bias: float
    slope: float
    offset: float

    def margins(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[bins], dtype=np.float64)])
        size = np.sqrt(np.maximum(1, np.diff(first)))
        return np.diff(total[first]) / size + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -40, 40)))


def descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bins: int, cost: float = COST, rounds: int = ROUNDS,
            seed: int = SEED) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; ``x``: per row its bins and
    their values; a bias is one more feature of value 1."""
    w, bias = np.zeros(bins), 0.0
    alpha = np.zeros(len(y))
    square = np.array([float((v * v).sum()) + 1.0 for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(y)).tolist():
            at, v = x[i]
            g = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of a one-variable logistic curve, by Newton's method on
    targets drawn in from 0 and 1."""
    weight = np.ones(len(y)) if weight is None else weight
    pos, neg = float(weight[y == 1].sum()), float(weight[y == 0].sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    scale = max(float(np.abs(x).max()), 1e-9) if len(x) else 1.0
    x = x / scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        d, h = weight * (t - p), weight * p * (1 - p)
        haa, hab, hbb = float((h * x * x).sum()) + 1e-3, float((h * x).sum()), float(h.sum()) + 1e-9
        ga, gb = float((d * x).sum()) - 1e-3 * a, float(d.sum())
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return a / scale, b


def fold(id_col: str, mod: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, y of the documents that have a label.  A bit table of the
    labels' ids keeps the other texts out of the shuffle; the join is the same
    at every size."""
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    maybe, _ = C.prefilter(docs.select("doc_id", "text"), "doc_id", y.select("doc_id"))
    return maybe.hint("merge").join(y, "doc_id")


def _ratio_counts(rows: DataFrame, bins: int) -> np.ndarray:
    """Documents with each indicator, by class (2 x bins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * bins, np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for c in C.chunks(batch.column(0)):
                got, first = features(c, bins)
                total += np.bincount(got + np.repeat((y[c.rows] == 1) * bins, np.diff(first)), minlength=2 * bins)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    sums = rows.select("text", "y").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * bins)
    out[sums.column("bin").to_numpy()] = sums.column("n").to_numpy()  # at most 2 x bins rows
    return out.reshape(2, bins)


def fit(train: DataFrame, bins: int = BINS, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """``train``: doc_id, text, y."""
    train = C.written(train, "op5-train")
    counts = _ratio_counts(train, bins)
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[counts.sum(axis=0) == 0] = 0.0

    # a bounded sample: ids by hash, then their features
    chosen = train.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(fit_rows + calibration_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in C.chunks(batch.column(1)):
                got, first = features(c, bins)
                lo, n = int(c.rows[0]), len(c)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, n), batch.column(2).slice(lo, n),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(got.astype(np.int32))),
                ], names=["doc_id", "y", "bins"])

    # bounded: fit_rows + calibration_rows ids
    sample = train.join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", "text", "y").dropDuplicates(["doc_id"])
    rows = sample.mapInArrow(run, "doc_id long, y int, bins array<int>").toArrow()
    order = np.argsort(C.mix64(rows.column("doc_id").to_numpy().astype(np.uint64)), kind="stable")[: fit_rows + calibration_rows]
    y = rows.column("y").to_numpy()[order]
    got = rows.column("bins").combine_chunks()
    offsets = got.offsets.to_numpy()
    flat = got.values.to_numpy()
    x = []
    for i in order.tolist():
        at = flat[offsets[i] : offsets[i + 1]]
        x.append((at, ratio[at] / np.sqrt(max(1, len(at)))))
    n_fit = len(y) * fit_rows // (fit_rows + calibration_rows)
    if not len(y) or y.min() == y.max():
        share = (float((y == 1).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(bins, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    w, bias = descend(x[:n_fit], np.where(y[:n_fit] == 1, 1.0, -1.0), bins)
    used = w != 0
    if used.any():
        w = np.where(used | (ratio != 0), (1 - INTERPOLATE) * np.abs(w[used]).mean() + INTERPOLATE * w, 0.0)
    model = Model((w * ratio).astype(np.float32), bias, 1.0, 0.0)
    held = range(n_fit, len(y))
    margin = np.array([float((model.weights[x[i][0]]).sum()) / np.sqrt(max(1, len(x[i][0]))) + bias for i in held])
    model.slope, model.offset = logistic(margin, y[n_fit:])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all its columns) with score and predicted."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)  # size set by the number of bins
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*names)
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for c in C.chunks(batch.column(at)):
                p = own.scores(own.margins(*features(c, len(own.weights))))
                part = batch.slice(int(c.rows[0]), len(c))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows whose crc32(doc_id as text) mod 3 is not 1."""
    keep = fold("doc_id", 3) != 1
    return fit(labelled(docs.filter(keep), labels.filter(keep), "quality"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


# no SQL: tested by held-out accuracy
QUERIES = {"op5_quality_classifier": (op5_quality_classifier, None)}
