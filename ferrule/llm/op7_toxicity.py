"""Toxicity by maximum-scoring segments of token log-odds.

*Tokens* are runs of ASCII letters, digits and non-ASCII characters, ASCII in
lower case.  A token has several units: itself and its first 3, 4 and 5
characters.  Units are hashed to ``BINS`` bins.

*Log-odds.*  Over all labelled training documents a bin's document counts are
compared between toxic and other documents, with a Dirichlet prior that adds
``PRIOR`` units spread as in the whole corpus (all documents, labelled or not)
plus ``FLOOR`` to each bin.  A bin scores the lower bound of its log-odds,
``Z`` standard deviations down; a token scores its best unit, or ``-DRIFT``
where that is not positive.

*Segments.*  One linear scan finds all maximal scoring segments of a document.
For the background (training documents that aren't toxic) the scores'
distribution gives the extreme-value parameters lambda and K, so a segment of
score S in a text of m tokens has the expected number of chance equals
E = K m exp(-lambda S); segments of E <= ``SIGNIFICANT`` are reported with
their character spans.  A document's statistic aggregates its segments: for its r
best, normalised by lambda and K, the sum has a known tail chance; -log of the
smallest of these chances over r, by a logistic curve over the training
documents, is its score.

Edge cases: a null or empty text has no token and the statistic 0; null or
repeated labels (the largest counts) and ids without a document or label do no
harm; with no labelled row, or of one class, all scores are that smoothed share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm import common as C
from ferrule.llm.op5_quality import fold, labelled, logistic

BINS = 1 << 20
PREFIXES = (3, 4, 5)
PRIOR, FLOOR, Z, DRIFT, TOP = 1000.0, 0.5, 2.5, 0.5, 12.0
SIGNIFICANT, CUT = 0.05, 0.3
STEP = 0.05  # of score histograms

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False
_GAP[128:] = False
_LOWER = C.IDENT.copy()
_LOWER[65:91] += 32


def units(c: C.Chunk, bins: int = BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins: tokens x units, starts, stops, first token of every row (len + 1));
    a unit that a token is too short for repeats the token itself."""
    starts, stops, first = c.spans(_GAP)
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), starts, stops, first
    prefix = C.Prefix(_LOWER[c.data])
    whole = prefix.slices(starts, stops, 1)
    lead = np.flatnonzero((c.data & 0xC0) != 0x80)
    at = np.searchsorted(lead, starts)
    lead = np.append(lead, np.full(max(PREFIXES) + 1, len(c.data)))
    cols = [whole]
    for k in PREFIXES:
        end = lead[at + k]
        cols.append(np.where(end < stops, prefix.slices(starts, np.minimum(end, stops), 10 + k), whole))
    return (np.stack(cols, axis=1) % np.uint64(bins)).astype(np.int64), starts, stops, first


def _presence(got: np.ndarray, first: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins, rows): each row's bins once."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    both = np.unique(row[:, None] * bins + got)
    return both % bins, both // bins


def _sums(rows: DataFrame, size: int, count) -> np.ndarray:
    """Sum over all tasks of the vectors (``size``) that ``count(batch)`` adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            count(batch, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    sums = rows.mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[sums.column("bin").to_numpy()] = sums.column("n").to_numpy()  # at most ``size`` rows
    return out


def log_odds(toxic: np.ndarray, other: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Lower bounds of the log-odds of every bin."""
    prior = FLOOR + PRIOR * corpus / max(1.0, corpus.sum())
    a, b = toxic + prior, other + prior
    na, nb = a.sum(), b.sum()
    delta = np.log(a / np.maximum(na - a, 1e-9)) - np.log(b / np.maximum(nb - b, 1e-9))
    return np.minimum(delta - Z * np.sqrt(1 / a + 1 / b), TOP)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in one linear scan."""
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, stop, link
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        low, start = before, i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                break
            low, start = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
        found.append((low, total, start, i + 1, j))
    return [(a, b, hi - lo) for lo, hi, a, b, _ in found]


@dataclass
class Model:
    table: np.ndarray
    decay: float = 1.0  # lambda
    k: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def tokens(self, got: np.ndarray) -> np.ndarray:
        s = self.table[got].max(axis=1) if len(got) else np.zeros(0, np.float32)
        return np.where(s > 0, s, -DRIFT)

    def segments(self, scores: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, float]]]:
        """Per row with a positive token: its segments, in tokens of the chunk."""
        good = np.flatnonzero(scores > 0)
        row = np.searchsorted(first, good, "right") - 1
        out = {}
        for r in np.unique(row).tolist():
            at = good[row == r]
            # runs of losing tokens between good ones count as one step
            gap = np.diff(at, prepend=at[0]) - 1
            steps: list[float] = []
            for g, s in zip(gap.tolist(), scores[at].tolist()):
                steps += [-DRIFT * max(g, 0), s]
            out[r] = [(int(at[a // 2]), int(at[(b - 1) // 2]) + 1, s) for a, b, s in maximal_segments(steps)]
        return out

    def expected(self, s: float, m: int) -> float:
        return self.k * m * math.exp(-min(self.decay * s, 700.0))

    def statistic(self, scores: list[float], m: int) -> float:
        """-log of the chance of segments as good as the best r, for the r that
        makes it largest: a sum T of r normalised scores has the tail
        exp(-T) T^(r-1) / (r! (r-1)!); one segment has the extreme-value tail."""
        if not scores or m == 0:
            return 0.0
        base = math.log(self.k * m)
        best = -math.log(max(-math.expm1(-self.expected(max(scores), m)), 1e-300))
        total, logs = 0.0, 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            total += self.decay * s - base
            if r > 1:
                logs += math.log(r) + math.log(r - 1)
                if total > r:
                    best = max(best, total - (r - 1) * math.log(total) + logs)
        return min(60.0, best)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -40, 40)))


def background(hist: np.ndarray, tail: np.ndarray) -> tuple[float, float]:
    """(lambda, K) from histograms of token scores (first: losing tokens) and
    of segment scores of the background, in steps of ``STEP``."""
    p = hist.astype(float)
    p[-1] += 1  # a best-scoring token is always possible
    p /= p.sum()
    values = np.concatenate([[-DRIFT], (np.arange(len(hist) - 1) + 0.5) * STEP])
    lo, hi = 0.0, 60.0 / STEP / len(hist) + 20.0
    for _ in range(100):
        mid = (lo + hi) / 2
        with np.errstate(over="ignore"):
            if float((p * np.exp(mid * values)).sum()) > 1:
                hi = mid
            else:
                lo = mid
    decay = max(lo, 1e-3)
    # segments at least as good as the middle one of the background
    n = tail.sum()
    if not n:
        return decay, 1.0 / max(1.0, hist.sum())
    mid = int(np.searchsorted(np.cumsum(tail), n / 2))
    return decay, float(tail[mid:].sum()) / max(1.0, hist.sum()) * math.exp(decay * mid * STEP)


def fit(train: DataFrame, corpus: DataFrame, bins: int = BINS) -> Model:
    """``train``: doc_id, text, y; ``corpus``: text of all documents."""
    train = C.written(train, "op7-train")

    def all_counts(batch, total):
        for c in C.chunks(batch.column(0)):
            total += np.bincount(units(c, bins)[0].ravel(), minlength=bins)

    def class_counts(batch, total):
        y = batch.column(1).to_numpy()
        for c in C.chunks(batch.column(0)):
            got, _, _, first = units(c, bins)
            one, row = _presence(got, first, bins)
            total += np.bincount(one + (y[c.rows][row] == 1) * bins, minlength=2 * bins)

    prior = _sums(corpus.select("text"), bins, all_counts)
    other, toxic = _sums(train.select("text", "y"), 2 * bins, class_counts).reshape(2, bins)
    table = log_odds(toxic, other, prior).astype(np.float32)
    model = Model(table)
    shared = train.sparkSession.sparkContext.broadcast(model)  # size set by the number of bins

    # one row per training document, and the background's histograms
    width = int(TOP / STEP) + 2
    long_tail = 40 * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        hist, tail = np.zeros(width, np.int64), np.zeros(long_tail, np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for c in C.chunks(batch.column(0)):
                got, _, _, first = units(c, bins)
                s = own.tokens(got)
                found = own.segments(s, first)
                best = [[x[2] for x in found.get(r, ())] for r in range(len(c))]
                clean = y[c.rows] != 1
                part = s[np.repeat(clean, np.diff(first))]
                hist += np.bincount(np.where(part > 0, 1 + part / STEP, 0).astype(int), minlength=width)
                ends = [x[2] for r, segs in found.items() if clean[r] for x in segs]
                tail += np.bincount(np.minimum(np.array(ends) / STEP, long_tail - 1).astype(int), minlength=long_tail) if ends else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(c), 1, np.int32)), pa.array(y[c.rows].astype(np.int64)), pa.array(np.diff(first).astype(np.int64)), pa.array(best, pa.list_(pa.float64()))],
                    names=["kind", "a", "b", "s"])
        for kind, h in ((2, hist), (3, tail)):
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(h[at]), pa.array([[]] * len(at), pa.list_(pa.float64()))], names=["kind", "a", "b", "s"])

    seen = C.written(train.select("text", "y").mapInArrow(run, "kind int, a long, b long, s array<double>"), "op7-training")
    hists = seen.filter("kind > 1").groupBy("kind", "a").agg(F.sum("b").alias("n")).collect()  # at most width + long_tail rows
    hist, tail = np.zeros(width), np.zeros(long_tail)
    for r in hists:
        (hist if r["kind"] == 2 else tail)[r["a"]] = r["n"]
    model.decay, model.k = background(hist, tail)

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, m, scores = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(round(8 * model.statistic(x, k))) for k, x in zip(m, scores)], pa.float64()), pa.array(y, pa.int64())], names=["x", "y"])

    model.table = np.zeros(0, np.float32)  # the closure needs lambda and K only
    pairs = (
        seen.filter("kind = 1").select("a", "b", "s").mapInArrow(statistics, "x double, y long").groupBy("x", "y").count().collect()
    )  # at most 2 x 481 rows
    model.table = table
    xs, ys, n = (np.array([float(r[c]) for r in pairs]) for c in ("x", "y", "count"))
    if len(set(ys.tolist())) < 2:
        share = (float(n[ys == 1].sum()) + 1) / (float(n.sum()) + 2) if len(ys) else 0.5
        model.offset = math.log(share / (1 - share))
    else:
        model.slope, model.offset = logistic(xs / 8, ys.astype(int), n)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all its columns) with score, predicted and segments: the
    significant segments' character spans and scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ("score", "predicted", "segments")
    names = [c for c in docs.columns if c not in new]
    docs = docs.select(*names)
    at = names.index("text")
    schema = T.StructType([
        *docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("segments", T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType())])))])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for c in C.chunks(batch.column(at)):
                got, starts, stops, first = units(c, len(own.table))
                found = own.segments(own.tokens(got), first)
                x, out = np.zeros(len(c)), [[] for _ in range(len(c))]
                for r, segs in found.items():
                    m = int(first[r + 1] - first[r])
                    x[r] = own.statistic([s for _, _, s in segs], m)
                    text = c.data[c.offsets[r] : c.offsets[r + 1]]
                    chars = np.cumsum((text & 0xC0) != 0x80)
                    for a, b, s in segs:
                        if own.expected(s, m) <= SIGNIFICANT:
                            lo, hi = int(starts[a] - c.offsets[r]), int(stops[b - 1] - c.offsets[r])
                            out[r].append({"start": int(chars[lo]) - 1, "stop": int(chars[hi - 1]), "score": s})
                p = own.score(x)
                part = batch.slice(int(c.rows[0]), len(c))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(p), pa.array((p >= CUT).astype(np.int32)), pa.array(out, spans)], names=[*names, *new])

    return docs.mapInArrow(run, schema)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns labels from rows whose crc32(doc_id as text) mod 4 is not 2; the
    prior's token counts are of all documents."""
    keep = fold("doc_id", 4) != 2
    return fit(labelled(docs.filter(keep), labels.filter(keep), "toxic"), docs)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


# no SQL: tested by held-out accuracy
QUERIES = {"op7_toxicity": (op7_toxicity, None)}
