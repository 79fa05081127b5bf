"""Mixing sources to target weights by the cube method.

*Targets.*  A document's size is its number of words.  Sources, in code point
order with null last, weigh 3, 1, 2, repeating.  They share 150 % of all words
by weight; a target stops at twice its source's size and the excess is shared
again by weight until none is above.

*Sampling.*  Every document of a source is due ``target / source_size`` times:
the whole part surely, the rest with that probability.  The choice is balanced
by the cube method: inside a block of documents, the probabilities move along
directions that keep both sums, of probabilities and of probabilities times
sizes, until they are 0 or 1; three documents always leave such a direction.
Two at most stay open per block; the open ones of many blocks form new blocks,
until one block per source remains, whose last two are landed on the side
nearest to the target, and a few exchanges inside that block take up what they
can of the rest.  A source's taken words so differ from its target by less than the
sizes of two documents, mostly by a few words, and its documents from their
expected number by less than two.

Blocks are dealt by a hash, so a source with a third of all documents is many
blocks, and the work per block is bounded.  The choice depends on ids and sizes
alone: reruns agree.

Edge cases: a null text has size 0, and is taken 0 words; null ids and repeated
rows are documents of their own (rows equal in id, source and size are
exchanged freely, each row taken on its own); an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm import common as C

WEIGHTS, SHARE, LIMIT, SEED = (3, 1, 2), 1.5, 2.0, 8
BLOCK = 4096
CUTS = 256
ROUNDS, EXCHANGES = 200, 20


def word_count(text: str) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size; one row each) with ``place``, 0-based
    in code point order, null last.  Ranges cut at sampled values are counted,
    then numbered inside, so no task sees all sources."""
    sample = sources.filter("source is not null").orderBy(F.xxhash64("source")).limit(CUTS).select("source")
    cuts = sorted(r["source"].encode("utf-8") for r in sample.collect())  # at most CUTS values
    part = F.lit(0)
    if cuts:
        marks = F.array(*[F.lit(c.decode("utf-8")) for c in cuts])
        part = F.size(F.filter(marks, lambda m: m <= F.col("source")))
    ranged = sources.withColumn("_p", F.when(F.col("source").isNull(), F.lit(CUTS + 1)).otherwise(part))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: CUTS + 2 at most
    offsets = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_p").orderBy("source")
    return ranged.join(F.broadcast(offsets), "_p").withColumn(
        "place", F.col("_o") + F.row_number().over(inside) - 1).drop("_p", "_o")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``sources`` with ``target``.  Each round shares what the sources at
    their limit leave, by weight, among the others; only sums come to the
    driver."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = C.written(
        numbered(sources).select("source", "source_size", w.alias("weight"), (F.col("source_size") * float(limit)).alias("cap")),
        "op8-sources",
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # a source is at its limit if rate * weight >= cap; rates only rise
    rate, at_limit = 0.0, -1
    for _ in range(ROUNDS):
        full = F.col("cap") <= F.col("weight") * F.lit(rate) if at_limit >= 0 else F.lit(False)
        r = table.agg(
            F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n")).first()
        if r["n"] == at_limit or not r["open"]:
            break
        at_limit = r["n"]
        rate = (share * total - (r["caps"] or 0.0)) / r["open"]
    else:
        raise RuntimeError(f"targets did not settle in {ROUNDS} rounds")
    return table.withColumn("target", F.least("cap", F.col("weight") * F.lit(rate)))


def flight(p: np.ndarray, x: np.ndarray, seed: int) -> tuple[np.ndarray, list[int]]:
    """Moves probabilities to 0 or 1 keeping sum(p) and sum(p x); returns them
    and the positions still open, two at most.  Each move is up or down at
    random, so that every probability keeps its expectation."""
    chance = np.random.default_rng(seed).random(len(p)).tolist()
    p = p.tolist()
    x = [float(v) for v in x.tolist()]
    eps = 1e-9
    held: list[int] = []
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        if len(held) == 2:
            a, b = held
            if x[a] == x[b]:  # equal sizes balance each other
                da, db = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
                if chance[i] * (da + db) < db:
                    p[a], p[b] = p[a] + da, p[b] - da
                else:
                    p[a], p[b] = p[a] - db, p[b] + db
        elif len(held) == 3:
            a, b, c = held
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(held, u) if v)
            down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(held, u) if v)
            t = up if chance[i] * (up + down) < down else -down
            for k, v in zip(held, u):
                p[k] += t * v
        still = []
        for k in held:
            if p[k] <= eps or p[k] >= 1 - eps:
                p[k] = float(round(p[k]))
            else:
                still.append(k)
        held = still
    return np.array(p), held


def _landing(p: np.ndarray, x: np.ndarray, open_: list[int], want: float) -> np.ndarray:
    """The open probabilities set to 0 or 1, nearest to the sum ``want``; then
    exchanges of a taken and an untaken unit, each the one that comes nearest to
    it, while they help."""
    rest = want - float((p * x).sum()) + sum(p[k] * x[k] for k in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(x[k] for b, k in enumerate(open_) if m >> b & 1) - rest), m))
    out = p.copy()
    for b, k in enumerate(open_):
        out[k] = float(best >> b & 1)
    for _ in range(EXCHANGES):
        miss = want - float((out * x).sum())
        ones, zeros = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
        if not miss or not len(ones) or not len(zeros):
            break
        zeros = zeros[np.argsort(x[zeros], kind="stable")]
        sizes = x[zeros]
        place = np.clip(np.searchsorted(sizes, x[ones] + miss), 1, len(sizes)) - 1
        options = np.stack([place, np.minimum(place + 1, len(sizes) - 1)])
        left = np.abs(sizes[options] - x[ones] - miss)
        at = np.unravel_index(int(np.argmin(left)), left.shape)
        if left[at] >= abs(miss):
            break
        out[ones[at[1]]], out[zeros[options[at]]] = 0.0, 1.0
    return out


def _fly(units: DataFrame) -> DataFrame:
    """One flight in every block, and the landing of the groups of one block.
    ``units``: key, grp, block, p, x, tie, land."""

    def run(t: pa.Table) -> pa.Table:
        key, tie, x, p = (t.column(c).to_numpy() for c in ("key", "tie", "x", "p"))
        order = np.lexsort((key, x, tie))
        key, tie, x, p = key[order], tie[order], x[order], p[order]
        q, open_ = flight(p, x, int(np.bitwise_xor.reduce(tie)) & 0xFFFFFFFF)
        land = t.column("land")[0].as_py()
        if land:
            q = _landing(q, x, open_, float((p * x).sum()))
        grp, block = (np.full(len(key), t.column(c)[0].as_py()) for c in ("grp", "block"))
        return pa.table({"key": key, "grp": grp, "p": q, "x": x, "tie": tie, "block": block.astype(np.int32), "land": np.full(len(key), land)})

    # dealt by source and block: what came before may have dealt by source alone,
    # which would leave a hot source's blocks in one task
    return units.repartition("grp", "block").groupBy("grp", "block").applyInArrow(
        run, "key long, grp long, p double, x long, tie long, block int, land boolean")


def choose(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, extra): 1 for the units taken.  ``units``: key (unique long), grp
    (long), p (in [0, 1)), x (long), tie (long: a hash)."""
    sure = []
    # each group lands in the round in which it fits one block; of a larger one,
    # the decided units of a first block wait as partners for exchanges
    names = ("key", "grp", "p", "x", "tie", "waits")
    now = units.withColumn("waits", F.lit(False))
    while True:
        sizes = now.groupBy("grp").agg(F.count_if(~F.col("waits")).alias("_m"))
        blocks = sizes.select("grp", F.greatest(F.ceil(F.col("_m") / block), F.lit(1)).cast("int").alias("_n"))
        dealt = now.join(blocks, "grp").withColumn("land", F.col("_n") == 1).withColumn(
            "block", F.pmod(F.xxhash64("tie", F.lit(len(sure))), F.col("_n")).cast("int"))
        last = (sizes.agg(F.max("_m")).first()[0] or 0) <= block
        flown = C.written(
            _fly(dealt.filter("land or not waits").select("key", "grp", "block", "p", "x", "tie", "land")), f"op8-flight{len(sure)}")
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        wait = whole & ~F.col("land") & (F.col("block") == 0) if not sure else F.lit(False)
        sure.append(flown.filter(whole & ~wait).select("key", F.col("p").cast("int").alias("extra")))
        if last:
            break
        waiting = flown.filter(wait) if len(sure) == 1 else dealt.filter("waits and not land")
        now = flown.filter(~whole).withColumn("waits", F.lit(False)).select(*names).unionByName(
            waiting.withColumn("waits", F.lit(True)).select(*names))
    out = sure[0]
    for s in sure[1:]:
        out = out.union(s)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows, targets).  rows: key (a number of this run's rows), id, source,
    size, source_size, target, copies (times the document is taken)."""
    rows = C.written(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
        .withColumn("key", F.monotonically_increasing_id()),
        "op8-rows",
    )
    return mix_rows(rows, weights, share, limit)


def mix_rows(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> tuple[DataFrame, DataFrame]:
    """As ``mix``, from written rows of key, id, source, size."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = C.written(
        targets(sources, weights, share, limit)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("grp", F.xxhash64("source")),
        "op8-targets",
    )
    cond = rows["source"].eqNullSafe(goal["source"])
    due = rows.join(goal, cond).select(
        "key", "id", rows["source"], "size", "source_size", "target", "grp",
        F.floor(F.col("rate") + 1e-12).cast("int").alias("base"),
        F.greatest(F.col("rate") - F.floor(F.col("rate") + 1e-12), F.lit(0.0)).alias("p"),
    )
    units = due.filter("size > 0").select("key", "grp", "p", F.col("size").alias("x"), F.xxhash64("id", "size", F.lit(SEED)).alias("tie"))
    extra = choose(units)
    rows = due.join(extra, "key", "left").select(
        "key", "id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("base") + F.coalesce("extra", F.lit(0))).otherwise(0).alias("copies"))
    return rows, goal


def op8_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(C.table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# no SQL for the sampling: tested for balance, and its targets against a plain loop
QUERIES = {"op8_balanced_mix": (op8_balanced_mix, None)}
