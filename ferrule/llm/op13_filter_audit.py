"""Filter interaction audit by a recursive CTE over filter prefixes.

Five filters (A: few words, B: few distinct words, C: many capitals, D: odd
signs, E: a copy of an earlier text) are applied in every order; the audit tells
for each order and step what that filter keeps, removes, and would have removed.

1. Every document becomes a *mask* of the filters it fails (bit k: letter k),
   in column expressions.  E needs the smallest id of each text: texts are
   told apart by their SHA-256, the smallest id is a partial aggregate, and a
   row fails E unless (digest, id) is that pair, an equi-join on both columns,
   so rows of one hot text spread over all tasks.
2. Documents are counted in *cells* (part, mask, good, toxic): at most 128 a part.
3. A step's figures depend on the part, the set of filters applied before, and
   the filter alone.  Each cell answers for the 80 pairs of such a set and a
   filter outside it; sums over the cells give (part, applied, letter).
4. The recursive CTE starts at the empty prefix of each part and extends
   prefixes with letters whose bit is not applied yet, joining the cells of
   (part, applied, letter) and carrying the applied bits; each level emits the
   figures of its step, 325 prefixes a part.
5. The 120 full orders take their five steps by their prefixes; the Shapley sums
   weigh a prefix by the number of orders that continue it.

Only cells meet the recursion, so its size depends on the parts and not on the
documents.  Spark limits a recursion's rows; the audit lifts that limit while it
writes its result, as there are 326 rows a part.

Edge cases: a null text is empty (no words: fails A only, or E too); a null source
is the part ''; a row of null id is never a copy of an earlier one and has no
labels; rows of one id and text are equal copies of themselves, not of a smaller
id; several labels of one id count as good or toxic if any of them is 1; null
labels count as 0.  Very long texts are read whole.  Other columns, whatever
their names, play no part.  An empty table gives no row.
"""

from __future__ import annotations

import itertools
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import common as C

LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_filters(text: Column) -> list[Column]:
    """Failure conditions of A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 2 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_filters(F.col("text")))), F.lit(0))
    rows = C.written(
        docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
        .select("id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest")),
        "op13-facts",
    )
    firsts = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    return (
        rows.join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
        .select("part", (F.col("bits") + F.when(copy, 16).otherwise(0)).alias("mask"),
                F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    )


def steps(cells: DataFrame) -> DataFrame:
    """Figures of (part, applied, letter) for every set of applied filters and
    every filter outside it, from cells (part, mask, good, toxic, n)."""
    pairs = F.array(*[
        F.struct(F.lit(s).alias("applied"), F.lit(1 << k).alias("bit"), F.lit(letter).alias("letter"))
        for s in range(32) for k, letter in enumerate(LETTERS) if not s >> k & 1
    ])
    spread = cells.select("*", F.explode(pairs).alias("p")).select("part", "mask", "good", "toxic", "n", "p.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("applied")) != 0
    here = fails & ~gone

    def total(cond: Column, name: str) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long").alias(name)

    return spread.groupBy("part", "applied", "letter", "bit").agg(
        total(~fails & ~gone, "kept"), total(here, "removed"), total(fails & gone, "redundant"),
        total(F.col("mask") == F.col("bit"), "unique_fails"), total(here & (F.col("good") == 1), "good_lost"),
        total(here & (F.col("toxic") == 1), "toxic_lost"))


WALK = """WITH RECURSIVE walk(part, prefix, applied, step, {figures}) AS (
  SELECT DISTINCT part, '', 0, 0, {zeros} FROM {cells}
  UNION ALL
  SELECT w.part, concat(w.prefix, c.letter), w.applied | c.bit, w.step + 1, {values}
  FROM walk w JOIN {cells} c ON c.part = w.part AND c.applied = w.applied AND (w.applied & c.bit) = 0
  WHERE w.step < 5
)
SELECT * FROM walk WHERE step > 0"""


def walk(step_cells: DataFrame) -> DataFrame:
    """One row per part and prefix of an order, with the figures of its last
    step.  Written at once, as the recursion's row limit is lifted meanwhile."""
    spark = step_cells.sparkSession
    view = f"op13_cells_{uuid.uuid4().hex}"
    before = spark.conf.get(ROW_LIMIT, None)
    step_cells.createOrReplaceTempView(view)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return C.written(spark.sql(WALK.format(
            cells=view, figures=", ".join(FIGURES), zeros=", ".join(["CAST(0 AS BIGINT)"] * len(FIGURES)),
            values=", ".join(f"c.{x}" for x in FIGURES))), "op13-walk")
    finally:
        spark.catalog.dropTempView(view)
        if before is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, before)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    spark = docs.sparkSession
    cells = masked(docs, labels).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    found = walk(C.written(steps(cells), "op13-steps"))
    orders = ["".join(p) for p in itertools.permutations(LETTERS)]
    # 120 orders x 5 steps
    places = spark.createDataFrame(
        [(o, k, o[:k]) for o in orders for k in range(1, 6)], "filter_order string, step int, prefix string")
    letter = F.substring("prefix", -1, 1)
    follow = F.element_at(F.array(*[F.lit(math.factorial(5 - k)) for k in range(1, 6)]), F.col("step").cast("int"))
    shapley = found.groupBy("part", letter.alias("letter")).agg(F.sum(F.col("removed") * follow).cast("long").alias("shapley"))
    return (
        found.drop("step", "applied").join(F.broadcast(places), "prefix").withColumn("letter", letter)
        .join(shapley, ["part", "letter"]).select("part", "filter_order", "step", *FIGURES, "shapley")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


SQL = r"""WITH d AS (
SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d
), fails AS (
SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
       100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
       regexp_matches(text, '[#$%&*|]') AS d, doc_id IS NOT NULL AND doc_id > first_id AS e
FROM words
), marks AS (
SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic
FROM labels GROUP BY doc_id
), cells AS (
SELECT part, [a, b, c, d, e] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (
SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) AS t(l, k)
), orders AS (
SELECT concat(p.l, q.l, r.l, s.l, t.l) AS filter_order, [p.k, q.k, r.k, s.k, t.k] AS ks
FROM letters p, letters q, letters r, letters s, letters t
WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5
), applied AS (
SELECT part, filter_order, step, n, good, toxic, f[ks[step]] AS bad,
       list_bool_or(list_transform(ks[1:step - 1], lambda k: f[k])) IS TRUE AS gone,
       list_sum(list_transform(f, lambda x: CAST(x AS INTEGER))) = 1 AS alone, ks[step] AS k
FROM cells, orders, range(1, 6) AS r(step)
), figures AS (
SELECT part, filter_order, CAST(step AS INTEGER) AS step, any_value(k) AS k,
       CAST(coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (bad AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (bad AND alone), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(n) FILTER (bad AND NOT gone AND good = 1), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(n) FILTER (bad AND NOT gone AND toxic = 1), 0) AS BIGINT) AS toxic_lost
FROM applied GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM figures"""

QUERIES = {"op13_filter_audit": (op13_filter_audit, SQL)}
