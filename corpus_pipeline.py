"""Corpus pipeline over ``documents``: quality filter, near-duplicate removal,
passage removal, source mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; ``run`` writes it as Parquet in the shared
checkpoint folder and reads it back as the next stage's ``docs``, so a lost
executor costs one stage's tasks at most.  All stages but the last return the
columns of ``docs``, whatever they are, as long as doc_id, text and (for the
mix) source are among them.

Edge cases: empty tables pass through; null ids and null texts are rows like
others (the quality model scores a null text as an empty one; a row of null id
is no near duplicate and loses no passage); rows of one id and text are one
document, and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import common as C
from ferrule.llm import op1_ngram_join as ngrams
from ferrule.llm import op5_quality as quality
from ferrule.llm import op8_mixing as mixing
from ferrule.llm import op9_bpe as bpe
from ferrule.llm import op10_substring_dedup as substrings


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    model = quality.quality_model(docs, C.table(spark, sf_dir, "labels"))
    # private names while the classifier adds its own columns
    names = docs.columns
    private = [c if c == "text" else f"_doc_{k}" for k, c in enumerate(names)]
    scored = quality.score(docs.toDF(*private), model).filter("predicted = 1")
    return scored.select(*private).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar five-word shingles."""
    gone = C.written(ngrams.join(docs.select("doc_id", "text")).filter("not kept").select("doc_id").distinct(), "pipeline-gone")
    maybe, rest = C.prefilter(docs, "doc_id", gone)
    return maybe.join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(rest.select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller id keeps."""
    spans = C.written(substrings.repeats(docs.select("doc_id", "text")), "pipeline-spans")
    return substrings.cleaned(docs, spans)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    keyed = C.written(docs.withColumn("_mix_key", F.monotonically_increasing_id()), "pipeline-keyed")
    rows = keyed.select(F.col("_mix_key").alias("key"), F.col("doc_id").alias("id"), "source", mixing.word_count("text").alias("size"))
    chosen, _ = mixing.mix_rows(C.written(rows, "pipeline-sizes"))
    times = chosen.filter("copies > 0").select(F.col("key").alias("_mix_key"), F.col("copies").alias("_mix_copies"))
    return (
        keyed.join(times, "_mix_key").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
        .select(*docs.columns)
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every row of the mix."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(bpe.VOCABULARY))


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing_sources", source_mix),
    ("byte_level_bpe", tokens),
]

# a trained classifier: not expressible in SQL, tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
