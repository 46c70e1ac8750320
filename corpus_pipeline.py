"""Corpus pipeline: documents to training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import jaccard, mixing, packing, pii, quality
from varve.llm.queries import OPEN_KEY, vocabulary_path
from varve.llm.text import table, word_count
from varve.session import few, stash

#: Near copies: five words, similarity 0.8 or more.
NGRAM, PERCENT = 5, 80
#: Rows of ids and counts that are broadcast at most.
FEW = 250_000


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; lines that a host repeats are removed."""
    return quality.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. Documents without words stay."""
    found, _ = stash(jaccard.groups(docs.select(F.col("doc_id").alias("id"), "text"), NGRAM, PERCENT).select("id", "t", "stays", (F.col("n_shingles") > 0).alias("some")), "groups")
    mark = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"))
    by = found.groupBy(F.struct(F.col("id").alias("i"), "t").alias("k")).agg(F.max("stays").alias("stays"), F.max("some").alias("some"), F.count(F.lit(1)).alias("n"))
    by, _ = stash(by, "marks")
    kept = docs.select(F.struct(*docs.columns).alias("_row"), mark.alias("_k")).join(few(by.where("not stays").select("k"), FEW), F.col("_k").eqNullSafe(F.col("k")), "left_anti")
    twice = by.where("stays and some and n > 1").select("k")
    if twice.limit(1).count():  # rows that are equal in id and text: one of them
        twice = few(twice, FEW)
        again = kept.join(twice, F.col("_k").eqNullSafe(F.col("k")), "left_semi").dropDuplicates(["_k"])
        kept = kept.join(twice, F.col("_k").eqNullSafe(F.col("k")), "left_anti").unionByName(again)
    return kept.select("_row.*")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the text. The key is the session's, or the open one for test tables."""
    out = pii.replace(docs, spark.conf.get(pii.SETTING, OPEN_KEY)).drop("n_entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized, _ = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("h")), "mixing")
    taken = mixing.mix(sized, size=F.col("words")).where("taken > 0")
    key = lambda h: F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"), h.alias("h"))
    # repeated rows are one document that is taken as often as they were together
    times, _ = stash(taken.groupBy(key(F.col("h")).alias("k")).agg(F.sum(F.expr("taken div size")).cast("int").alias("times")), "times")
    once = docs.select(F.struct(*docs.columns).alias("_row"), key(F.xxhash64("text")).alias("_k"))
    if sized.groupBy("doc_id", "source", "h").count().where("count > 1").limit(1).count():
        once = once.dropDuplicates(["_k"])
    joined = once.join(few(times, FEW), F.col("_k").eqNullSafe(F.col("k")))
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("times")))).select("_row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids."""
    return packing.pack(docs, vocabulary_path(packing.VOCABULARY))


STAGES = [("quality rules", rules), ("near copies", near_copies), ("personal data", surrogates), ("mixing", mixture), ("packing", sequences)]

#: Tokenisation and near copies by connected components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
