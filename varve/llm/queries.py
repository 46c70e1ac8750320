"""The driver's queries of these operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import html, jaccard, lm, mixing, neighbours, packing, pii, quality, secrets, sharding
from varve.llm.oracles import ORACLES
from varve.llm.text import table, word_count
from varve.session import shared_dir, stash


#: Not secret: so that the query and the pipeline on test tables give the same rows anywhere. Real data needs pii.SETTING.
OPEN_KEY = "test tables only"


def vocabulary_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = sharding.lookup_table(sharding.shard_names(spark))
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", slots)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    # a ledger of this call's own: a query's result must not hang on what ran before it
    found = secrets.Ledger(spark, f"{shared_dir(spark)}/varve/ledger-{uuid.uuid4().hex}").scan(paths)
    base = F.filter("spans", lambda x: x["rank"] < len(secrets.BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        "blob",
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("host"), "text")
    found, _ = stash(quality.features(docs), "quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "removed_chars"]
    return quality.judge(found).select(F.col("id").alias("doc_id"), *names)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return lm.score(docs).withColumnRenamed("id", "doc_id")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = stash(neighbours.usable(table(spark, sf_dir, "embeddings")), "vectors")
    return neighbours.search(rows, rows.where(F.col("id") % 20 == 0))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return jaccard.groups(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "rep")


def op7_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary or vocabulary_path(packing.VOCABULARY))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(pii.SETTING, OPEN_KEY))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    sized, _ = stash(docs, "mixing")
    return mixing.mix(sized, size=F.col("words")).drop("words")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_secrets, op3_quality, op4_lm, op5_neighbours, op6_jaccard, op7_packing, op8_pii, op9_html, op10_mixing)}
