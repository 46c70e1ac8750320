"""Version resolution and the reads on top of it.

Entries may carry any key and payload columns beside ``user_key``, ``seq`` and ``vtype``. The window form
keeps only the first row of each key before the exchange (Spark prunes top-1 windows map-side), so a key
with many versions does not become a hot task. Key predicates commute with resolution and reach the scan;
``vtype`` and value predicates do not and are applied after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.schema import VALUE


def as_of(entries: DataFrame, seq: int | Column | None) -> DataFrame:
    """Entries visible to a snapshot; None is the head."""
    return entries if seq is None else entries.where(F.col("seq") <= seq)


def newest(entries: DataFrame, key: str = "user_key") -> DataFrame:
    """Newest entry of every key, tombstones included."""
    w = Window.partitionBy(key).orderBy(F.col("seq").desc())
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve(entries: DataFrame, seq: int | None = None, key: str = "user_key") -> DataFrame:
    """Live rows at a snapshot: newest version of each key, keys whose newest version is a tombstone left out."""
    return newest(as_of(entries, seq), key).where(F.col("vtype") == VALUE)


def get(entries: DataFrame, value: object, seq: int | None = None, key: str = "user_key") -> DataFrame:
    """Zero or one row; the key predicate sits below the window and is pushed to the scan."""
    return resolve(entries.where(F.col(key) == F.lit(value)), seq, key)


def multi_get(entries: DataFrame, keys: DataFrame, seq: int | None = None, key: str = "user_key") -> DataFrame:
    return resolve(entries.join(keys.select(key).distinct(), key, "left_semi"), seq, key)


def versions(entries: DataFrame, value: object, key: str = "user_key") -> DataFrame:
    """Every stored version of one key; order by seq descending to list them newest first."""
    return entries.where(F.col(key) == F.lit(value))


def key_range(entries: DataFrame, lo: object = None, hi: object = None, key: str = "user_key") -> DataFrame:
    """Entries in a key range, both ends inclusive; None is unbounded."""
    if lo is not None:
        entries = entries.where(F.col(key) >= F.lit(lo))
    return entries if hi is None else entries.where(F.col(key) <= F.lit(hi))
