"""Global order without a single task: ranks, neighbours and nearest keys.

Rows are dealt to ranges of their order by split points from a bounded sample of the rows, taken by the hash
of all that orders them: rows weigh alike, so a key with many versions gets as many ranges as its rows need,
split by what orders rows of one key. The range of a row is an expression of its order, so every use of it
agrees. Windows run inside ranges, and one small row for each range carries what crosses its border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, RANGES = 4096, 64


def ranges(df: DataFrame, key: str, *ties: Column, n: int = RANGES) -> Column:
    """Range number of a row by its key, then ties (ascending); nulls go to the first range. Without ties keys must be few times the same."""
    place = F.struct(F.col(key).alias("k"), *[t.alias(f"t{i}") for i, t in enumerate(ties)])
    picked = df.where(F.col(key).isNotNull()).select(place.alias("p")).orderBy(F.xxhash64("p")).limit(SAMPLE)
    some = sorted({tuple(r[0]) for r in picked.collect()})
    if len(some) < 2 * n:
        n = max(1, len(some) // 2)
    cuts = [some[len(some) * k // n] for k in range(1, n)] if some else []
    if not cuts:
        return F.lit(0)
    kinds = picked.schema["p"].dataType.fields
    points = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kinds, strict=True)]) for c in cuts])
    return F.coalesce(F.when(F.col(key).isNotNull(), F.size(F.filter(points, lambda c: c <= place))), F.lit(0))


def running(df: DataFrame, amount: Column, key: str, *ties: Column, name: str) -> DataFrame:
    """df with the sum of amount over all rows before it by key, then ties (ascending)."""
    parts = df.withColumns({"_part": ranges(df, key, *ties), "_amount": amount.cast("long")})
    own = Window.partitionBy("_part").orderBy(F.col(key), *ties).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.groupBy("_part").agg(F.sum("_amount").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carried"))
    out = parts.withColumn("_in", F.coalesce(F.sum("_amount").over(own), F.lit(0))).join(F.broadcast(carry), "_part")  # a row for each of RANGES
    return out.withColumn(name, (F.col("_carried") + F.col("_in")).cast("long")).drop("_part", "_amount", "_carried", "_in")


def ranked(df: DataFrame, key: str, *ties: Column, name: str = "rank") -> DataFrame:
    """df with its 1-based global rank by key, then ties (ascending)."""
    return running(df, F.lit(1), key, *ties, name=name).withColumn(name, F.col(name) + 1)


def merged(runs: list[DataFrame], key: str = "user_key") -> DataFrame:
    """Rows of runs in one order, with ``run`` (a run's place in the list) and ``rank``: by key, of equal keys the earlier run first."""
    numbered = [r.withColumn("run", F.lit(k)) for k, r in enumerate(runs)]
    every = numbered[0]
    for r in numbered[1:]:
        every = every.unionByName(r)
    return ranked(every, key, F.col("run"))


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """df (unique keys) with ``prev_key`` and ``next_key``."""
    parts = df.withColumn("_part", ranges(df, key))
    w = Window.partitionBy("_part").orderBy(key)
    edge = parts.groupBy("_part").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    over = Window.orderBy("_part")
    edge = edge.select("_part", F.lag("_hi").over(over).alias("_left"), F.lead("_lo").over(over).alias("_right"))
    out = parts.withColumns({"prev_key": F.lag(key).over(w), "next_key": F.lead(key).over(w)}).join(F.broadcast(edge), "_part")
    return out.withColumns({"prev_key": F.coalesce("prev_key", "_left"), "next_key": F.coalesce("next_key", "_right")}).drop("_part", "_left", "_right")


def near(rows: DataFrame, probes: DataFrame, less: bool, allow_equal: bool, key: str = "user_key", probe: str = "probe") -> DataFrame:
    """(probe, found): nearest key before (less) or after each probe, null if there is none. Probes are distinct.

    Keys and probes are merged in order; the last key seen is the answer. No probe meets all keys.
    """
    kind = rows.schema[key].dataType
    # a key equal to the probe is seen before the probe exactly if it is allowed
    keys = rows.select(F.col(key).cast(kind).alias("_k")).distinct().select("_k", F.lit(0 if allow_equal else 1).alias("_tie"), F.col("_k").alias("_key"), F.lit(False).alias("_probe"))
    asks = probes.select(F.col(probe).cast(kind).alias("_k")).distinct().select("_k", F.lit(1 - (0 if allow_equal else 1)).alias("_tie"), F.lit(None).cast(kind).alias("_key"), F.lit(True).alias("_probe"))
    merged = keys.unionByName(asks)
    parts = merged.withColumn("_part", ranges(keys, "_k"))
    forward = (F.col("_k").asc(), F.col("_tie").asc()) if less else (F.col("_k").desc(), F.col("_tie").asc())
    w = Window.partitionBy("_part").orderBy(*forward).rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumn("_found", F.last("_key", ignorenulls=True).over(w)).where("_probe")
    edge = parts.groupBy("_part").agg((F.max("_key") if less else F.min("_key")).alias("_edge"))
    over = Window.orderBy(F.col("_part").asc() if less else F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select("_part", F.last("_edge", ignorenulls=True).over(over).alias("_carry"))
    return own.join(F.broadcast(carry), "_part").select(F.col("_k").alias(probe), F.coalesce("_found", "_carry").alias("found"))
