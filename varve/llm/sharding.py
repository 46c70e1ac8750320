"""Operator 1: sharding through a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table (offset and skip from
two digests of its name). The shards take turns; in its turn a shard claims the first free slot of its
order, until the table is full. A row's key is hashed to a slot, and one broadcast of the table (its size
is the fixed prime) gives the shard. Removing a shard moves little more than that shard's own keys.

Everything is DataFrame code: the table is filled by one ``aggregate`` over the turns.

Defined results: a null key is placed as the empty string; repeated rows get the same shard; an empty
table gives no rows; other columns pass through, and one that is called ``slot`` or ``shard`` is replaced.
No shards, or a table size that is no prime or smaller than the number of shards, raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters of the query: table size (prime, over 100 slots for a shard) and shards.
TABLE_SIZE = 2053
SHARDS = 16


def digest(text: Column) -> Column:
    """60 bits of MD5 as a long: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shard_names(spark: SparkSession, n: int = SHARDS) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("shard"), F.concat(F.lit("shard-"), F.col("id")).alias("name"))


def lookup_table(shards: DataFrame, size: int = TABLE_SIZE) -> DataFrame:
    """(slot long, shard int), one row for each of ``size`` slots. shards: (shard int, name string)."""
    n = shards.count()
    if n == 0 or n > size or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} slots, {n} shards: a prime of at least the number of shards (at least 1) is needed")
    order = shards.select(
        "shard",
        F.pmod(digest(F.concat(F.lit("offset:"), "name")), F.lit(size)).cast("int").alias("at"),
        (F.pmod(digest(F.concat(F.lit("skip:"), "name")), F.lit(size - 1)) + 1).cast("int").alias("skip"),
    )
    one = order.agg(F.array_sort(F.collect_list(F.struct("shard", "at", "skip"))).alias("s"))
    empty = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda _: F.lit(-1))
    tries = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda _: F.lit(0))

    def turn(acc, t):
        s = F.get(F.col("s"), F.pmod(t, F.lit(n)))
        slot_at = lambda j: F.pmod(s["at"].cast("long") + j.cast("long") * s["skip"], F.lit(size)).cast("int")
        seen = F.get(acc["tries"], F.pmod(t, F.lit(n)))
        free = F.get(F.filter(F.sequence(seen, F.lit(size - 1)), lambda j: F.get(acc["table"], slot_at(j)) == -1), F.lit(0))
        # element by element: the claimed slot gets the shard, and the shard's place in its order moves on
        claim = F.transform(F.array(free), lambda j: F.struct(slot_at(j).alias("slot"), j.alias("j")))
        return F.get(
            F.transform(
                claim,
                lambda c: F.struct(
                    F.transform(acc["table"], lambda v, i: F.when(i == c["slot"], s["shard"]).otherwise(v)).alias("table"),
                    F.transform(acc["tries"], lambda v, i: F.when(i == F.pmod(t, F.lit(n)), c["j"] + 1).otherwise(v)).alias("tries"),
                ),
            ),
            F.lit(0),
        )

    filled = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.struct(empty.alias("table"), F.slice(tries, 1, n).alias("tries")), turn)
    return one.select(F.posexplode(filled["table"]).alias("slot", "shard")).select(F.col("slot").cast("long").alias("slot"), "shard")


def assign(df: DataFrame, key: str, table: DataFrame, size: int = TABLE_SIZE) -> DataFrame:
    """df with ``slot`` and ``shard``. The table's size bounds what is broadcast."""
    slot = F.pmod(digest(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), F.lit(size).cast("long"))
    keep = df.drop("slot", "shard") if key not in ("slot", "shard") else df.withColumnRenamed(key, key)
    return keep.withColumn("slot", slot).join(F.broadcast(table), "slot").select(*keep.columns, "slot", "shard")
