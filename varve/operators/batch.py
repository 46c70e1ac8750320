"""Write batches: a batch is a frame of (pos, vtype, user_key, value) whose i-th operation gets sequence base + i."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.operators.ordered import ranked
from varve.schema import DELETION, VALUE

#: Header of an encoded batch: sequence and count.
HEADER = 12
#: Group commit limits in bytes: most of a group, and what a small first batch may grow by.
GROUP_LIMIT, SMALL_FIRST = 1 << 20, 128 << 10


def puts(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    return df.select(F.col(pos).alias("pos"), F.lit(VALUE).alias("vtype"), F.col(key).alias("user_key"), F.col(value).alias("value"))


def deletes(df: DataFrame, key: str, pos: str, like: DataFrame) -> DataFrame:
    """Tombstones; blind, no key is looked up first. like: a frame with the value's type."""
    return df.select(F.col(pos).alias("pos"), F.lit(DELETION).alias("vtype"), F.col(key).alias("user_key"), F.lit(None).cast(like.schema["value"].dataType).alias("value"))


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """Operations of right behind those of left; the left batch keeps its sequence."""
    n = F.broadcast(left.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("_n")))
    return left.unionByName(right.join(n).withColumn("pos", F.col("pos") + F.col("_n")).drop("_n"))


def apply(ops: DataFrame, base: int) -> DataFrame:
    """Entries of a batch in one atomic frame: seq = base + place of the operation."""
    return ranked(ops, "pos", name="_r").select("user_key", (F.col("_r") + F.lit(base - 1)).alias("seq"), "vtype", "value")


def varint_length(n: Column) -> Column:
    """Bytes of n as a base-128 varint."""
    out = F.lit(9)  # a signed 64-bit number has 63 bits
    for k in range(8, 0, -1):
        out = F.when(n < F.lit(1 << (7 * k)), k).otherwise(out)
    return out


def encoded_size(key_len: Column, value_len: Column, vtype: Column) -> Column:
    """Bytes of one operation in an encoded batch."""
    body = varint_length(key_len) + key_len
    return 1 + body + F.when(vtype == VALUE, varint_length(value_len) + value_len).otherwise(0)


def group_commit(batches: DataFrame, limit: int = GROUP_LIMIT, small: int = SMALL_FIRST) -> DataFrame:
    """(queue, pos, size, sync, group_no) of queued batches (queue, pos, size, sync): what is committed together.

    A group takes the batches behind its first while their bytes stay within ``limit``, or within the first's
    own and ``small`` if that is no bigger than ``small``; a synced batch never joins a group that is not
    synced. Where a group ends depends on all before it, so each queue is one fold in the order of pos that
    holds one group's numbers; queues are dealt out.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, number, total, most, synced = object(), 0, 0, 0, False
        for b in parts:
            out = []
            for q, size, sync in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                fits = q == queue and total + size <= most and not (sync and not synced)
                if fits:
                    total += size
                else:
                    number = number + 1 if q == queue else 0
                    queue, total, synced = q, size, bool(sync)
                    most = size + small if size <= small else limit
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "group_no"])

    kinds = ", ".join(f"{c} {batches.schema[c].dataType.simpleString()}" for c in ("queue", "pos", "size", "sync"))
    rows = batches.select("queue", "pos", "size", "sync").repartition("queue").sortWithinPartitions("queue", "pos")
    return rows.mapInArrow(fold, f"{kinds}, group_no long")


def room_for_write(level0_files: int, memtable_full: bool, immutable_pending: bool, slowdown: int = 8, stop: int = 12, delayed: bool = False) -> str:
    """What a writer does next: 'delay', 'write', 'wait' or 'rotate'."""
    if level0_files >= slowdown and not delayed:
        return "delay"
    if not memtable_full:
        return "write"
    return "wait" if immutable_pending or level0_files >= stop else "rotate"
