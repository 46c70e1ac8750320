"""Spark sources and sinks for byte-format files: each file is read or made by one Arrow batch task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from varve.schema import ENTRY
from varve.sources import codec

_NAMES = ["user_key", "seq", "vtype", "value"]


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _NAMES)


def read_tables(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Entries of table files; a bad file raises Corruption."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = []
                for ikey, value in codec.decode_table(raw, verify):
                    got = codec.parse_internal(ikey)
                    if got is None:
                        raise codec.Corruption("bad internal key")
                    rows.append((*got, value if got[2] else None))
                    if len(rows) >= 50_000:
                        yield _entries(rows)
                        rows = []
                yield _entries(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ENTRY)


def log_damage(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, reason) of what readers of these logs have to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                drops: list[tuple[int, str]] = []
                for _ in codec.decode_log(raw, drops):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(drops), pa.string()), pa.array([n for n, _ in drops], pa.int64()), pa.array([w for _, w in drops], pa.string())], ["path", "bytes", "reason"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, bytes long, reason string")


def read_logs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Entries of write-ahead logs, batches applied with their sequence numbers; damaged records are left out (strict: raise Corruption), see ``log_damage``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                drops: list[tuple[int, str]] = []
                for record in codec.decode_log(raw, drops):
                    yield _entries(codec.decode_batch(record))
                if strict and drops:
                    raise codec.Corruption(f"damaged log: {drops}")

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ENTRY)


def table_blobs(entries: DataFrame, group: str, block_size: int = codec.BLOCK_SIZE) -> DataFrame:
    """(group, content): a table file for each group of entries, in internal order. Groups are output files of bounded size."""

    def make(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in _NAMES), strict=True), key=lambda r: (r[0], -r[1]))
        raw = codec.encode_entries(rows, block_size)
        return pa.table({group: t.column(group)[:1], "content": pa.array([raw], pa.binary())})

    kind = entries.schema[group].dataType.simpleString()
    return entries.select(group, *_NAMES).groupBy(group).applyInArrow(make, f"{group} {kind}, content binary")
