"""Operator 2: secret scans through an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its content. A ledger row says that a blob
has been scanned under a version of the rules, and what was found, be it nothing. A scan takes one path of
every blob that the ledger does not know under this version, scans only those texts, appends their rows
and joins the findings back to all paths by the blob's address: copies are scanned once, and unchanged
texts never again.

``Ledger`` keeps the rows in a folder. An append is written beside and renamed into place, so it is there
whole or not at all; two scans that append at once may both hold a blob, with the same findings, and
readers take one. Paths are rows of any columns and ``text``; a history has a row for each version of each
path, so every version that ever was is scanned once.

Rules are patterns of Java's regular expressions. Matches are leftmost and do not overlap within a kind;
places are code points, the end exclusive. Spans are made from the pieces between the matches, so no
Python runs.

Defined results: a null text is the empty text; repeated rows each get their row; a row with a null id is
kept; an empty table gives no rows; columns of paths other than the text are passed, and ``blob`` and
``spans`` are replaced; a text of any length is scanned whole.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.session import stash

#: kind, pattern, group whose length counts, least length. The first three are the base rules.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("vcs", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
)
BASE = ("assign", "access", "hex")
VERSION = "rules-1"
#: Holds for every text with a match of any rule.
MAYBE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|-----BEGIN |gh[pousr]_|eyJ[A-Za-z0-9_-]{8}"

SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"
LEDGER = f"blob string, version string, spans {SPANS}"
#: Spans of findings that are broadcast at most.
FEW = 250_000


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def rule_spans(text: Column, rank: int) -> Column:
    """Spans of one rule, from what lies between its matches."""
    _, pattern, group, least = RULES[rank]
    rx = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    full = F.transform(F.regexp_extract_all(text, rx, F.lit(0)), lambda x: F.length(x).cast("long"))
    held = F.transform(F.regexp_extract_all(text, rx, F.lit(group)), lambda x: F.length(x).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))
    found = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), full.alias("full"), held.alias("held")),
        start,
        lambda acc, x: F.struct(
            (acc["at"] + F.coalesce(x["gap"], F.lit(0)) + F.coalesce(x["full"], F.lit(0))).alias("at"),
            F.when(
                x["held"] >= least,
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["gap"] + x["full"]).alias("end")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def spans_of(text: Column) -> Column:
    """All spans of a text by start, then kind as listed."""
    return F.array_sort(reduce(lambda a, b: F.concat(a, b), [rule_spans(text, k) for k in range(len(RULES))]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k, *_ in RULES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])), ",")


def unseen(paths: DataFrame, ledger: DataFrame | None, version: str = VERSION) -> DataFrame:
    """(blob): the addresses in paths that the ledger lacks under this version, each once. No text is shuffled."""
    blobs = paths.select(blob_id(F.col("text")).alias("blob")).distinct()
    return blobs if ledger is None else blobs.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")


def scan(paths: DataFrame, ledger: DataFrame | None = None, version: str = VERSION) -> DataFrame:
    """New ledger rows (blob, version, spans) of the unseen blobs, with empty spans where nothing was found. paths: with text."""
    todo, _ = stash(unseen(paths, ledger, version), "unseen")
    own = paths.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    maybe = F.col("text").rlike(MAYBE)
    once = lambda rows: rows.groupBy("blob").agg(F.first("text").alias("text"))  # noqa: E731 - copies meet before the exchange
    if ledger is None:  # everything is unseen
        texts = once(own.where(maybe))
    elif todo.limit(FEW + 1).count() <= FEW:  # only the new texts are looked at
        texts = once(own.join(F.broadcast(todo), "blob", "left_semi")).where(maybe)
    else:
        texts = once(own.where(maybe).join(todo, "blob", "left_semi"))
    found = texts.select("blob", spans_of(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    return todo.join(found, "blob", "left").select("blob", F.lit(version).alias("version"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def findings(paths: DataFrame, ledger: DataFrame, version: str = VERSION) -> DataFrame:
    """paths without text, with blob and spans, by the blob's address. ledger: stashed or stored."""
    rows = ledger.where((F.col("version") == version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select(F.col("blob").alias("_b"), F.col("spans").alias("_s"))
    if (rows.agg(F.sum(F.size("_s"))).first()[0] or 0) <= FEW:  # at most so many rows: a blob with a third of the paths is no hot key
        rows = F.broadcast(rows)
    names = [c for c in paths.columns if c not in ("text", "blob", "spans")]
    own = paths.select(*names, blob_id(F.col("text")).alias("blob"))
    return own.join(rows, F.col("blob") == F.col("_b"), "left").select(*names, "blob", F.coalesce("_s", F.array().cast(SPANS)).alias("spans"))


class Ledger:
    """A stored ledger: a folder with one Parquet folder for each append."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(at(self.path))] if fs.exists(at(self.path)) else []
        return sorted(f"{self.path}/{n}" for n in names if n.startswith("part-"))

    def read(self) -> DataFrame | None:
        """(blob, version, spans), or None before the first append."""
        parts = self._parts()
        return self.spark.read.schema(LEDGER).parquet(*parts) if parts else None

    def append(self, rows: DataFrame) -> None:
        at, name = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
        rows.select("blob", "version", "spans").write.parquet(f"{self.path}/_new-{name}")
        if not self._fs().rename(at(f"{self.path}/_new-{name}"), at(f"{self.path}/part-{name}")):
            raise OSError(f"can't append to {self.path}")

    def scan(self, paths: DataFrame, version: str = VERSION) -> DataFrame:
        """Scan what is unseen, append it, and give the findings of all paths."""
        self.append(scan(paths, self.read(), version))
        return findings(paths, self.read(), version)
