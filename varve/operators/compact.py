"""Compaction as a plan over entries: which versions survive, and where output files are cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.schema import DELETION


def retain(entries: DataFrame, oldest: int, deeper: Column | None = None, key: str = "user_key") -> DataFrame:
    """Entries that some snapshot at or above ``oldest`` can still read.

    Dropped: an entry behind a newer one that ``oldest`` already sees; and a tombstone that ``oldest`` sees
    while no deeper level may hold its key (deeper: true where one may).
    """
    w = Window.partitionBy(key).orderBy(F.col("seq").desc())
    newer = F.lag("seq").over(w)
    hidden = F.coalesce(F.col("_newer") <= oldest, F.lit(False))
    dead = (F.col("vtype") == DELETION) & (F.col("seq") <= oldest) & ~(F.lit(False) if deeper is None else deeper)
    return entries.withColumn("_newer", newer).where(~(hidden | dead)).drop("_newer")


def hull(files: DataFrame) -> DataFrame:
    """(lo, hi) of files (smallest_key, largest_key): ranges that hang together become one. Metadata: a few rows a file."""
    from varve.operators.files import overlap_groups

    one = files.select(F.lit(0).alias("level"), F.monotonically_increasing_id().alias("file_no"), "smallest_key", "largest_key")
    return overlap_groups(one).groupBy("grp").agg(F.min("smallest_key").alias("lo"), F.max("largest_key").alias("hi")).select("lo", "hi")


def may_be_deeper(entries: DataFrame, files: DataFrame, level: int, key: str = "user_key") -> DataFrame:
    """entries with ``deeper``: a file two or more levels below holds the key's range. By range, not by key.

    The ranges are merged to disjoint ones; keys and ranges are then merged in order, so no key meets all ranges.
    """
    from varve.operators.ordered import near

    spans = hull(files.where(F.col("level") >= level + 2))
    keys = entries.select(F.col(key).alias("probe")).distinct()
    next_end = near(spans.select(F.col("hi").alias("user_key")), keys, less=False, allow_equal=True)
    hit = next_end.join(spans, F.col("found") == F.col("hi")).where(F.col("lo") <= F.col("probe")).select(F.col("probe").alias("_p"), F.lit(True).alias("deeper"))
    return entries.join(hit, F.col(key) == F.col("_p"), "left").drop("_p").withColumn("deeper", F.coalesce("deeper", F.lit(False)))


def split_outputs(entries: DataFrame, size: Column, max_file: int, key: str = "user_key", cuts: list = ()) -> DataFrame:  # type: ignore[assignment]
    """entries with ``out_no``: output files by running bytes of whole keys, so no key is cut in two.

    Bytes are summed by key first; the running sum is over keys in ranges. cuts: keys behind which an output
    ends whatever its size, because it met enough of the level after next.
    """
    from varve.operators.ordered import running

    keyed = entries.groupBy(key).agg(F.sum(size).cast("long").alias("_bytes"))
    placed = running(keyed, F.col("_bytes"), key, name="_before")
    if not cuts:
        placed = placed.select(F.col(key).alias("_k"), F.floor(F.col("_before") / max_file).cast("long").alias("out_no"))
    else:
        points = F.array(*[F.lit(c).cast(entries.schema[key].dataType) for c in cuts])
        placed = placed.withColumn("_seg", F.size(F.filter(points, lambda c: c < F.col(key))))
        first = placed.groupBy("_seg").agg(F.min("_before").alias("_first"), F.sum("_bytes").alias("_all"))
        # files of the segments before; a row for each cut
        files = F.ceil(F.col("_all") / max_file)
        first = first.withColumn("_files", F.coalesce(F.sum(files).over(Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_all")
        placed = placed.join(F.broadcast(first), "_seg").select(F.col(key).alias("_k"), (F.col("_files") + F.floor((F.col("_before") - F.col("_first")) / max_file)).cast("long").alias("out_no"))
    return entries.join(placed, F.col(key) == F.col("_k")).drop("_k")


def split_rows(entries: DataFrame, size: Column, max_file: int, key: str = "user_key") -> DataFrame:
    """entries with ``out_no`` by running bytes in internal order: a key with many versions may go on in the next file."""
    from varve.operators.ordered import running

    return running(entries, size, key, -F.col("seq"), name="_before").withColumn("out_no", F.floor(F.col("_before") / max_file).cast("long")).drop("_before")


def grandparent_cuts(behind: list[tuple], limit: int) -> list:
    """Keys behind which an output ends. behind: (largest key, size) of the files two levels down, in order, from the first that the output can meet."""
    out, met = [], 0
    for largest, size in behind:
        met += size
        if met > limit:
            out.append(largest)
            met = 0
    return out


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "user_key") -> DataFrame:
    """(key, change) between the live rows of two snapshots: added, removed or changed."""
    a = old.select(F.col(key).alias("k"), F.col("seq").alias("sa"))
    b = new.select(F.col(key).alias("k"), F.col("seq").alias("sb"))
    change = F.when(F.col("sa").isNull(), "added").when(F.col("sb").isNull(), "removed").when(F.col("sa") != F.col("sb"), "changed")
    return a.join(b, "k", "full").withColumn("change", change).where("change is not null").select(F.col("k").alias(key), "change")
