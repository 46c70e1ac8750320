"""File metadata: zone maps of runs, levels, overlaps, scores, sizes. All frames are (level, file_no, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LEVELS, LEVEL0_TRIGGER = 7, 4
LEVEL1_BYTES, LEVEL_GROWTH = 64 << 20, 10
MAX_FILE = 2 << 20
SEEK_COST, LEAST_SEEKS = 16 << 10, 100


def file_meta(entries: DataFrame, size: Column) -> DataFrame:
    """Zone map of each run. entries: (level, file_no, user_key, seq); size: bytes of an entry.

    The smallest internal key is the newest version of the smallest key; the largest the oldest of the largest.
    """
    order = F.struct("user_key", -F.col("seq"))
    return entries.groupBy("level", "file_no").agg(
        F.sum(size).cast("long").alias("file_size"),
        F.count(F.lit(1)).alias("n_entries"),
        F.min("user_key").alias("smallest_key"),
        F.min_by("seq", order).alias("smallest_seq"),
        F.max("user_key").alias("largest_key"),
        F.max_by("seq", order).alias("largest_seq"),
    )


def overlaps(lo: Column, hi: Column) -> Column:
    """A file's range meets [lo, hi]."""
    return (F.col("largest_key") >= lo) & (F.col("smallest_key") <= hi)


def level_counts(m: DataFrame, levels: int = MAX_LEVELS) -> DataFrame:
    """(level, n_files, bytes), levels without files too."""
    all_levels = m.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    per = m.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("bytes"))
    return all_levels.join(per, "level", "left").select("level", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def level_score(m: DataFrame, level1_bytes: int = LEVEL1_BYTES, levels: int = MAX_LEVELS) -> DataFrame:
    """(level, score): files against the trigger at level 0, bytes against the level's budget below; the last level has none."""
    budget = F.lit(float(level1_bytes)) * F.pow(F.lit(float(LEVEL_GROWTH)), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("n_files") / F.lit(float(LEVEL0_TRIGGER))).otherwise(F.col("bytes") / budget)
    return level_counts(m, levels).where(F.col("level") < levels - 1).select("level", score.alias("score"))


def compaction_level(m: DataFrame, level1_bytes: int = LEVEL1_BYTES) -> DataFrame:
    """(level, score, needed) of the level to compact: highest score, the lower level on ties."""
    return level_score(m, level1_bytes).agg(F.max(F.struct("score", (-F.col("level")).alias("minus"))).alias("b")).select((-F.col("b.minus")).alias("level"), "b.score", (F.col("b.score") >= 1).alias("needed"))


def find_file(m: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, file_no): first file of a level of disjoint files whose largest key is at or behind the probe."""
    from varve.operators.ordered import near

    found = near(m.select(F.col("largest_key").alias("user_key")), probes, less=False, allow_equal=True)
    return found.join(m.select(F.col("largest_key").alias("found"), "file_no"), "found", "left").select("probe", "file_no")


def overlap_step(m: DataFrame, lo: object, hi: object) -> DataFrame:
    """(lo, hi) of one widening: the union of [lo, hi] and all files that meet it."""
    hit = m.where(overlaps(F.lit(lo), F.lit(hi)))
    return hit.agg(F.least(F.min("smallest_key"), F.lit(lo)).alias("lo"), F.greatest(F.max("largest_key"), F.lit(hi)).alias("hi"))


def overlap_groups(m: DataFrame) -> DataFrame:
    """m with ``grp``: files of a level whose ranges hang together (the fixed point of widening for each file)."""
    w = Window.partitionBy("level").orderBy("smallest_key", "file_no")
    before = F.max("largest_key").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = m.withColumn("_new", F.when(before.isNull() | (F.col("smallest_key") > before), 1).otherwise(0))
    return starts.withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def next_level_overlap(m: DataFrame) -> DataFrame:
    """(level, file_no, bytes): bytes of the next level that each file meets. m is metadata: thousands of rows, not data."""
    up, down = m.alias("a"), m.alias("b")
    cond = (F.col("b.level") == F.col("a.level") + 1) & (F.col("b.largest_key") >= F.col("a.smallest_key")) & (F.col("b.smallest_key") <= F.col("a.largest_key"))
    return up.join(down, cond, "left").groupBy("a.level", "a.file_no").agg(F.coalesce(F.sum("b.file_size"), F.lit(0)).cast("long").alias("bytes"))


def flush_level(m: DataFrame, lo: object, hi: object, deepest: int = 2, limit: int = 10 * MAX_FILE) -> DataFrame:
    """(level) where a flushed run of range [lo, hi] is put: down to ``deepest`` while nothing is in the way."""
    hit = m.where(overlaps(F.lit(lo), F.lit(hi))).groupBy("level").agg(F.sum("file_size").alias("bytes"))
    blocked = F.min(F.when(F.col("level") == 0, 0).when(F.col("level") <= deepest, F.col("level") - 1))
    heavy = F.min(F.when((F.col("level") >= 2) & (F.col("bytes") > limit), F.col("level") - 2))
    return hit.agg(blocked.alias("b"), heavy.alias("h")).select(F.greatest(F.lit(0), F.least(F.coalesce("b", F.lit(deepest)), F.coalesce("h", F.lit(deepest)), F.lit(deepest))).cast("int").alias("level"))


def range_size(blocks: DataFrame, lo: object, hi: object) -> DataFrame:
    """(bytes) stored in [lo, hi): bytes before hi less bytes before lo, never negative. blocks: (user_key, size)."""
    before = lambda k: F.coalesce(F.sum(F.when(F.col("user_key") < F.lit(k), F.col("size"))), F.lit(0))
    return blocks.agg(F.greatest(F.lit(0), before(hi) - before(lo)).cast("long").alias("bytes"))


def fold_edits(edits: DataFrame) -> DataFrame:
    """(level, file_no) alive after edits (edit_id, action, level, file_no): the last action wins, an addition over a deletion of the same edit."""
    last = F.max_by("action", F.struct("edit_id", F.when(F.col("action") == "add", 1).otherwise(0)))
    return edits.groupBy("level", "file_no").agg(last.alias("action")).where("action = 'add'").select("level", "file_no")


def disjoint_violations(m: DataFrame) -> DataFrame:
    """Files below level 0 that begin at or before the end of their left neighbour: none in a sound version."""
    w = Window.partitionBy("level").orderBy("smallest_key", "file_no")
    return m.where("level > 0").withColumn("_left", F.lag("largest_key").over(w)).where("_left >= smallest_key").drop("_left")


def boundary_files(m: DataFrame, chosen: DataFrame) -> DataFrame:
    """(file_no) of files whose smallest key is the largest key of a chosen file, in an older version."""
    c = chosen.select(F.col("level").alias("l"), F.col("largest_key").alias("k"), F.col("largest_seq").alias("s"))
    hit = m.join(c, (F.col("level") == F.col("l")) & (F.col("smallest_key") == F.col("k")) & (F.col("smallest_seq") < F.col("s")), "left_semi")
    return hit.join(chosen.select("level", "file_no"), ["level", "file_no"], "left_anti").select("file_no")


def trivial_moves(m: DataFrame, limit: int) -> DataFrame:
    """(level, file_no): files that meet nothing in the next level and at most limit bytes in the one behind it."""
    two = m.alias("a").join(m.alias("b"), (F.col("b.level") == F.col("a.level") + 2) & (F.col("b.largest_key") >= F.col("a.smallest_key")) & (F.col("b.smallest_key") <= F.col("a.largest_key")), "left")
    two = two.groupBy(F.col("a.level").alias("level"), F.col("a.file_no").alias("file_no")).agg(F.coalesce(F.sum("b.file_size"), F.lit(0)).alias("behind"))
    return next_level_overlap(m).where("bytes = 0").join(two.where(F.col("behind") <= limit), ["level", "file_no"]).select("level", "file_no")


def allowed_seeks(size: Column) -> Column:
    return F.greatest(F.lit(LEAST_SEEKS), F.floor(size / SEEK_COST)).cast("long")
