"""Operator 10: mixing sources to target weights by subset-sum budget fitting.

Targets: sources, ordered by code point with null last, get the weights in turn and share ``share`` of all
words; no target is above ``most`` times its source's words, and what that frees is shared again by weight.
The fixed point is min(most * words, level * weight) for one level, found by a running sum over the
sources in the order in which they reach their limit.

Fitting: of each source as many whole passes are taken as the target holds, and the rest is a budget.
Documents are counted by exact size; each size gives its share of the budget in whole documents, whole
documents then fill up from the largest size down, and a bounded-knapsack table over the words left, in
units of the sizes' common divisor, finds the counts that come nearest. Where that is not exact, documents
that were taken before go back into the choice. Last, of each size the seeded hash of the documents
says which ones make up the count. Only (source, size) counts meet in one place.

Choosing n of a size's documents needs no sort of that group: hashes are counted in ranges, whole ranges
are taken or left, and only the range in which n falls is ranked; a group of any size is split so.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, the last;
repeated rows count each; an empty table gives no rows; other columns pass, whatever they are called, but
for those that are added (size, source_size, target, taken), which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.session import few, stash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20
#: The knapsack table's length in words; and how many ranges a size's hashes are counted in.
TABLE = 1 << 15
#: Words of documents taken already that are chosen anew where the rest alone is not met; all, if they are no more.
LOOSE = 1 << 21
RANGES = 256
#: Columns that a mix adds, and sources whose targets are broadcast at most.
ADDED, FEW = ("size", "source_size", "target", "taken"), 100_000


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) of sizes (source, size). One row for each source is sorted."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(ws, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    cap = F.col("source_size") * float(most)
    by_limit = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    total, ahead = F.sum("source_size").over(everything) * float(share), F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - ahead) / left
    # a source is at its limit while the level, were it the first below, would pass the limit
    free = per.withColumns({"level": level, "free": cap / F.col("weight") > level})
    at = F.min(F.when(F.col("free"), F.struct((F.col("source_size") * float(most) / F.col("weight")).alias("r"), F.col("source").isNull().alias("no"), "source", "level"))).over(Window.partitionBy())
    target = F.when(at.isNull(), F.col("source_size") * float(most)).otherwise(F.least(F.col("source_size") * float(most), at["level"] * F.col("weight")))
    return free.select("source", "source_size", "weight", target.alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many documents of each size to take so that their words come nearest to budget (ties: below)."""
    order = np.argsort(-sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((sizes * counts).sum())
    budget = max(0, min(budget, total))
    take = np.floor(counts * (max(0, budget - table // 2) / max(total, 1))).astype(np.int64)
    left = budget - int((take * sizes).sum())
    for k, s in enumerate(sizes):  # whole documents, large first, while the table could not hold the rest
        if left <= table // 2:
            break
        n = min(int(counts[k] - take[k]), max(0, (left - table // 2) // int(s)))
        take[k] += n
        left -= n * int(s)
    more = _knapsack(sizes, counts - take, left) if left > 0 else np.zeros_like(take)
    off = abs(left - int((more * sizes).sum()))
    unit = int(np.gcd.reduce(sizes)) if len(sizes) else 1
    if off > min(budget % unit, -budget % unit):  # not the nearest multiple: taken documents are chosen anew
        back = take if int((take * sizes).sum()) <= LOOSE else np.minimum(take, 4)
        back = np.where((back * sizes).cumsum() <= LOOSE, back, 0)
        again = _knapsack(sizes, counts - take + back, left + int((back * sizes).sum()))
        if abs(left + int(((back - again) * sizes).sum())) < off:
            take, more = take - back, again
    take = take + more
    out = np.zeros(len(order), np.int64)
    out[order] = take
    return out


def _knapsack(sizes: np.ndarray, spare: np.ndarray, left: int) -> np.ndarray:
    """Bounded knapsack over 0..left + the largest spare size: counts whose sum is nearest to left."""
    have = spare > 0
    if not have.any():
        return np.zeros(len(sizes), np.int64)
    unit = int(np.gcd.reduce(sizes[have]))
    goal, sizes = left / unit, sizes // unit
    top = int(goal + min(goal, int(sizes[have].max()))) + 1  # no sum is nearer than 0 beyond twice the goal
    used_by = np.full(top + 1, -1, np.int32)  # the last size that first reached the sum, and how many of it
    used_n = np.zeros(top + 1, np.int32)
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    for k in np.flatnonzero(have):
        s = int(sizes[k])
        if s > top:
            continue
        n_here = np.where(reach, 0, -1).astype(np.int32)
        for step in range(min(int(spare[k]), top // s)):
            fresh = np.flatnonzero((n_here[: top + 1 - s] == step) & (n_here[s:] < 0)) + s
            if not len(fresh):
                break
            n_here[fresh] = step + 1
        new = np.flatnonzero(n_here > 0)
        used_by[new], used_n[new] = k, n_here[new]
        reach[new] = True
        if left % unit == 0 and reach[left // unit]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.lexsort((sums, np.abs(sums * unit - left)))[0]])
    out = np.zeros(len(sizes), np.int64)
    while at:
        k = used_by[at]
        out[k] += used_n[at]
        at -= int(used_n[at] * sizes[k])
    return out


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    target, words = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
    passes = int(target // words) if words else 0
    rows = rows.sort_values("size")
    rest = max(0, int(round(target)) - passes * words)
    more = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), rest)
    return rows.assign(passes=passes, more=more)[["source", "size", "n", "passes", "more"]]


def plan(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, size, n, passes, more): every document of the source is taken passes times, and more of this size once again."""
    hist = sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    joined = hist.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    return joined.groupBy("source").applyInPandas(_plan, "source string, size long, n long, passes int, more long")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, seed: int = SEED, **goal_args) -> DataFrame:
    """docs (which must be cheap to read twice) with size, source_size, target and taken. size: of a row, as long."""
    names = [c for c in docs.columns if c not in ADDED]
    # all columns as one value: none can clash with those made here
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), size.cast("long").alias("size"), F.col(source).alias("source"), F.col(key).alias("_key"))
    own = own.withColumn("_hash", F.xxhash64(F.lit(seed), F.col("_key").cast("string"), "size"))
    own = own.withColumn("_range", F.shiftrightunsigned("_hash", 64 - RANGES.bit_length() + 1))
    slim = own.select("source", "size", "_range")
    goal, _ = stash(targets(slim, **goal_args), "targets")
    chosen = plan(slim, goal).select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "passes", "more")
    # ranges of a size's hashes: how many documents lie before and in each
    counted = slim.where("size > 0").groupBy("source", "size", "_range").agg(F.count(F.lit(1)).alias("in_range"))
    counted = counted.withColumn("before", F.sum("in_range").over(Window.partitionBy("source", "size").orderBy("_range")) - F.col("in_range"))
    counted = counted.join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    counted = counted.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("_range").alias("r"), "passes", (F.col("more") - F.col("before")).alias("room"), "in_range")
    marked = own.join(counted, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("_range") == F.col("r")), "left").drop("s", "z", "r")
    split = (F.col("room") > 0) & (F.col("room") < F.col("in_range"))
    # only ranges that hold the cut are ranked; other rows go to a group of one by their own hash
    lane = F.when(split, F.lit(-1).cast("long")).otherwise(F.col("_hash"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "_range", lane).orderBy("_hash", "_key"))
    again = F.when(F.col("room") >= F.col("in_range"), 1).when(split & (rank <= F.col("room")), 1).otherwise(0)
    taken = F.coalesce((F.col("passes") + again) * F.col("size"), F.lit(0)).cast("long")
    out = marked.withColumn("taken", taken)
    out = out.join(few(goal.select(F.col("source").alias("_s"), "source_size", "target"), FEW), F.col("source").eqNullSafe(F.col("_s")))
    return out.select(*[F.col(f"_row.`{c}`") for c in names], "size", "source_size", "target", "taken")
