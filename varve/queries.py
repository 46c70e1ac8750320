"""Driver-facing queries over the event log, each with its SQL.

Events are the change log: ``user_key = user_id``, ``seq = event_id + 1``, errors are tombstones. Runs are
cut from it: level 0 by sequence (a flush for every 500 entries), level 1 and 2 by key ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions import bloom as BF
from varve.functions import bytes as B
from varve.functions.ordering import HEX_NUMBER
from varve.operators import batch as BA
from varve.operators import compact as C
from varve.operators import files as M
from varve.operators import ordered as O
from varve.operators import resolve as R
from varve.sources import filenames

FLUSH = 500
ENTRY_BYTES = 25
LEVEL1_BYTES = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: one version each, errors are tombstones."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("user_key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("vtype"),
        F.col("value"),
    )


def half(e: DataFrame) -> int:
    """The middle sequence number, a snapshot in the past."""
    return (e.agg(F.max("seq")).first()[0] or 0) // 2


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the level and file that holds them, one copy at each of three levels."""
    e = log(spark, sf_dir)
    at = lambda level, no: e.withColumns({"level": F.lit(level), "file_no": no.cast("long")})
    by_key = lambda n: F.floor(F.col("user_key") / n)
    return at(0, F.floor((F.col("seq") - 1) / FLUSH)).unionByName(at(1, by_key(10) + 100_000)).unionByName(at(2, by_key(25) + 200_000))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.file_meta(runs(spark, sf_dir), F.lit(ENTRY_BYTES))


LOG = "(SELECT user_id AS user_key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS vtype, value FROM events)"
HALF = "(SELECT max(event_id + 1) // 2 FROM events)"


def live_sql(upto: str | None = None) -> str:
    where = f" WHERE seq <= {upto}" if upto else ""
    return f"(SELECT user_key, max(seq) AS seq, arg_max(value, seq) AS value FROM {LOG}{where} GROUP BY user_key HAVING arg_max(vtype, seq) = 1)"


RUNS = f"""(SELECT *, 0 AS level, (seq - 1) // {FLUSH} AS file_no FROM {LOG}
  UNION ALL SELECT *, 1, user_key // 10 + 100000 FROM {LOG}
  UNION ALL SELECT *, 2, user_key // 25 + 200000 FROM {LOG})"""
META = f"""(SELECT level, file_no, CAST(count(*) * {ENTRY_BYTES} AS BIGINT) AS file_size, count(*) AS n_entries,
  min(user_key) AS smallest_key, arg_min(seq, user_key * 1000000000 - seq) AS smallest_seq,
  max(user_key) AS largest_key, arg_max(seq, user_key * 1000000000 - seq) AS largest_seq FROM {RUNS} GROUP BY level, file_no)"""

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# ---- reads ----


@query(f"SELECT * FROM {live_sql()}")
def latest_live(spark, d):
    return R.resolve(log(spark, d)).select("user_key", "seq", "value")


@query(f"SELECT * FROM {live_sql()} WHERE user_key = 7")
def get_point(spark, d):
    return R.get(log(spark, d), 7).select("user_key", "seq", "value")


@query(f"SELECT * FROM {live_sql()} WHERE user_key = -1")
def get_missing(spark, d):
    return R.get(log(spark, d), -1).select("user_key", "seq", "value")


@query(f"SELECT user_key, max(seq) AS seq, CAST(arg_max(vtype, seq) AS INT) AS vtype FROM {LOG} GROUP BY user_key HAVING arg_max(vtype, seq) = 0")
def tombstoned_keys(spark, d):
    return R.newest(log(spark, d)).where("vtype = 0").select("user_key", "seq", "vtype")


@query(f"SELECT * FROM {live_sql(HALF)} WHERE user_key = (SELECT min(user_key) FROM {live_sql(HALF)})")
def get_as_of(spark, d):
    """The first key that was alive then."""
    e = log(spark, d)
    return R.get(e, R.resolve(e, half(e)).agg(F.min("user_key")).first()[0], half(e)).select("user_key", "seq", "value")


@query(f"SELECT * FROM {live_sql(HALF)}")
def scan_as_of(spark, d):
    e = log(spark, d)
    return R.resolve(e, half(e)).select("user_key", "seq", "value")


@query(f"SELECT * FROM {live_sql('0')}")
def snapshot_empty(spark, d):
    return R.resolve(log(spark, d), 0).select("user_key", "seq", "value")


@query(f"""SELECT coalesce(a.user_key, b.user_key) AS user_key, CASE WHEN a.seq IS NULL THEN 'added' WHEN b.seq IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM {live_sql(HALF)} a FULL JOIN {live_sql()} b ON a.user_key = b.user_key WHERE a.seq IS DISTINCT FROM b.seq""")
def snapshot_diff(spark, d):
    e = log(spark, d)
    return C.snapshot_diff(R.resolve(e, half(e)), R.resolve(e))


@query(f"SELECT * FROM {live_sql()} WHERE user_key IN (SELECT c_custkey FROM customer)")
def multi_get(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("user_key"))
    return R.multi_get(log(spark, d), keys).select("user_key", "seq", "value")


@query(f"SELECT user_key, seq, CAST(vtype AS INT) AS vtype, value, row_number() OVER (ORDER BY seq DESC) AS age FROM {LOG} WHERE user_key = 7")
def all_versions(spark, d):
    from pyspark.sql import Window

    one = R.versions(log(spark, d), 7)
    return one.withColumn("age", F.row_number().over(Window.partitionBy("user_key").orderBy(F.col("seq").desc())).cast("long"))


@query(f"SELECT * FROM {live_sql()} WHERE user_key BETWEEN 20 AND 40")
def range_scan(spark, d):
    return R.resolve(R.key_range(log(spark, d), 20, 40)).select("user_key", "seq", "value")


@query(f"SELECT * FROM {live_sql()} WHERE user_key <= 30")
def open_lower(spark, d):
    return R.resolve(R.key_range(log(spark, d), None, 30)).select("user_key", "seq", "value")


@query(f"SELECT * FROM {live_sql()} WHERE user_key >= 100")
def open_upper(spark, d):
    return R.resolve(R.key_range(log(spark, d), 100)).select("user_key", "seq", "value")


@query(f"SELECT user_key, count(*) AS n_versions, count(*) FILTER (vtype = 0) AS n_tombstones FROM {LOG} GROUP BY user_key")
def version_counts(spark, d):
    return log(spark, d).groupBy("user_key").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if(F.col("vtype") == 0).alias("n_tombstones"))


def _seek(less: bool, equal: bool):
    def run(spark, d):
        probes = table(spark, d, "supplier").select((F.col("s_suppkey") * 3 - 1).alias("probe"))
        return O.near(R.resolve(log(spark, d)), probes, less, equal)

    return run


for _name, _less, _equal, _op, _best in (("seek_ge", False, True, ">=", "min"), ("seek_gt", False, False, ">", "min"), ("seek_le", True, True, "<=", "max"), ("seek_lt", True, False, "<", "max")):
    QUERIES[_name] = _seek(_less, _equal)
    ORACLES[_name] = f"SELECT p.probe, (SELECT {_best}(user_key) FROM {live_sql()} l WHERE l.user_key {_op} p.probe) AS found FROM (SELECT DISTINCT s_suppkey * 3 - 1 AS probe FROM supplier) p"


@query(f"SELECT min(user_key) AS first_key, max(user_key) AS last_key, count(*) AS n_keys FROM {live_sql()}")
def first_last(spark, d):
    return R.resolve(log(spark, d)).agg(F.min("user_key").alias("first_key"), F.max("user_key").alias("last_key"), F.count(F.lit(1)).alias("n_keys"))


@query(f"SELECT user_key, lag(user_key) OVER (ORDER BY user_key) AS prev_key, lead(user_key) OVER (ORDER BY user_key) AS next_key FROM {live_sql()}")
def next_prev(spark, d):
    return O.neighbours(R.resolve(log(spark, d)).select("user_key"), "user_key")


@query(f"SELECT user_key, seq, row_number() OVER (ORDER BY user_key) AS rank FROM {live_sql()}")
def ordered_scan(spark, d):
    return O.ranked(R.resolve(log(spark, d)).select("user_key", "seq"), "user_key")


# ---- writes ----


@query("""SELECT o_custkey AS user_key, 1000 + row_number() OVER (ORDER BY o_orderkey) - 1 AS seq,
CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS INT) AS vtype, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS value FROM orders""")
def batch_apply(spark, d):
    o = table(spark, d, "orders")
    deleted = F.col("o_orderstatus") == "F"
    ops = o.select(F.col("o_orderkey").alias("pos"), F.when(deleted, 0).otherwise(1).alias("vtype"), F.col("o_custkey").alias("user_key"), F.when(~deleted, F.col("o_totalprice")).alias("value"))
    return BA.apply(ops, 1000)


@query("""WITH n AS (SELECT count(*) AS k FROM nation)
SELECT n_nationkey::BIGINT AS pos, 1 AS vtype, n_nationkey::BIGINT AS user_key, n_name AS value FROM nation
UNION ALL SELECT k + r_regionkey, 0, r_regionkey, NULL FROM region, n""")
def batch_append(spark, d):
    left = BA.puts(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name"), "k", "n_name", "k")
    right = BA.deletes(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k")), "k", "k", left)
    return BA.append(left, right)


_QUEUED = "(SELECT queue, sync, size, row_number() OVER (PARTITION BY queue ORDER BY o) AS pos FROM (SELECT o_custkey % 10 AS queue, o_orderkey AS o, o_orderkey % 5 = 0 AS sync, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders))"


@query(f"""WITH RECURSIVE q AS (SELECT * FROM {_QUEUED}), g AS (
  SELECT queue, pos, size, sync, 0::BIGINT AS group_no, size AS total, CASE WHEN size <= {128 << 10} THEN size + {128 << 10} ELSE {1 << 20} END AS most, sync AS lead FROM q WHERE pos = 1
  UNION ALL
  SELECT queue, pos, size, sync, CASE WHEN fits THEN group_no ELSE group_no + 1 END, CASE WHEN fits THEN total + size ELSE size END,
    CASE WHEN fits THEN most WHEN size <= {128 << 10} THEN size + {128 << 10} ELSE {1 << 20} END, CASE WHEN fits THEN lead ELSE sync END
  FROM (SELECT q.*, g.group_no, g.total, g.most, g.lead, g.total + q.size <= g.most AND NOT (q.sync AND NOT g.lead) AS fits FROM g JOIN q ON q.queue = g.queue AND q.pos = g.pos + 1)
) SELECT queue, pos, size, sync, group_no FROM g""")
def group_commit(spark, d):
    """Orders as batches of as many bytes as they cost, queued by customer."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("queue"), "o_orderkey", (F.col("o_orderkey") % 5 == 0).alias("sync"), F.floor("o_totalprice").cast("long").alias("size"))
    place = F.row_number().over(Window.partitionBy("queue").orderBy("o_orderkey")).cast("long")
    return BA.group_commit(o.withColumn("pos", place))


# ---- runs, files, levels ----


@query(f"SELECT user_key, seq, row_number() OVER (ORDER BY user_key, seq DESC) AS rank FROM {LOG}")
def kmerge_runs(spark, d):
    e = log(spark, d).select("user_key", "seq")
    parts = [e.where(F.col("seq") % 4 == k) for k in range(4)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return O.ranked(merged, "user_key", -F.col("seq"))


@query(f"SELECT user_key, CAST(run AS INT) AS run, row_number() OVER (ORDER BY user_key, run) AS rank FROM (SELECT DISTINCT user_key, seq % 4 AS run FROM {LOG})")
def merge_tie(spark, d):
    """Runs that hold equal keys: the earlier run's key comes first."""
    e = log(spark, d)
    return O.merged([e.where(F.col("seq") % 4 == k).select("user_key").distinct() for k in range(4)])


@query(f"SELECT * FROM {META}")
def flush_file_meta(spark, d):
    return meta(spark, d)


@query(f"""SELECT CAST(l.level AS INT) AS level, coalesce(n_files, 0) AS n_files, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes FROM (SELECT unnest(range(7)) AS level) l
LEFT JOIN (SELECT level, count(*) AS n_files, sum(file_size) AS bytes FROM {META} GROUP BY level) m ON l.level = m.level""")
def level_counts(spark, d):
    return M.level_counts(meta(spark, d))


_SCORES = f"""(SELECT CAST(l.level AS INT) AS level, CASE WHEN l.level = 0 THEN coalesce(n, 0) / 4.0::DOUBLE ELSE coalesce(b, 0) / ({LEVEL1_BYTES}::DOUBLE * pow(10, l.level - 1)) END AS score
FROM (SELECT unnest(range(6)) AS level) l LEFT JOIN (SELECT level, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS b FROM {META} GROUP BY level) m ON l.level = m.level)"""


@query(f"SELECT level, round(score, 6) AS score FROM {_SCORES}")
def level_score(spark, d):
    return M.level_score(meta(spark, d), LEVEL1_BYTES).select("level", F.round("score", 6).alias("score"))


@query(f"SELECT level, round(score, 6) AS score, score >= 1 AS needed FROM {_SCORES} ORDER BY score DESC, level LIMIT 1")
def compaction_needed(spark, d):
    return M.compaction_level(meta(spark, d), LEVEL1_BYTES).select(F.col("level").cast("int").alias("level"), F.round("score", 6).alias("score"), "needed")


@query(f"SELECT p.probe, (SELECT arg_min(file_no, largest_key) FROM {META} m WHERE level = 1 AND largest_key >= p.probe) AS file_no FROM (SELECT DISTINCT s_suppkey * 3 - 1 AS probe FROM supplier) p")
def find_file(spark, d):
    probes = table(spark, d, "supplier").select((F.col("s_suppkey") * 3 - 1).alias("probe"))
    return M.find_file(meta(spark, d).where("level = 1"), probes)


@query(f"SELECT level, file_no FROM {META} WHERE largest_key >= 20 AND smallest_key <= 40")
def overlap_files(spark, d):
    return meta(spark, d).where(M.overlaps(F.lit(20), F.lit(40))).select("level", "file_no")


@query(f"SELECT least(min(smallest_key), 20) AS lo, greatest(max(largest_key), 40) AS hi FROM {META} WHERE level = 1 AND largest_key >= 20 AND smallest_key <= 40")
def overlap_step(spark, d):
    return M.overlap_step(meta(spark, d).where("level = 1"), 20, 40).select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@query(f"""SELECT level, file_no, CAST(sum(CASE WHEN prev IS NULL OR smallest_key > prev THEN 1 ELSE 0 END) OVER (PARTITION BY level ORDER BY smallest_key, file_no) AS BIGINT) AS grp
FROM (SELECT level, file_no, smallest_key, max(largest_key) OVER (PARTITION BY level ORDER BY smallest_key, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {META})""")
def overlap_fixpoint(spark, d):
    return M.overlap_groups(meta(spark, d)).select("level", "file_no", "grp")


@query(f"SELECT CAST(count(*) * {ENTRY_BYTES} AS BIGINT) AS bytes FROM {LOG} WHERE user_key >= 20 AND user_key < 40")
def approx_range_size(spark, d):
    return M.range_size(log(spark, d).select("user_key", F.lit(ENTRY_BYTES).alias("size")), 20, 40)


_NEXT = f"""(SELECT a.level, a.file_no, CAST(coalesce(sum(b.file_size), 0) AS BIGINT) AS bytes FROM {META} a LEFT JOIN {META} b
ON b.level = a.level + 1 AND b.largest_key >= a.smallest_key AND b.smallest_key <= a.largest_key GROUP BY a.level, a.file_no)"""


@query(f"SELECT * FROM {_NEXT}")
def next_level_overlap(spark, d):
    return M.next_level_overlap(meta(spark, d))


@query(f"SELECT max(bytes) AS bytes FROM {_NEXT}")
def max_next_level_overlap(spark, d):
    return M.next_level_overlap(meta(spark, d)).agg(F.max("bytes").alias("bytes"))


@query(f"SELECT level, CAST(sum(file_size) AS BIGINT) AS bytes, min(smallest_key) AS lo, max(largest_key) AS hi FROM {META} GROUP BY level")
def covering_range(spark, d):
    return meta(spark, d).groupBy("level").agg(F.sum("file_size").alias("bytes"), F.min("smallest_key").alias("lo"), F.max("largest_key").alias("hi"))


@query(f"SELECT CAST(CASE WHEN count(*) FILTER (level <= 1) > 0 THEN 0 WHEN count(*) FILTER (level = 2) > 0 THEN 1 ELSE 2 END AS INT) AS level FROM {META} WHERE largest_key >= 20 AND smallest_key <= 40")
def flush_level(spark, d):
    return M.flush_level(meta(spark, d), 20, 40)


@query(f"""SELECT a.level, a.file_no FROM {META} a JOIN {_NEXT} n ON a.level = n.level AND a.file_no = n.file_no
LEFT JOIN {META} b ON b.level = a.level + 2 AND b.largest_key >= a.smallest_key AND b.smallest_key <= a.largest_key
WHERE n.bytes = 0 GROUP BY a.level, a.file_no HAVING coalesce(sum(b.file_size), 0) <= {10 * M.MAX_FILE}""")
def trivial_move(spark, d):
    return M.trivial_moves(meta(spark, d), 10 * M.MAX_FILE)


_CUT = f"""(SELECT 1 AS level, rn // 40 AS file_no, min(user_key) AS smallest_key, arg_min(seq, rn) AS smallest_seq, max(user_key) AS largest_key, arg_max(seq, rn) AS largest_seq
FROM (SELECT user_key, seq, row_number() OVER (ORDER BY user_key, seq DESC) - 1 AS rn FROM {LOG}) GROUP BY rn // 40)"""


@query(f"""SELECT m.file_no FROM {_CUT} m WHERE EXISTS (SELECT 1 FROM {_CUT} c WHERE c.file_no % 2 = 0 AND c.largest_key = m.smallest_key AND m.smallest_seq < c.largest_seq)
AND NOT (m.file_no % 2 = 0)""")
def boundary_files(spark, d):
    """Files of 40 rows each, so that versions of a key go on in the next one."""
    rows = C.split_rows(log(spark, d), F.lit(ENTRY_BYTES), 40 * ENTRY_BYTES).withColumns({"level": F.lit(1), "file_no": F.col("out_no")})
    m = M.file_meta(rows, F.lit(ENTRY_BYTES))
    return M.boundary_files(m, m.where("file_no % 2 = 0"))


@query(f"SELECT level, file_no FROM (SELECT level, file_no, smallest_key, lag(largest_key) OVER (PARTITION BY level ORDER BY smallest_key, file_no) AS l FROM {META} WHERE level > 0) WHERE l >= smallest_key")
def level_disjoint(spark, d):
    return M.disjoint_violations(meta(spark, d)).select("level", "file_no")


@query(f"SELECT level, file_no, CAST(greatest(100, file_size // 16384) AS BIGINT) AS allowed_seeks FROM {META}")
def seek_budget(spark, d):
    return meta(spark, d).select("level", "file_no", M.allowed_seeks(F.col("file_size")).alias("allowed_seeks"))


def _edits(spark, d) -> DataFrame:
    """Flushes add level-0 files; every third edit later deletes its file and adds it one level down."""
    m = meta(spark, d).where("level = 0")
    add = m.select(F.col("file_no").alias("edit_id"), F.lit("add").alias("action"), F.lit(0).alias("level"), "file_no")
    moved = m.where("file_no % 3 = 0")
    gone = moved.select((F.col("file_no") + 2).alias("edit_id"), F.lit("delete").alias("action"), F.lit(0).alias("level"), "file_no")
    down = moved.select((F.col("file_no") + 2).alias("edit_id"), F.lit("add").alias("action"), F.lit(1).alias("level"), "file_no")
    return add.unionByName(gone).unionByName(down)


_ALIVE = f"(SELECT CAST(CASE WHEN file_no % 3 = 0 THEN 1 ELSE 0 END AS INT) AS level, file_no FROM {META} WHERE level = 0)"


@query(f"SELECT * FROM {_ALIVE}")
def fold_edits(spark, d):
    return M.fold_edits(_edits(spark, d))


@query(f"SELECT DISTINCT file_no FROM {_ALIVE}")
def live_files(spark, d):
    return M.fold_edits(_edits(spark, d)).select("file_no").distinct()


@query(f"SELECT file_no FROM {META} WHERE level <= 1 AND file_no NOT IN (SELECT file_no FROM {_ALIVE})")
def obsolete_files(spark, d):
    listing = meta(spark, d).where("level <= 1").select("file_no")
    return listing.join(M.fold_edits(_edits(spark, d)), "file_no", "left_anti")


# ---- compaction ----


def retain_sql(oldest: str, deeper: str = "false") -> str:
    return f"""SELECT user_key, seq, CAST(vtype AS INT) AS vtype FROM (SELECT *, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) AS newer FROM {LOG})
WHERE NOT (coalesce(newer <= {oldest}, false) OR (vtype = 0 AND seq <= {oldest} AND NOT ({deeper})))"""


@query(retain_sql("(SELECT max(event_id + 1) FROM events)"))
def compaction_retain_head(spark, d):
    e = log(spark, d)
    return C.retain(e, 2 * half(e) + 1).select("user_key", "seq", "vtype")


@query(retain_sql(HALF))
def compaction_retain_half(spark, d):
    e = log(spark, d)
    return C.retain(e, half(e)).select("user_key", "seq", "vtype")


@query(retain_sql(HALF, "user_key // 25 % 2 = 0 AND user_key >= (SELECT min(user_id) FROM events WHERE user_id // 25 = user_key // 25) AND user_key <= (SELECT max(user_id) FROM events WHERE user_id // 25 = user_key // 25)"))
def compaction_retain_deeper(spark, d):
    e = log(spark, d)
    deep = meta(spark, d).where("level = 2 and file_no % 2 = 0")
    return C.retain(C.may_be_deeper(e, deep, 0), half(e), F.col("deeper")).select("user_key", "seq", "vtype")


@query(f"""SELECT e.user_key, e.seq, k.out_no FROM {LOG} e JOIN (SELECT user_key, CAST((sum(count(*) * {ENTRY_BYTES}) OVER (ORDER BY user_key) - count(*) * {ENTRY_BYTES}) // 20000 AS BIGINT) AS out_no
FROM {LOG} GROUP BY user_key) k ON e.user_key = k.user_key""")
def compaction_split(spark, d):
    return C.split_outputs(log(spark, d).select("user_key", "seq"), F.lit(ENTRY_BYTES), 20_000)


# ---- byte functions ----


def _keys(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"))


def _le(n: str, width: int) -> str:
    big = f"lpad(to_hex({n}), {2 * width}, '0')"
    return " || ".join(f"substr({big}, {2 * k + 1}, 2)" for k in reversed(range(width)))


@query(f"SELECT event_id, {_le('event_id', 4)} AS fixed32, {_le('event_id * 1000003', 8)} AS fixed64 FROM events")
def fixed_encode(spark, d):
    e = table(spark, d, "events").select("event_id")
    return e.select("event_id", B.fixed_hex(F.col("event_id"), 4).alias("fixed32"), B.fixed_hex(F.col("event_id") * 1000003, 8).alias("fixed64"))


_VARINT = " || ".join(f"CASE WHEN {k} = 0 OR n >> {7 * k} > 0 THEN lpad(to_hex(((n >> {7 * k}) & 127) + CASE WHEN n >> {7 * (k + 1)} > 0 THEN 128 ELSE 0 END), 2, '0') ELSE '' END" for k in range(9))


@query(f"SELECT event_id, {_VARINT} AS varint, CAST(length({_VARINT}) // 2 AS BIGINT) AS n_bytes FROM (SELECT event_id, event_id * event_id AS n FROM events)")
def varint_encode(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * F.col("event_id")).alias("n"))
    return e.select("event_id", B.varint_hex(F.col("n")).alias("varint"), BA.varint_length(F.col("n")).cast("long").alias("n_bytes"))


@query(f"SELECT event_id, hex(encode(user_id::VARCHAR)) || {_le('(event_id + 1) * 256 + 1', 8)} AS ikey FROM events")
def key_encode(spark, d):
    return _keys(spark, d).select("event_id", F.hex(B.internal_key(F.col("key"), F.col("event_id") + 1, F.lit(1))).alias("ikey"))


@query("SELECT event_id, user_id::VARCHAR AS user_key, event_id + 1 AS seq, 1 AS vtype FROM events")
def key_parse(spark, d):
    k = _keys(spark, d).select("event_id", B.internal_key(F.col("key"), F.col("event_id") + 1, F.lit(1)).alias("ikey"))
    return k.select("event_id", F.decode(B.user_key(F.col("ikey")), "UTF-8").alias("user_key"), B.tag_of(F.col("ikey"))["seq"].alias("seq"), B.tag_of(F.col("ikey"))["vtype"].alias("vtype"))


@query("""WITH p AS (SELECT DISTINCT lpad(user_id::VARCHAR, 6, '0') AS a, lpad((user_id + 37)::VARCHAR, 6, '0') AS b FROM events),
q AS (SELECT a, b, (SELECT max(i) FROM range(7) t(i) WHERE substr(a, 1, i) = substr(b, 1, i)) AS n FROM p)
SELECT a, b, CASE WHEN n < 6 AND ord(substr(a, n + 1, 1)) + 1 < ord(substr(b, n + 1, 1)) THEN substr(a, 1, n) || chr(ord(substr(a, n + 1, 1)) + 1) ELSE a END AS sep FROM q""")
def key_separator(spark, d):
    pad = lambda c: F.lpad(c.cast("string"), 6, "0")
    p = table(spark, d, "events").select(pad(F.col("user_id")).alias("a"), pad(F.col("user_id") + 37).alias("b")).distinct()
    return p.select("a", "b", F.decode(B.separator(F.encode("a", "UTF-8"), F.encode("b", "UTF-8")), "UTF-8").alias("sep"))


@query("SELECT DISTINCT c_name AS key, chr(ord(substr(c_name, 1, 1)) + 1) AS succ FROM customer")
def key_successor(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("key"), F.decode(B.successor(F.encode("c_name", "UTF-8")), "UTF-8").alias("succ")).distinct()


def _bytes_sql(k: str) -> str:
    """The bytes of an ASCII text as numbers."""
    return f"list_transform(range(1, length({k}) + 1), lambda i: ord(substr({k}, i, 1))::BIGINT)"


def _crc_sql(k: str) -> str:
    """CRC-32 bit by bit."""
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda h, j: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {_bytes_sql(k)}), lambda c, b: {step}), 4294967295)"


_MASK = "(((crc >> 15) | ((crc << 17) & 4294967295)) + 2726488792) & 4294967295"


@query(f"SELECT event_id, crc, {_MASK} AS masked, crc AS back FROM (SELECT event_id, {_crc_sql('k')} AS crc FROM (SELECT event_id, user_id::VARCHAR AS k FROM events))")
def crc_mask(spark, d):
    k = _keys(spark, d).select("event_id", F.crc32("key").alias("crc"))
    return k.select("event_id", "crc", B.mask(F.col("crc")).alias("masked"), B.unmask(B.mask(F.col("crc"))).alias("back"))


def _hash_sql(b: str, n: str, seed: int) -> str:
    """The 32-bit block hash of a list of bytes: whole words, then what is left."""
    word = f"({b}[i + 1] + ({b}[i + 2] << 8) + ({b}[i + 3] << 16) + ({b}[i + 4] << 24))"
    times = lambda x: f"((({x}) * {0xC6A4A793}::HUGEINT) % 4294967296)::BIGINT"
    shift = lambda x, by: f"list_transform([{x}], lambda v: xor(v, v >> {by}))[1]"
    start = f"xor({seed}::BIGINT, {times(n)})"
    body = f"list_reduce(list_concat([{start}], list_transform(range(0, {n} - {n} % 4, 4), lambda i: {word}::BIGINT)), lambda h, w: {shift(times('((h + w) & 4294967295)'), 16)})"
    rest = f"coalesce(list_sum(list_transform(range(0, {n} % 4), lambda i: {b}[{n} - {n} % 4 + i + 1] << (8 * i))), 0)::BIGINT"
    return f"CASE WHEN {n} % 4 = 0 THEN {body} ELSE {shift(times(f'(({body}) + {rest}) & 4294967295'), 24)} END"


@query(f"SELECT event_id, {_hash_sql('b', 'len(b)', 0xBC9F1D34)} AS h FROM (SELECT event_id, {_bytes_sql('user_id::VARCHAR')} AS b FROM events)")
def hash32(spark, d):
    return _keys(spark, d).select("event_id", B.hash32(F.col("key"), 0xBC9F1D34).alias("h"))


_PROBES = "list_transform(range(6), lambda j: ((h + j * ((h >> 17) | ((h << 15) & 4294967295))) & 4294967295) % n_bits)"


@query(f"""WITH r AS (SELECT DISTINCT user_id // 10 + 100000 AS file_no, user_id::VARCHAR AS key FROM events),
hashed AS (SELECT key, {_hash_sql('b', 'len(b)', BF.BLOOM_SEED)} AS h FROM (SELECT key, {_bytes_sql('key')} AS b FROM (SELECT DISTINCT key FROM r))),
n AS (SELECT file_no, (greatest(count(*) * 10, 64) + 7) // 8 * 8 AS n_bits FROM r GROUP BY file_no),
built AS (SELECT file_no, n_bits, list(DISTINCT bit) AS bits FROM (SELECT r.file_no, n_bits, unnest({_PROBES}) AS bit FROM r JOIN hashed USING (key) JOIN n ON n.file_no = r.file_no) GROUP BY file_no, n_bits),
asks AS (SELECT key, h, key::BIGINT // 10 + 100000 + ({_crc_sql('key')}) % 2 AS file_no FROM hashed)
SELECT a.file_no, a.key, list_has_all(bits, {_PROBES}) AS maybe, EXISTS (SELECT 1 FROM r WHERE r.file_no = a.file_no AND r.key = a.key) AS present FROM asks a JOIN built b ON b.file_no = a.file_no""")
def bloom_probe(spark, d):
    """Each key against the filter of every run at level 1 that could hold it, and whether it is there."""
    r = runs(spark, d).where("level = 1").select("file_no", F.encode(F.col("user_key").cast("string"), "UTF-8").alias("key")).distinct()
    built = BF.build(r, "file_no", "key")
    asks = r.select("key").distinct().withColumn("file_no", F.floor(F.decode("key", "UTF-8").cast("long") / 10) + 100_000 + F.pmod(F.crc32("key"), F.lit(2)))
    there = r.withColumn("present", F.lit(True))
    return asks.join(built, "file_no").join(there, ["file_no", "key"], "left").select("file_no", F.decode("key", "UTF-8").alias("key"), BF.may_contain(F.col("key"), F.col("n_bits"), F.col("bits"), BF.probes_per_key(10)).alias("maybe"), F.coalesce("present", F.lit(False)).alias("present"))


@query("""SELECT user_key, rn, CAST(CASE WHEN rn % 16 = 0 OR p IS NULL THEN 0 ELSE (SELECT max(i) FROM range(9) t(i) WHERE substr(p, 1, i) = substr(user_key, 1, i)) END AS BIGINT) AS shared
FROM (SELECT user_key, row_number() OVER (ORDER BY user_key) - 1 AS rn, lag(user_key) OVER (ORDER BY user_key) AS p FROM (SELECT DISTINCT lpad(user_id::VARCHAR, 8, '0') AS user_key FROM events))""")
def block_prefix(spark, d):
    keys = table(spark, d, "events").select(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("user_key")).distinct()
    both = O.ranked(O.neighbours(keys, "user_key"), "user_key").withColumn("rn", F.col("rank") - 1)
    same = B.shared_prefix(F.encode("prev_key", "UTF-8"), F.encode("user_key", "UTF-8"))
    return both.select("user_key", "rn", F.when(F.col("rn") % 16 == 0, 0).otherwise(same).cast("long").alias("shared"))


@query("SELECT k, row_number() OVER (ORDER BY ('0x' || k)::BIGINT) AS rank FROM (SELECT DISTINCT lower(to_hex(user_id)) AS k FROM events)")
def custom_comparator(spark, d):
    keys = table(spark, d, "events").select(F.lower(F.hex("user_id")).alias("k")).distinct()
    return O.ranked(keys.withColumn("o", HEX_NUMBER.order(F.col("k")).cast("long")), "o").select("k", "rank")


@query("""SELECT name, CASE WHEN name LIKE 'MANIFEST-%' THEN 'manifest' WHEN name LIKE '%.log' THEN 'log' WHEN name LIKE '%.sst' THEN 'table' ELSE 'temp' END AS kind, num
FROM (SELECT CASE k % 4 WHEN 0 THEN lpad(k::VARCHAR, 6, '0') || '.log' WHEN 1 THEN lpad(k::VARCHAR, 6, '0') || '.sst' WHEN 2 THEN 'MANIFEST-' || lpad(k::VARCHAR, 6, '0') ELSE lpad(k::VARCHAR, 6, '0') || '.dbtmp' END AS name, k AS num
FROM (SELECT s_suppkey AS k FROM supplier))""")
def file_names(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    kind = F.get(F.array(*map(F.lit, ("log", "table", "manifest", "temp"))), (F.col("k") % 4).cast("int"))
    named = s.select(filenames.name_expr(kind, F.col("k")).alias("name"))
    return named.select("name", filenames.kind_expr(F.col("name")).alias("kind"), filenames.number_expr(F.col("name")).alias("num"))


# ---- declared-only tier: SQL over live rows ----


@query(f"SELECT c.c_custkey, c.c_mktsegment, l.value FROM {live_sql()} l JOIN customer c ON c.c_custkey = l.user_key")
def sql_join_live(spark, d):
    R.resolve(log(spark, d)).createOrReplaceTempView("live")
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c.c_custkey, c.c_mktsegment, l.value FROM live l JOIN customer c ON c.c_custkey = l.user_key")


@query(f"SELECT user_key % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM {live_sql()} GROUP BY 1")
def sql_agg_live(spark, d):
    R.resolve(log(spark, d)).createOrReplaceTempView("live")
    return spark.sql("SELECT user_key % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM live GROUP BY 1")
