"""Operator 3: quality rules with cross-document line frequency.

Per document: word and symbol counts, repeated lines, and words in repeated 5-word windows. Across
documents: every line is normalised (lower case, white space to one space, trimmed) and hashed; for each
host the distinct documents of a line are counted, where copies with the same lines are one document.
A line above ``max_docs`` is removed from all documents of the host but the first that holds it, so a
group of near copies never loses every member (``keep_first=False``: from that one as well). A document of which less than ``min_left`` of the
characters of its distinct lines is left is depleted and rejected.

The host column is a parameter (here: source). A hot host or line is no hot task: lines are dealt by
host and line and counted in two steps, and the join with the few lines above the limit can be split.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own;
repeated rows with the same id each get their row; an empty table gives no rows; extra columns are
passed by ``clean``, whatever they are called, and ignored by ``judge``; a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.text import WORD, let, words
from varve.session import few, remove, stash

MAX_DOCS = 10
MIN_LEFT = 0.3
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Rows of lines or changes that a join broadcasts at most.
FEW = 200_000


def repeat_words(hashes: Column) -> Column:
    """Words covered by a window that occurs twice or more. hashes: of the windows, by place."""

    def covered(placed):
        twice = F.filter(placed, lambda x, k: (F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"]))
        # each window adds the words that no earlier one covers, WINDOW at most
        return F.aggregate(
            F.array_sort(F.transform(twice, lambda x: x["i"])),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def count(hs):
        placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(placed, covered))

    return let(hashes, count)


def window_hashes(ws: Column) -> Column:
    """64-bit hash of every window of WINDOW words, each word hashed once."""

    def windows(each):
        last = F.size(each) - (WINDOW - 1)
        return F.when(
            last > 0,
            F.transform(F.slice(each, F.lit(1), F.greatest(last, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(each, i + k) for k in range(1, WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), windows)


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))

    def figures(ws, ls):
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            (F.size(F.split(t, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeat_words(window_hashes(ws)).alias("n_repeat_words"),
        )

    hashed = F.transform(lines, lambda x: F.xxhash64(x))
    out = docs.withColumn("_f", let(words(F.col(text)), lambda ws: let(hashed, lambda ls: figures(ws, ls))))
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], "_f.*")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def normal_text(text: Column) -> Column:
    """Lower case, and runs of white space but line ends to one space."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(t)


def line_hashes(text: Column) -> Column:
    """(hash, code points) of each normalised line, in order, blank ones too."""
    return F.transform(F.split(normal_text(text), "\n"), lambda x: let(F.trim(x), lambda y: F.struct(F.xxhash64(y).alias("line"), F.length(y).alias("n"))))


def features(docs: DataFrame) -> DataFrame:
    """(id, host, text_hash, content, keys, base figures) of docs (id, host, text): all that is taken from the texts.

    keys: the distinct lines that are not blank; content: the hash of keys, equal for copies.
    """
    keyed = docs.withColumn("keys", F.array_distinct(F.filter(line_hashes(F.col("text")), lambda x: x["n"] > 0)))
    keyed = keyed.withColumns({"host": F.coalesce(F.concat(F.lit("="), "host"), F.lit("")), "text_hash": F.xxhash64("text"), "content": F.xxhash64("keys")})
    return base_rules(keyed).drop("text")


def _lines(found: DataFrame) -> DataFrame:
    return found.select("id", "host", "content", F.explode("keys").alias("k")).select("id", "host", "content", F.col("k.line").alias("line"), F.col("k.n").alias("n"))


def excess_lines(found: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line, n_docs, first): lines in more than max_docs distinct documents of their host.

    first: content key of the document that keeps the line.
    """
    each = _lines(found).groupBy("host", "line", "content").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "content")).alias("k"))
    return each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("k").alias("k")).where(F.col("n_docs") > max_docs).select("host", "line", "n_docs", F.col("k.content").alias("first"))


def removals(found: DataFrame, max_docs: int = MAX_DOCS, keep_first: bool = True) -> DataFrame:
    """(host, content, removed_chars, removed): what each distinct document loses; those that lose nothing are absent."""
    once = found.where(F.size("keys") > 0).groupBy("host", "content").agg(F.first("keys").alias("keys")).withColumn("id", F.lit(None))
    over, _ = stash(excess_lines(found.where(F.size("keys") > 0), max_docs).select("host", "line", "first"), "lines")
    # few lines are looked up in place; many are joined by host and line, where a hot line can be split
    hits = _lines(once).join(few(over, FEW), ["host", "line"])
    hits = hits.where(F.col("content") != F.col("first")) if keep_first else hits
    return hits.groupBy("host", "content").agg(F.sum("n").alias("removed_chars"), F.collect_set("line").alias("removed"))


def judge(found: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, keep_first: bool = True) -> DataFrame:
    """A row for each of features' rows, with line_chars, removed_chars, removed and kept for keys. No text is shuffled."""
    lost = removals(found, max_docs, keep_first).withColumnsRenamed({"host": "_h", "content": "_c"})
    chars = F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    # a document without lines loses none: its key is null, which joins nothing
    own = F.when(F.size("keys") > 0, F.col("content"))
    out = found.withColumns({"line_chars": chars, "_own": own}).drop("keys").join(lost, (F.col("host") == F.col("_h")) & (F.col("_own") == F.col("_c")), "left").drop("_h", "_c", "_own")
    out = out.withColumns({"removed_chars": F.coalesce("removed_chars", F.lit(0).cast("long")), "removed": F.coalesce("removed", F.array().cast("array<bigint>"))})
    depleted = F.col("line_chars") - F.col("removed_chars") < F.lit(min_left) * F.col("line_chars")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, key: str = "doc_id", host: str = "source", text: str = "text", keep_first: bool = True) -> DataFrame:
    """The documents that are kept, without their removed lines, in the columns of docs."""
    slim = docs.select(F.col(key).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    found, path = stash(features(slim), "quality")
    mark = lambda h: F.struct(F.col("id").alias("i"), F.col("host").alias("h"), h.alias("t"))
    # a document is looked up only for what changes: that it goes, or loses lines
    change = judge(found, max_docs, min_left, keep_first).where("not kept or size(removed) > 0").select(mark(F.col("text_hash")).alias("_m"), "kept", "removed").dropDuplicates(["_m"])
    change, _ = stash(change, "changes")
    remove(docs.sparkSession, path)
    short_enough = change.agg(F.sum(F.size("removed"))).first()[0] or 0
    change = few(change, FEW) if short_enough <= 10 * FEW else change
    # all columns as one value: none can clash with those made here
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"), F.col(key).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("host"))
    r = left.withColumn("_k", mark(F.xxhash64("_text"))).join(change, F.col("_k").eqNullSafe(F.col("_m")), "left").where("coalesce(kept, true)")
    short = let(line_hashes(F.col("_text")), lambda hs: F.array_join(F.filter(F.split(F.col("_text"), "\n"), lambda x, i: ~F.array_contains(F.col("removed"), F.get(hs, i)["line"])), "\n"))
    r = r.withColumn("_new", F.when(F.size("removed") > 0, short).otherwise(F.col("_text")))
    return r.select(*[F.col("_new").alias(text) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])
