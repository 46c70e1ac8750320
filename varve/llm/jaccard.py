"""Operator 6: n-gram Jaccard join with rare-first prefix filtering.

A document's set holds the 64-bit hashes of its distinct word n-grams. Elements are put in one order for
all documents, rare ones first: by the count of the element's cell in a fixed-size table of document
frequencies over all documents, then by hash. Two sets of similarity t or more share an element in their
prefixes; with the length, positional and suffix filters few other pairs are left, and each pair is
verified once on the whole sets.

Copies with equal sets are one class, and only its first document takes part. Big groups of near copies
would have a pair for every two members, and the same links for most of them. So pairs are tested in
turns: in each, every document is tested with a few of the documents that share its prefix elements
(first the smallest id, then ``MATES`` or more neighbours from other components in seeded orders), links are merged to components,
and the last turn tests every pair left that is not yet in one component. No link between components is lost.

Hashes are taken for words and n-grams at 64 bits, as everywhere in this folder.

Every row is a document: rows get a number of their own, which is written once with their signature, and
the id is only what a result is called by.

Defined results: a null or wordless text has an empty set and is linked with nothing; with fewer words than
n the whole sequence is the only element; rows of one id are documents each, with their own texts and links;
a row with a null id takes part, and its component is called by the smallest id in it (null if there is
none); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.components import components
from varve.llm.workers import tidy
from varve.session import few, remove, small_batches, stash

NGRAM, PERCENT = 4, 85
#: Cells of the frequency table, whose size bounds what is broadcast, and bands of the suffix filter.
CELLS, BANDS = 1 << 20, 16
CHUNK = 1 << 14
#: Ids that a broadcast semi-join takes at most; beyond it the join is dealt by id.
FEW = 1_000_000
#: Entries of a worker's table of word hashes.
WORDS_HELD = 150_000
#: Texts that a worker looks at in one go.
ROWS = 256
#: Turns before the last one, and documents behind it that one is tested with in the first turn after the stars; later turns have powers of it.
TURNS, MATES = 3, 6

_P = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_WORDS) > WORDS_HELD:
        _WORDS.clear()
    got = list(map(_WORDS.get, words))
    if None in got:
        for k, h in enumerate(got):
            if h is None:
                got[k] = _WORDS[words[k]] = xxhash.xxh3_64_intdigest(words[k])
    return np.array(got, np.uint64)


def _done() -> None:
    """The end of a task."""
    _WORDS.clear()
    tidy()


def element_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    m = min(n, len(words))
    g = np.full(len(words) - m + 1, m, np.uint64)
    for k in range(m):
        g = g * _P + h[k : len(words) - m + 1 + k]
    return np.unique(_mix(g))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sketch(docs: DataFrame, n: int, cells: int) -> np.ndarray:
    """Document frequencies by cell over all documents, as a table of fixed size."""
    chunk = min(CHUNK, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for text in b.column(0):
                held.append((element_set(text.as_py(), n) % np.uint64(cells)).astype(np.int32))
                size += len(held[-1])
                if size > 500_000:
                    total += np.bincount(np.concatenate(held), minlength=cells)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=cells)
        yield from rows(total)
        _done()

    def rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = [k for k in range(cells // chunk) if total[k * chunk : (k + 1) * chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([total[k * chunk : (k + 1) * chunk].tobytes() for k in parts], pa.binary())], ["k", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k * chunk : (k + 1) * chunk] += np.frombuffer(c, np.int64)
        yield from rows(total)

    part = docs.select("text").mapInArrow(count, "k int, c binary")
    width = part.rdd.getNumPartitions()
    while width > 32:  # a tree of sums: no task reads more than 32 tables
        width = -(-width // 32)
        part = part.repartition(width).mapInArrow(add, "k int, c binary")
    total = np.zeros(cells, np.int64)
    for r in part.repartition(1).mapInArrow(add, "k int, c binary").collect():  # the table: 8 bytes a cell
        total[r["k"] * chunk : (r["k"] + 1) * chunk] += np.frombuffer(r["c"], np.int64)
    return np.minimum(total, 2**31 - 1).astype(np.int32)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(row, doc, t, n, f1, f2, prefix array<long>, bands array<int>): number and id of the row, hash of its text, set size, fingerprint, rare-first prefix, counts by band.

    row is made by the place in the frame: write the frame before it is used twice.
    """
    spark, cells = docs.sparkSession, len(sketch)
    shared = spark.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                yield of(whole.slice(at, ROWS), freq)
        _done()

    def of(b: pa.RecordBatch, freq: np.ndarray) -> pa.RecordBatch:
        sizes, f1, f2, prefix, bands = [], [], [], [], []
        for text in b.column(2).to_pylist():
            s = element_set(text, n)
            a, c = fingerprint(s)
            sizes.append(len(s))
            f1.append(a)
            f2.append(c)
            p = prefix_length(len(s), percent) if len(s) else 0
            order = np.lexsort((s, freq[(s % np.uint64(cells)).astype(np.int64)]))[:p]
            prefix.append(s[order].view(np.int64))
            bands.append(np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=BANDS).astype(np.int32))
        ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))),
                pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int32))),
            ],
            ["doc", "t", "n", "f1", "f2", "prefix", "bands"],
        )

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.select("id", F.xxhash64("text"), "text").mapInArrow(run, f"doc {kind}, t long, n long, f1 long, f2 long, prefix array<long>, bands array<int>")
    return out.withColumn("row", F.monotonically_increasing_id())


def whole_sets(docs: DataFrame, heads: DataFrame, n: int) -> tuple[DataFrame, str]:
    """(id, s binary) of heads (id, doc, t, f1): the sorted 64-bit hashes of the head's set. And where they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                sets = [element_set(t, n) for t in part.column(2).to_pylist()]
                right = pa.array([fingerprint(s)[0] == f for s, f in zip(sets, part.column(1).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "s"]).filter(right)
        _done()

    own = few(heads.select(F.col("id").alias("_id"), "doc", "t", "f1"), FEW)
    texts = docs.select("id", "text").join(own, F.col("id").eqNullSafe(F.col("doc")) & (F.xxhash64("text") == F.col("t"))).select("_id", "f1", "text")
    out, path = stash(texts.mapInArrow(run, "id long, s binary"), "sets")
    # rows that are equal in id and text give a set twice
    return out if out.count() == heads.count() else out.dropDuplicates(["id"]), path


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, counted on the whole sets. pairs: a stashed frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((u, v))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(u) + len(v) - same))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # only the sets of the second join that pairs name are dealt
    second = sets.select(F.col("id").alias("b"), F.col("s").alias("y")).join(few(pairs.select("b").distinct(), FEW), "b", "left_semi")
    full = few(pairs.select("a", "b"), FEW).join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(second, "b")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _may_link(percent: int, na: str, nb: str, pa_: str, pb: str):
    """Length and positional filter: what is left behind the shared element must reach the needed overlap."""
    a, b = F.col(na), F.col(nb)
    need = F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.least(a - F.col(pa_), b - F.col(pb)) >= need)


def _suffix(percent: int):
    """Suffix filter: by bands of the hash, sets cannot share more than the smaller count of each band."""
    most = F.aggregate(F.zip_with("bands_a", "bands_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda t, x: t + x)
    return most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def links(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, cells: int = CELLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, heads, links) of docs (id, text).

    rows: (row, doc, t, n_shingles, rep), one for each row of docs, rep being the row that stands for its set
    (itself where the set is empty). heads: (id, lead, doc), the rows that stand for a set that is not empty,
    with the smallest id among the set's rows. links: (a, b) between heads, enough of them for the
    components: every two that are similar are in one component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sig, sig_path = stash(signatures(docs, n, percent, _sketch(docs, n, cells)), "signatures")
    # one row for each distinct set: the first one, by id, a null id last
    first = F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "row", "t")).alias("k")
    some_sets = sig.where("n > 0").groupBy("f1", "f2").agg(first, F.min("doc").alias("lead"))
    heads, _ = stash(some_sets.select("f1", "f2", F.col("k.row").alias("id"), F.col("k.doc").alias("doc"), F.col("k.t").alias("t"), "lead"), "heads")
    rep = heads.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("id").alias("rep"))
    right = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") > 0)
    members, _ = stash(sig.select("row", "doc", "t", "n", "f1", "f2").join(rep, right, "left").select("row", "doc", "t", F.col("n").alias("n_shingles"), F.coalesce("rep", "row").alias("rep")), "members")
    head_sig = sig.withColumnRenamed("row", "id").join(heads.select("id"), "id", "left_semi")
    rows = head_sig.select("id", "n", F.posexplode("prefix").alias("pos", "e"))
    by = Window.partitionBy("e").orderBy("id")
    near = rows.withColumns({"p": F.lag("id").over(by), "q": F.lead("id").over(by)}).where("p is not null or q is not null")
    near, near_path = stash(near.select("e", "id", "n", "pos"), "near")
    # rows without any partner that the filters let pass are of no use to any turn
    mate = near.select(F.col("e").alias("e1"), F.col("id").alias("id1"), F.col("n").alias("n1"), F.col("pos").alias("pos1"))
    live = near.join(mate, (F.col("e") == F.col("e1")) & (F.col("id") != F.col("id1")) & _may_link(percent, "n", "n1", "pos", "pos1"), "left_semi")
    shared, shared_path = stash(live, "shared")
    remove(spark, near_path)
    need, need_path = stash(shared.select("id").distinct(), "need")
    some, some_path = stash(sig.select(F.col("row").alias("id"), "bands", "n").join(few(need, FEW), "id", "left_semi"), "bands")
    remove(spark, sig_path)
    sets, sets_path = whole_sets(docs, heads.join(need, "id", "left_semi"), n)

    def filtered(pairs: DataFrame) -> DataFrame:
        """a < b, once each, past the suffix filter."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        with_bands = pairs.join(some.withColumnsRenamed({"id": "a", "bands": "bands_a", "n": "n_a"}), "a").join(some.withColumnsRenamed({"id": "b", "bands": "bands_b", "n": "n_b"}), "b")
        return with_bands.where(_suffix(percent)).select("a", "b")

    best = lambda c: c.groupBy("id", "mate").agg(F.count(F.lit(1)).alias("k")).groupBy("id").agg(F.max_by("mate", F.struct("k", -F.col("mate"))).alias("mate"))
    found: DataFrame | None = None
    label = need.select("id", F.col("id").alias("c"))
    tested: DataFrame | None = None
    drop = [shared_path, need_path, some_path, sets_path]
    for turn in range(TURNS):
        if turn == 0:
            first = shared.withColumn("o", F.first(F.struct("id", "n", "pos")).over(by))
            first = first.select("id", "n", "pos", F.col("o.id").alias("mate"), F.col("o.n").alias("n0"), F.col("o.pos").alias("pos0"))
            cand = first.where("id != mate").where(_may_link(percent, "n", "n0", "pos", "pos0")).select("id", "mate")
            pairs = filtered(best(cand).select(F.col("id").alias("a"), F.col("mate").alias("b")))
        else:
            # the next ones in a seeded order that is the same for all elements; more of them each turn
            order = Window.partitionBy("e").orderBy(F.xxhash64(F.lit(turn), "id"), "id").rowsBetween(1, MATES ** turn)
            nxt = _mixed(shared, label).withColumn("o", F.collect_list(F.struct("id", "n", "pos", "c")).over(order))
            other = F.filter("o", lambda x: (x["c"] != F.col("c")) & (F.least("n", x["n"]) * 100 >= F.greatest("n", x["n"]) * percent))
            nxt = nxt.select("id", "n", "pos", F.explode(other).alias("o")).select("id", "n", "pos", F.col("o.id").alias("mate"), F.col("o.n").alias("n0"), F.col("o.pos").alias("pos0"))
            pairs = filtered(nxt.where(_may_link(percent, "n", "n0", "pos", "pos0")).select(F.col("id").alias("a"), F.col("mate").alias("b")))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, pairs_path = stash(pairs, "pairs")
        drop.append(pairs_path)
        tested = pairs if tested is None else tested.unionByName(pairs)
        good, _ = stash(verified(pairs, sets, percent), "good")
        if good.isEmpty():
            if turn:
                break
            continue
        found = good if found is None else found.unionByName(good)
        comp, comp_path = stash(components(found), "components")
        drop.append(comp_path)
        label = need.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("c"))
    mixed = _mixed(shared, label)
    x, y = mixed.select("e", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("c").alias("ca")), mixed.select("e", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("c").alias("cb"))
    same = x["e"] == y["e"]
    rest = x.join(y, same & (x["a"] < y["b"]) & (x["ca"] != y["cb"]) & _may_link(percent, "na", "nb", "pa", "pb")).select("a", "b")
    rest = filtered(rest)
    if tested is not None:
        rest = rest.join(tested, ["a", "b"], "left_anti")
    rest, rest_path = stash(rest, "pairs")
    drop.append(rest_path)
    last, _ = stash(verified(rest, sets, percent), "good")
    for path in drop:
        remove(spark, path)
    return members, heads.select("id", "lead", "doc"), last if found is None else found.unionByName(last)


def _mixed(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Prefix rows of the elements that more than one component holds."""
    rows = shared.select("e", "id", "n", "pos").join(label, "id")
    many = rows.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("e")
    return rows.join(many, "e", "left_semi")


def groups(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, cells: int = CELLS) -> DataFrame:
    """(id, t, n_shingles, rep, component_id, stays) of docs (id, text), a row for each of docs'.

    t: xxhash64 of the text. rep: a number that rows with equal sets share. component_id: the smallest id
    that the row is linked with through any links. stays: true for one row of each component.
    """
    rows, heads, pairs = links(docs, n, percent, cells)
    comp = heads.join(components(pairs).withColumnRenamed("id", "_c"), F.col("id") == F.col("_c"), "left").withColumn("c", F.coalesce("component", "id"))
    # names by component, from one row for each set
    best = F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "id"))
    named = comp.groupBy("c").agg(F.min("lead").alias("name"), best["id"].alias("first"))
    label, _ = stash(comp.select("id", "c").join(named, "c").select(F.col("id").alias("_rep"), "name", "first"), "labels")
    out = rows.join(label, F.col("rep") == F.col("_rep"), "left")
    linked = F.col("n_shingles") > 0
    return out.select(
        F.col("doc").alias("id"), "t", "n_shingles", "rep",
        F.when(linked, F.col("name")).otherwise(F.col("doc")).alias("component_id"),
        (~linked | (F.col("row") == F.col("first"))).alias("stays"),
    )
