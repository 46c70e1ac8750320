"""A store: a folder of Parquet runs and logs and a manifest, surfaced as one DataFrame of entries.

``open`` takes the lock, reads the manifest and finds logs that no run holds yet. A write appends one log
folder and then one manifest edit. A log that was written whole before a crash kept its edit from being
written is taken over at the next open, if it goes on where the last one ended; other files that no edit
names are garbage. ``flush`` turns logs into sorted runs, ``compact_once`` and ``compact_range`` merge runs.

Keys are ordered, compared and bounded by the comparator's sortable bytes throughout; ``File`` ranges are such
bytes. A failed write, flush or compaction is remembered: later writes raise it until the store is opened anew.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions import bloom
from varve.functions.ordering import BYTEWISE, Comparator
from varve.operators import compact as C
from varve.operators import files as M
from varve.operators import resolve as R
from varve.operators.batch import room_for_write
from varve.operators.snapshots import Snapshots
from varve.plans.version import MAX_LEVELS, File, Job, Limits, Seeks, Stats, Version, pick, pick_range, span
from varve.schema import DELETION, ENTRY, VALUE
from varve.sources import filenames
from varve.sources.folder import Folder


class StoreError(RuntimeError):
    """Open modes, locks, closed stores, damage."""


#: Deeper ranges that a compaction compares as they stand; more are merged in order.
FEW_RANGES = 32


def _size() -> F.Column:
    return F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 9


class Store:
    def __init__(self, spark: SparkSession, folder: Folder, comparator: Comparator, limits: Limits, bloom_keys: int, auto: bool = False):
        self.spark, self.folder, self.comparator, self.limits, self.bloom_keys = spark, folder, comparator, limits, bloom_keys
        self.version, self.snapshots, self.seeks, self.auto = Version(), Snapshots(), Seeks(), auto
        self.stats = [Stats() for _ in range(MAX_LEVELS)]
        self.error: BaseException | None = None
        self.read_only, self.buffered, self.streamed, self._owner = False, 0, -1, uuid.uuid4().hex
        self.logs: list[int] = []
        self.pointers: dict[int, bytes] = {}
        self.last_sequence, self.next_file, self._edit, self._open = 0, 1, 0, True

    # ---- life ----

    @staticmethod
    def open(spark: SparkSession, path: str, create_if_missing: bool = False, error_if_exists: bool = False, comparator: Comparator = BYTEWISE, paranoid: bool = True, limits: Limits | None = None, bloom_keys: int = 0, auto: bool = False, force: bool = False) -> Store:
        """paranoid=False: files that are missing are left out and the store is read only. auto: writes flush and compact
        as they need room. force: take over the lock of an owner that has crashed; one that still lives can't write from then on."""
        folder = Folder(spark, path)
        there = folder.exists("CURRENT")
        if not there and not create_if_missing:
            raise StoreError(f"{path} does not exist (create_if_missing is false)")
        if there and error_if_exists:
            raise StoreError(f"{path} exists (error_if_exists is true)")
        folder.make()
        s = Store(spark, folder, comparator, limits or Limits(), bloom_keys, auto)
        if not folder.create_exclusive("LOCK", s._owner):
            if not force:
                raise StoreError(f"{path} is locked (force takes over the lock of a crashed owner)")
            folder.write("LOCK", s._owner)
        try:
            if there:
                s._recover(paranoid)
            else:
                folder.make("MANIFEST-000000")
                s._append({"comparator": comparator.name})
                folder.write("CURRENT", "MANIFEST-000000")
        except BaseException:
            folder.remove("LOCK")
            raise
        return s

    def _recover(self, paranoid: bool) -> None:
        manifest = self.folder.read("CURRENT").strip()
        edits = [n for n in self.folder.list(manifest) if n.endswith(".json")]
        if not edits:
            raise StoreError("manifest has no edits")
        files: dict[tuple[int, int], File] = {}
        logs: set[int] = set()
        for name in edits:
            e = json.loads(self.folder.read(f"{manifest}/{name}"))
            if e.get("comparator", self.comparator.name) != self.comparator.name:
                raise StoreError(f"comparator {e['comparator']} does not match {self.comparator.name}")
            for level, number in e.get("gone", []):
                files.pop((level, number), None)
            for f in map(File.of, e.get("new", [])):
                files[f.level, f.number] = f
            logs |= set(e.get("logs", []))
            logs -= set(e.get("done", []))
            self.pointers |= {int(k): bytes.fromhex(v) for k, v in e.get("pointers", {}).items()}
            if "last_sequence" not in e or "next_file" not in e:
                raise StoreError(f"corrupt manifest: edit {name} lacks its last sequence or next file number")
            self.last_sequence, self.next_file = e["last_sequence"], e["next_file"]
            self.streamed = e.get("streamed", self.streamed)
            self._edit = int(name[:-5]) + 1
        missing = [f.number for f in files.values() if not self.folder.exists(self._run(f.number))]
        lost = [n for n in logs if not self.folder.exists(self._log(n))]
        if (missing or lost) and paranoid:
            raise StoreError(f"missing file: {missing + lost}")
        self.read_only = bool(missing or lost)
        self.version, self.logs = Version([f for f in files.values() if f.number not in missing]), sorted(logs - set(lost))
        if not self.read_only:
            self._adopt()
        self.buffered = sum(self.folder.size(self._log(n)) for n in self.logs)

    def _adopt(self) -> None:
        """Register whole logs that no edit names, as long as each goes on where the one before ended."""
        numbers = sorted(k[1] for k in map(filenames.parse, self.folder.list()) if k and k[0] == "log" and k[1] >= self.next_file)
        for number in numbers:
            if not self.folder.exists(f"{self._log(number)}/_SUCCESS"):
                break
            first, last, n = self._read([self._log(number)]).agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
            if not n or first != self.last_sequence + 1 or last != self.last_sequence + n:
                break
            self.next_file, self.last_sequence = number + 1, last
            self._append({"logs": [number]})
            self.logs.append(number)

    def close(self) -> None:
        if self._open:
            self._open = False
            if self.folder.exists("LOCK") and self.folder.read("LOCK") == self._owner:
                if not self.read_only and self.error is None:
                    self.collect_garbage()
                self.folder.remove("LOCK")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        folder = Folder(spark, path)
        if folder.exists("LOCK"):
            raise StoreError(f"{path} is locked")
        if folder.exists():
            folder.remove()

    def _alive(self) -> None:
        if not self._open:
            raise StoreError("store is closed")

    def _run(self, number: int) -> str:
        return filenames.name("table", number)

    def _log(self, number: int) -> str:
        return filenames.name("log", number)

    def _append(self, edit: dict) -> None:
        if self.read_only:
            raise StoreError("files are missing: the store is read only")
        if self.folder.read("LOCK") != self._owner:
            raise StoreError("the lock was taken over")
        edit |= {"last_sequence": self.last_sequence, "next_file": self.next_file}
        self.folder.write(f"MANIFEST-000000/{self._edit:012d}.json", json.dumps(edit))
        self._edit += 1

    def _number(self) -> int:
        self.next_file += 1
        return self.next_file - 1

    # ---- writes ----

    def put(self, key: bytes, value: bytes) -> int:
        return self.write([(key, value)])

    def delete(self, key: bytes) -> int:
        """A tombstone, whether the key is there or not."""
        return self.write([(key, None)])

    def write(self, ops: Iterable[tuple[bytes, bytes | None]]) -> int:
        """One atomic batch of (key, value), value None deletes. Returns its last sequence number."""
        rows = [(bytearray(k), self.last_sequence + 1 + i, DELETION if v is None else VALUE, None if v is None else bytearray(v)) for i, (k, v) in enumerate(ops)]
        if not rows:
            return self.last_sequence
        return self._commit(self.spark.createDataFrame(rows, ENTRY).coalesce(1), len(rows))

    def write_frame(self, ops: DataFrame, streamed: int | None = None) -> int:
        """One atomic batch of any size: ops (pos, vtype, user_key, value) in order of pos. streamed: the number of a stream's micro-batch, kept with it."""
        from varve.operators.batch import apply

        n = ops.count()
        return self._commit(apply(ops, self.last_sequence + 1), n, streamed) if n or streamed is not None else self.last_sequence

    @contextmanager
    def _latched(self) -> Iterator[None]:
        self._alive()
        if self.error:
            raise StoreError(f"an earlier write, flush or compaction failed: {self.error}") from self.error
        try:
            yield
        except BaseException as e:
            self.error = e
            raise

    def _commit(self, entries: DataFrame, n: int, streamed: int | None = None) -> int:
        if self.auto:
            self._make_room()
        with self._latched():
            edit: dict = {} if streamed is None else {"streamed": streamed}
            if n:
                number = self._number()
                entries.select("user_key", "seq", "vtype", "value").write.parquet(self.folder.at(self._log(number)))
                self.last_sequence += n
                edit["logs"] = [number]
            self._append(edit)
            self.streamed = self.streamed if streamed is None else streamed
            if n:
                self.logs.append(number)
                self.buffered += self.folder.size(self._log(number))
            return self.last_sequence

    def _make_room(self) -> None:
        """What a writer does before it writes: one step of compaction where level 0 is crowded, a flush where logs are full."""
        delayed = False
        while True:
            files = len(self.version.level(0))
            step = room_for_write(files, self.buffered >= self.limits.write_buffer, False, self.limits.slowdown, self.limits.stop, delayed)
            if step == "delay":
                delayed = True
                self.compact_once()
            elif step == "wait":
                if not self.compact_once():
                    return
            else:
                if step == "rotate":
                    self.flush()
                    while self.compact_once():
                        pass
                return

    # ---- reads ----

    def snapshot(self) -> int:
        self._alive()
        return self.snapshots.acquire(self.last_sequence)

    def release(self, snapshot: int) -> None:
        self.snapshots.release(snapshot)

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*[self.folder.at(n) for n in names])

    def _bound(self, key: bytes | None) -> bytes | None:
        return None if key is None else self.comparator.sortable_key(bytes(key))

    def _ordered(self, entries: DataFrame) -> DataFrame:
        """entries with ``ord``, the sortable bytes of the key."""
        return entries.withColumn("ord", self.comparator.sortable(F.col("user_key")))

    def entries(self, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        """All stored versions in a key range; runs outside it are not opened."""
        return self._entries(lo, hi).drop("ord")

    def _entries(self, lo: bytes | None, hi: bytes | None) -> DataFrame:
        self._alive()
        lo, hi = self._bound(lo), self._bound(hi)
        names = [self._run(f.number) for f in self.version.files if f.meets(lo, hi)] + [self._log(n) for n in self.logs]
        return R.key_range(self._ordered(self._read(names)), None if lo is None else bytearray(lo), None if hi is None else bytearray(hi), "ord")

    def scan(self, lo: bytes | None = None, hi: bytes | None = None, snapshot: int | None = None, reverse: bool = False) -> DataFrame:
        """Live (user_key, value) in key order, as of now or of a snapshot; later writes don't show."""
        rows = R.resolve(self._entries(lo, hi), self.last_sequence if snapshot is None else snapshot, "ord")
        return rows.orderBy(F.col("ord").desc() if reverse else F.col("ord").asc()).select("user_key", "value")

    def get(self, key: bytes, snapshot: int | None = None) -> bytes | None:
        """The value; the first file that was looked at in vain is charged with a seek."""
        rows = R.as_of(self._entries(key, key).withColumn("file", F.input_file_name()), self.last_sequence if snapshot is None else snapshot)
        row = rows.orderBy(F.col("seq").desc()).select("vtype", "value", "file").first()
        asked = list(self.version.for_each_overlapping(self._bound(key)))
        if len(asked) > 1 and (row is None or f"/{self._run(asked[0].number)}/" not in row["file"]):
            self.seeks.charge(asked[0])
        return None if row is None or row["vtype"] == DELETION else bytes(row["value"])

    def record_read_sample(self, key: bytes) -> bool:
        """Charge a sampled read of an iterator: the first file, if more than one holds the key's range. True if that asks for a compaction."""
        asked = list(self.version.for_each_overlapping(self._bound(key)))
        return len(asked) > 1 and self.seeks.charge(asked[0])

    def versions(self, key: bytes) -> list[bytes | None]:
        """Every stored version, newest first; None is a tombstone."""
        rows = self._entries(key, key).orderBy(F.col("seq").desc()).collect()
        return [None if r["vtype"] == DELETION else bytes(r["value"]) for r in rows]

    def approximate_size(self, lo: bytes, hi: bytes) -> int:
        """Stored bytes in [lo, hi); entries that no run holds yet don't count."""
        lo, hi = self._bound(lo), self._bound(hi)
        inside = [f for f in self.version.files if f.meets(lo, hi)]
        # whole files count by their size; only those at the ends are read
        whole = [f for f in inside if lo <= f.smallest and f.largest < hi]
        runs = self._ordered(self._read([self._run(f.number) for f in inside if f not in whole]))
        return sum(f.size for f in whole) + M.range_size(runs.select(F.col("ord").alias("user_key"), _size().alias("size")), bytearray(lo), bytearray(hi)).first()[0]

    # ---- flush and compaction ----

    def _sink(self, entries: DataFrame, level: int | None, max_file: int, cuts: list[bytes] = ()) -> list[File]:  # type: ignore[assignment]
        """Entries as sorted runs; level None (a flush: rows as they come, cut anywhere) is chosen by what is in the way."""
        entries = self._ordered(entries)
        cut = C.split_rows(entries, _size(), max_file, "ord") if level is None else C.split_outputs(entries, _size(), max_file, "ord", [bytearray(c) for c in cuts])
        first = self._number()
        temp = f"{first:06d}.dbtmp"
        sorted_ = cut.repartition("out_no").sortWithinPartitions("out_no", "ord", F.col("seq").desc())
        writer = sorted_.select("user_key", "seq", "vtype", "value", "out_no").write.partitionBy("out_no")
        (bloom.stored(writer, keys=self.bloom_keys) if self.bloom_keys else writer).parquet(self.folder.at(temp))
        back = self._ordered(self.spark.read.schema(f"{ENTRY}, out_no long").parquet(self.folder.at(temp)))
        order = F.struct("ord", -F.col("seq"))
        rows = back.groupBy("out_no").agg(F.sum(_size()).alias("size"), F.min("ord").alias("lo"), F.min_by("seq", order).alias("ls"), F.max("ord").alias("hi"), F.max_by("seq", order).alias("hs")).orderBy("out_no").collect()
        out = []
        for r in rows:  # a row for each output file
            number = self._number()
            self.folder._fs.rename(self.folder._path(f"{temp}/out_no={r['out_no']}"), self.folder._path(self._run(number)))
            lo, hi = bytes(r["lo"]), bytes(r["hi"])
            out.append(File(self.version.flush_level(lo, hi, self.limits) if level is None else level, number, r["size"], lo, r["ls"], hi, r["hs"]))
        self.folder.remove(temp)
        return out

    def _install(self, gone: Iterable[File], new: list[File], done: list[int] = (), pointer: tuple[int, bytes] | None = None) -> None:  # type: ignore[assignment]
        gone = {(f.level, f.number) for f in gone}
        version = self.version.edited(gone, new)
        edit = {"gone": sorted(gone), "new": [f.json() for f in new], "done": list(done)}
        if pointer:
            self.pointers[pointer[0]] = pointer[1]
            edit["pointers"] = {str(pointer[0]): pointer[1].hex()}
        self._append(edit)
        self.version, self.logs = version, [n for n in self.logs if n not in set(done)]

    def flush(self) -> list[File]:
        """Logs to runs of bounded size."""
        with self._latched():
            if not self.logs:
                return []
            done = list(self.logs)
            new = self._sink(self._read([self._log(n) for n in done]), None, self.limits.flush_file)
            self._install([], new, done)
            self.buffered = 0
            return new

    def _compact(self, job: Job) -> None:
        if job.reason != "manual" and job.moves(self.version, self.limits):
            self._install(job.base, [job.moved()], pointer=(job.level, job.base[0].largest))
            return
        began = time.monotonic()
        lo, hi = span(list(job.inputs))
        entries = self._ordered(self._read([self._run(f.number) for f in job.inputs]))
        deeper = [f for f in self.version.files if f.level >= job.level + 2 and f.meets(lo, hi)]
        if len(deeper) <= FEW_RANGES:
            may = F.lit(False)
            for f in deeper:
                may = may | ((F.col("ord") >= F.lit(bytearray(f.smallest))) & (F.col("ord") <= F.lit(bytearray(f.largest))))
            entries = entries.withColumn("deeper", may)
        else:
            files = self.spark.createDataFrame([(f.level, bytearray(f.smallest), bytearray(f.largest)) for f in deeper], "level int, smallest_key binary, largest_key binary")
            entries = C.may_be_deeper(entries, files, job.level, "ord")
        kept = C.retain(entries, self.snapshots.oldest(self.last_sequence), F.col("deeper"), "ord").drop("deeper", "ord")
        new = self._sink(kept, job.level + 1, self.limits.max_file, job.cuts(self.version, self.limits))
        self._install(job.inputs, new, pointer=(job.level, max(f.largest for f in job.base)))
        into = self.stats[job.level + 1]
        into.seconds, into.bytes_read, into.bytes_written = into.seconds + time.monotonic() - began, into.bytes_read + job.bytes_read, into.bytes_written + sum(f.size for f in new)

    def compact_once(self, sought: File | None = None) -> bool:
        """One step of background work; False when there is nothing to do."""
        with self._latched():
            found = pick(self.version, self.pointers, self.limits, sought or self.seeks.take(self.version))
            if found:
                self._compact(found)
            return found is not None

    def compact_range(self, lo: bytes | None = None, hi: bytes | None = None) -> None:
        """Flush, then push every level's files of the range one level down."""
        self.flush()
        lo, hi = self._bound(lo), self._bound(hi)
        deepest = max((f.level for f in self.version.files if f.meets(lo, hi)), default=0)
        for level in range(min(deepest + 1, MAX_LEVELS - 1)):
            todo = {f.number for f in self.version.overlapping(level, lo, hi)}
            while todo:
                job = pick_range(self.version, level, lo, hi, self.limits)
                if job is None:
                    break
                with self._latched():
                    self._compact(job)
                todo &= {f.number for f in self.version.level(level)}

    def collect_garbage(self) -> list[str]:
        """Delete files that neither the version nor a pending log names; frames read before a compaction need them until then."""
        keep = {self._run(f.number) for f in self.version.files} | {self._log(n) for n in self.logs}
        gone = []
        for n in self.folder.list():
            kind = filenames.parse(n)
            if kind and kind[0] in ("log", "table", "temp") and n not in keep:
                self.folder.remove(n)
                gone.append(n)
        return gone
