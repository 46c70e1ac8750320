"""Store scenarios: snapshots, deletion, flush placement, compaction, recovery, open modes."""

import pytest

from varve.functions.ordering import HEX_NUMBER
from varve.plans.version import Limits
from varve.sources.blobs import _entries  # noqa: F401 - the module must import beside the store
from varve.store import Store, StoreError


@pytest.fixture
def store(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"), create_if_missing=True, limits=Limits(max_file=200), bloom_keys=1000)
    yield s
    s.close()


def test_reads_and_writes(store):
    assert store.get(b"foo") is None
    store.write([(b"foo", b"v1"), (b"bar", b"v2"), (b"foo", b"v3"), (b"", b"e"), (b"empty", b"")])
    assert (store.get(b"foo"), store.get(b"bar"), store.get(b""), store.get(b"empty")) == (b"v3", b"v2", b"e", b"")
    assert store.last_sequence == 5 and store.write([]) == 5
    store.delete(b"foo")
    assert store.get(b"foo") is None
    assert [bytes(r[0]) for r in store.scan().collect()] == [b"", b"bar", b"empty"]
    assert [bytes(r[0]) for r in store.scan(b"b", b"c", reverse=True).collect()] == [b"bar"]


def test_snapshots_flush_and_compaction(store):
    store.put(b"foo", b"v1")
    snap = store.snapshot()
    store.put(b"foo", b"v2")
    pinned = store.scan()
    assert store.flush()[0].level == 2
    store.put(b"foo", b"v3")
    assert store.flush()[0].level == 1
    assert (store.get(b"foo"), store.get(b"foo", snap)) == (b"v3", b"v1")
    assert [bytes(r[1]) for r in pinned.collect()] == [b"v2"]
    store.delete(b"foo")
    store.compact_range()
    assert store.get(b"foo") is None and store.get(b"foo", snap) == b"v1"
    store.release(snap)
    store.compact_range()
    assert store.versions(b"foo") == []


def test_automatic_compaction_and_sizes(store):
    for i in range(4):
        store.write([(f"key{k:03d}".encode(), b"x" * 20) for k in range(0, 30, 3)] + [(b"zz", str(i).encode())])
        store.flush()
        store.version = type(store.version)([f.__class__(**{**{s: getattr(f, s) for s in f.__dataclass_fields__}, "level": 0}) for f in store.version.files])
    before = store.scan().collect()
    assert store.compact_once()
    assert store.version.counts()[0] == 0 and store.version.counts()[1] > 1
    assert store.scan().collect() == before and store.get(b"zz") == b"3"
    assert store.approximate_size(b"key000", b"key030") > 0 and store.approximate_size(b"x", b"a") == 0
    while store.compact_once():
        pass


def test_recovery_and_open_modes(spark, tmp_path):
    path = str(tmp_path / "db")
    with pytest.raises(StoreError, match="does not exist"):
        Store.open(spark, path)
    with Store.open(spark, path, create_if_missing=True) as s:
        s.put(b"a", b"1")
        s.flush()
        s.put(b"b", b"2")
        s.delete(b"a")
        with pytest.raises(StoreError, match="locked"):
            Store.open(spark, path)
        with pytest.raises(StoreError, match="locked"):
            Store.destroy(spark, path)
    with pytest.raises(StoreError, match="closed"):
        s.get(b"a")
    with pytest.raises(StoreError, match="exists"):
        Store.open(spark, path, error_if_exists=True)
    with pytest.raises(StoreError, match="comparator"):
        Store.open(spark, path, comparator=HEX_NUMBER)
    with Store.open(spark, path) as s:
        assert (s.get(b"a"), s.get(b"b"), s.last_sequence) == (None, b"2", 3)
        s.folder.remove(s._run(s.version.files[0].number))
    with pytest.raises(StoreError, match="missing file"):
        Store.open(spark, path)
    with Store.open(spark, path, paranoid=False) as s, pytest.raises(StoreError, match="read only"):
        s.put(b"x", b"1")
    Store.destroy(spark, path)
    with pytest.raises(StoreError, match="does not exist"):
        Store.open(spark, path)


def test_recovery_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "db")
    one = Store.open(spark, path, create_if_missing=True)
    one.put(b"a", b"1")
    append, one._append = one._append, lambda edit: (_ for _ in ()).throw(OSError("disk"))
    with pytest.raises(OSError):
        one.put(b"b", b"2")  # the log is whole, its edit is not there
    one._append = append
    with pytest.raises(StoreError, match="failed"):
        one.put(b"c", b"3")
    with pytest.raises(StoreError, match="locked"):
        Store.open(spark, path)
    with Store.open(spark, path, force=True) as two:
        assert (two.get(b"a"), two.get(b"b"), two.get(b"c"), two.last_sequence) == (b"1", b"2", None, 2)
        one.error = None
        with pytest.raises(StoreError, match="taken over"):
            one.put(b"d", b"4")
        edit = f"MANIFEST-000000/{two._edit:012d}.json"
        two.folder.write(edit, '{"logs": []}')
    with pytest.raises(StoreError, match="corrupt manifest"):
        Store.open(spark, path)


def test_a_comparator_orders_the_store(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "db"), create_if_missing=True, comparator=HEX_NUMBER) as s:
        s.write([(b"9", b"nine"), (b"0x10", b"sixteen"), (b"a", b"ten"), (b"0x2", b"two")])
        s.flush()
        s.write([(b"10", b"again"), (b"0xff", b"much")])
        assert [bytes(r[0]) for r in s.scan().collect()] == [b"0x2", b"9", b"a", b"10", b"0xff"]
        assert [bytes(r[1]) for r in s.scan(b"9", b"0x10").collect()] == [b"nine", b"ten", b"again"]
        s.compact_range()
        assert s.get(b"0x10") == b"again" and s.get(b"0x09") == b"nine" and s.get(b"11") is None
        assert len(s.versions(b"16"[:0] + b"10")) == 1


def test_room_seeks_and_cuts(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "db"), create_if_missing=True, auto=True, limits=Limits(write_buffer=1, flush_file=120, max_file=100)) as s:
        s.write([(b"hot", b"x" * 40)] * 8 + [(b"zoo", b"1")])
        s.put(b"hot", b"new")  # flushes first
        assert len(s.version.files) > 2 and not s.version.level(0)  # one key goes on over files
        s.flush()
        assert s.get(b"hot") == b"new" and len(s.versions(b"hot")) == 9
        first = next(s.version.for_each_overlapping(b"hot"))
        s.seeks.left[first.number] = 1
        assert s.record_read_sample(b"hot") and s.seeks.sought == first
        assert s.compact_once() and s.get(b"hot") == b"new"
        s.compact_range()
        assert s.versions(b"hot") == [b"new"] and sum(x.bytes_written for x in s.stats) > 0


def test_stream(spark, store, tmp_path):
    from varve.streaming.ingest import ingest

    src = tmp_path / "in"
    df = spark.createDataFrame([(0, 1, bytearray(b"k"), bytearray(b"1")), (1, 0, bytearray(b"k"), None), (2, 1, bytearray(b"m"), bytearray(b"2"))], "pos long, vtype int, user_key binary, value binary")
    df.coalesce(1).write.parquet(str(src))
    for _ in range(2):  # the second run has nothing new
        q = ingest(spark.readStream.schema(df.schema).parquet(str(src)), store, str(tmp_path / "cp"))
        q.awaitTermination()
    assert store.get(b"k") is None and store.get(b"m") == b"2" and store.last_sequence == 3
