"""Byte functions against fixed vectors, as columns and as plain functions."""

import zlib

import pytest
from pyspark.sql import functions as F

from varve.functions import bloom as BF
from varve.functions import bytes as B
from varve.functions.ordering import BYTEWISE, HEX_NUMBER, suffixed
from varve.operators.batch import varint_length
from varve.sources import codec, filenames

H = bytes.fromhex


def column(spark, rows, kind, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}")
    return [r[0] for r in df.select("i", expr.alias("o")).orderBy("i").select("o").collect()]


def test_crc(spark):
    data = [bytes(32), b"\xff" * 32, bytes(range(32)), bytes(range(31, -1, -1))]
    want = [0x190A55AD, 0xFF6CAB0B, 0x91267E8A, 0x9AB0EF72]
    assert column(spark, [(bytearray(d),) for d in data], "b binary", F.crc32("b")) == want
    assert [codec.crc(d) for d in data] == want
    assert codec.crc(b"hello ", b"world") == zlib.crc32(b"hello world")
    assert column(spark, [(bytearray(b"hello "), bytearray(b"world"))], "a binary, b binary", B.crc_extend(F.col("a"), F.col("b"))) == [zlib.crc32(b"hello world")]


def test_mask(spark):
    crcs = [0, 1, 0xFFFFFFFF, 0x190A55AD]
    masked = column(spark, [(c,) for c in crcs], "c long", B.mask(F.col("c")))
    assert masked == [codec.mask(c) for c in crcs]
    assert column(spark, [(m,) for m in masked], "m long", B.unmask(F.col("m"))) == crcs
    assert all(codec.unmask(codec.mask(c)) == c and codec.mask(c) != c for c in crcs)


def test_hash32(spark):
    data = [b"", H("62"), H("c397"), H("e299a5"), H("e180b932")]
    got = column(spark, [(bytearray(d),) for d in data], "b binary", B.hash32(F.col("b"), 0xBC9F1D34))
    assert got == [0xBC9F1D34, 0xEF1345C4, 0x5B663814, 0x323C078F, 0xED21633A]


def test_varint(spark):
    rows = {0: "00", 100: "64", 129: "8101", 258: "8202", 58962304: "80E38E1C", (1 << 62): codec.varint(1 << 62).hex().upper()}
    assert column(spark, [(n,) for n in rows], "n long", B.varint_hex(F.col("n"))) == list(rows.values())
    assert column(spark, [(n,) for n in rows], "n long", varint_length(F.col("n"))) == [len(v) // 2 for v in rows.values()]
    for n, h in rows.items():
        assert codec.varint(n).hex().upper() == h
        assert codec.varint_at(H(h)) == (n, len(h) // 2)
    with pytest.raises(codec.Corruption):
        codec.varint_at(b"\xff" * 12)


def test_fixed_and_keys(spark):
    assert column(spark, [(258,)], "n long", B.fixed_hex(F.col("n"), 4)) == ["02010000"]
    assert column(spark, [(bytearray(H("0201")),)], "b binary", B.fixed_value(F.col("b"))) == [258]
    ik = codec.internal_key(b"foo", 100, 1)
    assert [bytes(x) for x in column(spark, [(bytearray(b"foo"), 100, 1)], "k binary, s long, t int", B.internal_key(F.col("k"), F.col("s"), F.col("t")))] == [ik]
    assert codec.parse_internal(ik) == (b"foo", 100, 1)
    assert codec.parse_internal(b"short") is None and codec.parse_internal(b"foo" + b"\x05" + bytes(7)) is None
    got = column(spark, [(bytearray(ik),), (bytearray(b"x"),)], "k binary", B.user_key(F.col("k")))
    assert bytes(got[0]) == b"foo" and got[1] is None
    assert [bytes(x) for x in column(spark, [(bytearray(b""),), (bytearray(b"ab"),)], "k binary", B.prefixed(F.col("k")))] == [b"\x00", b"\x02ab"]


SEPARATORS = [("", "1111", ""), ("1111", "", "1111"), ("123", "1234", "123"), ("1", "2", "1"), ("1111", "12345", "1111"), ("1111", "13345", "12")]


def test_separator_and_successor(spark):
    rows = [(bytearray(a.encode()), bytearray(b.encode())) for a, b, _ in SEPARATORS]
    assert [bytes(x).decode() for x in column(spark, rows, "a binary, b binary", B.separator(F.col("a"), F.col("b")))] == [r for _, _, r in SEPARATORS]
    keys = {b"": b"", b"111": b"2", b"222": b"3", H("ffff01"): H("ffff02"), H("ffffff"): H("ffffff")}
    assert [bytes(x) for x in column(spark, [(bytearray(k),) for k in keys], "k binary", B.successor(F.col("k")))] == list(keys.values())


def test_bloom(spark):
    keys = spark.range(2000).select(F.lit(1).alias("g"), F.unhex(B.fixed_hex(F.col("id"), 4)).alias("k"))
    built = BF.build(keys, "g", "k")
    asks = spark.range(12000).select(F.lit(1).alias("g"), "id", F.unhex(B.fixed_hex(F.col("id"), 4)).alias("k"))
    r = asks.join(built, "g").select("id", BF.may_contain(F.col("k"), F.col("n_bits"), F.col("bits"), BF.probes_per_key(10)).alias("m"))
    got = r.groupBy((F.col("id") < 2000).alias("there")).agg(F.avg(F.col("m").cast("double")).alias("rate")).collect()
    rate = {x["there"]: x["rate"] for x in got}
    assert rate[True] == 1.0 and rate[False] <= 0.02
    assert BF.probes_per_key(10) == 6 and BF.probes_per_key(1) == 1 and BF.probes_per_key(100) == 30


def test_comparators(spark):
    df = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"", b"\x80", b"\x7f\x00", b"\x7f", b"\xff")], "user_key binary").withColumn("seq", F.lit(1))
    assert [bytes(r[0]) for r in df.orderBy(*BYTEWISE.internal()).collect()] == [b"", b"a", b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]
    hexes = spark.createDataFrame([("14",), ("a",), ("0x5",)], "k string")
    assert [r[0] for r in hexes.orderBy(HEX_NUMBER.order(F.col("k"))).collect()] == ["0x5", "a", "14"]
    pairs = spark.createDataFrame([(bytearray(b"a\x01"),), (bytearray(b"a\x02"),), (bytearray(b"b\x00"),)], "k binary")
    assert [bytes(r[0]) for r in pairs.orderBy(suffixed(1).order(F.col("k"))).collect()] == [b"a\x02", b"a\x01", b"b\x00"]


def test_file_names(spark):
    names = {("log", 10): "000010.log", ("lock", 0): "LOCK", ("table", 123): "000123.sst", ("manifest", 9): "MANIFEST-000009", ("current", 0): "CURRENT", ("temp", 100): "000100.dbtmp", ("info", 0): "LOG", ("old_info", 0): "LOG.old"}
    for (kind, n), text in names.items():
        assert filenames.name(kind, n) == text and filenames.parse(text) == (kind, n)
    for bad in ("", "foo", "foo-dx-100.log", ".log", "manifest-3", "CURREN", "100"):
        assert filenames.parse(bad) is None
    df = spark.createDataFrame([(t,) for t in names.values()], "name string")
    got = df.select("name", filenames.kind_expr(F.col("name")).alias("k"), filenames.number_expr(F.col("name")).alias("n")).collect()
    assert {r["name"]: (r["k"], r["n"]) for r in got} == {t: k for k, t in names.items()}
