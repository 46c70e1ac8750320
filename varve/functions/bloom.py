"""Bloom filters with bit-exact probes, built by aggregation; and the Parquet writer's own for stored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from varve.functions.bytes import BLOOM_SEED, HASH_MULTIPLIER, WORD32, _let, hash32

LEAST_BITS = 64


def probes_per_key(bits_per_key: int) -> int:
    """0.69 of the bits per key, from 1 to 30."""
    return min(30, max(1, int(bits_per_key * 0.69)))


def probe_bits(key: Column, n_bits: Column, k: int) -> Column:
    """Bits of a key: double hashing, the step is the hash turned by 17."""

    def bits(h: Column) -> Column:
        step = F.shiftright(h, 17).bitwiseOR(F.shiftleft(h, 15).bitwiseAND(F.lit(WORD32)))
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.pmod((h + j.cast("long") * step).bitwiseAND(F.lit(WORD32)), n_bits))

    return _let(hash32(key, BLOOM_SEED), bits)


def build(keys: DataFrame, group: str, key: str, bits_per_key: int = 10) -> DataFrame:
    """(group, n_bits, bits, n_probes): one filter for each group, over user keys. bits: the distinct set bits."""
    k = probes_per_key(bits_per_key)
    n = keys.groupBy(group).agg((F.ceil(F.greatest(F.count(F.lit(1)) * bits_per_key, F.lit(LEAST_BITS)) / 8) * 8).cast("long").alias("n_bits"))
    hit = keys.join(n, group).select(group, "n_bits", F.explode(probe_bits(F.col(key), F.col("n_bits"), k)).alias("bit"))
    return hit.groupBy(group, "n_bits").agg(F.collect_set("bit").alias("bits")).withColumn("n_probes", F.lit(k))


def may_contain(key: Column, n_bits: Column, bits: Column, k: int) -> Column:
    """False only for keys that are not there; a filter without bits holds nothing."""
    if k > 30:
        return F.lit(True)
    return F.when(F.size(bits) == 0, F.lit(False)).otherwise(F.forall(probe_bits(key, n_bits, k), lambda b: F.array_contains(bits, b)))


def stored(writer: DataFrameWriter, key: str = "user_key", keys: int = 100_000) -> DataFrameWriter:
    """Parquet's own bloom filter on the key column of a run."""
    return writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys))


class Bloom:
    """The same filters as bytes, for table files: bits low to high, then the number of probes."""

    name = "BloomFilter"  # fixed value: under this name tables keep such filters

    def __init__(self, bits_per_key: int = 10):
        self.bits_per_key, self.k = bits_per_key, probes_per_key(bits_per_key)

    @staticmethod
    def _hash(key: bytes) -> int:
        h = BLOOM_SEED ^ (len(key) * HASH_MULTIPLIER & WORD32)
        whole = len(key) - len(key) % 4
        for i in range(0, whole, 4):
            h = (h + int.from_bytes(key[i : i + 4], "little")) * HASH_MULTIPLIER & WORD32
            h ^= h >> 16
        if whole < len(key):
            h = (h + int.from_bytes(key[whole:], "little")) * HASH_MULTIPLIER & WORD32
            h ^= h >> 24
        return h

    def _bits(self, key: bytes, n_bits: int, k: int) -> list[int]:
        h = self._hash(key)
        step = (h >> 17 | h << 15) & WORD32
        return [((h + j * step) & WORD32) % n_bits for j in range(k)]

    def build(self, keys: list[bytes]) -> bytes:
        size = (max(LEAST_BITS, len(keys) * self.bits_per_key) + 7) // 8
        out = bytearray(size)
        for key in keys:
            for b in self._bits(key, 8 * size, self.k):
                out[b // 8] |= 1 << b % 8
        return bytes(out) + bytes([self.k])

    def may_contain(self, bits: bytes, key: bytes) -> bool:
        if len(bits) < 2:
            return False
        if bits[-1] > 30:
            return True
        return all(bits[b // 8] >> b % 8 & 1 for b in self._bits(key, 8 * (len(bits) - 1), bits[-1]))
