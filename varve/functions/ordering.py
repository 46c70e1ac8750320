"""Comparators as sort expressions, with the name under which a store remembers them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Comparator:
    """order: a key column to an expression that sorts as the comparator does.

    sortable and sortable_key: the same order as bytes, as an expression and of one key. Keys with equal bytes
    are one key to a store.
    """

    name: str
    order: Callable[[Column], Column]
    sortable: Callable[[Column], Column] = lambda k: k
    sortable_key: Callable[[bytes], bytes] = bytes

    def internal(self, key: str = "user_key") -> list[Column]:
        """Internal order: user key ascending, then the newest version first; the type does not count."""
        return [self.order(F.col(key)).asc(), F.col("seq").desc()]


#: Unsigned bytes, a prefix before what it begins: how BINARY sorts.
BYTEWISE = Comparator("bytewise", lambda k: k)
#: Keys that are hexadecimal numbers in text.
HEX_NUMBER = Comparator(
    "hex-number",
    lambda k: F.conv(F.regexp_replace(k.cast("string"), "^0[xX]", ""), 16, 10).cast("decimal(20,0)"),
    lambda k: F.unhex(F.lpad(F.regexp_replace(k.cast("string"), "^(?:0[xX])?0*", ""), 16, "0")),
    lambda k: int(k.decode(), 16).to_bytes(8, "big"),
)


def suffixed(width: int) -> Comparator:
    """Prefix ascending, then a fixed-width suffix descending."""
    return Comparator(f"suffix-{width}", lambda k: F.struct(F.substring(k, F.lit(1), F.octet_length(k) - width), F.translate(F.hex(F.substring(k, F.octet_length(k) - width + 1, F.lit(width))), "0123456789ABCDEF", "FEDCBA9876543210")))
