"""Names of a store's files, as column expressions and as functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names of a store.
SUFFIX = {"log": ".log", "table": ".sst", "temp": ".dbtmp"}
PLAIN = {"lock": "LOCK", "current": "CURRENT", "info": "LOG", "old_info": "LOG.old"}
_NUMBERED = re.compile(r"(?:MANIFEST-(\d+)|(\d+)\.(log|sst|dbtmp))\Z", re.ASCII)


def name(kind: str, number: int = 0) -> str:
    if kind in PLAIN:
        return PLAIN[kind]
    return f"MANIFEST-{number:06d}" if kind == "manifest" else f"{number:06d}{SUFFIX[kind]}"


def parse(text: str) -> tuple[str, int] | None:
    """(kind, number), or None for a name that is no file of a store."""
    for kind, plain in PLAIN.items():
        if text == plain:
            return kind, 0
    m = _NUMBERED.match(text)
    if not m:
        return None
    number = int(m[1] or m[2])
    if number >= 1 << 64:
        return None
    return ("manifest" if m[1] else next(k for k, s in SUFFIX.items() if s == f".{m[3]}")), number


def name_expr(kind: Column, number: Column) -> Column:
    digits = F.lpad(number.cast("string"), 6, "0")
    out = F.when(kind == "manifest", F.concat(F.lit("MANIFEST-"), digits))
    for k, suffix in SUFFIX.items():
        out = out.when(kind == k, F.concat(digits, F.lit(suffix)))
    return out


def kind_expr(text: Column) -> Column:
    out = F.when(text.rlike(r"^MANIFEST-[0-9]+$"), "manifest")
    for k, suffix in SUFFIX.items():
        out = out.when(text.rlike(rf"^[0-9]+\{suffix}$"), k)
    for k, plain in PLAIN.items():
        out = out.when(text == plain, k)
    return out


def number_expr(text: Column) -> Column:
    return F.when(kind_expr(text).isNotNull(), F.coalesce(F.regexp_extract(text, "([0-9]+)", 1).try_cast("bigint"), F.lit(0)))
