"""Operator 7: packing by power-of-two decomposition.

Each document is tokenised, gets an end id, and is cut into pieces whose lengths are powers of two: as many
of the largest length as fit, then the binary digits of the rest, large to small. Pieces of one length
form a bucket, and each piece is a training sequence by itself: no sequence crosses documents and nothing
is padded, since every length is a power of two. The work is one pass over the documents without a shuffle.

Words between ASCII white space are tokenised when first met and kept in a table in each Python worker, of bounded
bytes and in two generations, so that words in use outlive it when it is full: this vocabulary's rules
never look across white space. Words of plain Latin letters, digits and signs are cut
into the tokenizer's own parts first, so that a word with and without signs is learnt once.

Defined results: a null text is the empty text (one piece, the end id alone); repeated rows are packed
each; a null id stays null; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.workers import Idle
from varve.session import small_batches

LONGEST = 2048
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Bytes of one generation of a worker's tables of words and of their parts, what an entry costs beside its own bytes, and rows that are looked up at a time.
CACHE, PARTS, ENTRY, ROWS = 32 << 20, 16 << 20, 160, 256

_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+").fullmatch
# how this vocabulary's file cuts lower-case Latin text into parts
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall

# ids as bytes, by their number
_PACK = [Struct(f"<{n}I").pack for n in range(32)]

# the sign this vocabulary has for a byte: the byte's own where it shows and is no space, else the next one from 256 on
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_SIGNS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def _lower(raw: bytes) -> bytes:
    """A-Z in lower case, as the vocabulary's rules will have it: one entry for both cases.

    Not where a special token may be, nor a combining mark (U+0300 to U+037F), which is composed with a letter first.
    """
    return raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()


class Table(dict):
    """Values by name, made when first asked for, of bounded bytes: when full it becomes the old half, and what is asked for again is taken from there."""

    def __init__(self, limit: int, make: Callable[[bytes | str], bytes]):
        super().__init__()
        self.limit, self.make, self.old, self.size = limit, make, {}, 0

    def forget(self) -> None:
        self.clear()
        self.old, self.size = {}, 0

    def __missing__(self, name: bytes | str) -> bytes:
        value = self.old.get(name)
        if value is None:
            value = self.make(name)
        self.size = size = self.size + ENTRY + len(name) + len(value)
        if size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        self[name] = value
        return value


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, words and their parts remembered."""

    def __init__(self, path: str, limit: int = CACHE, parts: int = PARTS):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.merge = self.t.model.tokenize
        self.words, self.parts = Table(limit, self._word), Table(parts, self._part)
        self.idle = Idle(self.forget)

    def forget(self) -> None:
        self.words.forget()
        self.parts.forget()

    def _part(self, part: str) -> bytes:
        """Ids of a plain part in lower case: only the merges are left to do."""
        ids = [t.id for t in self.merge(part if part.isascii() else part.encode().decode("latin-1").translate(_SIGNS))]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        x = word.decode()
        if x.isascii():
            # a word of Latin letters alone is a part by itself, and a sign or digit behind them is another
            if x.isalpha():
                return self.parts[x.lower()]
            if (body := x[:-1]).isalpha() and x.isprintable():
                return self.parts[body.lower()] + self.parts[x[-1]]
        if _PLAIN(x) and "<|" not in x:
            return b"".join([self.parts[p] for p in _PARTS(x.lower())])
        return np.array(self.t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.words.__getitem__
        return [b"".join(map(get, _lower((x or "").encode()).split())) for x in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker: its tables serve all tasks of the worker, and are emptied when it has none."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole largest pieces, then the binary digits of what is left."""
    out = [(i, longest) for i in range(0, n - n % longest, longest)]
    at, rest, size = n - n % longest, n % longest, longest
    while rest:
        size >>= 1
        if rest >= size:
            out.append((at, size))
            at, rest = at + size, rest - size
    return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", longest: int = LONGEST, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids binary, doc_tokens, sequence_id, offset), a row for each piece.

    ids: little-endian unsigned 32-bit. path: of the vocabulary, readable by every worker.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    tail = np.array([end], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        with e.idle:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    yield of(b.slice(at, ROWS), e)

    def of(part: pa.RecordBatch, e: Encoder) -> pa.RecordBatch:
        raw = [x + tail for x in e.encode(part.column(1).to_pylist())]
        cut = [pieces(len(x) // 4, longest) for x in raw]
        rows = np.repeat(np.arange(len(raw)), [len(c) for c in cut])
        start = [s for c in cut for s, _ in c]
        length = [n for c in cut for _, n in c]
        ids = [raw[r][4 * s : 4 * (s + n)] for r, s, n in zip(rows, start, length, strict=True)]
        total = np.array([len(x) // 4 for x in raw], np.int64)[rows]
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total)],
            ["doc_id", "start", "length", "ids", "doc_tokens"],
        )

    small_batches(docs.sparkSession)
    out = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Parquet with a folder for each length: a batch of one bucket needs no padding."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
