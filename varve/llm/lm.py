"""Operator 4: language-model scores by a gated recurrent network in numpy.

Counts: every token of every training document is counted; words are held as bytes, A-Z lower-cased. The
most frequent words (``HEAD`` at most, cut by count) are broadcast with their counts; all others are joined
by word, so counts are exact for any vocabulary.

Model: a gated recurrent unit reads a document token by token and its state is carried from window to
window to the document's end. The output softmax is factored by class: the ``CLASSES`` x ``MEMBERS`` most
frequent words are put in classes of like frequency with a learned softmax inside each class; the end
token is a class of its own; any other word is in one of ``TAILS`` classes by its last two bytes, inside
which its probability is its smoothed share of the class's count. Each class of rest words keeps 0.1 for an
unknown word, so the model is a distribution.

A text is looked up once: its model ids are written as 16-bit numbers, and training and scoring read those.

Training is truncated backpropagation through windows of ``WINDOW`` tokens: first in one task over a
sample of about ``START_TOKENS`` tokens, then over all training documents, dealt by hash to streams of about
``STREAM`` tokens, each from the same start; weights are averaged by tokens in a tree of fixed order. So every
token of every training document is counted and trains weights, and neither the layout of the files nor
the number of tasks has an effect; the start only gives the streams a common point to leave from.

Defined results: a null text is the empty text (the end token alone); a null id counts as the empty text
in the split; repeated rows are scored each; an empty table gives no rows; without training documents
every token is unknown; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.workers import tidy
from varve.session import small_batches, stash

HEAD = 1 << 18
CLASSES, MEMBERS, TAILS, UNITS = 48, 32, 16, 16
WINDOW, LANES, RATE = 32, 64, 0.1
#: Lanes of a stream's training, which has more documents than the start.
WIDE = 256
START_TOKENS, STREAM, SEED = 300_000, 2_000_000, 4
SMOOTH = 0.1
END = b"\n"
FLUSH = 400_000
#: Tokens that a scoring or training task holds at a time, documents scored in step, and rows looked up at a time.
HELD, TRAINED, STEP, ROWS = 6_000_000, 500_000, 1024, 512
#: Tokens of a call for output probabilities in scoring, about.
OUT = 16_384
#: Weights that a task averages.
FAN = 32


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end token."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ws.append(END)
    return ws


def split_of(key: Column) -> Column:
    """crc32 of the id as text, modulo 10: 0 is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10


def count(training: DataFrame) -> DataFrame:
    """(w binary, c long) of training documents (text), every token counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(tokens(text))
                if len(seen) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["w", "c"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["w", "c"])

    return training.select("text").mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def tail_class(w: bytes) -> int:
    return zlib.crc32(w[-2:]) % TAILS


class Vocabulary:
    """Counts of the head words, the classes, and the totals; words are looked up by their bytes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, tail_mass: np.ndarray):
        """words: by falling count, END among them; tail_mass: sum of c + SMOOTH by tail class over all words but END."""
        self.n, self.v = n, v
        self.index = {w: k for k, w in enumerate(words)}
        self.counts = np.asarray(counts, np.int64)
        inner = [k for k, w in enumerate(words) if w != END][: CLASSES * MEMBERS]
        # model ids: 0 is the end, then members of classes, then rest classes
        self.ids = np.array([0 if w == END else 1 + CLASSES * MEMBERS + tail_class(w) for w in words], np.int32)
        self.ids[inner] = 1 + np.arange(len(inner))
        mass = np.asarray(tail_mass, float).copy()
        for k in inner:
            mass[tail_class(words[k])] -= counts[k] + SMOOTH
        self.mass = np.maximum(mass, 0) + SMOOTH
        self.members = np.zeros(CLASSES * MEMBERS)
        self.members[: len(inner)] = self.counts[inner]
        self.real = np.arange(CLASSES * MEMBERS) < len(inner)
        self.end = float(self.counts[self.index[END]]) if END in self.index else 0.0

    def look(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, ws, itertools.repeat(-1)), np.int64, len(ws))


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, int]:
    """The vocabulary of a count table, and the least count of a head word. At most ``head`` words come to the driver."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    tail = F.crc32(F.substring("w", -2, 2)) % TAILS
    many = sorted(((r[0], r[1], r[2]) for r in counts.groupBy(step).agg(F.count(F.lit(1)), F.min("c")).collect()), reverse=True)  # a row for each sixteenth of a power of two
    room, least = head, 1 << 62
    for _, k, c in many:
        if k > room:
            break
        room, least = room - k, c
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    mass = np.zeros(TAILS)
    for k, m, many_of in counts.where(F.col("w") != F.lit(bytearray(END))).groupBy(tail).agg(F.sum("c"), F.count(F.lit(1))).collect():
        mass[k] = m + SMOOTH * many_of
    top = counts.where((F.col("c") >= least) | (F.col("w") == F.lit(bytearray(END)))).toArrow().sort_by([("c", "descending"), ("w", "ascending")])
    return Vocabulary(top.column(0).to_pylist(), top.column(1).to_numpy(), n, v, mass), least


# ---- the network ----


def start(voc: Vocabulary, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights under which the model is the smoothed unigram distribution, whatever the state."""
    rng = np.random.default_rng(seed)
    inner = np.where(voc.real, np.log(voc.members + SMOOTH), -1e9).reshape(CLASSES, MEMBERS)
    of_class = np.concatenate(([voc.end + SMOOTH], np.maximum(np.where(voc.real, voc.members + SMOOTH, 0).reshape(CLASSES, MEMBERS).sum(1), 1e-9), voc.mass))
    small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {
        "in": small(1 + CLASSES * MEMBERS + TAILS, 3 * UNITS) * 3, "rec": small(UNITS, 3 * UNITS) * 2, "bias": np.zeros(3 * UNITS, np.float32),
        "cls": small(UNITS, len(of_class)), "cls_b": np.log(of_class / of_class.sum()).astype(np.float32),
        "mem": small(CLASSES, UNITS, MEMBERS), "mem_b": np.maximum(inner - np.log(np.exp(inner).sum(1, keepdims=True) + 1e-30), -1e9).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _step(p: dict, x: np.ndarray, h: np.ndarray):
    """One token for each lane: gates and the new state."""
    return _gates(p, p["in"][x] + p["bias"], h)


def _gates(p: dict, a: np.ndarray, h: np.ndarray):
    r = h @ p["rec"]
    g = _sigmoid(a[:, : 2 * UNITS] + r[:, : 2 * UNITS])
    z, q, c = g[:, :UNITS], g[:, UNITS:], r[:, 2 * UNITS :]
    n = np.tanh(a[:, 2 * UNITS :] + q * c)
    return z, q, c, n, n + z * (h - n)


#: The class of each model id: the end, classes of members, rest classes.
_CLASS = np.concatenate(([0], np.repeat(np.arange(1, CLASSES + 1), MEMBERS), np.arange(CLASSES + 1, CLASSES + 1 + TAILS))).astype(np.uint8)


def _next(rec: np.ndarray, a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The new state alone; a, the gates' input, is written over."""
    r = h @ rec
    s, n = a[:, : 2 * UNITS], r[:, 2 * UNITS :]
    s += r[:, : 2 * UNITS]
    _sigmoid_in(s)
    n *= s[:, UNITS:]
    n += a[:, 2 * UNITS :]
    n = np.tanh(n)
    out = h - n
    out *= s[:, :UNITS]
    out += n
    return out


def class_of(y: np.ndarray) -> np.ndarray:
    return _CLASS[y]


def output(p: dict, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability (natural) of class and member of y given states h; with grad, adds gradients and returns that of h."""
    cls, ht = class_of(y), np.ascontiguousarray(h.T)
    rows = np.arange(len(y))
    # classes by tokens: sums and maxima run along whole rows
    u = p["cls"].T @ ht
    u += p["cls_b"][:, None]
    u -= u.max(0)
    lp = u[cls, rows]
    np.exp(u, out=u)
    s = u.sum(0)
    lp -= np.log(s)
    dh = None
    if grad is not None:
        u /= s
        u[cls, rows] -= 1
        grad["cls"] += ht @ u.T
        grad["cls_b"] += u.sum(1)
        dh = p["cls"] @ u
    inner = np.flatnonzero((cls > 0) & (cls <= CLASSES))
    order = inner[np.argsort(cls[inner], kind="stable")]
    cut = np.searchsorted(cls[order], np.arange(1, CLASSES + 2))
    ho, m = ht[:, order], (y[order] - 1) % MEMBERS
    more, back = np.empty(len(order), lp.dtype), np.empty_like(ho)
    for k, (a, b) in enumerate(itertools.pairwise(cut.tolist())):
        if a == b:
            continue
        u = p["mem"][k].T @ ho[:, a:b]
        u += p["mem_b"][k][:, None]
        u -= u.max(0)
        of = rows[: b - a]
        more[a:b] = u[m[a:b], of]
        np.exp(u, out=u)
        s = u.sum(0)
        more[a:b] -= np.log(s)
        if grad is not None:
            u /= s
            u[m[a:b], of] -= 1
            grad["mem"][k] += ho[:, a:b] @ u.T
            grad["mem_b"][k] += u.sum(1)
            back[:, a:b] = p["mem"][k] @ u
    lp[order] += more
    if grad is not None:
        dh[:, order] += back
        dh = np.ascontiguousarray(dh.T)
    return lp, dh


def _rows(at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of at, and the rows of d summed by them."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # 16-bit numbers are sorted by digits
    there = at[order]
    cut = np.flatnonzero(np.diff(there, prepend=-1))
    return there[cut], np.add.reduceat(d[order], cut, axis=0)


def window(p: dict, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """One window of tokens by lanes: gradients of the loss, the words that ``in`` has them for, and the state behind it."""
    steps, lanes = y.shape
    g = {k: np.zeros_like(v) for k, v in p.items() if k != "in"}
    fresh = x == 0  # a document begins behind an end
    any_fresh = fresh.any(1).tolist()
    kind = p["rec"].dtype
    a = p["in"][x]
    a += p["bias"]
    rec, (begin, states) = p["rec"], np.empty((2, steps, lanes, UNITS), kind)  # what a step begins and ends with
    gates, kept = np.empty((steps, lanes, 2 * UNITS), kind), np.empty((2, steps, lanes, UNITS), kind)
    for t in range(steps):
        begin[t] = states[t - 1] if t else h
        if any_fresh[t]:
            begin[t][fresh[t]] = 0
        r = begin[t] @ rec
        s = gates[t]
        np.add(a[t, :, : 2 * UNITS], r[:, : 2 * UNITS], out=s)
        _sigmoid_in(s)
        c, n = r[:, 2 * UNITS :], kept[1, t]
        kept[0, t] = c
        np.multiply(s[:, UNITS:], c, out=n)
        n += a[t, :, 2 * UNITS :]
        np.tanh(n, out=n)
        new = states[t]
        np.subtract(begin[t], n, out=new)
        new *= s[:, :UNITS]
        new += n
    _, dh_all = output(p, states.reshape(-1, UNITS), y.ravel(), g)
    dh_all = dh_all.reshape(steps, lanes, UNITS)
    # what doesn't depend on the state's gradient, for all steps at once
    z, q, (c, n) = gates[:, :, :UNITS], gates[:, :, UNITS:], kept
    to_z, to_n, to_q = (begin - n) * (z * (1 - z)), (1 - z) * (1 - n * n), c * (q * (1 - q))
    back, turned = np.zeros((lanes, UNITS), kind), np.ascontiguousarray(rec.T)
    d_in, d_rec = np.empty((steps, lanes, 3 * UNITS), kind), np.empty((lanes, 3 * UNITS), kind)
    for t in range(steps - 1, -1, -1):
        dh = dh_all[t] + back
        d = d_in[t]
        dn = d[:, 2 * UNITS :]
        np.multiply(dh, to_n[t], out=dn)
        np.multiply(dh, to_z[t], out=d[:, :UNITS])
        np.multiply(dn, to_q[t], out=d[:, UNITS : 2 * UNITS])
        d_rec[:, : 2 * UNITS] = d[:, : 2 * UNITS]
        np.multiply(dn, q[t], out=d_rec[:, 2 * UNITS :])
        dh *= z[t]
        back = d_rec @ turned
        back += dh
        if any_fresh[t]:
            back[fresh[t]] = 0
    flat = d_in.reshape(-1, 3 * UNITS)
    g["bias"] += flat.sum(0)
    g["rec"][:, : 2 * UNITS] += begin.reshape(-1, UNITS).T @ flat[:, : 2 * UNITS]
    g["rec"][:, 2 * UNITS :] += begin.reshape(-1, UNITS).T @ (flat[:, 2 * UNITS :] * q.reshape(-1, UNITS))
    # words that are not in the window have no gradient
    used, g["in"] = _rows(x.ravel(), flat)
    return g, used, states[-1]


def _sigmoid_in(x: np.ndarray) -> None:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def learn(p: dict, squares: dict, docs: list[np.ndarray], passes: int = 1, rate: float = RATE, wide: int = LANES) -> int:
    """Truncated backpropagation over documents laid end to end in lanes; Adagrad. Returns the tokens seen: all, each pass."""
    stream = np.concatenate(docs).astype(np.int32) if docs else np.zeros(0, np.int32)
    lanes = max(1, min(wide, len(stream) // WINDOW))
    length = len(stream) // lanes
    if not length:
        return 0
    grid = np.ascontiguousarray(stream[: lanes * length].reshape(lanes, length).T)
    before = np.concatenate((np.zeros((1, lanes), grid.dtype), grid[:-1]))
    for _ in range(passes):
        h = np.zeros((lanes, UNITS), np.float32)
        for at in range(0, length, WINDOW):
            g, used, h = window(p, before[at : at + WINDOW], grid[at : at + WINDOW], h)
            for k in p:
                rows, d = used if k == "in" else slice(None), g[k]
                np.clip(d, -50, 50, out=d)
                squares[k][rows] += d * d
                p[k][rows] -= (rate * d / np.sqrt(squares[k][rows] + 1e-2)).astype(np.float32)
    # the last tokens, fewer than lanes, in fewer lanes
    rest = stream[lanes * length :]
    return lanes * length * passes + (learn(p, squares, [rest], passes, rate, wide) if len(rest) else 0)


def score_ids(p: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log of class and member probabilities, summed by document; the state runs through to the end."""
    total, every = np.zeros(len(docs)), np.arange(STEP)
    table, rec = p["in"] + p["bias"], p["rec"]
    hs, ys, who, held = [], [], [], 0
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
    for a in range(0, len(order), STEP):
        part = np.array(order[a : a + STEP])
        size = np.array([len(docs[k]) for k in part])
        h, prev = np.zeros((len(part), UNITS), np.float32), np.zeros(len(part), np.int32)
        for at in range(0, size[0], WINDOW):
            live = int(np.searchsorted(-size, -at))  # longer ones come first
            wide = np.zeros((min(WINDOW, size[0] - at), live), np.int32)
            for r in range(live):
                w = docs[part[r]][at : at + WINDOW]
                wide[: len(w), r] = w
            h, prev = h[:live], prev[:live]
            inputs = table[np.concatenate((prev[None], wide[:-1]))]
            for t, n in enumerate(np.searchsorted(-size[:live], -np.arange(at, at + len(wide))).tolist()):
                h = _next(rec, inputs[t, :n], h[:n])
                hs.append(h)
                ys.append(wide[t, :n])
                who.append(n)
                held += n
            prev = wide[-1]
            if held >= OUT or at + WINDOW >= size[0]:
                lp, _ = output(p, np.concatenate(hs), np.concatenate(ys))
                row = np.concatenate([every[:n] for n in who])
                total[part] += np.bincount(row, lp.astype(float), len(part))
                hs, ys, who, held = [], [], [], 0
    return total


def looked_up(docs: DataFrame, voc) -> DataFrame:
    """(id, n, known, base, tail_base, ids binary, tail, tail_n) of docs (id, text): what scoring needs of the text.

    ids: model ids as little-endian unsigned 16-bit numbers. base and tail_base: logarithms of the head
    tokens' smoothed counts, and those of them that are in rest classes, less the class's. tail: the other words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = voc.value
        # by head word, and last what a word outside has, whose number is -1
        log_m = np.log10(v.mass)
        log_c = np.append(np.log10(v.counts + SMOOTH), 0.0)
        ids = np.append(v.ids, 0)
        share = np.where(ids > CLASSES * MEMBERS, log_c - log_m[np.maximum(ids - 1 - CLASSES * MEMBERS, 0)], 0.0)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                yield of(b.slice(at, ROWS), v, log_m, log_c, ids, share)

    def of(part: pa.RecordBatch, v: Vocabulary, log_m: np.ndarray, log_c: np.ndarray, of_word: np.ndarray, share_of: np.ndarray) -> pa.RecordBatch:
        split = [tokens(t) for t in part.column(1).to_pylist()]
        size = np.array([len(ws) for ws in split], np.int64)
        flat = list(itertools.chain.from_iterable(split))
        at, row = v.look(flat), np.repeat(np.arange(len(split)), size)
        ids, share = of_word[at], share_of[at]
        tails = [Counter() for _ in split]
        outside = np.flatnonzero(at < 0)
        for k, r in zip(outside.tolist(), row[outside].tolist(), strict=True):
            w = flat[k]
            tails[r][w] += 1
            if w != END:
                ids[k] = 1 + CLASSES * MEMBERS + tail_class(w)
        rest = ids[outside]
        share[outside] = np.where(rest > 0, -log_m[np.maximum(rest - 1 - CLASSES * MEMBERS, 0)], 0.0)
        sums = lambda x: pa.array(np.bincount(row, x, len(split)))
        ends = np.cumsum(size)
        raw = ids.astype("<u2")
        cols = [
            part.column(0), pa.array(size), pa.array(size - np.bincount(row[outside], minlength=len(split))), sums(log_c[at]), sums(share),
            pa.array([raw[e - n : e].tobytes() for e, n in zip(ends, size, strict=True)], pa.binary()),
            pa.array([list(c) for c in tails], pa.list_(pa.binary())), pa.array([list(c.values()) for c in tails], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(cols, ["id", "n", "known", "base", "tail_base", "ids", "tail", "tail_n"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, known long, base double, tail_base double, ids binary, tail array<binary>, tail_n array<long>")


def train(training: DataFrame, counted: Vocabulary, most: int = STREAM) -> dict[str, np.ndarray]:
    """Weights from looked-up training documents (id, ids): a start in one task over a bounded sample, then the average of what every stream makes of it."""
    spark = training.sparkSession
    share = min(1.0, START_TOKENS / max(1, counted.n))
    keyed = training.select(F.xxhash64(F.col("id").cast("string"), "ids", F.lit(SEED)).alias("h"), "ids")  # copies of a text apart
    p = start(counted)
    squares = {k: np.zeros_like(v) for k, v in p.items()}
    names = list(p)

    def raw(w: dict) -> bytes:
        return np.concatenate([w[k].ravel().astype(np.float64) for k in names]).tobytes()

    def weights_of(data: bytes) -> dict[str, np.ndarray]:
        flat, at, out = np.frombuffer(data), 0, {}
        for k in names:
            out[k] = flat[at : at + p[k].size].reshape(p[k].shape).astype(np.float32)
            at += p[k].size
        return out

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_sq = {k: x.copy() for k, x in p.items()}, {k: x.copy() for k, x in squares.items()}
        docs = sorted((h, ids) for b in batches for h, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))  # the shuffle's order is none
        learn(own, own_sq, [np.frombuffer(ids, "<u2") for _, ids in docs], passes=3)
        yield pa.RecordBatch.from_arrays([pa.array([raw(own) + raw(own_sq)], pa.binary())], ["w"])

    below = F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40))
    for r in keyed.where(below).distinct().repartition(1).mapInArrow(begin, "w binary").collect():
        p, squares = weights_of(r["w"][: len(r["w"]) // 2]), weights_of(r["w"][len(r["w"]) // 2 :])
    shared = spark.sparkContext.broadcast((p, squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by stream: each is learnt from the same start."""
        first, sq = shared.value
        stream, seen, held, size, own, own_sq = None, 0, [], 0, {}, {}

        def end() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([stream], pa.int64()), pa.array([seen], pa.int64()), pa.array([raw(own)], pa.binary())], ["at", "n", "w"])

        for b in batches:
            for at, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at != stream or size > TRAINED:
                    seen += learn(own, own_sq, held, wide=WIDE)
                    held, size = [], 0
                if at != stream:
                    if seen:
                        yield end()
                    stream, seen = at, 0
                    own, own_sq = {k: x.copy() for k, x in first.items()}, {k: x.copy() for k, x in sq.items()}
                held.append(np.frombuffer(ids, "<u2"))
                size += len(held[-1])
        seen += learn(own, own_sq, held, wide=WIDE)
        if seen:
            yield end()

    def mean(t: pa.Table) -> pa.Table:
        n, total = 0, 0.0
        t = t.sort_by("at")
        for k, w in zip(t.column("n").to_pylist(), t.column("w").to_pylist(), strict=True):
            n, total = n + k, total + k * np.frombuffer(w)
        return pa.table({"at": pa.array([t.column("at")[0].as_py() // FAN], pa.int64()), "n": pa.array([n], pa.int64()), "w": pa.array([(total / n).tobytes()], pa.binary())})

    streams = max(1, -(-counted.n // most))
    dealt = keyed.withColumn("at", F.pmod("h", F.lit(streams)))
    by = min(streams, 8 * spark.sparkContext.defaultParallelism) if streams <= 1 << 16 else 1 << 16
    # a stream has its documents in the order of their hashes, wherever they come from
    part = dealt.repartition(by, "at").sortWithinPartitions("at", "h", "ids").select("at", "ids").mapInArrow(run, "at long, n long, w binary")
    while streams > 1:
        part = part.groupBy(F.floor(F.col("at") / FAN).alias("_g")).applyInArrow(mean, "at long, n long, w binary")
        streams = -(-streams // FAN)
    got = part.collect()  # one row
    shared.unpersist()
    return weights_of(got[0]["w"]) if got else p


def _scored(rows: DataFrame, weights) -> DataFrame:
    """rows (row, ids) with the logarithm of class and member probabilities: (row, model)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = weights.value
        at, seqs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(score_ids(p, seqs) / math.log(10), pa.float64())], ["row", "model"])

        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at.append(k)
                seqs.append(np.frombuffer(ids, "<u2"))
                size += len(seqs[-1])
                if size > HELD:
                    yield flush()
                    at, seqs, size = [], [], 0
        if at:
            yield flush()
        tidy()

    return rows.select("row", "ids").mapInArrow(run, "row long, model double")


def score(docs: DataFrame) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (id, text); scores are log10 of probabilities."""
    spark = docs.sparkSession
    small_batches(spark)
    counts, _ = stash(count(docs.where(split_of(F.col("id")) != 0)), "counts")
    voc, least = vocabulary(counts)
    shared = spark.sparkContext.broadcast(voc)
    rows, _ = stash(looked_up(docs, shared).withColumn("row", F.monotonically_increasing_id()), "looked-up")
    shared.destroy()
    weights = spark.sparkContext.broadcast(train(rows.where(split_of(F.col("id")) != 0), voc))
    model, _ = stash(_scored(rows, weights), "scored")
    weights.destroy()
    rest = rows.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("w"), F.col("t.tail_n").alias("k"))
    rest = rest.join(counts.where(F.col("c") < least), "w", "left")
    sums = rest.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    level = math.log10(voc.n + SMOOTH * (voc.v + 1))
    return rows.drop("tail", "tail_n", "ids").join(model, "row").join(sums, "row", "left").select(
        "id",
        (split_of(F.col("id")) == 0).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(int(voc.n)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n") * F.lit(level)).alias("base_score"),
        (F.col("model") + F.col("tail_base") + logs).alias("score"),
    )
