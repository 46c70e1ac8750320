"""Language model, neighbours, Jaccard join, packing and HTML against brute force, round trips and held-out figures."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from varve.llm import html, jaccard, lm, neighbours, packing
from varve.llm.components import components
from varve.session import stash


# ---- language model ----


def small_corpus(n=300, seed=1):
    """Two word lists; a document uses one of them, so the state has something to learn."""
    rng = random.Random(seed)
    lists = [[f"{a}{i}" for i in range(30)] for a in "xy"]
    return [(i, " ".join(rng.choice(lists[i % 2]) for _ in range(rng.randrange(5, 80)))) for i in range(n)] + [(n, None), (None, "x1 unseen"), (n + 1, ""), (5, "X1 \x0b Y2"), (5, "X1 \x0b Y2")]


def test_base_scores_and_learning(spark):
    rows = small_corpus()
    got = lm.score(spark.createDataFrame(rows, "id long, text string")).collect()
    tok = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for ws, h in zip(tok, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, h, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _), ws, h in zip(rows, tok, held, strict=True))
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better than counts on held-out text


def test_the_model_is_a_distribution():
    words = [f"w{i}".encode() for i in range(2000)] + [lm.END]
    counts = np.arange(2001, 0, -1)
    mass = np.zeros(lm.TAILS)
    for w, k in zip(words[:-1], counts, strict=False):
        mass[lm.tail_class(w)] += k + lm.SMOOTH
    voc = lm.Vocabulary(words, counts, int(counts.sum()), len(words), mass)
    p = lm.start(voc)
    p["cls"] += 0.3
    inner = lm.output(p, np.repeat(np.full((1, lm.UNITS), 0.2, np.float32), 1 + lm.CLASSES * lm.MEMBERS + lm.TAILS, 0), np.arange(1 + lm.CLASSES * lm.MEMBERS + lm.TAILS))[0]
    assert np.exp(inner.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    words = [f"w{i}".encode() for i in range(1700)] + [lm.END]
    voc = lm.Vocabulary(words, np.full(1701, 5), 1701 * 5, 1701, np.full(lm.TAILS, 500.0))
    p = {k: v.astype(np.float64) for k, v in lm.start(voc).items()}
    h, y = rng.standard_normal((4, lm.UNITS)), np.array([0, 5, 40, 1 + lm.CLASSES * lm.MEMBERS + 2])
    g = {k: np.zeros_like(v) for k, v in p.items()}
    _, dh = lm.output(p, h, y, g)
    loss = lambda hh: -lm.output(p, hh, y)[0].sum()
    for at in ((0, 0), (1, 3), (2, 7), (3, 5)):
        step = np.zeros_like(h)
        step[at] = 1e-5
        assert (loss(h + step) - loss(h - step)) / 2e-5 == pytest.approx(dh[at], rel=1e-3, abs=1e-6)


def test_gradients_through_time():
    rng = np.random.default_rng(1)
    words = [f"w{i}".encode() for i in range(1700)] + [lm.END]
    voc = lm.Vocabulary(words, np.full(1701, 5), 1701 * 5, 1701, np.full(lm.TAILS, 500.0))
    p = {k: v.astype(np.float64) for k, v in lm.start(voc).items()}
    grid = np.array([[0, 3, 9, 3, 1550], [7, 0, 0, 1540, 8], [9, 9, 4, 0, 2], [5, 6, 7, 8, 9]])
    x, y, h = grid[:-1], grid[1:], rng.standard_normal((5, lm.UNITS))
    g, used, _ = lm.window(p, x, y, h)

    def loss():
        own, total = h, 0.0
        for t in range(len(x)):
            own = np.where((x[t] == 0)[:, None], 0, own)
            own = lm._step(p, x[t], own)[-1]
            total -= lm.output(p, own, y[t])[0].sum()
        return total

    assert used.tolist() == sorted(set(x.ravel().tolist()))
    for name, at, got in [("rec", (3, 5), None), ("rec", (0, 20), None), ("rec", (7, 40), None), ("bias", (2,), None), ("bias", (18,), None), ("bias", (33,), None), ("cls", (4, 2), None), ("mem", (0, 3, 2), None)] + [("in", (w, c), g["in"][used.tolist().index(w), c]) for w in (0, 9, 1540) for c in (1, 17, 34)]:
        keep, out = p[name][at], []
        for step in (1e-5, -1e-5):
            p[name][at] = keep + step
            out.append(loss())
        p[name][at] = keep
        assert (out[0] - out[1]) / 2e-5 == pytest.approx(g[name][at] if got is None else got, rel=1e-3, abs=1e-6), (name, at)


def looked_up(spark, df):
    voc, _ = lm.vocabulary(lm.count(df))
    return voc, lm.looked_up(df, spark.sparkContext.broadcast(voc))


def test_every_training_document_trains_weights(spark, monkeypatch):
    monkeypatch.setattr(lm, "START_TOKENS", 0)  # the start learns from nothing
    rows = [(i, t) for i, t in small_corpus(400) if t and i]
    voc, df = looked_up(spark, spark.createDataFrame(rows, "id long, text string"))
    got = lm.train(df, voc)
    # the weights are those of every token in one stream, in the order of the hashes
    p = lm.start(voc)
    docs = [np.frombuffer(r["ids"], "<u2") for r in df.select("ids", lm.F.xxhash64(lm.F.col("id").cast("string"), "ids", lm.F.lit(lm.SEED)).alias("h")).orderBy("h", "ids").collect()]
    seen = lm.learn(p, {k: np.zeros_like(v) for k, v in p.items()}, docs, wide=lm.WIDE)
    assert seen == sum(map(len, docs)) == voc.n and np.abs(got["cls"] - lm.start(voc)["cls"]).max() > 1e-3
    assert all(np.allclose(got[k], p[k], atol=1e-4) for k in p)


def test_layout_has_no_effect(spark, monkeypatch):
    monkeypatch.setattr(lm, "STREAM", 2000)
    monkeypatch.setattr(lm.train, "__defaults__", (2000,))
    rows = [(*r, 7, "x") for r in small_corpus()] + [(9000, "z" * 200_000 + " y1" * 3000, 7, "x")]
    df = spark.createDataFrame(rows, "id long, text string, n long, ids string")
    one, many = (sorted((str(r["id"]), r["n_tokens"], r["score"], r["base_score"]) for r in lm.score(d).collect()) for d in (df.coalesce(1), df.repartition(8)))
    assert [x[:2] for x in one] == [x[:2] for x in many]
    assert all(a[2:] == pytest.approx(b[2:], abs=1e-9) for a, b in zip(one, many, strict=True))


def test_scores_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert lm.score(df).count() == 0


def test_scoring_asks_for_probabilities_of_many_windows_at_once(monkeypatch):
    rng, inner = np.random.default_rng(8), lm.CLASSES * lm.MEMBERS
    voc = lm.Vocabulary([lm.END] + [b"w%d" % k for k in range(inner)], np.arange(inner + 1, 0, -1), 10**6, inner + 1, np.full(lm.TAILS, 1e6))
    p = lm.start(voc)
    docs = [rng.integers(0, 1 + inner + lm.TAILS, n).astype("<u2") for n in (3200, 1, 33, 700)]
    calls, output = [], lm.output
    monkeypatch.setattr(lm, "output", lambda *a: calls.append(1) or output(*a))
    got = lm.score_ids(p, docs)
    assert len(calls) <= 2
    for d, score in zip(docs, got, strict=True):
        h, prev, want = np.zeros((1, lm.UNITS), np.float32), np.zeros(1, int), 0.0
        for y in d.astype(int):
            h = lm._step(p, prev, h)[-1]
            prev = np.array([y])
            want += float(output(p, h, prev)[0][0])
        assert score == pytest.approx(want, rel=1e-4)


# ---- neighbours ----


def found(spark, rows, **more):
    use, _ = stash(neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    got = defaultdict(list)
    for r in neighbours.search(use, use.where("id % 20 = 0"), **more).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall(got, x, n):
    s = x @ x.T
    hits = total = 0
    for q in range(0, n, 20):
        want = sorted((j for j in range(n) if j != q), key=lambda j: (-round(s[q, j], 9), j))[:20]
        assert len(got[q]) == len(want) and q not in dict(got[q])
        assert [v for v, _ in got[q]] == [v for v, _ in sorted(got[q], key=lambda t: (-round(t[1], 9), t[0]))]
        assert all(sc == pytest.approx(s[q, v]) for v, sc in got[q])
        hits += len(set(want) & {v for v, _ in got[q]})
        total += len(want)
    return hits / total


@pytest.mark.parametrize("n", [12, 3000])
def test_recall(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 24)) * rng.uniform(0.5, 2, (n, 1))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are copies
    got = found(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)])
    assert recall(got, x, n) >= 0.9


def test_few_lists_of_clustered_vectors_are_probed(spark):
    n, rng = 4000, np.random.default_rng(3)
    x = rng.standard_normal((80, 32))[rng.integers(0, 80, n)] * 3 + rng.standard_normal((n, 32)) * 0.3
    index = neighbours.Index(x, n, 20)
    assert index.probes <= len(index.centroids) / 4 and len(index.centroids) == 63 and len(set(index.region)) > 1
    got = found(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)])
    assert recall(got, x, n) >= 0.9


def test_queries_in_many_blocks(spark, monkeypatch):
    """As over 160 000 vectors, which have more queries than a block; a group of copies is larger than n."""
    n, rng = 2000, np.random.default_rng(4)
    x = rng.standard_normal((n, 24))
    x[300:700] = x[40]
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    monkeypatch.setattr(neighbours, "CHUNK", 500, raising=False)
    got = found(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)])
    assert len(got) == n / 20 and recall(got, x, n) >= 0.9


def test_what_queries_write_does_not_grow_with_the_lists_they_probe(spark):
    n, rng = 4000, np.random.default_rng(5)
    x = rng.standard_normal((n, 16))
    index = neighbours.Index(x, n, 20)
    use, _ = stash(neighbours.usable(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:100])], "vec_id long, embedding array<double>")))
    assert index.probes > 1 and neighbours.probed(use, spark.sparkContext.broadcast(index), np.full(len(index.centroids), 60), 20).count() == 100


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (1, [0.0, 0.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [2.0, 1.0]), (5, [2.0, 1.0]), (6, [3.0])]
    assert dict(found(spark, rows)) == {0: [(5, 4.0), (5, 4.0), (6, 3.0)]}
    assert dict(found(spark, [])) == {}


def test_rows_of_one_id_are_candidates_each(spark):
    assert dict(found(spark, [(20, [1.0, 0.0]), (20, [2.0, 0.0]), (7, [0.5, 0.0])])) == {20: [(20, 2.0), (20, 2.0), (7, 0.5), (7, 1.0)]}


# ---- Jaccard join ----


def closure(sets, ids, percent):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, n):
    ws = (text or "").split()
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_components_of_near_copies(spark, n, percent):
    rng = random.Random(percent)
    rows: list = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one two"), (905, "one two three")]
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 9)):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
            words = own if rng.random() < 0.4 else words  # chains
    passage = " ".join(f"p{i}" for i in range(90))
    rows += [(1000 + i, passage + " " + " ".join(f"q{i}_{k}" for k in range(10 + i % 9))) for i in range(40)]  # about the limit
    ids = [i for i, _ in rows]
    want = closure({i: shingles(t, n) for i, t in rows}, ids, percent)
    docs = spark.createDataFrame([(*r, 1, "x") for r in [*rows, (0 + rows[10][0], rows[10][1]), (None, "one two")]], "id long, text string, row long, doc string")
    got = jaccard.groups(docs, n, percent, cells=1 << 14).collect()
    assert {r["id"]: r["component_id"] for r in got if r["id"] is not None} == want and len(got) == len(ids) + 2
    assert {r["id"]: r["n_shingles"] for r in got if r["id"] is not None} == {i: len(shingles(t, n)) for i, t in rows}
    assert [r["component_id"] for r in got if r["id"] is None] == [903]
    assert sum(r["stays"] for r in got) == len(set(want.values()))


def test_pairs_of_a_large_group_are_few(spark, monkeypatch):
    rng, n = random.Random(6), 400
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(n):  # two with more than three changes between them are not linked directly
        own = list(words)
        for k in rng.sample(range(5, 195), rng.choices((0, 1, 2, 3), (1, 3, 4, 2))[0]):
            own[k] = f"n{i}_{k}"
        rows.append((i, " ".join(own)))
    tested, verified = [], jaccard.verified

    def counted(pairs, *more):
        tested.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = {r["id"]: r["component_id"] for r in jaccard.groups(spark.createDataFrame(rows, "id long, text string"), cells=1 << 14).collect()}
    assert got == closure({i: shingles(t, 4) for i, t in rows}, range(n), 85)
    assert tested[-1] < 5 * n and sum(tested) < 40 * n


def test_rows_of_one_id_keep_their_links(spark):
    long = " ".join(f"w{i}" for i in range(3000)) + " " + "x" * 100_000
    a, b = "a b c d e f", "u v w x y z"
    rows = [(1, a), (2, a), (2, b), (3, b), (None, "null one two three"), (None, "null one two three"), (None, long), (9, long), (9, long), (7, ""), (7, None)]
    got = jaccard.groups(spark.createDataFrame(rows, "id long, text string"), cells=1 << 14).collect()
    assert sorted((str(r["id"]), str(r["component_id"])) for r in got) == sorted([("1", "1"), ("2", "1"), ("2", "2"), ("3", "2"), ("None", "None"), ("None", "None"), ("None", "9"), ("9", "9"), ("9", "9"), ("7", "7"), ("7", "7")])
    assert sum(r["stays"] for r in got) == 6


def test_join_of_nothing(spark):
    assert jaccard.groups(spark.createDataFrame([], "id long, text string"), cells=1 << 14).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_a_long_chain(spark, few):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 70), (70, 90), (5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), few).collect()}
    assert got == {**{i: 0 for i in range(61)}, 70: 70, 90: 70, 100: 70}


# ---- packing ----


def test_pieces():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000, 6144):
        cut = packing.pieces(n)
        assert [s for s, _ in cut] == [sum(x for _, x in cut[:k]) for k in range(len(cut))]
        assert sum(x for _, x in cut) == n and all(x & (x - 1) == 0 and x <= 2048 for _, x in cut)


def test_words_in_either_case_are_one_entry():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    e, t = packing.Encoder(path), Tokenizer.from_file(path)
    e.encode(["Word word WORD wOrd", "Word, WORD,"])
    assert len(e.words) == 2
    texts = ["W\u030a w\u030a A\u030a I\u0307 K\u0328x", "\u212aELVIN ΟΔΟΣ ABC漢字DEF İI", "<|ENDOFTEXT|> <|endoftext|> A<|B", "DON'T Rock'S x' y7 Z- \x7fA a\x7f", "q" * 400 + "1"]
    for x, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_packing_round_trip(spark):
    path = public_tokenizers.path(packing.VOCABULARY)
    texts = ["", None, "Hello  World's", "don't I'LL 'S x's ## $$", "é ü ß İ ΣΑΣ ﬁ ½ ² 漢字 á x\xa0y z", "a\x00b \x00", "<|endoftext|> <|x", "A" * 5000, "word " * 3000, "123 4.5,6"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, "", "k"), (None, "x", "k")], "doc_id long, text string, ids string")
    rows = packing.pack(docs, path).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        if i == 0:
            continue
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        ids = [x for r in own for x in np.frombuffer(r["ids"], "<u4").tolist()]
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 1], text
        assert all(r["doc_tokens"] == len(ids) and r["length"] == len(r["ids"]) // 4 for r in own)
    assert sum(r["doc_id"] == 0 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) >= 1
    with pytest.raises(ValueError):
        packing.pack(docs, path, longest=1000)
    assert packing.pack(docs.limit(0), path).count() == 0


def test_the_word_table_may_run_over():
    path = public_tokenizers.path(packing.VOCABULARY)
    small, large = packing.Encoder(path, 600, 600), packing.Encoder(path)
    texts = [f"alpha beta{i} gamma{i % 3} é{i}" for i in range(20)]
    assert [small.encode([t])[0] for t in texts] == large.encode(texts)
    assert small.words.old and len(small.words) < 10
    small.forget()
    assert not small.words and not small.words.old and not small.words.size
    assert small.encode(texts) == large.encode(texts)


def test_words_cut_here_have_the_tokenizers_ids():
    e = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    rng = np.random.default_rng(7)
    signs = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)]] + ["'s", "'LL", "'d", "<|", "e", "t", "in", "on"]
    words = ["".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(1, 9))) for _ in range(4000)]
    words += [chr(c) for c in range(0xC0, 0x100)]
    for word, ids in zip(words, e.encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.t.encode(word, add_special_tokens=False).ids, word


def test_idle_tables_are_released():
    from varve.llm.workers import Idle

    gone = []
    idle = Idle(lambda: gone.append(1), 0.05)
    with idle:
        with idle:
            pass
        time.sleep(0.15)
        assert not gone
    time.sleep(0.3)
    assert gone == [1]


def test_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here"), (2, "more")], "doc_id long, text string")
    packing.write_buckets(packing.pack(docs, public_tokenizers.path(packing.VOCABULARY)), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("bucket != length").count() == 0 and back.count() > 1


# ---- HTML ----


@pytest.fixture(scope="module")
def model():
    return html.train()


def test_held_out_pages(model):
    pages = html.labelled_pages(150, seed=123)
    assert sum(html.main_text(p, model) == t for p, t in pages) / len(pages) >= 0.9


def test_marginals_are_exact(model):
    nodes, pieces = html.parse("<html><body><nav><a>x</a></nav><article><p>some text</p></article></body></html>")
    html.measure(nodes, pieces)
    belief = model.marginals(nodes)[0]
    z, one = 0.0, [0.0] * len(nodes)
    for code in range(1 << len(nodes)):
        y = [code >> i & 1 for i in range(len(nodes))]
        p = math.exp(sum(model.own(n) * y[i] for i, n in enumerate(nodes)) + sum(model.pair[y[n.parent]][y[i]] for i, n in enumerate(nodes) if i))
        z += p
        one = [o + p * y[i] for i, o in enumerate(one)]
    assert [1 / (1 + math.exp(-b)) for b in belief] == pytest.approx([o / z for o in one])


def test_parts_of_a_page(model):
    page = """<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a><li><a>More</a></ul></nav><div class="ad">Buy now</div>
    <article><h1>The &amp; title</h1><p>First  paragraph with enough words to be one,<br>and a <b>bold</b> end&#33; <p>Second &lt;b&gt; one is here as well, with words.</p></article>
    <script>var a = "<p>no</p>";</script><footer>&copy; someone</footer></body></html>"""
    assert html.main_text(page, model) == "The & title\nFirst paragraph with enough words to be one, and a bold end!\nSecond <b> one is here as well, with words."
    cut = page[: page.index(" one is here") + 8]
    assert html.main_text(cut, model).endswith("Second <b> one is")
    deep = "<html><body><article><p>" + "<div>" * 3000 + "deep words in the page" + "</div>" * 3000
    for odd in ("", "<", "<p", "text only", "</p></div>", "<!-- open", "<script>x", "&am", "a < b", deep):
        assert isinstance(html.main_text(odd, model), str)
    assert html.main_text(None, model) == ""


def test_stray_quotes_and_pages_without_marks(model):
    assert html.main_text("<p class=x'>Hello there my friends", model) == "Hello there my friends"
    assert html.main_text('<img alt="5" tall">after the image there is a text', model) == "after the image there is a text"
    assert html.main_text("<p title='a > b'>not <b c=\"x'>\">bold</b> at all</p>", model) == "not bold at all"
    assert html.main_text("plain text  only\nhere", model) == "plain text only here"
    assert html.main_text("<div><div>A short article in plain divs.</div><div>And a second one too.</div></div>", model) == "A short article in plain divs.\nAnd a second one too."


@pytest.mark.parametrize("part", ['<a <a ... "', "='a", "<b>", "<div>", "<li>", "<!--", "</", "<a b = ", "<p><button><div>", "<i></b>", "&#", "<script>"])
def test_hostile_pages_take_linear_time(model, part):
    took = []
    for size in (60_000, 240_000):
        page = "<article><p>" + part * (size // len(part))
        began = time.process_time()
        html.main_text(page, model)
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0] + 0.3  # four times the page


def test_very_long_pages_and_repeated_rows(spark, model):
    words = " ".join(f"word{i}" for i in range(60_000))
    pages = spark.createDataFrame([(1, "u", f"<article><p>{words}</p></article>")] * 2, "page_id long, url string, html string")
    assert [r["n_chars"] for r in html.extract(pages, model).collect()] == [len(words)] * 2


def test_extract(spark, model):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<article><p>some words that are long enough to be text</p></article>", "x"), (None, None, "", "x")], "page_id long, url string, html string, text string")
    got = html.extract(pages, model).orderBy("n_chars").collect()
    assert [(r["page_id"], r["n_chars"], len(r["text"])) for r in got][-1][1] > 10 and got[0]["text"] == ""
    assert html.extract(pages.limit(0), model).count() == 0
