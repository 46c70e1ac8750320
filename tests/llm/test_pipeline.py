"""The pipeline stage by stage on a small corpus with planted cases."""

import random

import numpy as np
import pytest

import corpus_pipeline
from varve.llm import jaccard, packing
from varve.llm.queries import vocabulary_path


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(i, prose(rng, rng.randrange(15, 90)), "en", rng.choice(["s1", "s2", None]), 1) for i in range(120)]
    base = prose(rng, 80).split()
    for k in range(6):  # near copies: one word differs
        own = list(base)
        own[10 * k] = f"other{k}"
        out.append((200 + k, " ".join(own), "en", "s1", 1))
    out += [(300 + k, " ".join(base[:40]) + " extra", "en", "s2", 1) for k in range(3)]  # exact copies
    out += [(400, "too short", "en", "s1", 1), (401, None, None, None, None), (402, "again and again and " * 20, "en", "s1", 1), (403, prose(rng, 30) + " mail me at jane.doe@corp.com", "en", "s1", 1)]
    return out


def test_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    ids = [{r["doc_id"] for r in s} for s in seen]
    assert ids[0] == {r[0] for r in rows} - {400, 401, 402}
    assert ids[1] == ids[0] - {201, 202, 203, 204, 205, 301, 302}
    assert ids[2] == ids[1] and not any("jane" in r["text"] for r in seen[2])
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2])
    clean = {r["doc_id"]: r["text"] for r in seen[2]}
    assert all(clean[i] == t for i, t, *_ in rows[:120])
    assert ids[3] <= ids[2] and all(clean[r["doc_id"]] == r["text"] for r in seen[3])
    encode = packing.encoder(vocabulary_path(packing.VOCABULARY)).encode
    want = sum(len(encode([r["text"]])[0]) // 4 + 1 for r in seen[3])
    assert sum(r["length"] for r in seen[4]) == want
    assert all(len(np.frombuffer(r["ids"], "<u4")) == r["length"] for r in seen[4])


def test_near_copies_match_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets = {r[0]: set(jaccard.element_set(r[1], 5).tolist()) for r in rows}
    drop = {i for i in sets for j in sets if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    got = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == set(sets) - drop
