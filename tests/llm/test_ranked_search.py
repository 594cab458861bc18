"""Ranked search against a plain scoring of every document, with small segments and blocks so that skipping happens."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

from clinspan.llm import ranked_search as search

WORDS = [f"w{i}" for i in range(400)]
FOLD = str.maketrans(search.UPPER, search.LOWER)


def terms(text):
    return re.findall(search.TERM_IN_TEXT, (text or "").translate(FOLD))


def plain(docs, items, k=10):
    found = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    df = {t: sum(t in set(d) for _, d in found) for s in wanted.values() for t in s}
    out = []
    for item, own in wanted.items():
        scored = []
        for doc_id, d in found:
            m = 10 + 90 * len(d) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * d.count(t) // (1000 * d.count(t) + 8 * m)) for t in own if t in d)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    pick = lambda k: " ".join(WORDS[min(int(rng.expovariate(0.02)), 399)] for _ in range(k))
    docs = [(i, pick(rng.choice([0, 1, 5, 30, 200]))) for i in range(n)]
    docs += [(n, docs[3][1]), (5, "W1 w2-w3 W1"), (5, "w1 W2 w3 w1"), (None, "w1 w2 w3"), (n + 1, None), (n + 2, ""), (n + 3, "Été café W7"), (n + 4, "w9 " * 30_000), (-4, "w1 w2 w3 w1")]
    rng.shuffle(docs)
    items = [(i, pick(rng.choice([1, 3, 20, 60]))) for i in range(40)] + [(40, None), (41, "none such"), (42, "ÉTÉ café"), (None, "w1 w5"), (43, "w3"), (43, "w4 w3")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_scores(spark, seed):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, item_id string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    want = plain(docs, items)
    assert sorted(map(tuple, search.ranked_documents(d, q).collect()), key=repr) == want
    assert sorted(map(tuple, search.ranked_documents(d, q, block_pairs=300).collect()), key=repr) == want  # several passes
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.sql("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(con.sql(search.SQL).fetchall(), key=repr) == want


@pytest.mark.parametrize("share,block", [(0.0, 16), (1 / 64, 16), (1 / 8, 64), (1.0, 16), (1 / 64, 100_000)])
def test_skipping_is_exact(share, block):
    """All lists long, all short, and mixtures, over many blocks: always the best of all sums."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, t = int(rng.integers(1, 300)), int(rng.integers(1, 25))
        sizes = rng.integers(0, t + 1, n)
        of = np.concatenate([rng.choice(t, s, replace=False) for s in sizes]) if sizes.sum() else np.zeros(0, dtype="int64")
        tfs = rng.integers(1, 6, len(of))
        weights = rng.integers(0, 5, t) * 100
        ids = rng.permutation(n)
        segment = search.Segment(ids, sizes * 3, sizes, of, tfs, weights, n, max(1, int(sizes.sum())))
        best = search.Best(10)
        wanted = np.sort(rng.choice(t, int(rng.integers(1, t + 1)), replace=False))
        search.search(segment, wanted, best, share, block)
        sums = np.zeros(n, dtype="int64")
        for term, docs, adds in ((t, segment.docs[a:b], segment.adds[a:b]) for t, a, b in zip(segment.terms, segment.first, segment.last)):
            if term in wanted:
                sums[docs] += adds
        want = sorted(((-s, i) for s, i in zip(sums.tolist(), ids.tolist()) if s > 0))[:10]
        assert sorted((-s, -i) for s, i in best.heap) == want


def test_small_segments(spark, monkeypatch):
    docs, items = corpus(4, 150)
    monkeypatch.setattr(search, "SEGMENT_DOCS", 7)
    got = search.ranked_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items)


def test_empty(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked_documents(d, q).collect() == []
    assert search.ranked_documents(q.withColumnRenamed("item_id", "doc_id"), q.limit(0)).collect() == []
