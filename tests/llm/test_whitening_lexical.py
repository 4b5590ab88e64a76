"""Whitening and ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from emberline.llm import lexical, whitening


def brute_whitening(rows, weights="one", components=16):
    whole = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in whole)
    x = [(i, tuple([math.floor(64 * c) + 1000000 for c in v] + [1000000] * (width - len(v)))) for i, v in whole]
    times = Counter(v for _, v in x)
    distinct = sorted(times)
    w = np.array([1 if weights == "one" else times[v] for v in distinct])
    n = int(w.sum())
    sums = [sum(int(a) * v[j] for a, v in zip(w, distinct, strict=True)) for j in range(width)]
    centred = np.array([[v[j] - sums[j] / n for j in range(width)] for v in distinct])
    cov = (centred * w[:, None]).T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = {v: sum((n * v[j] - sums[j]) ** 2 for j in range(width)) for v in distinct}
    white = dict(zip(distinct, centred @ vectors / np.sqrt(values), strict=True))
    return n, [(i, deviation[v], white[v]) for i, v in x], values / np.trace(cov)


def vectors(seed=3):
    g = np.random.default_rng(seed)
    mix = g.normal(0, 1, (6, 6))
    rows = [(i, [float(c) for c in g.normal(0, 1, 6) @ mix]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[1][1]), (600, [0.5, 1.0]), (601, []), (602, None), (603, [None] * 6), (604, [float("nan")] + [0.0] * 5), (605, [float("inf")] * 6)]
    return rows


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_brute_force(spark, weights):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in rows], "vec_id long, embedding array<double>, x int, whitened string").repartition(3)
    n, want, explained = brute_whitening(rows, weights, 4)
    got = whitening.whiten(df, components=4, weights=weights).collect()
    assert Counter((r["row"]["vec_id"], r["n"], r["deviation"]) for r in got) == Counter((i, n, d) for i, d, _ in want)
    assert {r["row"]["whitened"] for r in got} == {"a"}
    assert got[0]["explained"] == pytest.approx(explained, rel=1e-9) and got[0]["identity_error"] < 1e-9
    signs = np.sign(np.array(sorted(got, key=lambda r: (r["row"]["vec_id"] is None, r["row"]["vec_id"]))[0]["whitened"]) * next(w for i, _, w in want if i == 0))
    one = {(i, d): signs * w for i, d, w in want}
    for r in got:
        assert r["whitened"] == pytest.approx(one[r["row"]["vec_id"], r["deviation"]], abs=1e-8)


def test_whitening_of_constant_directions_and_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], schema)
    row = whitening.whiten(flat).first()
    assert len(row["whitened"]) == 1 and row["explained"] == pytest.approx([1.0])
    assert all(r["whitened"] == [] for r in whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema)).collect())
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []


def test_deviation_beyond_a_long_fails(spark):
    df = spark.createDataFrame([(i, [1e10 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        whitening.whiten(df).collect()


def brute_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_ranked(docs, queries, top):
    bags = [(i, brute_terms(t)) for i, t in docs]
    bags = [(i, Counter(t), len(t)) for i, t in bags if t]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in queries:
        terms = set(brute_terms(text))
        scored = []
        for i, bag, n in bags:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in terms if t in bag)
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:top], start=1)]
    return Counter(out)


def corpus(seed, n=300):
    g = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "été", "x_y", "don't", "中文", "A1b"]
    odds = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(g.choices(words, odds, k=g.randint(1, 60)))) for i in range(n)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (900, ""), (901, None), (902, "--- ..."), (903, "w3 " * 30000 + "w50"), *((1000 + i, docs[9][1]) for i in range(40))]
    queries = [(i, " ".join(g.choices(words, k=g.randint(1, 14)))) for i in range(25)] + [(25, None), (26, "?!"), (27, "unseen"), (3, "w1 W1 w2"), (None, "w40 w41"), (28, "w0")]
    return docs, queries


@pytest.mark.parametrize("bits,terms", [(13, 200_000), (4, 200_000), (5, 60)])
def test_ranking_equals_brute_force(spark, monkeypatch, bits, terms):
    monkeypatch.setattr(lexical, "BLOCK_BITS", bits)
    docs, queries = corpus(bits)
    left = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, row int, n int").repartition(3)
    right = spark.createDataFrame([(i, t, "q") for i, t in queries], "item_id long, text string, item string")
    got = lexical.ranked(left, right, top=10, terms=terms).select("query.item_id", "rank", "doc_id", "score")
    assert Counter(map(tuple, got.collect())) == brute_ranked(docs, queries, 10)


def test_bounds_skip_documents_but_lose_none():
    g = np.random.default_rng(1)
    for _ in range(60):
        impacts = {t: {int(d): int(s) for d, s in zip(g.choice(200, k, replace=False), g.integers(1, 1000, k), strict=True)} for t, k in enumerate(g.integers(1, 120, 7))}
        total = Counter()
        for one in impacts.values():
            total.update(one)
        groups = [(0, 1), (2, 3), (4, 5), (6, -1)]
        lists = {(t, -1): (max(one.values()), np.array(sorted(one), dtype=np.int32), np.array([one[d] for d in sorted(one)])) for t, one in impacts.items()}
        for a, b in groups[:3]:
            both = sorted(impacts[a].keys() & impacts[b].keys())
            if both:
                lists[a, b] = (max(impacts[a][d] + impacts[b][d] for d in both), np.array(both, dtype=np.int32), np.zeros(0, dtype=np.int64))
        want = sorted(((-s, d) for d, s in total.items()))[:8]
        for least in (1, -want[-1][0], -want[2][0]):
            docs, scores = lexical.best_of_block(lists, groups, least, 8)
            assert list(zip((-scores).tolist(), docs.tolist(), strict=True)) == [w for w in want if -w[0] >= least]


def test_ranking_of_nothing(spark):
    docs, queries = corpus(1)
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    assert lexical.ranked(left.limit(0), right).collect() == []
    assert lexical.ranked(left, right.limit(0)).collect() == []
    assert lexical.ranked(left.where("text is null"), right).collect() == []


def test_small_batches_leave_the_session_as_it_was(spark):
    from pyspark.sql import types as T

    from emberline.llm import common

    before = spark.conf.get(common.BATCH_LIMIT)
    docs = spark.createDataFrame([("a",)] * 3, "text string")
    assert common.per_batch(docs, ["text"], [T.StructField("n", T.LongType())], lambda: lambda t: [[len(t)] * len(t)]).count() == 3
    assert spark.conf.get(common.BATCH_LIMIT) == before
