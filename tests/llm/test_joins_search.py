"""The n-gram join, components and exact search against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import components as parts
from emberline.llm import jaccard, search
from emberline.llm.common import written
from emberline.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(class, links) of each row by its place."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or (both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return Counter((rows[i][0], name[find(i)], links[i]) for i in range(len(rows)))


def make_rows(seed, groups=30, tight=0):
    g = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [g.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = [g.choice(vocabulary) for _ in range(g.randint(5, 200))]
        for _ in range(g.randint(1, 6)):
            copy = list(base)
            for _ in range(g.randint(0, max(1, len(base) // 40))):
                copy[g.randrange(len(copy))] = g.choice(vocabulary)
            if g.random() < 0.4:
                copy += passage
            rows.append(" ".join(copy))
    if tight:
        base = [g.choice(vocabulary) for _ in range(160)]
        for _ in range(tight):
            copy = list(base)
            copy[g.randrange(160)] = g.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["one two", "one two", "one two three", "", "", None, None, rows[0], rows[0]]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, rows[1]), (None, "alone without an id")]


@pytest.mark.parametrize("seed,tight", [(1, 0), (2, 330)])
def test_join_equals_brute_force(spark, seed, tight):
    rows = make_rows(seed, 40, tight)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, jaccard.similar_classes(df).select("doc_id", "class_id", "links").collect()))
    want = brute(rows)
    assert got == want


def near_copies(seed, n, words=60):
    """Texts of one base, each with one word of its own in place of another."""
    g = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    return [" ".join([*base[: (k := g.randrange(words))], f"own{i}", *base[k + 1 :]]) for i in range(n)]


def test_edges_grow_in_proportion_and_links_equal_brute_force(spark, monkeypatch):
    """A group of near copies spread over many blocks: edges by nodes, not by pairs of them."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 64)
    edges = {}
    for n in (400, 800):
        rows = [(i, t) for i, t in enumerate(near_copies(n, n))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        nodes = jaccard.written(jaccard.text_nodes(jaccard.written(jaccard.sketched(docs))))
        found = jaccard.written(jaccard.exact_links(docs, nodes, jaccard.candidate_groups(nodes)))
        edges[n] = found.where("b is not null").count()
        assert found.where("b is null").count() <= n
    assert edges[800] < 2.5 * edges[400] and edges[800] < 2 * 800
    assert Counter(map(tuple, jaccard.similar_classes(docs).collect())) == brute(rows)


def test_a_group_of_two_thousand(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(9, 2000, 70))]
    got = jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sets = [shingles(t) for _, t in rows]
    sizes = np.array([len(s) for s in sets])
    token = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(token)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [token[t] for t in s]] = 1
    both = (held @ held.T).astype(int)
    links = (5 * both >= 4 * (sizes[:, None] + sizes - both)).sum(axis=1) - 1
    assert {r["class_id"] for r in got} == {0} and {r["doc_id"]: r["links"] for r in got} == dict(enumerate(links.tolist()))


def test_recall_at_the_least_similarity(spark):
    """Pairs whose similarity is 0.8 to 0.83: at least 0.9 must be found, and nearly all are."""
    g, rows, pairs = random.Random(4), [], []
    while len(pairs) < 400:
        n = g.randint(60, 300)
        base = [f"p{len(pairs)}w{i}" for i in range(n)]
        other = list(base)
        for k in g.sample(range(n), max(1, round(n / 47))):
            other[k] = f"q{len(pairs)}x{k}"
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.83:
            pairs.append((len(rows), len(rows) + 1))
            rows += [" ".join(base), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in jaccard.similar_classes(df).collect()}
    assert sum(found[b] == a for a, b in pairs) / len(pairs) >= 0.995


def test_keep_one_of_each_class(spark):
    rows = make_rows(5, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("node"), F.lit("k").alias("key_a"), F.lit(2).alias("doc"))
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    classes = {c for (_, c, _), n in brute(rows).items()}
    nulls = [i for i, t in rows if t is None]
    assert set(ids) == classes | set(nulls) | {None} and max(ids.values()) == 1
    assert jaccard.keep_one(df.limit(0)).count() == 0 and jaccard.similar_classes(df.limit(0)).count() == 0


def test_sampled_tokens_agree_as_often_as_sets_are_similar():
    g = np.random.default_rng(3)
    for shared, own in ((80, 10), (20, 40), (5, 1)):
        rates = []
        for _ in range(60):
            a, b, c = (np.unique(g.integers(0, 2**63, n).astype(np.uint64)) for n in (shared, own, own))
            left, right = (np.frombuffer(jaccard.sampled_tokens(np.unique(np.concatenate([a, x]))), dtype="<u4") for x in (b, c))
            rates.append((left == right).mean())
        assert np.mean(rates) == pytest.approx(shared / (shared + 2 * own), abs=0.06)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}


def test_components_join_each_edge_once(spark, monkeypatch):
    """Spanning edges of one tight group met in many buckets: joined in the first round, none of them in a later one."""
    g = np.random.default_rng(4)
    rows = [(int(a), int(bucket.min())) for _ in range(30) for bucket in np.array_split(g.permutation(600), 3) for a in bucket]
    sizes = []

    def counted(df):
        out = written(df)
        if set(out.columns) == {"a", "b"}:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(parts, "written", counted)
    got = {r["node"]: r["root"] for r in parts.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(600), 0)
    assert sum(sizes) <= len({(a, b) for a, b in rows if a != b})


def test_components_equal_search_in_random_graphs(spark):
    g = np.random.default_rng(6)
    for n, m in ((60, 40), (60, 90), (40, 20)):
        edges = [(int(a), int(b)) for a, b in g.integers(0, n, (m, 2))] + [(1000 - i, 1000 + i) for i in range(9)] + [(1000 - i, 1001 + i) for i in range(9)]
        root = {x: x for e in edges for x in e if e[0] != e[1] or any(x in f for f in edges if f[0] != f[1])}
        for _ in root:
            for a, b in edges:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        got = components(spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long"))
        assert {r["node"]: r["root"] for r in got.collect()} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_search(rows, every, top):
    whole = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for at, (i, v) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for k, (j, w) in enumerate(whole) if k != at)
        out.update((i, rank, j, -s) for rank, (s, j) in enumerate(scored[:top], start=1))
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_search_equals_brute_force(spark, block):
    g = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in g.normal(0, 1, 6)]) for i in range(150)]
    rows += [(1000 + i, rows[20][1]) for i in range(30)]
    rows += [(20, rows[20][1]), (40, None), (41, [None, 1.0]), (42, [float("nan")] * 6), (60, [float("inf")] * 6), (80, [1.0, 2.0]), (2000, []), (2001, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = search.top_products(df, F.col("vec_id") % 20 == 0, top=5, block=block)
    assert Counter(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_search(rows, 20, 5)


def test_search_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    query = F.col("vec_id") % 100 == 0
    assert search.top_products(spark.createDataFrame([], schema), query).count() == 0
    assert search.top_products(spark.createDataFrame([(0, [1.0])], schema), query).count() == 0
    two = search.top_products(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], schema), query).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, -1048576)]
