"""Boosted trees: splits and Shapley values against enumeration, missing values, categories, going on."""

import itertools
import math
import os
import tempfile
import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from emberline.operators import boosting as bo

SCHEMA = "id long, a double, b double, kind string, split string, y int"


def make_rows(n=6000, seed=3):
    g = np.random.default_rng(seed)
    a, b = g.normal(0, 1, n), g.normal(0, 1, n)
    kind = g.choice(["red", "green", "blue", None], n, p=[0.5, 0.3, 0.1, 0.1])
    gone = g.random(n) < 0.2
    logit = -1 + 1.5 * (a > 0.3) * (b > 0) + 1.5 * gone + np.array([1.0 if k == "green" else 0.0 for k in kind])
    y = (g.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    split = np.where(np.arange(n) < 0.6 * n, "train", np.where(np.arange(n) < 0.8 * n, "calib", "test"))
    return [(i, None if gone[i] else float(a[i]), float(b[i]), kind[i], str(split[i]), int(y[i])) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def model(data):
    return bo.boost(data, ["a", "b"], ["kind"], "y", rounds=40, depth=3, patience=8)


def auc(scores, labels):
    order = pd.Series(scores).rank().to_numpy()
    ones = labels.sum()
    return (order[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def test_fit_finds_missing_values_levels_and_interactions(data, model):
    assert 5 < len(model.trees) <= 40 and len(model.history) == len(model.trees) + 1
    losses = [h[0] for h in model.history]
    assert losses[-1] == min(losses) < losses[0] - 0.05
    test = bo.scored(data.where("split = 'test'"), model, "p").toPandas()
    assert auc(test["p"], test["y"].to_numpy()) > 0.68
    gone, there = test[test["a"].isna()]["p"].mean(), test[test["a"].notna()]["p"].mean()
    assert gone > there + 0.2
    assert set(model.levels["kind"]) == {"red", "green", "blue"} and any(any(t.level) for t in model.trees)


def test_first_split_is_the_best_of_all(spark):
    rows = make_rows(900, 5)
    df = spark.createDataFrame([(*r[:4], "train", r[5]) for r in rows], SCHEMA)
    model = bo.boost(df, ["a", "b"], ["kind"], "y", rounds=1, depth=1, weighted=False)
    ones = sum(r[5] for r in rows)
    p = ones / len(rows)
    frame = pd.DataFrame(rows, columns=["id", "a", "b", "kind", "split", "y"])
    codes = model.codes(frame)
    tree = model.trees[0]

    # The rows of the round are drawn; a split of all rows has nearly the drawn one's gain.
    def gain(left):
        g = np.array([p - r[5] for r in rows])
        h = p * (1 - p)
        part = lambda m: g[m].sum() ** 2 / (h * m.sum() + bo.RIDGE)
        return part(left) + part(~left)

    tried = []
    for feature, size in enumerate(model.sizes()):
        own = codes[:, feature]
        for code, missing in itertools.product(range(1, size), (False, True)):
            left = (own == code if feature == 2 else own <= code) & (own > 0) | (missing & (own == 0))
            if min(left.sum(), (~left).sum()) >= bo.LEAST_ROWS:
                tried.append(gain(left))
    chosen = bo.goes_left(tree, np.zeros(len(rows), dtype=int), codes)
    assert gain(chosen) >= 0.85 * max(tried)


def test_split_of_one_node_equals_enumeration():
    g = np.random.default_rng(8)
    for _ in range(40):
        sizes = np.array([5, 4, 6])
        hist = np.zeros((15, 3))
        rows = [tuple(g.integers(0, s) for s in sizes) for _ in range(300)]
        grads, hess = g.normal(0, 1, 300), g.random(300)
        for row, a, b in zip(rows, grads, hess, strict=True):
            for at, code in zip((0, 5, 9), row, strict=True):
                hist[at + code] += (a, b, 1)
        found = bo.best_split(hist, sizes, 2)
        best = 0.0
        for feature, size in enumerate(sizes):
            own = np.array([r[feature] for r in rows])
            for code, missing in itertools.product(range(1, size), (False, True)):
                left = (own == code if feature == 2 else (own <= code) & (own > 0)) | (missing & (own == 0))
                if min(left.sum(), (~left).sum()) >= bo.LEAST_ROWS:
                    part = lambda m: grads[m].sum() ** 2 / (hess[m].sum() + bo.RIDGE)
                    best = max(best, part(left) + part(~left) - part(left | True))
        assert found[0] == pytest.approx(best)


def test_a_fit_in_two_parts_equals_one(spark, data):
    whole = bo.boost(data.where("split <> 'calib'"), ["a", "b"], ["kind"], "y", rounds=6, depth=2)
    half = bo.boost(data.where("split <> 'calib'"), ["a", "b"], ["kind"], "y", rounds=3, depth=2)
    path = tempfile.mkdtemp(prefix="emberline-model-")
    bo.save(spark, half, path)
    stored = bo.load(spark, path)
    assert stored == half and len(half.trees) == 3 and half.history == ()
    on = bo.boost(data.where("split <> 'calib'"), ["a", "b"], ["kind"], "y", rounds=3, depth=2, start=stored)
    assert len(on.trees) == 6
    for one, two in zip(whole.trees, on.trees, strict=True):
        assert one.feature == two.feature and one.code == two.code and one.value == pytest.approx(two.value)


def test_refreshed_margins_change_nothing(data, monkeypatch):
    train = data.where("split <> 'calib'")
    one = bo.boost(train, ["a", "b"], [], "y", rounds=5, depth=2)
    monkeypatch.setattr(bo, "REFRESH", 2)
    two = bo.boost(train, ["a", "b"], [], "y", rounds=5, depth=2)
    assert [t.feature for t in one.trees] == [t.feature for t in two.trees]
    assert np.concatenate([t.value for t in one.trees]) == pytest.approx(np.concatenate([t.value for t in two.trees]))


def test_tasks_that_run_together_grow_the_trees_of_one(data, model, monkeypatch):
    """Few rows a task, few rounds a job: the same trees, in a job for each `REFRESH` rounds."""
    jobs = []
    more = bo.more_rounds
    monkeypatch.setattr(bo, "more_rounds", lambda *a: jobs.append(a[0].rdd.getNumPartitions()) or more(*a))
    monkeypatch.setattr(bo, "TASK_ROWS", 2000)
    monkeypatch.setattr(bo, "REFRESH", 2)
    got = bo.boost(data, ["a", "b"], ["kind"], "y", rounds=3, depth=3, patience=8)
    assert jobs == [3, 3] and len(got.trees) == 3
    for one, two in zip(model.trees, got.trees, strict=False):
        assert (one.feature, one.code) == (two.feature, two.code) and one.value == pytest.approx(two.value)
    assert np.array(model.history[:4]) == pytest.approx(np.array(got.history))


def test_shapley_values_equal_full_enumeration(spark, data, model):
    frame = pd.DataFrame(make_rows(60, 9), columns=["id", "a", "b", "kind", "split", "y"])
    codes, against = model.codes(frame.iloc[:12]), model.codes(frame.iloc[12:44])
    got = bo.shapley(model, codes, against)
    size = len(model.features)
    for row in range(12):
        want = np.zeros(size)
        for other in against:
            worth = {}
            for taken in itertools.product((False, True), repeat=size):
                worth[taken] = model.margins(np.where(taken, codes[row], other)[None, :].astype(np.uint8))[0]
            for feature in range(size):
                for taken, value in worth.items():
                    if not taken[feature]:
                        k = sum(taken)
                        more = tuple(t or i == feature for i, t in enumerate(taken))
                        want[feature] += math.factorial(k) * math.factorial(size - k - 1) / math.factorial(size) * (worth[more] - value)
        assert got[row] == pytest.approx(want / len(against), abs=1e-9)
    rows = bo.attributions(data.limit(50), "id", model, frame.iloc[12:44]).toPandas()
    sums = rows.groupby("id")["contribution"].sum()
    some = data.limit(50).toPandas().set_index("id").loc[sums.index]
    assert sums.to_numpy() == pytest.approx(model.margins(model.codes(some.reset_index())) - model.margins(against).mean(), abs=1e-9)


def test_unseen_levels_and_empty_tables(spark, model):
    new = spark.createDataFrame([(1, 0.5, None, "violet", "test", 0), (2, None, None, None, "test", 0)], SCHEMA)
    assert all(0 < r["p"] < 1 for r in bo.scored(new, model, "p").collect())
    nothing = bo.boost(new, ["a", "b"], ["kind"], "y", rounds=3)
    assert nothing.trees == () and bo.scored(new, nothing, "p").first()["p"] == pytest.approx(0.5)


class Stage:
    """A barrier stage of threads; counts the messages."""

    def __init__(self, tasks):
        self.said, self.met, self.messages = [None] * tasks, threading.Barrier(tasks, timeout=30), 0

    def task(self, number):
        stage = self

        class Context:
            def partitionId(self):  # noqa: N802
                return number

            def getTaskInfos(self):  # noqa: N802
                return stage.said

            def allGather(self, text):  # noqa: N802
                stage.messages += number == 0
                stage.said[number] = text
                stage.met.wait()
                heard = list(stage.said)
                stage.met.wait()
                return heard

        return Context()


def exchanged(folders, rounds=30):
    """What each of some tasks gets in each round, and the stage; a task may see another folder than the others."""
    stage = Stage(len(folders))

    def run(number):
        together = bo.Exchange(stage.task(number), folders[number])
        return [together.gather(f"{number}-{r}".encode() * (r + number)) for r in range(rounds)]

    with ThreadPoolExecutor(len(folders)) as pool:
        return list(pool.map(run, range(len(folders)))), stage


def test_sums_go_through_files_and_not_a_message_each(tmp_path):
    want = [[f"{t}-{r}".encode() * (r + t) for t in range(3)] for r in range(30)]
    got, stage = exchanged([str(tmp_path)] * 3)
    assert got == [want] * 3 and stage.messages == 2
    # Only the files of the last round are still there.
    assert sum(len(files) for _, _, files in os.walk(tmp_path)) == 3


def test_tasks_that_share_no_folder_use_messages(tmp_path, monkeypatch):
    monkeypatch.setattr(bo, "FIRST_WAIT", 0.2)
    want = [[f"{t}-{r}".encode() * (r + t) for t in range(3)] for r in range(5)]
    got, stage = exchanged([str(tmp_path / "one"), str(tmp_path / "one"), str(tmp_path / "two")], 5)
    assert got == [want] * 3 and stage.messages == 7
    got, stage = exchanged([None] * 3, 5)
    assert got == [want] * 3 and stage.messages == 5


def test_sums_of_a_child_and_of_codes_counted_together_equal_plain_sums():
    g = np.random.default_rng(4)
    sizes, n = np.array([9, 65, 4, 65, 3]), 40_000
    assert sorted(sorted(x) for x in bo.joined(sizes, 4500)) == [[0, 2, 4], [1, 3]] and bo.joined(sizes, 10) == [[1], [3], [0], [2], [4]]
    codes = np.stack([g.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8)
    columns = [[row.tobytes() for row in codes], (g.random(n) < 0.2).astype(float), g.random(n), g.random(n) < 0.1, g.integers(-(2**62), 2**62, n), g.normal(0, 1, n)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["codes", "label", "weight", "calib", "draw", "margin"])
    rows = bo.TaskRows(iter([batch]), sizes)
    assert len(rows.joint) == 2
    rows.begin(3)
    root = rows.sums().reshape(3, 1, -1)
    tree = bo.Tree([1, -1, -1], [30, 0, 0], [False] * 3, [True, False, False], [0.0] * 4)
    rows.descend(tree, 0)
    goes_right = codes[:, 1] > 30
    assert (rows.place == goes_right).all()
    counted = np.array([False, True])
    both = bo.children(root, rows.sums(counted).reshape(3, 1, -1), counted)
    starts = np.cumsum(sizes) - sizes
    for node, inside in ((0, ~goes_right), (1, goes_right)):
        chosen = inside[rows.some]
        for feature, size in enumerate(sizes):
            own = codes[rows.some][chosen, feature]
            want = [np.bincount(own, what, size) for what in (rows.gradient[chosen], rows.curvature[chosen], None)]
            assert both[:, node, starts[feature] : starts[feature] + size] == pytest.approx(np.array(want), abs=1e-9)
    # No rows, no sums, however their parent's were rounded.
    assert (both[:2, :, :][:, both[2] == 0] == 0).all()


def test_the_first_of_equal_columns_splits():
    g = np.random.default_rng(6)
    own = np.stack([g.normal(0, 1e5, 12), g.random(12) * 1e5, g.integers(50, 900, 12)])
    for rounding in (1 - 1e-13, 1 + 1e-13):
        sums = np.concatenate([own, own * np.array([[rounding], [1.0], [1.0]])], axis=1)[:, None]
        assert bo.best_splits(sums, np.array([12, 12]), 2)[0][1] == 0


@pytest.mark.parametrize("depth", [1, 3, 4, 5])
def test_shapley_values_from_tables_equal_full_enumeration(depth):
    """Trees that ask a feature twice on a path or send all rows left; a row costs a lookup for each feature of a table."""
    g = np.random.default_rng(depth)
    inner, names = (1 << depth) - 1, ["a", "b", "c", "d"]
    trees = tuple(
        bo.Tree([int(f) for f in g.choice([-1, 0, 1, 2, 3], inner, p=[0.1, 0.3, 0.2, 0.2, 0.2])], [int(c) for c in g.integers(1, 5, inner)],
                [bool(v) for v in g.random(inner) < 0.3], [bool(v) for v in g.random(inner) < 0.5], [float(v) for v in g.normal(0, 1, inner + 1)])
        for _ in range(6)
    )
    model = bo.Boosted(tuple(names), (), {n: [1.0, 2.0, 3.0, 4.0] for n in names}, {}, 0.2, trees)
    codes, against = g.integers(0, 6, (9, 4)).astype(np.uint8), g.integers(0, 6, (5, 4)).astype(np.uint8)
    tables = bo.pass_tables(model, against)
    assert len(tables) <= len(trees) << max(depth - 3, 0) and all(worth.shape[1] <= 1 << depth + 4 for _, _, worth in tables)
    got = bo.looked_up(tables, codes)
    for row, want in zip(codes, got, strict=True):
        found = np.zeros(4)
        for order in itertools.permutations(range(4)):
            mixed = against.copy()
            was = model.margins(mixed)
            for feature in order:
                mixed[:, feature] = row[feature]
                found[feature] += (model.margins(mixed) - was).mean() / 24
                was = model.margins(mixed)
        assert want == pytest.approx(found, abs=1e-9)
