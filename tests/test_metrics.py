import random

import numpy as np
import pytest

from emberline.operators import metrics as met


def brute(rows):
    pairs = [(s, y) for s, y in rows]
    p, n = sum(y for _, y in pairs), sum(1 - y for _, y in pairs)
    points, tp, fp, ap, ks, recall = sorted({s for s, _ in pairs}, reverse=True), 0, 0, 0.0, 0.0, 0.0
    for s in points:
        dp = sum(1 for t, y in pairs if t == s and y == 1)
        tp, fp = tp + dp, fp + sum(1 for t, y in pairs if t == s and y == 0)
        ap += dp / p * tp / (tp + fp)
        ks = max(ks, abs(tp / p - fp / n))
        recall = max(recall, tp / p) if fp / n <= 0.1 else recall
    wins = sum((a > b) + 0.5 * (a == b) for a, y in pairs if y for b, z in pairs if not z)
    brier = np.mean([(min(max(s, 0), 1) - y) ** 2 for s, y in pairs])
    return [wins / (p * n), ks, ap, recall, brier]


@pytest.mark.parametrize("ties", [True, False])
def test_metrics_equal_brute_force(spark, ties):
    rng = random.Random(11)
    rows = [(round(rng.uniform(-0.2, 1.2), 1 if ties else 6), int(rng.random() < 0.3)) for _ in range(300)]
    got = met.metrics_row(spark.createDataFrame(rows, "score double, y int"), "y", "score", places=9).first()
    assert [got[m] for m in met.METRICS] == pytest.approx(brute(rows), abs=1e-8)


def test_hand_checked_ties(spark):
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.4, 1), (0.4, 0), (0.1, 0)]
    got = met.metrics_row(spark.createDataFrame(rows, "score double, y int"), "y", "score", places=6).first()
    assert got["auc_roc"] == pytest.approx(7 / 9, abs=1e-6)
    assert got["pr_auc"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3, abs=1e-6)


def test_naive_row_and_table(spark):
    rows = spark.createDataFrame([(0.2, 0), (0.9, 1), (0.4, 0), (0.3, 0)], "s double, y int")
    table = {r["model"]: r for r in met.metric_table(rows, "y", {"m": "s"}).collect()}
    naive = table["naive_always_no_default"]
    assert (naive["auc_roc"], naive["ks"], naive["pr_auc"], naive["accuracy_for_contrast_only"]) == (0.5, 0.0, 0.25, 0.75)
    assert table["m"]["auc_roc"] == 1.0


def test_separability(spark):
    apart = spark.createDataFrame([(float(i), int(i >= 10)) for i in range(20)], "x double, f int")
    assert met.assert_separable(met.separability(apart, "f", "x")).first()["auc"] == 1.0
    same = spark.createDataFrame([(1.0, i % 2) for i in range(20)], "x double, f int")
    with pytest.raises(met.SeparabilityError):
        met.assert_separable(met.separability(same, "f", "x"))
    single = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, f int")
    with pytest.raises(met.SeparabilityError):
        met.assert_separable(met.separability(single, "f", "x"))


@pytest.mark.parametrize("shape", ["skewed", "tied", "one"])
def test_bounds_hold_the_true_values(spark, shape):
    rng = random.Random(shape)
    draw = {"skewed": lambda: rng.random() ** 12, "tied": lambda: rng.choice([0.1, 0.2, 0.7]), "one": lambda: 0.5}[shape]
    rows = [("g", s := draw(), int(rng.random() < 0.1 + 0.5 * s)) for _ in range(900)] + [("h", rng.random(), int(rng.random() < 0.4)) for _ in range(200)]
    df = spark.createDataFrame([*rows, ("g", None, 1), ("g", 0.3, None)], "k string, s double, y int").repartition(3)
    bounds = {r["k"]: r for r in met.bucketed_metrics(df, "y", "s", ["k"], buckets=20).collect()}
    for name in ("g", "h"):
        auc, ks, *_ = brute([(s, y) for k, s, y in rows if k == name])
        b = bounds[name]
        assert b["auc_low"] - 1e-9 <= auc <= b["auc_high"] + 1e-9 and b["auc_high"] - b["auc_low"] < (1.01 if shape != "skewed" or name == "h" else 0.2)
        assert b["ks_low"] - 1e-9 <= ks <= b["ks_high"] + 1e-9
    counts = met.score_buckets(df, "y", "s", ["k"], 20).where("k = 'g'").selectExpr("sum(pos + neg)", "count(*)").first()
    assert counts[0] == 900 and counts[1] <= 20


def test_windows_by_weight_equal_windows_of_rows(spark):
    from emberline.operators import panel, split

    rng = random.Random(6)
    loans = spark.createDataFrame([(i, rng.randint(1, 9), 0) for i in range(150)], "borrower_id long, duration int, event int")
    late = split.oot_split(panel.expand_person_period(loans), "borrower_id").select("borrower_id", "split").distinct()
    early = split.oot_split(loans, "borrower_id", weight="duration").select("borrower_id", "split")
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect()))
