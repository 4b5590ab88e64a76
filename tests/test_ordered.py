import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.operators import ordered, split


@pytest.mark.parametrize("first", [1, 10**10, 1_700_000_000_000_000, "text"])
def test_ranges_are_even_wherever_the_ids_lie(spark, first, monkeypatch):
    """No range holds more than a few times its share, and string ids are ranked too."""
    n, kept = 40_000, []
    settle = ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    ids = F.format_string("id%09d", F.col("id")) if first == "text" else F.col("id") + first
    df = spark.range(n).select(ids.alias("v"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.running_totals(df, "v", ["n"]).orderBy("v").select("cum_n", "total_n").collect()
        sizes = [r["count"] for r in kept[0].groupBy("_bucket").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["cum_n"] for r in got] == list(range(1, n + 1)) and got[0]["total_n"] == n
    assert len(sizes) > 2 and max(sizes) < 3 * n / len(sizes)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(6)
    pdf = pd.DataFrame({"g": ["a", "b"] * 400, "v": [round(rng.gauss(0, 50), 3) for _ in range(800)]})
    pdf = pdf.groupby(["g", "v"]).size().rename("n").reset_index()
    got = ordered.running_totals(spark.createDataFrame(pdf), "v", ["n"], ["g"], descending).toPandas()
    want = pdf.sort_values(["g", "v"], ascending=[True, not descending])
    want["cum"] = want.groupby("g")["n"].cumsum()
    merged = got.merge(want[["g", "v", "cum"]], on=["g", "v"])
    assert len(merged) == len(pdf) and (merged["cum_n"] == merged["cum"]).all()
    assert (got.groupby("g")["total_n"].first() == pdf.groupby("g")["n"].sum()).all()


@pytest.mark.parametrize("n", [1, 2, 7, 1001])
def test_exact_quantiles_equal_numpy(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, rng.gauss(0, 1), rng.gauss(5, 9)]) for _ in range(n)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = ordered.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", probs).first()["edges"]
    assert got == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)


def test_average_rank_equals_pandas(spark):
    rng = random.Random(8)
    pdf = pd.DataFrame({"id": range(300), "v": [float(rng.randint(1, 40)) for _ in range(300)]})
    got = ordered.average_rank(spark.createDataFrame(pdf), "v", "pct").toPandas().sort_values("id")
    assert np.allclose(got["pct"].to_numpy(), pdf["v"].rank(pct=True).to_numpy())


def test_numbering_of_a_hot_key(spark):
    rng = random.Random(9)
    rows = [(1 if rng.random() < 0.5 else rng.randint(2, 9), rng.randint(0, 400), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, t int, i long").withColumn("c", F.floor(F.col("t") / 30))
    got = {(r["k"], r["i"]): r["no"] for r in ordered.numbered_within(df, ["k"], "c", ["t", "i"], "no").collect()}
    for k in {r[0] for r in rows}:
        for no, (_, i) in enumerate(sorted((t, i) for kk, t, i in rows if kk == k), start=1):
            assert got[(k, i)] == no


@pytest.mark.parametrize("n", [1, 2, 10, 1000])
def test_split_uses_the_positional_rule(spark, n):
    ids = list(range(1, n + 1))
    random.Random(n).shuffle(ids)
    rows = split.oot_split(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()
    ordered_ids = sorted(ids)
    train_end, calib_end = ordered_ids[int(n * 0.7) - 1], ordered_ids[int(n * (0.7 + 0.1)) - 1]
    for r in rows:
        want = "train" if r["id"] <= train_end else "calib" if r["id"] <= calib_end else "test"
        assert r["split"] == want
    if n == 1000:
        counts = {s: sum(r["split"] == s for r in rows) for s in ("train", "calib", "test")}
        assert counts == {"train": 700, "calib": 99, "test": 201}


def test_split_is_weighted_by_rows(spark):
    rows = [(i, m) for i in range(1, 11) for m in range(10 if i == 1 else 1)]
    got = split.oot_split(spark.createDataFrame(rows, "id long, m int"), "id").groupBy("id").agg(F.count_distinct("split").alias("k"), F.min("split").alias("s")).collect()
    assert all(r["k"] == 1 for r in got)
    assert {r["id"]: r["s"] for r in got}[1] == "train"


def test_sample_is_reproducible(spark):
    df = spark.range(500).withColumnRenamed("id", "borrower_id")
    one, two = (split.deterministic_sample(df, "borrower_id", 50, 30) for _ in range(2))
    assert one.exceptAll(two).isEmpty() and one.count() == 80
    edges = one.groupBy("split").agg(F.min("borrower_id").alias("lo"), F.max("borrower_id").alias("hi"), F.count("*").alias("n"))
    rows = {r["split"]: r for r in edges.collect()}
    assert rows["train"]["n"] == 50 and rows["train"]["hi"] < rows["test"]["lo"]
