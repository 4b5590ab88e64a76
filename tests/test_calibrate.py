import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions.scalar import evaluable, models_disagree
from emberline.operators import calibrate as cal


def isotonic(points):
    """max over j ≤ i of min over k ≥ i of the mean of j..k, on (x, weight, label sum)."""
    fitted = []
    for i in range(len(points)):
        best = -1.0
        for j in range(i + 1):
            worst = min(
                sum(p[2] for p in points[j : k + 1]) / sum(p[1] for p in points[j : k + 1]) for k in range(i, len(points))
            )
            best = max(best, worst)
        fitted.append(best)
    return fitted


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(21)
    rows = []
    for i in range(1500):
        segment = rng.choice(["a", "a", "a", "b"])
        x = round(rng.random(), 2)
        rows.append((segment, x, int(rng.random() < x * (0.5 if segment == "a" else 0.9))))
    return rows


def test_isotonic_equals_min_max_form(spark, scored):
    df = spark.createDataFrame(scored, "segment string, x double, y int").repartition(7)
    fitted = cal.fit_calibrators(df, "segment", "x", "y")
    applied = cal.apply_calibration(df, fitted, "segment", "x").select("segment", "x", "calibrated_pd").distinct().collect()
    for segment in ("a", "b"):
        xs = sorted({x for s, x, _ in scored if s == segment})
        points = [
            (x, sum(1 for s, v, _ in scored if s == segment and v == x), sum(y for s, v, y in scored if s == segment and v == x))
            for x in xs
        ]
        want = dict(zip(xs, isotonic(points)))
        got = {r["x"]: r["calibrated_pd"] for r in applied if r["segment"] == segment}
        assert got == {x: pytest.approx(v, abs=1e-12) for x, v in want.items()}
        assert [got[x] for x in xs] == sorted(got[x] for x in xs)


def test_pooling_over_edges_equals_pooling_at_once(spark, monkeypatch):
    """Ranges cut anywhere, and few blocks of each side in a task: the same blocks."""
    monkeypatch.setattr(cal, "EDGE_BLOCKS", 3)
    rng = random.Random(4)
    # A falling stretch in the middle makes one block over many ranges.
    rows = [("s", i / 400, int(rng.random() < (i / 400 if not 100 < i < 300 else 0.6 - i / 1000))) for i in range(400)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fitted = cal.fit_calibrators(spark.createDataFrame(rows, "segment string, x double, y int"), "segment", "x", "y")
        got = sorted((r["x_lo"], r["x_hi"], r["weight"], r["value"]) for r in fitted.where("segment = 's'").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    x = np.array([r[1] for r in rows])
    want = zip(*cal.pooled(x, x, np.ones(400), np.array([float(r[2]) for r in rows])), strict=True)
    assert got == [(lo, hi, int(w), pytest.approx(y / w)) for lo, hi, w, y in want]
    values = isotonic([(v, 1.0, float(y)) for (_, v, y) in rows[:120]])
    part = cal.pooled(x[:120], x[:120], np.ones(120), np.array([float(r[2]) for r in rows[:120]]))
    assert np.repeat(part[3] / part[2], part[2].astype(int)) == pytest.approx(values)


def test_many_equal_scores_and_plan_without_arrays(spark):
    rows = [("a", 0.5, i % 2) for i in range(300)] + [("a", 0.1, 0), ("a", 0.9, 1)]
    fitted = cal.fit_calibrators(spark.createDataFrame(rows, "segment string, x double, y int"), "segment", "x", "y")
    asked = spark.createDataFrame([("a", 0.5, i) for i in range(2000)] + [("a", 0.7, -1)], "segment string, x double, segment_no int")
    out = cal.apply_calibration(asked, fitted, "segment", "x")
    got = {r["segment_no"]: r["calibrated_pd"] for r in out.collect()}
    assert len(got) == 2001 and {v for k, v in got.items() if k >= 0} == {0.5} and got[-1] == pytest.approx(0.75)
    plan = out._jdf.queryExecution().toString()
    assert "scalar-subquery" not in plan and "collect_list" not in plan


def test_nearest_knots_are_found_in_one_pass(spark):
    """Against numpy; no frame ends with the partition, as Spark computes such a frame anew for each row."""
    rng = random.Random(12)
    rows = [("a", round(x, 2), int(rng.random() < x)) for x in (rng.random() for _ in range(400))]
    fitted = cal.fit_calibrators(spark.createDataFrame(rows, "segment string, x double, y int"), "segment", "x", "y")
    knots = sorted((r["x"], r["value"]) for r in cal.knots_of(fitted).where("segment = 'a'").collect())
    asked = spark.createDataFrame([("a", rng.random()) for _ in range(3000)], "segment string, x double")
    out = cal.apply_calibration(asked, fitted, "segment", "x")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = out.select("x", "calibrated_pd").toPandas()
    assert got["calibrated_pd"].to_numpy() == pytest.approx(np.interp(got["x"], *zip(*knots, strict=True)), abs=1e-12)


def test_interpolation_halves_the_knots(spark):
    """Against numpy, for every number of knots; no knot is looked at for each score."""
    rng = random.Random(3)
    rows = []
    for n in (1, 2, 3, 4, 7, 8, 9, 100):
        knots = sorted({round(rng.random(), 3): 0.0 for _ in range(n)})
        rows += [([(x, x * x) for x in knots], v) for v in (-1.0, 2.0, knots[0], knots[-1], *(rng.random() for _ in range(20)))]
    df = spark.createDataFrame([*rows, (None, 0.5), (rows[0][0], None)], "knots array<struct<x double, value double>>, v double")
    out = df.select("*", cal.interpolate(F.col("knots"), F.col("v")).alias("got"))
    assert "filter(" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        want = None if r["knots"] is None or r["v"] is None else np.interp(r["v"], *zip(*r["knots"], strict=True))
        assert r["got"] == (want if want is None else pytest.approx(want, abs=1e-12))


def test_interpolates_clips_and_falls_back(spark):
    rows = [("a", 0.2, 0), ("a", 0.4, 1), ("a", 0.4, 0)]
    fitted = cal.fit_calibrators(spark.createDataFrame(rows, "segment string, x double, y int"), "segment", "x", "y")
    asked = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("a", 0.9), ("new", 0.3), ("a", None)], "segment string, x double")
    got = {(r["segment"], r["x"]): r["calibrated_pd"] for r in cal.apply_calibration(asked, fitted, "segment", "x").collect()}
    assert got[("a", 0.1)] == 0.0 and got[("a", 0.3)] == pytest.approx(0.25) and got[("a", 0.9)] == 0.5
    assert got[("new", 0.3)] == pytest.approx(0.25) and got[("a", None)] is None


def bands_frame(spark, rows):
    df = spark.createDataFrame(rows, "segment string, pd double, event int, duration int")
    return df.where(evaluable(F.col("event"), F.col("duration")))


def test_bands_cover_the_unit_interval(spark):
    rng = random.Random(31)
    rows = [("big", p := rng.random() * 0.4, int(rng.random() < p), 12) for _ in range(2000)]
    rows += [("tiny", 0.05 * i, i % 2, 12) for i in range(8)]
    rows += [("big", 0.9, 0, 4)] * 50  # early-censored: no outcome, no row
    bands = cal.fit_confidence_bands(bands_frame(spark, rows), "segment", "pd", "event")
    by = {}
    for r in bands.orderBy("segment", "band_no").collect():
        by.setdefault(r["segment"], []).append(r)
    assert sum(r["n"] for r in by["big"]) == 2000 and len(by["big"]) == 8 and len(by["tiny"]) == 1
    for rows in by.values():
        assert rows[0]["lo"] == 0.0 and rows[-1]["hi"] == 1.0
        assert all(a["hi"] == b["lo"] for a, b in zip(rows, rows[1:]))
    asked = spark.createDataFrame([("tiny", 0.1), ("big", 0.2), ("unseen", 0.2)], "segment string, pd double")
    got = {r["segment"]: r["band"] for r in cal.confidence_band(asked, bands, "segment", "pd").collect()}
    assert got["tiny"]["wide_band_flag"] and got["tiny"]["n_comparable"] == 8
    assert not got["big"]["wide_band_flag"] and got["unseen"]["n_comparable"] > 0


def test_equal_scores_make_one_band(spark):
    bands = cal.fit_confidence_bands(bands_frame(spark, [("a", 0.5, i % 2, 12) for i in range(300)]), "segment", "pd", "event")
    assert {(r["lo"], r["hi"], r["n"]) for r in bands.collect()} == {(0.0, 1.0, 300)}


def test_models_disagree_beyond_the_margin_in_either_direction(spark):
    margin, base = 0.15, 0.4
    gaps = [round(k * 0.01, 2) for k in range(-30, 31)]
    rows = spark.createDataFrame([(base, base + g, g) for g in gaps], "one double, other double, gap double")
    got = {r["gap"]: r["d"] for r in rows.select("gap", models_disagree(F.col("one"), F.col("other")).alias("d")).collect()}
    assert got == {g: abs(g) > margin for g in gaps}


def test_reliability_counts_add_up(spark):
    rng = random.Random(41)
    rows = [(p := round(rng.random(), 3), int(rng.random() < p)) for _ in range(900)]
    table = cal.reliability_table(spark.createDataFrame(rows, "p double, y int"), "y", "p").orderBy("bin").collect()
    assert sum(r["n"] for r in table) == 900 and len(table) == 10
    assert [r["mean_predicted"] for r in table] == sorted(r["mean_predicted"] for r in table)
