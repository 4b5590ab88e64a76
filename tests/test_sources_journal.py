import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from emberline.operators import boosting as bo
from emberline.operators import features
from emberline.operators import journal as jr
from emberline.operators import metrics as met
from emberline.operators import models as mod
from emberline.operators import online as on
from emberline.operators import woe
from emberline.sources import tables as tb


def folder(name):
    return tempfile.mkdtemp(prefix=f"emberline-{name}-")


def test_loan_tables(spark):
    where = folder("csv")
    with open(f"{where}/installments_payments.csv", "w") as f:
        f.write("SK_ID_PREV,SK_ID_CURR,NUM_INSTALMENT_VERSION,NUM_INSTALMENT_NUMBER,DAYS_INSTALMENT,DAYS_ENTRY_PAYMENT,AMT\n")
        f.write("10,1,1.0,1,-31.0,-30.0,5\n10,1,1.0,2,-1.0,,5\n")
    df = tb.read_loan_table(spark, where, "installments")
    assert [tuple(r) for r in df.orderBy("instalment_no").collect()] == [(1, 10, 1, -31, -30, "public_proxy"), (1, 10, 2, -1, None, "public_proxy")]
    assert tb.read_loan_table(spark, where, "installments", columns=["due_day"]).columns == ["due_day", "data_provenance"]


def test_whitespace_table(spark):
    where = folder("txt")
    attrs = ["A11 6 A34 A43 1169 A65 A75 4 A93 A101 4 A121 67 A143 A152 2 A173 1 A192 A201", "A12 48 A32 A43 5951 A61 A73 2 A92 A101 2 A121 22 A143 A152 1 A173 1 A191 A201"]
    with open(f"{where}/german.data", "w") as f:
        f.writelines(f"{attrs[i % 2].replace(' ', '  ' if i % 3 else ' ')} {1 + i % 2} \n" for i in range(40))
    df = tb.read_whitespace_table(spark, f"{where}/german.data").orderBy("row_id")
    rows = df.collect()
    assert [r["row_id"] for r in rows] == list(range(40)) and [r["target"] for r in rows] == [0, 1] * 20
    assert rows[1]["duration_months"] == 48 and rows[0]["checking_account_status"] == "A11"


def test_row_numbers_over_many_partitions(spark):
    df = tb.with_row_number(spark.range(1000, numPartitions=7).withColumnRenamed("id", "v"))
    assert [(r["row_id"], r["v"]) for r in df.orderBy("row_id").collect()] == [(i, i) for i in range(1000)]


def test_snapshot_and_metrics_round_trip(spark):
    where = folder("snap")
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id long, s string, x double")
    tb.write_snapshot(df, f"{where}/t", ["s"])
    assert tb.read_snapshot(spark, f"{where}/t", ["id", "s", "x"]).exceptAll(df).isEmpty()
    table = spark.createDataFrame([("m1", 0.7, None), ("m2", 0.5, 0.2)], "model string, auc_roc double, ks double")
    tb.write_metrics(table, f"{where}/m")
    back = tb.metrics_by_model(tb.read_metrics(spark, f"{where}/m"), ["auc_roc", "ks"])
    assert back.select(*table.columns).exceptAll(table).isEmpty() and back.count() == 2
    assert met.to_long(table).count() == 4


def test_nan_becomes_null(spark):
    published = tb.frame_of(spark, {"auc_roc": {"a": 0.5, "b": float("nan")}})
    assert {r["model"]: r["value"] for r in published.collect()} == {"a": 0.5, "b": None}


def test_decisions(spark):
    rows = [(1, "accept", None), (2, "modify", " "), (3, "override", "seen"), (4, "bogus", "x"), (5, None, "x"), (6, "override", None)]
    ok, bad = jr.split_decisions(spark.createDataFrame(rows, "loan_id long, decision string, reason string"))
    assert {r["loan_id"] for r in ok.collect()} == {1, 3}
    assert {r["loan_id"]: r["problem"] for r in bad.collect()} == {2: "reason_missing", 4: "unknown_decision", 5: "unknown_decision", 6: "reason_missing"}


def test_append_only_log(spark):
    path = folder("log") + "/audit"
    for i in range(3):
        jr.append_log(spark.createDataFrame([(i, 7, "x")], "audit_id long, loan_id long, note string"), path)
    log = spark.read.parquet(path)
    assert [r["audit_id"] for r in jr.latest_entries(log, "audit_id", 2).collect()] == [2, 1]
    assert tuple(jr.id_continuity(log, "audit_id").first()) == (3, 0, 0)
    assert jr.latest_entries(log, "audit_id", loan=8).isEmpty()


def test_online_offline_unknown_and_labels(spark):
    offline_rows = spark.createDataFrame([(1, 0.5, 1), (2, None, 0)], "id long, x double, target int")
    offline = on.materialize(offline_rows, "id")
    online = on.materialize(offline_rows, "id", ids=spark.createDataFrame([(1,)], "id long"))
    asked = spark.createDataFrame([(1,), (2,), (3,), (1,)], "id long")
    got = {r["id"]: (r["features"], r["source"]) for r in on.online_or_offline(asked, online, offline, "id").collect()}
    assert got == {1: ('{"id":1,"x":0.5}', "online"), 2: ('{"id":2,"x":null}', "offline_fallback"), 3: (None, "unknown")}
    assert on.materialize(offline_rows, "id", limit=1).count() == 1
    with pytest.raises(ValueError, match="known"):
        on.slice_by_sector(spark.createDataFrame([("a",)], "sector_segment string"), "b")


def test_as_of_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    stamp = lambda: f"2024-01-{rng.randint(1, 20):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00"
    left = [(1 if rng.random() < 0.4 else rng.randint(2, 5), stamp(), i) for i in range(150)]
    right = list({(k, t): (k, t, float(i)) for i, (k, t) in enumerate((rng.randint(1, 5), stamp()) for _ in range(60))}.values())
    a = spark.createDataFrame(left, "k long, ts string, i long").withColumn("ts", F.col("ts").cast("timestamp"))
    b = spark.createDataFrame(right, "k long, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["i"]: r["asof_v"] for r in on.feature_at(a, b, "k", "ts", ["v"]).collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        before = [(u, v) for kk, u, v in right if kk == k and u <= t]
        assert got[i] == (max(before)[1] if before else None)


def woe_rows(spark):
    import random

    rng = random.Random(6)
    rows = []
    for i in range(3000):
        x, f = round(rng.random(), 4), int(rng.random() < 0.03)
        rows.append((i, None if i % 20 == 0 else x, f, int(rng.random() < 0.05 + 0.3 * x + 0.2 * f)))
    return spark.createDataFrame(rows, "id long, x double, flag int, y int")


def test_woe_is_monotone_and_large_enough(spark):
    df = woe_rows(spark)
    tables = woe.fit_woe(df, ["x", "flag"], "y", {"x": "ascending", "flag": "ascending"}, {"flag": 0.005})
    x = tables["x"]
    assert [b.rate for b in x.bins] == sorted(b.rate for b in x.bins) and len(x.bins) >= 3
    assert min(b.n for b in x.bins) >= 0.05 * 3000 and x.missing.n == 150
    assert sum(b.n for b in x.bins) + x.missing.n == 3000
    assert [x.woe(b) for b in x.bins] == sorted((x.woe(b) for b in x.bins), reverse=True)  # risk up, WOE down
    assert len(tables["flag"].bins) == 2  # a 3 % flag keeps its own bin
    coded = woe.apply_woe(df, tables)
    per = coded.groupBy("x_woe").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in per) == sorted([*(b.n for b in x.bins), x.missing.n])
    zero = woe.apply_woe(df, tables, missing="zero").where("x is null").select("x_woe").distinct().collect()
    assert [r[0] for r in zero] == [0.0]
    frame = woe.woe_frame(spark, tables).withColumnRenamed("bin_no", "bin")
    assert all(r["monotonic"] for r in woe.is_monotonic(frame, ["feature"]).collect())


def gate_data(spark):
    df = woe_rows(spark).withColumnRenamed("id", "borrower_id")
    split = F.when(F.col("borrower_id") < 2100, "train").when(F.col("borrower_id") < 2400, "calib").otherwise("test")
    return df.withColumn("split", split).persist()


def test_gate_promotes_holds_and_logs(spark):
    where, data = folder("gate"), gate_data(spark)
    weak = data.withColumn("x", F.lit(0.5))
    first = mod.retrain_and_gate(data, ["x", "flag"], "y", where, iterations=5, depth=2)
    assert first["promoted"] and first["registered_version"] == 1
    # A challenger that saw a constant instead of the real feature must not win.
    held = mod.retrain_and_gate(
        data.withColumn("x", F.when(F.col("split") == "test", F.col("x")).otherwise(F.lit(0.5))), ["x", "flag"], "y", where, iterations=2, depth=2
    )
    assert not held["promoted"] and held["reason"].startswith("HELD") and "registered_version" not in held
    again = mod.retrain_and_gate(data, ["x", "flag"], "y", where, iterations=5, depth=2)
    assert again["promoted"] and again["registered_version"] == 2  # a tie promotes
    runs, aliases = spark.read.parquet(f"{where}/runs"), spark.read.parquet(f"{where}/aliases")
    assert runs.count() == 3 and aliases.count() == 2
    current = {r["metric"]: r["value"] for r in jr.production_metrics(aliases, runs, "fused").collect()}
    assert current["auc_roc"] == again["challenger_metrics"]["auc_roc"]
    assert weak.count() == 3000


def test_run_log_drops_unusable_metrics(spark):
    where = folder("runs") + "/runs"
    jr.log_run(spark, where, "n", metrics={"a": 1.0, "b": None, "c": float("nan"), "d": float("inf")})
    assert spark.read.parquet(where).first()["metrics"] == {"a": 1.0}


def test_drift_decides_whether_to_retrain(spark):
    data = gate_data(spark)
    now = F.col("split") == "test"
    shifted = data.withColumn("x", F.when(now, F.col("x") + 0.6).otherwise(F.col("x")))
    calm = mod.drift_triggered_retrain(data, now, data, ["x", "flag"], "y", folder("calm"), iterations=2, depth=2)
    moved = mod.drift_triggered_retrain(shifted, now, data, ["x", "flag"], "y", folder("moved"), iterations=2, depth=2)
    assert calm["status"] == 0 and calm["gate"] is None
    assert moved["drift"]["retrain_triggered"] and moved["gate"]["promoted"] and moved["status"] == 0


def test_hazard_recovers_a_known_model(spark):
    from emberline.operators import panel as pan
    import random, math

    rng = random.Random(12)
    rows = []
    for i in range(6000):
        x = rng.gauss(0, 1)
        h = lambda m: 1 / (1 + math.exp(-(-3.5 + 0.8 * x + (0.5 if m > 6 else 0))))
        died = next((m for m in range(1, 13) if rng.random() < h(m)), None)
        rows.append((i, x if i % 10 else None, died or 12, int(died is not None)))
    df = spark.createDataFrame(rows, "borrower_id long, x double, duration int, event int")
    scorer = mod.fit_hazard(pan.expand_person_period(df), ["x"])
    assert scorer.coefficients["x"] == pytest.approx(0.8, abs=0.12)
    assert scorer.month_effects[9] - scorer.month_effects[2] == pytest.approx(0.5, abs=0.3)
    scored = df.withColumn("pd", scorer.cumulative(scorer.logit()))
    assert scored.agg(F.avg("pd")).first()[0] == pytest.approx(sum(r[3] for r in rows) / len(rows), abs=0.02)


def test_every_sector_with_rows_is_known(spark):
    rows = spark.range(3000).select(F.format_string("sector%04d", F.col("id")).alias("sector_segment"))
    for name in ("sector0000", "sector1500", "sector2999"):
        assert on.slice_by_sector(rows, name).count() == 1
    with pytest.raises(ValueError, match="nowhere"):
        on.slice_by_sector(rows, "nowhere")


def test_more_than_a_thousand_levels(spark):
    rows = spark.range(1500).select(F.col("id").cast("string").alias("c"))
    assert len(features.category_levels(rows, ["c"])["c"]) == 1500


def test_classifier_stops_on_the_calib_window_and_takes_nulls(spark):
    g = random.Random(13)
    rows = [(i, x := g.gauss(0, 1), g.choice(["a", "b"]), int(g.random() < 1 / (1 + math.exp(-2 * x))), "calib" if i % 4 == 0 else "train") for i in range(800)]
    df = spark.createDataFrame([(i, None if i % 10 == 0 else x, s, y, p) for i, x, s, y, p in rows], "borrower_id long, x double, s string, y int, split string")
    scored, model = mod.fit_loan_classifier(df, ["x"], "y", categories=["s"], patience=5)
    losses = [h[0] for h in model.history]
    assert 1 < len(model.trees) < 1000 and losses[-1] == min(losses)
    assert scored.where("classifier_pd is null").count() == 0


def test_tree_hazard_recovers_a_known_model(spark):
    from emberline.operators import panel as pan

    g = random.Random(12)
    rows = []
    for i in range(4000):
        x, s = g.gauss(0, 1), g.choice(["low", "high"])
        died = next((m for m in range(1, 13) if g.random() < 1 / (1 + math.exp(-(-4 + 0.8 * x + (1.2 if s == "high" else 0))))), None)
        rows.append((i, x if i % 7 else None, s, died or 12, int(died is not None), "calib" if i % 5 == 0 else "train"))
    df = spark.createDataFrame(rows, "borrower_id long, x double, s string, duration int, event int, split string")
    panel = pan.expand_person_period(df).persist()
    model = mod.fit_tree_hazard(panel, ["x"], ["s"], patience=6, iterations=25)
    scored = mod.tree_cumulative(df, model, "pd").persist()
    assert scored.agg(F.avg("pd")).first()[0] == pytest.approx(sum(r[4] for r in rows) / len(rows), abs=0.03)
    by = {r["s"]: r["m"] for r in scored.groupBy("s").agg(F.avg("pd").alias("m")).collect()}
    assert by["high"] > by["low"] + 0.1
    # The months filled in by code equal the panel's own rows.
    hazards = bo.scored(pan.expand_person_period(df.withColumn("duration", F.lit(12)).withColumn("event", F.lit(0))), model, "h")
    folded = hazards.groupBy("borrower_id").agg(F.product(1 - F.col("h")).alias("alive")).join(scored, "borrower_id")
    assert folded.agg(F.max(F.abs(1 - F.col("alive") - F.col("pd")))).first()[0] < 1e-9


def test_arms_and_their_paired_interval(spark):
    g = random.Random(5)
    rows = []
    for i in range(3000):
        a, b = g.gauss(0, 1), g.gauss(0, 1)
        y = int(g.random() < 1 / (1 + math.exp(-(0.5 * a + 1.5 * b))))
        rows.append((i, a, b if i % 3 else None, y, "train" if i % 10 < 6 else "calib" if i % 10 < 8 else "test"))
    df = spark.createDataFrame(rows, "borrower_id long, a double, b double, y int, split string").persist()
    scored, models = mod.fit_arms(df, {"few": (["a"], []), "all": (["a", "b"], [])}, "y", iterations=12, patience=5)
    assert set(models) == {"few", "all"} and scored.count() == 600
    got = met.paired_auc(scored, "borrower_id", "y", "few", "all", replicates=60).first()
    exact = {r["model"]: r["auc_roc"] for r in met.metrics_row(met.long_scores(scored, "y", {"few": "few", "all": "all"}), "label", "score", ["model"]).collect()}
    assert got["base_auc"] == pytest.approx(exact["few"], abs=2e-3) and got["other_auc"] == pytest.approx(exact["all"], abs=2e-3)
    assert 0 < got["low"] < got["delta"] < got["high"]
    same = met.paired_auc(scored, "borrower_id", "y", "few", "few", replicates=20).first()
    assert same["low"] == same["delta"] == same["high"] == 0


def every_partition(n):
    """All ways to cut n neighbours, as lists of (start, end)."""
    for mask in range(1 << (n - 1)):
        cuts = [0, *[i + 1 for i in range(n - 1) if mask >> i & 1], n]
        yield list(zip(cuts, cuts[1:]))


@pytest.mark.parametrize("trend", ["ascending", "descending"])
def test_bins_are_the_best_of_all(trend):
    g = random.Random(trend)
    for _ in range(25):
        size = g.randint(1, 12)
        bins = [woe.Bin(float(i), float(i + 1), n := g.randint(1, 60), g.randint(0, n)) for i in range(size)]
        total, hits, least = sum(b.n for b in bins), sum(b.events for b in bins), g.choice([0, 20, 60])
        best = None
        for cut in every_partition(size):
            parts = [(sum(b.n for b in bins[a:e]), sum(b.events for b in bins[a:e])) for a, e in cut]
            rates = [e / n for n, e in parts]
            steps = [b - a if trend == "ascending" else a - b for a, b in zip(rates, rates[1:])]
            if min(n for n, _ in parts) >= least and all(x > 1e-12 for x in steps):
                value = sum(woe.information(total, hits, n, e) for n, e in parts)
                best = value if best is None else max(best, value)
        got = woe.optimal_bins(bins, trend, least)
        value = sum(woe.information(total, hits, b.n, b.events) for b in got)
        assert (got[0].lo, got[-1].hi) == (0.0, float(size)) and sum(b.n for b in got) == total
        assert len(got) == 1 if best is None else value == pytest.approx(best)


def test_versions_are_given_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    where = folder("aliases") + "/aliases"
    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(lambda i: jr.move_alias(spark, where, "m", "production", f"run{i}"), range(12)))
    assert sorted(versions) == list(range(1, 13))
    rows = spark.read.schema(jr.ALIAS_SCHEMA).parquet(where).where("model = 'm'")
    assert rows.count() == 12 and rows.select("version").distinct().count() == 12
    assert jr.move_alias(spark, where, "other", "production", "r") == 1


def test_newest_versions_write_through_and_reset(spark):
    offline = spark.createDataFrame([(k, v, 10.0 * k + v) for k in range(1, 5) for v in range(3)], "id long, version int, x double")
    rows = on.materialize(offline, "id", order=["version"]).select("id", F.get_json_object("features", "$.x").cast("double").alias("x"))
    assert {r["id"]: r["x"] for r in rows.collect()} == {k: 10.0 * k + 2 for k in range(1, 5)}
    path, whole = folder("online") + "/rows", on.materialize(offline, "id", order=["version"])
    on.materialize(offline.withColumn("x", F.lit(-1.0)), "id", spark.createDataFrame([(1,)], "id long"), order=["version"]).write.parquet(path)
    asked = spark.createDataFrame([(1,), (2,), (2,), (9,)], "id long")
    sources = lambda: {r["id"]: r["source"] for r in on.online_or_offline(asked, on.online_table(spark, path, "id"), whole, "id").collect()}
    assert sources() == {1: "online", 2: "offline_fallback", 9: "unknown"}
    assert on.write_through(on.online_or_offline(asked, on.online_table(spark, path, "id"), whole, "id"), "id", path).count() == 1
    assert sources() == {1: "online", 2: "online", 9: "unknown"}
    on.reset_rows(offline, "id", spark.createDataFrame([(1,)], "id long"), path, order=["version"])
    newest = on.online_table(spark, path, "id").where("id = 1").select(F.get_json_object("features", "$.x").cast("double")).first()[0]
    assert newest == 12.0


def test_facts_of_one_time_take_the_greatest(spark):
    facts = spark.createDataFrame([(1, 5, 3.0), (1, 5, 9.0), (1, 5, 4.0), (1, 7, 1.0)], "k long, ts int, v double").repartition(4)
    probes = spark.createDataFrame([(1, 4), (1, 5), (1, 6), (1, 8)], "k long, ts int")
    got = on.feature_at(probes, facts, "k", "ts", ["v"], coarse=F.col("ts") / 2)
    assert sorted((r["ts"], r["asof_v"]) for r in got.collect()) == [(4, None), (5, 9.0), (6, 9.0), (8, 1.0)]
