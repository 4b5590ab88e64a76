import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions import explain as ex
from emberline.functions import grades as G
from emberline.functions.scorer import DEMO_SCORER
from emberline.operators import stress as st

DRIVER = "array<struct<feature string, label string, value double, shap double, direction string>>"
DRIVERS = [
    ("ext_source_2", "External credit score 2", 0.1537, 0.61234, "increases risk"),
    ("credit_income_ratio", "Credit-to-income ratio", 5.25, 0.20111, "increases risk"),
    ("prior_late_rate", "Late-payment rate on earlier loans", None, 0.1, "increases risk"),
    ("age_years", "Applicant age (years)", 24.0, -0.05, "decreases risk"),
    ("bureau_active_count", "Active credit lines (bureau)", 3.0, 0.01, "increases risk"),
]


def story(spark, text=None):
    df = spark.createDataFrame([(DRIVERS, "E", 0.104, text)], f"d {DRIVER}, g string, p double, t string")
    return df.select(ex.narrative_or_fallback(F.col("t"), F.col("d"), F.col("g"), F.col("p")).alias("s")).first()["s"]


def test_template_text(spark):
    got = story(spark)
    assert got["source"] == "template" and got["verified"]
    assert got["text"].startswith(
        "Grade E: 10.4% chance of default within 12 months. First comes external credit score 2 = 0.1537 increases risk by "
        "+0.61234. Then: credit-to-income ratio = 5.25 increases risk by +0.20111; late-payment rate on earlier loans "
        "increases risk by +0.1;"
    )


@pytest.mark.parametrize("text,source", [
    ("Probability is 87.3% over 12 months.", "template"),
    ("About 10% over 12 months; External credit score 2 of 0.15 adds 0.61.", "supplied"),
    ("No numbers at all.", "supplied"),
    ("ratio 5.3 and 24 years", "supplied"),
    ("score v7.7 is fine but 7.7 is not", "template"),
])
def test_guardrail(spark, text, source):
    assert story(spark, text)["source"] == source


@pytest.mark.parametrize("value", [0.0, 1.0, -1.5, 0.05, 123456.789, 99999.96, 1234567.1, 0.00001234, 365243.0, 100.0, 0.1537, 12.0001])
def test_short_number_equals_general_format(spark, value):
    got = spark.range(1).select(ex.short_number(F.lit(value)), ex.signed_number(F.lit(value))).first()
    assert got[0] == f"{value:g}" and got[1] == f"{value:+g}"


FEATURES = dict(credit_income_ratio=6.0, annuity_income_ratio=0.3, bureau_active_count=4, bureau_overdue_flag=1,
                ext_source_1=0.4, ext_source_2=0.1, ext_source_3=None, age_years=30.0, employed_years=1.0,
                prior_late_rate=0.3, prior_n_installments=20)


def loans(spark, *changes):
    schema = ", ".join(f"{f} {'int' if isinstance(v, int) else 'double'}" for f, v in FEATURES.items())
    rows = [tuple({**FEATURES, **c}.values()) for c in changes]
    df = spark.createDataFrame(rows, schema)
    scored = df.withColumn("logit", DEMO_SCORER.logit()).withColumn("pd", DEMO_SCORER.cumulative(F.col("logit")))
    graded = scored.withColumn("risk_grade", G.pd_to_grade(F.col("pd")))
    return graded.withColumn("drivers", ex.top_drivers(ex.attributions(DEMO_SCORER)))


def score(features):
    logit = DEMO_SCORER.intercept + sum(
        c * (features[f] - DEMO_SCORER.means[f]) for f, c in DEMO_SCORER.coefficients.items() if features[f] is not None
    )
    survive = 1.0
    for e in DEMO_SCORER.month_effects:
        survive *= 1 - 1 / (1 + math.exp(-(logit + e)))
    p = 1 - survive
    return p, next((g for u, g in K.GRADE_BANDS if p < u), "G")


def searched(features):
    """The smallest single-lever move by plain loops over the same drivers."""
    _, grade = score(features)
    sizes = sorted(
        ((round(c * (features[f] - DEMO_SCORER.means[f]), 5) if features[f] is not None else 0.0, i, f) for i, (f, c) in enumerate(DEMO_SCORER.coefficients.items())),
        key=lambda t: (-abs(t[0]), t[1]),
    )[:5]
    levers = [f for s, _, f in sizes if s > 0 and f in K.LEVERS and features[f] is not None][:3]
    best = None
    for f in levers:
        way, bound = K.LEVERS[f]
        span = features[f] - bound if way == "down" else bound - features[f]
        for k in range(1, 11):
            value = features[f] + (-1 if way == "down" else 1) * k / 10 * span
            value = float(round(value)) if f in K.INTEGER_LEVERS else value
            if span > 0 and value != features[f]:
                p, g = score({**features, f: value})
                if g < grade and (best is None or k / 10 < best[0]):
                    best = (k / 10, f, round(value, 4), g)
                    break
    return best


CASES = [{}, {"prior_late_rate": 0.05, "credit_income_ratio": 1.0, "ext_source_2": 0.6, "bureau_overdue_flag": 0},
         {"prior_late_rate": 0.0, "credit_income_ratio": 60.0}, {"bureau_active_count": 9, "prior_late_rate": None, "ext_source_2": 0.9},
         {"prior_late_rate": 0.9, "ext_source_2": 0.0}]


def test_counterfactual_equals_search_and_really_improves(spark):
    found = ex.counterfactual(DEMO_SCORER, F.col("drivers"), F.col("logit"), F.col("pd"), F.col("risk_grade"))
    rows = loans(spark, *CASES).withColumn("c", found).collect()
    hits = 0
    for case, row in zip(CASES, rows):
        features = {**FEATURES, **case}
        p, grade = score(features)
        assert row["pd"] == pytest.approx(p, abs=1e-12) and row["risk_grade"] == grade
        want, c = searched(features), row["c"]
        if want is None:
            assert c["feature"] is None and c["reason"]
            continue
        hits += 1
        assert (c["feature"], c["suggested_value"], c["new_grade"]) == (want[1], pytest.approx(want[2]), want[3])
        assert c["reason"] is None and c["new_grade"] < grade
        assert score({**features, c["feature"]: c["suggested_value"]})[1] <= c["new_grade"]
    assert hits >= 2


def test_counterfactual_reasons(spark):
    best = loans(spark, {"prior_late_rate": 0.0, "ext_source_2": 1.0, "credit_income_ratio": 0.0, "age_years": 70.0, "ext_source_1": 1.0, "ext_source_3": 1.0,
                         "bureau_overdue_flag": 0, "bureau_active_count": 0, "employed_years": 30.0})
    # Only features nobody can move push the risk up.
    fixed = loans(spark, {"prior_late_rate": 0.0, "ext_source_2": 0.5, "credit_income_ratio": 2.0, "ext_source_1": 0.5, "annuity_income_ratio": 0.1,
                          "bureau_overdue_flag": 0, "bureau_active_count": 0, "age_years": -400.0, "employed_years": -100.0})
    for df, text in ((best, "grade A has"), (fixed, "none of the main")):
        c = df.select(ex.counterfactual(DEMO_SCORER, F.col("drivers"), F.col("logit"), F.col("pd"), F.col("risk_grade")).alias("c")).first()["c"]
        assert c["feature"] is None and c["reason"].startswith(text)


def test_borrower_wording(spark):
    rows = loans(spark, CASES[0]).withColumn("c", ex.counterfactual(DEMO_SCORER, F.col("drivers"), F.col("logit"), F.col("pd"), F.col("risk_grade")))
    text = rows.select(G.borrower_counterfactual_text(F.col("c"))).first()[0]
    assert text.startswith("Improving ") or text.startswith("A single specific improvement")
    assert rows.select(G.borrower_band_text(F.lit("G"))).first()[0].startswith("immediate attention")


def test_stress_direction_and_arguments(spark):
    df = loans(spark, *CASES).withColumn("sector_segment", F.lit("Manufacturing"))
    down = st.stress_test(df, DEMO_SCORER, "revenue", -15).first()
    assert down["magnitude"] == -0.15 and down["delta_expected_loss_rate"] > 0
    assert sum(down[f"pre_{g}"] for g in K.GRADES) == sum(down[f"post_{g}"] for g in K.GRADES) == len(CASES)
    other = st.stress_test(df, DEMO_SCORER, "sector_demand", -0.2, sector="Retail_Trade").first()
    assert other["n_loans_shocked"] == 0 and other["delta_expected_loss_rate"] == 0
    for bad in (("revenue", -1.0, None), ("weather", 0.1, None), ("sector_demand", 0.1, None)):
        with pytest.raises(ValueError):
            st.stress_test(df, DEMO_SCORER, *bad)


def test_ladders(spark):
    days = spark.createDataFrame([(d,) for d in (0, 1, 30, 31, 60, 90, 91)], "d int")
    assert [r[0] for r in days.select(G.sma_bucket(F.col("d"))).collect()] == [None, "SMA-0", "SMA-0", "SMA-1", "SMA-1", "SMA-2", "NPA"]
    seen = [(0.1, False, 0), (0.3, False, 0), (0.6, False, 0), (0.3, False, 0), (0.3, True, 0), (0.3, False, 45), (0.9, False, 91), (0.0, False, 0)]
    df = spark.createDataFrame([(seen,)], "o array<struct<pd double, indicator boolean, days_past_due int>>")
    states = df.select(G.ews_fold(F.col("o"))).first()[0]
    assert states == ["Performing", "WatchList", "HighAlert", "WatchList", "HighAlert", "Critical", "NPA_Stage3", "NPA_Stage3"]


def test_grades_and_routing(spark):
    pds = spark.createDataFrame([(p,) for p in (0.0, 0.0099, 0.01, 0.07, 0.1999, 0.2, 1.5, None)], "p double")
    assert [r[0] for r in pds.select(G.pd_to_grade(F.col("p"))).collect()] == ["A", "A", "B", "E", "F", "G", "G", None]
    rich = spark.createDataFrame([("ntc_ntb",), ("established",), (None,)], "r string")
    assert [r[0] for r in rich.select(G.route_model(F.col("r"))["model_used"]).collect()] == ["thin_file", "hazard", "hazard"]
    assert [r[0] for r in rich.select(G.route_model(F.col("r"), False)["thin_file_unavailable"]).collect()] == [True, False, False]
