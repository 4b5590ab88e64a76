"""Scenario runs and the full per-loan score record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions import explain as ex
from emberline.functions import grades as G
from emberline.functions.scorer import LinearHazard
from emberline.operators import calibrate as cal


def stress_test(
    features: DataFrame, scorer: LinearHazard, shock_type: str, magnitude: float, sector: str | None = None
) -> DataFrame:
    """Grade counts and expected-loss rates before and after a shock, over the whole book.

    Both arms are computed in the same row and reduced by one aggregation; nothing is sampled.
    """
    shocked = G.stress_shock(shock_type, magnitude, F.col("sector_segment"), sector)
    mask = F.coalesce(F.col("sector_segment") == sector, F.lit(False)) if shock_type == "sector_demand" else F.lit(True)
    arms = (
        features.withColumns({"_pre_logit": scorer.logit(), "_post_logit": scorer.logit(shocked)})
        .withColumns({"_pre": scorer.cumulative(F.col("_pre_logit")), "_post": scorer.cumulative(F.col("_post_logit"))})
        .withColumns({"_pre_grade": G.pd_to_grade(F.col("_pre")), "_post_grade": G.pd_to_grade(F.col("_post"))})
    )
    pre, post = F.avg("_pre") * K.LOSS_GIVEN_DEFAULT, F.avg("_post") * K.LOSS_GIVEN_DEFAULT
    return arms.agg(
        F.lit(shock_type).alias("shock_type"),
        F.lit(G.normalise_magnitude(magnitude)).alias("magnitude"),
        F.count(F.lit(1)).alias("n_loans_scored"),
        F.count_if(mask).alias("n_loans_shocked"),
        *[
            F.count_if(F.col(f"_{arm}_grade") == g).alias(f"{arm}_{g}")
            for arm in ("pre", "post")
            for g in K.GRADES
        ],
        F.round(pre, 5).alias("pre_expected_loss_rate"),
        F.round(post, 5).alias("post_expected_loss_rate"),
        F.round(post - pre, 5).alias("delta_expected_loss_rate"),
    )


def regulatory_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.REGULATORY_MAP), "ml_trigger string, rbi_indicator string, regulatory_action string")


#: Why a loan of the point scorer has no counterfactual.
NO_LEVERS = "the point scorer has no levers to move"


def score_record(
    book: DataFrame, scorer: LinearHazard, calibrators: DataFrame, bands: DataFrame, thin_scorer: LinearHazard | None = None
) -> DataFrame:
    """One nested record per loan: PD, curve, grade, drivers, counterfactual, action, narrative, band.

    Loans routed to the thin-file model are scored by `thin_scorer`, a scorer of one step: they get its probability
    and its drivers, no curve, and a fixed reason instead of a counterfactual. Without it they fall back to `scorer`.
    Each loan's record is built in its own row; calibrators and bands are small joined tables.
    """
    route = G.route_model(F.col("data_richness"), thin_scorer is not None)
    raw = book.withColumns({"logit": scorer.logit(), "_route": route})
    thin = F.col("_route.model_used") == "thin_file"
    hazards, chance, reasons = scorer.hazards(F.col("logit")), scorer.cumulative(F.col("logit")), ex.top_drivers(ex.attributions(scorer))
    if thin_scorer is not None:
        hazards = F.when(~thin, hazards)
        chance = F.when(thin, thin_scorer.cumulative(thin_scorer.logit())).otherwise(chance)
        reasons = F.when(thin, ex.top_drivers(ex.attributions(thin_scorer))).otherwise(reasons)
    raw = raw.withColumns({"hazards": hazards, "raw_pd": chance})
    arrays = cal.calibrator_arrays(cal.settle(calibrators))
    knots = cal.with_segment_rows(raw, "loan_type_segment", arrays, "knots")
    calibrated = knots.withColumn("pd", cal.interpolate(F.col("knots"), F.col("raw_pd")))
    graded = calibrated.withColumns({"risk_grade": G.pd_to_grade(F.col("pd")), "drivers": reasons})
    counterfactual = ex.counterfactual(
        scorer, F.col("drivers"), F.col("logit"), F.col("pd"), F.col("risk_grade"),
        calibrate=lambda p: cal.interpolate(F.col("knots"), p),
    )
    told = graded.withColumns(
        {
            "counterfactual": counterfactual,
            "narrative": ex.narrative_or_fallback(None, F.col("drivers"), F.col("risk_grade"), F.col("pd")),
        }
    ).drop("knots")
    if thin_scorer is not None:
        fields = told.schema["counterfactual"].dataType.fields
        none = F.struct(*[(F.lit(NO_LEVERS) if f.name == "reason" else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
        told = told.withColumn("counterfactual", F.when(thin, none).otherwise(F.col("counterfactual")))
    banded = cal.confidence_band(told, bands, "loan_type_segment", "pd")
    return banded.select(
        "borrower_id",
        F.col("loan_type_segment").alias("segment"),
        F.col("sector_segment").alias("sector"),
        "data_richness",
        F.col("_route.model_used").alias("model_used"),
        (F.col("_route.model_used") == "thin_file").alias("point_estimate"),
        F.col("_route.thin_file_unavailable").alias("thin_file_unavailable"),
        F.transform("hazards", lambda h: F.round(h, 5)).alias("hazard_curve"),
        F.round("raw_pd", 4).alias("raw_cum_pd_12m"),
        F.round("pd", 4).alias("calibrated_pd_12m"),
        "risk_grade",
        G.grade_action(F.col("risk_grade")).alias("recommended_action"),
        F.col("drivers").alias("top_drivers"),
        "narrative",
        "counterfactual",
        F.col("band").alias("confidence_band"),
        F.lit(K.DISCLOSURE).alias("disclosure"),
    )


def audit_rows(records: DataFrame, endpoint: str = "score") -> DataFrame:
    """What a scoring run appends to the audit log: one row per record, with the record itself as JSON."""
    return records.select(
        F.col("borrower_id").alias("loan_id"),
        F.lit(endpoint).alias("endpoint"),
        "model_used",
        "calibrated_pd_12m",
        "risk_grade",
        F.col("narrative.source").alias("narrative_source"),
        F.to_json(F.struct(*records.columns)).alias("payload"),
        F.current_timestamp().alias("scored_at"),
    )


EXPLANATION = "risk_grade string, calibrated_pd_12m double, top_drivers array<struct<feature:string,shap:double>>, narrative struct<text:string,source:string>, counterfactual struct<feature:string,reason:string>"


def explanations(audit: DataFrame) -> DataFrame:
    """The newest stored explanation of each loan, read from the audit log without scoring again."""
    newest = audit.groupBy("loan_id").agg(F.max_by("payload", F.struct("scored_at", "payload")).alias("payload"))
    return newest.select("loan_id", F.from_json("payload", EXPLANATION).alias("e")).select("loan_id", "e.*")
