"""The batch build from raw tables to a graded book, with a table written after each stage.

Stages hand over written tables, so a later stage reads columns instead of recomputing its inputs,
and a lost executor costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.grades import grade_action, pd_to_grade
from emberline.functions.scalar import evaluable
from emberline.functions.scorer import LinearHazard
from emberline.operators import calibrate as cal
from emberline.operators import features as feat
from emberline.operators import metrics as met
from emberline.operators import models as mod
from emberline.operators import panel as pan
from emberline.operators import portfolio as port
from emberline.operators import quality as qual
from emberline.operators import split as sp
from emberline.sources.tables import read_snapshot, write_metrics, write_snapshot


def build_features(tables: Mapping[str, DataFrame], folder: str, gate: bool = True) -> DataFrame:
    """Feature table with prior behaviour, duration and event, behind the quality gate."""
    spark = tables["applications"].sparkSession
    history = pan.borrower_history(tables["installments"])
    write_snapshot(feat.assemble_features(tables["applications"], tables["bureau"], history), f"{folder}/features")
    features = read_snapshot(spark, f"{folder}/features")
    if gate:
        qual.assert_quality("features", qual.quality_suite(features, qual.serving_checks(features)))
    return features


def split_panel(features: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Person-period rows and loans, both with the window of the row-weighted ordered split."""
    loans = features.where(F.col("duration").isNotNull())
    ends = sp.split_thresholds(loans.select("borrower_id", "duration"), "borrower_id", weight="duration").first()
    split = sp.window_of(F.col("borrower_id"), F.lit(ends["train_end"]), F.lit(ends["calib_end"]))
    panel = pan.expand_person_period(loans.select("borrower_id", "duration", "event", *names))
    return panel.withColumn("split", split), loans.withColumn("split", split)


def score_book(loans: DataFrame, scorer: LinearHazard, calibrators: DataFrame, segment: str = "loan_type_segment") -> DataFrame:
    """Raw and calibrated PD, grade and action of every loan."""
    raw = loans.withColumn("logit", scorer.logit()).withColumn("raw_pd", scorer.cumulative(F.col("logit")))
    calibrated = cal.apply_calibration(raw, calibrators, segment, "raw_pd", "pd")
    return calibrated.withColumn("risk_grade", pd_to_grade(F.col("pd"))).withColumn("action", grade_action(F.col("risk_grade")))


def build_book(
    tables: Mapping[str, DataFrame],
    folder: str,
    names: Sequence[str] = K.CORE_FEATURES,
    segment: str = "loan_type_segment",
    gate: bool = True,
) -> LinearHazard:
    """Features → panel → hazard → calibration → graded book and its reports, all under `folder`.

    Writes features, book, calibrators, bands, metrics, fairness and portfolio. The hazard is fitted
    on the train window; calibrators and bands on the calib window; metrics are of the test window.
    """
    features = build_features(tables, folder, gate)
    spark: SparkSession = features.sparkSession
    panel, loans = split_panel(features, names)
    scorer = mod.fit_hazard(panel, list(names))
    raw = loans.withColumn("logit", scorer.logit()).withColumn("raw_pd", scorer.cumulative(F.col("logit")))
    known = evaluable(F.col("event"), F.col("duration"))
    fitting = raw.where((F.col("split") == "calib") & known)
    write_snapshot(cal.fit_calibrators(fitting, segment, "raw_pd", "event"), f"{folder}/calibrators")
    calibrators = read_snapshot(spark, f"{folder}/calibrators")
    write_snapshot(score_book(loans, scorer, calibrators, segment), f"{folder}/book", ["split"])
    book = read_snapshot(spark, f"{folder}/book")
    bands = cal.fit_confidence_bands(book.where((F.col("split") == "calib") & known), segment, "pd", "event")
    write_snapshot(bands, f"{folder}/bands")
    test = book.where((F.col("split") == "test") & known)
    write_metrics(met.metric_table(test, "event", {"hazard_raw": "raw_pd", "hazard_calibrated": "pd"}), f"{folder}/metrics")
    write_snapshot(port.fairness_audit(book), f"{folder}/fairness")
    write_snapshot(port.portfolio_summary(book), f"{folder}/portfolio")
    return scorer
