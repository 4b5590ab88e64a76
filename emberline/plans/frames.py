"""Composed jobs the queries share: feature table, panel inputs and the scored book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.grades import cumulative_pd, grade_action, pd_to_grade
from emberline.functions.scorer import DEMO_SCORER, LinearHazard
from emberline.operators import features as feat
from emberline.operators import panel as pan
from emberline.session import settle
from emberline.sources import views


def feature_table(spark: SparkSession, directory: str) -> DataFrame:
    """Features of every borrower with prior behaviour, duration and event."""
    history = pan.borrower_history(views.installments(spark, directory))
    return feat.assemble_features(
        views.applications(spark, directory),
        views.bureau(spark, directory),
        history,
        keep=["c_mktsegment", "n_regionkey"],
    )


def score(features: DataFrame, scorer: LinearHazard = DEMO_SCORER) -> DataFrame:
    """Add logit, pd, grade: a projection, whatever the size of the book."""
    with_logit = features.withColumn("logit", scorer.logit())
    scored = with_logit.withColumn("pd", scorer.cumulative(F.col("logit")))
    return scored.withColumn("risk_grade", pd_to_grade(F.col("pd")))


def scored_book(spark: SparkSession, directory: str) -> DataFrame:
    """Every borrower with an observed loan, scored."""
    return score(feature_table(spark, directory).where(F.col("duration").isNotNull()))


CELLS = ["c_mktsegment", "n_regionkey"]


def observed_loans(spark: SparkSession, directory: str) -> DataFrame:
    """Borrowers with an observed loan: cell, segments, duration and event."""
    history = pan.recent_loan_durations(views.installments(spark, directory))
    applications = feat.data_richness(
        feat.with_segments(views.applications(spark, directory, with_credit=False)), views.bureau(spark, directory)
    )
    return applications.select("borrower_id", *CELLS, *K.SEGMENT_COLUMNS).join(history, "borrower_id")


def graded_cells(loans: DataFrame, weight: str | None = None) -> DataFrame:
    """pd, grade and action of each cell from its empirical 12-month curve."""
    curves = pan.segment_curves(pan.life_table_from_durations(loans, CELLS, weight), CELLS)
    priced = curves.select(*CELLS, cumulative_pd(F.col("hazard_curve")).alias("pd"))
    grade = pd_to_grade(F.col("pd"))
    return priced.withColumn("risk_grade", grade).withColumn("action", grade_action(F.col("risk_grade")))


def life_table_book(spark: SparkSession, directory: str) -> DataFrame:
    """Borrowers graded by the curve of their market segment × region."""
    loans = observed_loans(spark, directory)
    return loans.join(graded_cells(loans), CELLS)


def life_table_groups(spark: SparkSession, directory: str) -> DataFrame:
    """The same book with one row per combination of cell, segments and outcome, and its count.

    Loans of a cell share a PD, so reports need only these rows: the loans are reduced once, and both
    the curves and the report are built from the few that remain.
    """
    loans = observed_loans(spark, directory)
    groups = settle(loans.groupBy(*CELLS, *K.SEGMENT_COLUMNS, "duration", "event").agg(F.count(F.lit(1)).alias("n_loans")))
    return groups.join(graded_cells(groups, "n_loans"), CELLS)
