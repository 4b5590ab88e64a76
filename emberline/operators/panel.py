"""Person-period panel: latest loan, censored durations, monthly rows, prior behaviour.

One aggregation per (borrower, loan) carries everything the panel and the prior-behaviour
features need, so the installments are read and exchanged once. Both aggregations combine before
the exchange, so a borrower holding a third of all rows arrives as a handful of partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.scalar import clip, days_late, is_late
from emberline.operators.ordered import numbered_within

KEYS = ["borrower_id", "loan_id"]


def recency() -> Column:
    """Orders a borrower's loans: last due day, an unknown day being latest, then the loan id."""
    return F.struct(F.col("max_day").isNull().alias("unknown"), "max_day", "loan_id")


def loan_summary(
    installments: DataFrame, threshold: int = K.EVENT_DAYS_LATE, unpaid_days: int = K.UNPAID_DAYS_LATE
) -> DataFrame:
    """One row per (borrower, loan) with what later steps need."""
    days = days_late(F.col("due_day"), F.col("paid_day"))
    late = is_late(days, threshold, unpaid_days)
    month = F.when(F.col("instalment_no") >= 1, F.col("instalment_no"))
    return installments.groupBy(*KEYS).agg(
        F.max("due_day").alias("max_day"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(late).alias("n_late"),
        F.count_if(is_late(days)).alias("n_overdue"),
        F.max(days).alias("max_late"),
        F.sum(days).alias("sum_late"),
        F.count(days).alias("n_paid"),
        F.max(month).alias("last_month"),
        F.min(F.when(late, month)).alias("first_late_month"),
    )


def _durations(last_month: Column, first_late: Column, horizon: int) -> list[Column]:
    observed = F.least(last_month, F.lit(horizon))
    happened = F.coalesce(first_late <= observed, F.lit(False))
    return [
        F.when(happened, first_late).otherwise(observed).cast("int").alias("duration"),
        happened.cast("int").alias("event"),
    ]


def latest_loan(installments: DataFrame) -> DataFrame:
    """borrower_id, loan_id of each borrower's most recent loan."""
    per_loan = installments.groupBy(*KEYS).agg(F.max("due_day").alias("max_day"))
    return per_loan.groupBy("borrower_id").agg(F.max(recency()).alias("r")).select("borrower_id", "r.loan_id")


def keep_most_recent_loan(installments: DataFrame) -> DataFrame:
    return installments.join(latest_loan(installments), KEYS, "left_semi")


def other_loans_only(installments: DataFrame) -> DataFrame:
    return installments.join(latest_loan(installments), KEYS, "left_anti")


def latest_loan_rank(installments: DataFrame) -> DataFrame:
    """Every (borrower, loan) with its recency rank, 1 being the latest."""
    per_loan = installments.groupBy(*KEYS).agg(F.max("due_day").alias("max_day"))
    # Falls with recency, unknown days first: numbering runs over (borrower, period), not borrowers.
    period = F.coalesce(-F.floor(F.col("max_day") / 30), F.lit(-(1 << 40)))
    order = [F.col("max_day").desc_nulls_first(), F.col("loan_id").desc()]
    ranked = numbered_within(per_loan.withColumn("_period", period), ["borrower_id"], "_period", order, "loan_rank")
    return ranked.select(*KEYS, "max_day", "loan_rank")


def monthly_worst(installments: DataFrame, unpaid_days: int = K.UNPAID_DAYS_LATE) -> DataFrame:
    late = F.coalesce(days_late(F.col("due_day"), F.col("paid_day")), F.lit(unpaid_days))
    return (
        installments.where(F.col("instalment_no") >= 1)
        .groupBy("borrower_id", F.col("instalment_no").alias("month"))
        .agg(F.max(late).alias("days_late"))
    )


def loan_durations(
    installments: DataFrame,
    threshold: int = K.EVENT_DAYS_LATE,
    horizon: int = K.HORIZON_MONTHS,
    unpaid_days: int = K.UNPAID_DAYS_LATE,
) -> DataFrame:
    """(duration, event) per borrower over the rows given; months below 1 do not count."""
    late = is_late(days_late(F.col("due_day"), F.col("paid_day")), threshold, unpaid_days)
    per = (
        installments.where(F.col("instalment_no") >= 1)
        .groupBy("borrower_id")
        .agg(
            F.max("instalment_no").alias("last_month"),
            F.min(F.when(late, F.col("instalment_no"))).alias("first_late_month"),
        )
    )
    return per.select("borrower_id", *_durations(F.col("last_month"), F.col("first_late_month"), horizon))


def recent_loan_durations(installments: DataFrame, horizon: int = K.HORIZON_MONTHS) -> DataFrame:
    """loan_durations of the most recent loan, without joining back to the installments."""
    latest = (
        loan_summary(installments)
        .groupBy("borrower_id")
        .agg(F.max_by(F.struct("loan_id", "last_month", "first_late_month"), recency()).alias("s"))
        .where(F.col("s.last_month").isNotNull())
    )
    return latest.select(
        "borrower_id", *_durations(F.col("s.last_month"), F.col("s.first_late_month"), horizon)
    )


def prior_loan_behavior(installments: DataFrame) -> DataFrame:
    """Late rate and row count over every loan but the latest; borrowers without any have no row."""
    per = loan_summary(installments).groupBy("borrower_id").agg(
        F.sum("n_rows").alias("n"),
        F.sum("n_late").alias("late"),
        F.max_by(F.struct("n_rows", "n_late"), recency()).alias("s"),
    )
    n = F.col("n") - F.col("s.n_rows")
    return per.where(n > 0).select(
        "borrower_id",
        ((F.col("late") - F.col("s.n_late")) / n).alias("prior_late_rate"),
        n.alias("prior_n_installments"),
    )


def borrower_history(installments: DataFrame, horizon: int = K.HORIZON_MONTHS) -> DataFrame:
    """Everything the installments say about a borrower, from one scan and one large exchange:

    duration and event of the latest loan (null when it has no month ≥ 1), behaviour on the other
    loans (null without any), and the installment features over all loans.
    """
    per = loan_summary(installments).groupBy("borrower_id").agg(
        F.sum("n_rows").alias("n_installments"),
        F.sum("n_late").alias("late"),
        F.sum("n_overdue").alias("overdue"),
        F.max("max_late").alias("max_late"),
        F.try_divide(F.sum("sum_late"), F.sum("n_paid")).alias("avg_days_late"),
        F.max_by(F.struct("n_rows", "n_late", "last_month", "first_late_month"), recency()).alias("s"),
    )
    others = F.col("n_installments") - F.col("s.n_rows")
    duration, event = _durations(F.col("s.last_month"), F.col("s.first_late_month"), horizon)
    seen = F.col("s.last_month").isNotNull()
    return per.select(
        "borrower_id",
        F.when(seen, duration).alias("duration"),
        F.when(seen, event).alias("event"),
        F.when(others > 0, (F.col("late") - F.col("s.n_late")) / others).alias("prior_late_rate"),
        F.when(others > 0, others).alias("prior_n_installments"),
        "n_installments",
        (F.col("overdue") / F.col("n_installments")).alias("late_installment_rate"),
        clip(F.col("max_late"), 0, None).alias("max_days_late"),
        "avg_days_late",
    )


def expand_person_period(durations: DataFrame) -> DataFrame:
    """One row per loan-month survived; the event sits on the last row only."""
    months = F.explode(F.sequence(F.lit(1), F.col("duration")))
    keep = [c for c in durations.columns if c not in ("duration", "event")]
    rows = durations.select(*keep, "duration", F.col("event").alias("_e"), months.alias("months_since_origination"))
    event = ((F.col("months_since_origination") == F.col("duration")) & (F.col("_e") == 1)).cast("int")
    return rows.select(*keep, "months_since_origination", event.alias("event"))


def build_person_period_panel(installments: DataFrame) -> DataFrame:
    return expand_person_period(recent_loan_durations(installments))


def panel_durations(panel: DataFrame) -> DataFrame:
    return panel.groupBy("borrower_id").agg(
        F.max("months_since_origination").alias("duration"), F.max("event").alias("event")
    )


def life_table_hazard(panel: DataFrame, segments: list[str]) -> DataFrame:
    """Events over loans at risk, per segment and month."""
    return panel.groupBy(*segments, "months_since_origination").agg(
        F.count(F.lit(1)).alias("at_risk"),
        F.sum("event").alias("events"),
        F.avg("event").alias("hazard"),
    )


def life_table_from_durations(durations: DataFrame, segments: list[str], weight: str | None = None) -> DataFrame:
    """The same life table from one row per loan: the rows are aggregated before being expanded.

    `weight` names a count column when rows already stand for groups of equal loans.
    """
    loans = F.lit(1) if weight is None else F.col(weight)
    exits = durations.groupBy(*segments, "duration").agg(
        F.sum(loans).alias("n"), F.sum(F.col("event") * loans).alias("e")
    )
    months = exits.select(
        *segments, "n", "e", "duration",
        F.explode(F.sequence(F.lit(1), F.col("duration"))).alias("months_since_origination"),
    )
    ended = F.when(F.col("months_since_origination") == F.col("duration"), F.col("e")).otherwise(0)
    return months.groupBy(*segments, "months_since_origination").agg(
        F.sum("n").alias("at_risk"), F.sum(ended).alias("events"), (F.sum(ended) / F.sum("n")).alias("hazard")
    )


def segment_curves(life_table: DataFrame, segments: list[str]) -> DataFrame:
    """Ordered hazard array per segment, at most `horizon` long."""
    points = F.array_sort(F.collect_list(F.struct("months_since_origination", "hazard")))
    return life_table.groupBy(*segments).agg(F.transform(points, lambda p: p["hazard"]).alias("hazard_curve"))


def score_grid(loans: DataFrame, horizon: int = K.HORIZON_MONTHS) -> DataFrame:
    """Every loan for months 1..horizon."""
    return loans.withColumn("months_since_origination", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
