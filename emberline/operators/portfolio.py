"""Book-level reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.grades import ews_fold, expected_loss, high_risk_flag
from emberline.functions.scalar import evaluable
from emberline.operators.ordered import numbered_within
from emberline.session import settle


def grade_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, g, K.GRADE_ACTIONS[g]) for i, g in enumerate(K.GRADES, start=1)]
    return spark.createDataFrame(rows, "grade_no int, risk_grade string, action string")


def loans_in(weight: str | None) -> Column:
    """Loans a group stands for: its rows, or the sum of a column of counts."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def grade_distribution(book: DataFrame, weight: str | None = None) -> DataFrame:
    """Count and share of all seven grades, zero where a grade is empty."""
    counts = book.groupBy("risk_grade").agg(loans_in(weight).alias("n"))
    full = grade_dimension(book.sparkSession).join(counts, "risk_grade", "left").na.fill(0, ["n"])
    # Seven rows, so one window over all of them is fine.
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    return full.select("risk_grade", "n", F.round(F.try_divide(F.col("n"), total), 4).alias("share"))


def portfolio_summary(
    book: DataFrame, dimensions: Sequence[str] = K.SEGMENT_COLUMNS, weight: str | None = None
) -> DataFrame:
    """One row: loans, expected-loss rate, count per grade, counts per segment value.

    `weight` names a count column when rows stand for groups of loans with the same PD.
    """
    loss = expected_loss(F.col("pd")) if weight is None else expected_loss(F.col("pd"), ead=F.col(weight))
    # The few cells carry everything; the book itself is read once.
    cells = book.groupBy("risk_grade", *dimensions).agg(loans_in(weight).alias("n"), F.sum(loss).alias("loss"))
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])
    per_value = (
        cells.select("n", F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.sum("n").alias("n"))
    )
    pieces = F.concat(F.col("dimension"), F.lit("="), F.col("value"), F.lit(":"), F.col("n").cast("string"))
    entries = per_value.agg(F.array_join(F.array_sort(F.collect_list(pieces)), ";").alias("m"))
    totals = cells.agg(
        F.sum("n").alias("n_loans"),
        F.round(F.sum("loss") / F.sum("n"), 5).alias("expected_loss_rate"),
        *[
            F.coalesce(F.sum(F.when(F.col("risk_grade") == g, F.col("n"))), F.lit(0)).alias(f"n_{g}")
            for g in K.GRADES
        ],
    )
    return totals.withColumn("counts_by_segment", entries.scalar())


def unified_grade_table(book: DataFrame, segment: str) -> DataFrame:
    return book.groupBy(segment, "risk_grade").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pd").alias("mean_pd")
    )


def sample_per_grade(book: DataFrame, k: int = 4) -> DataFrame:
    """The k lowest-PD loans of each grade; each task keeps at most k rows per grade."""
    order = W.partitionBy("risk_grade").orderBy("pd", "borrower_id")
    return book.withColumn("rank_in_grade", F.row_number().over(order)).where(F.col("rank_in_grade") <= k)


def near_boundary_loans(book: DataFrame, n: int = 200) -> DataFrame:
    return book.where(high_risk_flag(F.col("risk_grade"))).orderBy("pd", "borrower_id").limit(n)


def riskiest_loan(book: DataFrame) -> DataFrame:
    return book.orderBy(F.col("pd").desc(), "borrower_id").limit(1)


def fairness_audit(book: DataFrame, dimensions: Sequence[str] = K.SEGMENT_COLUMNS) -> DataFrame:
    """Outcome statistics per dimension and group, with the disparity to the lowest-PD group."""
    known = evaluable(F.col("event"), F.col("duration"))
    negative = F.coalesce(known & (F.col("event") == 0), F.lit(False))
    flagged = high_risk_flag(F.col("risk_grade"))
    # First to one row per combination of groups; only those few rows are then fanned out.
    cells = book.groupBy(*dimensions).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pd").alias("pd_sum"),
        F.count("pd").alias("pd_n"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(negative).alias("negatives"),
        F.count_if(negative & flagged).alias("false_positives"),
    )
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group")) for d in dimensions]
    )
    fanned = cells.select("*", F.explode(pairs).alias("p")).where(F.col("p.group").isNotNull())
    groups = fanned.groupBy("p.dimension", "p.group").agg(
        F.sum("n").alias("n"),
        F.round(F.sum("pd_sum") / F.sum("pd_n"), 5).alias("avg_pd"),
        F.round(F.sum("flagged") / F.sum("n"), 5).alias("high_risk_share"),
        F.round(F.try_divide(F.sum("false_positives"), F.sum("negatives")), 5).alias("false_positive_rate"),
    )
    best = F.min("avg_pd").over(W.partitionBy("dimension"))
    ratio = F.col("avg_pd") / F.when(best == 0, F.lit(1e-9)).otherwise(best)
    return groups.withColumn("disparity_ratio", F.round(ratio, 3))


def fairness_flags(audit: DataFrame, threshold: float = K.DISPARITY_FLAG) -> DataFrame:
    return audit.where(F.col("disparity_ratio") > threshold)


def ews_history(observed: DataFrame, key: str, order: str, chunk: int = 64) -> DataFrame:
    """(key, m, state): the early-warning state after every observation (pd, indicator, days_past_due), in order.

    A loan's observations are numbered and cut into chunks. What a chunk does to each of the five states is found on
    its own; chunks are then chained, and each is walked from the state it starts in. `order` is a whole number.
    """
    numbered = numbered_within(observed.withColumn("_era", F.floor(F.col(order) / chunk)), [key], "_era", [order], "m")
    entry = F.struct("m", "pd", "indicator", "days_past_due")
    chunks = settle(numbered.groupBy(key, "_era").agg(F.array_sort(F.collect_list(entry)).alias("o")))
    ends = F.create_map(*[x for s in K.EWS_STATES for x in (F.lit(s), F.element_at(ews_fold(F.col("o"), s), -1))])
    era = F.struct(F.col("_era").alias("era"), F.map_entries(ends).alias("ends"))
    chained = chunks.groupBy(key).agg(F.array_sort(F.collect_list(era)).alias("eras"))
    first = F.array(F.lit(K.EWS_STATES[0]))
    moves = F.aggregate("eras", first, lambda acc, c: F.concat(acc, F.array(F.map_from_entries(c["ends"])[F.element_at(acc, -1)])))
    starts = chained.select(key, F.explode(F.arrays_zip(F.col("eras.era").alias("era"), F.slice(moves, 1, F.size("eras")).alias("state"))).alias("s"))
    begun = chunks.join(starts.select(key, F.col("s.era").alias("_era"), F.col("s.state").alias("_start")), [key, "_era"])
    walked = F.arrays_zip(F.col("o.m").alias("m"), ews_fold(F.col("o"), F.col("_start")).alias("state"))
    return begun.select(key, F.explode(walked).alias("w")).select(key, "w.m", "w.state")
