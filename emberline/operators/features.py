"""Segments and structured features, one row per borrower."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.scalar import (
    clip,
    days_late,
    days_to_years,
    is_late,
    map_loan_type,
    map_sector,
    safe_ratio,
    tenure_years,
)


def with_segments(applications: DataFrame) -> DataFrame:
    return applications.withColumns(
        {
            "loan_type_segment": map_loan_type(F.col("contract_type")),
            "sector_segment": map_sector(F.col("organization_type")),
        }
    )


def data_richness(
    applications: DataFrame, bureau: DataFrame, min_records: int = K.MIN_BUREAU_RECORDS
) -> DataFrame:
    counts = bureau.groupBy("borrower_id").agg(F.count(F.lit(1)).alias("bureau_record_count"))
    joined = applications.join(counts, "borrower_id", "left").na.fill(0, ["bureau_record_count"])
    richness = F.when(F.col("bureau_record_count") >= min_records, K.ESTABLISHED).otherwise(K.THIN_FILE)
    return joined.withColumn("data_richness", richness)


def installment_features(installments: DataFrame) -> DataFrame:
    late = days_late(F.col("due_day"), F.col("paid_day"))
    return installments.groupBy("borrower_id").agg(
        F.count(F.lit(1)).alias("n_installments"),
        F.avg(is_late(late).cast("int")).alias("late_installment_rate"),
        clip(F.max(late), 0, None).alias("max_days_late"),
        F.avg(late).alias("avg_days_late"),
    )


def bureau_features(bureau: DataFrame) -> DataFrame:
    overdue = F.coalesce(F.col("credit_day_overdue") > 0, F.lit(False))
    return bureau.groupBy("borrower_id").agg(
        F.count_if(F.col("credit_active") == "Active").alias("bureau_active_count"),
        F.max(overdue.cast("int")).alias("bureau_overdue_flag"),
    )


def bureau_profile(bureau: DataFrame) -> DataFrame:
    """Record count and bureau features together, so the table is read once."""
    overdue = F.coalesce(F.col("credit_day_overdue") > 0, F.lit(False))
    return bureau.groupBy("borrower_id").agg(
        F.count(F.lit(1)).alias("bureau_record_count"),
        F.count_if(F.col("credit_active") == "Active").alias("bureau_active_count"),
        F.max(overdue.cast("int")).alias("bureau_overdue_flag"),
    )


def ratio_columns() -> dict:
    return {
        "credit_income_ratio": safe_ratio(F.col("credit"), F.col("income")),
        "annuity_income_ratio": safe_ratio(F.col("annuity"), F.col("income")),
    }


def applicant_columns() -> dict:
    return {
        "age_years": days_to_years(F.col("days_birth")),
        "employed_years": tenure_years(F.col("days_employed")),
    }


def fill_defaults(df: DataFrame, defaults: Mapping[str, float] = K.FEATURE_DEFAULTS) -> DataFrame:
    return df.na.fill({c: v for c, v in defaults.items() if c in df.columns})


FEATURE_COLUMNS = (
    "borrower_id",
    "target",
    "loan_type_segment",
    "sector_segment",
    "data_richness",
    "credit_income_ratio",
    "annuity_income_ratio",
    "ext_source_1",
    "ext_source_2",
    "ext_source_3",
    "age_years",
    "employed_years",
    "bureau_active_count",
    "bureau_overdue_flag",
    "n_installments",
    "late_installment_rate",
    "max_days_late",
    "avg_days_late",
)


def assemble_features(
    applications: DataFrame,
    bureau: DataFrame,
    installment_profile: DataFrame,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Applications with segments, ratios and the joined aggregates; one row per borrower.

    `installment_profile` is one row per borrower: `installment_features`, or the wider
    `borrower_history`, whose further columns are kept without defaults. Both joined sides are
    already aggregated to the borrower key, so each join reuses that partitioning.
    """
    base = with_segments(applications).withColumns({**ratio_columns(), **applicant_columns()})
    joined = base.join(bureau_profile(bureau), "borrower_id", "left")
    joined = joined.join(installment_profile, "borrower_id", "left")
    richness = F.when(F.col("bureau_record_count") >= K.MIN_BUREAU_RECORDS, K.ESTABLISHED)
    joined = joined.withColumn("data_richness", richness.otherwise(K.THIN_FILE))
    further = [c for c in installment_profile.columns if c not in FEATURE_COLUMNS]
    return fill_defaults(joined.select(*FEATURE_COLUMNS, *keep, *further))


def panel_join_features(panel: DataFrame, features: DataFrame) -> DataFrame:
    return panel.join(features, "borrower_id")


def enrich_join(features: DataFrame, graph: DataFrame, text: DataFrame) -> DataFrame:
    """Features with graph and text columns; the two provenance columns are kept apart."""
    graph = graph.withColumnRenamed("data_provenance", "graph_data_provenance")
    text = text.withColumnRenamed("data_provenance", "text_data_provenance")
    return features.join(graph.join(text, "borrower_id"), "borrower_id", "left")


def segment_crosstab(segmented: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of row × column with an `All` margin on both sides."""
    cells = segmented.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    cube = cells.cube(row, column).agg(F.sum("n").alias("n"), F.grouping(row).alias("gr"), F.grouping(column).alias("gc"))
    named = cube.select(
        F.when(F.col("gr") == 1, "All").otherwise(F.col(row)).alias(row),
        F.when(F.col("gc") == 1, "All").otherwise(F.col(column)).alias(column),
        "n",
    )
    return named.groupBy(row).pivot(column, [*values, "All"]).agg(F.sum("n")).na.fill(0)


def segment_counts(segmented: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, n) for every dimension from one scan."""
    combined = segmented.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(
        F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])
    )
    return (
        combined.select("n", pairs.alias("p"))
        .groupBy("p.dimension", "p.value")
        .agg(F.sum("n").alias("n"))
    )


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column. Each becomes a column of its own where wide one-hot columns are asked for."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    )
    found = df.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull()).distinct().collect()
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in found:
        levels[row["c"]].append(row["v"])
    return {c: sorted(v) for c, v in levels.items()}
