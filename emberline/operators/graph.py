"""Firm × counterparty features from an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.operators.ordered import average_rank


def edge_build(rows: DataFrame, places: int | None = None) -> DataFrame:
    """One row per firm and counterparty; a repeated pair is one relationship."""
    total = F.sum("txn_value")
    total = total if places is None else F.round(total, places)
    return rows.groupBy("firm_id", "counterparty_id").agg(total.alias("txn_value"))


def firm_profile(edges: DataFrame) -> DataFrame:
    """Degree, concentration and top counterparty (smallest id among equals) in one aggregation."""
    best = F.struct("txn_value", (-F.col("counterparty_id")).alias("negated"))
    per = edges.groupBy("firm_id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("txn_value").alias("total_value"), F.max(best).alias("top")
    )
    return per.select(
        "firm_id",
        "degree",
        "total_value",
        F.col("top.txn_value").alias("top_value"),
        (-F.col("top.negated")).alias("top_counterparty"),
        F.try_divide(F.col("top.txn_value"), F.col("total_value")).alias("counterparty_concentration"),
    )


def top_counterparty(edges: DataFrame) -> DataFrame:
    return firm_profile(edges).select("firm_id", F.col("top_counterparty").alias("counterparty_id"), "top_value")


def node_count(edges: DataFrame):
    """Distinct firms plus distinct counterparties, as a scalar column."""
    firms = edges.select("firm_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    counterparties = edges.select("counterparty_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return firms + counterparties


def degree_centrality(edges: DataFrame) -> DataFrame:
    degree = edges.groupBy("firm_id").agg(F.count(F.lit(1)).alias("degree"))
    return degree.select("firm_id", "degree", (F.col("degree") / (node_count(edges) - 1)).alias("degree_centrality"))


def counterparty_volume_rank(edges: DataFrame) -> DataFrame:
    volumes = edges.groupBy("counterparty_id").agg(F.sum("txn_value").alias("volume"))
    return average_rank(volumes, "volume", "volume_pct")


def anchor_linkage(edges: DataFrame, percentile: float = K.ANCHOR_PERCENTILE) -> DataFrame:
    """Is the firm's top counterparty itself large?"""
    ranks = counterparty_volume_rank(edges).select("counterparty_id", "volume_pct")
    flag = F.coalesce(F.col("volume_pct") > percentile, F.lit(False)).cast("int")
    return top_counterparty(edges).join(ranks, "counterparty_id", "left").select(
        "firm_id", "counterparty_id", "volume_pct", flag.alias("anchor_linkage_flag")
    )


def graph_features(edges: DataFrame, percentile: float = K.ANCHOR_PERCENTILE) -> DataFrame:
    """Concentration, degree centrality and anchor flag per firm; the edges are aggregated once per key."""
    ranks = counterparty_volume_rank(edges).select(F.col("counterparty_id").alias("top_counterparty"), "volume_pct")
    profile = firm_profile(edges).join(ranks, "top_counterparty", "left")
    return profile.select(
        F.col("firm_id").alias("borrower_id"),
        "counterparty_concentration",
        (F.col("degree") / (node_count(edges) - 1)).alias("degree_centrality"),
        F.coalesce(F.col("volume_pct") > percentile, F.lit(False)).cast("int").alias("anchor_linkage_flag"),
    )


def network_churn(rows: DataFrame) -> DataFrame:
    """Per firm and active month: share of the previous active month's counterparties not seen again.

    No set is collected: a (firm, counterparty, month) row is kept when its counterparty's next
    month is the firm's next active month.
    """
    seen = rows.select("firm_id", "counterparty_id", "month_no").distinct()
    by_pair = W.partitionBy("firm_id", "counterparty_id").orderBy("month_no")
    linked = seen.withColumn("pair_next", F.lead("month_no").over(by_pair))
    # A firm has at most as many rows here as there are months.
    months = seen.select("firm_id", "month_no").distinct()
    by_firm = W.partitionBy("firm_id").orderBy("month_no")
    calendar = months.withColumn("firm_next", F.lead("month_no").over(by_firm)).where(F.col("firm_next").isNotNull())
    # Combine before joining, so a firm with very many counterparties joins as a few rows.
    per_month = linked.groupBy("firm_id", "month_no", "pair_next").agg(F.count(F.lit(1)).alias("n"))
    joined = per_month.join(calendar, ["firm_id", "month_no"])
    return joined.groupBy("firm_id", F.col("firm_next").alias("month_no")).agg(
        F.sum("n").alias("previous_size"),
        (1 - F.sum(F.when(F.col("pair_next") == F.col("firm_next"), F.col("n")).otherwise(0)) / F.sum("n")).alias("churn"),
    )


def degree_check(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees from the edge table against degrees counted from the transactions."""
    counted = rows.groupBy("firm_id").agg(F.count_distinct("counterparty_id").alias("counted"))
    degree = edges.groupBy("firm_id").agg(F.count(F.lit(1)).alias("degree"))
    both = degree.join(counted, "firm_id", "full")
    return both.agg(
        F.count(F.lit(1)).alias("firms_checked"),
        F.count_if(~F.col("degree").eqNullSafe(F.col("counted"))).alias("mismatches"),
    )
