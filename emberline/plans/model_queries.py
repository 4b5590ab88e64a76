"""Queries that fit models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions import scalar as S
from emberline.operators import boosting as bo
from emberline.operators import features as feat
from emberline.operators import graph as gr
from emberline.operators import metrics as met
from emberline.operators import models as mod
from emberline.operators import panel as pan
from emberline.operators import split as sp
from emberline.operators import woe
from emberline.plans import frames
from emberline.plans.book_queries import rounded
from emberline.plans.insight_queries import described
from emberline.plans.registry import query
from emberline.plans.sqlviews import sql
from emberline.session import cut_lineage, ensure_checkpoint_dir
from emberline.sources import views

STATIC = list(K.CORE_FEATURES)
SCORECARD = ["credit_income_ratio", "ext_source_2", "age_years", "employed_years", "bureau_overdue_flag", "late_installment_rate"]

#: Rows of the training window that attributions are measured against.
BACKGROUND_ROWS = 32


def split_features(spark: SparkSession, d: str) -> DataFrame:
    """Feature table with the ordered split, written once because fitting reads it many times."""
    return cut_lineage(sp.oot_split(frames.feature_table(spark, d), "borrower_id"))


QUANTITY_SPLITS = [10.0, 20.0, 30.0, 40.0]
BIN = "(l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT + (l_quantity >= 40)::INT"


@query("apply_woe", f"""
SELECT l_quantity, round(ln(((n - e) / (sum_n - sum_e)) / (e / sum_e)), 6) AS quantity_woe, count(*) AS n_rows
FROM (SELECT l_quantity, {BIN} AS b FROM lineitem) x
JOIN (SELECT b, count(*) AS n, sum(y) AS e, sum(count(*)) OVER () AS sum_n, sum(sum(y)) OVER () AS sum_e
      FROM (SELECT {BIN} AS b, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem) r GROUP BY b) w USING (b)
GROUP BY ALL""")
def apply_woe(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    table = woe.fixed_bins(rows, "l_quantity", "y", QUANTITY_SPLITS)
    coded = rounded(woe.apply_woe(rows, {"l_quantity": table}), "l_quantity_woe")
    return coded.groupBy("l_quantity", F.col("l_quantity_woe").alias("quantity_woe")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("bin_event_rates", f"SELECT {BIN} AS bin, count(*) AS n, round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS event_rate FROM lineitem GROUP BY 1")
def bin_event_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    number = sum((F.col("l_quantity") >= s).cast("int") for s in QUANTITY_SPLITS)
    return rounded(woe.bin_event_rates(rows, number, "y"), "event_rate")


@query("is_monotonic", f"""SELECT l_linestatus, bool_and(step >= 0) OR bool_and(step <= 0) AS monotonic FROM (
  SELECT l_linestatus, r - lag(r) OVER (PARTITION BY l_linestatus ORDER BY b) AS step FROM (
    SELECT l_linestatus, {BIN} AS b, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS r FROM lineitem GROUP BY 1, 2) x) y GROUP BY 1""")
def is_monotonic(spark: SparkSession, d: str) -> DataFrame:
    number = sum((F.col("l_quantity") >= s).cast("int") for s in QUANTITY_SPLITS)
    rows = views.table(spark, d, "lineitem").select("l_linestatus", number.alias("bin"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    rates = rows.groupBy("l_linestatus", "bin").agg(F.avg("y").alias("event_rate"))
    return woe.is_monotonic(rates, ["l_linestatus"])


@query("fit_woe")
def fit_woe(spark: SparkSession, d: str) -> DataFrame:
    train = split_features(spark, d).where(F.col("split") == "train")
    return woe.woe_frame(spark, woe.fit_woe(train, SCORECARD, "target"))


@query("fit_scorecard")
def fit_scorecard(spark: SparkSession, d: str) -> DataFrame:
    scored, _, _ = mod.fit_scorecard(split_features(spark, d), SCORECARD, "target")
    return met.metric_table(scored.where(F.col("split") == "test"), "target", {"woe_logistic": "baseline_pd"})


@query("fit_hazard")
def fit_hazard(spark: SparkSession, d: str) -> DataFrame:
    """The linear hazard, whose scoring is a projection, and boosted trees on the panel with segments."""
    data = split_features(spark, d).where(F.col("duration").isNotNull())
    panel = cut_lineage(pan.expand_person_period(data.select("borrower_id", "split", "duration", "event", *STATIC, *K.SEGMENT_COLUMNS)))
    scorer = mod.fit_hazard(panel, STATIC)
    trees = mod.fit_tree_hazard(panel, STATIC)
    scored = mod.tree_cumulative(frames.score(data.where(F.col("split") == "test"), scorer), trees, "trees_pd")
    known = scored.where(S.evaluable(F.col("event"), F.col("duration")))
    return met.metric_table(known, "event", {"hazard_12m": "pd", "hazard_trees_12m": "trees_pd"})


@query("fit_loan_classifier")
def fit_loan_classifier(spark: SparkSession, d: str) -> DataFrame:
    scored, _ = mod.fit_loan_classifier(split_features(spark, d), STATIC, "target")
    return met.metric_table(scored.where(F.col("split") == "test"), "target", {"boosted_trees": "classifier_pd"})


@query("fit_segment_model")
def fit_segment_model(spark: SparkSession, d: str) -> DataFrame:
    thin = frames.feature_table(spark, d).where(F.col("data_richness") == K.THIN_FILE)
    data = cut_lineage(sp.oot_split(thin, "borrower_id"))
    return mod.fit_segment_model(data, STATIC, "target")


@query("tree_attributions")
def tree_attributions(spark: SparkSession, d: str) -> DataFrame:
    data = split_features(spark, d)
    _, model = mod.fit_loan_classifier(data, STATIC, "target")
    # A sample of bounded size stands for the book, as many rows as the reference takes.
    names = [*STATIC, *K.SEGMENT_COLUMNS]
    sample = sp.deterministic_sample(data.where(F.col("split") == "train").select("borrower_id", *names), "borrower_id", BACKGROUND_ROWS, 0)
    rows = bo.attributions(data, "borrower_id", model, sample.orderBy("borrower_id").toPandas())
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("contribution")), 6).alias("mean_size"))


GRAPH = ["counterparty_concentration", "degree_centrality", "anchor_linkage_flag"]


def fused_features(spark: SparkSession, d: str) -> DataFrame:
    """Structured features with the graph and text columns of the borrowers that have any, others null; with the split."""
    graph = gr.graph_features(cut_lineage(gr.edge_build(views.edge_rows(spark, d), places=4)))
    text = described(spark, d)
    whole = feat.enrich_join(frames.feature_table(spark, d), S.tag_provenance(graph, "transaction_graph"), S.tag_provenance(text, "documents"))
    return cut_lineage(sp.oot_split(whole, "borrower_id"))


@query("fused_ablation")
def fused_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Structured trees against structured, graph and text trees, fitted on the same split, on the same test rows."""
    data = fused_features(spark, d)
    text = [c for c in data.columns if c.startswith("text_pc_")] + ["sentiment_signed", "distress_keyword_flag"]
    arms = {"structured": (STATIC, K.SEGMENT_COLUMNS), "fused": ([*STATIC, *GRAPH, *text], K.SEGMENT_COLUMNS)}
    scored, _ = mod.fit_arms(data, arms, "target")
    scored = cut_lineage(scored.select("borrower_id", "target", *arms))
    compared = met.paired_auc(scored, "borrower_id", "target", "structured", "fused")
    rows = met.metrics_row(met.long_scores(scored, "target", {n: n for n in arms}), "label", "score", ["model"])
    return met.ablation_delta(met.to_long(rows), "structured", "fused").join(
        compared.select(F.lit("auc_roc").alias("metric"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high")), "metric", "left"
    )


def outcome(spark: SparkSession, result: dict | None, status: int | None = None) -> DataFrame:
    gate = result or {}
    auc = (gate.get("challenger_metrics") or {}).get("auc_roc")
    row = (status, gate.get("promoted"), gate.get("reason"), gate.get("registered_version"), auc)
    return spark.createDataFrame([row], "status int, promoted boolean, reason string, version int, challenger_auc double")


@query("retrain_and_gate")
def retrain_and_gate(spark: SparkSession, d: str) -> DataFrame:
    """A challenger for an empty registry, with segments; it is registered as the first version."""
    where = f"{ensure_checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    return outcome(spark, mod.retrain_and_gate(split_features(spark, d), STATIC, "target", where, categories=K.SEGMENT_COLUMNS))


@query("drift_triggered_retrain")
def drift_triggered_retrain(spark: SparkSession, d: str) -> DataFrame:
    """Drift of the test window against the others, and the gated retrain if it triggers."""
    where = f"{ensure_checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    data = split_features(spark, d)
    found = mod.drift_triggered_retrain(data, F.col("split") == "test", data, STATIC, "target", where, categories=K.SEGMENT_COLUMNS)
    return outcome(spark, found["gate"], found["status"])


SEGMENT_LEVELS = {
    "loan_type_segment": ("other_proxy", "term_loan_proxy", "working_capital_proxy"),
    "sector_segment": ("Agriculture_Allied", "Manufacturing", "Other_Public", "Retail_Trade", "Services_IT"),
    "data_richness": (K.ESTABLISHED, K.THIN_FILE),
}
MATRIX_SQL = ", ".join(
    [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in STATIC]
    + [f"CAST({c} = '{v}' AS INTEGER) AS \"{c}_{v}\"" for c, vs in SEGMENT_LEVELS.items() for v in vs]
)


@query("training_matrix", sql(f"SELECT borrower_id, {MATRIX_SQL} FROM feats", "feats"))
def training_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Training matrix: numeric features with one-hot segments, in training column order."""
    rows = frames.feature_table(spark, d)
    levels = feat.category_levels(rows.select(*K.SEGMENT_COLUMNS), K.SEGMENT_COLUMNS)
    wide = S.one_hot(rows, levels)
    columns = [*STATIC, *[f"{c}_{v}" for c, vs in levels.items() for v in vs]]
    return rounded(S.align_columns(wide, columns, keep=["borrower_id"]), *STATIC)
