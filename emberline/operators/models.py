"""Distributed training, and what turns a fitted model back into columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.scorer import LinearHazard
from emberline.operators import boosting as bo
from emberline.operators import drift as dr
from emberline.operators import journal as jr
from emberline.operators.metrics import METRICS, long_scores, metrics_row
from emberline.operators.woe import WoeTable, apply_woe, fit_woe

FUSED = "fused"
#: Most boosting rounds, those of a segment's small model, and rounds without better calib figures after which they stop.
ROUNDS, SEGMENT_ROUNDS, PATIENCE = 1000, 300, 50


def feature_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    return {f: float(row[f] or 0.0) for f in features}


def missing_flags(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """<feature>_missing columns: MLlib takes no missing values, so their absence becomes a feature."""
    return df.withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in features})


def filled(df: DataFrame, features: Sequence[str], means: dict[str, float]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(means.get(f, 0.0))) for f in features})


def probability(vector: str = "probability") -> Column:
    return vector_to_array(F.col(vector))[1]


def class_weights(df: DataFrame, label: str) -> Column:
    """Balanced weights n / (2 · n_class)."""
    row = df.agg(F.count(label).alias("n"), F.sum(F.col(label).cast("double")).alias("pos")).first()
    n, pos = row["n"], row["pos"] or 0.0
    positive, negative = n / (2.0 * max(pos, 1.0)), n / (2.0 * max(n - pos, 1.0))
    return F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(negative))


def fit_scorecard(
    df: DataFrame, features: Sequence[str], label: str, c: float = 1.0
) -> tuple[DataFrame, dict[str, WoeTable], object]:
    """L2 logistic on WOE columns with balanced classes, fitted on split = train; every row scored."""
    train = df.where(F.col("split") == "train")
    tables = fit_woe(train, features, label)
    columns = [f"{f}_woe" for f in features]
    coded = VectorAssembler(inputCols=columns, outputCol="_x").transform(apply_woe(df, tables))
    training = coded.where(F.col("split") == "train")
    weighted = training.withColumn("_w", class_weights(training, label))
    # Balanced weights add up to the number of rows.
    rows = weighted.count()
    model = LogisticRegression(
        featuresCol="_x", labelCol=label, weightCol="_w", regParam=1.0 / (c * max(rows, 1)), standardization=False,
        maxIter=200, tol=1e-8,
    ).fit(weighted)
    scored = model.transform(coded).withColumn("baseline_pd", probability())
    return scored.drop("_x", "rawPrediction", "probability", "prediction", *columns), tables, model


def fit_hazard(
    panel: DataFrame, features: Sequence[str], event: str = "event", month: str = "months_since_origination"
) -> LinearHazard:
    """Discrete-time hazard by logistic regression with one effect per month, without class weights.

    The fitted coefficients become a LinearHazard, so scoring is a projection.
    """
    train = panel.where(F.col("split") == "train") if "split" in panel.columns else panel
    means = feature_means(train, features)
    # The optimiser passes over the rows many times, so they are prepared and held once.
    centred = [(F.coalesce(F.col(f).cast("double") - means[f], F.lit(0.0))).alias(f) for f in features]
    months = [(F.col(month) == m).cast("double").alias(f"_m{m}") for m in range(2, K.HORIZON_MONTHS + 1)]
    rows = train.select(F.col(event).cast("double").alias("label"), *centred, *months)
    columns = [*features, *[f"_m{m}" for m in range(2, K.HORIZON_MONTHS + 1)]]
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select("label", "features").persist()
    try:
        model = LogisticRegression(maxIter=100, regParam=1e-6).fit(vectors)
    finally:
        vectors.unpersist()
    weights = [float(v) for v in model.coefficients]
    return LinearHazard(
        intercept=float(model.intercept),
        coefficients=dict(zip(features, weights[: len(features)], strict=True)),
        means=means,
        month_effects=(0.0, *weights[len(features) :]),
    )


def assemble(df: DataFrame, features: Sequence[str], means: dict[str, float], output: str = "_x") -> DataFrame:
    """Feature vector of a linear model, with means for missing values and a flag for each feature that had any."""
    complete = filled(missing_flags(df, features), features, means)
    columns = [*features, *[f"{f}_missing" for f in features]]
    return VectorAssembler(inputCols=columns, outputCol=output).transform(complete)


def fit_tree_hazard(
    panel: DataFrame, features: Sequence[str], categories: Sequence[str] = K.SEGMENT_COLUMNS, event: str = "event",
    month: str = "months_since_origination", iterations: int = ROUNDS, patience: int = PATIENCE, start: bo.Boosted | None = None,
) -> bo.Boosted:
    """Discrete-time hazard by boosted trees on person-periods: numeric features and the month as they are, missing
    values unfilled, segments as levels. No class weights, so the chances are hazards; stops on split = calib."""
    return bo.boost(panel, [*features, month], categories, event, iterations, patience=patience, weighted=False, start=start)


def tree_cumulative(df: DataFrame, model: bo.Boosted, name: str, month: str = "months_since_origination", horizon: int = K.HORIZON_MONTHS) -> DataFrame:
    """`df` of loans with the chance of the event within the horizon, months filled in by code."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def within(frame: pd.DataFrame) -> pd.Series:
        model, at = shared.value, shared.value.numeric.index(month)
        codes = model.codes(frame.assign(**{month: 1.0}))
        survival = np.ones(len(frame))
        for m in range(1, horizon + 1):
            codes[:, at] = np.searchsorted(model.edges[month], float(m), side="left") + 1
            survival *= 1 - bo.chance(model.margins(codes))
        return pd.Series(1 - survival)

    columns = [F.col(c).cast("double").alias(c) for c in model.numeric if c != month] + [F.col(c).cast("string").alias(c) for c in model.categories]
    return df.withColumn(name, within(F.struct(*columns)))


def fit_loan_classifier(
    df: DataFrame, features: Sequence[str], label: str, iterations: int = ROUNDS, categories: Sequence[str] = K.SEGMENT_COLUMNS, patience: int = PATIENCE
) -> tuple[DataFrame, bo.Boosted]:
    """Loan-level boosted trees with a positive-class weight: (scored rows, model)."""
    model = bo.boost(df, features, categories, label, iterations, patience=patience)
    return bo.scored(df, model, "classifier_pd"), model


def fit_segment_model(df: DataFrame, features: Sequence[str], label: str, iterations: int = SEGMENT_ROUNDS, patience: int = PATIENCE) -> DataFrame:
    """The segment's own low-capacity models, fitted on train and compared on the same ordered test rows."""
    train = df.where(F.col("split") == "train")
    means = feature_means(train, features)
    vectors = assemble(df, features, means)
    linear = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.05, maxIter=100).fit(vectors.where(F.col("split") == "train"))
    trees = bo.boost(df, features, (), label, iterations, depth=3, patience=patience, weighted=False)
    test = linear.transform(vectors.where(F.col("split") == "test")).withColumn("linear_pd", probability()).drop("rawPrediction", "probability", "prediction")
    # The vectors' columns were filled for the linear arm; the trees read the table's own.
    keys = test.select("borrower_id", "linear_pd")
    both = bo.scored(df.where(F.col("split") == "test"), trees, "trees_pd").join(keys, "borrower_id")
    arms = long_scores(both, label, {"segment_linear": "linear_pd", "small_trees": "trees_pd"})
    return metrics_row(arms, "label", "score", ["model"])


def fit_arms(
    df: DataFrame, arms: dict[str, tuple[Sequence[str], Sequence[str]]], label: str, iterations: int = ROUNDS, patience: int = PATIENCE
) -> tuple[DataFrame, dict[str, bo.Boosted]]:
    """Boosted trees on the same rows and split for each arm (its numeric features and categories).

    Returns the test rows with a score for each arm, and the models. A block of features that a row lacks is null in
    all its columns; trees learn where missing values go, so no row is left out of an arm.
    """
    models = {name: bo.boost(df, numeric, categories, label, iterations, patience=patience) for name, (numeric, categories) in arms.items()}
    scored = df.where(F.col("split") == "test")
    for name, model in models.items():
        scored = bo.scored(scored, model, name)
    return scored, models


def evaluate(df: DataFrame, label: str, models: dict[str, str]) -> dict[str, dict[str, float]]:
    rows = metrics_row(long_scores(df, label, models), "label", "score", ["model"]).collect()
    return {r["model"]: {m: r[m] for m in METRICS} for r in rows}


def retrain_and_gate(
    data: DataFrame,
    features: Sequence[str],
    label: str,
    folder: str,
    name: str = FUSED,
    iterations: int = ROUNDS,
    depth: int = 4,
    sample_fraction: float | None = None,
    categories: Sequence[str] = (),
    patience: int = PATIENCE,
) -> dict:
    """Train a challenger, compare it with the production model on the same test rows, promote or hold.

    `data` carries `split`. Runs, aliases and models live under `folder`; a hold changes no model.
    """
    spark = data.sparkSession
    training = data
    if sample_fraction is not None and sample_fraction < 1.0:
        kept = F.pmod(F.xxhash64("borrower_id", F.lit(42)), F.lit(1_000_000)) < int(sample_fraction * 1_000_000)
        training = data.where((F.col("split") != "train") | kept)
    model = bo.boost(training, features, categories, label, iterations, depth=depth, patience=patience)
    scored, models = bo.scored(data.where(F.col("split") == "test"), model, "challenger_pd"), {"challenger": "challenger_pd"}
    current = production_path(spark, folder, name)
    if current:
        scored = bo.scored(scored, bo.load(spark, current), "production_pd")
        models["production"] = "production_pd"
    table = evaluate(scored, label, models)
    challenger, production = table["challenger"], table.get("production")
    if production is None:
        promoted, reason = True, "PROMOTED: there is no production model."
    else:
        verdict = spark.range(1).select(
            jr.gate_decision(F.lit(challenger["auc_roc"]), F.lit(production["auc_roc"])).alias("g")
        ).first()["g"]
        promoted, reason = verdict["promoted"], verdict["reason"]
    run_id = jr.log_run(
        spark, f"{folder}/runs", f"retrain_challenger_{name}",
        params={"iterations": iterations, "depth": depth, "sample_fraction": sample_fraction or 1.0},
        metrics=challenger, tags={"gate_decision": "promoted" if promoted else "held", "gate_reason": reason},
    )
    result = {
        "promoted": promoted, "reason": reason, "run_id": run_id,
        "challenger_metrics": challenger, "production_metrics": production,
    }
    if promoted:
        bo.save(spark, model, f"{folder}/models/{run_id}")
        result["registered_version"] = jr.move_alias(spark, f"{folder}/aliases", name, "production", run_id)
    return result


def production_path(spark: SparkSession, folder: str, name: str) -> str | None:
    """Where the model behind the production alias is stored, if there is one."""
    try:
        aliases = spark.read.schema(jr.ALIAS_SCHEMA).parquet(f"{folder}/aliases")
        row = aliases.where((F.col("model") == name) & (F.col("alias") == "production")).agg(
            F.max_by("run_id", "version").alias("r")
        ).first()
    except AnalysisException as error:  # only a table that does not exist yet is expected here
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return f"{folder}/models/{row['r']}" if row and row["r"] else None


def drift_triggered_retrain(
    windows: DataFrame, is_current: Column, data: DataFrame, features: Sequence[str], label: str, folder: str, **options
) -> dict:
    """Drift report, and only if it triggers, the gated retrain. status: 0 steady or promoted, 1 held."""
    summary = dr.drift_summary(dr.drift_report(windows, features, is_current, core=features)).first().asDict()
    if not summary["retrain_triggered"]:
        return {"status": 0, "drift": summary, "gate": None}
    gate = retrain_and_gate(data, features, label, folder, **options)
    return {"status": 0 if gate["promoted"] else 1, "drift": summary, "gate": gate}
