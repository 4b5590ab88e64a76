"""Ranking metrics from one tie-grouped curve; every figure for every model comes from one plan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.operators.ordered import running_totals
from emberline.functions.scalar import clip
from emberline.session import settle

METRICS = ("auc_roc", "ks", "pr_auc", "recall_at_fpr10", "brier")


def score_groups(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """(group, score, pos, neg): rows with the same score become one, before any exchange."""
    y = F.col(label).cast("long")
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*groups, F.col(score).cast("double").alias("score"))
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    )


def roc_curve(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """tpr and fpr after each distinct score, from the highest down."""
    points = score_groups(df, label, score, groups)
    curve = running_totals(points, "score", ["pos", "neg"], groups, descending=True)
    return curve.withColumns(
        {
            "tpr": F.try_divide(F.col("cum_pos"), F.col("total_pos")),
            "fpr": F.try_divide(F.col("cum_neg"), F.col("total_neg")),
        }
    )


def curve_metrics(curve: DataFrame, groups: Sequence[str] = (), max_fpr: float = 0.10) -> DataFrame:
    """Unrounded AUC, KS, step-wise average precision, recall under a false-alarm cap, Brier."""
    p, n = F.max("total_pos"), F.max("total_neg")
    above = F.col("cum_pos") - F.col("pos") / 2.0
    bounded = clip(F.col("score"), 0.0, 1.0)
    return curve.groupBy(*groups).agg(
        F.try_divide(F.sum(above * F.col("neg")), p * n).alias("auc_roc"),
        F.max(F.abs(F.col("tpr") - F.col("fpr"))).alias("ks"),
        F.try_divide(
            F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))), p
        ).alias("pr_auc"),
        F.coalesce(F.max(F.when(F.col("fpr") <= max_fpr, F.col("tpr"))), F.lit(0.0)).alias("recall_at_fpr10"),
        (
            F.sum(F.col("pos") * F.pow(1 - bounded, F.lit(2)) + F.col("neg") * F.pow(bounded, F.lit(2))) / (p + n)
        ).alias("brier"),
    )


def score_buckets(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), buckets: int = 1000) -> DataFrame:
    """(group, bucket, score, pos, neg): rows by score ranges of about equal share, `score` the highest of the range.

    The ends come from mergeable quantile sketches, one for each group, so no score is sorted; rows of one score fall
    into one bucket. A group is a row of the table of ends, which holds `buckets` numbers for it.
    """
    kept = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    keys = [F.col(g).cast("string") for g in groups] or [F.lit("")]
    keyed = kept.select(*groups, F.to_json(F.array(*keys)).alias("_g"), F.col(score).cast("double").alias("_s"), F.col(label).cast("long").alias("_y"))
    shares = [i / buckets for i in range(1, buckets)]
    ends = settle(keyed.groupBy("_g").agg(F.array_distinct(F.percentile_approx("_s", shares, 10 * buckets)).alias("_e")))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.zeros(len(frame), dtype=np.int64)
            for _, rows in frame.groupby("_g", sort=False):
                held = frame.index.get_indexer(rows.index)
                at[held] = np.searchsorted(rows["_e"].iloc[0], rows["_s"].to_numpy(), side="left")
            yield frame.drop(columns="_e").assign(bucket=at)

    joined = keyed.join(ends, "_g").select(*groups, "_g", "_s", "_y", "_e")
    schema = T.StructType([*[f for f in joined.schema.fields if f.name != "_e"], T.StructField("bucket", T.LongType())])
    return joined.mapInPandas(placed, schema).groupBy(*groups, "bucket").agg(
        F.max("_s").alias("score"), F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")
    )


def bucketed_metrics(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), buckets: int = 1000) -> DataFrame:
    """Bounds of AUC and KS from bucketed scores: the true values lie between `_low` and `_high`.

    In a bucket the positives may rank above all its negatives or below. KS is known at the ends of buckets, and inside
    one it cannot pass what remains if one class came first.
    """
    counts = score_buckets(df, label, score, groups, buckets)
    # At most `buckets` rows a group.
    inside = W.partitionBy(*(groups or [F.lit(0)]))
    upto = inside.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, 0)
    lower = inside.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    rows = counts.select(
        *groups, "pos", "neg", F.coalesce(F.sum("neg").over(lower), F.lit(0)).alias("under"),
        F.sum("pos").over(upto).alias("cp"), F.sum("neg").over(upto).alias("cn"), F.sum("pos").over(inside).alias("p"), F.sum("neg").over(inside).alias("n"),
    )
    share = lambda c, whole: F.try_divide(F.col(c), F.col(whole))
    tpr, fpr = share("cp", "p"), share("cn", "n")
    before_t, before_f = F.try_divide(F.col("cp") - F.col("pos"), F.col("p")), F.try_divide(F.col("cn") - F.col("neg"), F.col("n"))
    pairs = F.max(F.col("p") * F.col("n"))
    return rows.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("pos") * F.col("under")), pairs).alias("auc_low"),
        F.try_divide(F.sum(F.col("pos") * (F.col("under") + F.col("neg"))), pairs).alias("auc_high"),
        F.max(F.abs(tpr - fpr)).alias("ks_low"),
        F.max(F.greatest(tpr - before_f, fpr - before_t)).alias("ks_high"),
    )


def metrics_row(
    df: DataFrame, label: str, score: str, groups: Sequence[str] = (), places: int = 4
) -> DataFrame:
    """The five metrics, one row per group."""
    raw = curve_metrics(roc_curve(df, label, score, groups), groups)
    return raw.select(*groups, *[F.round(m, places).alias(m) for m in METRICS])


def naive_row(df: DataFrame, label: str, groups: Sequence[str] = (), places: int = 4) -> DataFrame:
    """What always predicting "no event" scores."""
    rate = F.avg(F.col(label).cast("double"))
    return df.groupBy(*groups).agg(
        F.lit(0.5).alias("auc_roc"),
        F.lit(0.0).alias("ks"),
        F.round(rate, places).alias("pr_auc"),
        F.lit(0.0).alias("recall_at_fpr10"),
        F.round(rate, places).alias("brier"),
        F.round(1 - rate, places).alias("accuracy_for_contrast_only"),
    )


def long_scores(df: DataFrame, label: str, models: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """(model, label, score) rows of several score columns."""
    arms = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in models.items()])
    )
    return df.select(*keep, F.col(label).alias("label"), arms.alias("a")).select(*keep, "label", "a.model", "a.score")


def metric_table(df: DataFrame, label: str, models: dict[str, str]) -> DataFrame:
    """Wide table: one row per model with a naive row for contrast."""
    rows = metrics_row(long_scores(df, label, models), "label", "score", ["model"])
    naive = naive_row(df, label).withColumn("model", F.lit("naive_always_no_default"))
    return rows.unionByName(naive, allowMissingColumns=True)


def to_long(table: DataFrame, key: str = "model") -> DataFrame:
    """model × metric table as (metric, model, value) rows."""
    metrics = [c for c in table.columns if c != key]
    return table.unpivot([key], metrics, "metric", "value")


def ablation_delta(long_table: DataFrame, base: str, other: str) -> DataFrame:
    """Per metric: other − base, from one grouped pass."""
    def of(model: str):
        return F.max(F.when(F.col("model") == model, F.col("value")))

    picked = long_table.groupBy("metric").agg(of(base).alias("base_value"), of(other).alias("other_value"))
    return picked.withColumn("delta", F.round(F.col("other_value") - F.col("base_value"), 4))


#: Replicates of a paired interval, and score buckets of their AUC.
REPLICATES, PAIR_BUCKETS = 100, 2048


def paired_auc(df: DataFrame, key: str, label: str, base: str, other: str, replicates: int = REPLICATES) -> DataFrame:
    """AUC of two scores of the same rows, their difference, and its 95 % interval by a paired bootstrap.

    A row's weight in a replicate is a Poisson draw of mean 1 from a hash of its key, the same for both scores.
    Weights are summed by (replicate, arm, score bucket) before any exchange, so a replicate costs as many rows as there
    are buckets; scores of a bucket count as tied. Replicate 0 has weight 1 for every row.
    """
    number = F.explode(F.sequence(F.lit(0), F.lit(replicates)))
    draw = (F.pmod(F.xxhash64(F.col(key), F.col("_r")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # Inverse of the distribution of a Poisson variable of mean 1.
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    weight = F.when(F.col("_r") == 0, F.lit(1)).otherwise(sum((draw > s).cast("int") for s in steps))
    bucket = lambda c: F.least(F.floor(clip(F.col(c), 0.0, 1.0) * PAIR_BUCKETS), F.lit(PAIR_BUCKETS - 1)).alias("bucket")
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), bucket(c)) for n, c in (("base", base), ("other", other))]))
    rows = df.where(F.col(label).isNotNull() & F.col(base).isNotNull() & F.col(other).isNotNull())
    # Rows that agree in label and both buckets differ by their draws only, so draws come before any grouping.
    drawn = rows.select(key, F.col(label).cast("long").alias("y"), base, other, number.alias("_r")).withColumn("w", weight).where("w > 0")
    sums = drawn.select("_r", "y", "w", arms.alias("a")).groupBy("_r", "a.arm", "a.bucket").agg(
        F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg")
    )
    below = W.partitionBy("_r", "arm").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    won = sums.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    auc = F.try_divide(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc")
    per = won.groupBy("_r", "arm").agg(auc).groupBy("_r").agg(
        F.max(F.when(F.col("arm") == "base", F.col("auc"))).alias("base"), F.max(F.when(F.col("arm") == "other", F.col("auc"))).alias("other")
    ).withColumn("delta", F.col("other") - F.col("base"))
    whole = lambda c: F.max(F.when(F.col("_r") == 0, F.col(c)))
    spread = F.percentile(F.when(F.col("_r") > 0, F.col("delta")), [0.025, 0.975])
    return per.agg(
        whole("base").alias("base_auc"), whole("other").alias("other_auc"), whole("delta").alias("delta"),
        F.get(spread, F.lit(0)).alias("low"), F.get(spread, F.lit(1)).alias("high"),
    )


def separability(df: DataFrame, flag: str, score: str, min_auc: float = 0.80) -> DataFrame:
    """How well one feature alone separates two groups: AUC, means, Cohen's d, counts."""
    auc = metrics_row(df, flag, score).select("auc_roc").scalar()
    yes, no = F.when(F.col(flag) == 1, F.col(score)), F.when(F.col(flag) == 0, F.col(score))
    pooled = F.sqrt((F.var_samp(yes) + F.var_samp(no)) / 2)
    stats = df.agg(
        F.round(F.avg(yes), 4).alias("mean_flagged"),
        F.round(F.avg(no), 4).alias("mean_unflagged"),
        F.round(F.try_divide(F.avg(yes) - F.avg(no), pooled), 4).alias("cohens_d"),
        F.count(yes).alias("n_flagged"),
        F.count(no).alias("n_unflagged"),
    )
    return stats.withColumn("auc", auc).withColumn(
        "separated",
        (F.col("n_flagged") > 0) & (F.col("n_unflagged") > 0) & F.coalesce(F.col("auc") >= min_auc, F.lit(False)),
    )


class SeparabilityError(ValueError):
    """The feature does not tell the groups apart."""


def assert_separable(result: DataFrame) -> DataFrame:
    row = result.first()
    if not row["separated"]:
        raise SeparabilityError(f"groups are not separated: {row.asDict()}")
    return result
