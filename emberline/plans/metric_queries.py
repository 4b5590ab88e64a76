"""Queries over splits, ranking metrics, calibration, bands and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions import scalar as S
from emberline.operators import calibrate as cal
from emberline.operators import drift as dr
from emberline.operators import metrics as met
from emberline.operators import ordered
from emberline.operators import panel as pan
from emberline.operators import split as sp
from emberline.plans import frames
from emberline.plans.book_queries import rounded
from emberline.plans.registry import query
from emberline.plans.sqlviews import sql, view
from emberline.session import cut_lineage
from emberline.session import settle
from emberline.sources import views

# ---- split

view(
    "ends",
    """
    SELECT ids[CASE WHEN k1 < 1 THEN len(ids) ELSE k1 END] AS train_end, ids[CASE WHEN k2 < 1 THEN len(ids) ELSE k2 END] AS calib_end
    FROM (SELECT ids, CAST(floor(len(ids) * 0.7e0) AS BIGINT) AS k1, CAST(floor(len(ids) * (0.7e0 + 0.1e0)) AS BIGINT) AS k2
          FROM (SELECT list(borrower_id ORDER BY borrower_id) AS ids FROM panel) l) k
    """,
    "panel",
)
SPLIT = "CASE WHEN borrower_id <= train_end THEN 'train' WHEN borrower_id <= calib_end THEN 'calib' ELSE 'test' END"


def split_panel(spark: SparkSession, d: str) -> DataFrame:
    """Person-periods with their window, which is found from the loans' durations before they are expanded."""
    loans = settle(pan.recent_loan_durations(views.installments(spark, d)))
    return pan.expand_person_period(sp.oot_split(loans, "borrower_id", weight="duration"))


@query("oot_split", sql(f"SELECT borrower_id, months_since_origination, event, {SPLIT} AS split FROM panel, ends", "ends"))
def oot_split(spark: SparkSession, d: str) -> DataFrame:
    return split_panel(spark, d).select("borrower_id", "months_since_origination", "event", "split")


@query("window_filter", sql(
    f"SELECT split, count(*) AS n, sum(event) AS events FROM (SELECT event, {SPLIT} AS split FROM panel, ends) s WHERE split <> 'train' GROUP BY 1", "ends"))
def window_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = split_panel(spark, d)
    return rows.where(F.col("split") != "train").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("events")
    )


@query("deterministic_sample", sql(
    "SELECT borrower_id, target, CASE WHEN row_number() OVER (ORDER BY borrower_id) <= 500 THEN 'train' ELSE 'test' END AS split FROM (SELECT borrower_id, target FROM feats WHERE data_richness = 'ntc_ntb' ORDER BY md5('42:' || borrower_id), borrower_id LIMIT 800) s", "feats"))
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    thin = frames.feature_table(spark, d).where(F.col("data_richness") == K.THIN_FILE)
    return sp.deterministic_sample(thin.select("borrower_id", "target"), "borrower_id", 500, 300)


# ---- ranking metrics

def curve_views(name: str, source: str, groups: str = "") -> None:
    by = f"PARTITION BY {groups} " if groups else ""
    g = f"{groups}, " if groups else ""
    view(
        name,
        f"""
        SELECT *, sum(pos) OVER ({by}) AS p, sum(neg) OVER ({by}) AS n,
          sum(pos) OVER ({by}ORDER BY score DESC) AS cum_pos, sum(neg) OVER ({by}ORDER BY score DESC) AS cum_neg
        FROM (SELECT {g}score, sum(label) AS pos, sum(1 - label) AS neg FROM {source} WHERE score IS NOT NULL GROUP BY {g}score) c
        """,
        *([source] if source in ("scores", "model_scores", "doc_scores") else []),
    )


view("doc_scores", "SELECT CAST(n_chars AS DOUBLE) AS score, toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
view(
    "model_scores",
    """
    SELECT 'pd' AS model, pd AS score, event AS label FROM book WHERE event = 1 OR duration >= 12
    UNION ALL SELECT 'late_rate', late_installment_rate, event FROM book WHERE event = 1 OR duration >= 12
    UNION ALL SELECT 'constant', 0.5, event FROM book WHERE event = 1 OR duration >= 12
    """,
    "book",
)
curve_views("curve", "scores")
curve_views("seg_curve", "scores", "segment")
curve_views("doc_curve", "doc_scores")
curve_views("model_curve", "model_scores", "model")

AUC = "sum((cum_pos - pos / 2) * neg) / (max(p) * max(n))"
KS = "max(abs(cum_pos / p - cum_neg / n))"
AP = "sum(pos * cum_pos / (cum_pos + cum_neg)) / max(p)"
RECALL = "coalesce(max(cum_pos / p) FILTER (WHERE cum_neg / n <= 0.1), 0)"
BRIER = "sum(pos * power(1 - least(greatest(score, 0), 1), 2) + neg * power(least(greatest(score, 0), 1), 2)) / max(p + n)"


def metric_sql(places: int) -> str:
    return (
        f"round({AUC}, {places}) AS auc_roc, round({KS}, {places}) AS ks, round({AP}, {places}) AS pr_auc, "
        f"round({RECALL}, {places}) AS recall_at_fpr10, round({BRIER}, {places}) AS brier"
    )


@query("roc_curve", sql("SELECT segment, score, round(cum_pos / p, 6) AS tpr, round(cum_neg / n, 6) AS fpr FROM seg_curve", "seg_curve"))
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = met.roc_curve(views.labelled_scores(spark, d), "label", "score", ["segment"])
    return rounded(curve.select("segment", "score", "tpr", "fpr"), "tpr", "fpr")


@query("auc", sql(f"SELECT round({AUC}, 6) AS auc_roc FROM doc_curve", "doc_curve"))
def auc(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = views.table(spark, d, "documents"), views.table(spark, d, "labels")
    rows = docs.select("doc_id", "n_chars").join(labels, "doc_id")
    return met.metrics_row(rows, "toxic", "n_chars", places=6).select("auc_roc")


@query("ks", sql(f"SELECT segment, round({KS}, 6) AS ks FROM seg_curve GROUP BY 1", "seg_curve"))
def ks(spark: SparkSession, d: str) -> DataFrame:
    return met.metrics_row(views.labelled_scores(spark, d), "label", "score", ["segment"], places=6).select("segment", "ks")


@query("average_precision", sql(f"SELECT round({AP}, 6) AS pr_auc FROM curve", "curve"))
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return met.metrics_row(views.labelled_scores(spark, d), "label", "score", places=6).select("pr_auc")


@query("recall_at_fpr", sql(f"SELECT round({RECALL}, 6) AS recall FROM doc_curve", "doc_curve"))
def recall_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").select("doc_id", "n_chars").join(views.table(spark, d, "labels"), "doc_id")
    return met.metrics_row(rows, "toxic", "n_chars", places=6).select(F.col("recall_at_fpr10").alias("recall"))


@query("brier", "SELECT round(avg(power(l_discount - CAST(l_returnflag = 'R' AS INTEGER), 2)), 6) AS brier FROM lineitem")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return met.metrics_row(views.labelled_scores(spark, d), "label", "score", places=6).select("brier")


@query("metrics_row", sql(f"SELECT {metric_sql(4)} FROM curve", "curve"))
def metrics_row(spark: SparkSession, d: str) -> DataFrame:
    return met.metrics_row(views.labelled_scores(spark, d), "label", "score")


@query("naive_metrics", sql(
    "SELECT segment, 0.5 AS auc_roc, 0.0 AS ks, round(avg(label), 4) AS pr_auc, 0.0 AS recall_at_fpr10, round(avg(label), 4) AS brier, round(1 - avg(label), 4) AS accuracy_for_contrast_only FROM scores GROUP BY 1", "scores"))
def naive_metrics(spark: SparkSession, d: str) -> DataFrame:
    return met.naive_row(views.labelled_scores(spark, d), "label", ["segment"])


def evaluable_models(spark: SparkSession, d: str) -> DataFrame:
    book = frames.scored_book(spark, d).where(S.evaluable(F.col("event"), F.col("duration")))
    return book.select("event", "pd", "late_installment_rate", F.lit(0.5).alias("constant"))


MODELS = {"pd": "pd", "late_rate": "late_installment_rate", "constant": "constant"}
NAIVE_SQL = (
    "SELECT 'naive_always_no_default', 0.5, 0.0, round(avg(label), 4), 0.0, round(avg(label), 4), round(1 - avg(label), 4) "
    "FROM model_scores WHERE model = 'pd'"
)


@query("auc_bounds", sql(
    f"SELECT model, round(auc_roc, 4) AS auc_roc, round(ks, 4) AS ks, true AS auc_inside, true AS ks_inside FROM (SELECT model, {metric_sql(4)} FROM model_curve GROUP BY 1) m", "model_curve"))
def auc_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the whole curve, and whether the bounds from bucketed scores hold them."""
    arms = settle(met.long_scores(evaluable_models(spark, d), "event", MODELS))
    exact = met.metrics_row(arms, "label", "score", ["model"]).select("model", "auc_roc", "ks")
    bounds = met.bucketed_metrics(arms, "label", "score", ["model"], buckets=64)
    slack = 5e-5
    return exact.join(bounds, "model").select(
        "model", "auc_roc", "ks",
        F.col("auc_roc").between(F.col("auc_low") - slack, F.col("auc_high") + slack).alias("auc_inside"),
        F.col("ks").between(F.col("ks_low") - slack, F.col("ks_high") + slack).alias("ks_inside"),
    )


@query("metric_table", sql(
    f"SELECT model, {metric_sql(4)}, NULL AS accuracy_for_contrast_only FROM model_curve GROUP BY 1 UNION ALL {NAIVE_SQL}", "model_curve"))
def metric_table(spark: SparkSession, d: str) -> DataFrame:
    return met.metric_table(evaluable_models(spark, d), "event", MODELS)


@query("ablation_delta", sql(
    f"""SELECT metric, base_value, other_value, round(other_value - base_value, 4) AS delta FROM (
      SELECT metric, max(value) FILTER (WHERE model = 'late_rate') AS base_value, max(value) FILTER (WHERE model = 'pd') AS other_value
      FROM (UNPIVOT (SELECT model, {metric_sql(4)} FROM model_curve GROUP BY 1) ON auc_roc, ks, pr_auc, recall_at_fpr10, brier INTO NAME metric VALUE value) u GROUP BY 1) v""",
    "model_curve"))
def ablation_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = met.metrics_row(met.long_scores(evaluable_models(spark, d), "event", MODELS), "label", "score", ["model"])
    return met.ablation_delta(met.to_long(rows), "late_rate", "pd")


@query("union_arms", sql(
    "SELECT model, count(*) AS n, round(avg(score), 6) AS mean_score FROM model_scores GROUP BY 1", "model_scores"))
def union_arms(spark: SparkSession, d: str) -> DataFrame:
    arms = met.long_scores(evaluable_models(spark, d), "event", MODELS)
    return arms.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


# ---- calibration

view(
    "iso",
    """
    SELECT segment, score, round(max(lower_avg), 9) AS value FROM (
      SELECT i.segment, i.score, j.score AS js, min(avg_jk) AS lower_avg
      FROM sc i JOIN sc j ON i.segment = j.segment AND j.score <= i.score
      JOIN (SELECT a.segment, a.score AS lo, b.score AS hi,
              (SELECT sum(y) / sum(w) FROM sc m WHERE m.segment = a.segment AND m.score BETWEEN a.score AND b.score) AS avg_jk
            FROM sc a JOIN sc b ON a.segment = b.segment AND b.score >= a.score) r
        ON r.segment = i.segment AND r.lo = j.score AND r.hi >= i.score
      GROUP BY 1, 2, 3) q GROUP BY 1, 2
    """,
    "sc",
)
view(
    "sc",
    """
    SELECT segment, score, sum(label) AS y, count(*) AS w FROM (
      SELECT segment, score, label FROM scores UNION ALL SELECT '__global__', score, label FROM scores) s GROUP BY 1, 2
    """,
    "scores",
)


@query("fit_calibrators", sql("SELECT segment, min(score) AS x_lo, max(score) AS x_hi, round(value, 6) AS value, CAST(sum(w) AS BIGINT) AS weight FROM iso JOIN sc USING (segment, score) GROUP BY segment, value", "iso"))
def fit_calibrators(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.fit_calibrators(views.labelled_scores(spark, d), "segment", "score", "label"), "value")


@query("apply_calibration", sql("SELECT s.segment, s.score, round(value, 6) AS calibrated_pd, count(*) AS n FROM scores s JOIN iso i ON s.segment = i.segment AND s.score = i.score GROUP BY 1, 2, 3", "iso", "scores"))
def apply_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = views.labelled_scores(spark, d)
    fitted = cal.fit_calibrators(rows, "segment", "score", "label")
    applied = rounded(cal.apply_calibration(rows, fitted, "segment", "score"), "calibrated_pd")
    return applied.groupBy("segment", "score", "calibrated_pd").agg(F.count(F.lit(1)).alias("n"))


view("evb", "SELECT loan_type_segment AS segment, pd, event FROM book WHERE event = 1 OR duration >= 12", "book")


@query("reliability_table", sql(
    """SELECT CAST(bin AS INTEGER) AS bin, round(avg(pd), 6) AS mean_predicted, round(avg(event), 6) AS observed_rate, count(*) AS n FROM (
      SELECT pd, event, len(list_filter(e[2:len(e) - 1], lambda x: x < pd)) AS bin
      FROM evb, (SELECT list_distinct_sorted AS e FROM (SELECT list_sort(list_distinct(quantile_cont(pd, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS list_distinct_sorted FROM evb) q) t) b GROUP BY 1""",
    "evb"))
def reliability_table(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.scored_book(spark, d).where(S.evaluable(F.col("event"), F.col("duration")))
    return rounded(cal.reliability_table(rows, "event", "pd"), "mean_predicted", "observed_rate")


view("bands_in", "SELECT * FROM evb UNION ALL SELECT '__global__', pd, event FROM evb", "evb")
view(
    "bands",
    """
    SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY bin) AS band_no,
      CASE WHEN row_number() OVER (PARTITION BY segment ORDER BY bin) = 1 THEN 0.0 ELSE e[bin + 1] END AS lo,
      CASE WHEN row_number() OVER (PARTITION BY segment ORDER BY bin) = count(*) OVER (PARTITION BY segment) THEN 1.0 ELSE e[bin + 2] END AS hi,
      round(abs(obs - mean_pd) + 1.96 * sqrt(((obs * n + 1) / (n + 2)) * (1 - (obs * n + 1) / (n + 2)) / n), 5) AS half_width, n
    FROM (
      SELECT segment, bin, e, count(*) AS n, avg(event) AS obs, avg(pd) AS mean_pd FROM (
        SELECT b.segment, pd, event, e, len(list_filter(e[2:len(e) - 1], lambda x: x < pd)) AS bin
        FROM bands_in b JOIN (
          SELECT segment, list_sort(list_distinct(CASE WHEN count(*) < 200 THEN [min(pd), max(pd)]
            ELSE quantile_cont(pd, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) END)) AS e FROM bands_in GROUP BY 1) q ON b.segment = q.segment) x
      GROUP BY 1, 2, 3) y
    """,
    "bands_in",
)


@query("fit_confidence_bands", sql("SELECT segment, band_no, round(lo, 6) AS lo, round(hi, 6) AS hi, half_width, n FROM bands", "bands"))
def fit_confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.scored_book(spark, d).where(S.evaluable(F.col("event"), F.col("duration")))
    return rounded(cal.fit_confidence_bands(rows, "loan_type_segment", "pd", "event"), "lo", "hi")


BAND_SQL = """
SELECT borrower_id, half_width, n AS n_comparable, half_width > 0.1 OR n < 50 AS wide_band_flag FROM (
  SELECT borrower_id, half_width, n, row_number() OVER (PARTITION BY borrower_id ORDER BY band_no) AS r
  FROM book JOIN bands ON segment = loan_type_segment AND pd >= lo AND pd <= hi) x WHERE r = 1
"""


@query("band_lookup", sql(BAND_SQL, "book", "bands"))
def band_lookup(spark: SparkSession, d: str) -> DataFrame:
    return confidence_band(spark, d)


@query("confidence_band", sql(BAND_SQL, "book", "bands"))
def confidence_band(spark: SparkSession, d: str) -> DataFrame:
    # The fit and the lookup both read the book, so it is written once.
    book = cut_lineage(frames.scored_book(spark, d).select("borrower_id", "loan_type_segment", "pd", "event", "duration"))
    known = book.where(S.evaluable(F.col("event"), F.col("duration")))
    bands = cal.fit_confidence_bands(known, "loan_type_segment", "pd", "event")
    banded = cal.confidence_band(book, bands, "loan_type_segment", "pd")
    return banded.select("borrower_id", "band.half_width", "band.n_comparable", "band.wide_band_flag")


@query("models_disagree", sql(
    "SELECT b.borrower_id, abs(b.pd - l.pd) - 0.15e0 > 1e-12 AS disagree FROM book b JOIN lt_book l ON b.borrower_id = l.borrower_id", "book", "lt_book"))
def models_disagree(spark: SparkSession, d: str) -> DataFrame:
    book = frames.scored_book(spark, d).select("borrower_id", "pd")
    other = frames.life_table_book(spark, d).select("borrower_id", F.col("pd").alias("other_pd"))
    return book.join(other, "borrower_id").select(
        "borrower_id", S.models_disagree(F.col("pd"), F.col("other_pd")).alias("disagree")
    )


# ---- drift

DRIFT_FEATURES = ("o_totalprice", "l_quantity", "l_discount", "l_linenumber")


def psi_sql(feature: str) -> str:
    """One feature's PSI; `CAST` of the value itself is the category when it is discrete."""
    return f"""
    SELECT '{feature}' AS feature, sum((a - e) * ln(a / e)) AS psi FROM (
      SELECT greatest(count(*) FILTER (WHERE NOT is_current) / (SELECT count({feature}) FROM drift_rows WHERE NOT is_current), 1e-4) AS e,
        greatest(count(*) FILTER (WHERE is_current) / (SELECT count({feature}) FROM drift_rows WHERE is_current), 1e-4) AS a
      FROM (SELECT is_current, CASE WHEN k <= 10 THEN {feature} ELSE len(list_filter(edges[2:len(edges) - 1], lambda x: x <= {feature})) END AS bin
        FROM drift_rows, (SELECT count(DISTINCT {feature}) AS k,
          list_sort(list_distinct(quantile_cont({feature}, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS edges FROM drift_rows WHERE NOT is_current) q) b
      GROUP BY bin) c
    """


PSI_ALL = " UNION ALL ".join(psi_sql(f) for f in DRIFT_FEATURES)


@query("psi", sql(f"SELECT feature, round(psi, 6) AS psi FROM ({PSI_ALL}) p", "drift_rows"))
def psi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dr.psi(views.drift_rows(spark, d), DRIFT_FEATURES, F.col("is_current")), "psi")


@query("drift_report", sql(
    f"SELECT feature, round(psi, 4) AS psi, feature = 'l_discount' AS is_score, feature IN ('o_totalprice', 'l_quantity') AS is_core, round(psi, 4) > 0.2 AS drifted FROM ({PSI_ALL}) p", "drift_rows"))
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    return dr.drift_report(
        views.drift_rows(spark, d), ["o_totalprice", "l_quantity", "l_linenumber"], F.col("is_current"),
        core=["o_totalprice", "l_quantity"], score="l_discount",
    )


DRIFT_TEXT = """
SELECT feature AS worst_feature, psi AS worst_psi, k > 0 AS retrain_triggered,
  CASE WHEN score_psi < 0.1 THEN 'stable' ELSE 'score_distribution_shifted' END AS calibration_status,
  CASE WHEN k > 0 THEN printf('Drift: %d of 2 watched core features moved, most of all %s with PSI %.2f (limit 0.20). A retrain is started, and its model must win the gate before it is used.', k, feature, psi)
    ELSE printf('Stable inputs: the highest feature PSI is %.2f, on %s (limit 0.20).', psi, feature)
    || CASE WHEN score_psi < 0.1 THEN ' Nothing to do before the next look.' ELSE ' The scores themselves moved; look at calibration.' END END AS plain_language,
  CASE WHEN k > 0 THEN 'Retrain now, past the limit: ' || names || '.' WHEN score_psi < 0.1 THEN 'Keep to the monthly cycle.'
    ELSE 'Check calibration: scores moved while inputs are stable.' END AS recommendation
FROM (SELECT feature, round(psi, 4) AS psi, row_number() OVER (ORDER BY round(psi, 4) DESC, feature DESC) AS r,
    count(*) FILTER (WHERE round(psi, 4) > 0.2 AND feature IN ('o_totalprice', 'l_quantity')) OVER () AS k FROM ({0}) p WHERE feature <> 'l_discount') w,
  (SELECT round(psi, 4) AS score_psi FROM ({0}) q WHERE feature = 'l_discount') s,
  (SELECT string_agg(feature, ', ' ORDER BY feature) AS names FROM ({0}) n WHERE round(psi, 4) > 0.2 AND feature IN ('o_totalprice', 'l_quantity')) t
WHERE r = 1
"""


@query("drift_text", sql(DRIFT_TEXT.replace("{0}", PSI_ALL), "drift_rows"))
def drift_text(spark: SparkSession, d: str) -> DataFrame:
    return dr.drift_summary(drift_report(spark, d)).select(
        "worst_feature", "worst_psi", "retrain_triggered", "calibration_status", "plain_language", "recommendation"
    )


@query("exact_quantiles", sql(
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY 1"))
def exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.exact_quantiles(views.table(spark, d, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.99], ["l_returnflag"])
    return rows.select("l_returnflag", *[F.round(F.col("edges")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q99"))])
