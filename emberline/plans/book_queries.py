"""Queries over sources, segments, features, panel and portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions import grades as G
from emberline.functions import scalar as S
from emberline.operators import features as feat
from emberline.operators import panel as pan
from emberline.operators import portfolio as port
from emberline.operators import quality as qual
from emberline.plans import frames
from emberline.plans.registry import query
from emberline.plans.sqlscore import action_sql, grade_sql
from emberline.plans.sqlviews import sql
from emberline.sources import views


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


GRADE_TOTALS = ", ".join(f"count(*) FILTER (WHERE risk_grade = '{g}') AS n_{g}" for g in K.GRADES)


def summary_sql(book: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{d}=' || {d} || ':' || CAST(count(*) AS VARCHAR) AS s FROM {book} GROUP BY {d}" for d in K.SEGMENT_COLUMNS
    )
    return f"""
    SELECT count(*) AS n_loans, round(avg(pd * 0.45), 5) AS expected_loss_rate, {GRADE_TOTALS},
      (SELECT string_agg(s, ';' ORDER BY s) FROM ({parts}) p) AS counts_by_segment
    FROM {book}
    """


@query("portfolio_summary", sql(summary_sql("lt_book"), "lt_book"))
def portfolio_summary(spark: SparkSession, d: str) -> DataFrame:
    return port.portfolio_summary(frames.life_table_groups(spark, d), weight="n_loans")


@query(
    "grade_distribution",
    sql(
        "SELECT risk_grade, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM lt_book), 4) AS share "
        "FROM (SELECT unnest(['A','B','C','D','E','F','G']) AS risk_grade) g "
        "LEFT JOIN (SELECT risk_grade AS rg, count(*) AS n FROM lt_book GROUP BY 1) c ON rg = risk_grade",
        "lt_book",
    ),
)
def grade_distribution(spark: SparkSession, d: str) -> DataFrame:
    return port.grade_distribution(frames.life_table_groups(spark, d), weight="n_loans")


@query(
    "scored_portfolio",
    sql(
        f"SELECT risk_grade, {action_sql('risk_grade')} AS action, count(*) AS n, round(avg(pd), 6) AS mean_pd, "
        "round(sum(pd * 0.45), 4) AS expected_loss FROM book GROUP BY 1, 2",
        "book",
    ),
)
def scored_portfolio(spark: SparkSession, d: str) -> DataFrame:
    book = frames.scored_book(spark, d)
    return book.groupBy("risk_grade", G.grade_action(F.col("risk_grade")).alias("action")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("pd"), 6).alias("mean_pd"),
        F.round(F.sum(G.expected_loss(F.col("pd"))), 4).alias("expected_loss"),
    )


# ---- scans and simple projections

@query("read_columns", "SELECT o_custkey AS borrower_id, o_totalprice AS amount FROM orders")
def read_columns(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "orders").select(F.col("o_custkey").alias("borrower_id"), F.col("o_totalprice").alias("amount"))


@query("tag_provenance", "SELECT c_custkey AS borrower_id, 'public_proxy' AS data_provenance FROM customer")
def tag_provenance(spark: SparkSession, d: str) -> DataFrame:
    return S.tag_provenance(views.table(spark, d, "customer").select(F.col("c_custkey").alias("borrower_id")), "public_proxy")


@query("map_loan_type", sql("SELECT contract_type, loan_type_segment, count(*) AS n FROM segd GROUP BY 1, 2", "segd"))
def map_loan_type(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.with_segments(views.applications(spark, d))
    return rows.groupBy("contract_type", "loan_type_segment").agg(F.count(F.lit(1)).alias("n"))


@query("map_sector", sql("SELECT organization_type, sector_segment, count(*) AS n FROM segd GROUP BY 1, 2", "segd"))
def map_sector(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.with_segments(views.applications(spark, d))
    return rows.groupBy("organization_type", "sector_segment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "safe_ratio",
    sql(
        "SELECT borrower_id, round(credit / nullif(income, 0), 6) AS credit_income_ratio, "
        "round(annuity / nullif(income, 0), 6) AS annuity_income_ratio FROM apps",
        "apps",
    ),
)
def safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = views.applications(spark, d).withColumns(feat.ratio_columns())
    return rounded(rows.select("borrower_id", "credit_income_ratio", "annuity_income_ratio"), "credit_income_ratio", "annuity_income_ratio")


@query(
    "days_to_years",
    sql(
        "SELECT borrower_id, round(-days_birth / 365.25, 6) AS age_years, "
        "round(CASE WHEN days_employed <> 365243 THEN greatest(-days_employed / 365.25, 0) END, 6) AS employed_years FROM apps",
        "apps",
    ),
)
def days_to_years(spark: SparkSession, d: str) -> DataFrame:
    rows = views.applications(spark, d).withColumns(feat.applicant_columns())
    return rounded(rows.select("borrower_id", "age_years", "employed_years"), "age_years", "employed_years")


@query(
    "days_late",
    sql("SELECT borrower_id, loan_id, paid_day - due_day AS days_late, count(*) AS n FROM inst GROUP BY 1, 2, 3", "inst"),
)
def days_late(spark: SparkSession, d: str) -> DataFrame:
    rows = views.installment_rows(spark, d)
    late = S.days_late(F.col("due_day"), F.col("paid_day"))
    return rows.groupBy("borrower_id", "loan_id", late.alias("days_late")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "is_late",
    sql(
        "SELECT count(*) FILTER (WHERE paid_day - due_day > 0) AS late_paid, "
        "count(*) FILTER (WHERE coalesce(paid_day - due_day, 9999) > 30) AS serious, count(*) AS n FROM inst",
        "inst",
    ),
)
def is_late(spark: SparkSession, d: str) -> DataFrame:
    late = S.days_late(F.col("due_day"), F.col("paid_day"))
    return views.installment_rows(spark, d).agg(
        F.count_if(S.is_late(late)).alias("late_paid"),
        F.count_if(S.is_late(late, K.EVENT_DAYS_LATE, K.UNPAID_DAYS_LATE)).alias("serious"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "fill_defaults",
    sql(
        "SELECT borrower_id, bureau_active_count, bureau_overdue_flag, n_installments, max_days_late FROM feats",
        "feats",
    ),
)
def fill_defaults(spark: SparkSession, d: str) -> DataFrame:
    joined = (
        views.applications(spark, d)
        .select("borrower_id")
        .join(feat.bureau_features(views.bureau(spark, d)), "borrower_id", "left")
        .join(feat.installment_features(views.installment_rows(spark, d)), "borrower_id", "left")
    )
    filled = feat.fill_defaults(joined)
    return filled.select("borrower_id", "bureau_active_count", "bureau_overdue_flag", "n_installments", "max_days_late")


@query(
    "one_hot",
    sql(
        "SELECT borrower_id, "
        + ", ".join(
            f"CAST({c} = '{v}' AS INTEGER) AS \"{c}_{v}\""
            for c, vs in {
                "data_richness": ("established", "ntc_ntb"),
                "loan_type_segment": ("other_proxy", "term_loan_proxy", "working_capital_proxy"),
            }.items()
            for v in vs
        )
        + " FROM segd",
        "segd",
    ),
)
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.data_richness(feat.with_segments(views.applications(spark, d)), views.bureau(spark, d))
    columns = ["data_richness", "loan_type_segment"]
    levels = feat.category_levels(rows, columns)
    return S.one_hot(rows.select("borrower_id", *columns), levels).drop(*columns)


@query(
    "align_columns",
    sql("SELECT borrower_id, ext_source_2, 0 AS sector_unseen, age_years FROM (SELECT borrower_id, ext_source_2, round(-days_birth / 365.25, 6) AS age_years FROM apps) a", "apps"),
)
def align_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = rounded(views.applications(spark, d).withColumns(feat.applicant_columns()), "age_years")
    return S.align_columns(rows, ["ext_source_2", "sector_unseen", "age_years"], keep=["borrower_id"])


@query(
    "clip",
    "SELECT c_custkey AS borrower_id, least(greatest(c_acctbal, 0.0), 5000.0) AS clipped FROM customer",
)
def clip(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("borrower_id"), S.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped")
    )


@query(
    "coerce_numeric",
    "SELECT event_id, try_cast(replace(replace(props, '{\"k\": ', ''), '}', '') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS not_a_number FROM events",
)
def coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "events")
    return rows.select(
        "event_id",
        S.coerce_numeric(F.get_json_object("props", "$.k")).alias("k"),
        S.coerce_numeric(F.col("event_type")).alias("not_a_number"),
    )


# ---- features and joins

@query(
    "installment_features",
    sql(
        "SELECT borrower_id, count(*) AS n_installments, round(avg(CASE WHEN paid_day - due_day > 0 THEN 1.0 ELSE 0.0 END), 6) AS late_installment_rate, "
        "CASE WHEN max(paid_day - due_day) IS NOT NULL THEN greatest(max(paid_day - due_day), 0) END AS max_days_late, round(avg(paid_day - due_day), 6) AS avg_days_late FROM inst GROUP BY 1",
        "inst",
    ),
)
def installment_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(feat.installment_features(views.installment_rows(spark, d)), "late_installment_rate", "avg_days_late")


@query(
    "bureau_features",
    sql(
        "SELECT borrower_id, count(*) FILTER (WHERE credit_active = 'Active') AS bureau_active_count, "
        "max(CASE WHEN credit_day_overdue > 0 THEN 1 ELSE 0 END) AS bureau_overdue_flag FROM bur GROUP BY 1",
        "bur",
    ),
)
def bureau_features(spark: SparkSession, d: str) -> DataFrame:
    return feat.bureau_features(views.bureau(spark, d))


@query("data_richness", sql("SELECT borrower_id, bureau_record_count, data_richness FROM segd", "segd"))
def data_richness(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.data_richness(views.applications(spark, d), views.bureau(spark, d))
    return rows.select("borrower_id", "bureau_record_count", "data_richness")


FEATURE_NUMBERS = (
    "credit_income_ratio", "annuity_income_ratio", "ext_source_1", "ext_source_2", "ext_source_3", "age_years",
    "employed_years", "late_installment_rate", "avg_days_late",
)
FEATURE_OTHERS = (
    "borrower_id", "target", "loan_type_segment", "sector_segment", "data_richness", "bureau_active_count",
    "bureau_overdue_flag", "n_installments", "max_days_late",
)


@query(
    "assemble_features",
    sql(
        f"SELECT {', '.join(FEATURE_OTHERS)}, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURE_NUMBERS)} FROM feats",
        "feats",
    ),
)
def assemble_features(spark: SparkSession, d: str) -> DataFrame:
    profile = feat.installment_features(views.installment_rows(spark, d))
    rows = feat.assemble_features(views.applications(spark, d), views.bureau(spark, d), profile)
    return rounded(rows.select(*FEATURE_OTHERS, *FEATURE_NUMBERS), *FEATURE_NUMBERS)


@query("segment_crosstab", sql(
    """SELECT CASE WHEN grouping(loan_type_segment) = 1 THEN 'All' ELSE loan_type_segment END AS loan_type_segment,
    count(*) FILTER (WHERE data_richness = 'established') AS established,
    count(*) FILTER (WHERE data_richness = 'ntc_ntb') AS ntc_ntb, count(*) AS "All"
    FROM segd GROUP BY ROLLUP (loan_type_segment)""", "segd"))
def segment_crosstab(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.data_richness(feat.with_segments(views.applications(spark, d)), views.bureau(spark, d))
    return feat.segment_crosstab(rows, "loan_type_segment", "data_richness", [K.ESTABLISHED, K.THIN_FILE])


@query("segment_counts", sql(
    " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM segd GROUP BY 2" for c in K.SEGMENT_COLUMNS), "segd"))
def segment_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.data_richness(feat.with_segments(views.applications(spark, d)), views.bureau(spark, d))
    return feat.segment_counts(rows, K.SEGMENT_COLUMNS)


# ---- panel

@query("keep_most_recent_loan", sql("SELECT borrower_id, loan_id, instalment_no, due_day, paid_day FROM recent", "recent"))
def keep_most_recent_loan(spark: SparkSession, d: str) -> DataFrame:
    return pan.keep_most_recent_loan(views.installments(spark, d)).select(
        "borrower_id", "loan_id", "instalment_no", "due_day", "paid_day"
    )


@query("latest_loan_rank", sql("SELECT borrower_id, loan_id, max_day, loan_rank FROM latest", "latest"))
def latest_loan_rank(spark: SparkSession, d: str) -> DataFrame:
    return pan.latest_loan_rank(views.installment_rows(spark, d))


@query("other_loans_only", sql(
    "SELECT i.borrower_id, i.loan_id, instalment_no, due_day, paid_day FROM inst i JOIN latest l ON i.borrower_id = l.borrower_id AND i.loan_id = l.loan_id WHERE loan_rank > 1",
    "latest"))
def other_loans_only(spark: SparkSession, d: str) -> DataFrame:
    return pan.other_loans_only(views.installments(spark, d)).select(
        "borrower_id", "loan_id", "instalment_no", "due_day", "paid_day"
    )


@query("prior_loan_behavior", sql("SELECT borrower_id, round(prior_late_rate, 6) AS prior_late_rate, prior_n_installments FROM prior", "prior"))
def prior_loan_behavior(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pan.prior_loan_behavior(views.installments(spark, d)), "prior_late_rate")


@query("valid_months", sql("SELECT borrower_id, count(*) AS n FROM inst WHERE instalment_no >= 1 GROUP BY 1", "inst"))
def valid_months(spark: SparkSession, d: str) -> DataFrame:
    rows = views.installments(spark, d).where(F.col("instalment_no") >= 1)
    return rows.groupBy("borrower_id").agg(F.count(F.lit(1)).alias("n"))


@query("monthly_worst", sql(
    "SELECT borrower_id, instalment_no AS month, max(coalesce(paid_day - due_day, 9999)) AS days_late FROM inst WHERE instalment_no >= 1 GROUP BY 1, 2", "inst"))
def monthly_worst(spark: SparkSession, d: str) -> DataFrame:
    return pan.monthly_worst(views.installments(spark, d))


@query("loan_durations", sql("SELECT borrower_id, duration, event FROM durations", "durations"))
def loan_durations(spark: SparkSession, d: str) -> DataFrame:
    return pan.recent_loan_durations(views.installments(spark, d))


@query("build_person_period_panel", sql("SELECT borrower_id, months_since_origination, event FROM panel", "panel"))
def build_person_period_panel(spark: SparkSession, d: str) -> DataFrame:
    return pan.build_person_period_panel(views.installments(spark, d))


@query("expand_person_period", sql(
    "SELECT months_since_origination, count(*) AS at_risk, sum(event) AS events FROM panel GROUP BY 1", "panel"))
def expand_person_period(spark: SparkSession, d: str) -> DataFrame:
    panel = pan.expand_person_period(pan.recent_loan_durations(views.installments(spark, d)))
    return panel.groupBy("months_since_origination").agg(F.count(F.lit(1)).alias("at_risk"), F.sum("event").alias("events"))


@query("panel_durations", sql(
    "SELECT borrower_id, max(months_since_origination) AS duration, max(event) AS event FROM panel GROUP BY 1", "panel"))
def panel_durations(spark: SparkSession, d: str) -> DataFrame:
    return pan.panel_durations(pan.build_person_period_panel(views.installments(spark, d)))


@query("panel_join_features", sql(
    "SELECT p.borrower_id, months_since_origination, event, loan_type_segment, data_richness, round(credit_income_ratio, 6) AS credit_income_ratio FROM panel p JOIN feats f ON p.borrower_id = f.borrower_id",
    "panel", "feats"))
def panel_join_features(spark: SparkSession, d: str) -> DataFrame:
    # Features and durations come from the same pass, so the panel is an expansion, not a join.
    features = frames.feature_table(spark, d).where(F.col("duration").isNotNull())
    kept = features.select("borrower_id", "duration", "event", "loan_type_segment", "data_richness", "credit_income_ratio")
    return rounded(pan.expand_person_period(kept), "credit_income_ratio")


@query("life_table_hazard", sql(
    "SELECT c_mktsegment, n_regionkey, months_since_origination, count(*) AS at_risk, sum(event) AS events, round(avg(event), 6) AS hazard FROM panel p JOIN apps a ON p.borrower_id = a.borrower_id GROUP BY 1, 2, 3",
    "panel", "apps"))
def life_table_hazard(spark: SparkSession, d: str) -> DataFrame:
    cells = ["c_mktsegment", "n_regionkey"]
    loans = pan.recent_loan_durations(views.installments(spark, d)).join(
        views.applications(spark, d).select("borrower_id", *cells), "borrower_id"
    )
    return rounded(pan.life_table_from_durations(loans, cells), "hazard")


@query("score_grid", sql("SELECT borrower_id, m AS months_since_origination FROM apps, range(1, 13) t(m)", "apps"))
def score_grid(spark: SparkSession, d: str) -> DataFrame:
    return pan.score_grid(views.applications(spark, d).select("borrower_id"))


@query("hazard_curve", sql(
    "SELECT c_mktsegment, n_regionkey, string_agg(h, ',' ORDER BY m) AS curve FROM (SELECT c_mktsegment, n_regionkey, months_since_origination AS m, printf('%.9f', avg(event)) AS h FROM panel p JOIN apps a ON p.borrower_id = a.borrower_id GROUP BY 1, 2, 3) x GROUP BY 1, 2",
    "panel", "apps"))
def hazard_curve(spark: SparkSession, d: str) -> DataFrame:
    cells = ["c_mktsegment", "n_regionkey"]
    loans = pan.recent_loan_durations(views.installments(spark, d)).join(
        views.applications(spark, d).select("borrower_id", *cells), "borrower_id"
    )
    curves = pan.segment_curves(pan.life_table_from_durations(loans, cells), cells)
    text = F.array_join(F.transform("hazard_curve", lambda h: F.format_string("%.9f", h)), ",")
    return curves.select(*cells, text.alias("curve"))


# ---- grades and the book

@query("cumulative_pd", sql(
    "SELECT c_mktsegment, n_regionkey, round(max(pd), 6) AS pd, count(*) AS n FROM lt_book GROUP BY 1, 2", "lt_book"))
def cumulative_pd(spark: SparkSession, d: str) -> DataFrame:
    book = frames.life_table_book(spark, d)
    return book.groupBy("c_mktsegment", "n_regionkey").agg(F.round(F.max("pd"), 6).alias("pd"), F.count(F.lit(1)).alias("n"))


@query("batch_score", sql("SELECT borrower_id, round(pd, 6) AS pd, risk_grade FROM book", "book"))
def batch_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frames.scored_book(spark, d).select("borrower_id", "pd", "risk_grade"), "pd")


@query("pd_to_grade", f"SELECT l_orderkey, l_linenumber, count(*) AS n, {grade_sql('l_discount')} AS risk_grade FROM lineitem GROUP BY ALL")
def pd_to_grade(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "lineitem")
    grade = G.pd_to_grade(F.col("l_discount")).alias("risk_grade")
    return rows.groupBy("l_orderkey", "l_linenumber", grade).agg(F.count(F.lit(1)).alias("n"))


@query("grade_action", sql(f"SELECT borrower_id, risk_grade, {action_sql('risk_grade')} AS action FROM lt_book", "lt_book"))
def grade_action(spark: SparkSession, d: str) -> DataFrame:
    return frames.life_table_book(spark, d).select("borrower_id", "risk_grade", "action")


@query("next_better_grade", sql(
    "SELECT borrower_id, risk_grade, CASE WHEN risk_grade > 'A' THEN chr(ascii(risk_grade) - 1) END AS better FROM book", "book"))
def next_better_grade(spark: SparkSession, d: str) -> DataFrame:
    return frames.scored_book(spark, d).select("borrower_id", "risk_grade", G.next_better_grade(F.col("risk_grade")).alias("better"))


@query("borrower_message", sql(
    "SELECT borrower_id, CASE risk_grade " + " ".join(f"WHEN '{g}' THEN '{t}'" for g, t in K.BORROWER_LANGUAGE.items()) + " END AS message FROM book", "book"))
def borrower_message(spark: SparkSession, d: str) -> DataFrame:
    return frames.scored_book(spark, d).select("borrower_id", G.borrower_band_text(F.col("risk_grade")).alias("message"))


@query("route_model", sql(
    "SELECT borrower_id, CASE WHEN data_richness = 'ntc_ntb' THEN 'thin_file' ELSE 'hazard' END AS model_used, data_richness = 'ntc_ntb' AS unavailable_if_missing FROM segd", "segd"))
def route_model(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.data_richness(views.applications(spark, d), views.bureau(spark, d))
    with_model = G.route_model(F.col("data_richness"))
    without = G.route_model(F.col("data_richness"), thin_file_available=False)
    return rows.select(
        "borrower_id", with_model["model_used"].alias("model_used"),
        without["thin_file_unavailable"].alias("unavailable_if_missing"),
    )


@query("expected_loss", sql(
    "SELECT loan_type_segment, round(avg(pd * 0.45), 6) AS unit_rate, round(sum(pd * 0.45 * credit) / sum(credit), 6) AS weighted_rate FROM book b JOIN (SELECT borrower_id AS bid, credit FROM apps) a ON bid = borrower_id GROUP BY 1",
    "book", "apps"))
def expected_loss(spark: SparkSession, d: str) -> DataFrame:
    book = frames.scored_book(spark, d).select("borrower_id", "loan_type_segment", "pd")
    joined = book.join(views.applications(spark, d).select("borrower_id", "credit"), "borrower_id")
    return joined.groupBy("loan_type_segment").agg(
        F.round(F.avg(G.expected_loss(F.col("pd"))), 6).alias("unit_rate"),
        F.round(F.sum(G.expected_loss(F.col("pd"), ead=F.col("credit"))) / F.sum("credit"), 6).alias("weighted_rate"),
    )


@query("high_risk_flag", sql("SELECT borrower_id, risk_grade IN ('E','F','G') AS high_risk FROM book", "book"))
def high_risk_flag(spark: SparkSession, d: str) -> DataFrame:
    return frames.scored_book(spark, d).select("borrower_id", G.high_risk_flag(F.col("risk_grade")).alias("high_risk"))


@query("evaluable_only", sql("SELECT borrower_id, duration, event FROM durations WHERE event = 1 OR duration >= 12", "durations"))
def evaluable_only(spark: SparkSession, d: str) -> DataFrame:
    return pan.recent_loan_durations(views.installments(spark, d)).where(S.evaluable(F.col("event"), F.col("duration")))


@query("score_join", sql(
    "SELECT borrower_id, loan_type_segment, sector_segment, data_richness, duration, event, target, round(pd, 6) AS pd FROM book", "book"))
def score_join(spark: SparkSession, d: str) -> DataFrame:
    book = frames.scored_book(spark, d)
    return rounded(book.select("borrower_id", *K.SEGMENT_COLUMNS, "duration", "event", "target", "pd"), "pd")


@query("unified_grade_table", sql(
    "SELECT loan_type_segment, risk_grade, count(*) AS n, round(avg(pd), 6) AS mean_pd FROM book GROUP BY 1, 2", "book"))
def unified_grade_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(port.unified_grade_table(frames.scored_book(spark, d), "loan_type_segment"), "mean_pd")


@query("fairness_audit", sql(
    "SELECT *, round(avg_pd / CASE WHEN min(avg_pd) OVER (PARTITION BY dimension) = 0 THEN 1e-9 ELSE min(avg_pd) OVER (PARTITION BY dimension) END, 3) AS disparity_ratio FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS dimension, {c} AS "group", count(*) AS n, round(avg(pd), 5) AS avg_pd,
        round(avg(CASE WHEN risk_grade IN ('E','F','G') THEN 1.0 ELSE 0.0 END), 5) AS high_risk_share,
        round(avg(CASE WHEN risk_grade IN ('E','F','G') THEN 1.0 ELSE 0.0 END) FILTER (WHERE event = 0 AND duration >= 12), 5) AS false_positive_rate
        FROM book GROUP BY 2""" for c in K.SEGMENT_COLUMNS) + ") g", "book"))
def fairness_audit(spark: SparkSession, d: str) -> DataFrame:
    return port.fairness_audit(frames.scored_book(spark, d))


@query("fairness_flags", sql(
    "SELECT dimension, \"group\" FROM (SELECT *, round(avg_pd / min(avg_pd) OVER (PARTITION BY dimension), 3) AS r FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS \"group\", round(avg(pd), 5) AS avg_pd FROM book GROUP BY 2" for c in K.SEGMENT_COLUMNS)
    + ") g) h WHERE r > 1.25", "book"))
def fairness_flags(spark: SparkSession, d: str) -> DataFrame:
    return port.fairness_flags(port.fairness_audit(frames.scored_book(spark, d))).select("dimension", "group")


@query("sample_per_grade", sql(
    "SELECT borrower_id, loan_type_segment, risk_grade, round(pd, 4) AS pd FROM (SELECT *, row_number() OVER (PARTITION BY risk_grade ORDER BY pd, borrower_id) AS r FROM book) x WHERE r <= 4", "book"))
def sample_per_grade(spark: SparkSession, d: str) -> DataFrame:
    rows = port.sample_per_grade(frames.scored_book(spark, d).select("borrower_id", "loan_type_segment", "risk_grade", "pd"))
    return rounded(rows.drop("rank_in_grade"), "pd", places=4)


@query("near_boundary_loans", sql(
    "SELECT borrower_id, risk_grade, round(pd, 6) AS pd FROM book WHERE risk_grade IN ('E','F','G') ORDER BY book.pd, borrower_id LIMIT 200", "book"))
def near_boundary_loans(spark: SparkSession, d: str) -> DataFrame:
    return rounded(port.near_boundary_loans(frames.scored_book(spark, d).select("borrower_id", "risk_grade", "pd")), "pd")


@query("riskiest_loan", sql(
    "SELECT borrower_id, risk_grade, round(pd, 6) AS pd FROM book ORDER BY book.pd DESC, borrower_id LIMIT 1", "book"))
def riskiest_loan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(port.riskiest_loan(frames.scored_book(spark, d).select("borrower_id", "risk_grade", "pd")), "pd")


# ---- quality

@query("quality_null_rate", sql(
    "SELECT round(avg(CASE WHEN credit_income_ratio IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM feats", "feats"))
def quality_null_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = views.applications(spark, d).withColumns(feat.ratio_columns())
    return rows.agg(F.round(qual.null_rate_below("credit_income_ratio", 0.05).observed, 6).alias("null_rate"))


@query("quality_between", "SELECT round(avg(CASE WHEN l_discount BETWEEN 0.01 AND 0.09 THEN 1.0 ELSE 0.0 END), 6) AS in_range FROM lineitem")
def quality_between(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "lineitem").agg(F.round(qual.between("l_discount", 0.01, 0.09).observed, 6).alias("in_range"))


@query("quality_unique", "SELECT CAST(sum(n - 1) AS DOUBLE) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) g")
def quality_unique(spark: SparkSession, d: str) -> DataFrame:
    return qual.duplicate_count(views.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("quality_suite", sql(
    """SELECT 'borrower_id: exists' AS "check", 1.0 AS observed, true AS passed
    UNION ALL SELECT 'loan_type_segment: exists', 1.0, true UNION ALL SELECT 'data_richness: exists', 1.0, true
    UNION ALL SELECT 'borrower_id: one row each', v, v = 0 FROM (SELECT CAST(count(*) - count(DISTINCT borrower_id) AS DOUBLE) AS v FROM feats) a
    UNION ALL SELECT 'credit_income_ratio: share of nulls under 0.05', round(v, 6), v < 0.05 FROM (SELECT avg(CASE WHEN credit_income_ratio IS NULL THEN 1.0 ELSE 0.0 END) AS v FROM feats) b
    UNION ALL SELECT 'late_installment_rate: all from 0 to 1', v, v = 1 FROM (SELECT avg(CASE WHEN late_installment_rate BETWEEN 0 AND 1 THEN 1.0 ELSE 0.0 END) AS v FROM feats) c
    UNION ALL SELECT 'age_years: all from 18 to 100', v, v = 1 FROM (SELECT avg(CASE WHEN age_years BETWEEN 18 AND 100 THEN 1.0 ELSE 0.0 END) AS v FROM feats) e""",
    "feats"))
def quality_suite(spark: SparkSession, d: str) -> DataFrame:
    profile = feat.installment_features(views.installment_rows(spark, d))
    rows = feat.assemble_features(views.applications(spark, d), views.bureau(spark, d), profile)
    return rounded(qual.quality_suite(rows, qual.serving_checks(rows)), "observed")
