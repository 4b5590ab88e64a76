"""Queries over events, online features, decisions and journals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions import grades as G
from emberline.functions.scalar import evaluable
from emberline.functions.scalar import feature_payload as payload_of
from emberline.functions.scorer import DEMO_SCORER
from emberline.operators import features as feat
from emberline.operators import journal as jr
from emberline.operators import metrics as met
from emberline.operators import online as on
from emberline.operators import portfolio as port
from emberline.plans import frames
from emberline.plans.book_queries import rounded
from emberline.plans.registry import query
from emberline.plans.sqlscore import grade_sql, logit_sql, pd_sql
from emberline.plans.sqlviews import sql, view
from emberline.session import ensure_checkpoint_dir
from emberline.sources import views
from emberline.sources.events import event_records, parse_events
from emberline.streaming import replay

# ---- replay

DYNAMIC = {"credit_income_ratio": "x1", "annuity_income_ratio": "x2", "bureau_overdue_flag": "x3", "prior_late_rate": "x4"}
view(
    "numbered",
    """SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY ts, event_id) AS k FROM evts
    WHERE type IN ('gst_filing', 'bank_transaction', 'repayment')""",
    "evts",
)
WALK = """
walk(loan_id, k, event_id, type, p1, p2, p3, p4, x1, x2, x3, x4) AS (
  SELECT borrower_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
    CAST(credit_income_ratio AS DOUBLE), CAST(annuity_income_ratio AS DOUBLE), CAST(bureau_overdue_flag AS DOUBLE), CAST(prior_late_rate AS DOUBLE)
  FROM feats WHERE borrower_id IN (SELECT loan_id FROM evts)
  UNION ALL
  SELECT n.loan_id, n.k, n.event_id, n.type, x1, x2, x3, x4,
    CASE WHEN n.type = 'gst_filing' THEN x1 * 1.4e0 ELSE x1 END, CASE WHEN n.type = 'gst_filing' THEN x2 * 1.4e0 ELSE x2 END,
    CASE WHEN n.type = 'repayment' THEN x3 ELSE 1e0 END,
    CASE WHEN n.type = 'repayment' THEN coalesce(x4, 0) * 0.8e0 ELSE least(1e0, coalesce(x4, 0) + 0.2e0) END
  FROM walk w JOIN numbered n ON n.loan_id = w.loan_id AND n.k = w.k + 1)
"""
PRE = logit_sql(replaced={f: f"p{i}" for i, f in enumerate(DYNAMIC, start=1)})
POST = logit_sql(replaced=DYNAMIC)
RESCORED = f"""rescored AS (SELECT *, {grade_sql('pre_pd')} AS pre_grade, {grade_sql('post_pd')} AS post_grade FROM (
  SELECT *, {pd_sql('lb')} AS pre_pd, {pd_sql('la')} AS post_pd FROM (
    SELECT w.loan_id, w.event_id, w.type, {PRE} AS lb, {POST} AS la
    FROM walk w JOIN feats f ON f.borrower_id = w.loan_id WHERE w.k > 0) l) p)"""


def replay_sql(body: str) -> str:
    marker = "SELECT 1 AS marker"
    return sql(marker, "feats", "numbered").replace("WITH ", "WITH RECURSIVE ", 1).replace(marker, f", {WALK}, {RESCORED} {body}")


def rescored(spark: SparkSession, d: str) -> DataFrame:
    features = frames.feature_table(spark, d)
    return replay.replay_events(views.loan_events(spark, d), features, DEMO_SCORER)


@query("replay_events", replay_sql("SELECT event_id, loan_id, type, round(pre_pd, 6) AS pre_pd, round(post_pd, 6) AS post_pd, pre_grade, post_grade FROM rescored"))
def replay_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rescored(spark, d).drop("ts"), "pre_pd", "post_pd")


@query("alerts", replay_sql("SELECT event_id, loan_id, type, pre_grade, post_grade FROM rescored WHERE pre_grade <> post_grade"))
def alerts(spark: SparkSession, d: str) -> DataFrame:
    return replay.alerts(rescored(spark, d)).drop("ts", "message")


@query("alert_message", replay_sql(
    "SELECT event_id, printf('%s moved loan %d from grade %s to %s (PD %.4f -> %.4f)', type, loan_id, pre_grade, post_grade, pre_pd, post_pd) AS message FROM rescored WHERE pre_grade <> post_grade"))
def alert_message(spark: SparkSession, d: str) -> DataFrame:
    return replay.alerts(rescored(spark, d)).select("event_id", "message")


@query("risk_timeline", replay_sql("SELECT event_id, loan_id, round(post_pd, 6) AS pd, post_grade AS risk_grade FROM rescored"))
def risk_timeline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(replay.risk_timeline(rescored(spark, d)).drop("ts"), "pd")


@query("event_feature_delta", sql(
    """SELECT event_id, round(CASE WHEN type = 'gst_filing' THEN credit_income_ratio * 1.4 END, 6) AS credit_income_ratio,
      CASE WHEN type IN ('gst_filing', 'bank_transaction') THEN 1.0 END AS bureau_overdue_flag,
      round(CASE WHEN type IN ('gst_filing', 'bank_transaction') THEN least(1.0, coalesce(prior_late_rate, 0) + 0.2) WHEN type = 'repayment' THEN coalesce(prior_late_rate, 0) * 0.8 END, 6) AS prior_late_rate
    FROM evts e JOIN feats f ON f.borrower_id = e.loan_id""", "evts", "feats"))
def event_feature_delta(spark: SparkSession, d: str) -> DataFrame:
    names = ["credit_income_ratio", "annuity_income_ratio", "prior_late_rate"]
    features = frames.feature_table(spark, d).select(F.col("borrower_id").alias("loan_id"), *names)
    rows = views.loan_events(spark, d).join(features, "loan_id")
    delta = G.event_feature_delta(F.col("type"), None, {c: F.col(c) for c in names})
    shown = ("credit_income_ratio", "bureau_overdue_flag", "prior_late_rate")
    return rows.select("event_id", delta.alias("m")).select("event_id", *[F.round(F.col("m")[c], 6).alias(c) for c in shown])


@query("bad_event_quarantine", sql("SELECT type, count(*) AS n FROM evts WHERE type NOT IN ('gst_filing', 'bank_transaction', 'repayment') GROUP BY 1", "evts"))
def bad_event_quarantine(spark: SparkSession, d: str) -> DataFrame:
    events = views.loan_events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "loan_id", "type")
    _, rejected = parse_events(event_records(events))
    return rejected.groupBy(F.get_json_object("value", "$.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


# ---- online features

@query("feature_payload", "SELECT c_custkey AS borrower_id, '{\"borrower_id\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\",\"known\":' || CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'null' END || '}' AS features FROM customer")
def feature_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("borrower_id"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("known"), F.lit(1).alias("target"),
    )
    return rows.select("borrower_id", payload_of(rows, "borrower_id").alias("features"))


@query("materialize", sql(
    "SELECT borrower_id, data_richness, CAST(bureau_active_count AS BIGINT) AS bureau_active_count, false AS has_label FROM feats WHERE borrower_id IN (SELECT loan_id FROM evts)", "feats", "evts"))
def materialize(spark: SparkSession, d: str) -> DataFrame:
    features = frames.feature_table(spark, d)
    ids = views.loan_events(spark, d).select(F.col("loan_id").alias("borrower_id"))
    online = on.materialize(features, "borrower_id", ids)
    read = F.from_json("features", "data_richness string, bureau_active_count bigint, target int")
    return online.select(
        "borrower_id", read["data_richness"].alias("data_richness"), read["bureau_active_count"].alias("bureau_active_count"),
        F.contains("features", F.lit('"target"')).alias("has_label"),
    )


SOURCES = """SELECT l_partkey AS borrower_id, CASE WHEN l_partkey IN (SELECT user_id FROM events) THEN 'online'
  WHEN l_partkey IN (SELECT c_custkey FROM customer) THEN 'offline_fallback' ELSE 'unknown' END AS source FROM (SELECT DISTINCT l_partkey FROM lineitem) p"""


def looked_up(spark: SparkSession, d: str) -> DataFrame:
    customers = views.table(spark, d, "customer").select(F.col("c_custkey").alias("borrower_id"), "c_mktsegment")
    offline = on.materialize(customers, "borrower_id")
    online = on.materialize(customers, "borrower_id", views.loan_events(spark, d).select(F.col("loan_id").alias("borrower_id")))
    requests = views.table(spark, d, "lineitem").select(F.col("l_partkey").alias("borrower_id"))
    return on.online_or_offline(requests, online, offline, "borrower_id")


@query("online_or_offline", SOURCES)
def online_or_offline(spark: SparkSession, d: str) -> DataFrame:
    return looked_up(spark, d).select("borrower_id", "source")


@query("source_counts", f"SELECT source, count(*) AS n FROM ({SOURCES}) s GROUP BY 1")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return on.source_counts(looked_up(spark, d))


@query("merge_features", sql(
    """SELECT s.borrower_id, data_richness, round(coalesce(v, ext_source_1), 6) AS ext_source_1, ext_source_2
    FROM segd s LEFT JOIN (SELECT loan_id, arg_max(value, (ts, event_id)) / 100 AS v FROM evts GROUP BY 1) e ON e.loan_id = s.borrower_id""", "segd", "evts"))
def merge_features(spark: SparkSession, d: str) -> DataFrame:
    base = feat.data_richness(views.applications(spark, d), views.bureau(spark, d)).select(
        "borrower_id", "data_richness", "ext_source_1", "ext_source_2"
    )
    newest = on.latest_per_key(views.loan_events(spark, d).select("loan_id", "ts", "event_id", "value"), "loan_id", ["ts", "event_id"])
    deltas = newest.select(F.col("loan_id").alias("borrower_id"), F.create_map(F.lit("ext_source_1"), F.col("value") / 100).alias("feature_updates"))
    return rounded(on.merge_features(base, deltas, "borrower_id"), "ext_source_1")


@query("feature_at", sql(
    """SELECT e.event_id, p.asof_value, p.asof_at FROM evts e
    ASOF LEFT JOIN (SELECT loan_id, ts, max(value) AS asof_value, ts AS asof_at FROM evts GROUP BY 1, 2) p ON p.loan_id = e.loan_id AND e.ts >= p.ts""", "evts"))
def feature_at(spark: SparkSession, d: str) -> DataFrame:
    """Every event probes, and every event is a fact, its own among them."""
    events = views.loan_events(spark, d)
    probes = events.select("event_id", "loan_id", "ts")
    facts = events.select("loan_id", "ts", "value", F.col("ts").alias("at"))
    return on.feature_at(probes, facts, "loan_id", "ts", ["value", "at"]).select("event_id", "asof_value", "asof_at")


@query("write_through", SOURCES.replace("CASE WHEN l_partkey IN (SELECT user_id FROM events) THEN 'online'", "CASE WHEN l_partkey IN (SELECT user_id FROM events) THEN 'online' WHEN l_partkey IN (SELECT c_custkey FROM customer) THEN 'online'"))
def write_through(spark: SparkSession, d: str) -> DataFrame:
    """The same lookup again after the first has written its offline hits through."""
    path = f"{ensure_checkpoint_dir(spark)}/online-{uuid.uuid4().hex}"
    customers = views.table(spark, d, "customer").select(F.col("c_custkey").alias("borrower_id"), "c_mktsegment")
    on.materialize(customers, "borrower_id", views.loan_events(spark, d).select(F.col("loan_id").alias("borrower_id"))).write.parquet(path)
    requests = views.table(spark, d, "lineitem").select(F.col("l_partkey").alias("borrower_id"))
    offline = on.materialize(customers, "borrower_id")
    on.write_through(on.online_or_offline(requests, on.online_table(spark, path, "borrower_id"), offline, "borrower_id"), "borrower_id", path)
    again = on.online_or_offline(requests, on.online_table(spark, path, "borrower_id"), offline, "borrower_id")
    return again.select("borrower_id", "source")


@query("slice_by_ids", sql("SELECT borrower_id, data_richness FROM segd WHERE borrower_id IN (SELECT loan_id FROM evts)", "segd", "evts"))
def slice_by_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.data_richness(views.applications(spark, d), views.bureau(spark, d)).select("borrower_id", "data_richness")
    return on.slice_by_ids(rows, views.loan_events(spark, d).select(F.col("loan_id").alias("borrower_id")), "borrower_id")


@query("slice_by_sector", sql("SELECT borrower_id, sector_segment FROM segd WHERE sector_segment = 'Retail_Trade'", "segd"))
def slice_by_sector(spark: SparkSession, d: str) -> DataFrame:
    rows = feat.with_segments(views.applications(spark, d)).select("borrower_id", "sector_segment")
    return on.slice_by_sector(rows, "Retail_Trade")


# ---- decisions and journals

view(
    "decs",
    """SELECT o_orderkey AS record_id, o_custkey AS loan_id,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'override' WHEN '2-HIGH' THEN 'modify' WHEN '3-MEDIUM' THEN 'bogus' ELSE 'accept' END AS decision,
      CASE o_orderstatus WHEN 'F' THEN 'checked by hand' WHEN 'P' THEN '  ' END AS reason FROM orders""",
)
PROBLEM = "CASE WHEN decision NOT IN ('accept', 'modify', 'override') THEN 'unknown_decision' WHEN decision IN ('modify', 'override') AND coalesce(trim(reason), '') = '' THEN 'reason_missing' END"


def decisions(spark: SparkSession, d: str) -> DataFrame:
    orders = views.table(spark, d, "orders")
    kind = F.col("o_orderpriority")
    return orders.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("loan_id"),
        F.when(kind == "1-URGENT", "override").when(kind == "2-HIGH", "modify").when(kind == "3-MEDIUM", "bogus").otherwise("accept").alias("decision"),
        F.when(F.col("o_orderstatus") == "F", "checked by hand").when(F.col("o_orderstatus") == "P", "  ").alias("reason"),
    )


@query("decision_valid", sql(f"SELECT record_id, decision, {PROBLEM} AS problem FROM decs", "decs"))
def decision_valid(spark: SparkSession, d: str) -> DataFrame:
    accepted, rejected = jr.split_decisions(decisions(spark, d))
    return accepted.withColumn("problem", F.lit(None).cast("string")).unionByName(rejected).select("record_id", "decision", "problem")


@query("latest_decisions", sql(f"SELECT record_id, loan_id, decision FROM decs WHERE {PROBLEM} IS NULL ORDER BY record_id DESC LIMIT 50", "decs"))
def latest_decisions(spark: SparkSession, d: str) -> DataFrame:
    accepted, _ = jr.split_decisions(decisions(spark, d))
    return jr.latest_entries(accepted.select("record_id", "loan_id", "decision"), "record_id", 50)


@query("latest_audit", sql("SELECT record_id, loan_id FROM decs WHERE loan_id = (SELECT min(loan_id) FROM decs) ORDER BY record_id DESC LIMIT 50", "decs"))
def latest_audit(spark: SparkSession, d: str) -> DataFrame:
    log = decisions(spark, d).select("record_id", "loan_id")
    first = log.agg(F.min("loan_id")).first()[0]
    return jr.latest_entries(log, "record_id", 50, loan=first)


@query("latest_alerts", replay_sql("SELECT event_id, loan_id, pre_grade, post_grade FROM rescored WHERE pre_grade <> post_grade ORDER BY event_id DESC LIMIT 50"))
def latest_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = replay.alerts(rescored(spark, d)).select("event_id", "loan_id", "pre_grade", "post_grade")
    return jr.latest_entries(rows, "event_id", 50)


@query("new_alerts_since", replay_sql("SELECT event_id, loan_id, post_grade FROM rescored WHERE pre_grade <> post_grade AND event_id > 5000"))
def new_alerts_since(spark: SparkSession, d: str) -> DataFrame:
    rows = replay.alerts(rescored(spark, d)).select("event_id", "loan_id", "post_grade")
    return jr.new_alerts_since(rows, 5000, "event_id")


@query("loan_timeline", replay_sql("SELECT event_id, loan_id, round(post_pd, 6) AS pd, post_grade AS risk_grade FROM rescored JOIN (SELECT event_id AS eid, ts FROM evts) e ON eid = event_id WHERE loan_id = 7 ORDER BY ts, event_id LIMIT 100"))
def loan_timeline(spark: SparkSession, d: str) -> DataFrame:
    # One loan is a filter on both inputs, which reaches their scans.
    events = views.loan_events(spark, d).where(F.col("loan_id") == 7)
    features = frames.feature_table(spark, d).where(F.col("borrower_id") == 7)
    line = replay.risk_timeline(replay.replay_events(events, features, DEMO_SCORER))
    return rounded(jr.loan_timeline(line, 7, ["ts", "event_id"]).drop("ts"), "pd")


@query("id_continuity", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT o_orderkey) AS repeated, max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS missing FROM orders")
def id_continuity(spark: SparkSession, d: str) -> DataFrame:
    return jr.id_continuity(views.table(spark, d, "orders"), "o_orderkey")


@query("newest_decision", sql("SELECT loan_id, max(record_id) AS record_id, arg_max(decision, record_id) AS decision FROM decs GROUP BY 1", "decs"))
def newest_decision(spark: SparkSession, d: str) -> DataFrame:
    return on.latest_per_key(decisions(spark, d).select("loan_id", "record_id", "decision"), "loan_id", ["record_id"])


AUC_SQL = "round((sum({r}) FILTER (WHERE event = 1) - count(*) FILTER (WHERE event = 1) * (count(*) FILTER (WHERE event = 1) + 1) / 2) / (count(*) FILTER (WHERE event = 1) * count(*) FILTER (WHERE event = 0)), 4)"
RANK_SQL = "rank() OVER (PARTITION BY loan_type_segment ORDER BY {c}) + (count(*) OVER (PARTITION BY loan_type_segment, {c}) - 1) / 2"


@query("gate_reason", sql(
    f"""SELECT loan_type_segment, c >= p AS promoted, CASE WHEN c >= p THEN printf('PROMOTED: AUC %.4f against %.4f in production, same test window.', c, p)
      ELSE printf('HELD: AUC %.4f against %.4f in production, same test window; a person decides.', c, p) END AS reason FROM (
      SELECT loan_type_segment, {AUC_SQL.format(r="r1")} AS c, {AUC_SQL.format(r="r2")} AS p FROM (
        SELECT loan_type_segment, event, {RANK_SQL.format(c="pd")} AS r1, {RANK_SQL.format(c="late_installment_rate")} AS r2 FROM book WHERE event = 1 OR duration >= 12) k GROUP BY 1) g""", "book"))
def gate_reason(spark: SparkSession, d: str) -> DataFrame:
    """The gate for each segment: AUC of the scored PD against that of the late rate alone, on the same loans."""
    known = frames.scored_book(spark, d).where(evaluable(F.col("event"), F.col("duration")))
    arms = met.long_scores(known, "event", {"challenger": "pd", "production": "late_installment_rate"}, ["loan_type_segment"])
    rows = met.metrics_row(arms, "label", "score", ["loan_type_segment", "model"])
    of = lambda name: F.max(F.when(F.col("model") == name, F.col("auc_roc")))
    both = rows.groupBy("loan_type_segment").agg(of("challenger").alias("challenger"), of("production").alias("production"))
    decided = both.withColumn("g", jr.gate_decision(F.col("challenger"), F.col("production")))
    # Without an AUC on both sides nothing is decided, so there is no reason either.
    return decided.select("loan_type_segment", "g.promoted", F.when(F.col("g.promoted").isNotNull(), F.col("g.reason")).alias("reason"))


@query("run_log", """SELECT p_brand AS model, version, run_id, metric, value FROM (
  SELECT p_brand, max(p_partkey) AS version, 'run-' || max(p_partkey) AS run_id, arg_max(p_size, p_partkey) AS size, arg_max(p_retailprice, p_partkey) AS price FROM part GROUP BY 1) x,
  (SELECT unnest(['price', 'size']) AS metric) m, LATERAL (SELECT CASE metric WHEN 'price' THEN price ELSE CAST(size AS DOUBLE) END AS value) v""")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    parts = views.table(spark, d, "part")
    run_id = F.concat(F.lit("run-"), F.col("p_partkey").cast("string"))
    aliases = parts.select(F.col("p_brand").alias("model"), F.lit("production").alias("alias"), F.col("p_partkey").alias("version"), run_id.alias("run_id"))
    runs = parts.select(run_id.alias("run_id"), F.create_map(F.lit("price"), F.col("p_retailprice"), F.lit("size"), F.col("p_size").cast("double")).alias("metrics"))
    chosen = jr.alias_runs(aliases, runs)
    return chosen.select("model", "version", "run_id", F.explode("metrics").alias("metric", "value"))
