"""Queries over what is written and read again: topics, streams, snapshots, metric tables and journals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scorer import DEMO_SCORER
from emberline.operators import journal as jr
from emberline.operators import quality
from emberline.operators.portfolio import grade_distribution
from emberline.plans import frames
from emberline.plans.book_queries import rounded
from emberline.plans.event_queries import replay_sql
from emberline.plans.insight_queries import attributions as attribution_rows
from emberline.plans.registry import query
from emberline.plans.sqlviews import sql
from emberline.session import ensure_checkpoint_dir
from emberline.sources import events as ev
from emberline.sources import tables as tb
from emberline.sources import views
from emberline.streaming import dedupe, replay, rescore

KNOWN = "type IN ('gst_filing', 'bank_transaction', 'repayment')"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- events that come twice, late, or for unknown loans

def repeated(spark: SparkSession, d: str) -> DataFrame:
    """All events, and every fifth once more an hour later."""
    events = views.loan_events(spark, d)
    again = events.where(F.col("event_id") % 5 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return events.unionByName(again)


@query("dedupe_events", sql(f"SELECT event_id, loan_id, type FROM evts WHERE {KNOWN}", "evts"))
def dedupe_events(spark: SparkSession, d: str) -> DataFrame:
    return replay.known_events(repeated(spark, d)).select("event_id", "loan_id", "type")


@query("dedupe_stream", sql(f"SELECT CAST(event_id AS VARCHAR) AS event_id, loan_id, type FROM evts WHERE {KNOWN}", "evts"))
def dedupe_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same events as a topic of many files, through the stream; what it emits, and the late ones beside it."""
    source, target = folder(spark, "topic"), folder(spark, "deduped")
    rows = repeated(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "loan_id", "type")
    ev.event_sink(rows.repartitionByRange(8, "ts"), source)
    for started in dedupe.start_dedupe(ev.event_source(spark, source, max_files_per_trigger=2), target, "2 hours"):
        started.awaitTermination()
    kept, landed = (spark.read.schema(ev.EVENT_SCHEMA).parquet(f"{target}/{name}") for name in ("kept", "landed"))
    return kept.unionByName(dedupe.late_events(landed, kept)).select("event_id", "loan_id", "type")


@query("replay_repeats", replay_sql("SELECT event_id, loan_id, round(post_pd, 6) AS post_pd, post_grade FROM rescored"))
def replay_repeats(spark: SparkSession, d: str) -> DataFrame:
    states = replay.replay_events(repeated(spark, d), frames.feature_table(spark, d), DEMO_SCORER)
    return rounded(states.select("event_id", "loan_id", "post_pd", "post_grade"), "post_pd")


@query("unknown_loan_quarantine", sql(
    f"SELECT event_id, loan_id, 'unknown_loan' AS problem FROM evts WHERE {KNOWN} AND loan_id NOT IN (SELECT borrower_id FROM feats WHERE borrower_id % 3 > 0)", "evts", "feats"))
def unknown_loan_quarantine(spark: SparkSession, d: str) -> DataFrame:
    known = frames.feature_table(spark, d).where(F.col("borrower_id") % 3 > 0)
    return replay.unknown_loans(views.loan_events(spark, d), known).select("event_id", "loan_id", "problem")


@query("online_rows", replay_sql(
    "SELECT loan_id, round(x1, 6) AS credit_income_ratio, x3 AS bureau_overdue_flag, round(x4, 6) AS prior_late_rate FROM walk w WHERE k > 0 AND k = (SELECT max(k) FROM walk o WHERE o.loan_id = w.loan_id)"))
def online_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = replay.online_rows(views.loan_events(spark, d), frames.feature_table(spark, d))
    names = ("credit_income_ratio", "bureau_overdue_flag", "prior_late_rate")
    shown = rows.select("loan_id", *[F.col("features")[n].alias(n) for n in names])
    return rounded(shown, "credit_income_ratio", "prior_late_rate")


# ---- topics and the stream

@query("stamp_event", sql(
    "SELECT event_id AS original, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) END AS kept_id, event_id % 3 = 0 AS new_id, event_id % 4 = 0 AS new_ts FROM evts", "evts"))
def stamp_event(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id")
    rows = views.loan_events(spark, d).select(
        key.alias("original"),
        F.when(key % 3 != 0, key.cast("string")).alias("event_id"),
        F.when(key % 4 != 0, F.col("ts").cast("timestamp")).alias("ts"),
        F.col("ts").cast("timestamp").alias("was"),
    )
    stamped = ev.stamp_event(rows)
    same = F.col("event_id") == F.col("original").cast("string")
    return stamped.select("original", F.when(same, F.col("event_id")).alias("kept_id"), (~same).alias("new_id"), (F.col("ts") != F.col("was")).alias("new_ts"))


def published(spark: SparkSession, d: str) -> str:
    """All events as a topic of text files."""
    where = folder(spark, "topic")
    rows = views.loan_events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "loan_id", "type")
    ev.event_sink(rows, where)
    return where


@query("event_sink", sql("SELECT CAST(event_id AS VARCHAR) AS event_id, loan_id, type FROM evts WHERE " + KNOWN, "evts"))
def event_sink(spark: SparkSession, d: str) -> DataFrame:
    good, _ = ev.parse_events(spark.read.text(published(spark, d)))
    return good.select("event_id", "loan_id", "type")


@query("event_source", sql("SELECT type, count(*) AS n, count(DISTINCT loan_id) AS loans FROM evts GROUP BY 1", "evts"))
def event_source(spark: SparkSession, d: str) -> DataFrame:
    target = folder(spark, "landed")
    raw = ev.event_source(spark, published(spark, d))
    writer = raw.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}/_checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    landed = spark.read.schema("value string").parquet(target)
    parsed = landed.select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.loan_id").alias("loan"))
    return parsed.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("loan").alias("loans"))


def streamed(spark: SparkSession, d: str) -> str:
    """The whole job on a topic, run until it has no more; the folder of its sinks."""
    target = folder(spark, "stream")
    raw = ev.event_source(spark, published(spark, d), max_files_per_trigger=100_000)
    for started in rescore.start_rescoring(raw, frames.feature_table(spark, d), DEMO_SCORER, target):
        started.awaitTermination()
    return target


# Ids are text in a topic, and equal times are ordered by them.
STREAM_SQL = "numbered AS (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS k"
PLAIN_SQL = "numbered AS (\nSELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY ts, event_id) AS k"


def stream_sql(body: str) -> str:
    text = replay_sql(body)
    assert PLAIN_SQL in text, "the view of numbered events has changed"
    return text.replace(PLAIN_SQL, STREAM_SQL)


@query("rescore_stream", stream_sql("SELECT CAST(event_id AS VARCHAR) AS event_id, loan_id, round(post_pd, 6) AS pd, post_grade AS risk_grade FROM rescored"))
def rescore_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{streamed(spark, d)}/timeline")
    return rounded(rows.select("event_id", "loan_id", "pd", "risk_grade"), "pd")


@query("two_sink_fanout", stream_sql(
    "SELECT 'timeline' AS sink, count(*) AS n FROM rescored UNION ALL SELECT 'alerts', count(*) FROM rescored WHERE pre_grade <> post_grade UNION ALL SELECT 'online', count(DISTINCT loan_id) FROM rescored"))
def two_sink_fanout(spark: SparkSession, d: str) -> DataFrame:
    target = streamed(spark, d)
    counts = [
        spark.read.parquet(f"{target}/{sink}").agg(F.lit(sink).alias("sink"), F.count_distinct(key).alias("n"))
        for sink, key in (("timeline", "event_id"), ("alerts", "event_id"), ("online", "loan_id"))
    ]
    return counts[0].union(counts[1]).union(counts[2])


# ---- files

@query("write_snapshot", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderkey) AS orders FROM orders GROUP BY 1")
def write_snapshot(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "snapshot")
    tb.write_snapshot(views.table(spark, d, "orders"), path, ["o_orderstatus"])
    read = tb.read_snapshot(spark, path)
    return read.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_orderkey").alias("orders")
    )


@query("read_snapshot", "SELECT c_custkey, c_mktsegment FROM customer")
def read_snapshot(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "snapshot")
    tb.write_snapshot(views.table(spark, d, "customer"), path)
    return tb.read_snapshot(spark, path, ["c_custkey", "c_mktsegment"])


def metric_table(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"))
    return rows.agg(F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.max("l_extendedprice").alias("top_price"))


METRICS_SQL = "SELECT l_returnflag AS model, round(avg(l_quantity), 6) AS mean_quantity, max(l_extendedprice) AS top_price FROM lineitem GROUP BY 1"


@query("write_metrics", f"SELECT metric, model, value FROM ({METRICS_SQL}) t UNPIVOT (value FOR metric IN (mean_quantity, top_price))")
def write_metrics(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "metrics")
    tb.write_metrics(metric_table(spark, d), path)
    return tb.read_metrics(spark, path)


@query("read_metrics", METRICS_SQL)
def read_metrics(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "metrics")
    tb.write_metrics(metric_table(spark, d), path)
    return tb.metrics_by_model(tb.read_metrics(spark, path), ["mean_quantity", "top_price"])


@query("read_loan_tables", "SELECT c_custkey AS borrower_id, o_orderkey AS loan_id, CAST(o_totalprice AS INTEGER) % 90 AS due_day FROM customer JOIN orders ON o_custkey = c_custkey")
def read_loan_tables(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "loans")
    joined = views.table(spark, d, "orders")
    installments = joined.select(
        F.col("o_custkey").alias("SK_ID_CURR"), F.col("o_orderkey").alias("SK_ID_PREV"), F.lit(1).alias("NUM_INSTALMENT_NUMBER"),
        (F.bround("o_totalprice").cast("int") % 90).cast("double").alias("DAYS_INSTALMENT"), F.lit("junk").alias("UNUSED"),
    )
    for name, file in tb.LOAN_FILES.items():
        source = installments if name == "installments" else views.table(spark, d, "customer").select(F.col("c_custkey").alias("SK_ID_CURR"))
        source.write.option("header", True).csv(f"{where}/{file}")
    return tb.read_loan_tables(spark, where)["installments"].select("borrower_id", "loan_id", "due_day")


@query("read_whitespace_table", "SELECT count(*) AS n, count(DISTINCT p_partkey) AS row_ids, sum(p_size) AS duration, count(*) FILTER (p_size % 2 = 0) AS bad FROM part")
def read_whitespace_table(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "credit")
    fields = [F.col("p_size").cast("string") if a in tb.CREDIT_NUMERIC else F.lit("A11") for a in tb.CREDIT_ATTRIBUTES]
    label = F.when(F.col("p_size") % 2 == 0, "2").otherwise("1")
    views.table(spark, d, "part").select(F.concat_ws("  ", *fields, label).alias("value")).write.text(where)
    rows = tb.read_whitespace_table(spark, where)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("row_ids"),
        F.sum(tb.CREDIT_NUMERIC[0]).alias("duration"), F.sum("target").alias("bad"),
    )


# ---- journals and single columns

@query("append_log", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT o_orderkey) AS repeated, max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) AS missing FROM orders")
def append_log(spark: SparkSession, d: str) -> DataFrame:
    path, orders = folder(spark, "log"), views.table(spark, d, "orders")
    for part in range(3):
        jr.append_log(orders.where(F.col("o_orderkey") % 3 == part), path)
    return jr.id_continuity(spark.read.parquet(path), "o_orderkey")


@query("production_metrics", """SELECT metric, value FROM (SELECT avg(p_retailprice) AS price, CAST(max(p_size) AS DOUBLE) AS size FROM part) t UNPIVOT (value FOR metric IN (price, size))""")
def production_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Two logged runs; the alias moves from the first to the second, whose metrics are the table's own."""
    runs, aliases = folder(spark, "runs"), folder(spark, "aliases")
    found = views.table(spark, d, "part").agg(F.avg("p_retailprice").alias("price"), F.max("p_size").alias("size")).first()
    for values in ({"price": 0.0, "size": None}, {"price": found["price"], "size": found["size"], "none": float("nan")}):
        jr.move_alias(spark, aliases, "pricer", "production", jr.log_run(spark, runs, "fit", metrics=values))
    read = spark.read
    return jr.production_metrics(read.schema(jr.ALIAS_SCHEMA).parquet(aliases), read.schema(jr.RUN_SCHEMA).parquet(runs), "pricer")


@query("driver_direction", sql("SELECT feature, CASE WHEN up THEN 'increases risk' ELSE 'decreases risk' END AS direction, count(*) AS n FROM contrib GROUP BY 1, 2", "contrib"))
def driver_direction(spark: SparkSession, d: str) -> DataFrame:
    return attribution_rows(spark, d).groupBy("feature", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("grade_shares", sql("SELECT risk_grade, round(count(*) / (SELECT count(*) FROM book), 4) AS share FROM book GROUP BY 1", "book"))
def grade_shares(spark: SparkSession, d: str) -> DataFrame:
    return grade_distribution(frames.scored_book(spark, d)).where("n > 0").select("risk_grade", "share")


@query("quality_column_present", """SELECT name || ': exists' AS "check", CAST(found AS DOUBLE) AS observed, found = 1 AS passed FROM (
  SELECT name, (SELECT count(*) FROM (DESCRIBE orders) c WHERE c.column_name = name) AS found FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_nothing']) AS name) n) t""")
def quality_column_present(spark: SparkSession, d: str) -> DataFrame:
    orders = views.table(spark, d, "orders")
    return quality.quality_suite(orders, [quality.column_present(orders, c) for c in ("o_orderkey", "o_custkey", "o_nothing")])
