"""Append-only tables: decisions, audit, alerts, timelines and model runs."""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K

RUN_SCHEMA = (
    "run_id string, name string, started_at timestamp, params map<string,string>, "
    "metrics map<string,double>, tags map<string,string>"
)
ALIAS_SCHEMA = "model string, alias string, version int, run_id string, moved_at timestamp"


def append_log(rows: DataFrame, path: str) -> None:
    """Append to a folder, one writer at a time: writers of one folder share its committer's temporary files."""
    rows.write.mode("append").parquet(path)


def decision_problem(decision: Column, reason: Column) -> Column:
    """Null for a valid decision, else why it is refused."""
    known = F.coalesce(decision.isin(*K.DECISIONS), F.lit(False))
    blank = F.coalesce(F.length(F.trim(reason)), F.lit(0)) == 0
    return F.when(~known, "unknown_decision").when(decision.isin(*K.REASON_REQUIRED) & blank, "reason_missing")


def split_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; the rejected ones carry `problem`."""
    judged = decisions.withColumn("problem", decision_problem(F.col("decision"), F.col("reason")))
    return judged.where(F.col("problem").isNull()).drop("problem"), judged.where(F.col("problem").isNotNull())


def latest_entries(log: DataFrame, id_column: str, limit: int = 50, loan: int | None = None, key: str = "loan_id") -> DataFrame:
    """Newest first, optionally for one loan."""
    chosen = log.where(F.col(key) == loan) if loan is not None else log
    return chosen.orderBy(F.col(id_column).desc()).limit(limit)


def loan_timeline(log: DataFrame, loan: int, order: Sequence[str], limit: int = 100, key: str = "loan_id") -> DataFrame:
    """Oldest first for one loan."""
    return log.where(F.col(key) == loan).orderBy(*order).limit(limit)


def new_alerts_since(alerts: DataFrame, mark: int, id_column: str = "alert_id") -> DataFrame:
    return alerts.where(F.col(id_column) > mark)


def id_continuity(log: DataFrame, id_column: str) -> DataFrame:
    """Rows, distinct ids and missing ids: what an append-only table must keep at zero difference."""
    ids = log.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"))
    return ids.agg(
        F.sum("n").alias("n_rows"),
        (F.sum("n") - F.count(F.lit(1))).alias("repeated"),
        (F.max(id_column) - F.min(id_column) + 1 - F.count(F.lit(1))).alias("missing"),
    )


def log_run(
    spark: SparkSession,
    path: str,
    name: str,
    params: Mapping[str, object] | None = None,
    metrics: Mapping[str, float | None] | None = None,
    tags: Mapping[str, str] | None = None,
) -> str:
    """Append one run; null and non-finite metrics are dropped. Returns the run id."""
    run_id = uuid.uuid4().hex
    clean = {k: float(v) for k, v in (metrics or {}).items() if v is not None and math.isfinite(float(v))}
    row = (run_id, name, None, {k: str(v) for k, v in (params or {}).items()}, clean, dict(tags or {}))
    frame = spark.createDataFrame([row], RUN_SCHEMA).withColumn("started_at", F.current_timestamp())
    append_log(frame, path)
    return run_id


def claimed(spark: SparkSession, path: str) -> bool:
    """Create an empty file that must not exist yet; False if someone else has.

    As exclusive as the store's own creation without overwriting; on a local disk the system's exclusive open.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() == "file":
        local = store.makeQualified(target).toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        store.create(target, False).close()
    except Py4JJavaError as error:
        if not error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        return False
    return True


def next_version(spark: SparkSession, folder: str) -> int:
    """A number that no other caller gets for the folder: one file for each, created exclusively, tried upwards."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = [int(f.getPath().getName()) for f in store.listStatus(where)] if store.exists(where) else []
    version = max(taken, default=0) + 1
    while not claimed(spark, f"{folder}/{version:09d}"):
        version += 1
    return version


def move_alias(spark: SparkSession, path: str, model: str, alias: str, run_id: str) -> int:
    """Register the run as the model's next version and point the alias at it.

    The version is claimed first, so two moves at once get two; a claim whose move fails leaves a gap. Each move has a
    folder of its own, `move=…`, so that moves at once do not share a writer's temporary files.
    """
    name = hashlib.sha256(model.encode()).hexdigest()[:16]
    version = next_version(spark, f"{path}/_versions/{name}")
    frame = spark.createDataFrame([(model, alias.lower(), version, run_id, None)], ALIAS_SCHEMA)
    frame.withColumn("moved_at", F.current_timestamp()).write.parquet(f"{path}/move={version:09d}-{name}")
    return version


def alias_runs(aliases: DataFrame, runs: DataFrame) -> DataFrame:
    """The run behind each (model, alias): the highest version wins, then the latest move."""
    newest = aliases.groupBy("model", "alias").agg(F.max_by("run_id", F.struct("version", "moved_at", "run_id") if "moved_at" in aliases.columns else F.struct("version", "run_id")).alias("run_id"), F.max("version").alias("version"))
    return newest.join(runs, "run_id")


def production_metrics(aliases: DataFrame, runs: DataFrame, model: str) -> DataFrame:
    """(metric, value) of the production run; empty when there is none."""
    chosen = alias_runs(aliases, runs).where((F.col("model") == model) & (F.col("alias") == "production"))
    return chosen.select(F.explode("metrics").alias("metric", "value"))


def gate_decision(challenger_auc: Column, production_auc: Column) -> Column:
    """Promote on rounded AUC at least as good: (promoted, reason)."""
    promoted = challenger_auc >= production_auc
    won = F.format_string("PROMOTED: AUC %.4f against %.4f in production, same test window.", challenger_auc, production_auc)
    held = F.format_string("HELD: AUC %.4f against %.4f in production, same test window; a person decides.", challenger_auc, production_auc)
    return F.struct(promoted.alias("promoted"), F.when(promoted, won).otherwise(held).alias("reason"))
