"""Event topics: JSON records from files or Kafka, parsed with a side table for bad ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K

EVENT_SCHEMA = "event_id string, ts timestamp, loan_id bigint, type string, feature_updates map<string,double>"
TOPIC = "loan_events"


def stamp_event(df: DataFrame) -> DataFrame:
    """Add an id and a time where they are missing."""
    have = set(df.columns)
    event_id = F.coalesce(F.col("event_id").cast("string"), F.uuid()) if "event_id" in have else F.uuid()
    ts = F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()) if "ts" in have else F.current_timestamp()
    return df.withColumns({"event_id": event_id, "ts": ts})


def event_source(
    spark: SparkSession,
    location: str,
    kind: str = "files",
    options: Mapping[str, str] | None = None,
    max_files_per_trigger: int = 64,
) -> DataFrame:
    """Stream of raw records (`value` string): text files in a folder, or a Kafka topic.

    Both admit a bounded amount per micro-batch, which also bounds what one key can bring.
    """
    reader = spark.readStream
    if kind == "kafka":
        settings = {"maxOffsetsPerTrigger": "1000000", "startingOffsets": "earliest", **(options or {})}
        raw = reader.format("kafka").option("subscribe", location).options(**settings).load()
        return raw.select(F.col("value").cast("string").alias("value"))
    if kind != "files":
        raise ValueError(f"unknown event source {kind!r}")
    return reader.format("text").option("maxFilesPerTrigger", max_files_per_trigger).load(location)


def problem_of(event: Column) -> Column:
    """Why a parsed record cannot be used, or null."""
    return (
        F.when(event.isNull() | event["loan_id"].isNull(), "unreadable")
        .when(event["type"].isNull() | ~event["type"].isin(*K.EVENT_TYPES), "unknown_type")
        .when(event["event_id"].isNull() | event["ts"].isNull(), "unstamped")
    )


def parse_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable events, and the rest as (value, problem); a bad record never stops the stream."""
    parsed = raw.select("value", F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("e"))
    judged = parsed.withColumn("problem", problem_of(F.col("e")))
    return judged.where(F.col("problem").isNull()).select("e.*"), judged.where(F.col("problem").isNotNull()).select(
        "value", "problem"
    )


def event_records(events: DataFrame) -> DataFrame:
    """Events as JSON text, stamped."""
    stamped = stamp_event(events)
    return stamped.select(F.to_json(F.struct(*stamped.columns)).alias("value"))


def event_sink(events: DataFrame, location: str, kind: str = "files", options: Mapping[str, str] | None = None) -> None:
    """Publish a batch of events to a folder or a Kafka topic."""
    writer = event_records(events).write
    if kind == "kafka":
        writer.format("kafka").option("topic", location).options(**(options or {})).save()
    else:
        writer.mode("append").text(location)
