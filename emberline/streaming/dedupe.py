"""Each event once in a stream, with state that follows event time.

An event's id is held until the watermark passes its time by `delay`; repeats that come meanwhile are left out. Events
behind the watermark are not emitted by the stream, as it no longer knows whether they are repeats. All usable events
also land in a table of their own, and what landed without ever being emitted is the side table of late events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.sources.events import parse_events
from emberline.streaming.rescore import quarantine_sink

KEYS = ["loan_id", "event_id"]


def first_of_each(events: DataFrame, delay: str) -> DataFrame:
    """The first copy to arrive of each (loan_id, event_id), while copies are at most `delay` apart in time."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(KEYS)


def sink(rows: DataFrame, path: str, checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_dedupe(raw: DataFrame, folder: str, delay: str, once: bool = True) -> list[StreamingQuery]:
    """Sinks `kept`, `landed` and `quarantine` of a raw event source under `folder`; `landed` is read by `late_events`."""
    good, rejected = parse_events(raw)
    return [
        quarantine_sink(rejected, f"{folder}/quarantine", f"{folder}/_checkpoints/quarantine", once),
        sink(good, f"{folder}/landed", f"{folder}/_checkpoints/landed", once),
        sink(first_of_each(good, delay), f"{folder}/kept", f"{folder}/_checkpoints/kept", once),
    ]


def late_events(landed: DataFrame, kept: DataFrame) -> DataFrame:
    """Events that landed but were behind the watermark, each once, as the earliest of their copies."""
    rest = [c for c in landed.columns if c not in KEYS]
    missed = landed.join(kept.select(*KEYS), KEYS, "left_anti")
    first = missed.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), "ts").alias("e"))
    return first.select(*KEYS, *[F.col(f"e.{c}").alias(c) for c in rest])
