"""Offline to online features: materialise, look up, merge, and look up as of a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.scalar import feature_payload
from emberline.session import settle


def slice_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def slice_by_sector(df: DataFrame, sector: str, column: str = "sector_segment") -> DataFrame:
    """The sector's rows; a sector without rows is an error that names some that have rows."""
    found = df.where(F.col(column) == sector)
    if found.isEmpty():
        names = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column).limit(20)
        raise ValueError(f"unknown sector {sector!r}; known, among others: {[r[0] for r in names.collect()]}")
    return found


def materialize(
    offline: DataFrame,
    key: str,
    ids: DataFrame | None = None,
    limit: int | None = None,
    excluded: Sequence[str] = K.SERVING_EXCLUDED,
    order: Sequence[str] = (),
) -> DataFrame:
    """(key, features as JSON, updated_at) without labels; the newest row per key by `order`.

    Without an order, of repeated rows of a key the one with the greatest text stands.
    """
    chosen = slice_by_ids(offline, ids, key) if ids is not None else offline
    chosen = latest_per_key(chosen, key, order)
    chosen = chosen.limit(limit) if limit is not None else chosen
    payload = feature_payload(chosen, key, excluded)
    return chosen.select(F.col(key), payload.alias("features"), F.current_timestamp().alias("updated_at"))


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Newest row per key by an aggregation, so old versions are dropped before the exchange."""
    rest = [c for c in df.columns if c != key]
    by = F.struct(*order) if order else F.to_json(F.struct(*rest))
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("r"))
    return newest.select(*[F.col(key) if c == key else F.col("r").getField(c).alias(c) for c in df.columns])


def online_or_offline(requests: DataFrame, online: DataFrame, offline: DataFrame, key: str) -> DataFrame:
    """Requested keys with their payload and where it came from: online, offline_fallback or unknown."""
    left = requests.select(key).distinct()
    joined = left.join(online.select(key, F.col("features").alias("_on")), key, "left").join(
        offline.select(key, F.col("features").alias("_off")), key, "left"
    )
    source = (
        F.when(F.col("_on").isNotNull(), "online").when(F.col("_off").isNotNull(), "offline_fallback").otherwise("unknown")
    )
    return joined.select(key, F.coalesce("_on", "_off").alias("features"), source.alias("source"))


def write_through(looked_up: DataFrame, key: str, path: str) -> DataFrame:
    """Append the offline hits of a lookup to the online table, so that the next lookup finds them there; returns them.

    A hit that another lookup has written meanwhile is a row more; readers take the newest of a key.
    """
    hits = looked_up.where(F.col("source") == "offline_fallback").select(key, "features", F.current_timestamp().alias("updated_at"))
    written = settle(hits)
    written.write.mode("append").parquet(path)
    return written


def reset_rows(offline: DataFrame, key: str, ids: DataFrame, path: str, order: Sequence[str] = ()) -> DataFrame:
    """Append the offline rows of the given keys as their newest online rows, whatever events have changed since."""
    rows = settle(materialize(offline, key, ids, order=order))
    rows.write.mode("append").parquet(path)
    return rows


def online_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest online row of each key."""
    return latest_per_key(spark.read.parquet(path), key, ["updated_at", "features"])


def source_counts(looked_up: DataFrame) -> DataFrame:
    return looked_up.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def merge_features(base: DataFrame, deltas: DataFrame, key: str, delta: str = "feature_updates") -> DataFrame:
    """Overwrite named feature columns with the non-null entries of a map<string,double> per key.

    `deltas` holds one row per key.
    """
    joined = base.join(deltas.select(key, F.col(delta).alias("_d")), key, "left")
    numeric = {f.name for f in base.schema.fields if f.dataType.typeName() in ("double", "integer", "long", "float")}
    columns = [
        F.coalesce(F.col("_d")[c], F.col(c).cast("double")).alias(c) if c in numeric and c != key else F.col(c)
        for c in base.columns
    ]
    return joined.select(*columns)


def feature_at(
    left: DataFrame, right: DataFrame, key: str, ts: str, values: Sequence[str], coarse: Column | None = None
) -> DataFrame:
    """For each left row, the newest right values of the key at or before its time, the greatest of those at one time.

    Both sides are united and carried forward inside (key, time bucket); what a bucket inherits is
    the last value of the key's earlier buckets. A hot key is thus spread over its buckets.
    """
    keep = left.columns
    payload = F.struct(*[F.col(v) for v in values])
    empty = F.lit(None)
    bucket = F.to_date(F.col(ts)) if coarse is None else coarse
    probes = left.select(*keep, F.lit(1).alias("_probe"), empty.alias("_p"))
    facts = right.select(key, ts, payload.alias("_p"), F.lit(0).alias("_probe"))
    rows = probes.drop("_p").unionByName(facts, allowMissingColumns=True).withColumn("_bucket", bucket)
    inside = W.partitionBy(key, "_bucket").orderBy(ts, "_probe", "_p").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.last("_p", ignorenulls=True).over(inside))
    newest = facts.withColumn("_bucket", bucket).groupBy(key, "_bucket").agg(
        F.max_by("_p", F.struct(F.col(ts), F.col("_p"))).alias("_end")
    )
    # Buckets with probes but no facts inherit too, so the calendar covers every bucket of the key.
    calendar = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n")).drop("_n").join(newest, [key, "_bucket"], "left")
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = calendar.select(key, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    found = F.coalesce(F.col("_local"), F.col("_carry"))
    return (
        local.where(F.col("_probe") == 1)
        .join(carried, [key, "_bucket"])
        .select(*keep, *[found[v].alias(f"asof_{v}") for v in values])
    )
