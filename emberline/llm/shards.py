"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group. Groups are gathered into parcels whose number depends on the number of
shards alone, never on the rows: small groups are hashed into `FINE` parcels for each shard, a group above the size
of such a parcel has parcels of its own. A group that needs more than half a shard is split, and its parcels are
placed one by one; any other group stays whole. Only the parcels' sums reach the driver. There each item, in
falling order of size, goes to the shard where the dot product of its vector with the residual capacity is highest
among those that it fits.

Defined results: a null text has no bytes and no tokens, and all null texts are one group; its checksum is null.
Equal rows are separate members of their group. No documents give no rows. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import read, word_count, written

SHARDS = 24
#: Parcels of small groups for each shard: a parcel holds about 1 / FINE of a shard.
FINE = 256
#: A group with a larger part of a shard than this is split over shards.
WHOLE = 0.5
#: Bytes that a document has besides its text.
HEADER = 8

ASSIGNED = "parcel string, shard int, first_slot long"


def measure(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: its vector, its group, and a number that tells equal rows apart."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + HEADER).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        word_count(text).alias("tokens"),
        F.xxhash64(text).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )


def sums() -> list:
    return [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; `items` holds vectors in units of one shard's capacity."""
    residual = np.ones((shards, items.shape[1]))
    placed = np.zeros(len(items), dtype=np.int64)
    for i in np.lexsort((items.sum(axis=1), items.max(axis=1)))[::-1]:
        gain = residual @ items[i]
        fits = (residual >= items[i]).all(axis=1)
        if fits.any():
            gain = np.where(fits, gain, -np.inf)
        placed[i] = gain.argmax()
        residual[placed[i]] -= items[i]
    return placed


def pack(docs: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot of every document."""
    spark = docs.sparkSession
    slim = written(measure(docs))
    total = slim.agg(*sums()).first()
    capacity = np.maximum(np.array([total["bytes"] or 0, total["tokens"] or 0, total["rows"]], dtype=float), 1.0) / shards

    share = F.greatest(*(F.col(c) / float(x) for c, x in zip(("bytes", "tokens", "rows"), capacity, strict=True)))
    # At most fine * shards groups exceed the limit in each of the three sums, so this table is bounded.
    large = slim.groupBy("group").agg(*sums()).select("group", share.alias("share")).where(F.col("share") > 1.0 / fine)
    tagged = slim.join(F.broadcast(large), "group", "left")
    pieces = F.ceil(F.col("share") * fine)
    small = F.concat(F.lit("h"), F.pmod(F.xxhash64("group", F.lit(1)), F.lit(shards * fine)).cast("string"))
    piece = F.concat_ws("/", F.concat(F.lit("g"), F.col("group").cast("string")), F.pmod(F.xxhash64("row"), pieces).cast("string"))
    whole = F.concat(F.lit("g"), F.col("group").cast("string"))
    parcel = F.when(F.col("share").isNull(), small).otherwise(piece)
    item = F.when(F.col("share").isNull(), small).when(F.col("share") > WHOLE, piece).otherwise(whole)
    tagged = tagged.select("doc_id", "size", "text_crc32", "tokens", "row", parcel.alias("parcel"), item.alias("item"))

    # One row for each parcel; their number is bounded by shards * fine as above.
    parcels = tagged.groupBy("parcel", "item").agg(*sums()).toPandas().sort_values("parcel", ignore_index=True)
    items = parcels.groupby("item", sort=True)[["bytes", "tokens", "rows"]].sum()
    shard_of = dict(zip(items.index, place(items.to_numpy(dtype=float) / capacity, shards).tolist(), strict=True))
    parcels["shard"] = [shard_of[x] for x in parcels["item"]]
    parcels["first_slot"] = parcels.groupby("shard")["rows"].cumsum() - parcels["rows"]
    rows = [(p, int(s), int(f)) for p, s, f in zip(parcels["parcel"], parcels["shard"], parcels["first_slot"], strict=True)]

    assigned = tagged.join(F.broadcast(spark.createDataFrame(rows, ASSIGNED)), "parcel")
    inside = F.row_number().over(Window.partitionBy("parcel").orderBy("doc_id", "row")) - 1
    return assigned.select(
        "doc_id", "size", "text_crc32", "tokens", "shard", (F.col("first_slot") + inside).cast("long").alias("slot")
    )


def op1_vector_packing(spark: SparkSession, directory: str) -> DataFrame:
    packed = pack(read(spark, directory, "documents"))
    return packed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )
