"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources share `SHARE` times all words by weight; a source's target stops at `MOST_EPOCHS` times its
own words, and the excess is shared again by weight until no source is above. Sources are weighed in order of code
points, null last, by `WEIGHTS` in turn.

A source first passes whole as often as its target holds it. What is left of the target is a fraction of an epoch:
each document draws the exponential key -ln(u) / quality, and documents are taken in order of the key until the
prefix sum of their words meets the budget; the document that crosses the budget is taken if that comes nearer to
it. u comes from an md5 of the document, so reruns agree.

The prefix sum does not sort a source in one task: the key alone puts a document into one of `BUCKETS` buckets, sums
by source and bucket find the bucket in which the budget ends, and only that bucket is sorted.

Defined results: a null text has no words. Null sources are one source. A document without words takes part with
size 0 and takes nothing. Equal rows are separate documents with equal keys, in whichever order. No documents give
no rows. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import global_rank, read, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Buckets of keys in a source; one of them is sorted.
BUCKETS = 1024
#: The lowest quality weight; the highest is 1.
LEAST_QUALITY = 0.25
SEED = "mix"


def quality() -> Column:
    """Weight of a document from LEAST_QUALITY to 1: the share of letters among its characters but ASCII spaces."""
    solid = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    share = F.when(solid > 0, letters / solid).otherwise(F.lit(0.0))
    return LEAST_QUALITY + (1 - LEAST_QUALITY) * F.coalesce(share, F.lit(0.0))


def uniform() -> Column:
    """A number in (0, 1) drawn by hash from the document."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digest = F.md5(F.concat_ws(":", F.lit(SEED), name, F.md5(F.coalesce("text", F.lit("")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def measure(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, key, the bucket of the key, and `more`."""
    keyed = docs.select(*more, "doc_id", "source", word_count(F.col("text")).alias("size"), (-F.ln(uniform()) / quality()).alias("key"))
    # Grows with the key alone; no bucket expects more than BUCKETS ** -1 / LEAST_QUALITY of a source.
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") * LEAST_QUALITY)) * BUCKETS), F.lit(BUCKETS - 1))
    return keyed.withColumn("bucket", bucket.cast("int"))


def source_targets(slim: DataFrame, weights: tuple, share: float, most: int) -> DataFrame:
    """source, source_size, target. The driver holds two sums of each round, never the sources."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sizes, F.col("source").asc_nulls_last(), "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights))
    sources = written(ranked.select("source", "source_size", weight.alias("weight")))
    top = most * F.col("source_size")
    wanted = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        full = top <= level * F.col("weight")
        sums = sources.agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("held"),
            F.sum(F.when(full, top).otherwise(0)).alias("kept"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not sums["open"] or sums["held"] == held:
            break
        held = sums["held"]
        level = (wanted - sums["kept"]) / sums["open"]
    target = F.least(top.cast("double"), F.lit(float(level)) * F.col("weight"))
    return written(sources.select("source", "source_size", target.alias("target")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each document."""
    return drawn(measure(docs), weights, share, most)


def drawn(measured: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    slim = written(measured)
    targets = source_targets(slim, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.select("source", "source_size", "target", epochs.alias("epochs")).withColumn(
        "budget", F.col("target") - F.col("epochs") * F.col("source_size")
    )

    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = totals.withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    plain = plan.withColumnRenamed("source", "plan_source")
    ends = totals.join(plain, totals["source"].eqNullSafe(plain["plan_source"]))
    ends = ends.where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("bucket_size") >= F.col("budget")))
    # The last bucket that the budget reaches; none where it takes nothing.
    ends = ends.groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("end"))
    ends = ends.select(F.col("source").alias("end_source"), F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("end_before"))
    limits = written(plain.join(ends, plain["plan_source"].eqNullSafe(ends["end_source"]), "left").drop("end_source"))

    rows = slim.join(limits, slim["source"].eqNullSafe(limits["plan_source"])).drop("plan_source")
    inside = F.coalesce(F.col("bucket") == F.col("end_bucket"), F.lit(False))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("end_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    sorted_rows = rows.where(inside).withColumn("more", (before + F.col("size") / 2 <= F.col("budget")).cast("int"))
    others = rows.where(~inside).withColumn("more", F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(False)).cast("int"))
    both = sorted_rows.unionByName(others)
    kept = [c for c in slim.columns if c not in ("key", "bucket")]
    return both.select(*kept, "source_size", "target", (F.col("epochs") + F.col("more")).cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """All columns of the documents, each row as often as the mix takes it."""
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("doc")
    taken = drawn(measure(docs, whole), weights, share, most).where(F.col("copies") > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op4_weighted_mix(spark: SparkSession, directory: str) -> DataFrame:
    mixed = mix(read(spark, directory, "documents"))
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


OP4_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS solid,
           length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS letters,
           ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS digest
    FROM documents
), keyed AS (
    SELECT doc_id, source, size,
           -ln((digest + 0.5::DOUBLE) / {16**12}::DOUBLE)
           / ({LEAST_QUALITY}::DOUBLE + {1 - LEAST_QUALITY}::DOUBLE * CASE WHEN solid > 0 THEN letters::DOUBLE / solid ELSE 0 END) AS key
    FROM sized
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
    FROM keyed GROUP BY source
), levels AS (
    SELECT *, ({SHARE} * sum(source_size) OVER () - coalesce(sum({MOST_EPOCHS} * source_size) OVER earlier, 0))::DOUBLE
              / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level, {MOST_EPOCHS} * source_size / weight AS full_at
    FROM sources
    WINDOW earlier AS (ORDER BY {MOST_EPOCHS} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
    SELECT coalesce(arg_min(level, full_at) FILTER (level <= full_at), 0) AS level FROM levels
), plan AS (
    SELECT source, source_size, least({MOST_EPOCHS} * source_size, water.level * weight)::DOUBLE AS target
    FROM sources, water
), parts AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM plan
), summed AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM keyed
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed JOIN parts ON summed.source IS NOT DISTINCT FROM parts.source
"""
