"""Per-segment isotonic calibration, reliability and confidence bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.scalar import let
from emberline.operators.ordered import quantiles_of_counts, right_closed_bin
from emberline.session import settle


def with_global(counts: DataFrame, segment: str) -> DataFrame:
    """The rows once under their segment and once under the global key."""
    keys = F.explode(F.array(F.col(segment), F.lit(K.GLOBAL_SEGMENT)))
    return counts.withColumn("_key", keys).drop(segment).withColumnRenamed("_key", segment)


BLOCKS = "segment string, part int, x_lo double, x_hi double, w double, y double"
#: Blocks on either side of an edge between two score ranges that one task pools.
EDGE_BLOCKS = 256


def pooled(x_lo: np.ndarray, x_hi: np.ndarray, w: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring blocks pooled until their means rise: every falling or level run at once, again while there is one.

    Pooling is associative, so blocks may be pooled in parts first, in any order.
    """
    while len(w) > 1:
        starts = np.flatnonzero(np.append(True, y[:-1] * w[1:] < y[1:] * w[:-1]))
        if len(starts) == len(w):
            break
        ends = np.append(starts[1:], len(w)) - 1
        x_lo, x_hi, w, y = x_lo[starts], x_hi[ends], np.add.reduceat(w, starts), np.add.reduceat(y, starts)
    return x_lo, x_hi, w, y


def pool_group(frame: pd.DataFrame) -> pd.DataFrame:
    """The pooled blocks of some neighbours; a block stays in the range in which it starts."""
    frame = frame.sort_values("x_lo", kind="stable")
    x_lo, x_hi, w, y = pooled(*(frame[c].to_numpy(dtype=float) for c in ("x_lo", "x_hi", "w", "y")))
    part = frame["part"].to_numpy()[np.searchsorted(frame["x_lo"].to_numpy(), x_lo)]
    return pd.DataFrame({"segment": frame["segment"].iloc[0], "part": part, "x_lo": x_lo, "x_hi": x_hi, "w": w, "y": y})


def falling_edges(blocks: DataFrame) -> DataFrame:
    """(segment, part, other) of neighbouring ranges whose last and first block do not rise; a row for each range at most."""
    block = F.struct("w", "y")
    ends = blocks.groupBy("segment", "part").agg(F.min_by(block, "x_lo").alias("first"), F.max_by(block, "x_lo").alias("last"))
    following = W.partitionBy("segment").orderBy("part")
    paired = ends.select("segment", "part", "last", F.lead("part").over(following).alias("other"), F.lead("first").over(following).alias("next"))
    return paired.where(F.col("last.y") * F.col("next.w") >= F.col("next.y") * F.col("last.w")).select("segment", "part", "other")


def merged_edges(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """The blocks with those next to the given edges pooled over them, at most `EDGE_BLOCKS` from either side; written.

    No range may stand in two edges. Blocks further from an edge are not touched.
    """
    sides = edges.select("segment", "part", F.col("part").alias("edge"), F.lit(-1).alias("side")).union(
        edges.select("segment", F.col("other").alias("part"), F.col("part").alias("edge"), F.lit(1).alias("side"))
    )
    marked = blocks.join(sides, ["segment", "part"], "left")
    # A range holds the blocks that one task has pooled.
    place = F.row_number().over(W.partitionBy("segment", "part").orderBy(F.col("x_lo") * F.coalesce("side", F.lit(1))))
    marked = settle(marked.withColumn("near", F.col("side").isNotNull() & (place <= EDGE_BLOCKS)))
    names = ["segment", "part", "x_lo", "x_hi", "w", "y"]
    pooled_blocks = marked.where("near").select(*names, "edge").groupBy("segment", "edge").applyInPandas(lambda f: pool_group(f), BLOCKS)
    return settle(marked.where("not near").select(*names).union(pooled_blocks))


def fit_calibrators(df: DataFrame, segment: str, score: str, label: str) -> DataFrame:
    """Isotonic step function per segment and for the whole: (segment, x_lo, x_hi, value, weight).

    Scores are grouped, cut into ranges and pooled inside each. Then the edges between neighbouring ranges are pooled,
    every other edge in a round, until all edges rise: pooling changes nothing further away, so no task sees a whole
    segment, whatever its size. Wherever the ranges are cut, the fit is the same.
    """
    counts = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(segment).cast("string").alias("segment"), F.col(score).cast("double").alias("x_lo"))
        .agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum(F.col(label).cast("double")).alias("y"))
    )
    both = with_global(counts, "segment").groupBy("segment", "x_lo").agg(F.sum("w").alias("w"), F.sum("y").alias("y"))
    ranged = settle(both.repartitionByRange("segment", "x_lo").withColumn("part", F.spark_partition_id()))
    points = ranged.select("segment", "part", "x_lo", F.col("x_lo").alias("x_hi"), "w", "y")
    blocks = settle(points.groupBy("segment", "part").applyInPandas(lambda f: pool_group(f), BLOCKS))
    turn = 0
    while True:
        edges = settle(falling_edges(blocks))
        if edges.isEmpty():
            break
        # Edges of even and of odd ranges in turn, by their place in the segment.
        numbered = blocks.select("segment", "part").distinct().withColumn("n", F.row_number().over(W.partitionBy("segment").orderBy("part")))
        chosen = edges.join(numbered.where(F.col("n") % 2 == turn % 2).drop("n"), ["segment", "part"])
        blocks = merged_edges(blocks, chosen)
        turn += 1
    value = F.least(F.greatest(F.col("y") / F.col("w"), F.lit(0.0)), F.lit(1.0))
    return blocks.select("segment", "x_lo", "x_hi", value.alias("value"), F.col("w").cast("long").alias("weight"))


def calibrator_arrays(calibrators: DataFrame) -> DataFrame:
    """One row per segment: the thresholds as an ordered array of (x, y)."""
    ends = F.when(
        F.col("x_lo") < F.col("x_hi"),
        F.array(F.struct(F.col("x_lo").alias("x"), "value"), F.struct(F.col("x_hi").alias("x"), "value")),
    ).otherwise(F.array(F.struct(F.col("x_lo").alias("x"), "value")))
    return calibrators.groupBy("segment").agg(F.array_sort(F.flatten(F.collect_list(ends))).alias("knots"))


def interpolate(knots: Column, x: Column) -> Column:
    """Piecewise-linear value between knots, flat outside them. Pass columns, not expressions."""

    def between(point: Column) -> Column:
        left, right, v = point["left"], point["right"], point["v"]
        share = F.try_divide(v - left["x"], right["x"] - left["x"])
        return F.when(share.isNull() | (v < left["x"]), left["value"]).otherwise(
            F.when(share >= 1, right["value"]).otherwise(left["value"] + (right["value"] - left["value"]) * share)
        )

    def neighbours(v: Column) -> Column:
        # The knots are sorted, so those at or below v are the first ones; halving finds their number.
        halves = F.slice(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), 32 - F.length(F.bin(F.size(knots))), F.length(F.bin(F.size(knots))))
        below = F.aggregate(halves, F.lit(0), lambda n, half: F.when(F.get(knots, n + half - 1)["x"] <= v, n + half).otherwise(n))
        return let(
            below,
            lambda n: F.struct(
                v.alias("v"),
                F.element_at(knots, F.greatest(n, F.lit(1))).alias("left"),
                F.element_at(knots, F.least(n + 1, F.size(knots))).alias("right"),
            ),
        )

    return F.when(x.isNotNull(), let(x, lambda v: let(neighbours(v), between)))


def with_segment_rows(df: DataFrame, segment: str, per_segment: DataFrame, payload: str) -> DataFrame:
    """Attach the segment's payload, else the global one."""
    fallback = per_segment.where(F.col("segment") == K.GLOBAL_SEGMENT).select(payload).scalar()
    keyed = per_segment.select(F.col("segment").alias("_seg"), F.col(payload).alias("_own"))
    joined = df.join(keyed, F.col(segment).cast("string") == F.col("_seg"), "left")
    return joined.withColumn(payload, F.coalesce("_own", fallback)).drop("_seg", "_own")


def knots_of(calibrators: DataFrame) -> DataFrame:
    """(segment, x, value) at both ends of every block."""
    ends = F.array_distinct(F.array("x_lo", "x_hi"))
    return calibrators.select("segment", F.explode(ends).alias("x"), "value")


def apply_calibration(
    df: DataFrame, calibrators: DataFrame, segment: str, score: str, name: str = "calibrated_pd"
) -> DataFrame:
    """Step function of the row's segment, the global one where the segment has none.

    Knots and scores are dealt together by (segment, score range). Inside a range a score takes its value from the
    nearest knots on either side; ranges without a knot on one side get that of the nearest range that has one, from a
    table with a row for each range.
    """
    knots = settle(knots_of(calibrators))
    # One row for each segment of the model; a table of segments has no bound, so the join is Spark's choice.
    known = knots.select(F.col("segment").alias("_known")).distinct()
    keyed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(segment).cast("string").alias("_own"), F.col(score).cast("double").alias("x"))
    keyed = keyed.join(known, F.col("_own") == F.col("_known"), "left").withColumn("segment", F.coalesce("_known", F.lit(K.GLOBAL_SEGMENT)))
    kind = keyed.schema["_row"].dataType
    rows = keyed.where(F.col("x").isNotNull() & ~F.isnan("x")).select("segment", "x", "_row", F.lit(None).cast("struct<x:double,value:double>").alias("k"))
    points = knots.select("segment", "x", F.lit(None).cast(kind).alias("_row"), F.struct("x", "value").alias("k"))
    # Scores of one value may be many: a hash of the row deals them over further ranges.
    ranged = settle(rows.withColumn("_deal", F.rand(7)).union(points.withColumn("_deal", F.lit(-1.0))).repartitionByRange("segment", "x", "_deal").withColumn("_part", F.spark_partition_id()))
    has = F.when(F.col("k").isNotNull(), F.col("k"))
    ends = ranged.groupBy("segment", "_part").agg(F.min_by(has, F.when(has.isNotNull(), F.col("x"))).alias("first"), F.max_by(has, F.when(has.isNotNull(), F.col("x"))).alias("last"))
    ordered, backwards = W.partitionBy("segment").orderBy("_part"), W.partitionBy("segment").orderBy(F.desc("_part"))
    around = ends.select(
        "segment", "_part",
        F.last("last", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.last("first", ignorenulls=True).over(backwards.rowsBetween(W.unboundedPreceding, -1)).alias("_after"),
    )
    inside = W.partitionBy("segment", "_part")
    left = F.last("k", ignorenulls=True).over(inside.orderBy("x", "_deal").rowsBetween(W.unboundedPreceding, 0))
    # Read backwards, as Spark computes a frame that ends with the partition anew for each row.
    right = F.last("k", ignorenulls=True).over(inside.orderBy(F.desc("x"), F.desc("_deal")).rowsBetween(W.unboundedPreceding, -1))
    near = ranged.withColumns({"_l": left, "_r": right}).where(F.col("_row").isNotNull()).join(around, ["segment", "_part"])
    near = near.select("_row", "x", F.coalesce("_l", "_before").alias("l"), F.coalesce("_r", "_after").alias("r"))
    share = F.try_divide(F.col("x") - F.col("l.x"), F.col("r.x") - F.col("l.x"))
    value = F.when(F.col("l").isNull(), F.col("r.value")).when(F.col("r").isNull() | share.isNull(), F.col("l.value")).otherwise(
        F.col("l.value") + (F.col("r.value") - F.col("l.value")) * share
    )
    without = keyed.where(F.col("x").isNull() | F.isnan("x")).select("_row", F.lit(None).cast("double").alias(name))
    kept = [c for c in df.columns if c != name]
    return near.select("_row", value.alias(name)).union(without).select(*[F.col("_row").getField(c).alias(c) for c in kept], name)


def reliability_table(df: DataFrame, label: str, score: str, n_bins: int = 10) -> DataFrame:
    """Quantile bins: mean predicted, observed rate, rows."""
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("w"), F.sum(F.col(label).cast("double")).alias("y"))
    )
    probabilities = [i / n_bins for i in range(n_bins + 1)]
    # n_bins + 1 numbers come to the driver, whatever the size of the table.
    found = quantiles_of_counts(counts, "x", "w", probabilities).select(F.array_distinct("edges").alias("e")).first()
    edges = F.array(*[F.lit(e) for e in (found["e"] if found else [0.0])])
    bins = counts.withColumn("bin", right_closed_bin(F.col("x"), edges)).groupBy("bin").agg(
        (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean_predicted"),
        (F.sum("y") / F.sum("w")).alias("observed_rate"),
        F.sum("w").alias("n"),
    )
    return bins


def fit_confidence_bands(
    df: DataFrame, segment: str, pd_column: str, label: str, n_bins: int = K.BAND_BINS
) -> DataFrame:
    """(segment, band_no, lo, hi, half_width, n) over evaluable rows, per segment and overall."""
    counts = (
        df.where(F.col(pd_column).isNotNull())
        .groupBy(F.col(segment).cast("string").alias("segment"), F.col(pd_column).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("w"), F.sum(F.col(label).cast("double")).alias("y"))
    )
    both = with_global(counts, "segment").groupBy("segment", "x").agg(F.sum("w").alias("w"), F.sum("y").alias("y"))
    probabilities = [i / n_bins for i in range(n_bins + 1)]
    quantiles = quantiles_of_counts(both, "x", "w", probabilities, ["segment"])
    ends = F.array(F.element_at("edges", 1), F.element_at("edges", -1))
    edges = F.array_distinct(F.when(F.col("total") < K.MIN_ROWS_FOR_BINS, ends).otherwise(F.col("edges")))
    binned = both.join(quantiles.select("segment", edges.alias("edges")), "segment")
    binned = binned.withColumn("bin", right_closed_bin(F.col("x"), F.col("edges")))
    rows = binned.groupBy("segment", "bin", "edges").agg(
        F.sum("w").alias("n"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("w")).alias("xs")
    )
    observed, mean = F.col("y") / F.col("n"), F.col("xs") / F.col("n")
    smoothed = (F.col("y") + 1.0) / (F.col("n") + 2.0)
    width = F.abs(observed - mean) + F.lit(K.Z_95) * F.sqrt(smoothed * (1.0 - smoothed) / F.col("n"))
    # At most n_bins rows per segment from here on.
    order = W.partitionBy("segment").orderBy("bin")
    size = F.count(F.lit(1)).over(W.partitionBy("segment"))
    number = F.row_number().over(order)
    upper = F.element_at("edges", F.least(F.col("bin") + 2, F.size("edges")))
    return rows.select(
        "segment",
        number.alias("band_no"),
        F.when(number == 1, F.lit(0.0)).otherwise(F.element_at("edges", F.col("bin") + 1)).alias("lo"),
        F.when(number == size, F.lit(1.0)).otherwise(upper).alias("hi"),
        F.round(width, 5).alias("half_width"),
        "n",
    )


def confidence_band(df: DataFrame, bands: DataFrame, segment: str, pd_column: str) -> DataFrame:
    """Attach `band` (half_width, n_comparable, wide_band_flag): first covering band, else nearest."""
    entry = F.struct("band_no", "lo", "hi", "half_width", "n")
    per_segment = settle(bands).groupBy("segment").agg(F.array_sort(F.collect_list(entry)).alias("bands"))
    attached = with_segment_rows(df, segment, per_segment, "bands")
    pd_value = F.col(pd_column).cast("double")
    covering = F.filter("bands", lambda b: (b["lo"] <= pd_value) & (pd_value <= b["hi"]))
    by_distance = F.array_min(
        F.transform(
            "bands",
            lambda b: F.struct(F.abs((b["lo"] + b["hi"]) / 2.0 - pd_value).alias("gap"), b.alias("b")),
        )
    )["b"]
    picked = F.when(F.size(covering) > 0, F.element_at(covering, 1)).otherwise(by_distance)
    band = F.struct(
        picked["half_width"].alias("half_width"),
        picked["n"].alias("n_comparable"),
        ((picked["half_width"] > K.WIDE_HALF_WIDTH) | (picked["n"] < K.MIN_COMPARABLE)).alias("wide_band_flag"),
    )
    return attached.withColumn("band", band).drop("bands")
