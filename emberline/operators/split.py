"""Ordered train / calib / test windows and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.operators.ordered import running_totals


def split_thresholds(
    df: DataFrame, id_column: str, train: float = K.TRAIN_FRACTION, calib: float = K.CALIB_FRACTION, weight: str | None = None
) -> DataFrame:
    """One row: the last id of the train and of the calib window, by row position.

    The position is floor(n · fraction) − 1 in double arithmetic, fractions added first. `weight` names how many rows
    a row stands for, so a table can be split before it is expanded.
    """
    counts = df.groupBy(id_column).agg((F.count(F.lit(1)) if weight is None else F.sum(F.col(weight).cast("long"))).alias("n"))
    ranked = running_totals(counts, id_column, ["n"])
    total = F.col("total_n")

    def last_id(fraction: float):
        # Position −1 means the last row, as in an index from the end.
        position = F.pmod(F.floor(total * F.lit(fraction)) - 1, total)
        inside = (F.col("cum_n") - F.col("n") <= position) & (position < F.col("cum_n"))
        return F.max(F.when(inside, F.col(id_column)))

    return ranked.agg(last_id(train).alias("train_end"), last_id(train + calib).alias("calib_end"))


def window_of(id_column: Column, train_end: Column, calib_end: Column) -> Column:
    return F.when(id_column <= train_end, "train").when(id_column <= calib_end, "calib").otherwise("test")


def oot_split(
    df: DataFrame, id_column: str, train: float = K.TRAIN_FRACTION, calib: float = K.CALIB_FRACTION, weight: str | None = None
) -> DataFrame:
    """Add `split`; all rows of one id fall in the same window."""
    ends = split_thresholds(df, id_column, train, calib, weight).select(F.struct("train_end", "calib_end").alias("e")).scalar()
    split = window_of(F.col(id_column), F.col("_ends.train_end"), F.col("_ends.calib_end"))
    return df.withColumn("_ends", ends).withColumn("split", split).drop("_ends")


def deterministic_sample(df: DataFrame, id_column: str, n_train: int, n_test: int, seed: int = 42) -> DataFrame:
    """n_train + n_test rows chosen by the md5 of seed and id, then the lower ids for training."""
    keyed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string"))))
    sample = keyed.orderBy("_h", id_column).limit(n_train + n_test).drop("_h")
    # The window runs over the sample only, whose size is the caller's.
    position = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(id_column))
    return sample.withColumn("split", F.when(position <= n_train, "train").otherwise("test"))
