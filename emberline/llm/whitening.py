"""Whitening of embeddings by a covariance weighted with multiplicities.

Equal vectors are grouped and counted first. The fit takes every distinct vector once with a weight: one, or its
count (`weights`). Their weighted mean, and then the products of the centred vectors, are summed by matrix products
inside tasks; only one table of dimension by dimension reaches the driver, which finds its unit eigenvectors. Each
distinct vector is whitened once, and all rows get the result of theirs by a join.

Vectors are integers, floor(64 * x) + 1,000,000 of each component, so sums and deviations are exact. `deviation` of a
vector is the sum of (n * x - S)^2 over its dimensions, n the sum of weights and S that of the weighted vectors; it and
S must fit a long, else Spark fails with an overflow.

A vector that holds more than one in `SHARE` of all rows is hot. There are at most `SHARE` of those, so they are joined
by a broadcast table and the others by an exchange; no task gets all rows of one vector.

Defined results: vectors that are null, or hold a null or non-finite component, are dropped. Missing components of a
shorter vector count as zero. Repeated rows stay, each with its result. Directions in which the vectors do not vary
have no whitened value and are left out, so that one distinct vector gives no rows, nor does an empty table. Equal
eigenvalues may come in any order. All columns are kept in the struct `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import read, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: A vector of more than one in so many rows is hot.
SHARE = 1000
#: An eigenvalue below this part of the largest counts as zero.
LEAST_EIGENVALUE = 1e-10


def whole_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """row (a struct of all columns) and x, the integer components, of the vectors that take part."""
    value = F.col(column)
    bad = F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ints = F.transform(value, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")) + F.lit(OFFSET))
    return vectors.where(value.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.struct("*").alias("row"), ints.alias("x"))


def padded(column: pd.Series, width: int) -> np.ndarray:
    out = np.full((len(column), width), OFFSET, dtype=np.int64)
    for i, values in enumerate(column):
        out[i, : len(values)] = values
    return out


def weighted_sums(distinct: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """The sum of weights and the exact weighted sum of each dimension."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(width, dtype=np.int64)
        for frame in frames:
            w = frame["weight"].to_numpy()
            n += int(w.sum())
            total += w @ padded(frame["x"], width)
        if n:
            yield pd.DataFrame({"dimension": np.arange(-1, width), "total": np.concatenate([[n], total])})

    parts = distinct.select("x", "weight").mapInPandas(task, "dimension int, total long")
    sums = {r[0]: r[1] for r in parts.groupBy("dimension").agg(F.sum("total")).collect()}
    return sums[-1], np.array([sums[i] for i in range(width)], dtype=np.int64)


def centred_products(frame_of: DataFrame, centred, width: int) -> np.ndarray:  # noqa: ANN001
    """The sum over all rows of weight times the outer product of `centred(frame)`, by matrix products in tasks."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, some = np.zeros((width, width)), False
        for frame in frames:
            d = centred(frame)
            total += (d * frame["weight"].to_numpy()[:, None]).T @ d
            some = True
        if some:
            yield pd.DataFrame({"i": np.arange(width), "line": list(total)})

    def merge(lines: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": lines["i"].iloc[:1], "line": [np.sum(lines["line"].to_list(), axis=0)]})

    lines = frame_of.mapInPandas(task, "i int, line array<double>").groupBy("i").applyInPandas(merge, "i int, line array<double>")
    out = np.zeros((width, width))
    for r in lines.collect():
        out[r["i"]] = r["line"]
    return out


def directions(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors as columns by falling eigenvalue, their eigenvalues, and these as shares of the trace."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > LEAST_EIGENVALUE * max(values[0], 0.0)).sum()))
    return vectors[:, :kept], values[:kept], values[:kept] / np.trace(covariance)


def whitened_vectors(distinct: DataFrame, n: int, sums: np.ndarray, axes: np.ndarray, values: np.ndarray) -> DataFrame:
    """x, times, weight, deviation and the whitened components of every distinct vector."""
    width = len(sums)
    base = sums // n
    shared = distinct.sparkSession.sparkContext.broadcast((base, (sums - n * base) / n, axes / np.sqrt(values)))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, rest, scaled = shared.value
        for frame in frames:
            x = padded(frame["x"], width) - base
            # n * (base + x) - sums, in whole numbers; Spark sums the squares, as it notices an overflow.
            gaps = n * x - (sums - n * base)
            yield frame.assign(gaps=list(gaps), whitened=list((x - rest) @ scaled))

    schema = "x array<long>, times long, weight long, gaps array<long>, whitened array<double>"
    made = distinct.select("x", "times", "weight").mapInPandas(batches, schema)
    deviation = F.aggregate("gaps", F.lit(0).cast("long"), lambda a, g: a + g * g)
    return made.select("x", "times", "weight", deviation.alias("deviation"), "whitened")


def joined_back(rows: DataFrame, made: DataFrame, n_rows: int) -> DataFrame:
    """Every row with what its vector got."""
    hot = made.where(F.col("times") * SHARE > n_rows).drop("times", "weight")
    # At most SHARE vectors can each hold more than one in SHARE rows.
    marked = rows.join(F.broadcast(hot), "x", "left")
    common = marked.where(F.col("whitened").isNull()).select("row", "x").join(made.drop("times", "weight"), "x")
    columns = ("row", "x", "deviation", "whitened")
    return marked.where(F.col("whitened").isNotNull()).select(*columns).union(common.select(*columns))


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """row, x, n, deviation, whitened (an array), explained (an array) and identity_error of every row that takes part.

    `weights` is `one` or `count`. `identity_error` is the largest absolute entry of the whitened vectors' covariance,
    with the same weights, less the identity.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights is 'one' or 'count'")
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, column)
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("times"))
    distinct = written(counted.withColumn("weight", F.col("times") if weights == "count" else F.lit(1).cast("long")))
    size = distinct.agg(F.sum("times").alias("rows"), F.max(F.size("x")).alias("width")).first()
    if not size["width"]:
        doubles = T.ArrayType(T.DoubleType())
        kinds = {"x": T.ArrayType(T.LongType()), "n": T.LongType(), "deviation": T.LongType(), "whitened": doubles, "explained": doubles, "identity_error": T.DoubleType()}
        return spark.createDataFrame([], T.StructType([rows.schema["row"], *(T.StructField(name, kind) for name, kind in kinds.items())]))
    n, sums = weighted_sums(distinct, size["width"])
    width, base = size["width"], sums // n
    rest = (sums - n * base) / n
    products = centred_products(distinct.select("x", "weight"), lambda f: (padded(f["x"], width) - base) - rest, width)
    axes, values, explained = directions(products / n, components)
    made = written(whitened_vectors(distinct, n, sums, axes, values))
    found = made.select("whitened", "weight")
    kept = len(values)
    mean = found.select(F.posexplode("whitened").alias("at", "value"), "weight").groupBy("at").agg((F.sum(F.col("value") * F.col("weight")) / n).alias("mean"))
    means = np.zeros(kept)
    for r in mean.collect():
        means[r["at"]] = r["mean"]
    spread = centred_products(found, lambda f: np.stack(f["whitened"].to_list()) - means, kept) / n if kept else np.zeros((0, 0))
    error = float(np.abs(spread - np.eye(kept)).max()) if kept else 0.0
    joined = joined_back(rows, made, size["rows"])
    return joined.select(
        "row", "x", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*(F.lit(float(e)) for e in explained)).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_weighted_whitening(spark: SparkSession, directory: str) -> DataFrame:
    found = whiten(read(spark, directory, "embeddings").select("vec_id", "embedding"))
    each = found.select("row.vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )
