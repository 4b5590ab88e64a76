"""Exact top-k by inner product with a pivot table.

Vectors are integers: floor(1024 * x) of each component. Lifted by one coordinate, candidates all get the length of
the longest vector, so that the highest inner product is the smallest Euclidean distance. Distances of every vector to
`PIVOTS` pivots are computed once. For a query and a candidate, the largest difference of their distances to a pivot
is a lower bound of their distance, and so an upper bound of the score. Candidates are evaluated in order of bounds
until the bound is below the k-th score. Bounds are loosened by more than the rounding of doubles, and scores are
computed on integers, so the result is exact.

Queries meet candidates in blocks of `BLOCK` rows each: a task holds one block of either. The k best of each block are
merged by query.

Defined results: vectors that are null, or hold a null or non-finite component, take no part. Missing components of
a shorter vector count as zero. A row is never its own candidate, but an equal row is. Ties go to the smaller vec_id.
No vectors give no rows. Scores are 64-bit. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import read, written

SCALE = 1024
TOP = 10
EVERY = 100
PIVOTS = 32
#: Rows of a block of queries or candidates.
BLOCK = 4096
#: Queries whose bounds a task holds at once, and candidates evaluated between two looks at the bound.
TOGETHER, STEP = 64, 256

FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """row, vec_id and the integer components of the vectors that take part."""
    value = F.col("embedding")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(value, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return (
        vectors.where(value.isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", ints.alias("v"))
    )


def matrix(column: pd.Series, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=kind)
    for i, values in enumerate(column):
        out[i, : len(values)] = values
    return out


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The coordinate that brings each vector to the square length `longest`."""
    return np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", vectors, vectors), 0.0))


def pivot_table(rows: DataFrame, pivots: np.ndarray, longest: float) -> DataFrame:
    """`near`: distances of each lifted vector to the lifted pivots; `asked`: those of the vector as a query."""
    width = pivots.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((pivots, lift(pivots, longest)))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, heights = shared.value
        for frame in frames:
            v = matrix(frame["v"], width, float)
            square = ((v[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
            frame["near"] = list(np.sqrt(square + (lift(v, longest)[:, None] - heights) ** 2))
            frame["asked"] = list(np.sqrt(square + heights**2))
            yield frame

    return rows.mapInPandas(batches, "row long, vec_id long, v array<long>, near array<double>, asked array<double>")


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, width: int, longest: float, top: int) -> pd.DataFrame:
    """The best candidates of a block for each query of a block."""
    if not len(queries) or not len(candidates):
        return pd.DataFrame({name: pd.Series(dtype=np.int64) for name in ("query_row", "query_id", "row", "vec_id", "score")})
    q, x = matrix(queries["v"], width, np.int64), matrix(candidates["other_v"], width, np.int64)
    asked, near = np.stack(queries["asked"].to_list()), np.stack(candidates["near"].to_list())
    ids, rows = candidates["other_id"].to_numpy(), candidates["other_row"].to_numpy()
    square = np.einsum("ij,ij->i", q.astype(float), q.astype(float))
    found = []
    for start in range(0, len(q), TOGETHER):
        some = slice(start, start + TOGETHER)
        low = np.zeros((len(q[some]), len(x)))
        for p in range(near.shape[1]):
            np.maximum(low, np.abs(asked[some, p, None] - near[None, :, p]), out=low)
        total = (square[some] + longest)[:, None]
        bounds = (total - low**2) / 2 + 1e-9 * total + 1
        for i, bound in enumerate(bounds):
            number = start + i
            bound[rows == queries["row"].iat[number]] = -np.inf
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] > -np.inf]
            best, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for at in range(0, len(order), STEP):
                if len(best) == top and bound[order[at]] < scores[-1]:
                    break
                more = order[at : at + STEP]
                best, scores = np.concatenate([best, more]), np.concatenate([scores, x[more] @ q[number]])
                kept = np.lexsort((rows[best], ids[best], -scores))[:top]
                best, scores = best[kept], scores[kept]
            found.append(
                pd.DataFrame(
                    {"query_row": queries["row"].iat[number], "query_id": queries["vec_id"].iat[number], "row": rows[best], "vec_id": ids[best], "score": scores}
                )
            )
    return pd.concat(found, ignore_index=True)


def top_products(vectors: DataFrame, is_query: Column, top: int = TOP, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the highest inner products of the rows that `is_query` holds for."""
    spark = vectors.sparkSession
    whole = written(whole_vectors(vectors))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = whole.agg(F.max(norm).alias("longest"), F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("queries")).first()
    if not stats["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, longest = max(stats["width"], 1), float(stats["longest"])
    points = whole.orderBy(F.xxhash64("row"), "row").limit(pivots).toPandas()
    table = written(pivot_table(whole, matrix(points["v"], width, float), longest))

    candidate_blocks, query_blocks = -(-stats["n"] // block), -(-stats["queries"] // block)
    own = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = table.where(is_query).select("row", "vec_id", "v", "asked", own(query_blocks).alias("qb"), every(candidate_blocks).alias("cb"))
    # Columns of their own: Spark prunes both sides of a cogroup by the same attributes.
    other = [F.col(c).alias(n) for c, n in (("row", "other_row"), ("vec_id", "other_id"), ("v", "other_v"))]
    candidates = table.select(*other, "near", own(candidate_blocks).alias("cb"), every(query_blocks).alias("qb"))
    found = (
        queries.groupBy("qb", "cb")
        .cogroup(candidates.groupBy("qb", "cb"))
        .applyInPandas(lambda q, c: search_block(q, c, width, longest, top), FOUND)
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_pivot_table(spark: SparkSession, directory: str) -> DataFrame:
    return top_products(read(spark, directory, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


OP9_SQL = f"""
WITH whole AS (
    SELECT vec_id, row_number() OVER () AS row, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, q.row AS query_row, x.vec_id, x.row,
           list_inner_product(q.v, x.v)::BIGINT AS score
    FROM whole q JOIN whole x ON q.row <> x.row WHERE q.vec_id % {EVERY} = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
