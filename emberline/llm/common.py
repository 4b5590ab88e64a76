"""What the operators share: reading tables, written intermediate tables, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from emberline.session import ensure_checkpoint_dir, table_path, tune

#: A word is a run of anything but the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: Rows of a batch that goes to Python; texts may be long.
BATCH_ROWS = 1000
BATCH_LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """`df` in a session of its own with small Arrow batches; the caller's session keeps its limit.

    The limit is read when a frame runs, which may be long after it was made.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_LIMIT) == str(BATCH_ROWS):
        return df
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(BATCH_LIMIT, BATCH_ROWS)
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan())
    return DataFrame(rows, own)


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(table_path(directory, name))


def written(df: DataFrame) -> DataFrame:
    """Write `df` once under the shared checkpoint folder and go on from the files.

    Every consumer and every retried task then sees the same rows, and lost executors cost no more than a re-read.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/emberline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_batch(df: DataFrame, inputs: list[str], added: list[T.StructField], make: Callable[[], Callable]) -> DataFrame:
    """All columns of `df` and those of `added`, computed in Python a batch at a time; columns of those names go.

    `make` is called once in each task; what it returns gets a list for each input column and returns one for each
    added column. Other columns pass as Arrow data, whatever their types and nulls.
    """
    df = small_batches(df)
    names = [f.name for f in added]
    kept = [f for f in df.schema if f.name not in names]
    types = [to_arrow_type(f.dataType) for f in added]

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in arrived:
            made = compute(*(batch.column(name).to_pylist() for name in inputs))
            arrays = [batch.column(f.name) for f in kept] + [pa.array(v, type=t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + names)

    return df.mapInArrow(batches, T.StructType(kept + added))


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Number rows from 0 in one global order, by range partitions and their counts; never in one task.

    The table of counts has one row per range partition. The ranges are written, as sampling may cut them
    elsewhere in another run of the same plan.
    """
    from pyspark.sql import Window

    part, inside, before = f"{name}_part", f"{name}_inside", f"{name}_before"
    ranged = written(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()))
    inside_part = Window.partitionBy(part).orderBy(order)
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    numbered = ranged.withColumn(inside, F.row_number().over(inside_part) - 1)
    return numbered.join(offsets, part).withColumn(name, F.col(before) + F.col(inside)).drop(part, inside, before)
