"""Loan tables from delimited files, snapshots between jobs, and metric tables."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions.scalar import nan_to_null, tag_provenance

PROVENANCE = "public_proxy"

# File of each loan table, and its columns by source name as (name here, type).
LOAN_FILES = {
    "applications": "application_train.csv",
    "bureau": "bureau.csv",
    "previous_applications": "previous_application.csv",
    "installments": "installments_payments.csv",
}
LOAN_COLUMNS = {
    "applications": {
        "SK_ID_CURR": ("borrower_id", "bigint"),
        "TARGET": ("target", "int"),
        "NAME_CONTRACT_TYPE": ("contract_type", "string"),
        "ORGANIZATION_TYPE": ("organization_type", "string"),
        "AMT_CREDIT": ("credit", "double"),
        "AMT_INCOME_TOTAL": ("income", "double"),
        "AMT_ANNUITY": ("annuity", "double"),
        "EXT_SOURCE_1": ("ext_source_1", "double"),
        "EXT_SOURCE_2": ("ext_source_2", "double"),
        "EXT_SOURCE_3": ("ext_source_3", "double"),
        "DAYS_BIRTH": ("days_birth", "int"),
        "DAYS_EMPLOYED": ("days_employed", "int"),
    },
    "bureau": {
        "SK_ID_CURR": ("borrower_id", "bigint"),
        "CREDIT_ACTIVE": ("credit_active", "string"),
        "CREDIT_DAY_OVERDUE": ("credit_day_overdue", "int"),
    },
    "previous_applications": {
        "SK_ID_CURR": ("borrower_id", "bigint"),
        "SK_ID_PREV": ("loan_id", "bigint"),
    },
    "installments": {
        "SK_ID_CURR": ("borrower_id", "bigint"),
        "SK_ID_PREV": ("loan_id", "bigint"),
        "NUM_INSTALMENT_NUMBER": ("instalment_no", "int"),
        "DAYS_INSTALMENT": ("due_day", "int"),
        "DAYS_ENTRY_PAYMENT": ("paid_day", "int"),
    },
}

# Attributes of the whitespace-separated credit file, in file order, then the label.
CREDIT_ATTRIBUTES = (
    "checking_account_status",
    "duration_months",
    "credit_history",
    "purpose",
    "credit_amount",
    "savings_account",
    "employment_since",
    "installment_rate_pct_income",
    "personal_status_sex",
    "other_debtors",
    "residence_since",
    "property",
    "age_years",
    "other_installment_plans",
    "housing",
    "existing_credits_count",
    "job",
    "dependents_count",
    "telephone",
    "foreign_worker",
)
CREDIT_NUMERIC = (
    "duration_months",
    "credit_amount",
    "installment_rate_pct_income",
    "residence_since",
    "age_years",
    "existing_credits_count",
    "dependents_count",
)


def read_loan_table(
    spark: SparkSession, directory: str, name: str, columns: Sequence[str] | None = None, provenance: str = PROVENANCE
) -> DataFrame:
    """One loan table with the names and types used here; only the wanted columns are parsed.

    Fields are read as text by position and cast by name, since decimals such as `-31.0` stand for
    whole days in the files; what cannot be read becomes null.
    """
    path = os.path.join(directory, LOAN_FILES[name])
    header = spark.read.text(path).first()[0].strip().split(",")
    raw = spark.read.option("header", True).schema(", ".join(f"`{h}` string" for h in header)).csv(path)
    wanted = [
        F.col(f"`{source}`").try_cast("double").try_cast(kind).alias(target)
        if kind != "string"
        else F.col(f"`{source}`").alias(target)
        for source, (target, kind) in LOAN_COLUMNS[name].items()
        if source in header and (columns is None or target in columns)
    ]
    return tag_provenance(nan_to_null(raw.select(*wanted)), provenance)


def read_loan_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {name: read_loan_table(spark, directory, name) for name in LOAN_FILES}


def with_row_number(df: DataFrame, name: str = "row_id") -> DataFrame:
    """0-based number in file order. The only table gathered has one row per input partition."""
    marked = df.withColumns(
        {
            "_part": F.shiftright(F.monotonically_increasing_id(), 33),
            "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = marked.join(offsets, "_part")
    return joined.select((F.col("_at") + F.col("_offset")).alias(name), *df.columns)


def read_whitespace_table(
    spark: SparkSession,
    path: str,
    attributes: Sequence[str] = CREDIT_ATTRIBUTES,
    numeric: Sequence[str] = CREDIT_NUMERIC,
    provenance: str = PROVENANCE,
) -> DataFrame:
    """Headerless text split on white space: row_id, named attributes, target (label 2 → 1)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = F.split(F.trim("value"), r"\s+")
    numbered = with_row_number(lines.select(fields.alias("f")))
    columns = [
        F.get("f", F.lit(i)).try_cast("double").try_cast("int").alias(a) if a in numeric else F.get("f", F.lit(i)).alias(a)
        for i, a in enumerate(attributes)
    ]
    label = F.get("f", F.lit(len(attributes))).try_cast("int")
    return tag_provenance(numbered.select("row_id", *columns, (label == 2).cast("int").alias("target")), provenance)


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_snapshot(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_metrics(table: DataFrame, path: str, key: str = "model") -> None:
    """A model × metric table as JSON rows of one metric with a map from model to value."""
    metrics = [c for c in table.columns if c != key]
    rows = table.unpivot([key], metrics, "metric", "value")
    by_metric = rows.groupBy("metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "value")))).alias("values"))
    by_metric.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, model, value) rows of a written metric table; NaN comes back as null."""
    stored = spark.read.schema("metric string, values map<string,double>").json(path)
    return nan_to_null(stored.select("metric", F.explode("values").alias("model", "value")))


def metrics_by_model(long_table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Invert (metric, model, value) rows to one row per model."""
    return long_table.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def frame_of(spark: SparkSession, values: Mapping[str, Mapping[str, float | None]]) -> DataFrame:
    """metric → model → value, as published, to (metric, model, value) rows."""
    rows = [(m, k, None if v is None else float(v)) for m, per in values.items() for k, v in per.items()]
    return nan_to_null(spark.createDataFrame(rows, "metric string, model string, value double"))
