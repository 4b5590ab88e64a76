"""Column expressions over single rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import constants as K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body mentions it.

    A Column is an expression, not a result: repeated inside another expression, or inside a lambda
    run per array element, it is computed again each time.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a value to Spark but a missing value here; normalise at the source."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def tag_provenance(df: DataFrame, tag: str, column: str = "data_provenance") -> DataFrame:
    return df.withColumn(column, F.lit(tag))


def lookup(value: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Map a column through a small fixed dictionary."""
    chain = F
    for key, target in mapping.items():
        chain = chain.when(value == key, F.lit(target))
    return chain.otherwise(F.lit(default))


def map_loan_type(contract_type: Column) -> Column:
    return lookup(contract_type, K.LOAN_TYPES, K.OTHER_LOAN_TYPE)


def map_sector(organization_type: Column) -> Column:
    chain = F
    for sector, values in K.SECTORS.items():
        chain = chain.when(organization_type.isin(*values), F.lit(sector))
    return chain.otherwise(F.lit(K.OTHER_SECTOR))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), F.nullif(denominator, F.lit(0)))


def days_to_years(negative_days: Column) -> Column:
    return -negative_days / F.lit(K.DAYS_PER_YEAR)


def tenure_years(negative_days: Column, sentinel: int = K.EMPLOYED_SENTINEL) -> Column:
    years = days_to_years(F.when(negative_days != sentinel, negative_days))
    return clip(years, 0.0, None)


def clip(value: Column, low: float | None, high: float | None) -> Column:
    """Bound a value, keeping null (least/greatest alone would skip it)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def days_late(due: Column, paid: Column) -> Column:
    return paid - due


def is_late(late_days: Column, threshold: int = 0, unpaid_days: int | None = None) -> Column:
    """Strictly later than the threshold; unpaid is on time unless `unpaid_days` says otherwise."""
    if unpaid_days is None:
        return F.coalesce(late_days > threshold, F.lit(False))
    return F.coalesce(late_days, F.lit(unpaid_days)) > threshold


def coerce_numeric(value: Column) -> Column:
    return value.try_cast("double")


def align_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Training columns in training order; missing ones are 0, extra ones are dropped."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(0).alias(c) for c in columns])


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per category, named <column>_<category>."""
    flags = {
        f"{column}_{value}": F.coalesce((F.col(column) == value).cast("int"), F.lit(0))
        for column, values in categories.items()
        for value in values
    }
    return df.withColumns(flags)


def signed_sentiment(label: Column, score: Column) -> Column:
    return F.when(label == "positive", score).when(label == "negative", -score).otherwise(F.lit(0.0))


def keyword_flag(text: Column, pattern: str = K.DISTRESS_PATTERN) -> Column:
    return text.rlike(f"(?i){pattern}").cast("int")


def models_disagree(a: Column, b: Column, margin: float = K.DISAGREEMENT_MARGIN) -> Column:
    return (F.abs(a - b) - F.lit(margin)) > F.lit(1e-12)


def evaluable(event: Column, duration: Column, horizon: int = K.HORIZON_MONTHS) -> Column:
    """The 12-month outcome is known: the event happened, or the full horizon was observed."""
    return (event == 1) | (duration >= horizon)


def feature_payload(df: DataFrame, key: str, excluded: Sequence[str] = K.SERVING_EXCLUDED) -> Column:
    """The row as JSON without labels; nulls are kept as explicit nulls."""
    columns = [c for c in df.columns if c not in excluded]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
