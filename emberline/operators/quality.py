"""Table checks evaluated together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import constants as K


class QualityError(ValueError):
    """One or more expectations failed."""


@dataclass(frozen=True)
class Check:
    """A named expectation: `observed` over the table, and when that observation passes."""

    name: str
    observed: Column | float
    passes: str  # SQL over `observed`
    subset: tuple[str, ...] = ()


def null_rate_below(column: str, threshold: float) -> Check:
    rate = F.coalesce(F.avg(F.col(column).isNull().cast("double")), F.lit(0.0))
    return Check(f"{column}: share of nulls under {threshold:g}", rate, f"observed < {threshold}")


def between(column: str, low: float, high: float, allow_null: bool = True) -> Check:
    inside = F.col(column).between(low, high)
    if not allow_null:
        inside = F.coalesce(inside, F.lit(False))
    share = F.coalesce(F.avg(inside.cast("double")), F.lit(1.0))
    return Check(f"{column}: all from {low:g} to {high:g}", share, "observed = 1.0")


def unique(*subset: str) -> Check:
    return Check(f"{', '.join(subset)}: one row each", 0.0, "observed = 0.0", subset)


def column_present(df: DataFrame, column: str) -> Check:
    return Check(f"{column}: exists", float(column in df.columns), "observed = 1.0")


def duplicate_count(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; keys are combined before the exchange."""
    sizes = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("duplicates"))


def quality_suite(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check, observed, passed): one scan for all row checks, one more per uniqueness check."""
    plain = [c for c in checks if not c.subset and isinstance(c.observed, Column)]
    values: dict[str, Column] = {}
    scanned = df.agg(*[c.observed.alias(f"v{i}") for i, c in enumerate(plain)]) if plain else None
    if scanned is not None:
        one_row = scanned.select(F.struct(*scanned.columns).alias("s")).scalar()
        values = {c.name: one_row[f"v{i}"] for i, c in enumerate(plain)}
    for check in checks:
        if check.subset:
            values[check.name] = duplicate_count(df, check.subset).scalar()
        elif not isinstance(check.observed, Column):
            values[check.name] = F.lit(check.observed)
    names = df.sparkSession.createDataFrame([(c.name, c.passes) for c in checks], "check string, rule string")
    observed, passed = F, F
    for check in checks:
        observed = observed.when(F.col("check") == check.name, values[check.name].cast("double"))
        passed = passed.when(F.col("check") == check.name, F.expr(check.passes))
    return names.select("check", observed.alias("observed")).select("check", "observed", passed.alias("passed"))


def assert_quality(table: str, results: DataFrame) -> DataFrame:
    """The results, one row per check, if all passed; else an error that lists those that did not."""
    broken = results.where(~F.col("passed")).collect()
    if broken:
        raise QualityError("; ".join([f"{table} must not be served", *[f"{r['check']}, found {r['observed']}" for r in broken]]))
    return results


def serving_checks(df: DataFrame, key: str = "borrower_id") -> list[Check]:
    """What a feature table must meet before it is served, by the fixed thresholds."""
    present = [column_present(df, c) for c in (key, *K.GATE_COLUMNS)]
    filled = [null_rate_below(c, most) for c, most in K.GATE_NULL_RATES.items()]
    bounded = [between(c, low, high) for c, (low, high) in K.GATE_RANGES.items()]
    return [*present, unique(key), *filled, *bounded]
