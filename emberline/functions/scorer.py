"""A hazard scorer that is only Columns: whole books are scored without leaving the JVM."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.scalar import let


def logistic(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


@dataclass(frozen=True)
class LinearHazard:
    """Monthly hazard = logistic(intercept + month effect + Σ coefficient · (value − mean)).

    A missing value counts as its mean, so its contribution is zero.
    """

    intercept: float
    coefficients: Mapping[str, float]
    means: Mapping[str, float] = field(default_factory=dict)
    month_effects: tuple[float, ...] = (0.0,) * K.HORIZON_MONTHS

    def contribution(self, name: str, value: Column | None = None) -> Column:
        value = F.col(name) if value is None else value
        mean = self.means.get(name, 0.0)
        deviation = value.cast("double") - F.lit(mean)
        return F.coalesce(F.lit(self.coefficients[name]) * deviation, F.lit(0.0))

    def logit(self, replaced: Mapping[str, Column] | None = None) -> Column:
        replaced = replaced or {}
        total = F.lit(self.intercept)
        for name in self.coefficients:
            total = total + self.contribution(name, replaced.get(name))
        return total

    def effects(self) -> Column:
        return F.array(*[F.lit(e) for e in self.month_effects])

    def hazards(self, logit: Column) -> Column:
        """Array of monthly hazards; no row expansion and no shuffle."""
        return let(logit, lambda v: F.transform(self.effects(), lambda e: logistic(v + e)))

    def hazard_at(self, month: Column, logit: Column) -> Column:
        return logistic(logit + F.element_at(self.effects(), month.cast("int")))

    def cumulative(self, logit: Column) -> Column:
        """Probability of the event within the horizon.

        Folded over the months with the logit bound once: a filter on the result is pushed below the
        projection as this expression, so its size matters.
        """

        def survival(v: Column) -> Column:
            return F.aggregate(
                self.effects(), F.lit(1.0), lambda acc, e: acc * (F.lit(1.0) - logistic(v + e))
            )

        return F.lit(1.0) - let(logit, survival)


# A fixed scorer whose numbers are arbitrary but documented; it lets plans be checked in SQL.
DEMO_SCORER = LinearHazard(
    intercept=-5.0,
    coefficients={
        "credit_income_ratio": 0.05,
        "annuity_income_ratio": 0.6,
        "bureau_active_count": 0.12,
        "bureau_overdue_flag": 0.7,
        "ext_source_1": -0.7,
        "ext_source_2": -1.4,
        "ext_source_3": -0.9,
        "age_years": -0.01,
        "employed_years": -0.02,
        "prior_late_rate": 6.0,
        "prior_n_installments": -0.004,
    },
    means={
        "credit_income_ratio": 2.0,
        "annuity_income_ratio": 0.1,
        "bureau_active_count": 0.7,
        "bureau_overdue_flag": 0.2,
        "ext_source_1": 0.5,
        "ext_source_2": 0.5,
        "ext_source_3": 0.5,
        "age_years": 44.0,
        "employed_years": 12.0,
        "prior_late_rate": 0.004,
        "prior_n_installments": 27.0,
    },
    month_effects=tuple(round(0.04 * (m - 6.5), 4) for m in range(1, K.HORIZON_MONTHS + 1)),
)

# A fixed point scorer for thin files: one step, so its only hazard is the probability itself.
DEMO_THIN_SCORER = LinearHazard(
    intercept=-2.0,
    coefficients={"credit_income_ratio": 0.1, "annuity_income_ratio": 1.5, "ext_source_2": -2.0, "age_years": -0.02},
    means={"credit_income_ratio": 2.0, "annuity_income_ratio": 0.1, "ext_source_2": 0.5, "age_years": 44.0},
    month_effects=(0.0,),
)
