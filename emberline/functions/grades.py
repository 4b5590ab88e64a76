"""From probability of default to grade, action, wording and regulatory state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.scalar import let, lookup


def pd_to_grade(pd: Column, bands: Sequence[tuple[float, str]] = K.GRADE_BANDS) -> Column:
    """Grade of the first band whose upper bound is above the PD; the last one beyond."""

    def first_band(v: Column) -> Column:
        chain = F
        for upper, grade in bands:
            chain = chain.when(v < upper, F.lit(grade))
        return F.when(v.isNotNull(), chain.otherwise(F.lit(bands[-1][1])))

    return let(pd, first_band)


def grade_rank(grade: Column) -> Column:
    """1 for A … 7 for G."""
    return F.array_position(F.array(*[F.lit(g) for g in K.GRADES]), grade)


def grade_action(grade: Column) -> Column:
    return lookup(grade, K.GRADE_ACTIONS)


def next_better_grade(grade: Column) -> Column:
    better = grade_rank(grade) - 1
    return F.when(better >= 1, F.element_at(F.array(*[F.lit(g) for g in K.GRADES]), better.cast("int")))


def high_risk_flag(grade: Column) -> Column:
    return grade.isin(*K.HIGH_RISK_GRADES)


def borrower_band_text(grade: Column) -> Column:
    return lookup(grade, K.BORROWER_LANGUAGE)


def borrower_counterfactual_text(counterfactual: Column) -> Column:
    """Plain-language sentence of a counterfactual struct, or the no-suggestion sentence."""
    sentence = F.concat(
        F.lit("Improving "),
        F.lower(counterfactual["label"]),
        F.lit(" from "),
        plain_number(counterfactual["current_value"]),
        F.lit(" to "),
        plain_number(counterfactual["suggested_value"]),
        F.lit(" would move your account to band "),
        counterfactual["new_grade"],
        F.lit("."),
    )
    return F.when(counterfactual["feature"].isNotNull(), sentence).otherwise(F.lit(K.BORROWER_NO_SUGGESTION))


def plain_number(value: Column) -> Column:
    """Up to four decimals without trailing zeros."""
    fixed = F.format_string("%.4f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


def cumulative_pd(hazards: Column) -> Column:
    """1 − Π(1 − h) over an array of monthly hazards."""
    return F.lit(1.0) - F.aggregate(hazards, F.lit(1.0), lambda acc, h: acc * (F.lit(1.0) - h))


def expected_loss(pd: Column, lgd: float = K.LOSS_GIVEN_DEFAULT, ead: Column | None = None) -> Column:
    loss = pd * F.lit(lgd)
    return loss if ead is None else loss * ead


def route_model(richness: Column, thin_file_available: bool = True) -> Column:
    """Which scorer handles the loan, and whether the thin-file one was missing."""
    thin = F.coalesce(richness == K.THIN_FILE, F.lit(False))
    model = F.when(thin & F.lit(thin_file_available), F.lit("thin_file")).otherwise(F.lit("hazard"))
    return F.struct(
        model.alias("model_used"),
        (thin & F.lit(not thin_file_available)).alias("thin_file_unavailable"),
    )


def sma_bucket(days_past_due: Column) -> Column:
    chain = F.when(days_past_due < 1, F.lit(None).cast("string"))
    for upper, bucket in K.SMA_LADDER:
        chain = chain.when(days_past_due <= upper, F.lit(bucket))
    return chain.when(days_past_due > K.SMA_LADDER[-1][0], F.lit(K.NPA))


def ews_next(state: Column, pd: Column, indicator: Column, days_past_due: Column) -> Column:
    """One move of the early-warning ladder."""
    performing, watch, alert, critical, npa = K.EWS_STATES
    dpd = F.coalesce(days_past_due, F.lit(0))
    p = F.coalesce(pd, F.lit(0.0))
    fired = F.coalesce(indicator, F.lit(False))
    return (
        F.when(state == performing, F.when(p > K.WATCH_PD, watch).otherwise(performing))
        .when(
            state == watch,
            F.when((p > K.ALERT_PD) | fired, alert).when(p <= K.WATCH_PD, performing).otherwise(watch),
        )
        .when(
            state == alert,
            F.when((p > K.CRITICAL_PD) | ((dpd > 30) & (dpd <= 90)), critical)
            .when((p <= K.ALERT_PD) & ~fired, watch)
            .otherwise(alert),
        )
        .when(state == critical, F.when(dpd > 90, npa).otherwise(critical))
        .otherwise(state)
    )


def ews_fold(observations: Column, first: Column | str = K.EWS_STATES[0]) -> Column:
    """State after each of an ordered array of (pd, indicator, days_past_due), from the state `first`."""
    start = F.array(F.lit(first) if isinstance(first, str) else first)
    states = F.aggregate(
        observations,
        start,
        lambda acc, o: F.concat(
            acc, F.array(ews_next(F.element_at(acc, -1), o["pd"], o["indicator"], o["days_past_due"]))
        ),
    )
    return F.slice(states, 2, F.size(observations))


def stress_shock(
    shock_type: str, magnitude: float, sector: Column | None = None, target_sector: str | None = None
) -> dict[str, Column]:
    """Shocked obligation ratios, by column name."""
    if shock_type not in ("revenue", "rate", "sector_demand"):
        raise ValueError(f"unknown shock type {shock_type!r}")
    m = normalise_magnitude(magnitude)
    if shock_type in ("revenue", "sector_demand") and m <= -1.0:
        raise ValueError("a revenue shock must be above -100 %")
    if shock_type == "sector_demand" and not target_sector:
        raise ValueError("a sector_demand shock needs a sector")
    factor = 1.0 + m if shock_type == "rate" else 1.0 / (1.0 + m)
    touched = ("annuity_income_ratio",) if shock_type == "rate" else ("credit_income_ratio", "annuity_income_ratio")
    mask = (sector == target_sector) if shock_type == "sector_demand" else F.lit(True)
    return {
        name: F.when(F.coalesce(mask, F.lit(False)), F.col(name) * F.lit(factor)).otherwise(F.col(name))
        for name in touched
    }


def normalise_magnitude(magnitude: float) -> float:
    """A fraction; values beyond ±1 are read as percent."""
    return magnitude / 100.0 if abs(magnitude) > 1.0 else magnitude


def rate_move_to_fraction(basis_points: float) -> float:
    return basis_points / 2000.0


def event_feature_delta(event_type: Column, updates: Column | None, features: dict[str, Column]) -> Column:
    """Feature changes of one event as map<string,double>; an explicit map wins."""
    late = F.coalesce(features["prior_late_rate"], F.lit(0.0))
    worse = F.round(F.least(F.lit(1.0), late + F.lit(K.LATE_STEP)), 6)
    better = F.round(F.greatest(F.lit(0.0), late * F.lit(K.LATE_RELIEF)), 6)

    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("double").alias("value"))

    ratios = [
        entry(c, F.round(features[c] * F.lit(K.RATIO_INFLATION), 6))
        for c in ("credit_income_ratio", "annuity_income_ratio")
    ]
    strain = [entry("bureau_overdue_flag", F.lit(1.0)), entry("prior_late_rate", worse)]

    def as_map(entries: list[Column]) -> Column:
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    derived = (
        F.when(event_type == "gst_filing", as_map(ratios + strain))
        .when(event_type == "bank_transaction", as_map(strain))
        .when(event_type == "repayment", as_map([entry("prior_late_rate", better)]))
    )
    if updates is None:
        return derived
    return F.when(F.size(updates) > 0, updates).otherwise(derived)
