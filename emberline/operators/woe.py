"""Weight-of-evidence bins: pre-bins counted on Spark, and the best way to join the few there are."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.operators.ordered import left_closed_bin, quantiles_of_counts

PREBINS = 20
MIN_SHARE = 0.05


@dataclass
class Bin:
    """Values in [lo, hi); infinite ends are open."""

    lo: float
    hi: float
    n: float
    events: float

    @property
    def rate(self) -> float:
        return self.events / self.n if self.n else 0.0


@dataclass(frozen=True)
class WoeTable:
    """Fitted bins of one feature, in value order, and the missing bin."""

    feature: str
    bins: tuple[Bin, ...]
    missing: Bin | None
    total: float
    total_events: float

    def woe(self, b: Bin) -> float:
        """ln(share of non-events / share of events); half a row stands in for none."""
        non_events = max(b.n - b.events, 0.5) / max(self.total - self.total_events, 0.5)
        events = max(b.events, 0.5) / max(self.total_events, 0.5)
        return math.log(non_events / events)


def value_counts(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, value, n, events), missing values as null; combined before the exchange."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    )
    return (
        df.where(F.col(target).isNotNull())
        .select(pairs.alias("p"), F.col(target).cast("long").alias("y"))
        .groupBy("p.feature", "p.value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))
    )


def prebin_counts(df: DataFrame, features: Sequence[str], target: str, prebins: int = PREBINS) -> DataFrame:
    """At most `prebins` + 1 rows per feature: (feature, bin, lo, n, events); bin is null for missing."""
    counts = value_counts(df, features, target)
    present = counts.where(F.col("value").isNotNull())
    quantiles = quantiles_of_counts(present, "value", "n", [i / prebins for i in range(prebins + 1)], ["feature"])
    # A feature with few values is split at each of them, so a rare category keeps its own bin.
    few = present.groupBy("feature").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= prebins)
    values = present.join(F.broadcast(few), "feature").groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("values"))
    edges = quantiles.join(values, "feature", "left").select(
        "feature",
        F.coalesce(F.concat(F.col("values"), F.array(F.lit(float("inf")))), F.array_distinct("edges")).alias("edges"),
    )
    # One row per feature named by the caller.
    binned = counts.join(F.broadcast(edges), "feature", "left").withColumn(
        "bin", F.when(F.col("value").isNotNull(), left_closed_bin(F.col("value"), F.col("edges")))
    )
    return binned.groupBy("feature", "bin").agg(
        F.min("value").alias("lo"), F.sum("n").alias("n"), F.sum("events").alias("events")
    )


def information(total: float, total_events: float, n: float, events: float) -> float:
    """What a bin adds to the information value of its feature."""
    non_events = max(n - events, 0.5) / max(total - total_events, 0.5)
    share = max(events, 0.5) / max(total_events, 0.5)
    return (non_events - share) * math.log(non_events / share)


def optimal_bins(bins: Sequence[Bin], trend: str, min_rows: float, total: float | None = None, total_events: float | None = None) -> list[Bin]:
    """The neighbours to join for the highest information value, with event rates strictly along the trend and bins of
    `min_rows` at least; all in one bin where that leaves no other way.

    A dynamic programme over the last bin: its best way to be reached from any earlier bin with a rate before its own.
    It takes cubic time in the number of pre-bins, some twenty.
    """
    if not bins:
        return []
    total = sum(b.n for b in bins) if total is None else total
    total_events = sum(b.events for b in bins) if total_events is None else total_events
    sign = 1 if trend == "ascending" else -1
    n, events = [0.0], [0.0]
    for b in bins:
        n.append(n[-1] + b.n)
        events.append(events[-1] + b.events)
    best: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {}
    for end in range(1, len(bins) + 1):
        for start in range(end):
            rows, hits = n[end] - n[start], events[end] - events[start]
            if rows < min_rows or not rows:
                continue
            own = information(total, total_events, rows, hits)
            if start == 0:
                best[0, end] = (own, None)
                continue
            # Rates are compared as products of counts, so equal ones never pass for rising.
            ways = [
                (value, (before, start))
                for before in range(start)
                if (value := best.get((before, start), (None,))[0]) is not None
                and sign * (hits * (n[start] - n[before]) - (events[start] - events[before]) * rows) > 0
            ]
            if ways:
                value, came = max(ways, key=lambda way: (way[0], -way[1][0]))
                best[start, end] = (value + own, came)
    last = [(value, key) for key, (value, _) in best.items() if key[1] == len(bins)]
    at: tuple[int, int] | None = max(last, key=lambda way: (way[0], -way[1][0]))[1] if last else (0, len(bins))
    out = []
    while at:
        start, end = at
        out.append(Bin(bins[start].lo, bins[end - 1].hi, n[end] - n[start], events[end] - events[start]))
        at = best.get(at, (0.0, None))[1]
    return out[::-1]


def fit_woe(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    trends: Mapping[str, str] = K.WOE_TRENDS,
    min_share: Mapping[str, float] = K.WOE_MIN_BIN,
    prebins: int = PREBINS,
) -> dict[str, WoeTable]:
    """Monotone bins of the highest information value per feature. Only the pre-bin counts, some twenty rows per feature, are fetched."""
    rows = prebin_counts(train, features, target, prebins).collect()
    tables = {}
    for feature in features:
        mine = [r for r in rows if r["feature"] == feature]
        present = sorted((r for r in mine if r["bin"] is not None), key=lambda r: r["bin"])
        gone = [r for r in mine if r["bin"] is None]
        total, events = sum(r["n"] for r in mine), sum(r["events"] for r in mine)
        lows = [-math.inf, *[r["lo"] for r in present[1:]]]
        bins = [
            Bin(lo, hi, r["n"], r["events"]) for r, lo, hi in zip(present, lows, [*lows[1:], math.inf], strict=True)
        ]
        merged = optimal_bins(bins, trends.get(feature, "ascending"), min_share.get(feature, MIN_SHARE) * total, total, events)
        missing = Bin(math.nan, math.nan, gone[0]["n"], gone[0]["events"]) if gone else None
        tables[feature] = WoeTable(feature, tuple(merged), missing, total, events)
    return tables


def woe_column(table: WoeTable, missing: str = "own") -> Column:
    """Value → WOE; a missing value has its own bin, or counts 0 (also where none was seen in training)."""
    value = F.col(table.feature).cast("double")
    gap = table.woe(table.missing) if missing == "own" and table.missing else 0.0
    chain = F.when(value.isNull(), F.lit(gap))
    for b in table.bins[:-1]:
        chain = chain.when(value < b.hi, F.lit(table.woe(b)))
    return chain.otherwise(F.lit(table.woe(table.bins[-1])) if table.bins else F.lit(0.0))


def apply_woe(df: DataFrame, tables: Mapping[str, WoeTable], missing: str = "own") -> DataFrame:
    """Add <feature>_woe for every fitted feature; a projection."""
    return df.withColumns({f"{f}_woe": woe_column(t, missing) for f, t in tables.items()})


def fixed_bins(df: DataFrame, feature: str, target: str, splits: Sequence[float]) -> WoeTable:
    """A table over given split points, without merging."""
    edges = [-math.inf, *splits, math.inf]
    value, y = F.col(feature).cast("double"), F.col(target).cast("long")
    number = sum((value >= s).cast("int") for s in splits)
    rows = {r["b"]: r for r in df.groupBy(number.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("e")).collect()}
    bins = tuple(
        Bin(edges[i], edges[i + 1], rows[i]["n"] if i in rows else 0, rows[i]["e"] if i in rows else 0)
        for i in range(len(edges) - 1)
    )
    gone = rows.get(None)
    return WoeTable(
        feature, bins, Bin(math.nan, math.nan, gone["n"], gone["e"]) if gone else None,
        sum(r["n"] for r in rows.values()), sum(r["e"] for r in rows.values()),
    )


def woe_frame(spark, tables: Mapping[str, WoeTable]) -> DataFrame:
    """The fitted bins as rows; bin_no is null for the missing bin."""
    rows = []
    for t in tables.values():
        rows += [(t.feature, i, b.lo, b.hi, int(b.n), int(b.events), b.rate, t.woe(b)) for i, b in enumerate(t.bins)]
        if t.missing:
            rows.append((t.feature, None, None, None, int(t.missing.n), int(t.missing.events), t.missing.rate, t.woe(t.missing)))
    return spark.createDataFrame(
        rows, "feature string, bin_no int, lo double, hi double, n long, events long, event_rate double, woe double"
    )


def bin_event_rates(df: DataFrame, bin_column: Column, target: str) -> DataFrame:
    """Rows and event rate per bin."""
    return df.groupBy(bin_column.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("event_rate")
    )


def is_monotonic(rates: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Whether event_rate only rises or only falls along `bin`; the input is one row per bin."""
    step = F.col("event_rate") - F.lag("event_rate").over(W.partitionBy(*(groups or [F.lit(0)])).orderBy("bin"))
    steps = rates.where(F.col("bin").isNotNull()).withColumn("step", step)
    rising = F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True))
    falling = F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(True))
    return steps.groupBy(*groups).agg((rising | falling).alias("monotonic"))
