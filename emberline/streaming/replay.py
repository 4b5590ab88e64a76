"""All events of all loans, folded in order, as a batch plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.explain import alert_message
from emberline.functions.grades import pd_to_grade
from emberline.functions.scorer import LinearHazard
from emberline.streaming import state

ARRAYS = "scale array<double>, shift array<double>, cap array<double>"


def known_events(events: DataFrame) -> DataFrame:
    """Usable events, each (loan_id, event_id) once: a repeat is applied as its earliest copy."""
    usable = events.where(F.col("type").isin(*K.EVENT_TYPES) & F.col("loan_id").isNotNull())
    rest = [c for c in usable.columns if c not in ("loan_id", "event_id")]
    # Maps have no order, so their text stands for them.
    order = [F.to_json(c).alias(c) if f.dataType.typeName() == "map" else F.col(c) for c, f in ((f.name, f) for f in usable.schema) if c in rest]
    first = F.min_by(F.struct(*rest), F.struct("ts", *[o for o, c in zip(order, rest, strict=True) if c != "ts"])).alias("e")
    return usable.groupBy("loan_id", "event_id").agg(first).select("loan_id", "event_id", *[F.col(f"e.{c}").alias(c) for c in rest])


def unknown_loans(events: DataFrame, features: DataFrame, key: str = "borrower_id") -> DataFrame:
    """Usable events of loans without offline features, with the problem; they are refused, not dropped."""
    known = features.select(F.col(key).alias("loan_id"))
    return known_events(events).join(known, "loan_id", "left_anti").withColumn("problem", F.lit("unknown_loan"))


def online_rows(events: DataFrame, features: DataFrame, key: str = "borrower_id") -> DataFrame:
    """(loan_id, features): what the newest online row of each loan with events holds beside its offline values.

    The dynamic features are those after its last event; any other feature that an event names has its last value.
    """
    newest = replay_states(events, features, key).groupBy("loan_id").agg(F.max_by("after", F.struct("ts", "event_id")).alias("x"))
    dynamic = newest.select("loan_id", F.posexplode("x").alias("at", "value"))
    names = F.array(*map(F.lit, state.FEATURES))
    dynamic = dynamic.where(~F.isnan("value")).select("loan_id", F.get(names, "at").alias("name"), "value")
    both = dynamic
    if "feature_updates" in events.columns:
        named = known_events(events).join(newest.select("loan_id"), "loan_id", "left_semi")
        named = named.select("loan_id", "ts", "event_id", F.explode("feature_updates").alias("name", "value"))
        last = named.where(~F.col("name").isin(*state.FEATURES)).groupBy("loan_id", "name")
        both = dynamic.union(last.agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")))
    return both.groupBy("loan_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("features"))


def base_values(features: DataFrame, key: str = "borrower_id") -> DataFrame:
    """(loan_id, base): the dynamic features as one array, missing values as NaN."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in state.FEATURES]
    return features.select(F.col(key).alias("loan_id"), F.array(*values).alias("base"))


def replay_states(events: DataFrame, features: DataFrame, key: str = "borrower_id", chunk_seconds: int = 3600) -> DataFrame:
    """Feature arrays `before` and `after` every event, in (ts, event_id) order per loan.

    A loan's history is cut into time chunks and exchanged by (loan, chunk), so one loan with a
    third of all events is many small pieces. Chunk effects are composed first; a loan's chunks are
    then chained (as many rows as it has active chunks), and each chunk is replayed from its start.
    """
    updates = F.col("feature_updates") if "feature_updates" in events.columns else None
    effect = state.event_effect(F.col("type"), updates)
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    chunked = (
        known_events(events)
        .select("event_id", "ts", "loan_id", "type", F.floor(seconds / chunk_seconds).alias("chunk"), effect.alias("e"))
        .select("event_id", "ts", "loan_id", "type", "chunk", "e.scale", "e.shift", "e.cap")
    )
    order = ["loan_id", "chunk", "ts", "event_id"]
    runs = (
        chunked.repartition("loan_id", "chunk")
        .sortWithinPartitions(*order)
        .select("loan_id", "chunk", "scale", "shift", "cap")
        .mapInPandas(state.compose_runs, f"loan_id bigint, chunk bigint, {ARRAYS}")
    )
    starts = (
        runs.join(base_values(features, key), "loan_id")
        .repartition("loan_id")
        .sortWithinPartitions("loan_id", "chunk")
        .mapInPandas(state.start_of_runs, "loan_id bigint, chunk bigint, start array<double>")
    )
    fields = {f.name: f.dataType.simpleString() for f in chunked.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in ("event_id", "ts", "loan_id", "type"))
    return (
        chunked.join(starts, ["loan_id", "chunk"])
        .repartition("loan_id", "chunk")
        .sortWithinPartitions(*order)
        .mapInPandas(state.states_of_rows, f"{schema}, before array<double>, after array<double>")
    )


def score_array(scorer: LinearHazard, values: Column) -> Column:
    """Logit of an array over the dynamic features; NaN counts as missing."""

    def at(name: str) -> Column:
        value = values[state.FEATURES.index(name)]
        return F.when(~F.isnan(value), value)

    return scorer.logit({name: at(name) for name in scorer.coefficients})


def score_states(states: DataFrame, scorer: LinearHazard, *kept: str) -> DataFrame:
    """PD and grade before and after each event, and the columns `kept`."""
    logits = states.select(
        "event_id", "ts", "loan_id", "type", *kept,
        score_array(scorer, F.col("before")).alias("_b"),
        score_array(scorer, F.col("after")).alias("_a"),
    )
    probabilities = logits.select(
        "event_id", "ts", "loan_id", "type", *kept,
        scorer.cumulative(F.col("_b")).alias("pre_pd"),
        scorer.cumulative(F.col("_a")).alias("post_pd"),
    )
    return probabilities.withColumns(
        {"pre_grade": pd_to_grade(F.col("pre_pd")), "post_grade": pd_to_grade(F.col("post_pd"))}
    )


def replay_events(events: DataFrame, features: DataFrame, scorer: LinearHazard, key: str = "borrower_id") -> DataFrame:
    return score_states(replay_states(events, features, key), scorer)


def risk_timeline(rescored: DataFrame) -> DataFrame:
    """One row per re-score, whether or not the grade moved."""
    return rescored.select("event_id", "ts", "loan_id", F.col("post_pd").alias("pd"), F.col("post_grade").alias("risk_grade"))


def alerts(rescored: DataFrame) -> DataFrame:
    """Only the re-scores that moved the grade, in either direction."""
    message = alert_message(
        F.col("loan_id"), F.col("type"), F.col("pre_grade"), F.col("post_grade"), F.col("pre_pd"), F.col("post_pd")
    )
    moved = rescored.where(F.col("pre_grade") != F.col("post_grade"))
    return moved.select("event_id", "ts", "loan_id", "type", "pre_grade", "post_grade", message.alias("message"))
