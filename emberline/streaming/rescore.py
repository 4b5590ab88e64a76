"""Live re-scoring: parse, drop repeats and update features in keyed state, score before and after, several sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from emberline.functions.scorer import LinearHazard
from emberline.sources.events import parse_events
from emberline.streaming import replay, state

OUTPUT = (
    "event_id string, ts timestamp, loan_id bigint, type string, before array<double>, after array<double>, "
    "named map<string,double>, problem string"
)
#: Rows of a fold.
FOLD_ROWS = 10_000
ORDER = ["ts", "event_id"]
HOUR = 3600
#: Hours of event time before a loan's newest event in which its event ids are known.
KNOWN_HOURS = 24 * 30
#: Event ids of a loan that are read and written with its values.
FEW_IDS = 1000
#: Groups of loans that a stream deals its events to, fixed for the life of a checkpoint; and offline loans of a part.
GROUPS, PART_LOANS = 2048, 64


def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a micro-batch in (loan, ts, event_id) order, a slice at a time, however Arrow batches cut them.

    A streaming plan cannot sort, so they are sorted here. What a trigger admits bounds them.
    """
    held = list(batches)
    rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
    rows = rows.sort_values([c for c in ("loan_id", *ORDER) if c in rows]) if len(rows) else rows
    for at in range(0, len(rows), FOLD_ROWS):
        yield rows.iloc[at : at + FOLD_ROWS]


@dataclass
class Loan:
    """What is held of a loan; `added` are the ids and hours of this micro-batch."""

    x: list[float]
    newest: int | None = None
    few: dict[int, int] = field(default_factory=dict)
    many: bool = False
    named: dict[str, float] = field(default_factory=dict)
    part: tuple[int, int] | None = None
    added: dict[int, int] = field(default_factory=dict)
    reached: int | None = None


class Rescorer(StatefulProcessor):
    """Folds the events of each loan, in (ts, event_id) order over a micro-batch, into its held values.

    A key is a group of loans, as each key and each call to the store have their price; the loans of a group are folded
    together. The offline features are the initial state, so no batch reads them again. They stand in parts of some
    `PART_LOANS` loans, of which a batch reads those it needs; with its first event a loan goes from its part to an entry
    of its own. Up to `FEW_IDS` event ids stand beside the loan's values. With more, every id is an entry of its own,
    and a batch writes the entries that it adds. Once the loan's newest event is `known_hours` past an event, its id
    goes, of entries by slices of an hour. An event with a known id is a repeat and is left out. An event older than the
    known hours could be either, so it is given back as `too_late`; any other late event is applied when it comes.
    Events of a loan without offline features are given back as `unknown_loan`.
    """

    def __init__(self, known_hours: int):
        self.known_hours = known_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.offline = handle.getMapState("offline", "parts int, part int", "loans binary, x binary")
        self.loans = handle.getMapState("loans", "loan bigint", "x binary, newest bigint, ids binary, hours binary, many boolean, named string")
        self.seen = handle.getMapState("seen", "loan bigint, id bigint", "hour bigint")
        self.slices = handle.getMapState("slices", "loan bigint, hour bigint, first bigint", "ids array<bigint>")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        """A row with the loans of the group and their values one after another; without `loans` the key is the loan. Of a
        loan that comes several times the first is taken."""
        row = initialState.iloc[0]
        loans, first = np.unique(np.array(row["loans"] if "loans" in initialState else key, dtype="<i8"), return_index=True)
        x = np.array(row["base"], dtype="<f8").reshape(-1, len(state.FEATURES))[first]
        parts = -(-len(loans) // PART_LOANS)
        of = parts_of(loans, parts)
        for part in np.unique(of).tolist():
            self.offline.updateValue((parts, part), (loans[of == part].tobytes(), x[of == part].tobytes()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held: dict[int, Loan | None] = {}
        for batch in in_order(rows):
            rows_of = batch.drop_duplicates(["loan_id", "event_id"])
            loans, ids = rows_of["loan_id"].tolist(), rows_of["id_hash"].tolist()
            hours = (rows_of["ts"].astype("datetime64[s]").astype("int64") // HOUR).to_numpy()
            self.fetch(held, loans)
            problems = []
            for loan, event, hour in zip(loans, ids, hours.tolist(), strict=True):
                one, problem = held[loan], None
                if one is None:
                    problem = "unknown_loan"
                elif event in one.added or event in one.few or (one.many and self.seen.containsKey((loan, event))):
                    problem = "repeat"
                elif one.newest is not None and hour < one.newest - self.known_hours:
                    problem = "too_late"
                else:
                    one.added[event] = hour
                    one.reached = hour if one.reached is None else max(one.reached, hour)
                problems.append(problem)
            rows_of = rows_of.assign(problem=np.array(problems, dtype=object))
            refused = rows_of[rows_of["problem"].isin(["unknown_loan", "too_late"])]
            if len(refused):
                nothing = [None] * len(refused)
                yield refused[["event_id", "ts", "loan_id", "type", "problem"]].assign(before=nothing, after=nothing, named=nothing)
            rows_of = rows_of[rows_of["problem"].isna()]
            if not len(rows_of):
                continue
            starts = [held[loan].x for loan in rows_of["loan_id"].tolist()]
            _, before, after = next(state.walked(iter([rows_of.assign(start=starts)]), ["loan_id"], "start"))
            shown = []
            for loan, updates, x in zip(rows_of["loan_id"].tolist(), rows_of["feature_updates"], after, strict=True):
                one = held[loan]
                one.x = x
                if new := {n: v for n, v in dict(updates or {}).items() if n not in state.FEATURES}:
                    one.named = {**one.named, **new}
                shown.append(one.named)
            yield rows_of[["event_id", "ts", "loan_id", "type", "problem"]].assign(before=before.tolist(), after=after.tolist(), named=shown)
        self.write({loan: one for loan, one in held.items() if one and one.added})

    def fetch(self, held: dict[int, Loan | None], wanted: Iterable[int]) -> None:
        """Add the loans that are not held yet; None for a loan without offline features."""
        wanted = np.array(sorted(set(wanted) - held.keys()), dtype="<i8")
        if not len(wanted):
            return
        for parts, kept in self.parts_kept().items():
            of = parts_of(wanted, parts)
            for part in kept & set(of.tolist()):
                loans, x = self.offline_part(parts, part)
                places = dict(zip(loans.tolist(), range(len(loans)), strict=True))
                for loan in wanted[of == part].tolist():
                    if loan in places:
                        held[loan] = Loan(x[places[loan]], part=(parts, part))
        for loan in wanted.tolist():
            if loan not in held:
                held[loan] = self.entry(loan) if self.loans.containsKey((loan,)) else None

    def parts_kept(self) -> dict[int, set[int]]:
        kept: dict[int, set[int]] = {}
        for parts, part in self.offline.keys():
            kept.setdefault(parts, set()).add(part)
        return kept

    def offline_part(self, parts: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        loans, x = self.offline.getValue((parts, part))
        return np.frombuffer(loans, dtype="<i8"), np.frombuffer(x, dtype="<f8").reshape(len(loans) // 8, -1)

    def entry(self, loan: int) -> Loan:
        x, newest, ids, hours, many, named = self.loans.getValue((loan,))
        few = dict(zip(*(np.frombuffer(v, dtype="<i8").tolist() for v in (ids, hours)), strict=True))
        return Loan(np.frombuffer(x, dtype="<f8"), newest, few, many, json.loads(named), reached=newest)

    def write(self, changed: dict[int, Loan]) -> None:
        stored = {}
        for loan, one in changed.items():
            before = one.reached - self.known_hours
            one.few = {i: hour for i, hour in (one.few | one.added).items() if hour >= before}
            if one.many or len(one.few) > FEW_IDS:
                self.remember(loan, one.few)
                one.few, stored[loan] = {}, before
        kept = self.forget(stored) if stored else set()
        left: dict[tuple[int, int], list[int]] = {}
        for loan, one in changed.items():
            ids, hours = (np.array(list(v), dtype="<i8").tobytes() for v in (one.few.keys(), one.few.values()))
            value = np.array(one.x, dtype="<f8").tobytes()
            self.loans.updateValue((loan,), (value, one.reached, ids, hours, loan in kept, json.dumps(one.named)))
            if one.part:
                left.setdefault(one.part, []).append(loan)
        for part, gone in left.items():
            loans, x = self.offline_part(*part)
            stay = ~np.isin(loans, gone)
            if stay.any():
                self.offline.updateValue(part, (loans[stay].tobytes(), x[stay].tobytes()))
            else:
                self.offline.removeKey(part)

    def remember(self, loan: int, added: dict[int, int]) -> None:
        by_hour: dict[int, list[int]] = {}
        for event, hour in added.items():
            self.seen.updateValue((loan, event), (hour,))
            by_hour.setdefault(hour, []).append(event)
        for hour, ids in by_hour.items():
            self.slices.updateValue((loan, hour, ids[0]), (ids,))

    def forget(self, before: dict[int, int]) -> set[int]:
        """Drop the ids of all hours before the given one of their loan; reads the names of slices, not the ids of
        others. The loans that have slices left."""
        kept = set()
        for loan, hour, first in list(self.slices.keys()):
            if hour >= before.get(loan, hour):
                kept.add(loan)
                continue
            for event in self.slices.getValue((loan, hour, first))[0]:
                self.seen.removeKey((loan, int(event)))
            self.slices.removeKey((loan, hour, first))
        return kept

    def close(self) -> None:
        pass


def parts_of(loans: np.ndarray, parts: int) -> np.ndarray:
    """The part of each loan of a group; the product spreads ids of any pattern."""
    return ((loans.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(max(parts, 1))).astype(np.int64)


def rescore_stream(
    events: DataFrame, features: DataFrame, scorer: LinearHazard, key: str = "borrower_id", known_hours: int = KNOWN_HOURS
) -> DataFrame:
    """Stream of events with values and grades before and after.

    `features` is the static offline table: it is read once, when the query first starts. Loans that join it later are
    unknown to a running query. A new checkpoint starts from the table anew.
    """
    effect = state.event_effect(F.col("type"), F.col("feature_updates"))
    group = F.pmod(F.xxhash64("loan_id"), F.lit(GROUPS)).alias("loans_group")
    rows = events.withColumn("e", effect).select(
        group, "event_id", "ts", "loan_id", "type", "feature_updates", F.xxhash64("event_id").alias("id_hash"), "e.scale", "e.shift", "e.cap"
    )
    loans = replay.base_values(features, key).select(F.col("loan_id").cast("bigint").alias("loan_id"), "base").where(F.col("loan_id").isNotNull())
    grouped = loans.groupBy(group).agg(F.collect_list(F.struct("loan_id", "base")).alias("r"))
    base = grouped.select("loans_group", F.col("r.loan_id").alias("loans"), F.flatten("r.base").alias("base")).groupBy("loans_group")
    states = rows.groupBy("loans_group").transformWithStateInPandas(Rescorer(known_hours), OUTPUT, "Append", "None", base)
    return replay.score_states(states, scorer, "after", "named", "problem")


def write_once(df: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Rows of a micro-batch under its own folder, so a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")


def online_row(rescored: DataFrame) -> DataFrame:
    """(loan_id, features, updated_at) after each loan's newest event: what the next lookup must read."""
    newest = rescored.groupBy("loan_id").agg(F.max_by(F.struct("after", "named", "ts"), F.struct("ts", "event_id")).alias("r"))
    names = F.array(*map(F.lit, state.FEATURES))
    dynamic = F.map_filter(F.map_from_arrays(names, "r.after"), lambda _, v: ~F.isnan(v))
    whole = F.map_concat(dynamic, F.coalesce("r.named", F.create_map().cast("map<string,double>")))
    return newest.select("loan_id", whole.alias("features"), F.col("r.ts").alias("updated_at"))


def two_sink_fanout(
    rescored: DataFrame, timeline_path: str, alerts_path: str, checkpoint: str, once: bool = True,
    online_path: str | None = None, quarantine_path: str | None = None,
) -> StreamingQuery:
    """Every re-score goes to the timeline, grade moves also to the alerts.

    Optional sinks: the online rows, and the events that could not be scored. A run has a folder of its own in each,
    so a new checkpoint never overwrites what an earlier one wrote.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            good = held.where(F.col("problem").isNull())
            write_once(replay.risk_timeline(good), timeline_path, run, batch_id)
            write_once(replay.alerts(good), alerts_path, run, batch_id)
            if online_path:
                write_once(online_row(good), online_path, run, batch_id)
            if quarantine_path:
                refused = held.where(F.col("problem").isNotNull())
                write_once(refused.select(F.to_json(F.struct("event_id", "ts", "loan_id", "type")).alias("value"), "problem"), quarantine_path, run, batch_id)
        finally:
            held.unpersist()

    writer = rescored.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def quarantine_sink(rejected: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = rejected.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_rescoring(
    raw: DataFrame, features: DataFrame, scorer: LinearHazard, folder: str, key: str = "borrower_id", once: bool = True
) -> list[StreamingQuery]:
    """The whole job on a raw event source: quarantine, re-scores, alerts, online rows and refused events under `folder`."""
    good, rejected = parse_events(raw)
    rescored = rescore_stream(good, features, scorer, key)
    return [
        quarantine_sink(rejected, f"{folder}/quarantine", f"{folder}/_checkpoints/quarantine", once),
        two_sink_fanout(
            rescored, f"{folder}/timeline", f"{folder}/alerts", f"{folder}/_checkpoints/rescore", once,
            f"{folder}/online", f"{folder}/refused",
        ),
    ]
