import json
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.functions.scorer import DEMO_SCORER
from emberline.sources import events as ev
from emberline.streaming import dedupe, replay, rescore, state

BASE = dict(credit_income_ratio=2.0, annuity_income_ratio=0.1, bureau_active_count=1.0, bureau_overdue_flag=0.0, ext_source_1=0.5,
            ext_source_2=0.3, ext_source_3=None, age_years=40.0, employed_years=5.0, prior_late_rate=0.0, prior_n_installments=20.0)


def features(spark, loans):
    schema = "borrower_id long, " + ", ".join(f"{c} double" for c in BASE)
    rows = [(i, *{**BASE, "prior_late_rate": None if i % 3 == 0 else 0.01 * i}.values()) for i in loans]
    return spark.createDataFrame(rows, schema)


def make_events(seed, n=300, hot=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        loan = 1 if hot and rng.random() < 0.4 else rng.randint(2, 8)
        minute = rng.randint(0, 6000)
        kind = rng.choice(["gst_filing", "bank_transaction", "repayment", "repayment"])
        updates = {"ext_source_2": round(rng.random(), 3), "prior_late_rate": 0.02} if rng.random() < 0.1 else None
        ts = f"2024-01-{1 + minute // 1440:02d}T{minute % 1440 // 60:02d}:{minute % 60:02d}:00Z"
        out.append({"event_id": f"e{i:05d}", "ts": ts, "loan_id": loan, "type": kind, "feature_updates": updates})
    return out


def plain_fold(events, base):
    """Every event in order by ordinary dictionaries."""
    states, out = {}, {}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        x = states.setdefault(e["loan_id"], dict(base[e["loan_id"]]))
        if e["feature_updates"]:
            x.update(e["feature_updates"])
        elif e["type"] == "repayment":
            x["prior_late_rate"] = (x["prior_late_rate"] or 0.0) * 0.8
        else:
            x["bureau_overdue_flag"] = 1.0
            x["prior_late_rate"] = min(1.0, (x["prior_late_rate"] or 0.0) + 0.2)
            if e["type"] == "gst_filing":
                for c in ("credit_income_ratio", "annuity_income_ratio"):
                    x[c] = None if x[c] is None else x[c] * 1.4
        out[e["event_id"]] = [x[f] for f in state.FEATURES]
    return out


def same(a, b):
    return all((p is None or p != p) if q is None else p == pytest.approx(q, rel=1e-9) for p, q in zip(a, b))


@pytest.mark.parametrize("chunk", [600, 3600, 10_000_000])
def test_replay_equals_plain_fold_whatever_the_chunks(spark, chunk):
    raw = make_events(1)
    df = spark.createDataFrame([(json.dumps(e),) for e in raw], "value string").repartition(5)
    good, bad = ev.parse_events(df)
    assert bad.count() == 0
    base_rows = features(spark, range(1, 9))
    base = {r["borrower_id"]: {f: r[f] for f in state.FEATURES} for r in base_rows.collect()}
    got = {r["event_id"]: r["after"] for r in replay.replay_states(good, base_rows, chunk_seconds=chunk).collect()}
    want = plain_fold(raw, base)
    assert got.keys() == want.keys()
    assert all(same(got[k], want[k]) for k in want)


def test_composition_equals_application():
    rng = np.random.default_rng(2)
    for _ in range(200):
        ops = []
        for _ in range(rng.integers(1, 12)):
            scale = rng.choice([0.0, 0.8, 1.0, 1.4], len(state.FEATURES))
            ops.append((scale, rng.choice([0.0, 0.2, 1.0], len(state.FEATURES)), rng.choice([1.0, np.inf], len(state.FEATURES))))
        x = rng.random(len(state.FEATURES))
        one_by_one, whole = x, ops[0]
        for op in ops:
            one_by_one = state.apply_effect(one_by_one, *op)
        for op in ops[1:]:
            whole = state.compose(whole, op)
        assert np.allclose(state.apply_effect(x, *whole), one_by_one)


def write_files(folder, records, n_files):
    for i in range(n_files):
        with open(f"{folder}/part{i}.txt", "w") as f:
            f.writelines(r + "\n" for r in records[i::n_files])


def run_stream(spark, records, base_rows, n_files=3):
    source, target = tempfile.mkdtemp(prefix="emberline-in-"), tempfile.mkdtemp(prefix="emberline-out-")
    write_files(source, records, n_files)
    raw = ev.event_source(spark, source, max_files_per_trigger=64)
    for query in rescore.start_rescoring(raw, base_rows, DEMO_SCORER, target):
        query.awaitTermination(240)
        assert query.exception() is None
    return target


def test_stream_equals_batch_with_duplicates_and_bad_events(spark):
    raw = make_events(3, n=120)
    records = [json.dumps(e) for e in raw]
    noise = ["not json", json.dumps({"event_id": "x", "ts": "2024-01-01T00:00:00Z", "loan_id": 1, "type": "signup"}), json.dumps({"type": "repayment"})]
    base_rows = features(spark, range(1, 9)).persist()
    folder = run_stream(spark, records + records[:40] + noise, base_rows)
    good, _ = ev.parse_events(spark.createDataFrame([(r,) for r in records], "value string"))
    batch = replay.replay_events(good, base_rows, DEMO_SCORER)
    want = {r["event_id"]: (r["pd"], r["risk_grade"]) for r in replay.risk_timeline(batch).collect()}
    rows = spark.read.parquet(f"{folder}/timeline").collect()
    got = {r["event_id"]: (r["pd"], r["risk_grade"]) for r in rows}
    assert len(rows) == len(raw) and got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0], rel=1e-9) and got[k][1] == want[k][1] for k in want)
    alerts = {r["event_id"] for r in spark.read.parquet(f"{folder}/alerts").collect()}
    assert alerts == {r["event_id"] for r in replay.alerts(batch).collect()} and alerts
    problems = sorted(r["problem"] for r in spark.read.parquet(f"{folder}/quarantine").collect())
    assert problems == ["unknown_type", "unreadable", "unreadable"]


def test_stream_order_does_not_follow_arrow_batches(spark):
    """Batches below one loan's events, shuffled arrival: the same rows as the replay; and no operator leaves a limit behind."""
    raw = make_events(9, n=150)
    random.Random(10).shuffle(raw)
    records = [json.dumps(e) for e in raw]
    base_rows = features(spark, range(1, 9)).persist()
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "7")
    try:
        folder = run_stream(spark, records, base_rows)
    finally:
        spark.conf.set(limit, before)
    good, _ = ev.parse_events(spark.createDataFrame([(r,) for r in records], "value string"))
    want = {r["event_id"]: (r["post_pd"], r["post_grade"]) for r in replay.replay_events(good, base_rows, DEMO_SCORER).collect()}
    got = {r["event_id"]: (r["pd"], r["risk_grade"]) for r in spark.read.parquet(f"{folder}/timeline").collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0], rel=1e-9), want[k][1]) for k in want)


@pytest.mark.parametrize(("step", "cut"), [(10, 7), (6, 9), (1, 1), (1000, 50)])
def test_rows_of_a_loan_come_in_order(monkeypatch, step, cut):
    monkeypatch.setattr(rescore, "FOLD_ROWS", step)
    g = random.Random(step)
    rows = pd.DataFrame([(pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=g.randint(0, 40)), f"e{g.randint(0, 99)}") for _ in range(211)], columns=rescore.ORDER)
    slices = list(rescore.in_order(rows.iloc[at : at + cut] for at in range(0, len(rows), cut)))
    assert len(slices) > 1 or step == 1000
    assert [tuple(r) for s in slices for r in s.to_numpy()] == sorted(tuple(r) for r in rows.to_numpy())
    assert not list(rescore.in_order(iter([])))


def test_state_survives_between_runs(spark):
    raw = sorted(make_events(4, n=60), key=lambda e: (e["ts"], e["event_id"]))
    base_rows = features(spark, range(1, 9)).persist()
    source, target = tempfile.mkdtemp(prefix="emberline-in-"), tempfile.mkdtemp(prefix="emberline-out-")
    for part in (raw[:30], raw[30:]):
        with open(f"{source}/{part[0]['event_id']}.txt", "w") as f:
            f.writelines(json.dumps(e) + "\n" for e in part)
        for query in rescore.start_rescoring(ev.event_source(spark, source), base_rows, DEMO_SCORER, target):
            query.awaitTermination(240)
            assert query.exception() is None
    good, _ = ev.parse_events(spark.createDataFrame([(json.dumps(e),) for e in raw], "value string"))
    want = {r["event_id"]: r["post_pd"] for r in replay.replay_events(good, base_rows, DEMO_SCORER).collect()}
    got = {r["event_id"]: r["pd"] for r in spark.read.parquet(f"{target}/timeline").collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_distress_alerts_and_small_change_is_silent(spark):
    base_rows = features(spark, [1, 2])
    rows = [("a", "2024-01-01 00:00:00", 1, "gst_filing", {"prior_late_rate": 0.9, "bureau_overdue_flag": 1.0}),
            ("b", "2024-01-01 00:00:00", 2, "bank_transaction", {"credit_income_ratio": 2.0002})]
    df = spark.createDataFrame(rows, "event_id string, ts string, loan_id long, type string, feature_updates map<string,double>")
    rescored = replay.replay_events(df.withColumn("ts", F.col("ts").cast("timestamp")), base_rows, DEMO_SCORER)
    alerts = replay.alerts(rescored).collect()
    assert [r["event_id"] for r in alerts] == ["a"] and alerts[0]["post_grade"] > alerts[0]["pre_grade"]
    assert alerts[0]["message"].startswith("gst_filing moved loan 1 from grade ")
    assert replay.risk_timeline(rescored).count() == 2


def test_stamping_and_sink(spark):
    rows = spark.createDataFrame([(None, 5, "repayment"), ("kept", 6, "repayment")], "event_id string, loan_id long, type string")
    folder = tempfile.mkdtemp(prefix="emberline-topic-")
    ev.event_sink(rows, folder)
    good, bad = ev.parse_events(spark.read.text(folder))
    got = {r["loan_id"]: r for r in good.collect()}
    assert bad.count() == 0 and got[6]["event_id"] == "kept" and got[5]["event_id"] and got[5]["ts"] is not None


def events_frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, ts string, loan_id long, type string, feature_updates map<string,double>")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_batch_applies_repeats_once_and_refuses_unknown_loans(spark):
    base_rows = features(spark, [1, 2])
    rows = [("a", "2024-01-01 00:00:00", 1, "repayment", None)] * 3 + [("b", "2024-01-01 01:00:00", 99, "repayment", None)]
    df = events_frame(spark, rows + [("c", "2024-01-01 02:00:00", 1, "gst_filing", {"margin": 0.5})])
    got = replay.replay_states(df, base_rows).collect()
    assert sorted(r["event_id"] for r in got) == ["a", "c"]
    assert {r["event_id"]: r["after"] for r in got}["a"][state.LATE] == pytest.approx(0.008)
    refused = replay.unknown_loans(df, base_rows).collect()
    assert [(r["event_id"], r["problem"]) for r in refused] == [("b", "unknown_loan")]
    online = {r["loan_id"]: r["features"] for r in replay.online_rows(df, base_rows).collect()}
    assert online.keys() == {1} and online[1]["margin"] == 0.5 and online[1]["prior_late_rate"] == pytest.approx(0.008)


def test_stream_keeps_late_unknown_and_foreign_features(spark):
    base_rows = features(spark, [1, 2]).persist()
    source, target = tempfile.mkdtemp(prefix="emberline-in-"), tempfile.mkdtemp(prefix="emberline-out-")

    def record(name, ts, loan, updates=None):
        return {"event_id": name, "ts": ts, "loan_id": loan, "type": "repayment", "feature_updates": updates}

    parts = [
        [record("new", "2024-01-09T00:00:00Z", 1, {"margin": 0.25}), record("gone", "2024-01-09T00:00:00Z", 77)],
        [record("late", "2024-01-02T00:00:00Z", 1), record("new", "2024-01-09T00:00:00Z", 1, {"margin": 0.25})],
    ]
    for i, part in enumerate(parts):
        with open(f"{source}/{i}.txt", "w") as f:
            f.writelines(json.dumps(e) + "\n" for e in part)
        for query in rescore.start_rescoring(ev.event_source(spark, source), base_rows, DEMO_SCORER, target):
            query.awaitTermination(240)
            assert query.exception() is None
    timeline = sorted(r["event_id"] for r in spark.read.parquet(f"{target}/timeline").collect())
    assert timeline == ["late", "new"]
    refused = spark.read.parquet(f"{target}/refused").collect()
    assert [(json.loads(r["value"])["event_id"], r["problem"]) for r in refused] == [("gone", "unknown_loan")]
    newest = spark.read.parquet(f"{target}/online").orderBy(F.desc("batch_id")).first()
    assert newest["loan_id"] == 1 and newest["features"]["margin"] == 0.25
    assert newest["features"]["prior_late_rate"] == pytest.approx(0.01 * 0.8)


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def write_events(source, name, rows):
    with open(f"{source}/{name}.txt", "w") as f:
        f.writelines(json.dumps(e) + "\n" for e in rows)


def hourly(hour, n, loan=1):
    """n repayments of one loan inside an hour counted from the start of 2024."""
    day = f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}"
    return [{"event_id": f"h{hour}-{i}", "ts": f"{day}:{i % 60:02d}:00Z", "loan_id": loan, "type": "repayment", "feature_updates": None} for i in range(n)]


def run_rescoring(spark, source, target, base_rows, **options):
    raw = ev.event_source(spark, source, max_files_per_trigger=1)
    good, _ = ev.parse_events(raw)
    rescored = rescore.rescore_stream(good, base_rows, DEMO_SCORER, **options)
    query = rescore.two_sink_fanout(rescored, f"{target}/timeline", f"{target}/alerts", f"{target}/check", True, f"{target}/online", f"{target}/refused")
    assert query.awaitTermination(240)
    assert query.exception() is None
    return query


def test_state_of_a_hot_loan_is_bounded_and_outlives_a_restart(spark):
    """Ids of old hours go as time advances; repeats inside the known hours are caught after a restart too."""
    base_rows = features(spark, [1]).persist()
    source, target = tempfile.mkdtemp(prefix="emberline-in-"), tempfile.mkdtemp(prefix="emberline-out-")
    for hour in range(8):
        write_events(source, hour, hourly(hour, 300))
    first = run_rescoring(spark, source, target, base_rows, known_hours=2)
    kept = state_rows(first)
    # The values, and at most the ids and slices of the known hours and the newest.
    assert max(kept) <= 3 * 300 + 3 + 2 and len(kept) >= 8
    write_events(source, "again", hourly(7, 300) + hourly(6, 300)[:5])
    write_events(source, "late", hourly(1, 3, loan=1) + [{**hourly(6, 1)[0], "event_id": "new but late"}])
    run_rescoring(spark, source, target, base_rows, known_hours=2)
    timeline = [r["event_id"] for r in spark.read.parquet(f"{target}/timeline").collect()]
    assert len(timeline) == len(set(timeline)) == 8 * 300 + 1 and "new but late" in timeline
    refused = spark.read.parquet(f"{target}/refused").collect()
    assert sorted(json.loads(r["value"])["event_id"] for r in refused) == ["h1-0", "h1-1", "h1-2"] and {r["problem"] for r in refused} == {"too_late"}
    late = spark.read.parquet(f"{target}/timeline").where("event_id = 'new but late'").count()
    assert late == 1


def test_many_ids_of_one_loan(spark):
    """A hundred thousand ids of one loan in a day: one row each while they are known, none after."""
    base_rows = features(spark, [1, 2]).persist()
    source, target = tempfile.mkdtemp(prefix="emberline-in-"), tempfile.mkdtemp(prefix="emberline-out-")
    for part in range(5):
        write_events(source, f"a{part}", [{**e, "event_id": f"{part}-{e['event_id']}"} for hour in range(5) for e in hourly(hour, 4000)])
    write_events(source, "b", hourly(24 * 9, 10))
    query = run_rescoring(spark, source, target, base_rows, known_hours=24)
    sizes = state_rows(query)
    assert max(sizes) >= 100_000 and sizes[-1] <= 10 + 1 + 2
    assert spark.read.parquet(f"{target}/timeline").count() == 100_010


def test_ids_leave_the_deduplication_as_time_advances(spark):
    """Repeats within the delay are dropped once, state follows the delay, and late events are beside, not lost."""
    source, target = tempfile.mkdtemp(prefix="emberline-in-"), tempfile.mkdtemp(prefix="emberline-out-")
    for hour in range(12):
        write_events(source, f"{hour:02d}", hourly(hour, 200) + (hourly(hour - 1, 50) if hour else []))
    queries = []
    for step in range(2):
        if step:
            write_events(source, "late", hourly(0, 201)[-1:] * 2 + hourly(11, 200) + hourly(2, 3, loan=5))
        queries = dedupe.start_dedupe(ev.event_source(spark, source, max_files_per_trigger=1), target, "2 hours")
        for query in queries:
            assert query.awaitTermination(240) and query.exception() is None
        if not step:
            held = state_rows(queries[-1])
            assert len(held) >= 12 and 200 <= max(held) <= 5 * 200
    kept, landed = spark.read.parquet(f"{target}/kept"), spark.read.schema(ev.EVENT_SCHEMA).parquet(f"{target}/landed")
    ids = [(r["loan_id"], r["event_id"]) for r in kept.collect()]
    late = [(r["loan_id"], r["event_id"]) for r in dedupe.late_events(landed, kept).collect()]
    assert len(ids) == len(set(ids)) == 12 * 200
    assert sorted(late) == [(1, "h0-200"), (5, "h2-0"), (5, "h2-1"), (5, "h2-2")]
    assert landed.count() == 12 * 200 + 11 * 50 + 205


class Store:
    """States in memory that count calls."""

    def __init__(self):
        self.calls, self.states = 0, {}

    def getValueState(self, name, _):  # noqa: N802
        return Held(self, self.states.setdefault(name, {}))

    def getMapState(self, name, *_):  # noqa: N802
        return Held(self, self.states.setdefault(name, {}))


class Held:
    def __init__(self, store, held):
        def counted(f):
            def call(*args):
                store.calls += 1
                return f(*args)

            return call

        self.exists = counted(lambda: bool(held))
        self.get, self.update = counted(lambda: held[()]), counted(lambda v: held.update({(): v}))
        self.containsKey, self.getValue = counted(lambda k: k in held), counted(lambda k: held[k])
        self.updateValue, self.removeKey = counted(lambda k, v: held.update({k: v})), counted(held.pop)
        self.iterator, self.keys = counted(lambda: list(held.items())), counted(lambda: list(held))


def test_few_ids_cost_no_call_each_and_many_are_still_known():
    store = Store()
    loan = rescore.Rescorer(known_hours=1000)
    loan.init(store)
    width = len(rescore.state.FEATURES)
    loan.handleInitialState((1,), pd.DataFrame({"base": [[0.0] * width]}), None)

    def send(*numbers):
        n = len(numbers)
        rows = pd.DataFrame({"event_id": [str(i) for i in numbers], "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(numbers, unit="min"), "loan_id": 1, "type": "x",
                             "feature_updates": [None] * n, "id_hash": numbers, "scale": [[1.0] * width] * n, "shift": [[0.0] * width] * n, "cap": [[np.inf] * width] * n})
        return [int(i) for out in loan.handleInputRows((1,), iter([rows]), None) for i in out["event_id"]]

    assert send(*range(500)) == list(range(500)) and send(*range(490, 510)) == list(range(500, 510))
    assert store.calls < 20 and not store.states["seen"]
    assert send(*range(505, 1700)) == list(range(510, 1700))
    assert len(store.states["seen"]) == 1700 and send(3, 600, 1699, 1700) == [1700]
    assert send(200_000) == [200_000] and len(store.states["seen"]) == 1 and send(200_000, 200_001) == [200_001]


@pytest.mark.parametrize("fold", [50, 10_000])
def test_loans_of_a_group_are_folded_together_with_few_calls(monkeypatch, fold):
    """A thousand offline loans cost a call for some 64; a batch reads the parts of its loans and writes an entry a loan."""
    monkeypatch.setattr(rescore, "FOLD_ROWS", fold)
    store, rng, width = Store(), random.Random(fold), len(state.FEATURES)
    group = rescore.Rescorer(known_hours=100_000)
    group.init(store)
    base = np.arange(1000.0 * width).reshape(1000, width) / 7
    base[5, state.LATE] = np.nan
    # Loan 0 comes twice.
    loans, values = [*range(0, 3000, 3), 0], np.concatenate([base, -base[:1] - 1])
    group.handleInitialState((3,), pd.DataFrame({"loans": [loans], "base": [values.ravel()]}), None)
    assert store.calls <= 2 * 1000 / 64
    events = [(rng.choice([0, 3, 15, 30, 2997, 1]), str(i), pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=rng.randint(0, 600))) for i in range(400)]

    def send(chosen):
        n = len(chosen)
        scale, shift = np.ones((n, width)), np.zeros((n, width))
        scale[:, state.LATE], shift[:, 0] = 0.5, [int(name) for _, name, _ in chosen]
        rows = pd.DataFrame({"event_id": [e[1] for e in chosen], "ts": [e[2] for e in chosen], "loan_id": [e[0] for e in chosen], "type": "x",
                             "feature_updates": [{"margin": float(e[1])} if int(e[1]) % 9 == 0 else None for e in chosen], "id_hash": [int(e[1]) * 11 for e in chosen],
                             "scale": list(scale), "shift": list(shift), "cap": [np.full(width, np.inf)] * n})
        return pd.concat([*group.handleInputRows((3,), iter([rows[: n // 3], rows[n // 3 :]]), None), pd.DataFrame()])

    held, names = {loan: base[loan // 3].copy() for loan in (0, 3, 15, 30, 2997)}, {}
    for first, part in ((0, events[:250]), (250, events[200:])):
        calls = store.calls
        got = send(part).set_index("event_id")
        # Each of the few loans: whether it has an entry, the entry, and the new entry; and its part read and written.
        assert store.calls - calls <= 6 * 5 + 2 * -(-len(part) // fold) * 2
        assert set(got[got["problem"] == "unknown_loan"].index) == {e[1] for e in part if e[0] == 1}
        fresh = sorted((e for e in part if e[0] != 1 and int(e[1]) >= first), key=lambda e: (e[2], e[1]))
        assert set(got[got["problem"].isna()].index) == {e[1] for e in fresh}
        for loan, name, _ in fresh:
            was = held[loan]
            held[loan] = was.copy()
            held[loan][state.LATE] = (0.0 if np.isnan(was[state.LATE]) else was[state.LATE]) * 0.5
            held[loan][0] += int(name)
            if int(name) % 9 == 0:
                names[loan] = {"margin": float(name)}
            assert got.loc[name, "before"] == pytest.approx(was.tolist(), nan_ok=True)
            assert got.loc[name, "after"] == pytest.approx(held[loan].tolist(), nan_ok=True)
            assert got.loc[name, "named"] == names.get(loan, {})
    kept = [np.frombuffer(loans, dtype="<i8") for loans, _ in store.states["offline"].values()]
    assert sorted(np.concatenate(kept).tolist()) == sorted(set(range(0, 3000, 3)) - held.keys()) and store.states["loans"].keys() == {(loan,) for loan in held}
