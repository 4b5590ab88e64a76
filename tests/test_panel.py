import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import panel as pan

SCHEMA = "borrower_id long, loan_id long, instalment_no int, due_day int, paid_day int"


def loan(borrower, loan_id, months, start=-400, late=None, unpaid=()):
    late = late or {}
    return [
        (borrower, loan_id, m, start + 30 * m, None if m in unpaid else start + 30 * m + late.get(m, 0))
        for m in months
    ]


def panel_of(spark, rows):
    panel = pan.build_person_period_panel(spark.createDataFrame(rows, SCHEMA))
    return [(r[1], r[2]) for r in panel.orderBy("borrower_id", "months_since_origination").collect()]


def test_censored_loan(spark):
    assert panel_of(spark, loan(1, 10, range(1, 9))) == [(m, 0) for m in range(1, 9)]


def test_event_truncates(spark):
    got = panel_of(spark, loan(1, 10, range(1, 10), late={5: 45}))
    assert got == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 1)]


def test_horizon_caps(spark):
    assert len(panel_of(spark, loan(1, 10, range(1, 25)))) == 12


def test_event_after_the_cap_is_censored(spark):
    got = panel_of(spark, loan(1, 10, range(1, 20), late={15: 60}))
    assert got == [(m, 0) for m in range(1, 13)]


def test_unpaid_is_an_event(spark):
    assert panel_of(spark, loan(1, 10, range(1, 6), unpaid=(3,))) == [(1, 0), (2, 0), (3, 1)]


def test_only_recent_loan(spark):
    rows = loan(1, 10, range(1, 7), start=-2000) + loan(1, 11, range(1, 4), start=-200)
    assert len(panel_of(spark, rows)) == 3


def test_month_zero_only_disappears(spark):
    assert panel_of(spark, loan(1, 10, [0])) == []


def test_missing_months_are_expanded(spark):
    assert [m for m, _ in panel_of(spark, loan(1, 10, [2, 6]))] == [1, 2, 3, 4, 5, 6]


def test_unknown_due_day_is_latest_and_ties_take_the_larger_loan(spark):
    rows = [(1, 10, 1, 100, 100), (1, 11, 1, None, 5), (2, 20, 1, 7, 7), (2, 21, 1, 7, 7)]
    got = pan.latest_loan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r[0], r[1]) for r in got} == {(1, 11), (2, 21)}


def random_rows(seed, hot=False):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        borrower = 1 if hot and rng.random() < 0.4 else rng.randint(1, 12)
        due = rng.randint(-900, -1)
        paid = None if rng.random() < 0.03 else due + rng.choice([-3, 0, 0, 2, 31, 45])
        rows.append((borrower, borrower * 10 + rng.randint(0, 3), rng.randint(0, 16), due, paid))
    return rows


def brute_force(rows):
    """(duration, event, prior rate, prior rows) per borrower by plain loops."""
    out = {}
    for b in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == b]
        last = max((max(r[3] for r in mine if r[1] == l), l) for l in {r[1] for r in mine})[1]
        recent = [r for r in mine if r[1] == last and r[2] >= 1]
        others = [r for r in mine if r[1] != last]
        late = lambda r: (9999 if r[4] is None else r[4] - r[3]) > 30
        if recent:
            observed = min(max(r[2] for r in recent), 12)
            first = min((r[2] for r in recent if late(r)), default=99)
            duration = (first, 1) if first <= observed else (observed, 0)
        else:
            duration = (None, None)
        rate = sum(map(late, others)) / len(others) if others else None
        out[b] = (*duration, rate, len(others) or None)
    return out


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_history_equals_brute_force(spark, seed, hot):
    rows = random_rows(seed, hot)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {
        r["borrower_id"]: (r["duration"], r["event"], r["prior_late_rate"], r["prior_n_installments"])
        for r in pan.borrower_history(df).collect()
    }
    want = brute_force(rows)
    assert got.keys() == want.keys()
    for b, (d, e, rate, n) in want.items():
        assert got[b][:2] == (d, e) and got[b][3] == n
        assert got[b][2] == (None if rate is None else pytest.approx(rate))


def test_separate_operators_agree_with_the_single_pass(spark):
    df = spark.createDataFrame(random_rows(3), SCHEMA)
    history = pan.borrower_history(df)
    durations = pan.loan_durations(pan.keep_most_recent_loan(df))
    assert durations.exceptAll(history.where("duration is not null").select("borrower_id", "duration", "event")).isEmpty()
    prior = pan.prior_loan_behavior(df)
    same = history.where("prior_n_installments is not null").select("borrower_id", "prior_late_rate", "prior_n_installments")
    assert prior.exceptAll(same).isEmpty() and same.exceptAll(prior).isEmpty()
    parts = pan.keep_most_recent_loan(df).unionByName(pan.other_loans_only(df))
    assert parts.exceptAll(df).isEmpty() and df.exceptAll(parts).isEmpty()


def test_panel_invariants(spark):
    df = spark.createDataFrame(random_rows(4), SCHEMA)
    durations = pan.recent_loan_durations(df)
    panel = pan.expand_person_period(durations)
    sums = durations.agg(F.sum("duration"), F.sum("event")).first()
    assert (panel.count(), panel.agg(F.sum("event")).first()[0]) == (sums[0], sums[1])
    assert pan.panel_durations(panel).exceptAll(durations).isEmpty()
    slow = pan.life_table_hazard(panel.withColumn("g", F.col("borrower_id") % 2), ["g"])
    fast = pan.life_table_from_durations(durations.withColumn("g", F.col("borrower_id") % 2), ["g"])
    assert slow.select(*fast.columns).exceptAll(fast).isEmpty()
