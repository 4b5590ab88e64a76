import random

import pytest
from pyspark.sql import functions as F

from emberline.functions.scalar import keyword_flag, signed_sentiment
from emberline.operators import graph as gr
from emberline.operators import text as tx


def edge_rows(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.3 else rng.randint(2, 15), rng.randint(100, 112), float(rng.randint(1, 40)), rng.randint(0, 8)) for _ in range(700)]
    return rows, spark.createDataFrame(rows, "firm_id long, counterparty_id long, txn_value double, month_no int")


def test_profile_and_ties(spark):
    rows = [(1, 9, 5.0), (1, 3, 2.0), (1, 3, 3.0), (2, 4, 7.0)]
    edges = gr.edge_build(spark.createDataFrame(rows, "firm_id long, counterparty_id long, txn_value double"))
    got = {r["firm_id"]: r for r in gr.firm_profile(edges).collect()}
    assert got[1]["top_counterparty"] == 3 and got[1]["degree"] == 2 and got[1]["counterparty_concentration"] == 0.5
    assert got[2]["counterparty_concentration"] == 1.0


def test_features_equal_brute_force(spark):
    rows, df = edge_rows(spark)
    edges = gr.edge_build(df)
    value = {}
    for f, c, v, _ in rows:
        value[(f, c)] = value.get((f, c), 0.0) + v
    firms, partners = {f for f, _ in value}, {c for _, c in value}
    volume = {c: sum(v for (_, k), v in value.items() if k == c) for c in partners}
    share = {c: (sum(w < volume[c] for w in volume.values()) + (sum(w == volume[c] for w in volume.values()) + 1) / 2) / len(volume) for c in partners}
    for r in gr.graph_features(edges).collect():
        mine = {c: v for (f, c), v in value.items() if f == r["borrower_id"]}
        top = min(mine, key=lambda c: (-mine[c], c))
        assert r["counterparty_concentration"] == pytest.approx(mine[top] / sum(mine.values()))
        assert r["degree_centrality"] == pytest.approx(len(mine) / (len(firms) + len(partners) - 1))
        assert r["anchor_linkage_flag"] == int(share[top] > 0.8)
    assert gr.degree_check(df, edges).first()["mismatches"] == 0


def test_churn_equals_set_arithmetic(spark):
    rows, df = edge_rows(spark)
    got = {(r["firm_id"], r["month_no"]): r["churn"] for r in gr.network_churn(df).collect()}
    want = {}
    for firm in {r[0] for r in rows}:
        months = sorted({r[3] for r in rows if r[0] == firm})
        sets = {m: {r[1] for r in rows if r[0] == firm and r[3] == m} for m in months}
        for before, now in zip(months, months[1:]):
            want[(firm, now)] = len(sets[before] - sets[now]) / len(sets[before])
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_distress_words(spark):
    notes = ["Delivery DELAYS continue", "partnership dispute", "work stoppage", "unit closures", "order book healthy"]
    got = spark.createDataFrame([(n,) for n in notes], "t string").select(keyword_flag(F.col("t"))).collect()
    assert [r[0] for r in got] == [1, 1, 1, 1, 0]


def test_signed_sentiment(spark):
    rows = spark.createDataFrame([("positive", 0.9), ("negative", 0.8), ("neutral", 0.7), ("other", 0.7)], "l string, s double")
    assert [r[0] for r in rows.select(signed_sentiment(F.col("l"), F.col("s"))).collect()] == [0.9, -0.8, 0.0, 0.0]


def test_each_text_is_computed_once_and_mapped_back(spark):
    notes = spark.createDataFrame([(i, t) for i, t in enumerate(["healthy order book", "delay", "healthy order book", "quiet", "delay"])], "borrower_id long, note string")
    seen = spark.sparkContext.accumulator(0)

    def compute(distinct):
        seen.add(distinct.count())
        return tx.flag_and_sentiment(distinct)

    got = {r["borrower_id"]: (r["sentiment_label"], r["distress_keyword_flag"]) for r in tx.map_back(notes, "note", compute).collect()}
    assert seen.value == 3
    assert got == {0: ("positive", 0), 1: ("negative", 1), 2: ("positive", 0), 3: ("neutral", 0), 4: ("negative", 1)}


def test_components_are_centred_and_ordered(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(5, 1 + 3 * (j == 2)) for j in range(6)]) for i in range(200)]
    got = tx.text_pca(spark.createDataFrame(rows, "id long, v array<float>"), "v", 3)
    stats = got.agg(*[F.avg(f"text_pc_{i}") for i in (1, 2, 3)], *[F.var_samp(f"text_pc_{i}") for i in (1, 2, 3)]).first()
    assert all(abs(m) < 1e-5 for m in stats[:3])
    assert stats[3] > stats[4] > stats[5] and stats[3] > 10
    few = tx.text_pca(spark.createDataFrame(rows[:3], "id long, v array<float>"), "v", 12)
    assert [c for c in few.columns if c.startswith("text_pc")] == ["text_pc_1", "text_pc_2"]
