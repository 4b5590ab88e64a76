"""Sharding, line dedup and mixing against plain Python, with odd rows."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberline.llm import lines, mixing, shards

DOCS = "doc_id long, text string, source string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd_rows(n=600, seed=1):
    """A hot group of copies, a hot source, nulls, empty and long texts, repeated rows."""
    g = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "été", "日本", "x"]
    rows = []
    for i in range(n):
        text = " ".join(g.choice(words) for _ in range(g.randint(1, 40)))
        if i % 3 == 0:
            text = "the same text again and again"
        rows.append((i, text, "hot" if g.random() < 0.4 else f"s{g.randint(0, 9)}"))
    rows += [(None, "no id", "s1"), (7001, None, None), (7002, "", "s2"), (7003, " \n\t ", None), (7004, "w " * 30_000, "s3")]
    return rows + [(7005, "twice", "s4")] * 2


def test_packing_balances_and_numbers(spark):
    rows = odd_rows()
    got = shards.pack(frame(spark, rows), shards=4).collect()
    assert len(got) == len(rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    want = Counter((i, len((t or "").encode()) + 8) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == want
    assert next(r["text_crc32"] for r in got if r["doc_id"] == 7001) is None


def test_packing_keeps_groups_and_splits_the_hot_one(spark):
    g = random.Random(2)
    rows = [(i, f"text {g.randint(0, 900)} " + "y " * g.randint(1, 60), "s") for i in range(3000)] + [(i, "copy " * 20, "s") for i in range(3000, 4500)]
    got = shards.pack(frame(spark, rows), shards=4).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() < 1.03 * sizes.min() and got.groupby("shard").size().max() < 1.05 * got.groupby("shard").size().min()
    spread = got.groupby("text_crc32")["shard"].nunique()
    assert (spread > 1).sum() == 1 and spread.max() == 4


def test_packing_of_nothing_and_of_one(spark):
    assert shards.pack(frame(spark, [])).count() == 0
    only = shards.pack(frame(spark, [(1, None, None)])).collect()
    assert [(r["size"], r["slot"]) for r in only] == [(8, 0)]


def plain_lines(rows, least):
    spread, first = defaultdict(set), {}
    for i, text, source in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for at, raw in enumerate((text or "").split("\n") if text is not None else []):
            line = raw.strip(" \t\n\x0b\x0c\r")
            if line:
                spread[line].add(source)
                first.setdefault(line, (i, at))
    out = Counter()
    for i, text, _ in rows:
        if text is None:
            out[i, None, 0] += 1
            continue
        kept, gone = [], 0
        for at, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\n\x0b\x0c\r")
            if line and len(spread[line]) >= least and first[line] != (i, at):
                gone += 1
            else:
                kept.append(raw)
        out[i, "\n".join(kept), gone] += 1
    return out


def test_lines_equal_plain_counts(spark):
    g = random.Random(3)
    pool = [f"line {k} of the pool" for k in range(60)]
    rows = [(i, "\n".join([g.choice(pool) if g.random() < 0.5 else f"own {i} {k}" for k in range(g.randint(1, 8))] + ["", "  footer "]), f"s{g.randint(0, 11)}") for i in range(400)]
    rows += [(9001, None, "s1"), (9002, "", None), (9003, "footer", None), (9004, " footer\n" * 200, "s0")] + [(9005, "footer\nend", "s2")] * 2
    for least in (5, 9, 12):
        got = lines.remove_boilerplate(frame(spark, rows), least).select("doc_id", "text", "lines_removed").collect()
        assert Counter(map(tuple, got)) == plain_lines(rows, least)


def test_lines_keep_clashing_columns_and_accept_nothing(spark):
    rows = [(i, "shared\nown %d" % i, f"s{i}") for i in range(9)]
    df = frame(spark, rows).select("*", F.lit(1).alias("pos"), F.lit("x").alias("row_a"), F.lit(2.5).alias("removed"), F.lit(3).alias("doc"))
    got = lines.cleaned(df, 8).select("doc.*")
    assert got.columns == df.columns and got.where("text LIKE 'shared%'").count() == 1
    assert lines.cleaned(frame(spark, [])).count() == 0


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rows = [r for r in odd_rows(1500, seed=4) if r[0] != 7004]
    got = mixing.mix(frame(spark, rows)).toPandas()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(dict(sizes))
    got["taken"] = got["size"] * got["copies"]
    for source, part in got.groupby(got["source"].fillna("\0null")):
        name = None if source == "\0null" else source
        assert part["target"].iloc[0] == pytest.approx(want[name])
        assert abs(part["taken"].sum() - want[name]) <= part["size"].max() / 2 + 1e-6
        assert part["copies"].max() - part["copies"].min() <= 1 and part["copies"].max() <= 2
    again = mixing.mix(frame(spark, rows[::-1])).toPandas()
    key = ["doc_id", "size", "copies"]
    assert sorted(map(tuple, got[key].fillna(-1).to_numpy().tolist())) == sorted(map(tuple, again[key].fillna(-1).to_numpy().tolist()))


def test_mix_prefers_quality(spark):
    """By exponential keys a text of letters is drawn about four times as likely as one of signs."""
    rows = [(i, ("word " if i % 2 else "#### ") * 10, "only" if i < 4000 else "zother") for i in range(8000)]
    got = mixing.mix(frame(spark, rows), weights=(1, 3), share=0.5).toPandas()
    drawn = got[(got["source"] == "only") & (got["copies"] > 0)]
    assert 2 < (drawn["doc_id"] % 2 == 1).sum() / (drawn["doc_id"] % 2 == 0).sum() < 5


def test_mixed_rows_repeat_and_keep_columns(spark):
    df = frame(spark, odd_rows(300)).select("*", F.lit(1).alias("size"), F.lit(2).alias("key"), F.lit(3).alias("bucket"), F.lit(4).alias("copies"))
    rows = mixing.mixed_rows(df)
    assert rows.columns == df.columns
    assert rows.count() == mixing.mix(df.select("doc_id", "text", "source")).agg(F.sum("copies")).first()[0]
    assert mixing.mixed_rows(df.limit(0)).count() == 0 and math.isfinite(mixing.SHARE)
