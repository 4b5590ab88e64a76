"""Queries over graph, text, explanations, counterfactuals and stress."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import pairwise
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions import explain as ex
from emberline.functions import grades as G
from emberline.functions import scalar as S
from emberline.functions.scorer import DEMO_SCORER, DEMO_THIN_SCORER
from emberline.operators import calibrate as cal
from emberline.operators import graph as gr
from emberline.operators import metrics as met
from emberline.operators import panel as pan
from emberline.operators import portfolio as port
from emberline.operators import stress as st
from emberline.operators import text as tx
from emberline.operators.features import data_richness, ratio_columns
from emberline.operators.features import enrich_join as join_enrichment
from emberline.operators.journal import append_log
from emberline.operators.ordered import average_rank
from emberline.plans import frames
from emberline.plans.book_queries import rounded
from emberline.plans.registry import query
from emberline.plans.sqlscore import grade_sql, logit_sql, number, pd_sql
from emberline.plans.sqlviews import sql, view
from emberline.session import cut_lineage, ensure_checkpoint_dir, settle
from emberline.sources import views

# ---- graph


def edges(spark: SparkSession, d: str) -> DataFrame:
    return gr.edge_build(views.edge_rows(spark, d), places=4)


def edge_table(spark: SparkSession, d: str) -> DataFrame:
    """The edges written once, for reports that read them several times."""
    return cut_lineage(edges(spark, d))


@query("edge_build", sql("SELECT firm_id, counterparty_id, txn_value FROM edges", "edges"))
def edge_build(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@query("counterparty_concentration", sql("SELECT firm_id, round(max(txn_value) / sum(txn_value), 6) AS counterparty_concentration FROM edges GROUP BY 1", "edges"))
def counterparty_concentration(spark: SparkSession, d: str) -> DataFrame:
    rows = gr.firm_profile(edges(spark, d)).select("firm_id", "counterparty_concentration")
    return rounded(rows, "counterparty_concentration")


@query("degree_centrality", sql(
    "SELECT firm_id, count(*) AS degree, round(count(*) / ((SELECT count(DISTINCT firm_id) + count(DISTINCT counterparty_id) FROM edges) - 1), 9) AS degree_centrality FROM edges GROUP BY 1", "edges"))
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.degree_centrality(edge_table(spark, d)), "degree_centrality", places=9)


TOP_SQL = "SELECT firm_id, counterparty_id, txn_value AS top_value FROM (SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY txn_value DESC, counterparty_id) AS r FROM edges) x WHERE r = 1"
view("tops", TOP_SQL, "edges")
view(
    "ranks",
    """
    SELECT counterparty_id, volume, (rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2) / count(*) OVER () AS volume_pct
    FROM (SELECT counterparty_id, sum(txn_value) AS volume FROM edges GROUP BY 1) v
    """,
    "edges",
)


@query("top_counterparty", sql("SELECT * FROM tops", "tops"))
def top_counterparty(spark: SparkSession, d: str) -> DataFrame:
    return gr.top_counterparty(edges(spark, d))


@query("pct_rank_average", "SELECT o_custkey, round(t, 4) AS total, round((rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2) / count(*) OVER (), 6) AS pct FROM (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS t FROM orders GROUP BY 1) x")
def pct_rank_average(spark: SparkSession, d: str) -> DataFrame:
    counts = views.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("total"))
    return rounded(average_rank(counts, "total", "pct"), "pct").select("o_custkey", "total", "pct")


@query("counterparty_lookup", sql("SELECT firm_id, t.counterparty_id, s_name AS counterparty_name FROM tops t LEFT JOIN supplier ON s_suppkey = t.counterparty_id", "tops"))
def counterparty_lookup(spark: SparkSession, d: str) -> DataFrame:
    suppliers = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("counterparty_id"), F.col("s_name").alias("counterparty_name"))
    return gr.top_counterparty(edges(spark, d)).select("firm_id", "counterparty_id").join(suppliers, "counterparty_id", "left")


@query("anchor_linkage_flag", sql("SELECT firm_id, t.counterparty_id, round(volume_pct, 6) AS volume_pct, CAST(volume_pct > 0.8 AS INTEGER) AS anchor_linkage_flag FROM tops t JOIN ranks r ON t.counterparty_id = r.counterparty_id", "tops", "ranks"))
def anchor_linkage_flag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.anchor_linkage(edge_table(spark, d)), "volume_pct")


@query("graph_features", sql(
    """SELECT e.firm_id AS borrower_id, round(max(e.txn_value) / sum(e.txn_value), 6) AS counterparty_concentration,
    round(count(*) / ((SELECT count(DISTINCT firm_id) + count(DISTINCT counterparty_id) FROM edges) - 1), 9) AS degree_centrality,
    CAST(max(volume_pct) > 0.8 AS INTEGER) AS anchor_linkage_flag
    FROM edges e JOIN tops t ON e.firm_id = t.firm_id JOIN ranks r ON r.counterparty_id = t.counterparty_id GROUP BY 1""", "tops", "ranks"))
def graph_features(spark: SparkSession, d: str) -> DataFrame:
    rows = rounded(gr.graph_features(edge_table(spark, d)), "counterparty_concentration")
    return rounded(rows, "degree_centrality", places=9)


@query("network_churn", sql(
    """SELECT firm_id, month_no, previous_size, round(1 - kept / previous_size, 6) AS churn FROM (
      SELECT m.firm_id, m.month_no, count(*) AS previous_size, count(c.counterparty_id) AS kept
      FROM (SELECT firm_id, month_no, lag(month_no) OVER (PARTITION BY firm_id ORDER BY month_no) AS prev FROM (SELECT DISTINCT firm_id, month_no FROM edge_rows) d) m
      JOIN (SELECT DISTINCT firm_id, counterparty_id, month_no FROM edge_rows) p ON p.firm_id = m.firm_id AND p.month_no = m.prev
      LEFT JOIN (SELECT DISTINCT firm_id, counterparty_id, month_no FROM edge_rows) c ON c.firm_id = m.firm_id AND c.month_no = m.month_no AND c.counterparty_id = p.counterparty_id
      GROUP BY 1, 2) x""", "edge_rows"))
def network_churn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gr.network_churn(views.edge_rows(spark, d)), "churn")


@query("degree_check", sql("SELECT count(DISTINCT firm_id) AS firms_checked, 0 AS mismatches FROM edge_rows", "edge_rows"))
def degree_check(spark: SparkSession, d: str) -> DataFrame:
    return gr.degree_check(views.edge_rows(spark, d), edges(spark, d))


view(
    "conc",
    """SELECT firm_id, max(txn_value) / sum(txn_value) AS score, CAST(count(*) < 30 AS INTEGER) AS label FROM edges GROUP BY 1""",
    "edges",
)


@query("separability", sql(
    """SELECT round((SELECT (sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))
        FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM conc) r), 4) AS auc,
      round(avg(score) FILTER (WHERE label = 1), 4) AS mean_flagged, round(avg(score) FILTER (WHERE label = 0), 4) AS mean_unflagged,
      round((avg(score) FILTER (WHERE label = 1) - avg(score) FILTER (WHERE label = 0)) / sqrt((var_samp(score) FILTER (WHERE label = 1) + var_samp(score) FILTER (WHERE label = 0)) / 2), 4) AS cohens_d,
      count(*) FILTER (WHERE label = 1) AS n_flagged, count(*) FILTER (WHERE label = 0) AS n_unflagged FROM conc""", "conc"))
def separability(spark: SparkSession, d: str) -> DataFrame:
    rows = gr.firm_profile(edges(spark, d)).select(
        "firm_id", F.col("counterparty_concentration").alias("score"), (F.col("degree") < 30).cast("int").alias("label")
    )
    return met.separability(rows, "label", "score").drop("separated")


@query("enrich_join", sql(
    """SELECT f.borrower_id, f.data_richness, round(e.c, 6) AS counterparty_concentration, e.flag AS distress_keyword_flag,
      CASE WHEN e.borrower_id IS NOT NULL THEN 'transaction_graph' END AS graph_data_provenance,
      CASE WHEN e.borrower_id IS NOT NULL THEN 'documents' END AS text_data_provenance
    FROM segd f LEFT JOIN (
      SELECT n.borrower_id, g.c, CAST(regexp_matches(officer_note, 'license', 'i') AS INTEGER) AS flag
      FROM notes n JOIN (SELECT firm_id, max(txn_value) / sum(txn_value) AS c FROM edges GROUP BY 1) g ON g.firm_id = n.borrower_id) e
      ON e.borrower_id = f.borrower_id""",
    "segd", "edges", "notes"))
def enrich_join(spark: SparkSession, d: str) -> DataFrame:
    features = data_richness(views.applications(spark, d), views.bureau(spark, d)).select("borrower_id", "data_richness")
    graph = gr.firm_profile(edges(spark, d)).select(F.col("firm_id").alias("borrower_id"), "counterparty_concentration")
    notes = views.notes(spark, d).select("borrower_id", S.keyword_flag(F.col("officer_note"), "license").alias("distress_keyword_flag"))
    joined = join_enrichment(features, S.tag_provenance(graph, "transaction_graph"), S.tag_provenance(notes, "documents"))
    return rounded(joined, "counterparty_concentration")


# ---- text

POSITIVE, NEGATIVE = ("le", "que", "ou"), ("and", "of", "is")


@query("distress_flag", sql(
    "SELECT borrower_id, CAST(regexp_matches(officer_note, 'delay|disput|stoppage|closure', 'i') AS INTEGER) AS distress, CAST(regexp_matches(officer_note, 'license', 'i') AS INTEGER) AS license FROM notes", "notes"))
def distress_flag(spark: SparkSession, d: str) -> DataFrame:
    note = F.col("officer_note")
    return views.notes(spark, d).select("borrower_id", S.keyword_flag(note).alias("distress"), S.keyword_flag(note, "license").alias("license"))


view(
    "tone",
    f"""
    SELECT borrower_id, lang, CASE WHEN up > down THEN 'positive' WHEN up < down THEN 'negative' ELSE 'neutral' END AS sentiment_label,
      CASE WHEN up + down > 0 THEN abs(up - down) / (up + down) ELSE 0.0 END AS sentiment_score
    FROM (SELECT borrower_id, lang, len(list_filter(t, lambda x: x IN {POSITIVE})) AS up, len(list_filter(t, lambda x: x IN {NEGATIVE})) AS down
          FROM (SELECT borrower_id, lang, regexp_extract_all(lower(officer_note), '[a-z]+') AS t FROM notes) a) b
    """,
    "notes",
)


def toned(distinct: DataFrame) -> DataFrame:
    return tx.flag_and_sentiment(distinct, "license", POSITIVE, NEGATIVE)


@query("signed_sentiment", sql(
    "SELECT borrower_id, sentiment_label, round(CASE sentiment_label WHEN 'positive' THEN sentiment_score WHEN 'negative' THEN -sentiment_score ELSE 0 END, 6) AS sentiment_signed FROM tone", "tone"))
def signed_sentiment(spark: SparkSession, d: str) -> DataFrame:
    rows = views.notes(spark, d).withColumn("s", tx.lexicon_sentiment(F.col("officer_note"), POSITIVE, NEGATIVE))
    signed = S.signed_sentiment(F.col("s.sentiment_label"), F.col("s.sentiment_score"))
    return rows.select("borrower_id", "s.sentiment_label", F.round(signed, 6).alias("sentiment_signed"))


@query("note_map_back", sql(
    "SELECT t.borrower_id, sentiment_label, round(sentiment_score, 6) AS sentiment_score, CAST(regexp_matches(officer_note, 'license', 'i') AS INTEGER) AS distress_keyword_flag FROM tone t JOIN notes n ON t.borrower_id = n.borrower_id", "tone"))
def note_map_back(spark: SparkSession, d: str) -> DataFrame:
    notes = views.notes(spark, d).select("borrower_id", "officer_note")
    rows = tx.map_back(notes, "officer_note", toned)
    return rounded(rows.select("borrower_id", "sentiment_label", "sentiment_score", "distress_keyword_flag"), "sentiment_score")


@query("note_tone_shares", sql(
    "SELECT sentiment_label, count(*) AS n, round(count(*) / (SELECT count(*) FROM tone), 6) AS share FROM tone GROUP BY 1", "tone"))
def note_tone_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = views.notes(spark, d).select(tx.lexicon_sentiment(F.col("officer_note"), POSITIVE, NEGATIVE)["sentiment_label"].alias("sentiment_label"))
    return rounded(tx.note_tone_shares(rows, "sentiment_label"), "share")


@query("text_pca")
def text_pca(spark: SparkSession, d: str) -> DataFrame:
    return tx.text_pca(views.table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").drop("embedding")


@query("text_pca_checks", "SELECT count(*) AS n, true AS centred, true AS orthogonal, true AS falling FROM embeddings WHERE embedding IS NOT NULL")
def text_pca_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of principal components whatever their signs: no mean, no covariance, falling variance."""
    parts = text_pca(spark, d)
    names = [c for c in parts.columns if c.startswith("text_pc_")]
    spread = [F.var_samp(c) for c in names]
    crossed = [F.abs(F.corr(a, b)) < 1e-6 for i, a in enumerate(names) for b in names[:i]]
    return parts.agg(
        F.count(F.lit(1)).alias("n"),
        reduce(and_, [F.abs(F.avg(c)) < 1e-6 for c in names]).alias("centred"),
        reduce(and_, crossed).alias("orthogonal"),
        reduce(and_, [x >= y for x, y in pairwise(spread)]).alias("falling"),
    )


def described(spark: SparkSession, d: str) -> DataFrame:
    """Note features with one vector for each distinct text."""
    notes = views.notes(spark, d).select("borrower_id", "officer_note")
    embeddings = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    keyed = notes.select(tx.text_key(F.col("officer_note")).alias("text_key"), "borrower_id")
    first = keyed.groupBy("text_key").agg((F.min("borrower_id") % embeddings.count()).alias("vec_id"))
    vectors = first.join(embeddings, "vec_id").drop("vec_id")
    return tx.text_features(notes, "borrower_id", "officer_note", vectors, pattern="license")


@query("text_features", sql(
    "SELECT borrower_id, CAST(regexp_matches(officer_note, 'license', 'i') AS INTEGER) AS distress_keyword_flag, true AS has_components FROM notes", "notes"))
def text_features(spark: SparkSession, d: str) -> DataFrame:
    return described(spark, d).select("borrower_id", "distress_keyword_flag", F.col("text_pc_1").isNotNull().alias("has_components"))


# ---- attributions, narrative, counterfactual

LABELS_SQL = ", ".join(f"'{f}': '{ex.driver_label(f)}'" for f in DEMO_SCORER.coefficients)
view(
    "contrib",
    " UNION ALL ".join(
        f"SELECT borrower_id, {i} AS i, '{name}' AS feature, '{ex.driver_label(name)}' AS label, round(CAST({name} AS DOUBLE), 4) AS value, "
        f"round(coalesce({number(c)} * ({name} - {number(DEMO_SCORER.means[name])}), 0), 5) AS shap, "
        f"coalesce({number(c)} * ({name} - {number(DEMO_SCORER.means[name])}), 0) > 0 AS up FROM book"
        for i, (name, c) in enumerate(DEMO_SCORER.coefficients.items())
    ),
    "book",
)
view("drv", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY borrower_id ORDER BY abs(shap) DESC, i) AS r FROM contrib) x WHERE r <= 5", "contrib")
DRIVER_COLUMNS = "borrower_id, r, feature, label, value, shap, CASE WHEN up THEN 'increases risk' ELSE 'decreases risk' END AS direction"


def with_drivers(spark: SparkSession, d: str) -> DataFrame:
    return frames.scored_book(spark, d).withColumn("drivers", ex.top_drivers(ex.attributions(DEMO_SCORER)))


def exploded(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("borrower_id", F.posexplode(column).alias("r", "d")).select(
        "borrower_id", (F.col("r") + 1).alias("r"), "d.feature", "d.label", "d.value", "d.shap", "d.direction"
    )


@query("attributions", sql("SELECT borrower_id, i + 1 AS r, feature, label, value, shap, CASE WHEN up THEN 'increases risk' ELSE 'decreases risk' END AS direction FROM contrib", "contrib"))
def attributions(spark: SparkSession, d: str) -> DataFrame:
    return exploded(frames.scored_book(spark, d).withColumn("a", ex.attributions(DEMO_SCORER)), "a")


@query("top_drivers", sql(f"SELECT {DRIVER_COLUMNS} FROM drv", "drv"))
def top_drivers(spark: SparkSession, d: str) -> DataFrame:
    return exploded(with_drivers(spark, d), "drivers")


@query("driver_label", sql("SELECT DISTINCT feature, label, CASE WHEN up THEN 'increases risk' ELSE 'decreases risk' END AS direction FROM drv", "drv"))
def driver_label(spark: SparkSession, d: str) -> DataFrame:
    return exploded(with_drivers(spark, d), "drivers").select("feature", "label", "direction").distinct()


NARRATIVE_SQL = """
SELECT b.borrower_id, printf('Grade %s: %.1f%% chance of default within 12 months. First comes ', risk_grade, pd * 100)
  || lead || '. Then: ' || rest || '.' AS narrative
FROM book b JOIN (
  SELECT borrower_id, max(told) FILTER (r = 1) AS lead, string_agg(told, '; ' ORDER BY r) FILTER (r > 1) AS rest
  FROM (SELECT *, lower(label) || CASE WHEN value IS NULL THEN '' ELSE ' = ' || printf('%g', value) END || ' '
      || CASE WHEN up THEN 'increases risk' ELSE 'decreases risk' END || ' by ' || printf('%+g', shap + 0.0) AS told FROM drv) d
  GROUP BY 1) t ON t.borrower_id = b.borrower_id
"""


@query("templated_narrative", sql(NARRATIVE_SQL, "drv"))
def templated_narrative(spark: SparkSession, d: str) -> DataFrame:
    rows = with_drivers(spark, d)
    return rows.select("borrower_id", ex.templated_narrative(F.col("drivers"), F.col("risk_grade"), F.col("pd")).alias("narrative"))


@query("verify_narrative", sql("SELECT borrower_id, true AS template_ok, false AS wrong_ok FROM book", "book"))
def verify_narrative(spark: SparkSession, d: str) -> DataFrame:
    rows = with_drivers(spark, d)
    text = ex.templated_narrative(F.col("drivers"), F.col("risk_grade"), F.col("pd"))
    wrong = F.concat(text, F.format_string(" The true probability is %.2f%%.", F.col("pd") * 100 + 987654321.0))
    return rows.select(
        "borrower_id",
        ex.verify_narrative(text, F.col("drivers"), F.col("pd")).alias("template_ok"),
        ex.verify_narrative(wrong, F.col("drivers"), F.col("pd")).alias("wrong_ok"),
    )


@query("narrative_or_fallback", sql("SELECT risk_grade, 'supplied' AS source, count(*) AS n FROM book WHERE target = 0 GROUP BY 1 UNION ALL SELECT risk_grade, 'template', count(*) FROM book WHERE target = 1 GROUP BY 1", "book"))
def narrative_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = with_drivers(spark, d)
    honest = F.format_string("Grade %s; 12-month probability %.2f%%.", F.col("risk_grade"), F.col("pd") * 100)
    candidate = F.when(F.col("target") == 0, honest).otherwise(F.lit("Probability 987654321%."))
    story = ex.narrative_or_fallback(candidate, F.col("drivers"), F.col("risk_grade"), F.col("pd"))
    return rows.withColumn("s", story).groupBy("risk_grade", F.col("s.source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


def grid_sql() -> str:
    """Every borrower × lever × step that changes the value, with the outcome."""
    arms = []
    for name, (way, bound) in K.LEVERS.items():
        span = f"({name} - {number(bound)})" if way == "down" else f"({number(bound)} - {name})"
        moved = f"({name} {'-' if way == 'down' else '+'} (k / 10e0) * {span})"
        before = f"({name} {'-' if way == 'down' else '+'} ((k - 1) / 10e0) * {span})"
        if name in K.INTEGER_LEVERS:
            moved, before = f"round_even({moved}, 0)", f"round_even({before}, 0)"
        arms.append(
            f"SELECT borrower_id, risk_grade, pd, logit, '{name}' AS feature, k, k / 10e0 AS frac, CAST({name} AS DOUBLE) AS current, "
            f"{moved} AS value, {before} AS before, {number(DEMO_SCORER.coefficients[name])} AS coef, {span} AS span "
            f"FROM book, range(1, 11) t(k)"
        )
    return " UNION ALL ".join(arms)


view("grid", f"SELECT * FROM ({grid_sql()}) g WHERE span > 0 AND value <> before AND value <> current", "book")
view(
    "cands",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY borrower_id ORDER BY r) AS c FROM drv WHERE shap > 0 AND value IS NOT NULL AND feature IN ("
    + ", ".join(f"'{n}'" for n in K.LEVERS)
    + ")) x WHERE c <= 3",
    "drv",
)
view(
    "outcomes",
    f"""
    SELECT *, {grade_sql('new_pd')} AS new_grade FROM (
      SELECT g.borrower_id, g.risk_grade, g.pd, g.feature, c.label, c.c, frac, current, g.value, {pd_sql('(logit + coef * (g.value - current))')} AS new_pd
      FROM grid g JOIN cands c ON g.borrower_id = c.borrower_id AND g.feature = c.feature) o
    """,
    "grid",
    "cands",
)


@query("counterfactual_grid", sql("SELECT borrower_id, feature, round(frac, 6) AS frac, round(value, 6) AS value FROM grid", "grid"))
def counterfactual_grid(spark: SparkSession, d: str) -> DataFrame:
    book = frames.scored_book(spark, d).select("borrower_id", F.explode(ex.lever_steps(DEMO_SCORER)).alias("v"))
    steps = book.select("borrower_id", "v.feature", F.explode("v.grid").alias("g"))
    return steps.select("borrower_id", "feature", F.round("g.frac", 6).alias("frac"), F.round("g.value", 6).alias("value"))


@query("find_counterfactual", sql(
    """SELECT b.borrower_id, feature, round(current, 4) AS current_value, round(value, 4) AS suggested_value, round(new_pd, 5) AS new_pd, new_grade,
      CASE WHEN b.risk_grade = 'A' THEN 'grade A has no better one'
        WHEN b.borrower_id NOT IN (SELECT borrower_id FROM cands) THEN 'none of the main drivers is a lever'
        WHEN feature IS NULL THEN printf('one lever alone does not lift grade %s to %s (PD %.3f)', b.risk_grade, chr(ascii(b.risk_grade) - 1), b.pd) END AS reason
    FROM book b LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY borrower_id ORDER BY frac, c) AS q FROM outcomes WHERE new_grade < risk_grade) x WHERE q = 1) o
      ON b.borrower_id = o.borrower_id""", "outcomes"))
def find_counterfactual(spark: SparkSession, d: str) -> DataFrame:
    rows = with_drivers(spark, d)
    found = ex.counterfactual(DEMO_SCORER, F.col("drivers"), F.col("logit"), F.col("pd"), F.col("risk_grade"))
    return rows.withColumn("c", found).select(
        "borrower_id", "c.feature", "c.current_value", "c.suggested_value", "c.new_pd", "c.new_grade", "c.reason"
    )


# ---- stress

def stress_sql(shock: dict[str, str], shock_type: str, magnitude: float, mask: str = "true") -> str:
    totals = ", ".join(
        f"count(*) FILTER (WHERE {grade_sql(p)} = '{g}') AS {arm}_{g}" for arm, p in (("pre", "pd"), ("post", "post_pd")) for g in K.GRADES
    )
    return f"""SELECT '{shock_type}' AS shock_type, {magnitude!r} AS magnitude, count(*) AS n_loans_scored, count(*) FILTER (WHERE {mask}) AS n_loans_shocked,
      {totals}, round(avg(pd) * 0.45, 5) AS pre_expected_loss_rate, round(avg(post_pd) * 0.45, 5) AS post_expected_loss_rate,
      round(avg(post_pd) * 0.45 - avg(pd) * 0.45, 5) AS delta_expected_loss_rate
    FROM (SELECT *, {pd_sql('post_logit')} AS post_pd FROM (SELECT *, {logit_sql(replaced=shock)} AS post_logit FROM logits) l) p"""


def stress_view(factor: str, columns: tuple[str, ...], mask: str) -> dict[str, str]:
    return {c: f"CASE WHEN {mask} THEN {c} * {factor} ELSE {c} END" for c in columns}


RATIOS = ("credit_income_ratio", "annuity_income_ratio")


def stress_oracle(factor: str, columns: tuple[str, ...], shock_type: str, magnitude: float, mask: str = "true") -> str:
    return sql(stress_sql(stress_view(factor, columns, mask), shock_type, magnitude, mask).replace("FROM logits", "FROM pds"), "pds")


@query("stress_test", stress_oracle("(1e0 / (1e0 + -0.15e0))", RATIOS, "revenue", -0.15))
def stress_test(spark: SparkSession, d: str) -> DataFrame:
    return st.stress_test(frames.scored_book(spark, d), DEMO_SCORER, "revenue", -15)


@query("stress_sector", stress_oracle("(1e0 / (1e0 + -0.4e0))", RATIOS, "sector_demand", -0.4, "sector_segment = 'Manufacturing'"))
def stress_sector(spark: SparkSession, d: str) -> DataFrame:
    return st.stress_test(frames.scored_book(spark, d), DEMO_SCORER, "sector_demand", -0.4, sector="Manufacturing")


@query("stress_rate", stress_oracle("1.1e0", ("annuity_income_ratio",), "rate", 0.1))
def stress_rate(spark: SparkSession, d: str) -> DataFrame:
    return st.stress_test(frames.scored_book(spark, d), DEMO_SCORER, "rate", G.rate_move_to_fraction(200))


@query("stress_shock", sql(
    "SELECT borrower_id, round(credit_income_ratio / 0.85e0, 6) AS credit_income_ratio, round(annuity_income_ratio / 0.85e0, 6) AS annuity_income_ratio FROM (SELECT borrower_id, credit / nullif(income, 0) AS credit_income_ratio, annuity / nullif(income, 0) AS annuity_income_ratio FROM apps) a", "apps"))
def stress_shock(spark: SparkSession, d: str) -> DataFrame:
    rows = views.applications(spark, d).withColumns(ratio_columns()).withColumns(G.stress_shock("revenue", -0.15))
    return rounded(rows.select("borrower_id", *RATIOS), *RATIOS)


# ---- the full record

def thin_logit_sql() -> str:
    parts = [f"coalesce({number(c)} * ({n} - {number(DEMO_THIN_SCORER.means[n])}), 0)" for n, c in DEMO_THIN_SCORER.coefficients.items()]
    return f"{number(DEMO_THIN_SCORER.intercept)} + " + " + ".join(parts)


def records(spark: SparkSession, d: str) -> DataFrame:
    # Two fits and the report read the book; it is written once instead of being rebuilt three times.
    book = cut_lineage(frames.scored_book(spark, d))
    known = book.where(S.evaluable(F.col("event"), F.col("duration")))
    calibrators = cal.fit_calibrators(known, "loan_type_segment", "pd", "event")
    bands = cal.fit_confidence_bands(known, "loan_type_segment", "pd", "event")
    return st.score_record(book, DEMO_SCORER, calibrators, bands, DEMO_THIN_SCORER)


ROUTED = f"""routed AS (SELECT borrower_id, data_richness = 'ntc_ntb' AS thin,
  CASE WHEN data_richness = 'ntc_ntb' THEN 1e0 / (1e0 + exp(-({thin_logit_sql()}))) ELSE pd END AS raw_pd FROM book)"""


@query("score_record", sql("SELECT 1 AS marker", "book").replace("SELECT 1 AS marker", f""", {ROUTED}
  SELECT borrower_id, CASE WHEN thin THEN 'thin_file' ELSE 'hazard' END AS model_used, thin AS point_estimate, round(raw_pd, 4) AS raw_pd,
    NOT thin AS has_curve, CASE WHEN thin THEN 4 ELSE 5 END AS n_drivers, CASE WHEN thin THEN '{st.NO_LEVERS}' END AS fixed_reason FROM routed"""))
def score_record(spark: SparkSession, d: str) -> DataFrame:
    """Every route's own score; calibration, which has no SQL, is tested on its own."""
    reason = F.col("counterfactual.reason")
    return records(spark, d).select(
        "borrower_id", "model_used", "point_estimate", F.col("raw_cum_pd_12m").alias("raw_pd"),
        F.col("hazard_curve").isNotNull().alias("has_curve"), F.size("top_drivers").alias("n_drivers"),
        F.when(reason == st.NO_LEVERS, reason).alias("fixed_reason"),
    )


@query("explanation_cache", sql("SELECT borrower_id AS loan_id, data_richness = 'ntc_ntb' AS thin, true AS told, true AS graded FROM book", "book"))
def explanation_cache(spark: SparkSession, d: str) -> DataFrame:
    """Explanations come from the audit rows that scoring appended, the newest of each loan."""
    log = f"{ensure_checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    # Scored once for both appends.
    scored = settle(records(spark, d))
    append_log(st.audit_rows(scored), log)
    append_log(st.audit_rows(scored, "again").where(F.col("loan_id") % 2 == 0), log)
    stored = st.explanations(spark.read.parquet(log))
    return stored.select(
        "loan_id", F.coalesce(F.col("counterfactual.reason") == st.NO_LEVERS, F.lit(False)).alias("thin"),
        F.col("narrative.text").startswith(F.concat(F.lit("Grade "), F.col("risk_grade"))).alias("told"),
        (G.pd_to_grade(F.col("calibrated_pd_12m")) <= "G").alias("graded"),
    )


@query("regulatory_lookup", sql(
    "SELECT borrower_id, regulatory_action FROM (SELECT borrower_id, CASE WHEN pd > 0.2 THEN 'Triggers lifetime-ECL provisioning review' WHEN late_installment_rate > 0.05 THEN 'Feeds existing bank EWS/RFA workflow' END AS regulatory_action FROM book) x WHERE regulatory_action IS NOT NULL", "book"))
def regulatory_lookup(spark: SparkSession, d: str) -> DataFrame:
    trigger = F.when(F.col("pd") > K.WATCH_PD, K.REGULATORY_MAP[4][0]).when(F.col("late_installment_rate") > 0.05, K.REGULATORY_MAP[0][0])
    rows = frames.scored_book(spark, d).select("borrower_id", trigger.alias("ml_trigger"))
    return rows.join(st.regulatory_dimension(spark), "ml_trigger").select("borrower_id", "regulatory_action")


@query("sma_bucket", sql(
    "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN dpd < 1 THEN NULL WHEN dpd <= 30 THEN 'SMA-0' WHEN dpd <= 60 THEN 'SMA-1' WHEN dpd <= 90 THEN 'SMA-2' WHEN dpd > 90 THEN 'NPA' END AS bucket FROM (SELECT paid_day - due_day + 10 * instalment_no AS dpd FROM inst) a) b GROUP BY 1", "inst"))
def sma_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows = views.installments(spark, d)
    past_due = S.days_late(F.col("due_day"), F.col("paid_day")) + 10 * F.col("instalment_no")
    return rows.groupBy(G.sma_bucket(past_due).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def next_state_sql(state: str) -> str:
    return f"""CASE {state} WHEN 'Performing' THEN CASE WHEN p > 0.2 THEN 'WatchList' ELSE 'Performing' END
      WHEN 'WatchList' THEN CASE WHEN p > 0.5 OR fired THEN 'HighAlert' WHEN p <= 0.2 THEN 'Performing' ELSE 'WatchList' END
      WHEN 'HighAlert' THEN CASE WHEN p > 0.75 OR (dpd > 30 AND dpd <= 90) THEN 'Critical' WHEN p <= 0.5 AND NOT fired THEN 'WatchList' ELSE 'HighAlert' END
      WHEN 'Critical' THEN CASE WHEN dpd > 90 THEN 'NPA_Stage3' ELSE 'Critical' END ELSE {state} END"""


@query("ews_state", "WITH RECURSIVE " + sql("SELECT loan_id, m, state FROM walk WHERE m > 0", "recent", "book").removeprefix("WITH ").replace(
    "SELECT loan_id, m, state FROM walk WHERE m > 0",
    f""", obs AS (SELECT r.borrower_id AS loan_id, row_number() OVER (PARTITION BY r.borrower_id ORDER BY instalment_no) AS m,
        coalesce(paid_day - due_day, 100) AS dpd, pd AS p, coalesce(paid_day - due_day > 15, true) AS fired
      FROM recent r JOIN (SELECT borrower_id, pd FROM book) b ON b.borrower_id = r.borrower_id),
    walk(loan_id, m, state) AS (SELECT DISTINCT loan_id, CAST(0 AS BIGINT), 'Performing' FROM obs UNION ALL
      SELECT o.loan_id, o.m, {next_state_sql('w.state')} FROM walk w JOIN obs o ON o.loan_id = w.loan_id AND o.m = w.m + 1)
    SELECT loan_id, m, state FROM walk WHERE m > 0"""))
def ews_state(spark: SparkSession, d: str) -> DataFrame:
    late = F.col("paid_day") - F.col("due_day")
    rows = pan.keep_most_recent_loan(views.installments(spark, d)).join(frames.scored_book(spark, d).select("borrower_id", "pd"), "borrower_id")
    observed = rows.select(
        F.col("borrower_id").alias("loan_id"), F.col("instalment_no").alias("m"), "pd",
        F.coalesce(late > 15, F.lit(True)).alias("indicator"), F.coalesce(late, F.lit(100)).alias("days_past_due"),
    )
    return port.ews_history(observed, "loan_id", "m")
