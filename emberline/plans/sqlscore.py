"""The scored book as SQL, generated from the same scorer object the plans use."""

from __future__ import annotations

from emberline.functions import constants as K
from emberline.functions.scorer import DEMO_SCORER, LinearHazard
from emberline.plans.sqlviews import view


def number(value: float) -> str:
    return f"{value!r}e0" if "e" not in repr(value) else repr(value)


def logit_sql(scorer: LinearHazard = DEMO_SCORER, replaced: dict[str, str] | None = None) -> str:
    replaced = replaced or {}
    terms = [number(scorer.intercept)]
    for name, coefficient in scorer.coefficients.items():
        value = replaced.get(name, name)
        terms.append(f"coalesce({number(coefficient)} * (({value}) - {number(scorer.means[name])}), 0)")
    return "(" + " + ".join(terms) + ")"


def pd_sql(logit: str, scorer: LinearHazard = DEMO_SCORER) -> str:
    survive = " * ".join(
        f"(1e0 - 1e0 / (1e0 + exp(-({logit} + {number(e)}))))" for e in scorer.month_effects
    )
    return f"(1e0 - {survive})"


def grade_sql(pd: str) -> str:
    whens = " ".join(f"WHEN {pd} < {number(u)} THEN '{g}'" for u, g in K.GRADE_BANDS)
    return f"CASE {whens} ELSE 'G' END"


def action_sql(grade: str) -> str:
    whens = " ".join(f"WHEN '{g}' THEN '{a}'" for g, a in K.GRADE_ACTIONS.items())
    return f"CASE {grade} {whens} END"


view(
    "logits",
    f"SELECT f.*, duration, event, {logit_sql()} AS logit FROM feats f JOIN durations d ON f.borrower_id = d.borrower_id",
    "feats",
    "durations",
)
view("pds", f"SELECT *, {pd_sql('logit')} AS pd FROM logits", "logits")
view("book", f"SELECT *, {grade_sql('pd')} AS risk_grade FROM pds", "pds")
view(
    "lt_book",
    f"""
    SELECT *, {grade_sql('pd')} AS risk_grade FROM (
      SELECT s.borrower_id, s.c_mktsegment, s.n_regionkey, s.loan_type_segment, s.sector_segment, s.data_richness,
        d.duration, d.event, c.pd
      FROM segd s JOIN durations d ON s.borrower_id = d.borrower_id
      JOIN (SELECT c_mktsegment, n_regionkey, 1 - product(1 - hazard) AS pd FROM (
              SELECT c_mktsegment, n_regionkey, months_since_origination, avg(event) AS hazard
              FROM panel p JOIN apps a ON p.borrower_id = a.borrower_id GROUP BY 1, 2, 3) h GROUP BY 1, 2) c
        ON s.c_mktsegment = c.c_mktsegment AND s.n_regionkey = c.n_regionkey) b
    """,
    "segd",
    "durations",
    "panel",
)
