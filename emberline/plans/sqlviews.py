"""The loan-shaped views as SQL, for checking."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (needs, body.strip())


def sql(body: str, *needs: str) -> str:
    """`body` behind a WITH clause that defines the named views and what they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dependency in VIEWS[name][0]:
            visit(dependency)
        order.append(name)

    for name in needs:
        visit(name)
    clauses = ",\n".join(f"{name} AS (\n{VIEWS[name][1]}\n)" for name in order)
    return f"WITH {clauses}\n{body.strip()}" if clauses else body.strip()


view(
    "inst",
    """
    SELECT borrower_id, loan_id, due_day, due_day + late_by AS paid_day,
      CAST(row_number() OVER (PARTITION BY borrower_id, loan_id
        ORDER BY due_day, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS instalment_no
    FROM (
      SELECT o_custkey AS borrower_id, o_custkey * 10 + o_orderkey % 3 AS loan_id,
        date_diff('day', DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS due_day,
        CASE WHEN (l_partkey * 7 + l_suppkey) % 1000 = 0 THEN NULL ELSE
          greatest(((date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % 701) + 701) % 701 - 668, -30)
        END AS late_by,
        o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) r
    """,
)
view(
    "apps",
    """
    SELECT c_custkey AS borrower_id, c_mktsegment, n_regionkey,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Revolving loans'
           WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Consumer loans' ELSE 'Cash loans' END AS contract_type,
      CASE n_regionkey WHEN 0 THEN 'Industry: type 3' WHEN 1 THEN 'Trade: type 2' WHEN 2 THEN 'Self-employed'
           WHEN 3 THEN 'Agriculture' ELSE 'School' END AS organization_type,
      greatest(c_acctbal, 0.0) * 300 AS income,
      CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey * 17 % 101) / 100 END AS ext_source_1,
      CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey * 29 % 101) / 100 END AS ext_source_2,
      CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey * 43 % 101) / 100 END AS ext_source_3,
      CAST(-(7000 + c_custkey * 37 % 18000) AS INTEGER) AS days_birth,
      CAST(CASE WHEN c_custkey % 25 = 0 THEN 365243 ELSE 300 - c_custkey * 53 % 9000 END AS INTEGER) AS days_employed,
      CAST((c_custkey * 7919 % 1000) / 1000 < CAST(0.03 AS DOUBLE) + CAST(0.2 AS DOUBLE) * (1 - (c_custkey * 29 % 101) / 100) AS INTEGER) AS target,
      credit, credit / 20 AS annuity
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS credit FROM orders GROUP BY 1) o ON o_custkey = c_custkey
    """,
)
view(
    "bur",
    """
    SELECT o_custkey AS borrower_id,
      CASE WHEN o_orderstatus = 'O' THEN 'Active' ELSE 'Closed' END AS credit_active,
      CASE WHEN o_orderstatus = 'P' AND o_totalprice > 350000 THEN 12 ELSE 0 END AS credit_day_overdue
    FROM orders WHERE o_orderpriority = '1-URGENT'
    """,
)
view(
    "edge_rows",
    """
    SELECT o_custkey AS firm_id, l_suppkey AS counterparty_id, l_extendedprice * (1 - l_discount) AS txn_value,
      year(o_orderdate) * 12 + month(o_orderdate) - 1 AS month_no
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
view("edges", "SELECT firm_id, counterparty_id, round(sum(txn_value), 4) AS txn_value FROM edge_rows GROUP BY 1, 2", "edge_rows")
view(
    "scores",
    "SELECT l_linestatus AS segment, l_discount AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem",
)
view(
    "drift_rows",
    """
    SELECT year(o_orderdate) >= 1999 AS is_current, o_totalprice, l_quantity, l_discount, CAST(l_linenumber AS DOUBLE) AS l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
view(
    "evts",
    """
    SELECT event_id, ts, user_id AS loan_id, value,
      CASE event_type WHEN 'error' THEN 'gst_filing' WHEN 'view' THEN 'bank_transaction'
        WHEN 'click' THEN 'repayment' WHEN 'purchase' THEN 'repayment' ELSE event_type END AS type
    FROM events
    """,
)
view("notes", "SELECT doc_id AS borrower_id, text AS officer_note, lang FROM documents")
view(
    "latest",
    """
    SELECT borrower_id, loan_id, loan_rank, max_day FROM (
      SELECT *, row_number() OVER (PARTITION BY borrower_id ORDER BY max_day DESC NULLS FIRST, loan_id DESC) AS loan_rank
      FROM (SELECT borrower_id, loan_id, max(due_day) AS max_day FROM inst GROUP BY 1, 2) g) w
    """,
    "inst",
)
view(
    "recent",
    "SELECT i.* FROM inst i JOIN latest l ON i.borrower_id = l.borrower_id AND i.loan_id = l.loan_id WHERE l.loan_rank = 1",
    "latest",
)
view(
    "durations",
    """
    SELECT borrower_id,
      CASE WHEN first_event <= least(last_month, 12) THEN first_event ELSE least(last_month, 12) END AS duration,
      CASE WHEN first_event <= least(last_month, 12) THEN 1 ELSE 0 END AS event
    FROM (SELECT borrower_id, max(instalment_no) AS last_month,
            min(instalment_no) FILTER (WHERE coalesce(paid_day - due_day, 9999) > 30) AS first_event
          FROM recent WHERE instalment_no >= 1 GROUP BY 1) d
    """,
    "recent",
)
view(
    "panel",
    """
    SELECT borrower_id, m AS months_since_origination, CAST(m = duration AND event = 1 AS INTEGER) AS event
    FROM (SELECT *, unnest(range(1, duration + 1)) AS m FROM durations) x
    """,
    "durations",
)
view(
    "prior",
    """
    SELECT borrower_id, avg(CASE WHEN coalesce(paid_day - due_day, 9999) > 30 THEN 1.0 ELSE 0.0 END) AS prior_late_rate,
      count(*) AS prior_n_installments
    FROM inst i WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.loan_rank = 1 AND l.borrower_id = i.borrower_id AND l.loan_id = i.loan_id)
    GROUP BY 1
    """,
    "latest",
)
view(
    "segd",
    """
    SELECT a.*, coalesce(n, 0) AS bureau_record_count,
      CASE contract_type WHEN 'Cash loans' THEN 'term_loan_proxy' WHEN 'Revolving loans' THEN 'working_capital_proxy' ELSE 'other_proxy' END AS loan_type_segment,
      CASE organization_type WHEN 'Industry: type 3' THEN 'Manufacturing' WHEN 'Trade: type 2' THEN 'Retail_Trade'
        WHEN 'Self-employed' THEN 'Services_IT' WHEN 'Agriculture' THEN 'Agriculture_Allied' ELSE 'Other_Public' END AS sector_segment,
      CASE WHEN coalesce(n, 0) >= 2 THEN 'established' ELSE 'ntc_ntb' END AS data_richness
    FROM apps a LEFT JOIN (SELECT borrower_id, count(*) AS n FROM bur GROUP BY 1) b ON a.borrower_id = b.borrower_id
    """,
    "apps",
    "bur",
)
view(
    "feats",
    """
    SELECT s.borrower_id, target, c_mktsegment, n_regionkey, loan_type_segment, sector_segment, data_richness,
      credit / nullif(income, 0) AS credit_income_ratio, annuity / nullif(income, 0) AS annuity_income_ratio,
      ext_source_1, ext_source_2, ext_source_3,
      -days_birth / 365.25 AS age_years,
      CASE WHEN days_employed <> 365243 THEN greatest(-days_employed / 365.25, 0) END AS employed_years,
      coalesce(bureau_active_count, 0) AS bureau_active_count, coalesce(bureau_overdue_flag, 0) AS bureau_overdue_flag,
      coalesce(n_installments, 0) AS n_installments, coalesce(late_installment_rate, 0) AS late_installment_rate,
      coalesce(max_days_late, 0) AS max_days_late, coalesce(avg_days_late, 0) AS avg_days_late,
      prior_late_rate, prior_n_installments
    FROM segd s
    LEFT JOIN (SELECT borrower_id, count(*) FILTER (WHERE credit_active = 'Active') AS bureau_active_count,
                 max(CASE WHEN credit_day_overdue > 0 THEN 1 ELSE 0 END) AS bureau_overdue_flag FROM bur GROUP BY 1) b
      ON s.borrower_id = b.borrower_id
    LEFT JOIN (SELECT borrower_id, count(*) AS n_installments,
                 avg(CASE WHEN paid_day - due_day > 0 THEN 1.0 ELSE 0.0 END) AS late_installment_rate,
                 greatest(max(paid_day - due_day), 0) AS max_days_late, avg(paid_day - due_day) AS avg_days_late FROM inst GROUP BY 1) i
      ON s.borrower_id = i.borrower_id
    LEFT JOIN prior p ON s.borrower_id = p.borrower_id
    """,
    "segd",
    "inst",
    "prior",
)
