"""Loan-shaped views over the star-schema tables (synthetic; no credit meaning)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.ordered import numbered_within
from emberline.session import table_path


# Declared, so that opening a table reads no file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(table_path(directory, name))


def installment_columns() -> list[Column]:
    """Keys and days of one order line read as an installment."""
    due = F.datediff("o_orderdate", F.lit("2002-01-01").cast("date"))
    lateness = F.greatest(F.pmod(F.datediff("l_shipdate", "o_orderdate"), F.lit(701)) - 668, F.lit(-30))
    unpaid = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 1000 == 0
    return [
        F.col("o_custkey").alias("borrower_id"),
        (F.col("o_custkey") * 10 + F.col("o_orderkey") % 3).alias("loan_id"),
        due.alias("due_day"),
        F.when(~unpaid, due + lateness).alias("paid_day"),
    ]


def order_lines(spark: SparkSession, directory: str) -> DataFrame:
    orders = table(spark, directory, "orders")
    return table(spark, directory, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def installments(spark: SparkSession, directory: str) -> DataFrame:
    """borrower_id, loan_id, instalment_no, due_day, paid_day (null when never paid)."""
    order = ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = order_lines(spark, directory).select(*installment_columns(), *order)
    periods = rows.withColumn("due_period", F.floor(F.col("due_day") / 30))
    numbered = numbered_within(periods, ["borrower_id", "loan_id"], "due_period", ["due_day", *order], "instalment_no")
    return numbered.select("borrower_id", "loan_id", "instalment_no", "due_day", "paid_day")


def installment_rows(spark: SparkSession, directory: str) -> DataFrame:
    """The same rows without instalment numbers, for work that does not need them."""
    return order_lines(spark, directory).select(*installment_columns())


def applications(spark: SparkSession, directory: str, with_credit: bool = True) -> DataFrame:
    """One row per borrower; the amounts need the orders, which not every job reads."""
    customer = table(spark, directory, "customer")
    nation = table(spark, directory, "nation").select("n_nationkey", "n_regionkey")
    credit = (
        table(spark, directory, "orders")
        .groupBy(F.col("o_custkey").alias("borrower_id"))
        .agg(F.sum("o_totalprice").alias("credit"))
    )
    key = F.col("c_custkey")
    known = key % 10 != 0
    segment, region = F.col("c_mktsegment"), F.col("n_regionkey")
    ext2 = (key * 29 % 101) / 100
    base = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("borrower_id"),
        "c_mktsegment",
        "n_regionkey",
        F.when(segment.isin("BUILDING", "MACHINERY"), "Revolving loans")
        .when(segment == "HOUSEHOLD", "Consumer loans")
        .otherwise("Cash loans")
        .alias("contract_type"),
        F.when(region == 0, "Industry: type 3")
        .when(region == 1, "Trade: type 2")
        .when(region == 2, "Self-employed")
        .when(region == 3, "Agriculture")
        .otherwise("School")
        .alias("organization_type"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 300).alias("income"),
        F.when(known, (key * 17 % 101) / 100).alias("ext_source_1"),
        F.when(known, ext2).alias("ext_source_2"),
        F.when(known, (key * 43 % 101) / 100).alias("ext_source_3"),
        (-(7000 + key * 37 % 18000)).cast("int").alias("days_birth"),
        F.when(key % 25 == 0, 365243).otherwise(300 - key * 53 % 9000).cast("int").alias("days_employed"),
        ((key * 7919 % 1000) / 1000 < 0.03 + 0.2 * (1 - ext2)).cast("int").alias("target"),
    )
    if not with_credit:
        return base
    joined = base.join(credit, "borrower_id", "left")
    return joined.withColumn("annuity", F.col("credit") / 20)


def bureau(spark: SparkSession, directory: str) -> DataFrame:
    """External credit lines: the urgent orders."""
    orders = table(spark, directory, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    overdue = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 350000)
    return orders.select(
        F.col("o_custkey").alias("borrower_id"),
        F.when(F.col("o_orderstatus") == "O", "Active").otherwise("Closed").alias("credit_active"),
        F.when(overdue, 12).otherwise(0).alias("credit_day_overdue"),
    )


def edge_rows(spark: SparkSession, directory: str) -> DataFrame:
    return order_lines(spark, directory).select(
        F.col("o_custkey").alias("firm_id"),
        F.col("l_suppkey").alias("counterparty_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("txn_value"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month_no"),
    )


def labelled_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Every lineitem as a scored row: few distinct scores, so heavy ties."""
    return table(spark, directory, "lineitem").select(
        F.col("l_linestatus").alias("segment"),
        F.col("l_discount").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def drift_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Order lines with the window they belong to; four numeric features."""
    return order_lines(spark, directory).select(
        (F.year("o_orderdate") >= 1999).alias("is_current"),
        "o_totalprice",
        "l_quantity",
        "l_discount",
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
    )


def loan_events(spark: SparkSession, directory: str) -> DataFrame:
    """Events renamed to the loan vocabulary; `signup` stays unknown on purpose."""
    kind = F.col("event_type")
    return table(spark, directory, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("loan_id"),
        F.when(kind == "error", "gst_filing")
        .when(kind == "view", "bank_transaction")
        .when(kind.isin("click", "purchase"), "repayment")
        .otherwise(kind)
        .alias("type"),
        F.col("value"),
    )


def notes(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select(
        F.col("doc_id").alias("borrower_id"), F.col("text").alias("officer_note"), "lang"
    )
