import tempfile

from pyspark.sql import functions as F

from emberline.plans import jobs
from emberline.sources import views


def test_build_book_end_to_end(spark):
    where, folder = "/root/testdata/sf0.01", tempfile.mkdtemp(prefix="emberline-book-")
    tables = {
        "applications": views.applications(spark, where),
        "bureau": views.bureau(spark, where),
        "installments": views.installments(spark, where),
    }
    # The views leave 8 % of the incomes empty, so the standing gate must stop the build …
    try:
        jobs.build_features(tables, folder)
        raise AssertionError("the gate let the table through")
    except ValueError as error:
        assert "credit_income_ratio: share of nulls" in str(error)
    # … and the ungated build must go through.
    scorer = jobs.build_book(tables, folder, gate=False)
    book = spark.read.parquet(f"{folder}/book")
    assert book.count() == 1500 and book.where("pd is null or risk_grade is null").isEmpty()
    ranges = {r["split"]: (r["lo"], r["hi"]) for r in book.groupBy("split").agg(F.min("borrower_id").alias("lo"), F.max("borrower_id").alias("hi")).collect()}
    assert ranges["train"][1] < ranges["calib"][0] and ranges["calib"][1] < ranges["test"][0]
    per_segment = book.groupBy("loan_type_segment").agg(F.corr("raw_pd", "pd").alias("c")).collect()
    assert len(per_segment) == 3
    assert set(scorer.coefficients) >= {"ext_source_2", "prior_late_rate"}
    assert spark.read.parquet(f"{folder}/portfolio").first()["n_loans"] == 1500
    models = {r["model"] for r in spark.read.json(f"{folder}/metrics").select(F.explode(F.map_keys(F.from_json(F.to_json("values"), "map<string,double>"))).alias("model")).collect()}
    assert {"naive_always_no_default", "hazard_raw", "hazard_calibrated"} <= models
    bands = spark.read.parquet(f"{folder}/bands")
    assert {r[0] for r in bands.select("segment").distinct().collect()} >= {"__global__"}
