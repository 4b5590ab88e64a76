"""The pipeline's stages in turn against SQL and the tokenizers library, and on odd tables."""

import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from emberline.llm import catalog
from emberline.llm.jaccard import OP7_SQL
from emberline.llm.lines import OP2_SQL
from emberline.llm.mixing import OP4_SQL


def test_stages_equal_their_sql(spark, testdata):
    connection = duckdb.connect()
    connection.execute(f"CREATE TABLE documents AS SELECT * FROM '{testdata}/documents.parquet'")
    for sql in (
        f"SELECT d.* REPLACE (o.text AS text) FROM documents d JOIN ({OP2_SQL}) o USING (doc_id)",
        f"SELECT d.* FROM documents d JOIN ({OP7_SQL}) o ON d.doc_id = o.doc_id AND o.class_id = o.doc_id",
        f"SELECT d.*, CASE WHEN size > 0 THEN taken // size ELSE floor(target / source_size) END AS copies FROM documents d JOIN ({OP4_SQL}) o USING (doc_id)",
    ):
        connection.execute(f"CREATE TABLE next AS {sql}")
        connection.execute("DROP TABLE documents")
        connection.execute("ALTER TABLE next RENAME TO documents")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, copies in connection.execute("SELECT doc_id, text, copies FROM documents").fetchall():
        want += [(i, text, library.encode(text, add_special_tokens=False).ids)] * int(copies)
    rows = corpus_pipeline.run(spark, testdata).select("doc_id", "text", "token_ids").collect()
    got = [(r["doc_id"], r["text"], np.frombuffer(r["token_ids"], dtype="<u4").tolist()) for r in rows]
    assert sorted(got) == sorted(want) and len(got) > 100


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "The first text stands here.", "en", None, 5), (4, "The first text stands here.", "en", "s", 5),
     (4, "The first text stands here.", "en", "s", 5), (5, "x " * 20_000, "en", "s", 40_000)],
])
def test_odd_tables_pass_all_stages(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", F.lit(1).alias("size"), F.lit("a").alias("row_a"), F.lit(2).alias("token_ids"), F.lit(3.5).alias("doc"))
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        docs = out
    found = {r["doc_id"] for r in docs.collect()}
    assert found <= {4, 5, None} and (not rows or 4 in found)


def test_each_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 11)) and os.path.exists(corpus_pipeline.__file__)
