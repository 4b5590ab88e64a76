"""Line dedup by the number of distinct sites that a line is seen on.

One HyperLogLog sketch of sites for each line hash, merged by aggregation, estimates the spread of every line.
Lines whose estimate is within the sketch's error of the threshold get an exact distinct count. A line on
`MIN_SITES` sites or more is boilerplate: it is removed everywhere but at its first place, by doc_id (nulls first)
and position, so that a text copied to many sites is still whole once.

A line is what stands between line feeds, without ASCII space at its ends; lines of space alone are left as they
are. A line is known by 96 bits of hash.

Defined results: a null text stays null, and a text whose lines are all removed becomes empty. Null sources are one
site. Equal rows share their first place, and the same lines are removed from each. No documents give no rows. All
columns of the input are returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import SPACES, read, written

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 8
#: Sketches have 2 ** SKETCH_BITS registers; their relative error is 1.04 / sqrt(2 ** SKETCH_BITS).
SKETCH_BITS = 12
#: Estimates within so many standard errors of the threshold, and one more, are counted exactly.
NEAR = 4.0


def text_lines(text: Column) -> Column:
    return F.split(text, "\n")


def row_keys() -> list[Column]:
    """What knows a document row by its content; equal rows have equal keys."""
    return [F.xxhash64("doc_id", "source", "text").alias("row_a"), F.hash("text", "doc_id").alias("row_b")]


def line_rows(docs: DataFrame) -> DataFrame:
    """One row for each line that is not blank: its hashes, site, place and document row."""
    site = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    lines = docs.select("doc_id", *row_keys(), site.alias("site"), F.posexplode(text_lines(F.col("text"))).alias("pos", "raw"))
    line = F.btrim("raw", F.lit(SPACES))
    return lines.where(line != "").select(
        F.xxhash64(line).alias("line_a"), F.hash(line).alias("line_b"), "site", "doc_id", "row_a", "row_b", "pos"
    )


def spread_lines(docs: DataFrame, min_sites: int) -> DataFrame:
    """Every occurrence of the lines that may be boilerplate, and whether the sketch alone is `sure`."""
    error = NEAR * 1.04 / 2 ** (SKETCH_BITS / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = F.hll_sketch_estimate("sites")
    likely = (
        line_rows(docs)
        .groupBy("line_a", "line_b")
        .agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sites"))
        .where(spread >= low)
        .select("line_a", "line_b", (spread > high).alias("sure"))
    )
    return written(line_rows(docs).join(written(likely), ["line_a", "line_b"]))


def removed_places(docs: DataFrame, min_sites: int) -> DataFrame:
    """row_a, row_b and the positions of the lines to remove from that row."""
    seen = spread_lines(docs, min_sites)
    line = ["line_a", "line_b"]
    place = F.struct("doc_id", "row_a", "row_b", "pos")
    exact = seen.where(~F.col("sure")).groupBy(*line).agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    boilerplate = written(seen.where("sure").select(*line).distinct().union(exact.select(*line)))
    # Written, so that both sides of the join below are plain exchanges and a hot line's rows can be split.
    first = written(seen.groupBy(*line).agg(F.min(place).alias("first")).join(boilerplate, line))
    return (
        seen.join(first, line)
        .where(place != F.col("first"))
        .groupBy("row_a", "row_b")
        .agg(F.collect_set("pos").alias("removed"))
    )


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with boilerplate lines removed from text, and lines_removed, the number of them."""
    return cleaned(docs, min_sites).select(*[F.col(f"doc.{_quoted(c)}") for c in docs.columns], "lines_removed")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Columns `doc`, the row with its cleaned text, and lines_removed: no name of the input can clash."""
    removed = removed_places(docs.select("doc_id", "source", "text"), min_sites)
    keyed = docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("doc"), *row_keys())
    lines = text_lines(F.col("doc.text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return keyed.join(removed, ["row_a", "row_b"], "left").select(
        F.col("doc").withField("text", F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(text)).alias("doc"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("lines_removed"),
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op2_line_spread(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents").select("doc_id", "source", "text")
    whole = cleaned(docs)
    n_lines = F.coalesce(F.size(text_lines(F.col("doc.text"))), F.lit(0))
    return whole.select("doc.doc_id", "doc.text", F.col("lines_removed"), n_lines.alias("lines_left"))


OP2_SQL = f"""
WITH placed AS (
    SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
           unnest(string_split(text, chr(10))) AS raw
    FROM documents
), seen AS (
    SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM placed
), spread AS (
    SELECT line, count(DISTINCT coalesce('s' || source, 'n')) AS sites, min((doc_id, pos)) AS first
    FROM seen WHERE line <> '' GROUP BY line
), judged AS (
    SELECT seen.*, coalesce(sites >= {MIN_SITES} AND (doc_id, pos) <> first, false) AS gone
    FROM seen LEFT JOIN spread USING (line)
), joined AS (
    SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
           count(*) FILTER (gone) AS lines_removed
    FROM judged GROUP BY doc_id
)
SELECT doc_id, joined.text, coalesce(lines_removed, 0) AS lines_removed,
       coalesce(len(string_split(joined.text, chr(10))), 0) AS lines_left
FROM documents LEFT JOIN joined USING (doc_id)
"""
