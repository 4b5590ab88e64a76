"""Ranked lexical search: MaxScore over blocks of documents, with bounds of term pairs.

The index of some query terms is cut into blocks of at most `BLOCK` documents. A block holds each term's postings with
their integer impacts and the highest of them, and for the term pairs of the queries the list of documents that hold
both, with the highest sum of both impacts. The terms of a query, by rising weight, are paired with their neighbours;
a pair adds at most the highest of its joint maximum and the two single maxima, which is less than their sum where
the terms do not peak together. Taken by rising bound, pairs whose bounds add up to less than the score to beat cannot
bring a document in. Beyond them a list brings its documents in only if its own maximum suffices, and the intersection
list stands for both where only the joint maximum does. Candidates are scored from the highest bound down and leave
as soon as the bounds of the rest no longer suffice. The score to beat is the k-th of one block, a lower bound of the
k-th of all. Nothing is approximate.

Terms of queries are broadcast; queries are therefore taken in batches that hold about `TERMS` terms together.

Defined results: a null or empty text has no terms; such documents count nowhere and such queries return no rows.
Repeated rows are documents, or queries, of their own. Equal scores go by ascending id, null last, then by the row's
place. Weights of terms that all documents hold may be 0; a score of 0 is no result. Texts are read whole, at any
length. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import read, small_batches, written

TOP = 50
#: Documents of a block, as a power of two.
BLOCK_BITS = 13
#: Query terms whose index is built and searched at once.
TERMS = 200_000
#: Ten to the ninth and the saturation of a term's occurrences.
UNIT, SATURATION, LENGTH_SHARE = 1_000_000_000, 20, 50

#: Bytes that end a term become spaces; only A to Z change their case.
LOWER = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))

#: One posting list of a block. `second` is -1 for a single term; the list with both -1 holds the documents' ids.
LISTS = "block long, first int, second int, bound long, docs array<int>, impacts array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """item (a number of the row), all columns as the struct `query`, and the distinct terms, of queries that have any."""

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, type=pa.list_(pa.binary()))], names=["item", "terms"])

    numbered = written(queries.select(F.monotonically_increasing_id().alias("item"), F.struct("*").alias("query")))
    texts = small_batches(numbered.select("item", F.col("query").getField(text).cast("binary").alias("text")))
    return written(numbered.join(texts.mapInArrow(batches, "item long, terms array<binary>").where(F.size("terms") > 0), "item"))


def term_counts(documents: DataFrame, doc_id: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """row, id, n (terms with repeats), and numbers and occurrences of the wanted terms, of documents with any term."""
    shared = documents.sparkSession.sparkContext.broadcast(number)

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in arrived:
            sizes, terms, times = [], [], []
            for value in batch.column("text"):
                found = terms_of(value.as_py())
                counts = Counter(wanted[t] for t in found if t in wanted)
                sizes.append(len(found))
                terms.append(list(counts))
                times.append(list(counts.values()))
            arrays = [batch.column("row"), batch.column("id"), pa.array(sizes, type=pa.int64()), pa.array(terms, type=pa.list_(pa.int32())), pa.array(times, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "n", "terms", "times"])

    texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    counted = small_batches(texts).mapInArrow(batches, "row long, id long, n long, terms array<int>, times array<long>")
    return written(counted.where(F.col("n") > 0))


def index_block(block: int, frame: pd.DataFrame, weights: np.ndarray, pairs: np.ndarray, n_docs: int, n_terms: int) -> pd.DataFrame:
    """The posting lists of one block; a document's number in it follows the order of ids. Impacts of 0 are left out."""
    frame = frame.sort_values(["id", "row"], na_position="last")
    held = np.flatnonzero(frame["id"].notna().to_numpy())
    lists = [(block, -1, -1, len(frame), held.astype(np.int32), frame["id"].iloc[held].astype(np.int64).to_numpy())]
    sizes = frame["terms"].map(len).to_numpy()
    if sizes.sum():
        terms, times = np.concatenate(frame["terms"].to_list()), np.concatenate(frame["times"].to_list())
        docs = np.repeat(np.arange(len(frame), dtype=np.int32), sizes)
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * frame["n"].to_numpy() * n_docs) // n_terms
        impacts = weights[terms] * ((UNIT * times) // (1000 * times + SATURATION * m[docs]))
        order = np.lexsort((docs, terms))
        order = order[impacts[order] > 0]
        terms, docs, impacts = terms[order], docs[order], impacts[order]
        edges = np.searchsorted(terms, np.arange(len(weights) + 1))
        for t in np.unique(terms):
            span = slice(edges[t], edges[t + 1])
            lists.append((block, int(t), -1, int(impacts[span].max()), docs[span], impacts[span]))
        dense, laid = np.zeros(len(frame), dtype=np.int64), -1
        for a, b in pairs:
            if edges[a] == edges[a + 1] or edges[b] == edges[b + 1]:
                continue
            if a != laid:
                dense[:] = 0
                span = slice(edges[a], edges[a + 1])
                dense[docs[span]], laid = impacts[span], a
            span = slice(edges[b], edges[b + 1])
            other = dense[docs[span]]
            both = other > 0
            if both.any():
                lists.append((block, int(a), int(b), int((other + impacts[span])[both].max()), docs[span][both], np.zeros(0, dtype=np.int64)))
    return pd.DataFrame(lists, columns=["block", "first", "second", "bound", "docs", "impacts"])


EMPTY = (0, np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))


def best_of_block(lists: dict[tuple[int, int], tuple], groups: list[tuple[int, int]], least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the best documents of a block with at least the score `least`, highest first.

    `groups` are pairs of terms, or a term and -1.
    """
    bounded = []
    for a, b in groups:
        one, two, both = lists.get((a, -1), EMPTY), lists.get((b, -1), EMPTY) if b >= 0 else EMPTY, lists.get((a, b), EMPTY)
        bound = max(one[0], two[0], both[0])
        if bound:
            bounded.append((bound, one, two, both))
    bounded.sort(key=lambda g: g[0])
    below = np.concatenate([[0], np.cumsum([g[0] for g in bounded], dtype=np.int64)])
    sources = []
    for (_, one, two, both), rest in zip(bounded, below, strict=False):
        alone = [postings[1] for postings in (one, two) if postings[0] and rest + postings[0] >= least]
        # Both maxima may be too low where their sum is not: then only documents with both terms count.
        sources += alone
        if rest + both[0] >= least and len(alone) < 2:
            sources.append(both[1])
    if not sources:
        return EMPTY[1], EMPTY[2]
    docs = np.unique(np.concatenate(sources))
    scores = np.zeros(len(docs), dtype=np.int64)
    for (_, one, two, _), rest in zip(reversed(bounded), reversed(below[:-1]), strict=True):
        for _, held, impacts in (one, two):
            if len(held):
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                scores += np.where(held[at] == docs, impacts[at], 0)
        kept = scores + rest >= least
        docs, scores = docs[kept], scores[kept]
    best = np.lexsort((docs, -scores))[:top]
    return docs[best], scores[best]


def search_block(frame: pd.DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], least: dict[int, int], top: int) -> pd.DataFrame:
    """The best documents of one block for every query."""
    lists = {(a, b): (bound, docs, impacts) for a, b, bound, docs, impacts in zip(*(frame[c] for c in ("first", "second", "bound", "docs", "impacts")), strict=True)}
    _, held, ids = lists.pop((-1, -1))
    id_of = dict(zip(held.tolist(), ids.tolist(), strict=True))
    block, found = int(frame["block"].iat[0]), []
    for item, groups in queries:
        docs, scores = best_of_block(lists, groups, least.get(item, 1), top)
        found += [(item, block, d, id_of.get(d), s) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
    out = pd.DataFrame(found, columns=["item", "block", "doc", "id", "score"])
    return out.astype({"id": "Int64"})


def term_groups(terms: list[int], weights: np.ndarray) -> list[tuple[int, int]]:
    """Neighbours by rising weight, the lower number first; a last one alone."""
    order = sorted(terms, key=lambda t: (weights[t], t))
    return [(min(order[i : i + 2]), max(order[i : i + 2])) if i + 1 < len(order) else (order[i], -1) for i in range(0, len(order), 2)]


def build_index(counted: DataFrame, weights: np.ndarray, pairs: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """The posting lists of all blocks, written once."""
    shared = counted.sparkSession.sparkContext.broadcast((weights, pairs))
    blocks = counted.groupBy(F.shiftright("row", BLOCK_BITS).alias("block"))
    return written(blocks.applyInPandas(lambda key, frame: index_block(int(key[0]), frame, *shared.value, n_docs, n_terms), LISTS))


def search_index(index: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], least: dict[int, int], top: int) -> DataFrame:
    """item, id, score and the place of the best documents of each query in each block, with at least a given score."""
    shared = index.sparkSession.sparkContext.broadcast((queries, least))
    schema = "item long, block long, doc int, id long, score long"
    return index.groupBy("block").applyInPandas(lambda frame: search_block(frame, *shared.value, top), schema)


def first_scores(index: DataFrame, queries: list, top: int) -> dict[int, int]:
    """For each query, the k-th score of the block with the most documents, if it has as many."""
    block = index.where((F.col("first") == -1) & (F.col("second") == -1)).orderBy(F.desc("bound"), "block").select("block").first()
    found = search_index(index.where(F.col("block") == block[0]), queries, {}, top)
    kth = found.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") >= top)
    return {r["item"]: r["score"] for r in kth.collect()}


def ranked_batch(documents: DataFrame, batch: DataFrame, doc_id: str, text: str, top: int) -> DataFrame | None:
    asked = [(r["item"], [bytes(t) for t in r["terms"]]) for r in batch.select("item", "terms").collect()]
    number = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    if not number:
        return None
    counted = term_counts(documents, doc_id, text, number)
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    df = np.zeros(len(number), dtype=np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weights = np.array([weight(total["docs"], int(n)) for n in df], dtype=np.int64)
    queries = [(item, term_groups([number[t] for t in terms], weights)) for item, terms in asked]
    pairs = np.array(sorted({g for _, groups in queries for g in groups if g[1] >= 0}), dtype=np.int64).reshape(-1, 2)
    index = build_index(counted, weights, pairs, total["docs"], total["terms"])
    return search_index(index, queries, first_scores(index, queries, top), top)


def ranked(documents: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_text: str = "text", top: int = TOP, terms: int = TERMS) -> DataFrame:
    """query (a struct of the columns of `queries`), rank, doc_id and score of the `top` documents of each query."""
    spark = documents.sparkSession
    items = query_terms(queries, query_text)
    n_batches = max(1, -(-(items.agg(F.sum(F.size("terms"))).first()[0] or 0) // terms))
    batches = (ranked_batch(documents, items.where(F.pmod(F.xxhash64("item"), F.lit(n_batches)) == i), doc_id, text, top) for i in range(n_batches))
    found = [f for f in batches if f is not None] or [spark.createDataFrame([], "item long, block long, doc int, id long, score long")]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "block", "doc")
    cut = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return cut.join(items.select("item", "query"), "item").select("query", F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")


def op12_pair_bound_maxscore(spark: SparkSession, directory: str) -> DataFrame:
    found = ranked(read(spark, directory, "documents").select("doc_id", "text"), read(spark, directory, "benchmark").select("item_id", "text"))
    return found.select(F.col("query.item_id").alias("item_id"), "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = f"""
WITH held AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS terms FROM documents
), sized AS (
    SELECT r, doc_id, len(terms) AS n, terms FROM held WHERE len(terms) > 0
), total AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized
), asked AS (
    SELECT DISTINCT i, item_id, unnest(terms) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS terms FROM benchmark)
), posted AS (
    SELECT r, doc_id, n, term, count(*) AS tf
    FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized)
    WHERE term IN (SELECT term FROM asked)
    GROUP BY r, doc_id, n, term
), weighed AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM posted GROUP BY term), total
), scored AS (
    SELECT i, item_id, r, doc_id,
           sum(w * (({UNIT} * tf) // (1000 * tf + {SATURATION} * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN posted USING (term) JOIN weighed USING (term), total
    GROUP BY i, item_id, r, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
