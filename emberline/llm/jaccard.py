"""N-gram Jaccard join by chosen paths: texts whose sets of five-word shingles have similarity 0.8 or more.

Equal texts are one node. A node's set is represented by `PLACES` sampled tokens: the least hash in each part of the
hash range, empty parts filled from others by a fixed order, so that two sets agree in a place with the chance of
their similarity. In each run nodes are split by one place; a bucket above `BUCKET` nodes is split again, by two
places that its path chooses, and so on. Nodes that keep together when split (a part of `TIGHT` of the parent), or
are still together after `DEPTH` splits, are one candidate group as they are. In small buckets all pairs are compared
on the sampled tokens. Runs repeat until a pair of least similarity is met with a chance of `RECALL`.

Candidate groups are then compared exactly on whole sets, in blocks of bounded size, so a large group is spread over
many tasks. Tasks return a count of links for each node, which are summed before they are written, and edges that span
what is linked, never the pairs: inside a block at most one a node, between two blocks fewer than their components, so
a tight group of n nodes in k blocks has about n + k * k / 2. Classes are the connected components of the edges.

Words are runs of anything but ASCII space, as they stand. Defined results: a text of one to four words is a single
shingle; a text without words, such as an empty one, is joined to equal texts only; a null text is joined to nothing
and is a class of its own. Links of a document are the other documents, copies counted, that it is joined to. A class is named by its least doc_id (nulls only if there is
no other). Equal rows are copies. No documents give no rows. Only doc_id and text are read; `keep_one` returns all
columns.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import WORD, per_batch, read, written
from emberline.llm.components import components

SHINGLE = 5
#: Least similarity as a fraction, so that comparisons are exact.
LEAST = (4, 5)
PLACES = 128
RECALL = 0.9999
BUCKET = 128
TIGHT = 0.6
DEPTH = 5
#: Standard errors below the least similarity at which a pair is still compared exactly.
SLACK = 4.0
#: Nodes and shingles of a block of a candidate group, and rows and shingles that one task takes of small ones.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000
PACK_ROWS, PACK_SHINGLES = 500, 200_000
#: Columns of the token matrix that is held at once.
COLUMNS = 8192
#: Distinct words that a task remembers; beyond it starts anew.
REMEMBERED = 500_000

_rng = np.random.default_rng(20)
#: For each place the order in which other places lend it their token.
LENDERS = np.array([_rng.permutation(PLACES) for _ in range(PLACES)])


def runs_needed(recall: float = RECALL) -> int:
    """Runs after which a pair of least similarity s is met with chance `recall`.

    A run keeps it in the first split with chance s, and below with q = 1 - (1 - s q) ** 2 at least.
    """
    s = LEAST[0] / LEAST[1]
    return math.ceil(math.log(1 - recall) / math.log(1 - s * (2 * s - 1) / s**2))


class Shingler:
    """Sets of 64-bit shingle hashes of texts; word hashes are remembered."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [t.encode().split() if isinstance(t, str) else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = {w for words in split for w in words} - self.known.keys()
        self.known |= {w: xxhash.xxh64_intdigest(w) for w in new}
        return [self.shingles(words) for words in split]

    def shingles(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, dtype=np.uint64)
        hashes = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(SHINGLE, len(words))
        mixed = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for at in range(size):
            mixed = (mixed ^ hashes[at : at + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def sampled_tokens(shingles: np.ndarray) -> bytes:
    """The token of each place, as 32-bit numbers; `shingles` is sorted and not empty."""
    parts = (shingles >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(parts, prepend=-1))
    tokens = np.zeros(PLACES, dtype="<u4")
    filled = np.zeros(PLACES, dtype=bool)
    tokens[parts[first]] = (shingles[first] >> np.uint64(25)).astype(np.uint32)
    filled[parts[first]] = True
    if not filled.all():
        lender = LENDERS[np.arange(PLACES), filled[LENDERS].argmax(axis=1)]
        tokens = np.where(filled, tokens, tokens[lender])
    return tokens.tobytes()


def text_keys() -> list[Column]:
    """What knows a text by its content; null for a null text."""
    some = F.col("text").isNotNull()
    return [F.when(some, F.xxhash64("text")).alias("key_a"), F.when(some, F.xxhash64(F.lit(1), "text")).alias("key_b")]


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, the text's keys, its number of shingles and its sampled tokens (null without a shingle)."""

    def make():  # noqa: ANN202
        shingler = Shingler()

        def sketch(texts: list[str | None]) -> list[list]:
            sets = shingler.sets(texts)
            return [[len(s) for s in sets], [sampled_tokens(s) if len(s) else None for s in sets]]

        return sketch

    added = [T.StructField("shingles", T.LongType()), T.StructField("tokens", T.BinaryType())]
    return per_batch(docs.select("doc_id", *text_keys(), "text"), ["text"], added, make).drop("text")


def text_nodes(rows: DataFrame) -> DataFrame:
    """A node for each text: copies, the least doc_id, and how many rows have that doc_id."""
    keys, some = ["key_a", "key_b"], rows.where(F.col("key_a").isNotNull())
    by_id = some.groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rows")).alias("least")
    named = by_id.groupBy(*keys).agg(F.sum("rows").alias("copies"), least)
    # Tokens are exchanged once, after copies have been combined.
    nodes = some.groupBy(*keys).agg(F.first("shingles").alias("shingles"), F.first("tokens").alias("tokens")).join(named, keys)
    return nodes.select(
        F.monotonically_increasing_id().alias("node"),
        "key_a", "key_b", "copies", "shingles", "tokens",
        F.col("least.doc_id").alias("first_doc"),
        F.col("least.rows").alias("first_rows"),
    )


def token(place: Column) -> Column:
    return F.substring("tokens", (place * 4 + 1).cast("int"), F.lit(4))


def chosen_buckets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, node of small buckets of two nodes or more, and node pairs a, b that tie large groups together."""
    places = np.random.default_rng(7).permutation(PLACES)[: runs_needed()].tolist()
    starts = F.array(*[F.xxhash64(F.lit(place), token(F.lit(place))) for place in places])
    rows = nodes.select("node", F.explode(starts).alias("path"), F.lit(None).cast("long").alias("parent"))
    small, tied = [], []
    for depth in range(DEPTH + 1):
        rows = written(rows)
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
        sized = written(rows.join(written(sizes.where(F.col("size") > 1)), "path"))
        small.append(sized.where(F.col("size") <= BUCKET).select("path", "node"))
        large = sized.where(F.col("size") > BUCKET)
        whole = F.lit(True) if depth == DEPTH else F.coalesce(F.col("size") >= TIGHT * F.col("parent"), F.lit(False))
        tied.append(large.where(whole).select(F.col("node").alias("a"), F.col("least").alias("b")))
        large = large.where(~whole)
        if large.isEmpty():
            break
        place = lambda turn: F.pmod(F.xxhash64("path", F.lit(turn)), F.lit(PLACES))
        paths = F.array(*[F.xxhash64("path", F.lit(turn), token(place(turn))) for turn in (0, 1)])
        rows = large.join(nodes.select("node", "tokens"), "node").select("node", F.explode(paths).alias("path"), F.col("size").alias("parent"))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(union(frames[1:]))
    return union(small), union(tied)


def labels_of(joined: np.ndarray) -> np.ndarray:
    """The least index in the component of each index of a symmetric matrix."""
    labels = np.arange(len(joined))
    while True:
        lower = np.minimum(labels, np.where(joined, labels, len(labels)).min(axis=1, initial=len(labels)))
        lower = lower[lower]
        if (lower == labels).all():
            return labels
        labels = lower


def bucket_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Spanning pairs of the nodes of each bucket whose sampled tokens agree well enough."""
    frame = frame.sort_values("path", kind="stable")
    tokens = np.frombuffer(b"".join(frame["tokens"]), dtype="<u4").reshape(len(frame), PLACES)
    nodes, sizes = frame["node"].to_numpy(), np.minimum(frame["shingles"].to_numpy(), PLACES)
    starts = np.append(np.flatnonzero(np.diff(frame["path"].to_numpy(), prepend=np.nan)), len(frame))
    s = LEAST[0] / LEAST[1]
    left, right = [], []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        agree = np.stack([(tokens[a:b] == row).mean(axis=1) for row in tokens[a:b]])
        fewest = np.minimum(sizes[a:b, None], sizes[None, a:b])
        labels = labels_of(agree >= s - SLACK * np.sqrt(s * (1 - s) / fewest))
        moved = np.flatnonzero(labels != np.arange(b - a))
        left.append(nodes[a:b][moved])
        right.append(nodes[a:b][labels[moved]])
    return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """node, root of every node that may have a link."""
    small, tied = chosen_buckets(nodes)
    small = small.join(nodes.select("node", "shingles", "tokens"), "node")
    packs = max(1, small.count() // PACK_ROWS)
    pack = F.pmod(F.xxhash64("path"), F.lit(packs)).alias("pack")
    pairs = small.select("path", "node", "shingles", "tokens", pack).groupBy("pack").applyInPandas(bucket_pairs, "a long, b long")
    return components(written(pairs.union(tied)))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, tokens, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    keep = shared[tokens]
    column = np.cumsum(shared)[tokens[keep]] - 1
    owners = owners[keep]
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[owners[a:b], column[a:b] - start] = 1
        total += (held @ held.T).astype(np.int64)
    return total


def verified(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of each node of a task's groups (b null), and edges a, b that tie the linked ones together (links 0).

    Where a group comes as two blocks, `side` tells them apart, and only pairs across count. What is linked inside a
    block is tied by the block's own task, so two blocks return edges between their components only, and fewer than
    there are components.
    """
    out = []
    for _, group in frame.groupby("root", sort=False):
        # Rows that repeat a doc_id and its text come more than once.
        group = group.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(s, dtype="<u8") for s in group["shingle_set"]]
        sizes = np.array([len(s) for s in sets])
        both = shared_counts(sets)
        joined = both * LEAST[1] >= LEAST[0] * (sizes[:, None] + sizes[None, :] - both)
        np.fill_diagonal(joined, False)
        nodes, side = group["node"].to_numpy(), group["side"].to_numpy()
        if side.any():
            across = side[:, None] != side[None, :]
            heads, part = np.unique(labels_of(joined & ~across), return_inverse=True)
            joined &= across
            met = np.zeros((len(heads), len(heads)), dtype=bool)
            one, other = joined.nonzero()
            met[part[one], part[other]] = True
        else:
            heads, met = np.arange(len(nodes)), joined
        labels = labels_of(met)
        moved = np.flatnonzero(labels != np.arange(len(heads)))
        links = joined @ group["copies"].to_numpy()
        some = links > 0
        out.append(pd.DataFrame({"a": nodes[some], "b": None, "links": links[some]}))
        out.append(pd.DataFrame({"a": nodes[heads[moved]], "b": nodes[heads[labels[moved]]], "links": 0}))
    return pd.concat(out, ignore_index=True).astype({"b": "Int64"})


def exact_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, links: rows of `verified` over all candidate groups, links summed by node."""
    members = written(groups.join(nodes.drop("tokens"), "node"))
    weight = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("shingles") / BLOCK_SHINGLES))
    blocks = members.groupBy("root").agg(weight.cast("int").alias("blocks"))
    members = written(members.join(blocks, "root").select("node", "root", "blocks", "copies", "shingles", "key_a", "key_b", "first_doc"))
    packs = max(1, int(members.agg(F.sum("shingles")).first()[0] or 0) // PACK_SHINGLES)

    keyed = docs.select("doc_id", *text_keys(), "text")
    named = keyed["doc_id"].eqNullSafe(members["first_doc"])
    # Merged at any size: candidates grow with the table, so they are never broadcast and the plan stays one.
    texts = keyed.join(members.hint("merge"), (keyed["key_a"] == members["key_a"]) & (keyed["key_b"] == members["key_b"]) & named)

    def make():  # noqa: ANN202
        shingler = Shingler()
        return lambda found: [[s.astype("<u8").tobytes() for s in shingler.sets(found)]]

    added = [T.StructField("shingle_set", T.BinaryType())]
    shingled = per_batch(texts.select("node", "root", "blocks", "copies", "text"), ["text"], added, make).drop("text")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = shingled.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    packed = F.pmod(F.xxhash64("root"), F.lit(packs))
    task = F.when(F.col("blocks") == 1, packed).otherwise(F.xxhash64("root", low, high)).alias("task")
    side = (F.col("block") > F.col("other")).cast("int").alias("side")
    # A task of two blocks holds the lower as side 0 and the higher as side 1; one block alone is all side 0.
    found = spread.select(task, "root", side, "node", "copies", "shingle_set").groupBy("task").applyInPandas(verified, "a long, b long, links long")
    return found.groupBy("a", "b").agg(F.sum("links").alias("links"))


def joined_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `sketched`, and its nodes with class_node and links."""
    rows = written(sketched(docs))
    nodes = written(text_nodes(rows))
    found = written(exact_links(docs, nodes, candidate_groups(nodes.where(F.col("tokens").isNotNull()))))
    classes = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    links = found.where(F.col("b").isNull()).select(F.col("a").alias("node"), "links")
    joined = nodes.drop("tokens", "shingles").join(links, "node", "left").join(classes, "node", "left")
    others = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return rows.drop("tokens", "shingles"), written(joined.select("node", "key_a", "key_b", "first_doc", "first_rows", F.coalesce("root", "node").alias("class_node"), others.alias("links")))


def similar_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and links of every document."""
    docs = docs.select("doc_id", "text")
    rows, nodes = joined_texts(docs)
    names = nodes.groupBy("class_node").agg(F.min("first_doc").alias("class_id"))
    named = written(nodes.join(names, "class_node").select("key_a", "key_b", "class_id", "links"))
    found = rows.join(named, ["key_a", "key_b"], "left")
    alone = F.col("links").isNull()
    return found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each class: that of the least doc_id. Null texts stay."""
    columns = docs.columns
    slim = docs.select("doc_id", "text")
    _, nodes = joined_texts(slim)
    least = F.min(F.struct(F.col("first_doc").isNull().alias("unnamed"), "first_doc", "node", "key_a", "key_b", "first_rows")).alias("least")
    keepers = written(nodes.groupBy("class_node").agg(least).select("least.*"))
    whole = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns]).alias("doc"), *text_keys(), F.col("doc_id").alias("row_doc"))
    without = whole.where(F.col("key_a").isNull()).select("doc")
    same = (whole["key_a"] == keepers["key_a"]) & (whole["key_b"] == keepers["key_b"]) & whole["row_doc"].eqNullSafe(keepers["first_doc"])
    kept = whole.join(keepers, same).select("doc", "node", "first_rows")
    # Only rows that repeat both doc_id and text are brought together to choose one.
    single = kept.where(F.col("first_rows") == 1).select("doc")
    chosen = Window.partitionBy("node").orderBy(F.to_json("doc"))
    repeated = kept.where(F.col("first_rows") > 1).withColumn("turn", F.row_number().over(chosen)).where("turn = 1").select("doc")
    return single.union(repeated).union(without).select("doc.*")


def op7_chosen_path(spark: SparkSession, directory: str) -> DataFrame:
    return similar_classes(read(spark, directory, "documents"))


OP7_SQL = rf"""
WITH RECURSIVE listed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), placed AS (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - {SHINGLE} + 1, 1) + 1)) AS pos FROM listed WHERE len(words) > 0
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[pos : pos + {SHINGLE} - 1], ' ') AS shingle FROM placed
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE shared * {LEAST[1]} >= {LEAST[0]} * (x.n + y.n - shared)
    UNION
    SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS class_id,
       (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS links
FROM documents d
"""
