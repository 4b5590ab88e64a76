"""Boosted trees on histograms that Spark sums: missing values and categories as they are, rounds that can go on.

Features become small codes once: numeric ones the number of the quantile range they fall into, categories the rank of
their level by frequency, and 0 stands for a missing value. The coded rows are written. A job of `REFRESH` rounds is a
barrier stage: its tasks run together, each reads its share of the rows once, and for each level of a tree they exchange
sums of gradients, curvatures and rows by (node, feature, code), whose number does not depend on the rows. Of two children
the one with fewer rows is summed, the other has the rest of their parent's sums. From the same
sums every task picks the same splits: a code range, or one level against the rest, and the side for missing values that
gains more. A job gives its trees to the driver, and the rows are written with their margins, so a lost task repeats one
job at most. A model goes on from its last tree.

At the start of each round log loss and AUC of the calib rows are taken. Boosting ends when neither has been better for
`patience` rounds; the rounds up to the best log loss are kept.
"""

from __future__ import annotations

import base64
import json
import math
import os
import shutil
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cache
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import ensure_checkpoint_dir, settle

#: Most ranges of a numeric feature; most levels of a category that count by themselves, others share a code.
RANGES, LEVELS = 63, 254
RATE, RIDGE, LEAST_ROWS, SAMPLED = 0.1, 1.0, 20, 0.8
#: Rounds of a job.
REFRESH = 200
#: Rows for which a job takes one more task while there are cores, if tasks exchange files; the same if they exchange
#: messages of Spark, which take a second each, as long as the sums of some 4,000,000 rows; and most tasks, as each reads all sums.
TASK_ROWS, MESSAGE_ROWS, MOST_TASKS = 50_000, 2_000_000, 64
#: Score buckets of the calib AUC; most combinations of codes that are counted together; rows taken at once.
AUC_BUCKETS, JOINT, BLOCK = 1024, 4500, 32_768
#: Seconds in which a task has to see the first files of the others, and in which each later file has to come.
FIRST_WAIT, LONGEST_WAIT = 10.0, 3600.0


@dataclass(frozen=True)
class Tree:
    """A complete tree: of inner node i the children are 2i + 1 and 2i + 2. Feature -1 sends all rows left."""

    feature: list[int]
    code: list[int]
    level: list[bool]
    missing_left: list[bool]
    value: list[float]


@dataclass(frozen=True)
class Boosted:
    """Features and their coding, the first margin, and the trees."""

    numeric: tuple[str, ...]
    categories: tuple[str, ...]
    edges: dict[str, list[float]]
    levels: dict[str, list[str]]
    start: float = 0.0
    trees: tuple[Tree, ...] = ()
    history: tuple[tuple[float, float], ...] = field(default=())

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.numeric, *self.categories)

    def sizes(self) -> np.ndarray:
        """Codes of each feature: missing, its ranges, or its levels and the rest."""
        numeric = [len(self.edges[f]) + 2 for f in self.numeric]
        return np.array(numeric + [len(self.levels[f]) + 2 for f in self.categories])

    def codes(self, frame: pd.DataFrame) -> np.ndarray:
        """A row of codes for each row of the features; a level that was not among the counted ones has the last code."""
        out = np.zeros((len(frame), len(self.features)), dtype=np.uint8)
        for at, name in enumerate(self.numeric):
            values = pd.to_numeric(frame[name]).to_numpy(dtype=float, na_value=np.nan)
            out[:, at] = np.where(np.isnan(values), 0, np.searchsorted(self.edges[name], values, side="left") + 1)
        for at, name in enumerate(self.categories, start=len(self.numeric)):
            number = {v: i + 1 for i, v in enumerate(self.levels[name])}
            out[:, at] = [0 if v is None or v != v else number.get(str(v), len(number) + 1) for v in frame[name]]
        return out

    def margins(self, codes: np.ndarray, trees: Sequence[Tree] | None = None) -> np.ndarray:
        """Sums of the trees' values; of all trees with the first margin if none are given."""
        out = np.full(len(codes), self.start if trees is None else 0.0)
        for tree in self.trees if trees is None else trees:
            out += np.array(tree.value)[descend(tree, codes, depth_of(tree)) - len(tree.feature)]
        return out

    def to_json(self) -> str:
        return json.dumps({**self.__dict__, "trees": [t.__dict__ for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Boosted:
        raw = json.loads(text)
        lists = {k: tuple(raw[k]) for k in ("numeric", "categories")}
        return Boosted(**{**raw, **lists, "trees": tuple(Tree(**t) for t in raw["trees"]), "history": tuple(map(tuple, raw["history"]))})


def depth_of(tree: Tree) -> int:
    return int(math.log2(len(tree.feature) + 1))


def left_codes(tree: Tree, nodes: Sequence[int]) -> np.ndarray:
    """nodes × 256: whether a code goes left at a node."""
    code, every = np.array(tree.code)[nodes][:, None], np.arange(256)
    left = np.where(np.array(tree.level)[nodes][:, None], every == code, every <= code)
    left[:, 0] = np.array(tree.missing_left)[nodes]
    return left | (np.array(tree.feature)[nodes] < 0)[:, None]


def goes_left(tree: Tree, node: np.ndarray | int, codes: np.ndarray) -> np.ndarray:
    """Whether each row goes left at its node."""
    own = codes[np.arange(len(codes)), np.maximum(np.array(tree.feature)[node], 0)]
    return left_codes(tree, range(len(tree.feature)))[node, own]


def descend(tree: Tree, codes: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after some levels."""
    node, flat, starts = np.zeros(len(codes), dtype=np.int64), codes.ravel(), np.arange(len(codes)) * codes.shape[1]
    feature, left = np.maximum(tree.feature, 0), left_codes(tree, range(len(tree.feature))).ravel()
    for _ in range(levels):
        own = flat.take(starts + feature.take(node))
        node = 2 * node + 2 - left.take(node * 256 + own)
    return node


def coding(df: DataFrame, numeric: Sequence[str], categories: Sequence[str]) -> Boosted:
    """Ranges of equal shares of each numeric feature, and the most frequent levels of each category."""
    shares = [i / (RANGES + 1) for i in range(1, RANGES + 1)]
    asked = [F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in numeric]
    found = df.where(F.lit(True)).agg(F.count(F.lit(1)), *asked).first()
    edges = {c: sorted({float(v) for v in found[c] or [] if v == v}) for c in numeric}
    levels = {}
    for c in categories:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count()
        levels[c] = [r["v"] for r in counts.orderBy(F.desc("count"), "v").limit(LEVELS).collect()]
    return Boosted(tuple(numeric), tuple(categories), edges, levels)


def coded_rows(df: DataFrame, model: Boosted, label: str, weight: float) -> tuple[DataFrame, int]:
    """label, weight, calib, draw (a hash that draws rows), codes and margin of the train and calib rows, written; and
    the tasks of a job on them."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fitting = df.where(F.col("split").isin("train", "calib") & F.col(label).isNotNull())
    chosen = fitting.select(
        F.col(label).cast("double").alias("_label"), F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)).alias("_weight"),
        (F.col("split") == "calib").alias("_calib"), F.xxhash64(*[F.col(c) for c in df.columns if c not in ("split",)]).alias("_draw"), *model.features,
    )

    def batches(arrived: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in arrived:
            codes = shared.value.codes(frame)
            out = frame[["_label", "_weight", "_calib", "_draw"]].set_axis(["label", "weight", "calib", "draw"], axis=1)
            yield out.assign(codes=[row.tobytes() for row in codes], margin=shared.value.margins(codes))

    schema = "label double, weight double, calib boolean, draw long, codes binary, margin double"
    tasks = tasks_for(fitting)
    return settle(chosen.mapInPandas(batches, schema).repartition(tasks)), tasks


def tasks_for(rows: DataFrame) -> int:
    """Tasks of a job: one for each `TASK_ROWS` rows, at most as many as can run at the same time."""
    context = rows.sparkSession.sparkContext._jsc.sc()
    together = context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())
    return max(1, min(-(-rows.count() // (TASK_ROWS if shared_folder(rows.sparkSession) else MESSAGE_ROWS)), together, MOST_TASKS))


def shared_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder as a path that Python can open; None if it is in another kind of store."""
    found = urlparse(ensure_checkpoint_dir(spark))
    return unquote(found.path) if found.scheme in ("", "file") else None


class Exchange:
    """Gives the bytes of each task of a barrier stage to all of them, in the order of the tasks.

    They go through files in a folder that all tasks share, as a message of Spark takes a second. The tasks first try
    whether each sees the files of all; if one does not, all use messages.
    """

    def __init__(self, context: BarrierTaskContext, folder: str | None):
        self.context, self.task, self.tasks = context, context.partitionId(), len(context.getTaskInfos())
        self.folder, self.step = folder, 0
        if self.folder:
            # A repeated stage must not read files of the one that failed.
            self.folder = os.path.join(folder, context.allGather(uuid.uuid4().hex)[0])
            try:
                os.makedirs(self.folder, exist_ok=True)
                seen = self.through_files(b"", FIRST_WAIT)
            except OSError:
                seen = None
            if not all(context.allGather("" if seen is None else "seen")):
                self.folder = None

    def gather(self, sent: bytes) -> list[bytes]:
        if self.folder:
            return self.through_files(sent, LONGEST_WAIT)
        return [base64.b64decode(m) for m in self.context.allGather(base64.b64encode(sent).decode())]

    def through_files(self, sent: bytes, wait: float) -> list[bytes]:
        own, until, got = self.path(self.task), time.monotonic() + wait, []
        with open(f"{own}.part", "wb") as file:
            file.write(sent)
        os.replace(f"{own}.part", own)
        while len(got) < self.tasks:
            try:
                with open(self.path(len(got)), "rb") as file:
                    got.append(file.read())
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"no sums of task {len(got)} after {wait} seconds") from None
                time.sleep(0.0005)
        self.step += 1
        if self.step > 1:
            # Who has written this step has read the step before.
            os.remove(self.path(self.task, self.step - 2))
        return got

    def path(self, task: int, step: int | None = None) -> str:
        return os.path.join(self.folder, f"{self.step if step is None else step}-{task}")


def chance(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margins))


def joined(sizes: Sequence[int], most: int) -> list[list[int]]:
    """Features whose codes are counted together, the larger first: groups with at most `most` combinations."""
    groups: list[list[int]] = []
    for feature in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        fitting = (g for g in groups if math.prod(int(sizes[f]) for f in [*g, feature]) <= most)
        if (group := next(fitting, None)) is None:
            groups.append([feature])
        else:
            group.append(feature)
    return groups


class TaskRows:
    """A task's share of the coded rows, a line for each feature, and where each row stands in the growing tree."""

    def __init__(self, arrived: Iterator[pa.RecordBatch], sizes: np.ndarray):
        kept = [[np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, len(sizes)).T,
                 *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "calib", "draw", "margin"))] for batch in arrived]
        none = [np.zeros((len(sizes), 0), dtype=np.uint8), *(np.zeros(0, dtype=t) for t in (float, float, bool, np.int64, float))]
        self.codes, self.y, self.w, self.calib, self.draw, self.margin = (np.concatenate(c, axis=-1) for c in zip(none, *kept, strict=True))
        self.draw, self.sizes = self.draw.astype(np.uint64), sizes
        self.codes = np.ascontiguousarray(self.codes)
        self.watched = np.flatnonzero(self.calib)
        # A pass over codes that are counted together gives the sums of two or more features.
        self.joint = []
        for group in joined(sizes, min(JOINT, len(self.y) // 4)):
            codes = self.codes[group[0]].astype(np.uint16)
            for feature in group[1:]:
                codes = codes * np.uint16(sizes[feature]) + self.codes[feature]
            self.joint.append((group, [int(sizes[f]) for f in group], codes))

    def begin(self, turn: int) -> np.ndarray:
        """Draw the rows of a round; the calib sums of all trees so far, a column for each score bucket."""
        watched = np.zeros((3, AUC_BUCKETS))
        if len(self.watched):
            q, cy, cw = np.clip(chance(self.margin.take(self.watched)), 1e-15, 1 - 1e-15), self.y.take(self.watched), self.w.take(self.watched)
            bucket = np.minimum((q * AUC_BUCKETS).astype(np.int64), AUC_BUCKETS - 1)
            losses = -cw * (cy * np.log(q) + (1 - cy) * np.log(1 - q))
            watched = np.stack([np.bincount(bucket, what, AUC_BUCKETS) for what in (cw * cy, cw * (1 - cy), losses)])
        drawn = (self.draw ^ np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
        self.some = np.flatnonzero(~self.calib & (drawn < np.uint64(math.ceil(SAMPLED * 2**32))))
        y, w, p = self.y.take(self.some), self.w.take(self.some), chance(self.margin.take(self.some))
        self.gradient, self.curvature = w * (p - y), w * p * (1 - p)
        self.place = np.zeros(len(self.y), dtype=np.uint16)
        return watched

    def sums(self, counted: np.ndarray | None = None) -> np.ndarray:
        """Gradient, curvature and rows by (node, feature, code) of the drawn rows; of the root, or of one child of each
        node of the last level, those that are `counted`."""
        at, gradient, curvature, place, nodes = self.some, self.gradient, self.curvature, None, 1
        if counted is not None:
            place, nodes = self.place.take(at), len(counted) // 2
            chosen = np.flatnonzero(counted.take(place))
            at, gradient, curvature = at.take(chosen), gradient.take(chosen), curvature.take(chosen)
            place = (place.take(chosen) >> 1).astype(np.int64)
        out, starts = np.zeros((3, nodes, int(self.sizes.sum()))), np.cumsum(self.sizes) - self.sizes
        for group, sizes, codes in self.joint:
            slot, slots = codes.take(at), math.prod(sizes)
            slot = slot.astype(np.int64) if place is None else place * slots + slot
            for into, what in zip(out, (gradient, curvature, None), strict=True):
                found = np.bincount(slot, what, nodes * slots).reshape(nodes, *sizes)
                for axis, (feature, size) in enumerate(zip(group, sizes, strict=True), start=1):
                    into[:, starts[feature] : starts[feature] + size] = found.sum(axis=tuple(a for a in range(1, found.ndim) if a != axis))
        return out.reshape(3, -1)

    def descend(self, tree: Tree, level: int) -> None:
        nodes, rows = range((1 << level) - 1, (2 << level) - 1), len(self.y)
        begins, left = np.maximum(np.array(tree.feature)[nodes], 0) * rows, left_codes(tree, nodes).ravel()
        codes, numbers = self.codes.ravel(), np.arange(BLOCK)
        for at in range(0, rows, BLOCK):
            place = self.place[at : at + BLOCK].astype(np.int64)
            own = codes.take(begins.take(place) + at + numbers[: len(place)])
            self.place[at : at + BLOCK] = 2 * place + 1 - left.take(place * 256 + own)

    def finish(self, tree: Tree) -> None:
        self.margin = self.margin + np.array(tree.value).take(self.place)


def added_up(together: Exchange | None, sums: np.ndarray) -> np.ndarray:
    """The sums of all tasks, in their order; what has no rows is not sent."""
    if together is None:
        return sums
    full = sums[:2].any(axis=0) | (sums[2] != 0)
    sent = np.packbits(full).tobytes() + sums[:, full].astype("<f8").tobytes()
    total, ends = np.zeros_like(sums), -(-len(full) // 8)
    for got in together.gather(sent):
        held = np.unpackbits(np.frombuffer(got, dtype=np.uint8, count=ends), count=len(full)).astype(bool)
        total[:, held] += np.frombuffer(got, dtype="<f8", offset=ends).reshape(3, -1)
    return total


def watched_metrics(sums: np.ndarray) -> tuple[float, float] | None:
    """Log loss and AUC of the calib rows, ties within a bucket as a half; None without such rows."""
    positive, negative, losses = sums[:, sums[:2].sum(axis=0) > 0]
    if not len(positive):
        return None
    below = np.cumsum(negative) - negative
    pairs = positive.sum() * negative.sum()
    auc = float((positive * (below + negative / 2)).sum() / pairs) if pairs else 0.5
    return float(sum(losses.tolist()) / (positive.sum() + negative.sum())), auc


def best_split(hist: np.ndarray, sizes: np.ndarray, n_numeric: int) -> tuple[float, int, int, bool, bool] | None:
    """(gain, feature, code, is a level, missing goes left) of a node; `hist` has a row of sums for each slot."""
    return best_splits(hist.T[:, None], sizes, n_numeric)[0]


def best_splits(sums: np.ndarray, sizes: np.ndarray, n_numeric: int) -> list[tuple[float, int, int, bool, bool] | None]:
    """The best split of each node, all nodes and features in one step; `sums` is (3, nodes, slots)."""
    starts, codes = np.cumsum(sizes) - sizes, np.arange(1, max(int(sizes.max()), 2))
    there = codes < sizes[:, None]
    # A line of codes for each feature; what a shorter one lacks is read from a slot without rows.
    padded = np.concatenate([sums, np.zeros((*sums.shape[:2], 1))], axis=2)
    left = padded[:, :, np.where(there, starts[:, None] + codes, sums.shape[2])]
    left[:, :, :n_numeric] = np.cumsum(left[:, :, :n_numeric], axis=3)
    missing, whole = sums[:, :, starts][..., None], sums[:, :, : sizes[0]].sum(axis=2)[:, :, None, None]
    worth = lambda s: s[0] ** 2 / (s[1] + RIDGE)
    gains, at = [], []
    for sides in (left, left + missing):
        other = whole - sides
        gain = worth(sides) + worth(other) - worth(whole)
        gain[(sides[2] < LEAST_ROWS) | (other[2] < LEAST_ROWS) | ~there] = -np.inf
        at.append(gain.argmax(axis=2))
        gains.append(gain.max(axis=2))
    found = []
    for of_node, code_of in zip(np.stack(gains, axis=2).tolist(), np.stack(at, axis=2).tolist(), strict=True):
        best = None
        for feature, (own, code) in enumerate(zip(of_node, code_of, strict=True)):
            for missing_left in (False, True):
                # Equal columns have equal gains but for rounding; the first of them is taken.
                if own[missing_left] > 1e-9 and (best is None or own[missing_left] > best[0] + 1e-9 * max(1.0, best[0])):
                    best = (own[missing_left], feature, code[missing_left] + 1, feature >= n_numeric, missing_left)
        found.append(best)
    return found


def children(parents: np.ndarray, some: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Sums of both children of each node, from its own and those of the counted child."""
    rest = parents - some
    # A difference of sums without rows is rounding.
    rest[:, rest[2] == 0] = 0.0
    both = np.empty((3, len(counted), parents.shape[2]))
    both[:, counted], both[:, ~counted] = some, rest
    return both


def one_tree(rows: TaskRows, together: Exchange | None, model: Boosted, depth: int, first: np.ndarray) -> Tree | None:
    """The next tree, an exchange for each level after the first; None where no split gains."""
    sizes = model.sizes()
    total, inner = int(sizes.sum()), (1 << depth) - 1
    tree = Tree([-1] * inner, [0] * inner, [False] * inner, [False] * inner, [0.0] * (1 << depth))
    sums, fewer = first.reshape(3, 1, total), np.zeros(0, dtype=bool)
    for level in range(depth):
        if level:
            counted = np.stack([~fewer, fewer], axis=1).ravel()
            sums = children(sums, added_up(together, rows.sums(counted)).reshape(3, -1, total), counted)
        fewer = np.ones(1 << level, dtype=bool)
        for place, found in enumerate(best_splits(sums, sizes, len(model.numeric))):
            node = (1 << level) - 1 + place
            hist = sums[:, place].T
            whole = hist[: sizes[0]].sum(axis=0)
            sides = [whole, np.zeros(3)]
            if found:
                _, feature, code, is_level, missing_left = found
                tree.feature[node], tree.code[node], tree.level[node], tree.missing_left[node] = feature, code, is_level, missing_left
                own = hist[sizes[:feature].sum() : sizes[: feature + 1].sum()]
                left = own[code].copy() if is_level else own[1 : code + 1].sum(axis=0)
                if not own[0, 2]:
                    # Nothing was missing here: what comes later goes where most rows go.
                    tree.missing_left[node] = missing_left = bool(2 * left[2] >= whole[2])
                left = left + own[0] if missing_left else left
                sides = [left, whole - left]
                fewer[place] = 2 * left[2] >= whole[2]
            if level == depth - 1:
                for side, s in enumerate(sides):
                    tree.value[2 * place + side] = float(-RATE * s[0] / (s[1] + RIDGE))
        rows.descend(tree, level)
    return tree if tree.feature[0] >= 0 else None


def more_rounds(rows: DataFrame, model: Boosted, history: list[tuple[float, float]], left: int, depth: int, patience: int) -> tuple[Boosted, list, bool]:
    """The model and the history after `REFRESH` rounds at most, in one job, and whether boosting has ended.

    `rows` holds margins of all trees of the model; `left` are the rounds still allowed.
    """
    sizes = model.sizes()
    shared, folder = rows.sparkSession.sparkContext.broadcast((model, history)), shared_folder(rows.sparkSession)
    folder = folder and os.path.join(folder, f"sums-{uuid.uuid4().hex}")

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        together = Exchange(context, folder) if len(context.getTaskInfos()) > 1 else None
        (model, history), held = shared.value, TaskRows(arrived, sizes)
        trees, history, ended = list(model.trees), list(history), False
        begun = len(trees)
        while not ended and len(trees) - begun < REFRESH:
            watched = held.begin(len(trees))
            both = added_up(together, np.concatenate([watched, held.sums()], axis=1))
            watched, first = both[:, :AUC_BUCKETS], both[:, AUC_BUCKETS:]
            if metrics := watched_metrics(watched):
                history.append(metrics)
            ended = bool(metrics and best_rounds(history, patience)[1]) or len(trees) - begun == left
            tree = None if ended else one_tree(held, together, model, depth, first)
            ended = tree is None
            if tree:
                held.finish(tree)
                trees.append(tree)
        if context.partitionId() == 0:
            found = json.dumps({"trees": [t.__dict__ for t in trees[begun:]], "history": history, "ended": ended})
            yield pa.RecordBatch.from_arrays([pa.array([found])], names=["found"])

    found = json.loads(rows.mapInArrow(batches, "found string", barrier=True).collect()[0][0])
    if folder:
        shutil.rmtree(folder, ignore_errors=True)
    model = replace(model, trees=(*model.trees, *(Tree(**t) for t in found["trees"])))
    return model, [tuple(h) for h in found["history"]], found["ended"]


def refreshed(rows: DataFrame, model: Boosted, done: int) -> DataFrame:
    """The coded rows with the margins of all trees, written; theirs are of the first `done`."""
    shared, width = rows.sparkSession.sparkContext.broadcast(model), len(model.features)

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, width)
            new = batch.column("margin").to_numpy() + shared.value.margins(codes, shared.value.trees[done:])
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(new))

    return settle(rows.mapInArrow(batches, rows.schema))


def best_rounds(history: Sequence[tuple[float, float]], patience: int) -> tuple[int, bool]:
    """Rounds of the least log loss, and whether neither it nor the AUC was better in the last `patience` rounds."""
    losses, aucs = [h[0] for h in history], [h[1] for h in history]
    newest = max(int(np.argmin(losses)), int(np.argmax(aucs)))
    return int(np.argmin(losses)), len(history) - 1 - newest >= patience


def boost(
    df: DataFrame, numeric: Sequence[str], categories: Sequence[str], label: str, rounds: int, depth: int = 4, patience: int = 50,
    weighted: bool = True, start: Boosted | None = None,
) -> Boosted:
    """Fit on split = train, watch split = calib, and keep its best rounds. `start` is a model to go on from.

    `history` of the model holds (log loss, AUC) of calib before the first tree and after each kept one; with no calib
    rows it is empty and all rounds are kept.
    """
    train = df.where((F.col("split") == "train") & F.col(label).isNotNull())
    counted = train.agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros")).first()
    ones, zeros = counted["ones"], counted["zeros"]
    weight = zeros / max(ones, 1) if weighted else 1.0
    if start is None:
        odds = (max(ones, 0.5) * weight) / max(zeros, 0.5) if ones + zeros else 1.0
        start = replace(coding(train, numeric, categories), start=math.log(odds))
    model = replace(start, history=())
    rows, tasks = coded_rows(df, model, label, weight)
    begun, history, ended = len(model.trees), [], False
    while not ended:
        done = len(model.trees)
        model, history, ended = more_rounds(rows.repartition(tasks), model, history, rounds - (done - begun), depth, patience)
        if not ended:
            rows = refreshed(rows, model, done)
    kept = best_rounds(history, patience)[0] if history else len(model.trees) - begun
    return replace(model, trees=model.trees[: begun + kept], history=tuple(history[: kept + 1]))


def scored(df: DataFrame, model: Boosted, name: str) -> DataFrame:
    """`df` with the chance of label 1 as `name`; features may be null, levels new."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def chances(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(chance(shared.value.margins(shared.value.codes(frame))))

    columns = [F.col(c).cast("double").alias(c) for c in model.numeric] + [F.col(c).cast("string").alias(c) for c in model.categories]
    return df.withColumn(name, chances(F.struct(*columns)))


def shapley(model: Boosted, codes: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Exact interventional Shapley values of the margin, rows × features, averaged over the background rows."""
    return looked_up(pass_tables(model, background), codes)


def looked_up(tables: Sequence[tuple[list[int], np.ndarray, np.ndarray]], codes: np.ndarray) -> np.ndarray:
    """Rows × features: the sums of what `pass_tables` give to the rows."""
    out, codes = np.zeros(codes.shape[::-1]), np.ascontiguousarray(codes.T).astype(np.int64)
    for features, bits, worth in tables:
        way = bits[0].take(codes[features[0]])
        for feature, bit in zip(features[1:], bits[1:], strict=True):
            way += bit.take(codes[feature])
        way = way.astype(np.int64)
        for feature, of_way in zip(features, worth, strict=True):
            out[feature] += of_way.take(way)
    return out.T


def pass_tables(model: Boosted, background: np.ndarray) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """What a row gets from a tree depends only on the nodes where it would go left. For the leaves of each subtree of up
    to three levels: the features asked on the way to them; for each a number by code, whose bits are the nodes where
    the code goes left; and for each what it gets, by the sum of the numbers.

    A leaf counts for a row and a background row where each feature of its path lets one of them pass. With a features
    that only the row passes and b that only the background row passes, each of the former gets the leaf's value times
    (a - 1)! b! / (a + b)!, each of the latter loses it times a! (b - 1)! / (a + b)!.
    """
    made, background = [], np.ascontiguousarray(background.T)
    for tree in model.trees:
        inner, depth = len(tree.feature), depth_of(tree)
        left, top = left_codes(tree, range(inner)), max(depth - 3, 0)
        for root in range((1 << top) - 1, (2 << top) - 1):
            leaves = range((root + 1 << depth - top) - 1 - inner, (root + 2 << depth - top) - 1 - inner)
            paths = [path_to(tree, leaf) for leaf in leaves]
            nodes = sorted({node for path in paths for node, _ in path or ()})
            if not nodes:
                continue
            features = sorted({tree.feature[n] for n in nodes})
            every, kind = np.arange(1 << len(nodes)), np.min_scalar_type((1 << len(nodes)) - 1)
            bits, worth = np.zeros((len(features), 256), dtype=kind), np.zeros((len(features), len(every)))
            passes = {}
            for i, node in enumerate(nodes):
                bits[features.index(tree.feature[node])] |= left[node].astype(kind) << kind.type(i)
                passes[node] = every >> i & 1 == 1, left[node].take(background[tree.feature[node]])
            for leaf, path in zip(leaves, paths, strict=True):
                let = {}
                for node, is_left in path or ():
                    own, other = (p if is_left else ~p for p in passes[node])
                    had = let.get(tree.feature[node])
                    let[tree.feature[node]] = (own, other) if had is None else (had[0] & own, had[1] & other)
                if not let:
                    continue
                own, other = (sum(p[side].astype(np.int64) << i for i, p in enumerate(let.values())) for side in (0, 1))
                # What a row gets depends on which features of the path let it pass, so on a few cases.
                table = tree.value[leaf] * (shares(len(let)) @ (np.bincount(other, minlength=1 << len(let)) / len(other)))
                for i, feature in enumerate(let):
                    worth[features.index(feature)] += table[i].take(own)
            made.append((features, bits, worth))
    return made


def path_to(tree: Tree, leaf: int) -> list[tuple[int, bool]] | None:
    """Nodes with a feature on the way to a leaf, and whether it goes left there; None if no row comes to it."""
    node, path = leaf + len(tree.feature), []
    while node:
        parent, is_left = (node - 1) // 2, node % 2 == 1
        if tree.feature[parent] >= 0:
            path.append((parent, is_left))
        elif not is_left:
            return None
        node = parent
    return path


@cache
def shares(size: int) -> np.ndarray:
    """feature × features that let the row pass × those that let the background row pass (as bits): the feature's share of a leaf."""
    f, full = math.factorial, (1 << size) - 1
    out = np.zeros((size, 1 << size, 1 << size))
    for own in range(1 << size):
        for other in range(1 << size):
            a, b = (own & ~other).bit_count(), (other & ~own).bit_count()
            for i in range(size) if own | other == full else ():
                if own & ~other & 1 << i:
                    out[i, own, other] = f(a - 1) * f(b) / f(a + b)
                elif other & ~own & 1 << i:
                    out[i, own, other] = -f(a) * f(b - 1) / f(a + b)
    return out


def attributions(df: DataFrame, key: str, model: Boosted, background: pd.DataFrame) -> DataFrame:
    """(key, feature, contribution) of the margin against bounded background rows; contributions of a key add up to
    its margin less the mean margin of the background."""
    # The tables do not depend on the rows, some 30 kB for a tree.
    shared = df.sparkSession.sparkContext.broadcast((model, pass_tables(model, model.codes(background))))

    def batches(arrived: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, tables = shared.value
        for frame in arrived:
            for at in range(0, len(frame), 5000):
                some = frame.iloc[at : at + 5000]
                values = looked_up(tables, model.codes(some))
                yield pd.DataFrame({key: np.repeat(some[key].to_numpy(), values.shape[1]), "feature": list(model.features) * len(some), "contribution": values.ravel()})

    columns = [F.col(c).cast("double").alias(c) for c in model.numeric] + [F.col(c).cast("string").alias(c) for c in model.categories]
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *columns).mapInPandas(batches, f"{key} {kind}, feature string, contribution double")


def save(spark: SparkSession, model: Boosted, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Boosted:
    return Boosted.from_json(spark.read.text(path).first()[0])
