"""Feature changes as functions that compose.

Every rule changes one feature by x → min(cap, scale · x + shift). Such functions compose to the
same form, so the effect of any run of events is three numbers per feature, and a long history can
be folded in pieces: each piece on its own, then the pieces in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions import constants as K

FEATURES = K.CORE_FEATURES
LATE = FEATURES.index("prior_late_rate")
NO_CAP = float("inf")


def event_effect(kind: Column, updates: Column | None = None) -> Column:
    """(scale, shift, cap) arrays over FEATURES for one event; an explicit map wins."""
    distress = kind.isin("gst_filing", "bank_transaction")

    def parts(name: str) -> tuple[Column, Column, Column]:
        scale, shift, cap = F.lit(1.0), F.lit(0.0), F.lit(NO_CAP)
        if name in ("credit_income_ratio", "annuity_income_ratio"):
            scale = F.when(kind == "gst_filing", F.lit(K.RATIO_INFLATION)).otherwise(scale)
        elif name == "bureau_overdue_flag":
            scale, shift = F.when(distress, 0.0).otherwise(scale), F.when(distress, 1.0).otherwise(shift)
        elif name == "prior_late_rate":
            scale = F.when(kind == "repayment", F.lit(K.LATE_RELIEF)).otherwise(scale)
            shift, cap = F.when(distress, K.LATE_STEP).otherwise(shift), F.when(distress, 1.0).otherwise(cap)
        if updates is None:
            return scale, shift, cap
        explicit = F.coalesce(F.size(updates) > 0, F.lit(False))
        named = explicit & F.map_contains_key(updates, name)
        return (
            F.when(named, 0.0).when(explicit, 1.0).otherwise(scale),
            F.when(named, updates[name]).when(explicit, 0.0).otherwise(shift),
            F.when(explicit, NO_CAP).otherwise(cap),
        )

    columns = [parts(name) for name in FEATURES]
    return F.struct(*[F.array(*[c[i] for c in columns]).alias(n) for i, n in enumerate(("scale", "shift", "cap"))])


Effects = tuple[np.ndarray, np.ndarray, np.ndarray]


def apply_effect(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """New values, of one row or of many; a missing late rate counts as 0 once touched, other missing ones stay."""
    touched = np.isnan(x[..., LATE]) & ((scale[..., LATE] != 1.0) | (shift[..., LATE] != 0.0))
    if touched.any():
        x = x.copy()
        x[..., LATE] = np.where(touched, 0.0, x[..., LATE])
    with np.errstate(invalid="ignore"):
        return np.minimum(cap, np.where(scale == 0.0, shift, scale * x + shift))


def compose(first: Effects, then: Effects) -> Effects:
    """The effect of `first` followed by `then`."""
    (a1, b1, c1), (a2, b2, c2) = first, then
    with np.errstate(invalid="ignore"):
        shift = np.where(a2 == 0.0, b2, a2 * b1 + b2)
        cap = np.where(a2 == 0.0, c2, np.minimum(c2, a2 * c1 + b2))
    return a1 * a2, shift, cap


def scan(effects: Effects, place: np.ndarray) -> Effects:
    """Running composition inside each run, in log2(longest run) steps; `place` counts from 0 within the run."""
    step = 1
    while (reached := place >= step).any():
        earlier = np.flatnonzero(reached) - step
        made = compose(tuple(e[earlier] for e in effects), tuple(e[reached] for e in effects))
        effects = tuple(e.copy() for e in effects)
        for whole, part in zip(effects, made, strict=True):
            whole[reached] = part
        step *= 2
    return effects


def effects_of(batch: pd.DataFrame) -> Effects:
    return tuple(np.stack(batch[c].to_list()).astype(float) for c in ("scale", "shift", "cap"))


def runs_of(batch: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: where each run of equal keys starts, and each row's place in its run."""
    values = batch[keys].to_numpy()
    starts = np.flatnonzero(np.append(True, (values[1:] != values[:-1]).any(axis=1)))
    lengths = np.diff(np.append(starts, len(batch)))
    return starts, np.arange(len(batch)) - np.repeat(starts, lengths)


def compose_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (loan_id, chunk, order) → one composed effect per (loan_id, chunk).

    Of a run that the next batch may continue, only the composed effect is held.
    """
    columns = ["loan_id", "chunk", "scale", "shift", "cap"]
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch[columns] if held is None else pd.concat([held, batch[columns]], ignore_index=True)
        starts, place = runs_of(rows, ["loan_id", "chunk"])
        ends = np.append(starts[1:], len(rows)) - 1
        done = rows[["loan_id", "chunk"]].iloc[ends].reset_index(drop=True)
        done = done.assign(**{c: list(e[ends]) for c, e in zip(columns[2:], scan(effects_of(rows), place), strict=True)})
        held = done.tail(1)
        yield done.iloc[:-1]
    if held is not None:
        yield held


def walked(batches: Iterator[pd.DataFrame], keys: list[str], start: str) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows sorted by keys and order, with their run's start → each batch with values before and after its rows."""
    last, x = None, None
    for batch in batches:
        if not len(batch):
            continue
        starts, place = runs_of(batch, keys)
        begun = np.stack(batch[start].iloc[starts].to_list()).astype(float)
        if last == tuple(batch[keys].iloc[0]):
            begun[0] = x
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(batch))))
        after = apply_effect(begun[run], *scan(effects_of(batch), place))
        before = np.where((place == 0)[:, None], begun[run], np.roll(after, 1, axis=0))
        last, x = tuple(batch[keys].iloc[-1]), after[-1]
        yield batch, before, after


def start_of_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Composed runs sorted by (loan_id, chunk), with the loan's base values → values each run starts from."""
    for batch, before, _ in walked(batches, ["loan_id"], "base"):
        yield batch[["loan_id", "chunk"]].assign(start=list(before))


def states_of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events sorted by (loan_id, chunk, order), with their run's start → values before and after each."""
    for batch, before, after in walked(batches, ["loan_id", "chunk"], "start"):
        yield batch[["event_id", "ts", "loan_id", "type"]].assign(before=list(before), after=list(after))
