"""Hashed character n-grams of words, in numpy, and counts of them summed over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches

_not_letters = regex.compile(r"[^\p{L}\p{M}]+")
# Odd multipliers for the three places of a trigram.
_PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def letters(chunk: str) -> str:
    """The letters of a chunk of text; empty if it has none."""
    return chunk if chunk.isascii() and chunk.isalpha() else _not_letters.sub("", chunk)


def hashed(codes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of n-grams; `codes` has a column for each place."""
    return hashed_places(list(codes.T), bits)


def hashed_places(places: list[np.ndarray], bits: int) -> np.ndarray:
    """As `hashed`, an array for each place."""
    mixed = np.zeros(len(places[0]), dtype=np.uint64)
    for i, codes in enumerate(places):
        mixed ^= codes.astype(np.uint64)
        mixed *= _PLACES[i % 3]
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(7)).astype(np.int64) & ((1 << bits) - 1)


def trigrams(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all words, a space on either side, and how many each word has."""
    joined = " ".join(["", *words, ""])
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    grams = np.stack([codes[:-2], codes[1:-1], codes[2:]], axis=1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    # Trigrams with a space in the middle reach over two words.
    inside = grams[:, 1] != 32
    return hashed(grams[inside], bits), lengths


def word_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of rows of `values` over words; words without rows get zero."""
    sums = np.zeros((len(lengths), *values.shape[1:]), dtype=np.float64)
    some = lengths > 0
    if some.any():
        sums[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some], axis=0)
    return sums


def summed_counts(frame: DataFrame, count: Callable[[Iterable[pd.DataFrame]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all rows of an array of fixed shape that `count` makes of one task's batches.

    Each task sends the cells that are not zero; Spark adds them up before the array reaches the driver.
    """

    frame = small_batches(frame)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = count(frames).ravel()
        cells = np.flatnonzero(flat)
        for at in range(0, len(cells), 50_000):
            some = cells[at : at + 50_000]
            yield pd.DataFrame({"cell": some.astype(np.int64), "n": flat[some].astype(np.int64)})

    cells = frame.mapInPandas(batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(int(np.prod(shape)), dtype=np.int64)
    total[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return total.reshape(shape)
