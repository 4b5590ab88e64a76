"""Language identification with spans: script ranges, then Viterbi over per-word scores.

Learned from labelled documents: for each language the counts of hashed character trigrams of its words, and of its
letters by script. A word's candidates are the languages that use its script (all, if none does); its score under a
language is the sum of log probabilities of its trigrams. Viterbi with a penalty for every switch labels the words.
Where no stretch of a text gains more than half a penalty by another language, one label for the whole text is the
best path, and no search is needed.

The counts have a fixed number of buckets for each language and script, so the model's size follows the number of
languages, not the text.

Defined results: a text that is null or has no letters is `und` with score 0 and no spans, and so is every text if
no language could be learned. The language of a text is that of most letters, ties to the lower name; its score is
that language's share of the letters. Equal rows get equal results. Texts are labelled whole. No documents give no
rows. Only doc_id, text and, in training, lang are read; a null doc_id counts as an empty name.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import per_batch, read
from emberline.llm.ngrams import letters, summed_counts, trigrams, word_sums

UNKNOWN = "und"
BITS = 16
SMOOTHING = 0.1
#: Log odds that a change of language must earn.
PENALTY = 20.0
#: A language uses a script that holds at least this part of its letters.
LEAST_SCRIPT = 0.01
#: Chunks of text that a task remembers; beyond it starts anew.
REMEMBERED = 300_000

# First code points of ranges of scripts, as in the Unicode blocks.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = [start for start, _ in SCRIPT_STARTS]
_SCRIPT_AT = [SCRIPTS.index(name) for _, name in SCRIPT_STARTS]


def script_of(word: str) -> int:
    """The script of a word's first letter."""
    return _SCRIPT_AT[bisect.bisect_right(_STARTS, ord(word[0])) - 1]


def chunks_of(text: str) -> list[str]:
    return unicodedata.normalize("NFC", text).lower().split()


def fold() -> Column:
    """Remainder by 5 of the checksum of doc_id as text; rows of remainder 0 are held out."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 5


class Model:
    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        smooth = grams + SMOOTHING
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
        uses = scripts >= np.maximum(1, LEAST_SCRIPT * scripts.sum(axis=1, keepdims=True))
        uses[:, ~uses.any(axis=0)] = True
        self.barred = np.where(uses, 0.0, -1e4).T

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word, relative to its best language; words are lower-case letters, or empty."""
        buckets, lengths = trigrams(words, BITS)
        scores = word_sums(self.logs[buckets].astype(np.float64), lengths)
        some = np.flatnonzero(lengths)
        scores[some] += self.barred[[script_of(words[i]) for i in some]]
        return scores - scores.max(axis=1, keepdims=True)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word."""
        one = int(scores.sum(axis=0).argmax())
        gains = np.cumsum(scores - scores[:, one : one + 1], axis=0)
        lowest = np.minimum(np.minimum.accumulate(gains, axis=0), 0)
        before = np.vstack([np.zeros((1, gains.shape[1])), lowest[:-1]])
        if (gains - before).max() <= PENALTY / 2:
            return np.full(len(scores), one)
        return viterbi(scores.tolist(), PENALTY)


def viterbi(scores: list[list[float]], penalty: float) -> np.ndarray:
    """Labels of the best path; a change between any two labels costs `penalty`."""
    states = range(len(scores[0]))
    best = scores[0]
    back = []
    for row in scores[1:]:
        top = max(best)
        leader = best.index(top)
        floor = top - penalty
        back.append([s if best[s] >= floor else leader for s in states])
        best = [(b if b >= floor else floor) + r for b, r in zip(best, row, strict=True)]
    label = best.index(max(best))
    labels = [label]
    for came in reversed(back):
        label = came[label]
        labels.append(label)
    return np.array(labels[::-1])


def train(labelled: DataFrame) -> Model | None:
    """Learn from text and lang of all rows given; None if there is no language."""
    labelled = labelled.select("text", "lang").where(F.col("lang").isNotNull())
    languages = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return None
    number = {name: i for i, name in enumerate(languages)}
    width = (1 << BITS) + len(SCRIPTS)

    def count(frames: Iterable[pd.DataFrame]) -> np.ndarray:
        total = np.zeros((len(languages), width), dtype=np.int64)
        for frame in frames:
            for name, group in frame.groupby("lang"):
                found: Counter[str] = Counter()
                for text in group["text"].dropna():
                    found.update(chunks_of(text))
                pairs = [(w, n) for w, n in ((letters(c), n) for c, n in found.items()) if w]
                if not pairs:
                    continue
                words, times = [w for w, _ in pairs], np.array([n for _, n in pairs])
                buckets, lengths = trigrams(words, BITS)
                row = total[number[name]]
                row[: 1 << BITS] += np.bincount(buckets, np.repeat(times, lengths), 1 << BITS).astype(np.int64)
                scripts = np.array([script_of(w) for w in words])
                row[1 << BITS :] += np.bincount(scripts, times * lengths, len(SCRIPTS)).astype(np.int64)
        return total

    counts = summed_counts(labelled, count, (len(languages), width))
    return Model(languages, counts[:, : 1 << BITS].astype(float), counts[:, 1 << BITS :].astype(float))


class Labeller:
    """Labels texts of one task; scores of distinct chunks are remembered."""

    def __init__(self, model: Model | None):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages) if self.model else 0))
        self.sizes = np.zeros(0, dtype=np.int64)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > REMEMBERED:
            self.forget()
        new = list({c for chunks in texts for c in chunks} - self.known.keys())
        if new:
            words = [letters(c) for c in new]
            self.known |= {c: i + len(self.known) for i, c in enumerate(new)}
            self.scores = np.vstack([self.scores, self.model.word_scores(words)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, words), dtype=np.int64, count=len(words))])

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (first word, words, language) of each text; words stand between white space."""
        if not self.model:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        split = [chunks_of(t) if t else [] for t in texts]
        self.learn(split)
        out = []
        for chunks in split:
            at = np.fromiter(map(self.known.__getitem__, chunks), dtype=np.int64, count=len(chunks))
            sizes = self.sizes[at]
            if not sizes.sum():
                out.append((UNKNOWN, 0.0, []))
                continue
            labels = self.model.path(self.scores[at])
            share = np.bincount(labels, sizes, len(self.model.languages)) / sizes.sum()
            starts = np.flatnonzero(np.diff(labels, prepend=-1))
            ends = np.append(starts[1:], len(labels))
            spans = [(int(a), int(b - a), self.model.languages[labels[a]]) for a, b in zip(starts, ends, strict=True)]
            top = int(share.argmax())
            out.append((self.model.languages[top], float(share[top]), spans))
        return out


ADDED = (
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())]))),
)


def identify(docs: DataFrame, model: Model | None, added: tuple = ADDED) -> DataFrame:
    """All columns of `docs` and the three of `added`; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():  # noqa: ANN202
        labeller = Labeller(shared.value)

        def label(texts: list[str | None]) -> list[list]:
            found = labeller.label(texts)
            names = ("first_word", "words", "lang")
            spans = [[dict(zip(names, span, strict=True)) for span in f[2]] for f in found]
            return [[f[0] for f in found], [f[1] for f in found], spans]

        return label

    return per_batch(docs, ["text"], list(added), make)


def op10_script_viterbi(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents")
    model = train(docs.where(fold() != 0))
    labelled = identify(docs.select("doc_id", "text"), model)
    return labelled.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", F.col("score").cast("double").alias("score"))
