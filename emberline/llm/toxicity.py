"""Toxicity through a noisy channel: restore disguised words, then score the restored text.

A chunk of text that looks disguised (digits or signs among letters, letters three times in a row, single characters
apart, letters of two scripts) is a lattice: each character is itself, a letter it may stand for, or nothing; a mask is
any letter or nothing, and a space in a run of single characters may end a word. Viterbi finds the cheapest reading
under a character trigram model whose counts come from all documents. A word with doubled letters, or with look-alikes
or masks at an end, is read as another where all documents hold that one far more often; of a word's readings without
doubled letters the `READINGS` cheapest are looked at, which are all up to six doubled letters. Words are then scored by
whole word and by beginnings of 4 to 6 letters: how much likelier toxic documents hold them, shrunk to the base rate. A
logistic regression over a document's highest word scores and their share gives the score.

Word statistics come from all labelled documents given; only the regression is fitted on a bounded sample of
`FIT_ROWS` labels, picked by a hash of doc_id. All tables of counts have a fixed number of buckets.

Defined results: a null text counts as empty; a text without letters gets the regression's score of no evidence.
Without labels of both kinds the score is the base rate of label 1, or 0. Equal rows get equal results. A document
with several labels is toxic if one of them says so. Texts are scored whole. No documents give no rows. Only doc_id,
text and, of the labels, doc_id and toxic are read.
"""

from __future__ import annotations

import heapq
import itertools
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import per_batch, read, small_batches
from emberline.llm.language import fold
from emberline.llm.ngrams import hashed, hashed_places, letters, summed_counts

#: Buckets of character trigrams and of word features, as powers of two.
GRAM_BITS, WORD_BITS = 16, 20
BEGINNINGS = (4, 5, 6)
#: Rows of the base rate added to each feature's counts.
SHRINK = 20.0
#: The highest word scores of a document that the regression sees.
TOP = 5
#: Labels whose documents the regression is fitted on, about.
FIT_ROWS = 20_000
#: Distinct chunks that a task remembers; beyond it starts anew.
REMEMBERED = 300_000

# Letters that signs and digits stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
# Latin letters that Cyrillic and Greek ones look like.
TWINS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SEPARATORS = ".-_*~'` "
#: Signs that may stand after a letter of a spaced word.
AFTER = ".,;:?"
#: What a chunk may be for a spaced run, as bits: one character, a letter of a run, one that begins with a letter.
BARE, SINGLE, LETTER = 1, 2, 4
# Costs in nats of reading a character otherwise than as itself.
SWAP, SKIP, REPEAT, MASKED, TWIN = 1.0, 0.5, 0.2, 0.5, 0.2
MASK = "*"
#: What a mask may stand for, by script.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя")
#: A word is read as another one that is so many times as frequent; readings of doubled letters looked at.
OFTENER, READINGS = 10, 64
#: Tables of trigrams kept for sets of symbols.
TABLES = 64

_disguised = regex.compile(r"\p{L}[0-9@$!|+(<€£*._~\-]+\p{L}|[0-9@$€£]\p{L}|(\p{L})\1\1")
_triple = re.compile(r"(.)\1\1")
_double = re.compile(r"(.)\1")
_ends = regex.compile(r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}@$]+$|([#*$%&|<>!?.])\1\1$")
_mixed = regex.compile(r"\p{Latin}.*[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}].*\p{Latin}")
_signs = "".join(LOOKALIKES)


def chunks_of(text: str) -> list[str]:
    """Lower-case chunks between white space, without a comma or full stop at the end."""
    text = unicodedata.normalize("NFC", text).lower()
    return text.replace(", ", " ").replace(". ", " ").replace(".\n", "\n").split()


def is_single(chunk: str) -> bool:
    """Whether a chunk may be a letter of a spaced word: a letter, look-alike or mask, perhaps with a sign after it."""
    bare = chunk if len(chunk) == 1 else chunk.rstrip(AFTER)
    return len(bare) == 1 and (bare.isalpha() or bare in LOOKALIKES or bare == MASK)


def kinds_of(chunks: list[str]) -> np.ndarray:
    """The bits of `BARE`, `SINGLE` and `LETTER` that hold for each chunk, 0 for longer ones."""
    kinds = np.zeros(len(chunks), dtype=np.int8)
    for i, chunk in enumerate(chunks):
        # One character alone or with a sign after it; the others are not looked at.
        if chunk[1:2] in AFTER:
            kinds[i] = BARE * (len(chunk) == 1) | SINGLE * is_single(chunk) | LETTER * chunk[:1].isalpha()
    return kinds


def spaced_runs(kinds: np.ndarray) -> list[tuple[int, int]]:
    """Beginnings and ends of runs of single characters, two letters at least among them.

    A run has three or more, of which two neighbours have no sign after them.
    """
    bare = (kinds & BARE).view(bool)
    if not (bare[:-1] & bare[1:]).any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (kinds & SINGLE) >> 1, [0]])))
    runs = zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
    return [(a, b) for a, b in runs if b - a >= 3 and np.count_nonzero(kinds[a:b] & LETTER) > 1]


def spaced_out(chunks: list[str]) -> list[str]:
    """The spaced runs of a text's chunks, each with spaces between."""
    return [" ".join(chunks[a:b]) for a, b in spaced_runs(kinds_of(chunks))]


def word_buckets(words: list[str]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, map(str.encode, words)), dtype=np.int64, count=len(words)) & ((1 << WORD_BITS) - 1)


def is_mixed(chunk: str) -> bool:
    """Whether letters of a chunk come from Latin and from Greek or Cyrillic script."""
    return not chunk.isascii() and max(chunk) >= "\u0370" and bool(_mixed.search(chunk))


class CharacterModel:
    """Trigram log probabilities of lower-case letters and word ends, backed off to bigrams."""

    def __init__(self, counts: np.ndarray, words: np.ndarray):
        self.pairs, self.triples, self.words = counts[0].astype(float), counts[1].astype(float), words
        #: How often words of an average bucket stand in all documents.
        self.usual = float(words.mean())
        self.known: dict[str, float] = {}
        self.tables: dict[str, np.ndarray] = {}
        self.ends: dict[tuple[str, str, str, bool], str] = {}

    def logs(self, codes: np.ndarray) -> np.ndarray:
        pairs, triples = hashed(codes[:, :2], GRAM_BITS), hashed(codes, GRAM_BITS)
        return np.log((self.triples[triples] + 0.01) / (self.pairs[pairs] + 1.0))

    def log(self, context: str, char: str) -> float:
        gram = context + char
        if gram not in self.known:
            self.known[gram] = float(self.logs(np.array([[ord(c) for c in gram]]))[0])
        return self.known[gram]

    def table(self, symbols: str) -> np.ndarray:
        """The cost in nats of each symbol after each two of them."""
        if symbols not in self.tables:
            if len(self.tables) >= TABLES:
                self.tables.clear()
            codes = np.array([ord(c) for c in symbols])
            grams = np.stack(np.meshgrid(codes, codes, codes, indexing="ij"), axis=-1).reshape(-1, 3)
            self.tables[symbols] = -self.logs(grams).reshape((len(symbols),) * 3)
        return self.tables[symbols]

    def frequent(self, word: str) -> int:
        """How often all documents hold a word, or more where words share a bucket."""
        return self.words.item(zlib.crc32(word.encode()) & ((1 << WORD_BITS) - 1))


def readings(before: str, char: str, alphabet: str, mixed: bool) -> list[tuple[str, float]]:
    """What a character after another may be, and the cost of it."""
    if char == " ":
        return [("", SKIP), (" ", SKIP)]
    if char == MASK:
        return [("", SKIP), *((c, MASKED) for c in alphabet)]
    found = [(char, 0.0)] if char.isalpha() else [(c, SWAP) for c in LOOKALIKES.get(char, "")]
    if mixed and char in TWINS:
        found.append((TWINS[char], TWIN))
    if char in SEPARATORS or not found:
        found.append(("", SKIP))
    if char == before:
        found.append(("", REPEAT))
    return found


def cheapest(context: str, may_be: list[list[tuple[str, float]]], model: CharacterModel) -> str:
    """The cheapest choice of readings after a context: Viterbi, a state for each last two characters."""
    best = {context: (0.0, "")}
    for choices in may_be:
        step: dict[str, tuple[float, str]] = {}
        for context, (cost, read_so_far) in best.items():
            for char, price in choices:
                if char == " " and context == "  ":
                    continue
                total = cost + price - (model.log(context, char) if char else 0.0)
                state = context if not char else "  " if char == " " else context[1] + char
                if state not in step or total < step[state][0]:
                    step[state] = (total, read_so_far + char)
        best = step
    ended = ((cost - model.log(context, " "), text) for context, (cost, text) in best.items())
    return min(ended)[1]


def cheapest_masked(context: str, may_be: list[list[tuple[str, float]]], model: CharacterModel) -> str:
    """As `cheapest`, over arrays of all states at once: masks make states of every two letters."""
    symbols = " " + "".join(sorted({c for choices in may_be for c, _ in choices}.union(context) - {" "}))
    at, costs = {c: i for i, c in enumerate(symbols)}, model.table(symbols)
    size = len(symbols)
    best = np.full((size, size), np.inf)
    best[at[context[0]], at[context[1]]] = 0.0
    # For each step and state the symbol before its two, or SAME; for the state of a word's end the state before.
    steps, same = [], -1
    for choices in may_be:
        skip = min((price for char, price in choices if not char), default=np.inf)
        now, came = best + skip, np.full((size, size), same)
        some = [(at[char], price) for char, price in choices if char not in ("", " ")]
        if some:
            prices = np.full(size, np.inf)
            for column, price in some:
                prices[column] = min(price, prices[column])
            live = np.flatnonzero(np.isfinite(best).any(axis=1))
            total = best[live][:, :, None] + costs[live]
            first = total.argmin(axis=0)
            cost = np.take_along_axis(total, first[None], axis=0)[0] + prices
            better = cost < now
            now[better], came[better] = cost[better], live[first[better]]
        if any(char == " " for char, _ in choices):
            price = min(price for char, price in choices if char == " ")
            total = best + costs[:, :, 0] + price
            total[0, 0] = np.inf
            if total.min() < now[0, 0]:
                now[0, 0], came[0, 0] = total.min(), total.argmin()
        best = now
        steps.append(came)
    state = divmod(int((best + costs[:, :, 0]).argmin()), size)
    out = []
    for came in reversed(steps):
        before = int(came[state])
        if before == same:
            continue
        if state == (0, 0):
            out.append(" ")
            state = divmod(before, size)
        else:
            out.append(symbols[state[1]])
            state = (before, state[0])
    return "".join(reversed(out))


def restore(chunk: str, model: CharacterModel) -> str:
    """The cheapest reading of a disguised chunk.

    Letters ahead of the first choice matter by their last two only, so the rest is remembered by these.
    """
    mixed = is_mixed(chunk)
    alphabet = next((a for a in ALPHABETS if any(c in a for c in chunk)), ALPHABETS[0]) if MASK in chunk else ""
    plain = 0
    while plain < len(chunk) and chunk[plain].isalpha() and not (mixed and chunk[plain] in TWINS) and (not plain or chunk[plain] != chunk[plain - 1]):
        plain += 1
    context, rest = ("  " + chunk[:plain])[-2:], chunk[plain:]
    key = (context, rest, alphabet, mixed)
    if key not in model.ends:
        if len(model.ends) > REMEMBERED:
            model.ends.clear()
        may_be = [readings(before, char, alphabet, mixed) for before, char in zip(context[1] + rest, rest, strict=False)]
        model.ends[key] = (cheapest_masked if rest.count(MASK) > 1 else cheapest)(context, may_be, model)
    return chunk[:plain] + model.ends[key]


def without_doubles(word: str, model: CharacterModel) -> list[str]:
    """The `READINGS` cheapest readings of a word that leave out one or more letters equal to the one before."""
    doubles = len(_double.findall(word))
    if 1 << doubles <= READINGS:
        found = [""]
        for i, char in enumerate(word):
            found = [w + char for w in found] + (found if i and char == word[i - 1] else [])
        return [w for w in found if w != word]
    # So many for each last two characters are enough to hold the cheapest of all.
    best = {"  ": {"": 0.0}}
    for i, char in enumerate(word):
        step: dict[str, dict[str, float]] = {}
        for context, held in best.items():
            price = model.log(context, char)
            step.setdefault(context[1] + char, {}).update({text + char: cost - price for text, cost in held.items()})
        if i and char == word[i - 1]:
            for context, held in best.items():
                now = step.setdefault(context, {})
                now |= {text: min(cost + REPEAT, now.get(text, np.inf)) for text, cost in held.items()}
        best = {context: {t: held[t] for t in heapq.nsmallest(READINGS + 1, held, key=held.get)} for context, held in step.items()}
    ended = {text: cost - model.log(context, " ") for context, held in best.items() for text, cost in held.items() if text != word}
    return heapq.nsmallest(READINGS, ended, key=ended.get)


def single_letters(word: str, model: CharacterModel) -> str:
    """A word without those doubled letters without which it is a far more frequent one."""
    double = _double.search(word)
    if not double:
        return word
    at = double.start()
    only = not _double.search(word, at + 1)
    best = word[:at] + word[at + 1 :] if only else max(without_doubles(word, model), key=model.frequent)
    return best if model.frequent(best) > OFTENER * model.frequent(word) else word


def with_ends(chunk: str, core: str) -> list[str]:
    """A chunk's core with the look-alikes and masks at its beginning, its end and both."""
    at = chunk.index(core)
    ahead, after = chunk[:at], chunk[at + len(core) :]
    if not (ahead[-1:] in LOOKALIKES or after[:1] in LOOKALIKES or after[:1] == MASK or core[-1] in LOOKALIKES):
        return []
    first = ahead[len(ahead.rstrip(_signs)) :]
    last = after[: len(after) - len(after.lstrip(_signs + MASK))]
    found = [first + core + last, first + core, core + last]
    if core[-1] in LOOKALIKES:
        found.append(core)
    return [w for w in dict.fromkeys(found) if w != core or core[-1] in LOOKALIKES]


def restored_words(chunk: str, model: CharacterModel) -> list[str]:
    """The words of a chunk, read through the channel where it looks disguised; only a spaced run may be several."""
    if chunk.isalpha() and not _triple.search(chunk) and not is_mixed(chunk):
        return [single_letters(chunk, model)]
    if " " in chunk:
        return [single_letters(w, model) for w in map(letters, restore(chunk, model).split(" ")) if w]
    core = _ends.sub("", chunk)
    if not core:
        return [""]
    word = single_letters(letters(restore(core, model) if _disguised.search(core) or is_mixed(core) else core), model)
    if not word:
        return [word]
    for other in with_ends(chunk, core):
        whole = single_letters(letters(restore(other, model)), model)
        # Digits that end a word are letters where that gives a known word, however frequent the word without them.
        known = model.frequent(whole) > OFTENER * model.usual
        if known and (other == core or model.frequent(whole) > OFTENER * model.frequent(word)):
            word = whole
    return [word]


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted; for as many as a text has a sort is cheaper than `np.unique`."""
    ordered = np.sort(numbers, axis=None)
    first = np.ones(len(ordered), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return ordered[first]


def beginnings(words: list[str]) -> np.ndarray:
    """Buckets of each word's features: the whole word and its beginnings, shorter words padded."""
    width = max(BEGINNINGS)
    codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    parts = [hashed(np.hstack([codes[:, :n], np.full((len(words), 1), n, dtype=np.uint32)]), WORD_BITS) for n in BEGINNINGS]
    return np.stack([word_buckets(words), *parts], axis=1)


class Reader:
    """The distinct restored words of texts and their features; distinct chunks are remembered."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        #: Numbers in order of first sight, of chunks and of their words.
        self.known: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.words: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        #: For each number the chunk, its word and its bits; what is seen but not learnt yet is not among them.
        self.chunks: list[str] = []
        self.word_of = np.zeros(0, dtype=np.int32)
        self.kinds = np.zeros(0, dtype=np.int8)
        self.runs: dict[str, list[int]] = {}
        self.features = np.zeros((1, 1 + len(BEGINNINGS)), dtype=np.int64)
        self.add([""])

    def add(self, words: list[str]) -> np.ndarray:
        """The numbers of words, with features for new ones."""
        numbers = np.fromiter(map(self.words.__getitem__, words), dtype=np.int32, count=len(words))
        fresh = list(itertools.islice(self.words, len(self.features), None))
        if fresh:
            self.features = np.vstack([self.features, beginnings(fresh)])
        return numbers

    def number(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's chunks in order, of an empty one if it has none.

        Arrow finds the distinct chunks of all texts, so each is looked up once. Python splits at white space, as
        Arrow's own split is wrong where a text ends with several.
        """
        split = pc.split_pattern(pa.array([" ".join(chunks_of(t)) if t else "" for t in texts], type=pa.large_string()), " ")
        found = split.values.dictionary_encode()
        chunks = found.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.known.__getitem__, chunks), dtype=np.int32, count=len(chunks))[found.indices.to_numpy()]
        return [numbers[a:b] for a, b in itertools.pairwise(split.offsets.to_pylist())]

    def learn(self) -> None:
        """The words of chunks that got a number since."""
        new = list(itertools.islice(self.known, len(self.chunks), None))
        if not new:
            return
        words = [c if c.isalpha() and not _double.search(c) and not is_mixed(c) else restored_words(c, self.model)[0] for c in new]
        self.chunks += new
        self.word_of = np.concatenate([self.word_of, self.add(words)])
        self.kinds = np.concatenate([self.kinds, kinds_of(new)])

    def learn_runs(self, runs: set[str]) -> None:
        """Spaced runs, of several words perhaps."""
        new = {run: restored_words(run, self.model) for run in runs - self.runs.keys()}
        self.add([w for words in new.values() for w in words])
        self.runs |= {run: [self.words[w] for w in words] for run, words in new.items()}

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the numbers of its distinct words, which are rows of `features`."""
        if len(self.known) + len(self.runs) > REMEMBERED:
            self.forget()
        numbers = self.number(texts)
        self.learn()
        spaced = [[" ".join(map(self.chunks.__getitem__, n[a:b].tolist())) for a, b in spaced_runs(self.kinds[n])] for n in numbers]
        self.learn_runs({run for runs in spaced for run in runs})
        out = []
        for seen, runs in zip(numbers, spaced, strict=True):
            words = self.word_of[seen]
            if runs:
                words = np.concatenate([words, np.array([w for run in runs for w in self.runs[run]], dtype=np.int32)])
            words = distinct(words)
            out.append(words[words > 0])
        return out


def character_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and triples of characters in the words of all documents, and the words by bucket."""
    split = 2 << GRAM_BITS

    def count(frames: Iterable[pd.DataFrame]) -> np.ndarray:
        whole = np.zeros(split + (1 << WORD_BITS), dtype=np.int64)
        total, held = whole[:split].reshape(2, -1), whole[split:]
        found: Counter[str] = Counter()

        def add() -> None:
            words = list(map(letters, found))
            some = np.fromiter(map(bool, words), dtype=bool, count=len(words))
            times = np.fromiter(found.values(), dtype=np.int64, count=len(words))[some]
            found.clear()
            words = list(filter(None, words))
            if not words:
                return
            np.add.at(held, word_buckets(words), times)
            # Two spaces ahead of each word and one after it.
            codes = np.frombuffer(f"  {'   '.join(words)} ".encode("utf-32-le"), dtype=np.uint32)
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 3
            times = np.repeat(times, lengths)[2:]
            # Not those that run from one word into the next.
            ends = np.cumsum(lengths)[:-1]
            inside = np.ones(len(codes) - 2, dtype=bool)
            inside[np.concatenate([ends - 2, ends - 1])] = False
            places, times = [codes[i : len(codes) - 2 + i][inside] for i in range(3)], times[inside]
            for row, buckets in zip(total, (hashed_places(places[:2], GRAM_BITS), hashed_places(places, GRAM_BITS)), strict=True):
                row += np.bincount(buckets, times, 1 << GRAM_BITS).astype(np.int64)

        for frame in frames:
            for text in frame["text"].dropna():
                found.update(text.lower().split())
            if len(found) > REMEMBERED:
                add()
        add()
        return whole

    counts = summed_counts(docs.select("text"), count, (split + (1 << WORD_BITS),))
    return counts[:split].reshape(2, -1), counts[split:]


class ToxicModel:
    def __init__(self, characters: CharacterModel, counts: np.ndarray, documents: np.ndarray):
        """counts: documents of label 0 and 1 that hold each feature; documents: of label 0 and 1."""
        self.characters = characters
        both = max(documents.sum(), 1)
        self.base = documents[1] / both
        rate = min(max(self.base, 1 / (both + 1)), 1 - 1 / (both + 1))
        shrunk = (counts[1] + SHRINK * rate) / (counts.sum(axis=0) + SHRINK)
        self.gains = np.log(np.maximum(shrunk, 1e-6) / rate).astype(np.float32)
        self.weights: np.ndarray | None = None

    def word_gains(self, features: np.ndarray) -> np.ndarray:
        return self.gains[features].max(axis=1)

    @staticmethod
    def evidence(gains: np.ndarray) -> np.ndarray:
        """From a document's word scores: the highest, the share of high ones, and a constant."""
        row = np.zeros(TOP + 2)
        row[-1] = 1.0
        if len(gains):
            top = np.sort(np.partition(gains, -TOP)[-TOP:] if len(gains) > TOP else gains)[::-1]
            row[: len(top)] = top
            row[TOP] = (gains > 1.0).mean()
        return row

    def fit(self, rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> None:
        """Logistic regression by Newton steps; the constant is not penalised."""
        weights = np.zeros(rows.shape[1])
        penalty = np.full(rows.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(30):
            chance = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
            slope = rows.T @ (labels - chance) - penalty * weights
            bend = (rows * (chance * (1 - chance))[:, None]).T @ rows + np.diag(penalty)
            move = np.linalg.solve(bend, slope)
            weights += move
            if np.abs(move).max() < 1e-8:
                break
        self.weights = weights

    def score(self, gains: np.ndarray) -> float:
        if self.weights is None:
            return float(self.base)
        return float(1 / (1 + np.exp(-np.clip(self.evidence(gains) @ self.weights, -30, 30))))


class Scorer:
    """Word scores of texts, under a reader that remembers words."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.reader = Reader(model.characters)
        self.words, self.known = self.reader.words, np.zeros(0, dtype=np.float32)

    def gains(self, texts: list[str | None]) -> list[np.ndarray]:
        found = self.reader.read(texts)
        if self.words is not self.reader.words:
            # The reader has started anew, and so do the scores.
            self.words, self.known = self.reader.words, np.zeros(0, dtype=np.float32)
        self.known = np.concatenate([self.known, self.model.word_gains(self.reader.features[len(self.known) :])])
        return [self.known[words] for words in found]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicModel:
    """Learn from all `docs` (characters) and from those that `labels` (doc_id, toxic) name."""
    context = docs.sparkSession.sparkContext
    characters = CharacterModel(*character_counts(docs))
    shared = context.broadcast(characters)
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Labels grow with the table, so they are merged at any size and the plan stays one.
    labelled = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    width = 1 << WORD_BITS

    def count(frames: Iterable[pd.DataFrame]) -> np.ndarray:
        reader = Reader(shared.value)
        total = np.zeros((2, width + 1), dtype=np.int64)
        for frame in frames:
            for words, toxic in zip(reader.read(list(frame["text"])), frame["toxic"], strict=True):
                total[toxic, distinct(reader.features[words])] += 1
                total[toxic, width] += 1
        return total

    counts = summed_counts(labelled, count, (2, width + 1))
    model = ToxicModel(characters, counts[:, :width], counts[:, width])
    if counts[:, width].min() > 0:
        shared_model = context.broadcast(model)
        # A hash picks about fit_rows labels, so the table that is broadcast and the rows fitted are bounded.
        every = max(1, known.count() // fit_rows)
        sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
        sampled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))

        def evidence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(shared_model.value)
            for frame in frames:
                rows = [ToxicModel.evidence(g) for g in scorer.gains(list(frame["text"]))]
                yield pd.DataFrame({"row": rows, "toxic": frame["toxic"].to_numpy()})

        fitted = small_batches(sampled).mapInPandas(evidence, "row array<double>, toxic int").toPandas()
        if fitted["toxic"].nunique() == 2:
            model.fit(np.stack(fitted["row"].to_list()), fitted["toxic"].to_numpy(dtype=float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and the score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():  # noqa: ANN202
        scorer = Scorer(shared.value)
        return lambda texts: [[shared.value.score(g) for g in scorer.gains(texts)]]

    return per_batch(docs.select("doc_id", "text"), ["text"], [T.StructField("score", T.DoubleType())], make).drop("text")


def op6_noisy_channel(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents")
    labels = read(spark, directory, "labels").where(fold() != 0).select("doc_id", "toxic")
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
