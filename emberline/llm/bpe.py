"""BPE encoding and decoding with a public vocabulary, by batched merge rounds in numpy.

The symbols of many words stand in one flat array. Each round looks up the rank of every neighbouring pair by binary
search over the sorted pair keys, takes the lowest rank of each word, and merges that pair everywhere in the word,
from the left; words without a pair are put aside. Only distinct chunks of text (between spaces, after
normalisation) are encoded, and they are remembered in a table of bounded size in the task.

Token ids are carried as binary, little-endian unsigned 32-bit integers.

Defined results: a null text counts as empty and has no tokens; null ids decode to empty text. Equal rows get equal
results. Texts are encoded whole, however long. No documents give no rows.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import per_batch, read

VOCABULARY = "word_bpe_49k.json"
#: Chunks that a task remembers; beyond it starts anew.
REMEMBERED = 100_000

# Fixed values of the vocabulary's format.
WORD_END = "</w>"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: str.split() takes these for white space, the vocabulary does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from code point 256."""
    printable = [b for low, high in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(low), ord(high) + 1)]
    others = iter(range(256, 512))
    shown = set(printable)
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.empty(1 + max(max(ids.values()), *self.special.values()), dtype=object)
        for token, i in (ids | self.special).items():
            self.tokens[i] = token
        self.size = len(self.tokens)
        chars = byte_characters()
        self.inner = np.array([ids[c] for c in chars], dtype=np.int64)
        self.last = np.array([ids[c + WORD_END] for c in chars], dtype=np.int64)
        pairs = np.array([ids[a] * self.size + ids[b] for a, b in model["merges"]], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in model["merges"]], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.made = pairs[order], order, made
        self.words = regex.compile(WORD_PATTERN)
        self.spaces = regex.compile(rf"(?V1)[\s--[{SEPARATORS}]]+")
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; `len(ranks)` where no merge has it."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], len(self.ranks))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The token ids of each word, as bytes; words hold a byte or more."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        number = np.arange(len(words))
        none = len(self.ranks)
        done: list = [None] * len(words)
        while len(number):
            starts = np.cumsum(lengths) - lengths
            ranks = np.full(len(symbols), none, dtype=np.int64)
            ranks[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
            ranks[starts + lengths - 1] = none
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == none
            if over.any():
                for i in np.flatnonzero(over):
                    done[number[i]] = symbols[starts[i] : starts[i] + lengths[i]].astype("<u4").tobytes()
                stay = np.repeat(~over, lengths)
                symbols, ranks = symbols[stay], ranks[stay]
                number, lengths, lowest = number[~over], lengths[~over], lowest[~over]
                if not len(number):
                    break
                starts = np.cumsum(lengths) - lengths
            chosen = ranks == np.repeat(lowest, lengths)
            # In a run of overlapping pairs every second one is merged, from the left.
            place = np.arange(len(symbols))
            begun = np.maximum.accumulate(np.where(chosen, -1, place))
            chosen &= (place - begun) % 2 == 1
            at = np.flatnonzero(chosen)
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            lengths = np.add.reduceat(keep, starts, dtype=np.int64)
            symbols = symbols[keep]
        return done

    def chunks(self, text: str) -> list[str]:
        """A text as chunks between spaces; a special token is a chunk with a space before it."""
        found, at = [], 0
        for m in self.specials.finditer(text) if "<|" in text else ():
            found += self.plain_chunks(text[at : m.start()])
            found.append(" " + m.group())
            at = m.end()
        return found + self.plain_chunks(text[at:] if at else text)

    def plain_chunks(self, text: str) -> list[str]:
        # Letters are lowered one by one, so a sigma at a word's end is as any other.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(c in text for c in SEPARATORS):
            return [c for c in self.spaces.split(text) if c]
        return text.split()

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [[] if c[0] == " " else [w.encode() for w in self.words.findall(c)] for c in chunks]
        merged = self.merge([w for words in split for w in words])
        out, at = [], 0
        for chunk, words in zip(chunks, split, strict=True):
            if chunk[0] == " ":
                out.append(self.special[chunk[1:]].to_bytes(4, "little"))
            else:
                out.append(b"".join(merged[at : at + len(words)]))
            at += len(words)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches of texts and remembers distinct chunks."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.vocabulary.chunks(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = sorted({c for chunks in split for c in chunks} - self.known.keys())
        if new:
            self.known |= zip(new, self.vocabulary.encode_chunks(new), strict=True)
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """All columns of `docs`, and the token ids of its text as binary; a column of that name is replaced."""

    def make():  # noqa: ANN202
        encoder = Encoder(path)
        return lambda texts: [encoder.encode([t or "" for t in texts])]

    return per_batch(docs, [text], [T.StructField(ids, T.BinaryType())], make)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """All columns of `tokens`, and the text of its ids: this vocabulary's tokens with a space between."""

    def make():  # noqa: ANN202
        shown = vocabulary(path).tokens
        return lambda coded: [[" ".join(shown[np.frombuffer(b or b"", dtype="<u4")]) for b in coded]]

    return per_batch(tokens, [ids], [T.StructField(text, T.StringType())], make)


def op5_merge_rounds(spark: SparkSession, directory: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = read(spark, directory, "documents").select("doc_id", "text")
    coded = decode(encode(docs, path).select("doc_id", "token_ids"), path)
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
