"""Quality rules, line first: bad lines are removed, then documents that lose too much text are rejected.

A line (between line feeds) fails by
  navigation   two separators or more, and one for every `SEPARATED` words;
  punctuation  no sentence end of its script in it (scripts without such marks pass), or runs of symbols on one in `SYMBOLS` words, or repeated exclamation marks on
               one in `SHOUTS` words;
  boilerplate  a phrase of `BOILERPLATE`, a short list for nine languages.
Lines without a word are neither judged nor removed. A document is rejected if its failing lines hold more than
`MOST_LOST` of its words, or by the base rules: fewer than `LEAST_WORDS` words, or more than `MOST_REPEATED` percent
of its words in five-word windows that the text holds twice.

Defined results: a null or empty text has no words and fails the base rules; its cleaned text is null or empty.
Equal rows get equal results. Texts are judged whole, one document at a time. No documents give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from emberline.llm.common import WORD, per_batch, read

LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5
#: Part of the words that may go with failing lines.
MOST_LOST = 0.8
SEPARATED, SYMBOLS, SHOUTS = 3, 5, 3

# Patterns that Python and RE2 read alike.
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"[|>»•·]"
SYMBOL_RUN = r"[#*$%&|<>]{2,}"
SHOUT = r"!!"
# Marks that end a sentence before white space, by script; those that need no space after them; and
# letters of scripts that end sentences by a space alone.
_ENDS = (
    ".!?…‼⁇⁈⁉"  # Latin, Greek, Cyrillic, Hebrew, Georgian, Hangul
    "\u037e"  # the Greek question mark
    "։՜՞"  # Armenian
    "؟۔؞܀܁܂߹"  # Arabic, Syriac, N'Ko
    "।॥෴᱾᱿"  # Devanagari and its neighbours, Sinhala, Ol Chiki
    "།༎။។៕᭞᭟"  # Tibetan, Myanmar, Khmer, Balinese
    "።፧፨᠃᠉᙮꓿꘎꘏"  # Ethiopic, Mongolian, Canadian syllabics, Lisu, Vai
)
_WIDE_ENDS = "。！？｡．︒﹒﹖﹗"
_CLOSERS = "\"'”’»›)」』】）〉》"
SENTENCE_END = rf"[{_ENDS}][{_CLOSERS}\]]*([ \t\x0b\x0c\r]|$)|[{_WIDE_ENDS}]|[ก-ฮກ-ຮ]"
# Phrases of notices and page furniture, by language.
BOILERPLATE = "(?i)" + "|".join((
    r"all rights reserved|licen[sc]ed under|terms of (use|service)|privacy policy|cookie|javascript",
    r"lorem ipsum|subscribe|sign up|log in|copyright|©",
    r"alle rechte vorbehalten|datenschutzerkl|nutzungsbedingungen|newsletter abonnieren",
    r"tous droits réservés|politique de confidentialité|conditions (générales )?d['’]utilisation|mentions légales",
    r"todos los derechos reservados|política de privacidad|términos (y condiciones|de uso)|aviso legal",
    r"todos os direitos reservados|política de cookies|termos de uso|tutti i diritti riservati|informativa sulla privacy",
    r"все права защищены|политика конфиденциальности|版权所有|隐私政策|無断転載|利用規約",
))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_lost")
_symbol, _separator, _run, _shout, _end, _boilerplate = map(re.compile, (SYMBOL, SEPARATOR, SYMBOL_RUN, SHOUT, SENTENCE_END, BOILERPLATE))


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8: splitting bytes splits at the six ASCII spaces only."""
    return text.encode().split()


def line_fails(line: str, n_words: int) -> bool:
    separators = len(_separator.findall(line))
    return bool(
        (separators >= 2 and separators * SEPARATED >= n_words)
        or not _end.search(line)
        or len(_run.findall(line)) * SYMBOLS >= n_words
        or len(_shout.findall(line)) * SHOUTS >= n_words
        or _boilerplate.search(line)
    )


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window which the text holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = reach = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + WINDOW - max(at, reach)
            reach = at + WINDOW
    return covered


def screened(text: str | None) -> tuple:
    """COUNTS, whether the base rules fail, whether the document is kept, and its text without failing lines."""
    if text is None:
        return (0,) * len(COUNTS) + (True, False, None)
    words = words_of(text)
    kept_lines, seen, lost, repeats = [], set(), 0, 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            repeats += line in seen
            seen.add(line)
            if line_fails(line, n):
                lost += n
                continue
        kept_lines.append(line)
    chars = sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words))
    repeated = repeated_words(words)
    base_failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    kept = not base_failed and lost <= MOST_LOST * len(words)
    return len(words), chars, len(_symbol.findall(text)), repeats, repeated, lost, base_failed, kept, "\n".join(kept_lines)


def screen(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, and the cleaned text of every document."""
    added = [T.StructField(c, T.LongType()) for c in COUNTS]
    added += [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")] + [T.StructField("cleaned", T.StringType())]
    screened_all = lambda texts: list(zip(*map(screened, texts), strict=True))
    return per_batch(docs.select("doc_id", "text"), ["text"], added, lambda: screened_all).drop("text")


def op3_line_rules(spark: SparkSession, directory: str) -> DataFrame:
    return screen(read(spark, directory, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP3_SQL = f"""
WITH lines AS (
    SELECT doc_id, line, len(regexp_extract_all(line, {_sql(WORD)})) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
), judged AS (
    SELECT *, len(regexp_extract_all(line, {_sql(SEPARATOR)})) AS separators,
           NOT regexp_matches(line, {_sql(SENTENCE_END)})
           OR len(regexp_extract_all(line, {_sql(SYMBOL_RUN)})) * {SYMBOLS} >= n
           OR len(regexp_extract_all(line, {_sql(SHOUT)})) * {SHOUTS} >= n
           OR regexp_matches(line, {_sql(BOILERPLATE)}) AS fails
    FROM lines WHERE n > 0
), by_lines AS (
    SELECT doc_id, sum(n) FILTER (fails OR separators >= 2 AND separators * {SEPARATED} >= n) AS lost,
           count(*) - count(DISTINCT line) AS dups
    FROM judged GROUP BY doc_id
), listed AS (
    SELECT doc_id, regexp_extract_all(text, {_sql(WORD)}) AS words FROM documents
), placed AS (
    SELECT doc_id, unnest(range(1, len(words) - {WINDOW} + 2)) AS pos, words FROM listed WHERE len(words) >= {WINDOW}
), windows AS (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words[pos : pos + {WINDOW} - 1]) AS found FROM placed
), repeated AS (
    SELECT doc_id, count(DISTINCT pos + step) AS repeats
    FROM windows, range({WINDOW}) steps(step) WHERE found > 1 GROUP BY doc_id
), counted AS (
    SELECT doc_id, coalesce(len(words), 0) AS n_words,
           coalesce(length(array_to_string(words, '')), 0) AS word_chars,
           coalesce(len(regexp_extract_all(text, {_sql(SYMBOL)})), 0) AS n_symbols,
           coalesce(dups, 0) AS n_dup_lines, coalesce(repeats, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS words_lost
    FROM documents JOIN listed USING (doc_id) LEFT JOIN by_lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
       AND words_lost <= {MOST_LOST}::DOUBLE * n_words AS kept
FROM counted
"""
