"""Features of notes: computed once per distinct text and mapped back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import constants as K
from emberline.functions.scalar import keyword_flag, signed_sentiment

# Small default lexicon; callers pass their own for another domain or language.
POSITIVE_WORDS = ("healthy", "strong", "regular", "satisfactory", "upward", "improved", "timely", "growth")
NEGATIVE_WORDS = ("delay", "delayed", "dispute", "stoppage", "closure", "penalty", "default", "loss")


def text_key(text: Column) -> Column:
    """256-bit digest: joins carry it instead of the whole text."""
    return F.sha2(text, 256)


def map_back(notes: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run `compute` on (text_key, text) of the distinct texts, and join its columns to every note.

    The joined-back side holds one row per distinct text; a text shared by very many notes makes a
    large partition on the notes' side only, which adaptive execution splits.
    """
    keyed = notes.withColumn("text_key", text_key(F.col(text)))
    distinct = keyed.select("text_key", F.col(text).alias("text")).dropDuplicates(["text_key"])
    computed = compute(distinct).drop("text")
    return keyed.join(computed, "text_key", "left").drop("text_key", text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def lexicon_sentiment(
    text: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> Column:
    """(sentiment_label, sentiment_score): sign and strength of the word balance."""
    tokens = words(text)
    up = F.size(F.filter(tokens, lambda t: t.isin(*positive)))
    down = F.size(F.filter(tokens, lambda t: t.isin(*negative)))
    label = F.when(up > down, "positive").when(up < down, "negative").otherwise("neutral")
    score = F.when(up + down > 0, F.abs(up - down) / (up + down)).otherwise(F.lit(0.0))
    return F.struct(label.alias("sentiment_label"), score.alias("sentiment_score"))


def flag_and_sentiment(
    distinct: DataFrame,
    pattern: str = K.DISTRESS_PATTERN,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> DataFrame:
    scored = distinct.withColumn("_s", lexicon_sentiment(F.col("text"), positive, negative))
    return scored.select(
        *distinct.columns,
        "_s.sentiment_label",
        "_s.sentiment_score",
        signed_sentiment(F.col("_s.sentiment_label"), F.col("_s.sentiment_score")).alias("sentiment_signed"),
        keyword_flag(F.col("text"), pattern).alias("distress_keyword_flag"),
    )


def text_pca(vectors: DataFrame, column: str, k: int = K.TEXT_COMPONENTS) -> DataFrame:
    """Add text_pc_1..k: centred principal components of an array<float> column.

    The covariance is d × d, whatever the number of rows; the sign of a component is arbitrary.
    """
    dimension = len(vectors.select(column).where(F.col(column).isNotNull()).first()[0])
    rows = vectors.where(F.col(column).isNotNull()).count()
    k = max(1, min(k, rows - 1, dimension))
    with_vector = vectors.where(F.col(column).isNotNull()).withColumn(
        "_v", array_to_vector(F.col(column).cast("array<double>"))
    )
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(with_vector)
    centred = scaler.transform(with_vector)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    projected = model.transform(centred).withColumn("_p", vector_to_array("_p"))
    return projected.select(*vectors.columns, *[F.col("_p")[i].alias(f"text_pc_{i + 1}") for i in range(k)])


def text_features(
    notes: DataFrame,
    key: str,
    text: str,
    vectors: DataFrame,
    vector: str = "embedding",
    components: int = K.TEXT_COMPONENTS,
    pattern: str = K.DISTRESS_PATTERN,
) -> DataFrame:
    """Components, sentiment and keyword flag per note.

    `vectors` is (text_key, <vector>): whichever embedding the caller has of the distinct texts.
    """

    def compute(distinct: DataFrame) -> DataFrame:
        flagged = flag_and_sentiment(distinct, pattern)
        reduced = text_pca(vectors, vector, components).drop(vector)
        return flagged.join(reduced, "text_key", "left")

    return map_back(notes.select(key, text), text, compute)


def note_tone_shares(notes: DataFrame, tone: str) -> DataFrame:
    counts = notes.groupBy(tone).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.select(tone, "n", (F.col("n") / total).alias("share"))
