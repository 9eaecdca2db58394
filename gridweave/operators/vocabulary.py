"""Words: counts, dictionary, token ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridweave.functions.text import pad_or_truncate, split_sentences, tokenize
from gridweave.operators.lookup import ranked_lookup
from gridweave.operators.numbering import dense_index
from gridweave.schemas import (
    FIRST_WORD_ID,
    MIN_WORD_COUNT,
    NULL_WORD,
    SEQUENCE_LENGTH,
    SPECIAL_WORDS,
    UNK,
)
from gridweave.session import materialize

# The most frequent words, sent to every task: at most this many, of at most this length.
HEAD_WORDS = 100_000
HEAD_WORD_LENGTH = 64


def word_counts(corpus: DataFrame, times: str | None = None) -> DataFrame:
    """(word, cnt) over the whole `text` column; counted in part before the shuffle.

    With `times` a text counts as often as that column says, so that a corpus which repeats few
    texts is tokenized once for each of them, see `distinct_texts`.
    """
    words = corpus.select(F.explode(tokenize(F.col("text"))).alias("word"), *([times] if times else []))
    return words.groupBy("word").agg((F.sum(times) if times else F.count("*")).alias("cnt"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(text, cnt): each text of `rows` and how many rows have it; no text counts as NULL_WORD, as it
    has the same words."""
    return rows.groupBy(F.coalesce("text", F.lit(NULL_WORD)).alias("text")).agg(F.count("*").alias("cnt"))


def dictionary_size(counts: DataFrame) -> DataFrame:
    """The number of distinct words, as the one-row column `num_words`."""
    return counts.agg(F.count("word").alias("num_words"))


def number_words(counts: DataFrame) -> DataFrame:
    """Dictionary (word, cnt, word_id) of counted words.

    The special words come first, with count 0, and keep their ids also where the corpus
    has them;
    the other words follow by falling count, then by word.
    """
    ordinary = counts.where(~F.col("word").isin(SPECIAL_WORDS)).select("word", "cnt")
    numbered = dense_index(
        ordinary, [F.col("cnt").desc(), F.col("word")], "word_id", FIRST_WORD_ID
    )
    specials = counts.sparkSession.createDataFrame(
        [(word, 0, i) for i, word in enumerate(SPECIAL_WORDS)],
        "word string, cnt long, word_id long",
    )
    return specials.unionByName(numbered.select("word", "cnt", "word_id"))


def build_dictionary(counts: DataFrame, more_than: int = MIN_WORD_COUNT) -> DataFrame:
    return number_words(counts.where(F.col("cnt") > more_than))


def tokens_to_ids(
    rows: DataFrame, keys: list[str], tokens: Column, dictionary: DataFrame
) -> DataFrame:
    """(*keys, ids array<int>): the id of each word of `tokens`, UNK for unknown words.

    `keys` identify a row. The frequent words are found in the broadcast head of the
    dictionary, the rare ones by a shuffle join, so no single word forms a hot group. The words
    are stored first, so `tokens` is worked out once.
    """
    split = materialize(rows.select(*keys, tokens.alias("_words")), "words")  # read twice by the look-up
    flat = split.select(*keys, F.posexplode_outer("_words").alias("_place", "word"))
    found = ranked_lookup(
        flat,
        dictionary.select("word", "word_id"),
        "word",
        (F.col("word_id") < HEAD_WORDS) & (F.length("word") <= HEAD_WORD_LENGTH),
        twice=True,
    )
    entry = F.struct("_place", F.coalesce("word_id", F.lit(UNK)).cast("int").alias("id"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_place").isNotNull(), entry)))
    return found.groupBy(*keys).agg(listed.alias("_entries")).select(
        *keys, F.col("_entries.id").alias("ids")
    )


def token_sequences(
    rows: DataFrame,
    keys: list[str],
    text: Column,
    dictionary: DataFrame,
    length: int = SEQUENCE_LENGTH,
) -> DataFrame:
    """(*keys, ids): fixed-length id sequences of `text`.

    A sequence keeps `length` words at most, so further words are not looked up.
    """
    found = tokens_to_ids(rows, keys, F.slice(tokenize(text), 1, length), dictionary)
    return found.withColumn("ids", pad_or_truncate(F.col("ids"), length))


def skipgram_sentences(corpus: DataFrame, keys: list[str] = []) -> DataFrame:
    """(*keys, sentence, words): the sentences of `text` with more than one word."""
    sentences = corpus.select(*keys, F.posexplode(split_sentences(F.col("text"))))
    return (
        sentences.select(*keys, F.col("pos").alias("sentence"), tokenize(F.col("col")).alias("words"))
        .where(F.size("words") > 1)
    )


def sentence_count(sentences: DataFrame) -> DataFrame:
    """The number of skip-gram sentences, as the one-row column `num_sentences`."""
    return sentences.agg(F.count("*").alias("num_sentences"))
