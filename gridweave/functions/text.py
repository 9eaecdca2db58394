"""Text expressions. All are Catalyst expressions, so they run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from gridweave.schemas import EOS, NULL_WORD, PAD, SEPARATOR, SEQUENCE_LENGTH

# White space that ends a word, marks stripped from both ends of a
# word, and punctuation that becomes a word of its own. White space of one byte's width is listed
# by character and the rest lies in one range, so that most characters take two tests.
WHITESPACE = (
    r"[ \x{9}\x{A}\x{B}\x{C}\x{D}\x{1C}\x{1D}\x{1E}\x{1F}\x{85}\x{A0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]+"
)
STRIPPED = "\"\\'"
TRAILING = [",", ".", "!", "?", ")", ":", ";"]
MOST = (1 << 31) - 1  # characters of a string
CURLY_QUOTES = "‘’“”"


def tokenize(text: Column, straighten_quotes: bool = False) -> Column:
    """`text` as an array of words.

    Separators and escaped quotes count as blanks. A word loses one opening
    bracket, which becomes a word, then its quotes and backslashes at both ends,
    then one trailing punctuation mark, which becomes a word. A word with nothing
    left, and a null text, give `-`.
    """
    blanked = F.replace(F.replace(text, F.lit(SEPARATOR), F.lit(" ")), F.lit('\\"'), F.lit(" "))
    if straighten_quotes:
        blanked = F.translate(blanked, CURLY_QUOTES, "'" * len(CURLY_QUOTES))
    pieces = F.filter(F.split(blanked, WHITESPACE), lambda piece: piece != "")
    # Two steps, so that the trimmed body is computed once per piece.
    peeled = F.transform(
        pieces,
        lambda piece: F.struct(
            piece.startswith("(").alias("bracket"),
            F.btrim(
                F.when(piece.startswith("("), F.substring(piece, 2, MOST)).otherwise(piece), F.lit(STRIPPED)
            ).alias("body"),
        ),
    )
    return F.when(text.isNull(), F.array(F.lit(NULL_WORD))).otherwise(
        F.flatten(F.transform(peeled, _words))
    )


def _words(piece: Column) -> Column:
    body = piece["body"]
    # Tests of the last bytes; characters are only counted in words that end in a mark.
    marked = reduce(Column.__or__, (body.endswith(mark) for mark in TRAILING)) & ~body.isin(TRAILING)
    words = (
        F.when(body == "", F.array(F.lit(NULL_WORD)))
        .when(marked, F.array(F.left(body, F.length(body) - 1), F.right(body, F.lit(1))))
        .otherwise(F.array(body))
    )
    return F.when(piece["bracket"], F.concat(F.array(F.lit("(")), words)).otherwise(words)


def split_sentences(text: Column) -> Column:
    """The parts of `text` between separators, as an array."""
    return F.split(text, r"\[SEP\]")


def pad_or_truncate(ids: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """Exactly `length` ids: cut without an end mark, or end mark and padding added."""
    filler = F.array_repeat(F.lit(PAD), F.greatest(F.lit(length) - F.size(ids) - 1, F.lit(0)))
    return F.when(F.size(ids) >= length, F.slice(ids, 1, length)).otherwise(
        F.concat(ids, F.array(F.lit(EOS)), filler)
    )


def pad_mask(ids: Column) -> Column:
    """True where a position holds a token, false where it is padding."""
    return F.transform(ids, lambda token: token != PAD)
