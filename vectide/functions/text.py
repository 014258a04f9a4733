"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the query-log normaliser.
NORMALISER_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "can", "this",
    "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
ASCII_SPACE = r"[ \t\n\x0B\f\r]+"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only, whatever else the text holds."""
    return F.translate(text, UPPER, LOWER)


def normalize_query(text: Column) -> Column:
    """Query text as the log's reports group it: words of the text in lower case, without ASCII punctuation
    and without stop words, joined by one space. Null gives null; a text of stop words gives ''."""
    words = F.split(F.regexp_replace(ascii_lower(text), ASCII_PUNCTUATION, ""), ASCII_SPACE)
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*NORMALISER_STOP_WORDS)), " ")


def trimmed_lower(text: Column) -> Column:
    """Without white space at both ends, in lower case."""
    return F.lower(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")))
