"""Word splitting for keyword search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectide.functions.text import ascii_lower

# The stop words of keyword search.
SEARCH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "this", "but", "they", "have", "had",
    "what", "when", "where", "who", "which", "why", "how", "or",
)


def tokens(text: Column, stop_words: tuple[str, ...] = SEARCH_STOP_WORDS) -> Column:
    """Runs of ASCII letters and digits in lower case, without stop words, in order. Null gives null."""
    words = F.split(ascii_lower(text), "[^a-z0-9]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words))


def preprocess(text: Column, lower: bool = True, punctuation: bool = True, max_length: int | None = None, truncate: str = "end", pad: str | None = None) -> Column:
    """Lower case, no ASCII punctuation, single blanks, no blanks at the ends, and at most max_length characters, cut
    at the start, at the end or in the middle; with `pad`, shorter ones are filled up to max_length at the end."""
    out = F.lower(text) if lower else text
    if punctuation:
        out = F.regexp_replace(out, r"[!-/:-@\[-`{-~]", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    if max_length is None:
        return out
    size = F.length(out)
    head = max_length - max_length // 2
    short = {
        "end": F.substring(out, 1, max_length),
        "start": F.right(out, F.lit(max_length)),
        "middle": F.concat(F.substring(out, 1, head), F.right(out, F.lit(max_length // 2))),
    }[truncate]
    out = F.when(size <= max_length, out).otherwise(short)
    return F.rpad(out, max_length, pad) if pad else out
