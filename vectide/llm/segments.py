"""Cutting oversized texts at topic boundaries found by lexical cohesion.

A text is a row of sentences. The similarity of the blocks of sentences before and after each gap, as bags of words
(of four letters or more; character pairs in scripts without spaces), falls where the topic changes; a gap's depth is how far it lies below the similarity peaks on both sides. Each piece
takes up to `max_size` characters, the first `overlap` of them repeating the end of the piece before. Of the gaps in
the second half of what fits, the deepest becomes the cut (the last, if none lies in a valley); without a gap there, the last gap in the first half, then
the last white space that fits, and only in a stretch without any of these a hard cut at the limit.

Sizes are characters as stored. Defined cases: null and empty texts have no pieces; a text within the limit is one
piece; white space counts like other characters, so the pieces without their overlaps are exactly the text; pieces
depend on the text alone, so equal texts are cut alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = re.compile(r"(?:[.!?…][\"')\]»”]*\s+)|(?:[。！？]+\s*)|(?:\n\s*)")
BREAK = re.compile(r"[\s。！？]+")
WORD = re.compile(r"(?=([぀-ヿ㐀-鿿]{2}))|([^\W\d_぀-ヿ㐀-鿿]{4,})")
BLOCK = 3
CHUNK = 1000


def gaps_and_depths(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions after each sentence, and how deep the cohesion's valley is there. Memory: CHUNK gaps at a time."""
    at = np.fromiter((m.end() for m in GAP.finditer(text) if 0 < m.end() < len(text)), np.int64)
    if len(at) < 2:
        return at, np.zeros(len(at))
    alike = np.concatenate([likeness(text, at, g, min(g + CHUNK, len(at))) for g in range(0, len(at), CHUNK)])
    near = 2 * BLOCK
    padded = np.concatenate([np.full(near, -1.0), alike, np.full(near, -1.0)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, near + 1)
    before, after = windows[: len(alike)].max(axis=1), windows[near:].max(axis=1)
    return at, before + after - 2 * alike


def likeness(text: str, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Cosine of the bags of words of the BLOCK sentences before and after the gaps first to last - 1; gap g lies
    between the sentences g and g + 1."""
    lo, hi = max(first - BLOCK + 1, 0), min(last - 1 + BLOCK, len(at))
    span = (0 if lo == 0 else int(at[lo - 1]), int(at[hi]) if hi < len(at) else len(text))
    numbers: dict[str, int] = {}
    words = [(m.start(), numbers.setdefault(m[1] or m[2], len(numbers))) for m in WORD.finditer(text[span[0] : span[1]].lower())]
    if not words:
        return np.zeros(last - first)
    where, slot = np.array(words, np.int64).T
    sentence = np.searchsorted(at[lo:hi], where + span[0], side="right")
    n, width = hi - lo + 1, len(numbers)
    bags = np.bincount(sentence * width + slot, minlength=n * width).reshape(n, width).astype(np.float32)
    total = np.concatenate([np.zeros((1, width), np.float32), np.cumsum(bags, axis=0)])
    gap = np.arange(first, last) - lo + 1
    left = total[gap] - total[np.maximum(gap - BLOCK, 0)]
    right = total[np.minimum(gap + BLOCK, n)] - total[gap]
    norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
    return np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0)


def cuts(text: str, max_size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of each piece."""
    n = len(text)
    if n <= max_size:
        return [(0, n, "end")] if n else []
    at, depth = gaps_and_depths(text)
    spaces = np.fromiter((m.end() for m in BREAK.finditer(text)), np.int64)
    out, cut = [], 0
    while True:
        start = max(cut - overlap, 0)
        most = start + max_size
        if n <= most:
            out.append((start, n, "end"))
            return out
        lo, mid, hi = np.searchsorted(at, [cut, cut + (most - cut) // 2, most], side="right")
        if hi > mid and depth[mid:hi].max() > 0:
            end, kind = int(at[mid + np.argmax(depth[mid:hi])]), "topic"
        elif hi > mid:
            end, kind = int(at[hi - 1]), "sentence"
        elif mid > lo:
            end, kind = int(at[mid - 1]), "sentence"
        elif (s := np.searchsorted(spaces, most, side="right")) and spaces[s - 1] > cut:
            end, kind = int(spaces[s - 1]), "space"
        else:
            end, kind = most, "hard"
        out.append((start, end, kind))
        cut = end


def longest_unbroken(text: str) -> int:
    """Length of the longest stretch without white space and without 。！？."""
    return max(map(len, BREAK.split(text)))


def pieces(df: DataFrame, id_column: str, text_column: str, max_size: int, overlap: int, with_text: bool = False) -> DataFrame:
    """(doc_id, piece, n_pieces, start, end, boundary, length, unbroken[, piece_text]): map-only, one text at a time.

    start and end are offsets in characters; unbroken is the text's longest stretch without a natural boundary.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and less than max_size")
    fields = [("piece", T.IntegerType()), ("n_pieces", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("boundary", T.StringType()), ("length", T.IntegerType()), ("unbroken", T.IntegerType())]
    schema = T.StructType([T.StructField("doc_id", df.schema[id_column].dataType), *[T.StructField(*f) for f in fields], *[T.StructField("piece_text", T.StringType())] * with_text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows = [], []
            for i in range(batch.num_rows):
                text = batch.column("t")[i].as_py()
                if text:
                    spans, unbroken = cuts(text, max_size, overlap), longest_unbroken(text)
                    source += [i] * len(spans)
                    rows += [(k, len(spans), a, b, kind, len(text), unbroken, *([text[a:b]] * with_text)) for k, (a, b, kind) in enumerate(spans)]
                    if with_text and len(rows) > 2000:
                        yield emit(batch, source, rows)
                        source, rows = [], []
            if rows:
                yield emit(batch, source, rows)

    def emit(batch: pa.RecordBatch, source: list[int], rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(source)), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=schema.names)

    return df.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInArrow(run, schema)
