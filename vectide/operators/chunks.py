"""Chunks of texts for retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def fixed(df: DataFrame, doc_id: str, text: str, size: int, overlap: int) -> DataFrame:
    """(doc_id, chunk, piece): windows of equal stride, in the JVM. Null and empty texts have none."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step) - 1)
    rows = df.where(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("chunk"))
    return rows.select("doc_id", "chunk", F.substring("t", (F.col("chunk") * step + 1).cast("int"), F.lit(size)).alias("piece"))


def split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters: cut at the strongest separator that leaves parts small enough, joined again
    up to the size, each piece beginning with whole parts of at most `overlap` characters of the one before."""
    head = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(head) + 1 :]
    parts = [text[i : i + 1] for i in range(len(text))] if head == "" else [p + head for p in text.split(head)[:-1]] + [text.split(head)[-1]]
    small: list[str] = []
    for p in parts:
        small += [p] if len(p) <= size else split(p, size, 0, rest or ("",))
    out: list[str] = []
    held: list[str] = []
    length = 0
    for p in small:
        if held and length + len(p) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if held and "".join(held).strip():
        out.append("".join(held))
    return [s for s in (o.strip() for o in out) if s]


def recursive(df: DataFrame, doc_id: str, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk, piece): map-only, one text at a time."""
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("chunk", T.IntegerType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, piece = [], [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                own = split(t, size, overlap) if t else []
                at += [i] * len(own)
                number += range(len(own))
                piece += own
            yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(piece, pa.string())], names=schema.names)

    return df.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(run, schema)


def page(text: Column) -> Column:
    found = F.regexp_extract(text, r"\[Page ([0-9]+)\]", 1)
    return F.when(found != "", found).otherwise("unknown")


def section(text: Column) -> Column:
    """The first of the first three lines that is an upper-case heading or numbered, else ''."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 3), lambda x: F.btrim(x, F.lit(" \t\r")))
    upper = lambda x: x.rlike("^[ -~]*[A-Z][ -~]*$") & ~x.rlike("[a-z]") & F.length(x).between(4, 79)
    heads = F.filter(lines, lambda x: upper(x) | x.rlike(r"^[0-9][^.]{0,8}\."))
    return F.coalesce(F.try_element_at(heads, F.lit(1)), F.lit(""))
