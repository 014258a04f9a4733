"""JSON and CSV in and out. Vectors in CSV cells are JSON text."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMPORT_SCHEMA = "id string, values array<float>, metadata map<string,string>, _corrupt_record string"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of {id, values, metadata} per file. Broken records keep their text in _corrupt_record."""
    return spark.read.schema(IMPORT_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns id, values, metadata with a header; cells that don't parse give null values and keep the row."""
    raw = spark.read.schema("id string, values string, metadata string").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return raw.select("id", F.from_json("values", "array<float>").alias("values"), F.from_json("metadata", "map<string,string>").alias("metadata"), F.when(F.from_json("values", "array<float>").isNull(), F.col("values")).alias("_corrupt_record"))


def import_statistics(df: DataFrame) -> DataFrame:
    """One row: total, imported, errors, success_rate in percent."""
    good = F.col("id").isNotNull() & F.col("values").isNotNull() & (F.size("values") > 0)
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.count_if(good).alias("imported"), (n - F.count_if(good)).alias("errors"), F.coalesce(F.round(F.count_if(good) * 100 / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("success_rate"))


def as_cells(df: DataFrame, values: str = "values", metadata: str = "metadata") -> DataFrame:
    """(id, values, metadata) with JSON text in the cells."""
    return df.select("id", F.to_json(values).alias("values"), F.col(metadata).alias("metadata"))


def write_csv(df: DataFrame, path: str) -> None:
    as_cells(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_arrays(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """One JSON array per line of text and file part, of at most `rows` records; null fields are left out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lines = batch.column("r").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(lines[a : a + rows]) + "]" for a in range(0, len(lines), rows)], pa.string())], names=["value"])

    # a file holds one array
    parts = max(1, df.count() // rows + 1)
    df.select(F.to_json(F.struct(*df.columns)).alias("r")).repartition(parts).mapInArrow(run, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def as_docx(text):
    """A minimal word-processor file with a paragraph per line."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _zipped(t))

    return pack(text)


def _zipped(text: str) -> bytes:
    root = ElementTree.Element(f"{{{NAMESPACE}}}document")
    body = ElementTree.SubElement(root, f"{{{NAMESPACE}}}body")
    for line in text.split("\n"):
        run = ElementTree.SubElement(ElementTree.SubElement(body, f"{{{NAMESPACE}}}p"), f"{{{NAMESPACE}}}r")
        ElementTree.SubElement(run, f"{{{NAMESPACE}}}t").text = line
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", ElementTree.tostring(root, "utf-8"))
    return out.getvalue()


def docx_text(content):
    """Paragraphs of word-processor files, one a line; null for what is no such file."""

    def read(data) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return None
        lines = []
        for paragraph in root.iter(f"{{{NAMESPACE}}}p"):
            parts = [e.text or "" if e.tag.endswith("}t") else "\t" if e.tag.endswith("}tab") else "\n" if e.tag.endswith("}br") else "" for e in paragraph.iter()]
            lines.append("".join(parts))
        return "\n".join(lines)

    @F.pandas_udf("string")
    def extract(contents: pd.Series) -> pd.Series:
        return contents.map(read)

    return extract(content)


def plain_text(markup) -> F.col:
    """Text of HTML: no scripts and styles, no tags, single blanks."""
    t = F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, r"[\s\u00a0]+", " "))
