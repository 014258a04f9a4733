"""Folders for tables that the engine writes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from vectide.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
