"""vectide: vector retrieval, keyword search and query-log analytics on Spark."""

from vectide.session import durable, session

__all__ = ["durable", "session"]
