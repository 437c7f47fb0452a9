"""Every query of the engine, by name."""

from . import model_queries, relational_queries, scalar_queries, source_queries, streaming_queries, vector_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
