"""Importing this module registers every query."""

from . import detection_queries, diagram_queries, many_raster_queries, overlay_queries, raster_queries, table_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
