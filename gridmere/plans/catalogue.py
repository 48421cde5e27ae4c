"""All queries of the library, apart from the training-data operators."""

from __future__ import annotations

from . import files, formats, further, more, places, rasters, regional, shapes
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "files", "formats", "further", "more", "places", "rasters", "regional", "shapes"]
