"""Queries over the driver tables, one module per family."""

from . import books, camera, catalogs, dedup, files, people, scans, search, streams, transcripts, visits  # noqa: F401
from .catalog import CATALOG

__all__ = ["CATALOG"]
