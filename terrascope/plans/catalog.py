"""Every registered query with its check."""

from . import catalog_geo, catalog_sales, catalog_streams, catalog_tables, catalog_text  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
