"""All named queries."""

from palaver.catalog import columns, joins, lifecycle, mapping, profiles, quality  # noqa: F401
from palaver.catalog.base import CATALOG, Source

__all__ = ["CATALOG", "Source"]
