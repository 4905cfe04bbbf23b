"""The registered queries of the core, and the same in SQL where SQL can express them."""

from veldspar.catalog import documents, events, gaussians, search, senses  # noqa: F401
from veldspar.catalog.registry import QUERIES, SQL

FLAGSHIP = "hybrid_retrieve"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
