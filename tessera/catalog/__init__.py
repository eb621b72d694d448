"""Every operator as a query over the driver's tables, with its DuckDB twin where SQL can express it."""

from tessera.catalog import batch, builds, evaluation, functions, index, more, ranking, sources  # noqa: F401  they register their queries
from tessera.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
