"""All registered core queries with their SQL. The modules that register them don't import this one: Spark's workers
import the module of a kernel first, whichever it is."""

from quire import model_queries, source_queries  # noqa: F401  they register their own
from quire.core_queries import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES", "query", "table"]
