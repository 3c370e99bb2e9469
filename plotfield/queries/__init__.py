from plotfield.queries import (  # noqa: F401  (importing registers the queries)
    histories, recodes, relations, statistics, summaries,
)
from plotfield.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
