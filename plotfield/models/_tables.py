"""Small result tables. A number that does not exist is missing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from plotfield.sources.tables import literal_table


def _plain(x: Any) -> Any:
    if isinstance(x, (float, np.floating)):
        return None if np.isnan(x) else float(x)
    if isinstance(x, np.integer):
        return int(x)
    return x


def table(spark: SparkSession, rows: Iterable[Sequence[Any]], schema: str) -> DataFrame:
    return literal_table(spark, [tuple(_plain(x) for x in r) for r in rows], schema)
