"""The queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            # "at" is a keyword of DuckDB
            SQL[f.__name__] = re.sub(r"""(?<![\w"'])at(?![\w"'])""", '"at"', sql)
        return f

    return keep
