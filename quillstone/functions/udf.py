"""Arrow UDFs that can be declared before there is a session."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def arrow_udf(kind: str):
    """A vectorised function over columns; its type is parsed at the first use, not at import."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns) -> Column:
            return pandas_udf(f, kind)(*columns)

        return call

    return wrap
