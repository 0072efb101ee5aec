"""Pandas functions as column functions, made when they are called, so that workers can import their modules."""

from __future__ import annotations

import functools

from pyspark.sql.functions import pandas_udf


def vectorised(schema: str):
    def wrap(f):
        @functools.wraps(f)
        def call(*cols):
            return pandas_udf(f, schema)(*cols)

        return call

    return wrap
