"""Named queries over the driver's tables. Each has the SQL that another engine must agree with, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread

TEXTS = {"documents": "doc_id", "pages": "page_id"}  # tables that cost much work for each row, and their keys
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, raw: bool = False):
    """Register a function of (spark, tables) under its name; tables(x) reads table x. A small table of texts is spread
    over the cores, unless raw is set."""

    def add(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(t: str) -> DataFrame:
                df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
                return spread(df, TEXTS[t]) if t in TEXTS and not raw else df

            table.place = sf_dir
            return f(spark, table)

        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return add


def load() -> tuple[dict, dict]:
    from . import details, relations, retrieval, structure  # noqa: F401  they register their queries

    return QUERIES, ORACLES
