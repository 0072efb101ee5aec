"""Sinks: guarded CSV, tab-separated files with a checksum, sharded tables, key-value merges, idempotent batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_cell


def csv_lines(df: DataFrame) -> DataFrame:
    """One `line` for each row, all cells quoted and guarded."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in df.columns]).alias("line"))


def csv_head(df: DataFrame) -> str:
    return "﻿" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """Guarded CSV parts with CRLF; the header with its byte order mark is a file of its own, _head."""
    csv_lines(df).write.mode("overwrite").option("lineSep", "\r\n").text(path)
    df.sparkSession.createDataFrame([(csv_head(df),)], "line string").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path + "_head")


def write_tsv(df: DataFrame, path: str) -> str:
    """Compressed tab-separated parts; returns a checksum that does not depend on the order of rows."""
    cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), "[\t\r\n]+", " ") for c in df.columns]
    lines = df.select(F.concat_ws("\t", *cells).alias("value"))
    lines.write.mode("overwrite").option("compression", "gzip").text(path)
    return lines.agg(F.lower(F.hex(F.bit_xor(F.xxhash64("value"))))).first()[0] or ""


def write_sharded(df: DataFrame, path: str, by: list[str], records: int = 5_000_000) -> None:
    """A table partitioned by the first column of `by` and sorted by the others, files of at most `records` rows."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("maxRecordsPerFile", records).option("compression", "zstd").partitionBy(by[0]).parquet(path)


def merged(table: DataFrame, changes: DataFrame, key: str, deleted: str | None = None) -> DataFrame:
    """The table after upserts (the whole row wins) and deletions."""
    kept = table.join(changes.select(key), key, "left_anti")
    new = changes.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else changes
    return kept.unionByName(new.select(kept.columns))


def imported(ours: DataFrame, theirs: DataFrame, key: str, maps: list[str]) -> DataFrame:
    """Both exports in one; of their maps, theirs win entry by entry."""
    from ..operators.resolve import merged_maps

    a, b = ours.alias("a"), theirs.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *[merged_maps(F.col(f"a.{m}"), F.col(f"b.{m}")).alias(m) for m in maps])


def manifest(spark: SparkSession, path: str, **facts) -> None:
    spark.createDataFrame([{k: str(v) for k, v in facts.items()}]).coalesce(1).write.mode("overwrite").json(path)


def packed_groups(sizes: DataFrame, limit: int, name: str = "name", size: str = "size") -> DataFrame:
    """Files put greedily, in order of name, into groups of at most `limit` bytes. The fold is sequential, so it takes
    a listing of files, not rows of data."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        group, held, out = 0, 0, []
        for s in pdf.sort_values(name)[size]:
            if held and held + s > limit:
                group, held = group + 1, 0
            held += s
            out.append(group)
        return pdf.sort_values(name).assign(grp=out)

    return sizes.select(name, size).groupBy().applyInPandas(fold, f"{name} string, {size} long, grp long")


def html_table(df: DataFrame) -> Column:
    """A row of an HTML table."""
    from ..functions.text import escape_html

    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns], F.lit("</tr>"))
