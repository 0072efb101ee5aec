"""Incremental maintenance: an index that follows changing documents, latest wins, unchanged revisions, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the greatest sequence number of each key, in one combining aggregate."""
    fields = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*fields), seq).alias("__row"))
    return best.select(key, *[F.col(f"__row.{c}").alias(c) for c in fields])


def changed(rows: DataFrame, key: str, order: str, revision: Column) -> DataFrame:
    """Rows whose revision differs from the one before it of the same key."""
    before = F.lag("__rev").over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__rev", revision).withColumn("__old", before).where(F.col("__old").isNull() | (F.col("__rev") != F.col("__old"))).drop("__rev", "__old")


def newer(batch: DataFrame, table: DataFrame, key: str, seq: str) -> DataFrame:
    """Of a batch, what is newer than the table."""
    known = table.select(F.col(key).alias("__key"), F.col(seq).alias("__seq"))
    return latest(batch, key, seq).join(known, (F.col(key) == F.col("__key")) & (F.col(seq) <= F.col("__seq")), "left_anti")


COMPACT = 8  # batches after which the table is written anew


class Upserts:
    """A keyed table kept by a stream. Each batch writes its own rows under its number, so a batch that is tried again
    leaves the same state, and late rows with an old sequence number change nothing. Every COMPACT batches the whole
    table is written, and what two earlier such versions made unnecessary is removed."""

    def __init__(self, spark: SparkSession, path: str, key: str, seq: str, deleted: str | None = None):
        self.spark, self.path, self.key, self.seq, self.deleted = spark, path, key, seq, deleted

    def _store(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _written(self) -> dict[str, list[int]]:
        """Numbers of the finished whole versions (v) and batches (d)."""
        p, fs = self._store()
        out: dict[str, list[int]] = {"v": [], "d": []}
        for s in fs.listStatus(p) if fs.exists(p) else ():
            name = s.getPath().getName()
            if name[:1] in out and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                out[name[0]].append(int(name[1:]))
        return out

    def table(self, upto: int | None = None) -> DataFrame | None:
        """The state after all batches, or those up to a number: the latest whole version and the batches since."""
        there = self._written()
        fits = lambda n: upto is None or n <= upto
        base = max(filter(fits, there["v"]), default=-1)
        parts = [f"{self.path}/v{base}"] * (base >= 0) + [f"{self.path}/d{n}" for n in sorted(there["d"]) if n > base and fits(n)]
        return latest(self.spark.read.parquet(*parts), self.key, self.seq) if parts else None

    def apply(self, batch: DataFrame, number: int) -> None:
        latest(batch, self.key, self.seq).write.mode("overwrite").parquet(f"{self.path}/d{number}")
        if number % COMPACT == COMPACT - 1:
            p, fs = self._store()
            whole = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{number}")
            fs.delete(whole, True)  # of an earlier try
            self.table(number).write.parquet(f"{self.path}/v{number}")
            for kind, numbers in self._written().items():
                for n in numbers:
                    if n <= number - 2 * COMPACT:
                        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}{n}"), True)

    def current(self) -> DataFrame | None:
        """The rows that are not deleted."""
        out = self.table()
        return out.where(~F.coalesce(F.col(self.deleted), F.lit(False))) if out is not None and self.deleted else out

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outdated(files: DataFrame, index: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """What an index must do about each file (key, fingerprint): keep, rebuild or add it, or drop what is gone. The
    index's rows say under which fingerprint a file was indexed; one that changed is built anew from its first block."""
    a = files.select(key, F.col(fingerprint).alias("__now"))
    b = index.groupBy(key).agg(F.max(fingerprint).alias("__then"), F.min(fingerprint).alias("__other"))
    same = (F.col("__now") == F.col("__then")) & (F.col("__then") == F.col("__other"))
    act = F.when(F.col("__now").isNull(), "drop").when(F.col("__then").isNull(), "add").when(same, "keep").otherwise("rebuild")
    return a.join(b, key, "full").select(key, act.alias("action"))


def memoised(requests: DataFrame, memo: DataFrame | None, judge, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Judgments of requests and the memo that holds them too. judge(rows) adds a column `judgment`; it sees each
    distinct request (keys) once, and none that the memo answers."""
    asked = requests.select(*keys).distinct()
    new = asked if memo is None else asked.join(memo, list(keys), "left_anti")
    found = judge(new).select(*keys, "judgment")
    known = found if memo is None else memo.select(*keys, "judgment").unionByName(found)
    return requests.join(known, list(keys), "left"), known


def term_counts(changes: DataFrame) -> DataFrame:
    """Signed counts (term, df) of documents that come (sign 1) and go (-1): sums of them are the index's statistics."""
    return changes.groupBy("term").agg(F.sum("sign").alias("df"))


def tumbling(events: DataFrame, time: str, width: str, late: str | None = None, *keys: str) -> DataFrame:
    """Counts by event-time window; on a stream, `late` is the watermark."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__t", late) if late else rows
    out = rows.groupBy(F.window("__t", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Sessions of a key that end with a gap."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    out = rows.groupBy(F.session_window("__t", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def fresh(table: DataFrame, read_at: str, now: Column, recheck: str = "10 minutes", expire: str = "15 minutes") -> DataFrame:
    """State with `stale` (to be read again) for rows older than `recheck`; rows older than `expire` are gone."""
    age = F.col(read_at)
    kept = table.where(age > now - F.expr(f"INTERVAL {expire}"))
    return kept.withColumn("stale", age <= now - F.expr(f"INTERVAL {recheck}"))


def moved(handles: DataFrame, registry: DataFrame, tab: str = "tab", doc: str = "doc") -> DataFrame:
    """The tab each result handle (tab, doc) points to now: its own where that still shows the document, else any tab
    that does; none where the document is gone."""
    shown = registry.groupBy(doc).agg(F.min(tab).alias("__least"))
    own = registry.select(F.col(tab).alias("__tab"), F.col(doc).alias("__doc")).distinct()
    met = handles.select(tab, doc).distinct().join(shown, doc)
    met = met.join(own, (F.col(tab) == F.col("__tab")) & (F.col(doc) == F.col("__doc")), "left")
    return met.select(tab, doc, F.coalesce("__tab", "__least").alias("now"))
