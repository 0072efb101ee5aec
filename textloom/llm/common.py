"""Shared pieces: the scratch folder, written intermediate tables, connected components, streamed groups."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BITS = 1 << 28  # of a broadcast map of keys, 32 MB; LEAST_BITS for the smallest
LEAST_BITS = 1 << 20
BATCH_BYTES = 8 << 20  # of rows that go to a Python worker at once: the limit in rows alone lets texts and sets take 100 MB
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed, and take rows in batches of BATCH_BYTES at most:
    executors hold each batch twice outside their heap, and workers keep what their largest batch needed."""
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(most, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def scratch(spark: SparkSession) -> str:
    """This session's folder under spark.checkpoint.dir; a temporary one only where that is unset and the session is
    local, as in tests: the executors of a cluster do not share the driver's folders."""
    made = getattr(spark, "_textloom_scratch", None)
    if made is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        own = not base
        if own and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if own:
            base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        made = f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"
        spark._textloom_scratch = made
        if own:
            atexit.register(shutil.rmtree, made.removeprefix("file://"), ignore_errors=True)
        atexit.register(release, spark)
    return made


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this session. Frames that read them are unusable afterwards."""
    made = getattr(spark, "_textloom_scratch", None)
    if made is None:
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark._textloom_scratch = None
    except Exception:  # the session may be gone at exit
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def most_counted(counts: DataFrame, key: str, n: str, most: int, *more: str) -> list[tuple]:
    """All (key, n, *more) whose n reaches the least threshold that at most `most` keys reach: a bounded list, ties kept together.

    The threshold comes from a histogram of n (values of 1024 and more to three digits in base 2), not from a sort.
    """
    step = F.when(F.col(n) < 1024, F.col(n)).otherwise(F.expr(f"shiftleft(shiftright({n}, int(log2({n})) - 9), int(log2({n})) - 9)"))
    total, least = 0, None
    for level, rows in sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True):
        total += rows
        if total > most:
            break
        least = level
    if least is None:
        return []
    return [tuple(r) for r in counts.where(F.col(n) >= least).select(key, n, *more).collect()]


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it any more, and let Spark clean up old shuffles."""
    spark = df.sparkSession
    spark._jvm.System.gc()
    path = spark._jvm.org.apache.hadoop.fs.Path(df._textloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class BitMap:
    """A broadcast set of long keys that may hold others by chance: about 16 bits for each key, within MOST_BITS."""

    def __init__(self, sent, size: int):
        self.sent, self.size = sent, size

    def holds(self, keys: "np.ndarray") -> "np.ndarray":
        at = keys % self.size
        return ((self.sent.value[at >> 6] >> (at & 63)) & 1).astype(bool)


def bit_map(rows: DataFrame, key) -> BitMap:
    """The map of the keys in a written table. What goes to the driver and out again is at most MOST_BITS // 32 bytes."""
    import numpy as np

    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * rows.count()).bit_length()))
    at = F.pmod(key, F.lit(size))
    words = rows.select(at.alias("b")).groupBy(F.expr("b div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("w")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words["at"].to_numpy()] = words["w"].to_numpy()
    return BitMap(rows.sparkSession.sparkContext.broadcast(bits), size)


def row_key(id_col: str, text: str):
    """A struct of two independent hashes, equal for rows of equal id and text; ids and texts may be null."""
    parts = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`")
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("b"))


def without(df: DataFrame, key, dropped_keys: DataFrame, kept=None) -> DataFrame:
    """df without the rows whose `key` (see row_key) is in dropped_keys (a written table of one such column).

    Rows that a bit map of the dropped keys rules out pass at once; only the others meet the exact keys in a join, so
    texts are not shuffled for the sake of a few of them: the map is sized by the count of dropped keys. kept, where
    given, replaces the anti-join: kept(rows) takes and gives the columns `doc` (a row of df as a struct) and `key`,
    or `doc` alone. df may have columns of any names and null values; an empty df stays empty.
    """
    import numpy as np
    import pyarrow as pa

    name = dropped_keys.columns[0]
    bits = bit_map(dropped_keys, F.col(f"{name}.a"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), key.alias("key"))

    def part(wanted: bool) -> DataFrame:
        def read(batches):
            for batch in batches:
                mask = pa.array(bits.holds(batch.column(1).field(0).to_numpy().astype(np.int64)) == wanted)
                yield batch.filter(mask)

        return rows.mapInArrow(read, rows.schema)

    met = part(True)
    met = met.join(dropped_keys.select(F.col(name).alias("key")), "key", "left_anti") if kept is None else kept(met)
    return part(False).select("doc.*").unionByName(met.select("doc.*"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node that an edge names; component is the least node reachable.

    Alternating large-star and small-star steps on (lo, hi) edges until they no longer change. The least
    neighbour of a node comes from a combining aggregate, and the joins that follow read two written tables, so
    that Spark can split a hub's rows among tasks. Null ends are left out; an empty input gives an empty result.
    """
    cur = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    cur = written(cur, "edges")
    seen = _mark(cur)
    while seen[0]:
        mins = written(cur.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), "mins")
        # Large star: a higher neighbour moves to the least node that its lower end knows.
        large = cur.join(mins, cur.lo == mins.node, "left").select(F.coalesce("m", "lo").alias("lo"), "hi")
        large = written(large.union(mins.select(F.col("m").alias("lo"), F.col("node").alias("hi"))).distinct(), "large")
        mins2 = written(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), "mins")
        # Small star: all lower neighbours of a node move to the least of them.
        small = large.join(mins2, large.hi == mins2.node).select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        small = small.where("lo < hi").union(mins2.select(F.col("m").alias("lo"), F.col("node").alias("hi"))).distinct()
        nxt = written(small, "edges")
        for old in (cur, mins, large, mins2):
            dropped(old)
        cur, last, seen = nxt, seen, _mark(nxt)
        if seen == last:
            break
    leaves = cur.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = cur.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return leaves.union(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi")), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 31)))).first()
    return tuple(row)


def whole_groups(frames, same):
    """Regroup sorted pandas frames so that no group is cut: same(frame) is an integer array that changes between groups."""
    import numpy as np
    import pandas as pd

    rest = None
    for pdf in frames:
        if not len(pdf):
            continue
        cur = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        g = same(cur)
        cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
        if cut:
            yield cur.iloc[:cut].reset_index(drop=True), g[:cut]
        rest = cur.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, same(rest)


def bounds(g):
    """Starts and ends of runs of equal values."""
    import numpy as np

    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return list(zip(at.tolist(), [*at[1:].tolist(), len(g)], strict=True))


class Forest:
    """Union-find over small integers, least member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.up[y] = x
        return True
