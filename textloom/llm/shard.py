"""Sharding in Hilbert order: several quantised dimensions, sorted along the curve, cut into even runs.

Shards are runs of the curve, so each covers a compact region in every dimension and its ranges prune files. No task
ranks all rows: rows are counted by curve cell, cells are cut into bins of about equal size by a hash of the key (a
bounded table), running sums give each bin its first rank, and rows are ranked only inside their bin.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 3  # of each dimension, at least
CELLS = 16  # bits of a cell over all dimensions, at most: the counts of 2**CELLS cells go to the driver
CELL_ROWS = 4096  # rows of an average cell beyond which a dimension gets another bit
BINS = 1 << 17  # bins that all rows may be cut into, besides one for each cell
LEAST_BIN = 1000  # rows below which a cell is not cut


def bits_for(rows: int, dimensions: int) -> int:
    """Bits of each dimension, so that an average cell has CELL_ROWS rows, within BITS and CELLS."""
    bits = BITS
    while (bits + 1) * dimensions <= CELLS and rows >> bits * dimensions > CELL_ROWS:
        bits += 1
    return bits


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points (rows of coordinates under 2**bits), by Skilling's transform."""
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for d in range(dims):
            high = (x[:, d] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & (q - 1))
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        flip ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
    x ^= flip[:, None]
    index = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << 1 | x[:, d] >> level & 1
    return index



def listed_dimension(col: Column, known: list, bits: int) -> Column:
    """A category's cell by its place in `known`, most frequent first: equality on it prunes, and only values beyond
    2**bits - 1 share the last cell. Null has cell 0."""
    last = (1 << bits) - 1
    cells = [x for i, v in enumerate(known[: last - 1]) for x in (F.lit(v), F.lit(i + 1))]
    found = F.element_at(F.create_map(*cells), col) if cells else F.lit(None).cast("int")
    return F.when(col.isNull(), 0).otherwise(F.coalesce(found, F.lit(last))).cast("int")


def scaled_dimension(col: Column, low, high, bits: int) -> Column:
    """A number's cell on the way from the least to the greatest value; null has cell 0."""
    if low is None or high == low:
        return F.lit(0)
    share = (col.cast("double") - float(low)) / (float(high) - float(low))
    return F.coalesce(F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor(share * (1 << bits)))), F.lit(0)).cast("int")


def shards(rows: Column, dimensions: list[Column], key: Column, count: int, df: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows (row, curve, shard, slot): `row` is the given struct column of df, curve the Hilbert index of its cell;
    shards are 0 to count - 1, of sizes at most one apart, and slots are gapless from 0.

    Rows are in order of curve, a hash of the key, the key and then the whole row; rows that are equal in all of them
    are interchangeable. Each dimension has 2**bits cells. df's columns are never mixed with those made here, so they
    may have any names. Null keys and repeated rows are placed like others; an empty df gives no rows.
    """
    cell = sum((d.cast("long") * F.lit(1 << bits * i) for i, d in enumerate(dimensions)), F.lit(0).cast("long"))
    placed = df.select(rows.alias("row"), cell.alias("cell"), key.alias("key")).withColumn("spread", F.xxhash64("key", "row"))
    cells = np.array([tuple(r) for r in placed.groupBy("cell").count().collect()], np.int64).reshape(-1, 2)  # 2**CELLS rows at most
    total = int(cells[:, 1].sum())
    wanted = max(LEAST_BIN, -(-total // BINS))
    cuts = np.maximum(1, cells[:, 1] // wanted)
    curve = hilbert(cells[:, :1] >> bits * np.arange(len(dimensions)) & (1 << bits) - 1, bits)
    spark = df.sparkSession
    cut = spark.createDataFrame([(int(c), int(n), int(h)) for (c, _), n, h in zip(cells, cuts, curve, strict=True)], "cell long, cuts int, curve long")
    binned = placed.join(F.broadcast(cut), "cell").withColumn("bin", F.pmod("spread", F.col("cuts")).cast("int"))
    counts = sorted(tuple(r) for r in binned.groupBy("curve", "bin").count().collect())  # BINS and the cells at most
    first, start = [], 0
    for c, b, n in counts:
        first.append((c, b, start))
        start += n
    bins = spark.createDataFrame(first, "curve long, bin int, first long")
    inside = Window.partitionBy("curve", "bin").orderBy("spread", "key", "row")
    ranked = binned.join(F.broadcast(bins), ["curve", "bin"]).withColumn("rank", F.col("first") + F.row_number().over(inside) - 1)
    small, larger = divmod(total, count)
    edge = larger * (small + 1)  # ranks below lie in shards of one row more
    rank, most = F.col("rank"), F.lit(max(small, 1))
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(larger + F.floor((rank - edge) / most))
    slot = F.when(rank < edge, F.pmod(rank, F.lit(small + 1))).otherwise(F.pmod(rank - edge, most))
    return ranked.select("row", "curve", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
