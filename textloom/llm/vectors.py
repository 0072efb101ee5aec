"""Near-duplicate embeddings by Euclidean p-stable hashing, with exact cosine checks.

Unit vectors at cosine c lie sqrt(2 - 2c) apart. A table's key quantises k Gaussian projections of a vector,
floor((a.x + b) / width); vectors that share a key of any table, and a label, are compared exactly. k follows the
number of vectors so that unrelated vectors rarely meet in any table, and the number of tables follows k so that a
pair at the threshold meets in at least one of them with probability RECALL or more.

Equal vectors form a class and are hashed once. What is shuffled for every table is a key and a class; the vectors
follow only into buckets that hold several classes, and of buckets of different tables that hold the same classes only
the first counts. A bucket with more than BLOCK classes is cut into blocks, and every two of its blocks meet in a group
of their own, so no task holds a whole hot bucket. A group returns sums of links and a spanning forest instead of its
pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, bit_map, bounds, components, ready, whole_groups, written
from .wordhash import mix

BLOCK = 512
WIDTH = 2.5
RECALL = 0.99999
SPARE = 8  # unrelated vectors share a key of a table with a chance of 1 / SPARE at most


def meets(distance: float, width: float) -> float:
    """Chance that one quantised projection of two vectors at this distance agrees (Datar et al. 2004)."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, cosine: float, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """Projections of a table and number of tables, for so many vectors that may meet."""
    near, far = meets(math.sqrt(2 - 2 * cosine), width), meets(math.sqrt(2), width)
    k = max(6, math.ceil(math.log(max(vectors, 2) * SPARE) / math.log(1 / far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _class(label: str, x: np.ndarray, seed: int) -> tuple[int, int]:
    """A class and a second hash that tells two classes of the same number apart."""
    body = hashlib.blake2b(f"{seed}:{len(label)}:{label}:".encode() + (x + 0.0).tobytes(), digest_size=16).digest()
    return int.from_bytes(body[:8], "little", signed=True), int.from_bytes(body[8:], "little", signed=True)


@lru_cache(maxsize=8)
def _projections(size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(size)
    return rng.standard_normal((size, count)), rng.uniform(0, WIDTH, count)


def _cells(xs: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Quantised projections (vector, table, projection) of unit vectors of one length; the same in every task."""
    a, b = _projections(xs.shape[1], k * tables)
    return np.floor((xs @ a + b) / WIDTH).astype(np.int32).reshape(len(xs), tables, k)


def _keys(cells: np.ndarray, salts: list[int]) -> np.ndarray:
    """One 64-bit key for each vector and table, from its cells, the table and what labels and lengths salt it with."""
    h = np.array(salts, np.int64).view(np.uint64)[:, None] + mix(np.arange(cells.shape[1], dtype=np.uint64))[None]
    for j in range(cells.shape[2]):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + cells[:, :, j].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _usable(values) -> np.ndarray | None:
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _units(xs: list) -> np.ndarray:
    x = np.stack(xs).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """Rows (id, n_links, component_id, kept): how many other vectors of the same label each one links with directly,
    the least id it reaches by links, and whether that is itself.

    Vectors that are null, empty or zero, that hold null or non-finite components, or whose label is null link with
    nothing and are their own component; so do vectors of different lengths among each other. Repeated rows count as
    vectors of their own. A row with a null id is no component's least id and is not kept. An empty table gives none.
    Other columns of df, whatever their names, are ignored.
    """
    spark = df.sparkSession
    ready(spark)
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    kind, held = ("array<float>", pa.list_(pa.float32())) if single else ("array<double>", pa.list_(pa.float64()))

    def describe(seed):
        def read(batches):
            for batch in batches:
                labels, vecs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                xs = [None if lab is None else _usable(v) for lab, v in zip(labels, vecs, strict=True)]
                cls = [(None, None) if x is None else _class(repr(lab), x, seed) for lab, x in zip(labels, xs, strict=True)]
                salt = [None if x is None else int.from_bytes(hashlib.blake2b(f"{len(x)}:{lab!r}".encode(), digest_size=8).digest(), "little", signed=True) for lab, x in zip(labels, xs, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[j] for c in cls], pa.int64()) for j in range(2)), pa.array(salt, pa.int64()), pa.array(xs, held)], names=["id", "cls", "check", "salt", "x"])

        own = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("x"))
        return own.mapInArrow(read, f"id long, cls long, check long, salt long, x {kind}")

    for seed in itertools.count():  # another seed in the rare case that two classes have one number
        rows = describe(seed)
        classes = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("check").alias("low"), F.max("check").alias("high"), F.first("salt").alias("salt"), F.first("x").alias("x"))
        classes = written(classes, "classes")
        if classes.where("low < high").isEmpty():
            break
    most = classes.groupBy("salt").count().agg(F.max("count")).first()[0] or 0
    k, tables = plan(most, cosine)

    def sign(bits):
        def read(batches):
            for batch in (part.slice(at, 2000) for part in batches for at in range(0, part.num_rows, 2000)):
                cls, xs, salts = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for size in {len(x) for x in xs}:
                    at = [i for i, x in enumerate(xs) if len(x) == size]
                    keys = _keys(_cells(_units([xs[i] for i in at]), k, tables), [salts[i] for i in at])
                    t, own = np.tile(np.arange(tables, dtype=np.int32), len(at)), np.repeat(cls[at], tables)
                    keys = keys.ravel()
                    if bits is not None:
                        met = bits.holds(keys)
                        t, own, keys = t[met], own[met], keys[met]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(t), pa.array(own)], names=["key", "t", "cls"])

        return classes.select("cls", "x", "salt").mapInArrow(read, "key long, t int, cls long")

    full = sign(None).groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("m"), F.min("t").alias("t"), F.bit_xor(F.xxhash64("cls")).alias("held")).where("m > 1")
    # Buckets of the same classes are compared once, in the first table: a pair's first bucket is among those.
    full = written(full.groupBy("held", "m").agg(F.min_by("key", "t").alias("key"), F.min("t").alias("t")).select("key", "m", "t"), "buckets")
    members = sign(bit_map(full, F.col("key"))).drop("t").join(full, "key")
    members = members.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.expr("int(pmod(xxhash64(cls), blocks))"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    members = members.select("t", "key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "cls")
    met = members.join(classes.select("cls", "n", "salt", "x"), "cls")
    met = met.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "block")

    def compare(frames):
        keys = ["key", "b1", "b2"]
        for pdf, g in whole_groups(frames, lambda p: p.groupby(keys, sort=False).ngroup().to_numpy()):
            out = []
            for lo, hi in bounds(g):
                if hi - lo > 1:
                    out += _compared(pdf.iloc[lo:hi], cosine, k, tables)
            if out:
                a, b, links = zip(*out, strict=True)
                # Typed one by one: a frame of tuples would make floats of integers beside nulls.
                yield pd.DataFrame({"a": np.array(a, np.int64), "b": pd.array(b, "Int64"), "links": np.array(links, np.int64)})

    found = written(met.mapInPandas(compare, "a long, b long, links long"), "links")
    links = written(found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links")), "sums")
    groups = components(found.where("b is not null"), "a", "b").join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    groups = written(groups, "groups")
    least = written(groups.groupBy("component").agg(F.min("rep").alias("least")), "least")
    named = groups.join(least, "component").select(F.col("node").alias("cls"), "least")
    own = classes.select("cls", "rep", "n").join(links, "cls", "left").join(named, "cls", "left")
    own = written(own.select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "rep").alias("component")), "own")
    out = rows.select("id", "cls").join(own, "cls", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _compared(own: pd.DataFrame, cosine: float, k: int, tables: int) -> list[tuple]:
    """Sums of links and a spanning forest of one group. A pair counts in the first table in which it meets, for both."""
    t, same = int(own["t"].iloc[0]), own["b1"].iloc[0] == own["b2"].iloc[0]
    cls, n, salts = own["cls"].to_numpy(), own["n"].to_numpy(), own["salt"].to_numpy()
    if (salts != salts[0]).any():  # keys of 64 bits may agree by chance, labels must not
        return [row for salt in np.unique(salts) for row in _compared(own[salts == salt], cosine, k, tables)]
    x = _units(own["x"].to_list())
    half = len(own) if same else int((own["block"] == own["b1"].iloc[0]).sum())
    sums, forest, edges, keys = np.zeros(len(own), np.int64), Forest(len(own)), [], None
    for at in range(0, half, 256):
        near = x[at : min(at + 256, half)] @ x.T >= cosine
        i, j = np.nonzero(near)
        i += at
        keep = j > i if same else j >= half
        i, j = i[keep], j[keep]
        if t and len(i):
            keys = _keys(_cells(x, k, tables)[:, :t], [0] * len(x)) if keys is None else keys
            first = np.concatenate([~(keys[i[s : s + 65536]] == keys[j[s : s + 65536]]).any(1) for s in range(0, len(i), 65536)])
            i, j = i[first], j[first]
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(p, q):
                edges.append((cls[p], cls[q], 0))
        np.add.at(sums, i, n[j])
        np.add.at(sums, j, n[i])
    return edges + [(cls[i], None, sums[i]) for i in np.flatnonzero(sums)]
