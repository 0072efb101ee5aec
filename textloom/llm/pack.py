"""Bounded-space online packing of tokenised documents into sequences of a fixed length.

Each partition keeps a fixed number of open windows. A document is cut into whole windows and a rest; the rest goes
where it fits best. When none fits, the fullest window is emitted and a new one opened. The windows that are still
open at a partition's end go, with their ids, to a last step, which lays the pieces of neighbouring partitions end to
end and cuts them at the window's length.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, written

OPEN = 64  # open windows of a partition
MERGED = 16  # partitions whose leftovers one task merges
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, win long, offset long, ids binary"
_LONG = re.compile(r"\S{500}|\s{500}")


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """Text -> ids as little-endian unsigned 32-bit bytes, by the byte-level BPE file `vocabulary` (.json).

    The ids are those that `tokenizers` gives with add_special_tokens=False: the strings of the file's special tokens
    stand for their ids. The rank file of the same name, where there is one, holds the same vocabulary for a faster
    library, with equal ids; texts with a special string, which that library does not know, and texts with very long
    unbroken runs, which it takes long for, go through the .json file.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    by_file = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    try:
        import public_tokenizers
        import tiktoken

        lines = open(vocabulary.removesuffix(".json") + ".tiktoken", "rb").read().splitlines()
    except (ImportError, OSError):
        return by_file
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: by_file(text) if any(x in text for x in special) or _LONG.search(text) else np.array(fast.encode_ordinary(text), "<u4").tobytes()


class Windows:
    """The open windows of one partition; each holds its pieces until it is emitted."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.held, self.next = size, most, [], {}, 0

    def put(self, piece: tuple, length: int) -> list[tuple]:
        """Place one piece; returns the pieces of a window that had to go, as (piece, window, offset)."""
        gone = []
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, win = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                gone = self.emit(0)
            room, win = self.size, self.next
            self.next += 1
            self.held[win] = []
        self.held[win].append((piece, win, self.size - room))
        insort(self.free, (room - length, win))
        if room == length:
            gone = gone + self.emit(0)
        return gone

    def emit(self, at: int) -> list[tuple]:
        return self.held.pop(self.free.pop(at)[1])


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", size: int = 2048, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids), one for each piece of a document.

    A document's ids are those of its text, then `end`. `ids` holds a piece's ids only where keep_ids is set. Null
    and empty texts are one id long; equal and repeated rows are packed each; null ids stay null; an empty table
    gives no rows. sequence_id is unique, not gapless. A lost executor's partition is packed again the same way.
    Texts of any length are encoded whole; the choice between the two encoders (see encoder) changes no id. Other
    columns of docs, whatever their names, are ignored.
    """
    ready(docs.sparkSession)

    def online(batches):
        part = TaskContext.get().partitionId()
        encode, windows = encoder(vocabulary), Windows(size, OPEN)
        last = np.array([end], "<u4").tobytes()

        def rows(placed, whole):
            for (doc, start, ids, total), win, offset in placed:
                yield doc, start, len(ids) // 4, zlib.crc32(ids), total, part, win if whole else -1 - win, offset, ids if keep_ids or not whole else None

        def frame(out):
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 8 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc, body = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = encode(body or "") + last
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    out += rows(windows.put((doc, start, piece, total), len(piece) // 4), True)
                if len(out) >= 20000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)
        out = [row for at in range(len(windows.free)) for row in rows(windows.emit(0), False)]
        if out:
            yield frame(out)

    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(online, SCHEMA)
    placed = written(placed, "placed")
    sequence = (F.col("part") * F.lit(1 << 33) + F.col("win")).alias("sequence_id")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["part", "win", "offset"], ascending=[True, False, True])
        at, win, out = 0, 1 << 32, []  # above the windows of the first step
        for row in own.itertuples(index=False):
            body, start = bytes(row.ids), row.start
            while body:
                cut = body[: 4 * (size - at)]
                out.append((row.doc_id, start, len(cut) // 4, zlib.crc32(cut), row.doc_tokens, own["part"].iloc[0], win, at, cut if keep_ids else None))
                start, at, body = start + len(cut) // 4, at + len(cut) // 4, body[len(cut) :]
                if at == size:
                    at, win = 0, win + 1
        return pd.DataFrame(out, columns=own.columns[: len(out[0])]).astype({"doc_id": "Int64"})

    left = placed.where("win < 0").groupBy(F.expr(f"part div {MERGED}")).applyInPandas(merge, SCHEMA)
    done = placed.where("win >= 0").unionByName(left).withColumn("sequence_id", sequence)
    return done.select(columns)
