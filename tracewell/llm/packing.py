"""Fixed-capacity containers filled with neighbouring documents.

Hashed document vectors are projected to three dimensions and put in order along a Hilbert curve,
so near documents stand near each other. The order is range-partitioned, and each range is packed
in one pass along the curve with a bounded number of containers open.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens

CAPACITY = 4096
OPEN = 64  # containers open at a time in a range
BITS = 10  # of the curve per dimension


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of integer points (n x d, each below 2**bits) along the Hilbert curve, as int64.

    Goes down the bits of all points at once: the standard change of axes, undone to Gray code.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[d - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_key(cells: list[Column]) -> Column:
    """The Hilbert key of cell numbers (one column per dimension)."""

    @F.pandas_udf("bigint")
    def key(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([c.to_numpy() for c in cols], axis=1)))

    return key(*cells)


def along_curve(items: DataFrame) -> DataFrame:
    """Adds ``curve`` to ``items`` with ``x_0 .. x_2``.

    Each dimension is centred and scaled by its mean and deviation over all items and mapped to
    2**BITS cells of equal share under the normal curve, so cells are used evenly at any size.
    """
    dims = [f"x_{i}" for i in range(tokens.DIMS)]
    stats = items.agg(*[x for c in dims for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    held = items.crossJoin(F.broadcast(stats))  # one row of statistics

    def cell(c: str) -> Column:
        z = F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0))
        share = 1 / (1 + F.exp(-1.702 * z))  # close to the normal distribution function
        return F.least(F.floor(share * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("bigint")

    return held.withColumn("curve", curve_key([cell(c) for c in dims])).drop(*[f"{a}_{c}" for a in "ms" for c in dims], *dims)


class Packer:
    """Best fit among at most ``limit`` open containers; items come and containers go in a stream."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.open: list[tuple[int, int]] = []  # (room left, number), sorted
        self.items: dict[int, list] = {}
        self.made = 0

    def put(self, size: int, item) -> list[list]:
        """Places an item; gives containers that this closes."""
        i = bisect_left(self.open, (size, -1))
        closed = []
        if i < len(self.open):
            room, k = self.open.pop(i)
        else:
            room, k = self.capacity, self.made
            self.made += 1
            self.items[k] = []
            if len(self.open) >= self.limit:
                closed.append(self.items.pop(self.open.pop(0)[1]))
        self.items[k].append((size, item))
        if room == size:
            closed.append(self.items.pop(k))
        else:
            insort(self.open, (room - size, k))
        return closed

    def rest(self) -> list[list]:
        """What is open at the end, packed anew by best fit from the largest item down."""
        left = sorted((x for k in self.items.values() for x in k), key=lambda x: (-x[0], x[1]))
        last = Packer(self.capacity, len(left) + 1)
        full = [c for size, item in left for c in last.put(size, item)]
        return full + list(last.items.values())


def packed(items: DataFrame, doc_id: str, capacity: int = CAPACITY, open_containers: int = OPEN) -> DataFrame:
    """``container_id, doc_id, piece, from_token, to_token, n_tokens`` for ``items(doc_id, n_tokens, curve)``.

    Every item is in exactly one container, whole, but one above the capacity, which is cut into
    pieces of the capacity and a rest. No container holds more than the capacity. An item without
    tokens is a piece of size 0. A container is named after the first piece put into it.

    Ranges of the curve are cut by key and id, so a place that holds any part of all items is split
    like others. The work of a range is one pass; what is in memory is ``open_containers``
    containers. A range ends with at most about one container that isn't nearly full.
    """
    kind = items.schema[doc_id].dataType.simpleString()
    ordered = items.select(doc_id, F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), "curve").repartitionByRange("curve", doc_id).sortWithinPartitions("curve", doc_id)
    columns = ["container_id", doc_id, "piece", "from_token", "to_token", "n_tokens"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity, open_containers)

        def rows(containers: list[list]) -> list[tuple]:
            out = []
            for c in containers:
                name = f"{c[0][1][0]}.{c[0][1][1]}"
                out += [(name, doc, piece, piece * capacity, piece * capacity + size, size) for size, (doc, piece) in c]
            return out

        for batch in batches:
            done = []
            for doc, n in zip(batch[doc_id].tolist(), batch["n_tokens"].tolist(), strict=True):
                for piece in range(max(1, -(-n // capacity))):
                    done += packer.put(min(capacity, n - piece * capacity), (doc, piece))
            yield pd.DataFrame(rows(done), columns=columns)
        yield pd.DataFrame(rows(packer.rest()), columns=columns)

    return ordered.mapInPandas(pack, f"container_id string, `{doc_id}` {kind}, piece bigint, from_token bigint, to_token bigint, n_tokens bigint")


def fill(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, split documents, tokens, unused room and its share."""
    per = pieces.groupBy("container_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("piece") == 1).alias("split"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"),
        F.coalesce(F.sum("split"), F.lit(0)).alias("n_split_documents"),
        F.coalesce(F.sum("held"), F.lit(0)).alias("n_tokens"),
        (F.count(F.lit(1)) * capacity - F.coalesce(F.sum("held"), F.lit(0))).alias("unused"),
        F.round(1 - F.sum("held") / (F.count(F.lit(1)) * capacity), 6).alias("unused_share"),
    )
