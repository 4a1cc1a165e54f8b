"""All pairs inside the groups of a table, by tiles of bounded size.

A group larger than a tile is dealt to parts, and each pair of parts is a tile of its own, so
the pairs of even the largest group are looked at by many tasks, and none of them is emitted:
a tile answers with what each of its rows found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part; a tile has two.
PART_ROWS = 768


def deal(rows: DataFrame, part_rows: int | None = None) -> DataFrame:
    """Add ``lo``, ``hi`` (a tile's parts) and ``part`` to rows with ``node``, ``id`` and ``m``, the node's rows."""
    k = F.ceil(F.col("m") / F.lit(part_rows or PART_ROWS)).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "node"), k).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), k - 1)))
    return rows.withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other")).drop("_other")


def gather(tiles: DataFrame, rows_each: int, n_rows: int) -> DataFrame:
    """Add ``lot``, by which whole tiles are put together into groups of about ``rows_each`` rows."""
    lots = max(8, n_rows // rows_each)
    return tiles.withColumn("lot", F.pmod(F.xxhash64("node", "lo", "hi"), F.lit(lots)).cast("int"))


def each_tile(node: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each tile of a lot, by ascending id."""
    order = np.lexsort((ids, hi, lo, node))
    a, b, c = node[order], lo[order], hi[order]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])) + 1
    yield from np.split(order, cut)


def pairs_mask(part: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Which pairs (row, column) a tile answers for: within its part, or between its two parts."""
    n = len(part)
    if lo == hi:
        return ~np.eye(n, dtype=bool)
    return part[:, None] != part[None, :]


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest row number that each row reaches in a boolean link matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(1, initial=n)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
