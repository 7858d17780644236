"""Connected regions of runs on two levels: a forest inside each raster block, contraction between blocks.

The raster is cut into square blocks. Inside a block a vectorised union-find joins runs that share a
side, so a region that stays in its block is done in one pass; only runs that meet across a border
make links, between the roots of their blocks. That border graph is smaller than the raster by about
a block's width, whatever the regions' shapes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.operators.graph import components
from cinderframe.sources.scratch import written

#: Cells along a block's side, and links that one task may settle.
BLOCK, LINKS = 256, 500_000
#: A cell's number: its row, then its column (both may be negative).
ROW = 2**31


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's tree among nodes 0..n-1 with links a-b.

    Every round hooks the roots of a link's ends to the lesser one and halves the paths to the roots.
    """
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    return root


def row_neighbours(row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (upper, lower) of runs in order of (row, c0) that overlap in rows one apart."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, width = c0.min(), int(c1.max() - c0.min()) + 2
    starts, ends, below = row * width + (c0 - low), row * width + (c1 - low), (row + 1) * width
    first = np.searchsorted(ends, below + (c0 - low), "right")
    last = np.searchsorted(starts, below + (c1 - low), "left")
    many = np.maximum(last - first, 0)
    upper = np.repeat(np.arange(len(row)), many)
    lower = np.repeat(first, many) + np.arange(len(upper)) - np.repeat(np.cumsum(many) - many, many)
    return upper, lower


def block_labels(part: pd.DataFrame) -> pd.DataFrame:
    """Runs of one block with ``low``: the number of the first cell of their region inside the block."""
    part = part.sort_values(["row", "c0"], kind="stable").reset_index(drop=True)
    row, c0, c1, n = (part[c].to_numpy(np.int64) for c in ("row", "c0", "c1", "n"))
    # touching runs of a row with one count are one run
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (c0[1:] != c1[:-1]) | (n[1:] != n[:-1])
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(row)) - 1
    row, c0, c1, n = row[starts], c0[starts], c1[last], n[starts]
    upper, lower = row_neighbours(row, c0, c1)
    same = n[upper] == n[lower]
    root = forest(len(row), upper[same], lower[same])
    return pd.DataFrame({"row": row, "c0": c0, "c1": c1, "n": n, "low": row[root] * ROW + c0[root]})


def settled(links: DataFrame, most: int = LINKS) -> DataFrame:
    """(node, root) of links (a, b), already written: the smallest node reachable.

    Up to ``most`` links are one task's union-find, more go through star contraction.
    """
    if links.limit(most + 1).count() > most:
        return components(links)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = np.unique(part[["a", "b"]].to_numpy(np.int64).reshape(-1), return_inverse=True)
        ends = ends.reshape(-1, 2)
        return pd.DataFrame({"node": nodes, "root": nodes[forest(len(nodes), ends[:, 0], ends[:, 1])]})

    return links.groupBy().applyInPandas(run, "node long, root long")


def label_components(runs: DataFrame, block: int = BLOCK, most: int = LINKS) -> DataFrame:
    """(row, c0, c1, n, rid, comp) of disjoint runs (row, c0, c1, n): their 4-connected region of equal n.

    ``comp`` is the number of the region's first cell (row, then column), ``rid`` that of the run's own.
    Runs come out cut at the blocks' borders, and runs of a row that touch with equal n inside a block
    come out as one. A block holds at most ``block`` squared runs.
    """
    across = F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor((F.col("c1") - 1) / block))).alias("bx")
    cut = runs.select("row", F.col("c0").alias("a"), F.col("c1").alias("z"), "n", F.floor(F.col("row") / block).alias("by"), across)
    cut = cut.select("by", "bx", "row", F.greatest("a", F.col("bx") * block).alias("c0"), F.least("z", (F.col("bx") + 1) * block).alias("c1"), F.col("n").cast("int").alias("n"))
    parts = written(cut.groupBy("by", "bx").applyInPandas(block_labels, "row long, c0 long, c1 long, n int, low long"), "block-labels")
    roots = settled(written(border_links(parts, block), "border-links"), most)
    out = parts.join(roots.withColumnsRenamed({"node": "low", "root": "comp"}), "low", "left")
    return out.select("row", "c0", "c1", "n", (F.col("row") * F.lit(ROW) + F.col("c0")).alias("rid"), F.coalesce("comp", "low").alias("comp"))


def border_links(parts: DataFrame, block: int) -> DataFrame:
    """(a, b): the block regions that share a side across a border with equal n, each pair once."""
    above = parts.where(F.pmod(F.col("row") + 1, F.lit(block)) == 0)
    above = above.select((F.col("row") + 1).alias("row"), F.floor(F.col("c0") / block).alias("bx"), "n", F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("low").alias("a"))
    below = parts.where(F.pmod("row", F.lit(block)) == 0).select("row", F.floor(F.col("c0") / block).alias("bx"), "n", "c0", "c1", F.col("low").alias("b"))
    level = above.join(below, ["row", "bx", "n"]).where("a0 < c1 and c0 < a1").select("a", "b")
    left = parts.where(F.pmod("c1", F.lit(block)) == 0).select("row", F.col("c1").alias("c"), "n", F.col("low").alias("a"))
    right = parts.where(F.pmod("c0", F.lit(block)) == 0).select("row", F.col("c0").alias("c"), "n", F.col("low").alias("b"))
    return level.unionByName(left.join(right, ["row", "c", "n"]).select("a", "b")).distinct()
