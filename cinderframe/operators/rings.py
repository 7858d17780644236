"""Outlines of raster patches: directed sides of runs, joined to paths in raster blocks and to rings between them.

A side has its patch on its left, so outer rings turn counter-clockwise (positive area) and holes
clockwise. Where two cells of a patch touch at a corner only, a ring turns left and so stays on its
own cell, which is what 4-connection asks for. No patch or ring is one task's work until its corners
are gathered to one shape: inside a block sides form paths, and paths that leave their block are put
in order by list contraction: independent ones are taken out by coin, round by round, and put back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.operators.labels import BLOCK, ROW
from cinderframe.sources.scratch import written

#: Paths that one task may join to rings.
PATHS = 500_000
#: Directions of sides: east, north, west, south.
EAST, NORTH, WEST, SOUTH = range(4)


def in_blocks(runs: DataFrame, block: int) -> DataFrame:
    """Runs (comp, row, c0, c1) cut at block borders, each in its block (by, bx) and, as ``halo``, where its sides are another's.

    A block owns the sides on its own left and lower lines: a run that ends at a block's right border is also
    in the block to the right, and one in its last row also in the block above.
    """
    across = F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor((F.col("c1") - 1) / block))).alias("bx")
    cut = runs.select("comp", "row", F.col("c0").alias("a"), F.col("c1").alias("z"), F.floor(F.col("row") / block).alias("by"), across)
    cut = cut.select("by", "bx", "comp", "row", F.greatest("a", F.col("bx") * block).alias("c0"), F.least("z", (F.col("bx") + 1) * block).alias("c1"))
    place = lambda up, right, halo: F.struct((F.col("by") + up).alias("by"), (F.col("bx") + right).alias("bx"), F.lit(halo).alias("halo"))
    right = F.when(F.col("c1") == (F.col("bx") + 1) * block, place(0, 1, 1))
    up = F.when(F.pmod(F.col("row") + 1, F.lit(block)) == 0, place(1, 0, 2))
    places = F.explode(F.array_compact(F.array(place(0, 0, 0), right, up))).alias("p")
    return cut.select("comp", "row", "c0", "c1", places).select("p.by", "p.bx", "p.halo", "comp", "row", "c0", "c1")


def block_sides(part: pd.DataFrame, block: int) -> pd.DataFrame:
    """(comp, s, x0, y0, x1, y1, d): the directed sides that one block owns, of runs in_blocks().

    Upright sides are a row high; level ones run along a line between two rows while just one of them is
    the patch's.
    """
    halo, comp, row, c0, c1 = (part[c].to_numpy(np.int64) for c in ("halo", "comp", "row", "c0", "c1"))
    size, right = len(part), (part["bx"].to_numpy(np.int64) + 1) * block
    top = (part["by"].to_numpy(np.int64) + 1) * block
    # upright: both ends of the block's own runs, and the ends that came from the left; equal ends of a patch meet
    own, left = halo == 0, halo == 1
    end_x = np.concatenate((c0[own], c1[own & (c1 < right)], c1[left]))
    at = np.concatenate((np.flatnonzero(own), np.flatnonzero(own & (c1 < right)), np.flatnonzero(left)))
    north = np.concatenate((np.zeros(int(own.sum()), bool), np.ones(len(at) - int(own.sum()), bool)))
    order = np.lexsort((end_x, row[at], comp[at]))
    at, end_x, north = at[order], end_x[order], north[order]
    twin = (np.diff(end_x) == 0) & (np.diff(row[at]) == 0) & (np.diff(comp[at]) == 0) if len(at) else np.zeros(0, bool)
    alone = ~(np.append(twin, False) | np.insert(twin, 0, False))[: len(at)]
    at, end_x, north = at[alone], end_x[alone], north[alone]
    y = row[at]
    upright = np.stack((comp[at], end_x, np.where(north, y, y + 1), end_x, np.where(north, y + 1, y), np.where(north, NORTH, SOUTH)), axis=1)
    # level: ends of the runs over and under each line, summed along it
    over, under = np.flatnonzero(own), np.flatnonzero((own & (row + 1 < top)) | (halo == 2))
    line = np.concatenate((row[over], row[over], row[under] + 1, row[under] + 1))
    who = np.concatenate((comp[over], comp[over], comp[under], comp[under]))
    x = np.concatenate((c0[over], c1[over], c0[under], c1[under]))
    a = np.repeat([1, -1, 0, 0], (len(over), len(over), len(under), len(under)))
    b = np.repeat([0, 0, 1, -1], (len(over), len(over), len(under), len(under)))
    order = np.lexsort((x, who, line))
    line, who, x, a, b = line[order], who[order], x[order], np.cumsum(a[order]), np.cumsum(b[order])
    stretch = np.flatnonzero((np.diff(x) > 0) & (np.diff(who) == 0) & (np.diff(line) == 0) & (a[:-1] != b[:-1])) if len(x) else np.zeros(0, int)
    # stretches that go on with the same side up are one
    east = a[stretch] > b[stretch]
    x0, x1, y = x[stretch], x[stretch + 1], line[stretch]
    more = (x1[:-1] == x0[1:]) & (y[:-1] == y[1:]) & (who[stretch][:-1] == who[stretch][1:]) & (east[:-1] == east[1:]) if len(stretch) else np.zeros(0, bool)
    first = np.flatnonzero(~np.insert(more, 0, False)) if len(stretch) else np.zeros(0, int)
    last = np.append(first[1:], len(stretch)) - 1 if len(stretch) else first
    x0, x1, y, east, who = x0[first], x1[last], y[first], east[first], who[stretch][first]
    level = np.stack((who, np.where(east, x0, x1), y, np.where(east, x1, x0), y, np.where(east, EAST, WEST)), axis=1)
    out = pd.DataFrame(np.concatenate((upright, level)) if size else np.zeros((0, 6), np.int64), columns=["comp", "x0", "y0", "x1", "y1", "d"])
    out.insert(1, "s", side_key(out["x0"], out["y0"], out["d"]))
    return out


def side_key(x, y, d):
    """A side's number: where it starts and its direction, which no two sides share."""
    return (y * ROW + x) * 4 + d


def chained(part: pd.DataFrame, block: int) -> pd.DataFrame:
    """The sides of one block as paths: each side's path, its place there, and what a path is.

    In: (comp, s, x0, y0, x1, y1, d). Out: a row a side (head, i, corner) and on a path's last row also
    ``ends`` (true), with length, least side and its place, and where the path goes on (x1, y1, d) unless
    it is ``closed``. A closed path starts at its least side.
    """
    v = {c: part[c].to_numpy(np.int64) for c in ("comp", "s", "x0", "y0", "x1", "y1", "d")}
    n = len(part)
    _, comp = np.unique(v["comp"], return_inverse=True)
    inside = (v["x1"] % block != 0) & (v["y1"] % block != 0)  # a corner on a border line may be another block's too
    start = (comp * block + v["y0"] % block) * block + v["x0"] % block
    order = np.argsort(start, kind="stable")
    end = (comp * block + v["y1"] % block) * block + v["x1"] % block
    first, stop = np.searchsorted(start[order], end, "left"), np.searchsorted(start[order], end, "right")
    turns = lambda j: (1 - v["d"][j] + v["d"]) % 4  # noqa: E731  left 0, straight 1, right 2
    one = order[np.minimum(first, n - 1)]
    two = order[np.minimum(first + 1, n - 1)]
    nxt = np.where((stop - first == 2) & (turns(two) < turns(one)), two, one)
    turn = turns(nxt)
    nxt = np.where(inside, nxt, -1)
    tail, after = walked(nxt)
    loop = np.flatnonzero(tail < 0)
    if len(loop):
        # the least side of each loop is seen within as many doublings as it has sides
        seen, least = nxt.copy(), v["s"].copy()
        for _ in range(int(len(loop)).bit_length() + 1):
            least[loop], seen[loop] = np.minimum(least[loop], least[seen[loop]]), seen[seen[loop]]
        cut = nxt.copy()
        back = np.zeros(n, bool)
        back[loop] = v["s"][nxt[loop]] == least[loop]
        cut[back] = -1
        tail, after = walked(cut)
    closed = np.zeros(n, bool)
    closed[loop] = True
    length = np.zeros(n, np.int64)
    np.maximum.at(length, tail, after + 1)
    at = length[tail] - 1 - after
    head = np.zeros(n, np.int64)
    firsts = np.flatnonzero(at == 0)
    head[tail[firsts]] = v["s"][firsts]
    best = np.lexsort((v["s"], tail))
    best = best[np.concatenate(([True], tail[best][1:] != tail[best][:-1]))] if n else best
    low, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low[tail[best]], place[tail[best]] = v["s"][best], at[best]
    corner = np.where(inside, turn != 1, False)
    out = {"comp": v["comp"], "head": head[tail], "i": at, "corner": corner, "x": v["x1"], "y": v["y1"], "d": v["d"], "ends": after == 0}
    return pd.DataFrame(out | {"closed": closed, "length": length[tail], "least": low[tail], "off": place[tail]})


def walked(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last node, steps to it) of each node of lists; -1 and nothing for those that go round."""
    end = nxt < 0
    at, far = np.where(end, np.arange(len(nxt)), nxt), (~end).astype(np.int64)
    for _ in range(max(1, int(len(nxt)).bit_length())):
        far, at = far + np.where(end[at], 0, far[at]), at[at]
    return np.where(end[at], at, -1), far


def splice(paths: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One contraction: (paths left, paths taken out), each taken into the path before it.

    paths: (h, next, length, least, off). A path goes if its coin fell on one side and that of the path
    before on the other, so no two neighbours go, and a fourth does on average.
    """
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))
    gone = paths.where(coin("h") == 1).select(*[F.col(c).alias(f"b_{c}") for c in paths.columns])
    kept = paths.where(coin("h") == 0)
    both = written(kept.join(gone, F.col("next") == F.col("b_h"), "left"), "spliced-paths")
    lesser = F.coalesce(F.col("b_least") < F.col("least"), F.lit(False))
    after = both.select(
        "h", F.coalesce("b_next", "next").alias("next"), (F.col("length") + F.coalesce("b_length", F.lit(0))).alias("length"),
        F.least("least", "b_least").alias("least"), F.when(lesser, F.col("length") + F.col("b_off")).otherwise(F.col("off")).alias("off"),
    )
    out = both.where("b_h is not null").select(F.col("b_h").alias("h"), F.col("h").alias("into"), F.col("length").alias("at"))
    rest = paths.where(coin("h") == 1).join(out.select("h"), "h", "left_anti")
    return written(after.unionByName(rest.select(*after.columns)), "paths"), out


def joined(part: pd.DataFrame) -> pd.DataFrame:
    """(h, ring, at, size) of paths (h, next, length, least, off) that form rings: each path's place on its ring."""
    h, length = part["h"].to_numpy(np.int64), part["length"].to_numpy(np.int64)
    order = np.argsort(h)
    nxt = order[np.searchsorted(h[order], part["next"].to_numpy(np.int64))]
    least, seen = part["least"].to_numpy(np.int64).copy(), nxt.copy()
    for _ in range(int(len(h)).bit_length() + 1):
        least, seen = np.minimum(least, least[seen]), seen[seen]
    own = part["least"].to_numpy(np.int64) == least  # the path that holds its ring's least side
    before = np.empty(len(h), np.int64)
    before[nxt] = np.arange(len(h))
    cut = np.where(own[nxt], -1, nxt)
    at, far, end = np.where(cut < 0, np.arange(len(h)), cut), np.where(cut < 0, 0, length), cut < 0
    for _ in range(max(1, int(len(h)).bit_length())):
        far, at = far + np.where(end[at], 0, far[at]), at[at]
    # from a path's start to the last path's end, and the whole ring from the path with the least side
    rest = far + length[at]
    size = rest[nxt[at]]
    off = part["off"].to_numpy(np.int64)[nxt[at]]
    return pd.DataFrame({"h": h, "ring": least, "at": (size - rest - off) % size, "size": size})


def placed(paths: DataFrame, most: int) -> DataFrame:
    """(h, ring, at, size) of open paths (h, next, length, least, off): their place on their ring.

    Lists contract until at most ``most`` paths are left, which one task joins; those taken out on the
    way get their places back in reverse. All rounds together write a few times the paths, not their
    number times the rounds.
    """
    taken, whole, turn = [], None, 0
    while paths.limit(most + 1).count() > most:
        paths, out = splice(paths, turn)
        alone = paths.where("h = next").select("h", F.col("least").alias("ring"), ((F.col("length") - F.col("off")) % F.col("length")).alias("at"), F.col("length").alias("size"))
        whole = alone if whole is None else whole.unionByName(alone)
        paths, taken, turn = paths.where("h <> next"), [*taken, out], turn + 1
    found = paths.groupBy().applyInPandas(joined, "h long, ring long, at long, size long")
    found = found if whole is None else found.unionByName(whole)
    for out in reversed(taken):
        base = written(found, "placed-paths")
        place = out.withColumnRenamed("at", "step").join(base.withColumnRenamed("h", "into"), "into")
        found = base.unionByName(place.select("h", "ring", ((F.col("at") + F.col("step")) % F.col("size")).alias("at"), "size"))
    return found


def rings(runs: DataFrame, block: int = BLOCK, most: int = PATHS) -> DataFrame:
    """(comp, ring, pos, x, y): the corners of each ring of patches (comp, row, c0, c1) in order, in cells.

    ring is the number of its lowest, then leftmost side, and pos grows along the ring. Sides become paths
    inside their raster block; a ring that leaves its block is then a list of paths, ranked by contraction.
    """
    dealt = in_blocks(runs, block).groupBy("by", "bx")
    schema = "comp long, head long, i long, corner boolean, x long, y long, d int, ends boolean, closed boolean, length long, least long, off long"
    chain = written(dealt.applyInPandas(lambda p: chained(block_sides(p, block), block), schema), "side-paths")
    whole = chain.where("closed and corner").select("comp", F.col("least").alias("ring"), F.col("i").alias("pos"), "x", "y")
    last = chain.where("ends and not closed")
    heads = chain.where("i = 0 and not closed").select("comp", F.col("head").alias("t"))
    # a head's number says where it starts and where it goes
    start = heads.select("comp", F.pmod(F.floor(F.col("t") / 4) + F.lit(ROW // 2), F.lit(ROW)) - F.lit(ROW // 2), "t", F.pmod("t", F.lit(4)).cast("int"))
    start = start.toDF("comp", "x", "t", "e").withColumn("y", F.floor((F.floor(F.col("t") / 4) - F.col("x")) / F.lit(ROW)))
    turn = F.pmod(F.lit(1) - F.col("e") + F.col("d"), F.lit(4))
    on = last.join(start, ["comp", "x", "y"]).groupBy("head").agg(F.min(F.struct(turn.alias("turn"), "t")).alias("m"))
    on = written(on.select("head", F.col("m.t").alias("next"), (F.col("m.turn") != 1).alias("bend")), "path-ends")
    paths = written(last.join(on, "head").select(F.col("head").alias("h"), "next", "length", "least", "off"), "paths")
    at = placed(paths, most).join(on.withColumnRenamed("head", "h"), "h").withColumnRenamed("h", "head")
    open_ = chain.where("not closed and (corner or ends)").join(at, "head").where("corner or (ends and bend)")
    open_ = open_.select("comp", "ring", ((F.col("at") + F.col("i")) % F.col("size")).alias("pos"), "x", "y")
    return whole.unionByName(open_)


def shapes(corners: DataFrame, cell: int) -> DataFrame:
    """(comp, ring, pts, area): rings of corners as closed lists of points, with their signed area, in units of ``cell`` a cell."""
    p = F.struct("pos", F.struct((F.col("x") * cell).cast("double").alias("x"), (F.col("y") * cell).cast("double").alias("y")).alias("p"))
    r = corners.groupBy("comp", "ring").agg(F.transform(F.sort_array(F.collect_list(p)), lambda s: s["p"]).alias("r"))
    r = r.select("comp", "ring", F.concat("r", F.slice("r", 1, 1)).alias("pts"))
    nxt = F.slice("pts", 2, F.size("pts") - 1)
    terms = F.zip_with(F.slice("pts", 1, F.size("pts") - 1), nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return r.withColumn("area", F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2)
