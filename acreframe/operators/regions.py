"""Connected components, field sizes, sieve, boundary edges and polygons of masks.

Components never cross tiles. Labelling is an array kernel on a block of a tile, one group each; labels of blocks are joined across
their borders, and the sieve works on labels, so that a tile may have any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.sources.files import kept

AROUND = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, 0), (1, 1), (1, -1))}


def touching(r: np.ndarray, c: np.ndarray, connectivity: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of cells that touch, each once; cells are in scan order."""
    width = int(c.max() - c.min()) + 3  # a column to spare on either side, so that no row runs into the next
    key = (r - r.min()).astype(np.int64) * width + (c - c.min()) + 1
    left, right = [], []
    for dr, dc in AROUND[connectivity]:
        at = np.searchsorted(key, key + dr * width + dc)
        found = np.flatnonzero(key[np.minimum(at, len(key) - 1)] == key + dr * width + dc)
        left.append(found)
        right.append(at[found])
    return np.concatenate(left), np.concatenate(right)


def united(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the edges (i, j): hooking and pointer jumping on arrays."""
    parent = np.arange(n)
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


def label_cells(r: np.ndarray, c: np.ndarray, v: np.ndarray, connectivity: int) -> np.ndarray:
    """For each cell, the position of the first cell, in scan order, of its component of equal values."""
    if not len(r):
        return np.zeros(0, int)
    order = np.lexsort((c, r))
    i, j = touching(r[order], c[order], connectivity)
    same = v[order][i] == v[order][j]
    out = np.empty(len(order), int)
    out[order] = order[united(len(order), i[same], j[same])]
    return out


def components(mask: DataFrame, connectivity: int = 4, block: int = SETTINGS.block) -> DataFrame:
    """(tile, r, c, v, root_r, root_c): the first cell of each cell's component of equal values v.

    A tile is cut into blocks of ``block`` cells a side, which are labelled apart, one group each. Pairs of labels that touch
    across the border of two blocks are the edges of a graph of labels, whose components are found by joins; labels then take
    the first cell of their component. No task holds more than a block, and a label has a block's cells at most.
    """
    found = labelled(mask, connectivity, block)
    return found.select("tile", "r", "c", "v", F.shiftright("root", 32).alias("root_r"), F.col("root").bitwiseAND(F.lit((1 << 32) - 1)).alias("root_c"))


def labelled(mask: DataFrame, connectivity: int, block: int) -> DataFrame:
    """(tile, r, c, v, root): the component's first cell as row * 2**32 + column; a table in the shared folder."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf.r.to_numpy(), pdf.c.to_numpy()
        root = label_cells(r, c, pdf.v.to_numpy(), connectivity)
        return pdf.assign(root=(r[root] << 32) + c[root])[["tile", "r", "c", "v", "root"]]

    kind = mask.schema["tile"].dataType.simpleString()
    cells = mask.select("tile", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), F.col("v").cast("int").alias("v"))
    placed = cells.withColumns({"br": F.floor(F.col("r") / block), "bc": F.floor(F.col("c") / block)})
    local = kept(placed.groupBy("tile", "br", "bc").applyInPandas(run, f"tile {kind}, r bigint, c bigint, v int, root bigint"), "labels")
    edges = kept(across_borders(local, connectivity, block), "edges")
    if edges.isEmpty():
        return local
    joined = graph_components(edges).withColumnsRenamed({"tile": "_tile", "root": "_root"})
    return kept(local.join(joined, (F.col("tile") == F.col("_tile")) & (F.col("root") == F.col("node")), "left").select("tile", "r", "c", "v", F.coalesce("_root", "root").alias("root")), "labels")


def across_borders(local: DataFrame, connectivity: int, block: int) -> DataFrame:
    """(tile, a, b) of labels a < b of equal values that touch across the border of two blocks: an equi-join of border cells."""
    r, c = F.col("r") % block, F.col("c") % block
    border = local.where((r == 0) | (r == block - 1) | (c == 0) | (c == block - 1))
    steps = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in AROUND[connectivity]]))
    sent = border.select("tile", "r", "c", "v", F.col("root").alias("x"), steps.alias("s")).withColumns({"r2": F.col("r") + F.col("s.dr"), "c2": F.col("c") + F.col("s.dc")})
    sent = sent.where((F.floor(F.col("r") / block) != F.floor(F.col("r2") / block)) | (F.floor(F.col("c") / block) != F.floor(F.col("c2") / block)))
    other = border.select(F.col("tile").alias("_t"), F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("v").alias("_v"), F.col("root").alias("y"))
    met = sent.join(other, (F.col("tile") == F.col("_t")) & (F.col("r2") == F.col("_r")) & (F.col("c2") == F.col("_c")) & (F.col("v") == F.col("_v")))
    return met.where("x <> y").select("tile", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def graph_components(edges: DataFrame) -> DataFrame:
    """(tile, node, root) of the nodes of edges (tile, a, b): the least node of each component.

    In each round every root that has a smaller neighbour is hooked to the least one; chains of hooks are halved until they
    lead to roots, and the edges between roots that are left go to the next round. At least half of the roots of a component
    that is not done are hooked, so rounds grow with the logarithm of its size.
    """
    labels = edges.select("tile", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        hooks = kept(edges.groupBy("tile", F.greatest("a", "b").alias("x")).agg(F.min(F.least("a", "b")).alias("to")), "hooks")
        while True:
            above = hooks.select(F.col("tile").alias("_t"), F.col("x").alias("_x"), F.col("to").alias("_to"))
            shorter = kept(hooks.join(above, (F.col("tile") == F.col("_t")) & (F.col("to") == F.col("_x")), "left").select("tile", "x", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "hooks")
            hooks = shorter.drop("moved")
            if shorter.where("moved").isEmpty():
                break
        labels = kept(_moved(labels, hooks, "root"), "roots")
        edges = kept(_moved(_moved(edges, hooks, "a"), hooks, "b").where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return labels


def _moved(rows: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    """Rows with a column's node replaced by what it is hooked to."""
    to = hooks.select(F.col("tile").alias("_t"), F.col("x").alias("_x"), F.col("to").alias("_to"))
    joined = rows.join(to, (F.col("tile") == F.col("_t")) & (F.col(column) == F.col("_x")), "left")
    return joined.select(*[F.coalesce("_to", c).alias(c) if c == column else F.col(c) for c in rows.columns])


def component_sizes(mask: DataFrame, connectivity: int = 4, block: int = SETTINGS.block) -> DataFrame:
    """(tile, root_r, root_c, n) of the components of value 1."""
    return components(mask.where("v = 1"), connectivity, block).groupBy("tile", "root_r", "root_c").agg(F.count("*").alias("n"))


def sieve_cells(r: np.ndarray, c: np.ndarray, v: np.ndarray, least: int, connectivity: int) -> np.ndarray:
    """Values after components of fewer than ``least`` cells have taken the value of their largest neighbour.

    A component whose largest neighbour is below ``least`` too stays as it is; of neighbours of one size the first in scan
    order counts.
    """
    if not len(r):
        return v.copy()
    order = np.lexsort((c, r))
    values = v[order]
    i, j = touching(r[order], c[order], connectivity)
    same = values[i] == values[j]
    root = united(len(order), i[same], j[same])
    size = np.bincount(root, minlength=len(order))
    # Pairs of neighbouring components with the small one first, the best neighbour of each in front.
    x, y = np.concatenate([root[i[~same]], root[j[~same]]]), np.concatenate([root[j[~same]], root[i[~same]]])
    small = size[x] < least
    x, y = x[small], y[small]
    best = np.lexsort((y, -size[y], x))
    x, y = x[best], y[best]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    x, y = x[first], y[first]
    becomes = np.arange(len(order))
    becomes[x[size[y] >= least]] = y[size[y] >= least]
    out = np.empty_like(v)
    out[order] = values[becomes[root]]
    return out


def sieve(mask: DataFrame, least: int = SETTINGS.sieve_pixels, connectivity: int = 8, block: int = SETTINGS.block) -> DataFrame:
    """The mask (tile, r, c, v) with small regions of either value merged into their largest neighbour, as ``sieve_cells`` does.

    Regions are those of ``components``, so a tile may have any size. Only cells of small regions look at their neighbours.
    """
    cells = labelled(mask, connectivity, block)
    sizes = kept(cells.groupBy("tile", "root").agg(F.count("*").alias("n"), F.first("v").alias("v")), "sizes")
    small = sizes.where(F.col("n") < least).select(F.col("tile").alias("_t"), F.col("root").alias("x"))
    around = [(a * dr, a * dc) for dr, dc in AROUND[connectivity] for a in (1, -1)]
    steps = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in around]))
    sent = cells.join(small, (F.col("tile") == F.col("_t")) & (F.col("root") == F.col("x"))).select("_t", "x", "r", "c", steps.alias("s")).select("_t", "x", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c")).distinct()
    met = sent.join(cells.select(F.col("tile").alias("_t"), "r", "c", F.col("root").alias("y")), ["_t", "r", "c"]).where("x <> y").select("_t", "x", "y").distinct()
    rated = met.join(sizes.select(F.col("tile").alias("_t"), F.col("root").alias("y"), "n", "v"), ["_t", "y"])
    best = rated.groupBy("_t", "x").agg(F.max(F.struct("n", (-F.col("y")).alias("first"), "v")).alias("best")).where(F.col("best.n") >= least).select("_t", "x", F.col("best.v").alias("_v"))
    return cells.join(best, (F.col("tile") == F.col("_t")) & (F.col("root") == F.col("x")), "left").select("tile", "r", "c", F.coalesce("_v", "v").alias("v"))


def adjacency(mask: DataFrame) -> DataFrame:
    """Pairs of cells of value 1 that touch by a side, each once: equi-joins on the shifted key."""
    ones = mask.where("v = 1").select("tile", "r", "c")
    steps = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    moved = ones.select("tile", "r", "c", steps.alias("s")).select("tile", "r", "c", (F.col("r") + F.col("s.dr")).alias("r2"), (F.col("c") + F.col("s.dc")).alias("c2"))
    other = ones.select(F.col("tile").alias("_t"), F.col("r").alias("_r"), F.col("c").alias("_c"))
    return moved.join(other, (F.col("tile") == F.col("_t")) & (F.col("r2") == F.col("_r")) & (F.col("c2") == F.col("_c")), "left_semi")


def boundary_edges(mask: DataFrame) -> DataFrame:
    """(tile, r1, c1, r2, c2) of cell sides between value 1 and anything else, directed with the cell on the right."""
    return sides(mask.where("v = 1").withColumn("root", F.lit(0))).drop("root")


def sides(cells: DataFrame) -> DataFrame:
    """(tile, root, r1, c1, r2, c2) of the sides of cells (tile, r, c, root) that no two of them share, directed with the cell on the right."""
    # An edge of each side; a side that two cells share comes up in both directions and cancels out.
    four = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(x).alias("x"), F.lit(y).alias("y")) for a, b, x, y in ((0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0))])
    all_ = cells.select("tile", "root", "r", "c", F.explode(four).alias("s")).select("tile", "root", (F.col("r") + F.col("s.a")).alias("r1"), (F.col("c") + F.col("s.b")).alias("c1"), (F.col("r") + F.col("s.x")).alias("r2"), (F.col("c") + F.col("s.y")).alias("c2"))
    low, high = (F.struct(F.col(f"r{k}").alias("r"), F.col(f"c{k}").alias("c")) for k in (1, 2))
    lone = all_.groupBy("tile", F.least(low, high).alias("p"), F.greatest(low, high).alias("q")).agg(F.count("*").alias("n"), F.first(low).alias("from"), F.first(high).alias("to"), F.first("root").alias("root")).where("n = 1")
    return lone.select("tile", "root", F.col("from.r").alias("r1"), F.col("from.c").alias("c1"), F.col("to.r").alias("r2"), F.col("to.c").alias("c2"))


def followers(r1: np.ndarray, c1: np.ndarray, r2: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """For each directed edge the one that follows it, or -1; edges are sorted by where they start.

    Where two rings touch at a corner a ring turns right, so that it keeps to its own cells.
    """
    n = len(r1)
    width = int(max(c1.max(), c2.max())) + 2
    start, end = r1 * width + c1, r2 * width + c2
    low, high = np.searchsorted(start, end), np.searchsorted(start, end, side="right")
    dr, dc = r2 - r1, c2 - c1
    right = (r2 + dc) * width + (c2 - dr)  # where a right turn leads
    after = np.where((high - low > 1) & (end[np.minimum(low + 1, n - 1)] == right), low + 1, low)
    after = np.where((high - low > 1) & (end[np.minimum(low, n - 1)] == right), low, after)
    return np.where(high > low, after, -1)


def chain_places(after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the first edge of its chain, the place in the chain, whether the chain is a ring) of each edge.

    A ring begins with its least edge, an open chain with the edge that follows none. Chains are numbered and measured by pointer
    doubling, in a number of steps that grows with the logarithm of the longest one.
    """
    n = len(after)
    index = np.arange(n)
    headless = np.ones(n, bool)
    headless[after[after >= 0]] = False
    heads, tails = np.flatnonzero(headless), np.flatnonzero(after < 0)
    # The end of an open chain is led back to its begin, to be found out by the doubling.
    back, jump = np.where(headless, index, -1), np.full(n, -1)
    jump[after[after >= 0]] = np.flatnonzero(after >= 0)
    while len(tails) and (back[tails] < 0).any():
        behind = np.where(jump >= 0, jump, index)
        back = np.where(back >= 0, back, back[behind])
        jump = np.where(jump >= 0, jump[behind], -1)
    closed = after.copy()
    closed[tails] = back[tails]
    least, jump = index.copy(), closed.copy()
    while True:
        found = np.minimum(least, least[jump])
        if (found == least).all():
            break
        least, jump = found, jump[jump]
    begin, ring = index.copy(), np.ones(n, bool)
    begin[least[heads]] = heads
    ring[least[heads]] = False
    first, ring = begin[least], ring[least]
    # Steps from each edge on to the first one, which stays where it is.
    steps = (index != first).astype(np.int64)
    jump = np.where(index == first, index, closed)
    while True:
        more = steps[jump]
        if not more.any():
            break
        steps, jump = steps + more, jump[jump]
    length = np.bincount(first, minlength=n)
    return first, (length[first] - steps) % length[first], ring


def rings_of(r1: np.ndarray, c1: np.ndarray, r2: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ring, row, col) of the corners of closed rings, ring by ring in order, each from its least corner back to it."""
    first, place, _ = chain_places(followers(r1, c1, r2, c2))
    order = np.lexsort((place, first))
    ring, r, c, dr, dc = first[order], r1[order], c1[order], (r2 - r1)[order], (c2 - c1)[order]
    head = np.concatenate([[True], ring[1:] != ring[:-1]])
    corner = head | np.concatenate([[True], (dr[1:] != dr[:-1]) | (dc[1:] != dc[:-1])])
    tail = np.flatnonzero(np.concatenate([head[1:], [True]]))
    # The first corner once more behind each ring.
    place_of = np.concatenate([np.flatnonzero(corner), tail + 0.5])
    again = np.concatenate([np.flatnonzero(corner), np.flatnonzero(head)])
    at = again[np.argsort(place_of, kind="stable")]
    return ring[at], r[at], c[at]


def chains(edges: DataFrame, block: int) -> DataFrame:
    """Chains of the edges (tile, root, r1, c1, r2, c2) that begin in a block of corners, each with its corners in order.

    (tile, root, id, ring, r1, c1, dr1, dc1, r2, c2, dr2, dc2, n, area, corners): where and in which direction the chain begins and
    ends, its edges, the sum of its cross products and the corners where it turns, its begin among them. A chain that leaves
    its block is open, and goes on with one that begins where it ends.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r1", "c1", "r2", "c2"])
        r1, c1, r2, c2 = (pdf[k].to_numpy() for k in ("r1", "c1", "r2", "c2"))
        first, place, closed = chain_places(followers(r1, c1, r2, c2))
        order = np.lexsort((place, first))
        chain, dr, dc = first[order], (r2 - r1)[order], (c2 - c1)[order]
        head = np.concatenate([[True], chain[1:] != chain[:-1]])
        turn = np.concatenate([[True], (dr[1:] != dr[:-1]) | (dc[1:] != dc[:-1])]) | head
        begin = np.flatnonzero(head)
        end = np.concatenate([begin[1:], [len(order)]]) - 1
        cross = np.add.reduceat((c1 * r2 - c2 * r1)[order], begin)
        at = np.split(np.flatnonzero(turn), np.searchsorted(np.flatnonzero(turn), begin[1:]))
        a, b = order[begin], order[end]
        corners = [[{"r": x, "c": y} for x, y in zip(r1[order[k]].tolist(), c1[order[k]].tolist(), strict=True)] for k in at]
        return pd.DataFrame({
            "tile": pdf.tile.iloc[0], "root": pdf.root.to_numpy()[a], "id": ((r1[a] << 31) + c1[a] << 2) + (r2[a] - r1[a]) + 2 * (c2[a] - c1[a]) + 2, "ring": closed[a], "r1": r1[a], "c1": c1[a], "dr1": dr[begin], "dc1": dc[begin],
            "r2": r2[b], "c2": c2[b], "dr2": dr[end], "dc2": dc[end], "n": end - begin + 1, "area": cross, "corners": corners,
        })

    kind = edges.schema["tile"].dataType.simpleString()
    placed = edges.withColumns({"br": F.floor(F.col("r1") / block), "bc": F.floor(F.col("c1") / block)})
    return placed.groupBy("tile", "br", "bc").applyInPandas(run, f"tile {kind}, root bigint, id bigint, ring boolean, r1 bigint, c1 bigint, dr1 bigint, dc1 bigint, r2 bigint, c2 bigint, dr2 bigint, dc2 bigint, n bigint, area bigint, corners array<struct<r:bigint,c:bigint>>")


def joined_chains(open_: DataFrame) -> DataFrame:
    """Open chains with their ring, their place in it (in edges from the ring's first chain on) and whether they begin with a turn.

    A chain goes on with the one that begins where it ends, by a right turn where there are two. Rings of chains are numbered and
    measured by pointer doubling, with a join for each step; steps grow with the logarithm of the chains of the longest ring.
    """
    a, b = open_, open_.select(F.col("tile").alias("_t"), F.col("r1").alias("_r"), F.col("c1").alias("_c"), F.col("dr1").alias("_dr"), F.col("dc1").alias("_dc"), F.col("id").alias("next"))
    right = ((F.col("_dr") == F.col("dc2")) & (F.col("_dc") == -F.col("dr2"))).cast("int")
    turns = ((F.col("_dr") != F.col("dr2")) | (F.col("_dc") != F.col("dc2"))).alias("turn")
    met = a.join(b, (F.col("tile") == F.col("_t")) & (F.col("r2") == F.col("_r")) & (F.col("c2") == F.col("_c"))).groupBy("tile", "id", "n").agg(F.max(F.struct(right.alias("right"), "next", turns)).alias("to"))
    link = kept(met.select("tile", "id", "n", F.col("to.next").alias("next"), F.col("to.turn").alias("turn")), "links")

    def behind(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(F.col("tile").alias("_t"), F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])

    ahead = lambda rows, *columns: rows.join(behind(rows, *columns), (F.col("tile") == F.col("_t")) & (F.col("jump") == F.col("_id")))
    found = link.select("tile", "id", F.col("next").alias("jump"), F.col("id").alias("head"))
    while True:
        found = kept(ahead(found, "jump", "head").select("tile", "id", F.col("_jump").alias("jump"), F.least("head", "_head").alias("head"), (F.col("_head") < F.col("head")).alias("less")), "heads")
        if found.where("less").isEmpty():
            break
    headed = link.join(found.select("tile", "id", "head"), ["tile", "id"])
    # Edges from each chain on to the ring's first one, which leads to itself.
    left = headed.select("tile", "id", "head", F.when(F.col("next") == F.col("head"), F.col("head")).otherwise(F.col("next")).alias("jump"), F.col("n").alias("gone"))
    left = left.withColumns({"jump": F.when(F.col("id") == F.col("head"), F.col("id")).otherwise(F.col("jump")), "gone": F.when(F.col("id") == F.col("head"), 0).otherwise(F.col("gone"))})
    left = kept(left, "left")
    while not left.where("jump <> head").isEmpty():
        left = kept(ahead(left, "jump", "gone").select("tile", "id", "head", F.col("_jump").alias("jump"), (F.col("gone") + F.col("_gone")).alias("gone")), "left")
    length = headed.groupBy("tile", "head").agg(F.sum("n").alias("length"))
    placed = left.join(length, ["tile", "head"]).select("tile", "id", "head", F.when(F.col("gone") == 0, 0).otherwise(F.col("length") - F.col("gone")).alias("place"))
    turned = link.select(F.col("tile"), F.col("next").alias("id"), "turn")
    return open_.join(placed, ["tile", "id"]).join(turned, ["tile", "id"])


def trace_rings(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of (row, col) corners from directed edges; where two touch at a corner a ring turns right, so that it
    keeps to its own cells."""
    if not edges:
        return []
    ring, r, c = rings_of(*(np.array(x) for x in zip(*sorted(edges), strict=True)))
    cuts = np.flatnonzero(ring[1:] != ring[:-1]) + 1
    return [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(np.split(r, cuts), np.split(c, cuts), strict=True)]


def area(ring: list[tuple[int, int]]) -> float:
    """Signed area of a ring of (row, col): positive for outer rings as traced here."""
    return sum(c1 * r2 - c2 * r1 for (r1, c1), (r2, c2) in zip(ring, ring[1:], strict=False)) / 2


def polygons(mask: DataFrame, block: int = SETTINGS.block) -> DataFrame:
    """(tile, root_r, root_c, rings, outer_area, net_area, holes) of the 4-connected regions of value 1.

    Rings are (row, col) corners from the least one back to it, the outer ring of a region first and then its holes by size.
    Edges are chained within blocks, and chains that leave their block are joined to rings.
    """
    cells = labelled(mask.where("v = 1"), 4, block)
    found = kept(chains(sides(cells), block), "chains")
    columns = ["tile", "root", "id", "n", "area", "corners"]
    whole = found.where("ring").select(*columns, F.col("id").alias("head"), F.lit(0).cast("bigint").alias("place"), F.lit(True).alias("turn"))
    open_ = found.where("not ring")
    if not open_.isEmpty():
        whole = whole.unionByName(joined_chains(open_).select(*columns, "head", "place", "turn"))
    # A chain that goes straight on from the one before has no corner where it begins.
    turning = F.when(F.col("turn"), F.col("corners")).otherwise(F.slice("corners", 2, F.size("corners")))
    ring = whole.groupBy("tile", "root", "head").agg(F.sum("area").alias("cross"), F.sort_array(F.collect_list(F.struct("place", turning.alias("corners")))).alias("parts"))
    ring = ring.select("tile", "root", (F.col("cross") / 2).alias("area"), F.flatten(F.transform("parts", lambda p: p["corners"])).alias("points"))
    at = F.array_position("points", F.array_min("points")).cast("int")
    ring = ring.withColumn("at", at).select("tile", "root", "area", F.concat(F.expr("slice(points, at, size(points))"), F.expr("slice(points, 1, at)")).alias("points"))
    each = ring.groupBy("tile", "root").agg(F.sort_array(F.collect_list(F.struct((-F.col("area")).alias("order"), "points"))).alias("rings"), F.max("area").alias("outer_area"), F.sum("area").alias("net_area"), (F.count("*") - 1).cast("int").alias("holes"))
    return each.select("tile", F.shiftright("root", 32).alias("root_r"), F.col("root").bitwiseAND(F.lit((1 << 32) - 1)).alias("root_c"), F.transform("rings", lambda x: x["points"]).alias("rings"), "outer_area", "net_area", "holes")
