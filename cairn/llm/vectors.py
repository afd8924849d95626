"""Embedding near-dedup: dual traversal of cover trees (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, store
from .graph import connected_components

_UNIT = "id long, dim int, unit binary"
_ROW = "rid long, id long, w long, unit binary"
_ROUTED = f"{_ROW}, node long, gap double"
_CENTRES = "node long, child long, centre binary"
_REFINED = f"g long, b int, {_ROW}, cell int, far double, centre boolean, load long, hub long"
_JUDGED = "kind int, g long, b int, cell int, a long, c long"
_FOUND = "rid long, a long, c long, n long"
_FAN = 1024  # children a node at most, and the base of node numbers
_SLACK = 1e-6


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Chord lengths between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


class CoverTree:
    """Nested levels of centres with halving radii over unit vectors.

    A level's centres are among those of the next; each is at most the level's radius from its
    parent, and two centres of a level are more than its radius apart. Level 0 has one centre. Where
    ``most`` centres are reached, the last level stays partial: its centres are still apart, but
    points may lie farther from them than its radius. Farthest points come first, so a partial level
    has the centres that matter most. Levels end at radius ``least``.
    """

    def __init__(self, points: np.ndarray, most: int, least: float = 1e-3) -> None:
        self.points = points
        self.levels: list[np.ndarray] = []  # indices of centres
        self.parents: list[np.ndarray] = []  # position in the level above
        self.radii: list[float] = []
        chosen = list(range(min(1, len(points))))
        radius = 2.0
        near = _distances(points, points[chosen])[:, 0] if chosen else np.zeros(0)
        while chosen:
            last = len(self.levels[-1]) if self.levels else 0
            if len(chosen) > last:
                now = np.array(chosen)
                self.parents.append(_distances(points[now], points[self.levels[-1]]).argmin(1) if last else np.zeros(1, np.int64))
                self.levels.append(now)
                self.radii.append(radius)
            radius /= 2
            if len(chosen) >= most or radius < least:
                break
            while len(chosen) < most and near[k := int(near.argmax())] > radius:
                chosen.append(k)
                near = np.minimum(near, _distances(points, points[k : k + 1])[:, 0])

    @property
    def leaves(self) -> np.ndarray:
        return self.points[self.levels[-1]]

    def order(self) -> np.ndarray:
        """Leaves depth-first, so that near ones are neighbours."""
        path = np.arange(len(self.levels[-1]))[:, None]
        for k in range(len(self.levels) - 1, 0, -1):
            path = np.hstack([self.parents[k][path[:, :1]], path])
        return np.lexsort(path.T[::-1])

    def near_pairs(self, far: np.ndarray, reach: float) -> np.ndarray:
        """Leaf pairs that may hold points within ``reach``, by dual descent from the root.

        ``far`` has the leaves' exact covering radii. A node pair is pruned where the centres'
        distance exceeds both covering radii plus ``reach``.
        """
        radii = [far]
        for k in range(len(self.levels) - 1, 0, -1):
            up = np.zeros(len(self.levels[k - 1]))
            gap = np.sqrt(np.maximum(2 - 2 * (self.points[self.levels[k]] * self.points[self.levels[k - 1]][self.parents[k]]).sum(1), 0))
            np.maximum.at(up, self.parents[k], gap + radii[0])
            radii.insert(0, up)
        pairs = np.zeros((1, 2), np.int64) if len(self.levels[0]) else np.zeros((0, 2), np.int64)
        for k, level in enumerate(self.levels):
            if k:
                order = np.argsort(self.parents[k], kind="stable")
                size = np.bincount(self.parents[k], minlength=len(self.levels[k - 1]))
                start = np.cumsum(size) - size
                i, j = pairs[:, 0], pairs[:, 1]
                count = size[i] * size[j]
                row = np.repeat(np.arange(len(pairs)), count)
                at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                pairs = np.stack([order[start[i][row] + at // size[j][row]], order[start[j][row] + at % size[j][row]]], 1)
                pairs = np.unique(np.sort(pairs, 1), axis=0)
            kept, x = [], self.points[level]
            for s in range(0, len(pairs), 1 << 17):
                p = pairs[s : s + (1 << 17)]
                gap = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x[p[:, 0]], x[p[:, 1]]), 0))
                kept.append(p[gap <= radii[k][p[:, 0]] + radii[k][p[:, 1]] + reach + 1e-9])
            pairs = np.concatenate(kept) if kept else pairs
        return pairs


def refine(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a block: each row's cell, the row that is each cell's centre, and exact covering radii.

    The cells are the leaves of a cover tree over all rows down to a third of ``reach``, at most a
    quarter as many as rows; beyond that they only stay wider.
    """
    tree = CoverTree(x, max(1, len(x) // 4), reach / 3)
    centre = tree.levels[-1]
    d = _distances(x, x[centre])
    d[centre, np.arange(len(centre))] = 0
    cell = d.argmin(1)
    cell[centre] = np.arange(len(centre))
    far = np.zeros(len(centre))
    np.maximum.at(far, cell, d[np.arange(len(x)), cell])
    return cell, centre, far


def tight(far: np.ndarray, reach: float) -> np.ndarray:
    """Cells all of whose rows lie within ``reach`` of each other."""
    return 2 * far <= reach - _SLACK


def judge(x: np.ndarray, rx: np.ndarray, y: np.ndarray, ry: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For every pair of cells (centres, radii): whether all rows of both are linked, and whether some may be.

    The first only counts between tight cells, the second excludes the first. Values near a
    border are taken from a sum whose rounding doesn't depend on the other cells, so that every
    task decides a pair alike.
    """
    gap = _distances(x, y)
    spread = rx[:, None] + ry[None, :]
    both = tight(rx, reach)[:, None] & tight(ry, reach)[None, :]
    for border in (reach - _SLACK - spread, reach + 1e-9 + spread):
        i, j = np.nonzero(np.abs(gap - border) < 1e-9)
        if len(i):
            gap[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(1))
    inside = both & (gap <= reach - _SLACK - spread)
    return inside, ~inside & (gap <= reach + 1e-9 + spread)


def _links(x: np.ndarray, y: np.ndarray, threshold: float, leaf: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors with cosine >= threshold. Leaf blocks are matrix products in
    single precision with a margin; what comes near is decided in double precision."""
    fx, fy = x.astype(np.float32), y.astype(np.float32)
    for a in range(0, len(x), leaf):
        i, j = np.nonzero(fx[a : a + leaf] @ fy.T >= threshold - 1e-4)
        i += a
        ok = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 16):
            part = slice(s, s + (1 << 16))
            ok[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= threshold
        yield i[ok], j[ok]


def open_links(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, may: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows of the cell pairs that ``may`` hold some. Where most cells face each other one
    product does; else each left cell meets only the rows of its open right cells."""
    if may.mean() > 0.25:
        for i, j in _links(x, y, threshold):
            ok = may[cx[i], cy[j]]
            yield i[ok], j[ok]
        return
    left, right = np.argsort(cx, kind="stable"), np.argsort(cy, kind="stable")
    starts = np.searchsorted(cx[left], np.arange(len(may) + 1))
    ends = np.searchsorted(cy[right], np.arange(may.shape[1] + 1))
    for c in np.flatnonzero(may.any(1) & (np.diff(starts) > 0)):
        i = left[starts[c] : starts[c + 1]]
        j = np.concatenate([right[ends[k] : ends[k + 1]] for k in np.flatnonzero(may[c])])
        for a, b in _links(x[i], y[j], threshold):
            yield i[a], j[b]


def _units(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def _split(rows: DataFrame, big: DataFrame, dim: int, sample: int, fan: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows of big nodes sent to children, and the children's centres. Each node's children come from a
    bounded sample of its rows; then its rows stream through salted, sorted partitions, each headed
    by the node's centres, so a node of any size needs the memory of its centres alone."""
    mine = rows.join(big.select("node", "n"), "node")
    drawn = mine.where(F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(1_000_000)) < F.greatest(F.lit(1), (F.lit(1_000_000.0 * sample) / F.col("n")).cast("long"))).select("node", "unit")

    def centres(table: pa.Table) -> pa.Table:
        x = _units(table.column("unit"), dim)
        tree = CoverTree(x, fan)
        leaves = tree.leaves[tree.order()]
        node = table.column("node")[0].as_py()
        return pa.table([pa.array([node] * len(leaves), pa.int64()), pa.array(node * _FAN + np.arange(len(leaves))), pa.array([v.tobytes() for v in leaves], pa.binary())], schema=arrow_schema(_CENTRES))

    made = store(drawn.groupBy("node").applyInArrow(centres, _CENTRES), "centres")
    split = mine.join(made.select("node").distinct(), "node", "left_semi").withColumn("salts", F.ceil(F.col("n") / (16 * block)))
    heads = made.join(big.select("node", F.ceil(F.col("n") / (16 * block)).alias("salts")), "node").select("node", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rid"), F.col("child").alias("id"), F.lit(None).cast("long").alias("w"), F.col("centre").alias("unit"))
    body = split.select("node", F.pmod(F.xxhash64("rid", F.lit(5)), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "rid", "id", "w", "unit")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, centre = None, [], []
        for b in batches:
            key = list(zip(b.column("node").to_pylist(), b.column("salt").to_pylist(), b.column("kind").to_pylist()))
            edges = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                part, (node, salt, kind) = b.slice(s, e - s), key[s]
                if kind == 0:
                    if now != (node, salt):
                        now, ids, centre = (node, salt), [], []
                    ids += part.column("id").to_pylist()
                    centre += part.column("unit").to_pylist()
                    continue
                y = np.frombuffer(b"".join(centre), np.float64).reshape(-1, dim)
                d = _distances(_units(part.column("unit"), dim), y)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "id", "w", "unit")), pa.array(np.array(ids, np.int64)[at]), pa.array(d[np.arange(len(d)), at])], schema=arrow_schema(_ROUTED))

    sent = heads.unionByName(body).repartition("node", "salt").sortWithinPartitions("node", "salt", "kind", "id")
    return store(sent.mapInArrow(route, _ROUTED), "split"), made


def _leaves(own: DataFrame, dim: int, count: int, reach: float, sample: int, centres: int, block: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their leaf, leaves (node, parent, n), and leaf pairs (x, y) that may hold links."""
    spark = own.sparkSession
    part = F.pmod(F.xxhash64("rid"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / count) + 1)
    taken = own.where(part).orderBy("rid").limit(2 * sample).select("unit").collect() or [own.first()]
    points = np.array([np.frombuffer(r.unit, np.float64) for r in taken])
    tree = CoverTree(points, max(1, min(centres, -(-count // 16))))
    order = tree.order()
    rank = np.argsort(order)
    shared = spark.sparkContext.broadcast(tree.leaves[order])  # at most ``centres`` vectors

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_units(b.column("unit"), dim), shared.value)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "id", "w", "unit")), pa.array(_FAN + at), pa.array(d[np.arange(len(d)), at])], schema=arrow_schema(_ROUTED))

    rows = store(own.select("rid", "id", "w", "unit").mapInArrow(route, _ROUTED), "cells")
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.max("gap").alias("far"))
    far = np.zeros(len(order))
    for r in sizes.collect():  # at most ``centres``
        far[order[r.node - _FAN]] = r.far
    near = rank[tree.near_pairs(far, reach)] + _FAN
    pairs = spark.createDataFrame(pa.table({"x": near.min(1), "y": near.max(1)}))
    leaves = sizes.withColumn("parent", F.lit(1).cast("long"))
    for _ in range(depth):
        big = leaves.where((F.col("n") > block) & (F.col("far") > reach / 6))
        if not big.limit(1).count():
            break
        big = store(big, "big")
        moved, made = _split(rows, big, dim, sample, min(centres, _FAN), block)
        rows = rows.join(big.select("node"), "node", "left_anti").select(moved.columns).unionByName(moved)
        young = moved.groupBy("node").agg(F.count("*").alias("n"), F.max("gap").alias("far")).join(made.select(F.col("child").alias("node"), F.col("node").alias("parent"), "centre"), "node")
        grown = store(young, "young")
        leaves = store(leaves.join(big.select("node"), "node", "left_anti").select("node", "n", "far", "parent").unionByName(grown.select("node", "n", "far", "parent")), "leaves")
        pairs = store(_grow(pairs, big, grown, dim, reach), "pairs")
    return rows, leaves, pairs


def _grow(pairs: DataFrame, split: DataFrame, grown: DataFrame, dim: int, reach: float) -> DataFrame:
    """Pairs after nodes were split: both children where both sides were, pruned by their centres and
    radii. A pair with one side split passes on to that side's children unpruned."""
    for side in ("x", "y"):
        kids = grown.select(F.col("parent").alias(side), F.col("node").alias(f"{side}k"), F.col("centre").alias(f"{side}c"), F.col("far").alias(f"{side}f"))
        pairs = pairs.join(split.select(F.col("node").alias(side), F.lit(True).alias(f"{side}s")), side, "left").join(kids, side, "left").where(F.col(f"{side}s").isNull() | F.col(f"{side}k").isNotNull())
    pairs = pairs.select(F.coalesce("xk", "x").alias("x"), F.coalesce("yk", "y").alias("y"), "xc", "xf", "yc", "yf")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            at = np.flatnonzero(np.array(b.column("xc").is_valid()) & np.array(b.column("yc").is_valid()))
            if len(at):
                t = b.take(pa.array(at))
                gap = np.sqrt(((_units(t.column("xc"), dim) - _units(t.column("yc"), dim)) ** 2).sum(1))
                ok[at] = gap <= t.column("xf").to_numpy() + t.column("yf").to_numpy() + reach + 1e-9
            x, y = b.column("x").to_numpy()[ok], b.column("y").to_numpy()[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    return pairs.mapInArrow(prune, "x long, y long").distinct()


def _near_of_length(own: DataFrame, dim: int, count: int, threshold: float, sample: int, centres: int, block: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(rid, n) with the weight of a row's partners, and edges (a, c), among vectors of one length."""
    reach = float(np.sqrt(2 - 2 * threshold))
    rows, leaves, pairs = _leaves(own, dim, count, reach, sample, centres, block, depth)
    # siblings fill blocks together in tree order; a leaf above the size is cut by a hash
    before = F.sum(F.when(F.col("n") <= block, F.col("n")).otherwise(0)).over(Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    small = F.col("n") <= block
    placed = leaves.select("node", F.when(small, F.col("parent")).otherwise(F.col("node")).alias("g"), F.when(small, F.floor(F.coalesce(before, F.lit(0)) / block)).otherwise(0).cast("int").alias("at"), F.when(small, 1).otherwise(F.ceil(F.col("n") / block)).cast("int").alias("parts"))
    placed = store(placed, "placed")  # at most ``centres`` siblings meet in a window
    blocked = rows.join(placed, "node").select("g", (F.col("at") + F.pmod(F.xxhash64("rid", F.lit(7)), F.col("parts"))).cast("int").alias("b"), "rid", "id", "w", "unit")

    def cells(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        x = _units(t.column("unit"), dim)
        cell, centre, far = refine(x, reach)
        w, ids = t.column("w").to_numpy(), t.column("id").to_numpy()
        is_centre = np.zeros(len(x), bool)
        is_centre[centre] = True
        load = np.bincount(cell, w, len(centre)).astype(np.int64)[cell]
        hub = pa.array(ids[centre][cell], pa.int64(), mask=~tight(far, reach)[cell])
        return pa.table([*(t.column(c) for c in ("g", "b", "rid", "id", "w", "unit")), pa.array(cell, pa.int32()), pa.array(far[cell]), pa.array(is_centre), pa.array(load), hub], schema=arrow_schema(_REFINED))

    refined = store(blocked.groupBy("g", "b").applyInArrow(cells, _REFINED), "refined")
    sides = pairs
    for side in ("x", "y"):
        sides = sides.join(placed.select(F.col("node").alias(side), F.col("g").alias(f"g{side}"), F.explode(F.expr("sequence(at, at + parts - 1)")).alias(f"b{side}")), side)
    swap = (F.col("gx") > F.col("gy")) | (F.col("gx") == F.col("gy")) & (F.col("bx") > F.col("by"))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    met = store(sides.select(pick("gx", "gy").alias("gx"), pick("bx", "by").alias("bx"), pick("gy", "gx").alias("gy"), pick("by", "bx").alias("by")).distinct(), "met")
    key = ["gx", "bx", "gy", "by"]
    one = (F.col("gx") == F.col("gy")) & (F.col("bx") == F.col("by"))
    ends = F.array(F.struct(F.col("gx").alias("g"), F.col("bx").alias("b"), F.lit(0).alias("side")), F.struct(F.col("gy").alias("g"), F.col("by").alias("b"), F.lit(1).alias("side")))
    ends = met.select(*key, F.explode(F.when(one, F.slice(ends, 1, 1)).otherwise(ends)).alias("e")).select(*key, "e.*")

    def two(t: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
        same = t.column("gx")[0] == t.column("gy")[0] and t.column("bx")[0] == t.column("by")[0]
        side = t.column("side").to_numpy()
        return same, np.flatnonzero(side == 0), np.flatnonzero(side == 0) if same else np.flatnonzero(side == 1)

    def weigh(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        same, i, j = two(t)
        x, far, load, ids = _units(t.column("unit"), dim), t.column("far").to_numpy(), t.column("load").to_numpy(), t.column("id").to_numpy()
        inside, may = judge(x[i], far[i], x[j], far[j], reach)
        sent = np.zeros(len(x), bool)
        sent[i[may.any(1)]] = True
        sent[j[may.any(0)]] = True
        extra = np.zeros(len(x), np.int64)
        extra[i] += inside.astype(np.int64) @ load[j]
        if not same:
            extra[j] += inside.T.astype(np.int64) @ load[i]
        p, q = np.nonzero(inside)
        g, b, cell = (t.column(c).to_numpy() for c in ("g", "b", "cell"))
        edges = _forest(ids[i], ids[j], p, q)
        s, m = np.flatnonzero(sent), np.flatnonzero(extra)
        n, none = len(s) + len(m) + len(edges), [None] * len(edges)
        kind = np.repeat([0, 1, 2], [len(s), len(m), len(edges)]).astype(np.int32)
        at = np.concatenate([s, m])
        cols = [pa.array(kind), *(pa.array([*v[at].tolist(), *none], k) for v, k in ((g, pa.int64()), (b, pa.int32()), (cell, pa.int32())))]
        a = pa.array([*[None] * len(s), *extra[m].tolist(), *[e[0] for e in edges]], pa.int64())
        c = pa.array([*[None] * (n - len(edges)), *[e[1] for e in edges]], pa.int64())
        own = [pa.array([t.column(k)[0].as_py()] * n, v) for k, v in zip(key, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))]
        return pa.table([*own, *cols, a, c], schema=arrow_schema(f"gx long, bx int, gy long, by int, {_JUDGED}"))

    heads = refined.where("centre").select("g", "b", "cell", "id", "unit", "far", "load").join(ends, ["g", "b"])
    judged = store(heads.groupBy(*key).applyInArrow(weigh, f"gx long, bx int, gy long, by int, {_JUDGED}"), "judged")
    sent = judged.where("kind = 0").select(*key, "g", "b", "cell").join(ends, [*key, "g", "b"])

    def compare(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        same, i, j = two(t)
        x, rid, ids, w = _units(t.column("unit"), dim), t.column("rid").to_numpy(), t.column("id").to_numpy(), t.column("w").to_numpy()
        cell, far, centre = t.column("cell").to_numpy(), t.column("far").to_numpy(), np.array(t.column("centre"))

        def side(k: np.ndarray):
            heads = k[centre[k]]
            heads = heads[np.argsort(cell[heads], kind="stable")]
            return x[heads], far[heads], np.searchsorted(cell[heads], cell[k])

        (cx, rx, at), (cy, ry, to) = side(i), side(j)
        _, may = judge(cx, rx, cy, ry, reach)
        n, edges = np.zeros(len(x), np.int64), []
        group = np.arange(len(x))
        for p, q in open_links(x[i], at, x[j], to, may, threshold):
            a, c = i[p], j[q]
            a, c = a[a != c], c[a != c]
            np.add.at(n, a, w[c])
            if not same:
                np.add.at(n, c, w[a])
            edges += _join(group, ids, a, c)
        some = np.flatnonzero(n)
        blank = [None] * len(some)
        return pa.table([pa.array([*rid[some].tolist(), *[None] * len(edges)], pa.int64()), pa.array([*blank, *[e[0] for e in edges]], pa.int64()), pa.array([*blank, *[e[1] for e in edges]], pa.int64()), pa.array([*n[some].tolist(), *[0] * len(edges)], pa.int64())], schema=arrow_schema(_FOUND))

    found = store(refined.join(sent, ["g", "b", "cell"]).select(*key, "side", "rid", "id", "w", "unit", "cell", "far", "centre").groupBy(*key).applyInArrow(compare, _FOUND), "links")
    inner = judged.where("kind = 1").groupBy("g", "b", "cell").agg(F.sum("a").alias("m"))
    per_row = refined.select("g", "b", "cell", "rid", F.when(F.col("hub").isNotNull(), -F.col("w")).otherwise(0).alias("self")).join(inner, ["g", "b", "cell"], "left").select("rid", (F.col("self") + F.coalesce("m", F.lit(0).cast("long"))).alias("n"))
    counts = per_row.unionByName(found.where("rid is not null").select("rid", "n")).groupBy("rid").agg(F.sum("n").alias("n"))
    edges = found.where("rid is null").select("a", "c").unionByName(judged.where("kind = 2").select("a", "c")).unionByName(refined.where("hub is not null and hub <> id").select(F.col("id").alias("a"), F.col("hub").alias("c")))
    return counts, edges


def _join(group: np.ndarray, ids: np.ndarray, a: np.ndarray, c: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest that the links (a, c) add; ``group`` is updated."""
    order = np.argsort(a, kind="stable")
    a, c = a[order], c[order]
    edges = []
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
    for s, e in zip(first, np.append(first[1:], len(a)) if len(a) else []):
        own, mates = group[a[s]], c[s:e]
        for g in np.unique(group[mates]):
            if g != own:
                edges.append((int(ids[a[s]]), int(ids[mates[group[mates] == g][0]])))
                group[group == g] = own
    return edges


def _forest(left: np.ndarray, right: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (left[p], right[q])."""
    return _join(np.arange(len(left) + len(right)), np.concatenate([left, right]), p, q + len(left))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, sample: int = 4096, centres: int = 1024, block: int = 4096, depth: int = 5) -> DataFrame:
    """All pairs with cosine >= ``threshold`` in double precision, as link counts and classes.

    1. Equal vectors become one with a weight, so copies are never paired.
    2. A cover tree over a bounded sample (``sample`` vectors, at most ``centres`` leaves, broadcast)
       routes every vector to its nearest leaf; covering radii are taken over all vectors. Leaves
       above ``block`` vectors are split again, each by a tree over a sample of its own, up to
       ``depth`` times; from there on nodes and pairs are tables. Dual traversal prunes node pairs
       whose distance exceeds both covering radii and the reach of a link.
    3. Leaves fill blocks of about ``block`` vectors, and each block is cut into the cells of a tree of
       its own, down to a third of the reach. The traversal goes on among the cells of surviving block
       pairs, by their centres alone: far cells are pruned, and cells that lie within reach of each
       other as a whole are counted as linked without a look at their vectors.
    4. Only vectors of cells that remain are sent to a block pair's task and compared. Tasks return
       counts and spanning forests of links, not pairs.

    All of it is exact; where nothing is near (high dimensions without structure) no bound prunes
    and step 4 compares all block pairs, in bounded tasks.

    Returns id_col, n_links, component_id, kept: one for every row. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
    different lengths. Every row is a vector of its own for n_links, but rows that share an id
    are one node in a class. A null id links with nothing (component_id null, kept true). Columns
    other than these two are not read.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    if not 1 <= centres <= _FAN:
        raise ValueError(f"centres must lie between 1 and {_FAN}")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, units = [], []
            for i, v in zip(b.column(0), b.column(1)):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and i.is_valid else np.zeros(0)
                top = np.abs(x).max() if len(x) else 0.0
                good = len(x) and np.isfinite(top) and top > 0
                dims.append(len(x) if good else 0)
                units.append((x / top / np.linalg.norm(x / top) + 0.0).tobytes() if good else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], schema=arrow_schema(_UNIT))

    rows = store(src.mapInArrow(unit, _UNIT).withColumn("rid", F.monotonically_increasing_id()).withColumn("h", F.sha2("unit", 256)), "unit")
    base = rows.select("id", "rid", "dim", "h")
    same = base.where("dim > 0").groupBy("dim", "h").agg(F.min("rid").alias("rep"), F.min("id").alias("low"), F.count("*").alias("w")).where("w > 1")
    copies = store(base.join(same, ["dim", "h"]).select("rid", "id", "rep", "low", "w"), "copies")
    reps = rows.drop("h").join(copies.select("rid", "rep", "w"), "rid", "left").where("rep is null or rep = rid").withColumn("w", F.coalesce("w", F.lit(1).cast("long")))
    counts = {r.dim: r["count"] for r in reps.where("dim > 0").groupBy("dim").count().orderBy("dim").limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError("more than 1000 vector lengths")
    links, edges = None, copies.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("c"))
    for dim, count in counts.items():
        n, e = _near_of_length(reps.where(F.col("dim") == dim), dim, count, threshold, sample, centres, block, depth)
        links = n if links is None else links.unionByName(n)
        edges = edges.unionByName(e)
    if links is None:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    classes = connected_components(edges.select("a", F.col("c").alias("b")))
    out = base.select("id", "rid").join(copies.select("rid", "rep", "w"), "rid", "left").withColumn("rep", F.coalesce("rep", "rid")).join(links.withColumnRenamed("rid", "rep"), "rep", "left").join(classes, "id", "left")
    total = F.coalesce("n", F.lit(0).cast("long")) + F.coalesce("w", F.lit(1).cast("long")) - 1
    out = out.select(F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.lit(0).cast("long")).otherwise(total).alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
