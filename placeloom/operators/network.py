"""Walk networks: noding, verdicts, shortest paths.

Edges are segments (seg_id, x0, y0, x1, y1) on an integer grid, so crossings are rounded to it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import components, staged
from .spatial import in_cells, meeting, serving_component

#: Pairs of segments that are tested at once.
TESTED = 1 << 20
#: Segments a task takes.
SEGMENTS = 25_000


def _crossings(ax, ay, bx, by, px, py, qx, qy):
    """(number of the pair, x, y): where the first line of a pair is cut by the second, rounded, halves away from zero."""

    def whole(at):
        size = np.abs(at)
        floor = np.floor(size)
        return (np.where(at < 0, -1.0, 1.0) * (floor + (size - floor >= 0.5))).astype(np.int64)

    out = []
    det = (bx - ax) * (qy - py) - (by - ay) * (qx - px)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / det
        u = ((px - ax) * (by - ay) - (py - ay) * (bx - ax)) / det
    at = np.flatnonzero((det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    out.append((at, whole(ax[at] + t[at] * (bx[at] - ax[at])), whole(ay[at] + t[at] * (by[at] - ay[at]))))
    for x, y in ((px, py), (qx, qy)):  # an end of the other on this one
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        at = np.flatnonzero((side == 0) & (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx)) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by)))
        out.append((at, x[at].astype(np.int64), y[at].astype(np.int64)))
    return [np.concatenate(c) for c in zip(*out)]


def _cut(batches):
    """(seg_id, ax, ay, x, y): cuts of segments in a cell, of rows by cell (level, cx, cy, wide, home, seg_id, ax, ay, bx, by)."""

    def solve(rows):
        home = rows[4].astype(bool)
        cx, cy, wide = (int(rows[c][0]) for c in (1, 2, 3))
        seg, line = rows[5], [c.astype(np.float64) for c in rows[6:10]]
        x0, x1, y0, y1 = np.minimum(rows[6], rows[8]), np.maximum(rows[6], rows[8]), np.minimum(rows[7], rows[9]), np.maximum(rows[7], rows[9])
        small = np.int32 if max(int(abs(c).max()) for c in (x0, x1, y0, y1)) < 1 << 31 else np.int64
        box = [c.astype(small) for c in (x0, x1, y0, y1)]
        ours, span_y = np.flatnonzero(home), int((y1 - y0).max()) + 1
        span = (int((x1 - x0).max()) + 1) * span_y
        step = max(1, TESTED // len(seg))
        for s in range(0, len(ours), step):
            o = ours[s : s + step, None]
            met = box[0][o] <= box[1]
            for low, high in ((box[0], box[1][o]), (box[2][o], box[3]), (box[2], box[3][o])):
                met &= low <= high
            i, j = np.divmod(np.flatnonzero(met), len(seg))
            i = o[i, 0]
            # Of the cells where two meet, the one of their overlap's low corner counts.
            go = (seg[i] != seg[j]) & (np.maximum(x0[i], x0[j]) // wide == cx) & (np.maximum(y0[i], y0[j]) // wide == cy)
            i, j = i[go], j[go]
            i, j = np.concatenate((i, j[~home[j]])), np.concatenate((j, i[~home[j]]))  # finer ones are cut by ours as well
            at, x, y = _crossings(*(c[i] for c in line), *(c[j] for c in line))
            i = i[at]
            if not len(i):
                continue
            if len(seg) * span < 1 << 62:
                code = i * span + (x - x0[i]) * span_y + y - y0[i]
                if len(seg) * span <= 1 << 24:
                    flags = np.zeros(len(seg) * span, bool)
                    flags[code] = True
                    code = np.flatnonzero(flags)
                else:
                    code = np.unique(code)
                i = code // span
                x, y = code % span // span_y + x0[i], code % span_y + y0[i]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (seg[i], rows[6][i], rows[7][i], x, y)], ["seg_id", "ax", "ay", "x", "y"])

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(10)]
        new = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if held and any(held[-1][c][0] != rows[c][s] for c in range(3)):
                yield from solve([np.concatenate(x) for x in zip(*held)])
                held = []
            held.append([c[s:e] for c in rows])
    if held:
        yield from solve([np.concatenate(x) for x in zip(*held)])


def _pieces(batches):
    """(seg_id, x0, y0, x1, y1): pieces between neighbouring points, lower end first, of rows (seg_id, ax, ay, x, y) by seg_id."""

    def solve(parts):
        seg, ax, ay, x, y = (np.concatenate(c) for c in zip(*parts))
        along = (x - ax) * (x - ax) + (y - ay) * (y - ay)
        order = np.lexsort((y, x, along, seg))
        seg, x, y = seg[order], x[order], y[order]
        go = np.flatnonzero((seg[1:] == seg[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        x0, y0, x1, y1 = x[go], y[go], x[go + 1], y[go + 1]
        turn = (x0 > x1) | ((x0 == x1) & (y0 > y1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (seg[go], np.where(turn, x1, x0), np.where(turn, y1, y0), np.where(turn, x0, x1), np.where(turn, y0, y1))], ["seg_id", "x0", "y0", "x1", "y1"])

    held, size = [], 0
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in range(5)]
        if size >= TESTED:
            cut = int(np.searchsorted(rows[0], held[-1][0][-1], "right"))
            if cut < len(rows[0]):
                yield solve([*held, [c[:cut] for c in rows]])
                held, size, rows = [], 0, [c[cut:] for c in rows]
        if len(rows[0]):
            held.append(rows)
            size += len(rows[0])
    if held:
        yield solve(held)


def noded(segments: DataFrame, step: int | None = None) -> DataFrame:
    """(seg_id, x0, y0, x1, y1) pieces that meet only at their ends: cut where two cross, touch or overlap.

    Equal segments are cut once, for the least of them.  Segments meet in cells about as wide as they are (or of
    ``step``), where a task tests them many at once and gives each cut of a segment once.
    """
    lines = staged(segments.groupBy(*(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1"))).agg(F.min(F.col("seg_id").cast("long")).alias("seg_id")))
    boxed = lines.select("seg_id", F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"), F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))
    if step is None:
        longest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        usual, most = boxed.agg(F.percentile_approx(longest, 0.9), F.max(longest)).first()
        step = max(1, most if most <= 2 * usual else usual) if most else 1
    rows = in_cells(boxed, step).select("level", "cx", "cy", "wide", "home", "seg_id", "ax", "ay", "bx", "by")
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // SEGMENTS))
    cuts = rows.repartition(parts, "level", "cx", "cy").sortWithinPartitions("level", "cx", "cy").mapInArrow(_cut, "seg_id long, ax long, ay long, x long, y long")
    end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ends = boxed.where("ax is not null and ay is not null and bx is not null and by is not null").select("seg_id", "ax", "ay", F.inline(F.array(end("ax", "ay"), end("bx", "by"))))
    pieces = cuts.union(ends).repartition(parts, "seg_id").sortWithinPartitions("seg_id").mapInArrow(_pieces, "seg_id long, x0 long, y0 long, x1 long, y1 long")
    # Overlapping pieces are one.
    return pieces.groupBy("x0", "y0", "x1", "y1").agg(F.min("seg_id").alias("seg_id")).select("seg_id", "x0", "y0", "x1", "y1")


def node_edges(pieces: DataFrame, *keep: str) -> DataFrame:
    """(u, v, length) and the columns ``keep``: end points as numbers."""
    at = lambda x, y: F.shiftleft(F.col(x), 32).bitwiseOR(F.col(y).bitwiseAND(F.lit(0xFFFFFFFF)))
    return pieces.select(at("x0", "y0").alias("u"), at("x1", "y1").alias("v"), F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("length"), *keep)


def graph_verdict(pieces: DataFrame) -> DataFrame:
    """Nodes, pieces, components, and the share of pieces in the largest one (what pruning keeps)."""
    edges = staged(node_edges(pieces).select("u", "v"))  # read by several jobs
    placed = components(edges.select("u", "v"))
    per = edges.join(placed, edges.u == placed.node).groupBy("root").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("components"), F.sum("n").alias("pieces"), F.max("n").alias("kept"))


def served_graph(pieces: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """The pieces of the one component that every anchor (key, x, y) reaches, with its ``root``; an error if there is none.

    Of several: the least sum of ways to the anchors, then the larger, then the lower root.  All others are pruned.
    """
    lines = staged(pieces.select("x0", "y0", "x1", "y1").distinct())
    edges = staged(node_edges(lines, "x0", "y0", "x1", "y1"))
    placed = components(edges.select("u", "v"))
    owned = staged(edges.join(placed, edges.u == placed.node).select("root", F.xxhash64("x0", "y0", "x1", "y1").alias("seg_id"), "x0", "y0", "x1", "y1"))
    sizes = owned.groupBy("root").agg(F.count("*").alias("n_nodes"))
    near = snaps(anchors, owned.select("seg_id", "x0", "y0", "x1", "y1"), reach).join(owned.select("seg_id", "root"), "seg_id").groupBy(F.col("key").alias("anchor"), "root").agg(F.min("distance").alias("snap"))
    chosen = serving_component(near.join(sizes, "root"), anchors.select("key").distinct().count())
    found = chosen.first()
    if found is None:
        raise ValueError("no part of the network serves every anchor")
    return owned.where(F.col("root") == found["root"]).select("root", "x0", "y0", "x1", "y1")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the nearest point of a segment."""
    dx, dy = bx - ax, by - ay
    along = F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif((dx * dx + dy * dy).cast("double"), F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(px - ax - t * dx, F.lit(2)) + F.pow(py - ay - t * dy, F.lit(2)))


def snaps(points: DataFrame, segments: DataFrame, reach: int, step: int = 256) -> DataFrame:
    """(key, seg_id, distance) of the segments within reach of points (key, x, y): boxes that meet, then the exact distance."""
    around = points.select("key", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") - reach).alias("x0"), (F.col("y") - reach).alias("y0"), (F.col("x") + reach).alias("x1"), (F.col("y") + reach).alias("y1"))
    boxed = segments.select("seg_id", F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"), F.least("x0", "x1").alias("u0"), F.least("y0", "y1").alias("v0"), F.greatest("x0", "x1").alias("u1"), F.greatest("y0", "y1").alias("v1"))
    far = segment_distance(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    return meeting(around, boxed, step).withColumn("distance", far).where(F.col("distance") <= reach).select("key", "seg_id", "distance")


def nearest_edges(points: DataFrame, segments: DataFrame, reach: int) -> DataFrame:
    """Per point the nearest segment within reach, of equals the least: (key, seg_id, distance)."""
    near = snaps(points, segments, reach).groupBy("key").agg(F.min(F.struct("distance", "seg_id")).alias("n"))
    return near.select("key", "n.seg_id", "n.distance")


def shortest_paths(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(graph_id, source, target, length) by Dijkstra per graph (one area's network); null where no path leads."""

    def solve(key, edge: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, list] = {}
        for u, v, w in edge[["u", "v", "length"]].itertuples(index=False) if len(edge) else ():
            around.setdefault(u, []).append((v, w))
            around.setdefault(v, []).append((u, w))
        out = []
        for source, targets in ask.groupby("source")["target"] if len(ask) else ():
            best, queue = {source: 0.0}, [(0.0, source)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > best[u]:
                    continue
                for v, w in around.get(u, ()):
                    if d + w < best.get(v, float("inf")):
                        best[v] = d + w
                        heapq.heappush(queue, (d + w, v))
            out += [(key[0], source, t, best.get(t)) for t in targets]
        return pd.DataFrame(out, columns=["graph_id", "source", "target", "length"])

    return edges.groupBy("graph_id").cogroup(asked.groupBy("graph_id")).applyInPandas(solve, "graph_id long, source long, target long, length double")


def valid_ring(ring: list) -> bool:
    """A simple ring of three corners or more, some area, in range."""
    points = [tuple(p) for p in ring or ()]
    if points and points[0] == points[-1]:
        points = points[:-1]
    if len(points) < 3 or len(set(points)) < len(points) or any(not (-180 <= x <= 180 and -90 <= y <= 90) for x, y in points):
        return False
    n = len(points)
    if sum(points[i][0] * points[(i + 1) % n][1] - points[(i + 1) % n][0] * points[i][1] for i in range(n)) == 0:
        return False
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: turn(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            a, b, c, d = points[i], points[(i + 1) % n], points[j], points[(j + 1) % n]
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0 or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
                return False
    return True


@F.pandas_udf(T.BooleanType())
def ring_is_valid(rings: pd.Series) -> pd.Series:
    """``valid_ring`` over arrays of (lon, lat) arrays."""
    return rings.map(lambda r: False if r is None else valid_ring([tuple(p) for p in r]))
