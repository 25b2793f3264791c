"""Areas: containment, coverage, largest overlap, networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import covers, overlap_area
from ..runtime import components, staged


#: Each level's cells are four times as wide as those before; the last level holds boxes of any size.
LEVELS = 16


def _cells(df: DataFrame, step: int, level: Column, corners: tuple[str, str, str, str]) -> DataFrame:
    """A row per cell of the level that the box touches; at or above its own level these are four at most."""
    at = df.withColumn("level", level).withColumn("wide", F.lit(step) * F.pow(F.lit(4), F.col("level")).cast("long"))
    x0, y0, x1, y1 = corners
    span = lambda a, b: F.sequence(F.floor(F.col(a) / F.col("wide")), F.floor(F.col(b) / F.col("wide")))
    return at.withColumn("cx", F.explode(span(x0, x1))).withColumn("cy", F.explode(span(y0, y1)))


def _own(step: int, corners: tuple[str, str, str, str]) -> Column:
    """The level whose cells are as wide as the box."""
    longest = F.greatest(F.col(corners[2]) - F.col(corners[0]), F.col(corners[3]) - F.col(corners[1]))
    return F.when(longest <= step, 0).otherwise(F.least(F.ceil(F.log2(longest / step) / 2), F.lit(LEVELS - 1))).cast("int")


def in_cells(boxes: DataFrame, step: int) -> DataFrame:
    """Boxes (x0, y0, x1, y1) in the cells of their own level, with ``home``, and of the coarser ones that others stand in."""
    at = boxes.withColumn("own", _own(step, ("x0", "y0", "x1", "y1")))
    levels = sorted(r[0] for r in at.select("own").distinct().collect() if r[0] is not None)  # LEVELS numbers at most
    looked = F.explode(F.filter(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)"), lambda x: x >= F.col("own")))
    return _cells(at.withColumn("look", looked), step, F.col("look"), ("x0", "y0", "x1", "y1")).withColumn("home", F.expr("look = own")).drop("own", "look")


def meeting(left: DataFrame, right: DataFrame, step: int) -> DataFrame:
    """Pairs of boxes that overlap or touch, once each: left with x0, y0, x1, y1, right with u0, v0, u1, v1 (x0 <= x1, ...).

    A box stands in the grid of the level whose cells are as wide as it is, and looks around in the coarser grids that
    the other side has boxes in, so it takes four cells a level at most, however large it is.
    """
    sides = (left, ("x0", "y0", "x1", "y1")), (right, ("u0", "v0", "u1", "v1"))
    levelled = []
    for df, c in sides:
        levelled.append((df.withColumn("own", _own(step, c)), c))
    held = [sorted(r[0] for r in df.select("own").distinct().collect()) for df, _ in levelled]  # LEVELS numbers at most
    parts = []
    for (home, c), (guest, d), levels, finer in ((levelled[0], levelled[1], held[0], False), (levelled[1], levelled[0], held[1], True)):
        looked = F.explode(F.filter(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)"), (lambda x: x > F.col("own")) if finer else (lambda x: x >= F.col("own"))))
        at_home = _cells(home, step, F.col("own"), c).drop("own", "wide")
        around = _cells(guest.withColumn("look", looked), step, F.col("look"), d).drop("own", "look")
        parts.append(at_home.join(around, ["level", "cx", "cy"]))
    met = parts[0].unionByName(parts[1].select(parts[0].columns))
    touch = (F.col("x0") <= F.col("u1")) & (F.col("u0") <= F.col("x1")) & (F.col("y0") <= F.col("v1")) & (F.col("v0") <= F.col("y1"))
    # Of the cells where two meet, the one of their overlap's low corner counts.
    low = (F.col("cx") == F.floor(F.greatest("x0", "u0") / F.col("wide"))) & (F.col("cy") == F.floor(F.greatest("y0", "v0") / F.col("wide")))
    return met.where(touch & low).drop("level", "cx", "cy", "wide")


def _right(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x1").alias("u1"), F.col("y1").alias("v1"))


def places_in(areas: DataFrame, places: DataFrame, step: int = 100) -> DataFrame:
    """(area_id, place_id) of points inside boxes, edges included."""
    points = places.select("place_id", F.col("x").alias("u0"), F.col("y").alias("v0"), F.col("x").alias("u1"), F.col("y").alias("v1"))
    return meeting(areas.select("area_id", "x0", "y0", "x1", "y1"), points, step).select("area_id", "place_id")


def largest_overlap(areas: DataFrame, zones: DataFrame, step: int = 100) -> DataFrame:
    """Per area the zone that shares most of it, sums per zone name, of equals the first by name."""
    met = meeting(areas.select("area_id", "x0", "y0", "x1", "y1"), _right(zones, "zone_id", "zone"), step)
    shared = overlap_area(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "u0", "v0", "u1", "v1")))
    sums = met.groupBy("area_id", "zone").agg(F.sum(shared.cast("long")).alias("shared")).where("shared > 0")
    best = sums.groupBy("area_id").agg(F.min_by(F.struct("zone", "shared"), F.struct(-F.col("shared"), F.col("zone"))).alias("b"))
    return best.select("area_id", "b.zone", "b.shared")


def coverage(requests: DataFrame, researched: DataFrame, step: int = 100) -> DataFrame:
    """Per request (request_id, box) the area of the union of researched boxes in it, by coordinate compression, and its own."""
    met = meeting(requests.select("request_id", "x0", "y0", "x1", "y1"), _right(researched), step)
    clip = met.select("request_id", F.greatest("x0", "u0").alias("a0"), F.greatest("y0", "v0").alias("b0"), F.least("x1", "u1").alias("a1"), F.least("y1", "v1").alias("b1")).where("a0 < a1 and b0 < b1").distinct()
    # Strips between neighbouring x edges; in each, the union of y intervals by a running maximum.
    edges = clip.select("request_id", F.explode(F.array("a0", "a1")).alias("s0")).distinct()
    strips = edges.withColumn("s1", F.lead("s0").over(W.partitionBy("request_id").orderBy("s0"))).where("s1 is not null")
    held = strips.join(clip, "request_id").where("a0 <= s0 and a1 >= s1").select("request_id", "s0", "s1", "b0", "b1").distinct()
    before = W.partitionBy("request_id", "s0").orderBy("b0", "b1").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.col("b1") - F.greatest("b0", F.coalesce(F.max("b1").over(before), F.col("b0"))), F.lit(0))
    covered = held.withColumn("h", new).groupBy("request_id").agg(F.sum(((F.col("s1") - F.col("s0")) * F.col("h")).cast("long")).alias("covered"))
    own = requests.select("request_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("long").alias("asked"))
    return own.join(covered, "request_id", "left").select("request_id", "asked", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))


def component_sizes(edges: DataFrame) -> DataFrame:
    """(root, n_nodes, n_edges) of each connected component."""
    edges = staged(edges)  # both are read twice
    nodes = staged(components(edges))
    sizes = nodes.groupBy("root").agg(F.count("*").alias("n_nodes"))
    inside = edges.join(nodes, edges.u == nodes.node).groupBy("root").agg(F.count("*").alias("n_edges"))
    return sizes.join(inside, "root")


def serving_component(snaps: DataFrame, n_anchors: int) -> DataFrame:
    """The one component that serves all anchors: least total snap, then larger, then the lower number; snaps(anchor, root, n_nodes, snap)."""
    per = snaps.groupBy("anchor", "root", "n_nodes").agg(F.min("snap").alias("snap"))
    whole = per.groupBy("root", "n_nodes").agg(F.count("*").alias("n"), F.sum("snap").alias("total")).where(F.col("n") == n_anchors)
    return whole.orderBy("total", F.desc("n_nodes"), "root").limit(1).select("root", "n_nodes", "total")


def zones_at(points: DataFrame, zones: DataFrame, step: int = 100) -> DataFrame:
    """(key, zone) of points (key, x, y) in polygons (zone, ring of structs x, y): boxes first, then the ring, edges included.

    Of several the first by name; points in none are left out, and zones of code ``-99`` are none.
    """
    corner = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    boxed = zones.where("zone <> '-99'").select("zone", "ring", *(F.floor(corner(F.array_min, c)).cast("long").alias(f"{c}0") for c in "xy"), *(F.ceil(corner(F.array_max, c)).cast("long").alias(f"{c}1") for c in "xy"))
    at = points.select("key", "x", "y", F.col("x").alias("u0"), F.col("y").alias("v0"), F.col("x").alias("u1"), F.col("y").alias("v1"))
    inside = meeting(boxed, at, step).where(covers(F.col("ring"), F.col("x").cast("double"), F.col("y").cast("double")))
    return inside.groupBy("key").agg(F.min("zone").alias("zone"))
