"""Scans: box predicates that reach Parquet, late materialisation, element feeds, resolvers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import boxes_overlap
from ..runtime import staged


#: Ways that are not walked.
NOT_WALKED = ("motorway", "motorway_link", "trunk")


def bbox_scan(rows: DataFrame, window: tuple, limit: int | None = None, x0="x", y0="y", x1="x", y1="y", key="place_id") -> DataFrame:
    """Rows whose box overlaps the window, in order of their id."""
    hit = rows.where(boxes_overlap(F.col(x0), F.col(y0), F.col(x1), F.col(y1), *map(F.lit, window))).orderBy(key)
    return hit if limit is None else hit.limit(limit)


def name_scan(rows: DataFrame, needle: str, fold, name: str = "name") -> DataFrame:
    """Rows whose folded name holds the folded needle, or is held by it."""
    other, own = fold(F.col(name)), fold(F.lit(needle))
    return rows.where(F.contains(other, own) | F.contains(own, other))


def late_materialise(narrow: DataFrame, wide: DataFrame, key: str, bounds: tuple[str, str]) -> DataFrame:
    """The wide columns of the narrow pass's hits: a literal range from the corners that pass saw, then a semi-join.

    The range reaches the scan's row groups; the hits may be many, so no side is broadcast by hand.
    """
    hits = staged(narrow.select(key, *bounds).distinct())
    low, high = hits.agg(F.min(bounds[0]), F.max(bounds[1])).first()
    if low is None:
        return wide.limit(0)
    return wide.where((F.col(bounds[0]) >= low) & (F.col(bounds[1]) <= high)).join(hits.select(key), key, "left_semi")


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def element_feed(spark: SparkSession, path: str) -> DataFrame:
    """Elements of map-feed JSON: (id, lon, lat, tags); ways and relations stand at their centre."""
    schema = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    place = e.select(F.concat_ws("/", "e.type", "e.id").alias("id"), F.coalesce("e.center.lon", "e.lon").alias("lon"), F.coalesce("e.center.lat", "e.lat").alias("lat"), F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"), F.element_at(F.create_map(F.lit("node"), F.lit(0), F.lit("way"), F.lit(1), F.lit("relation"), F.lit(2)), F.col("e.type")).alias("rank"))
    return first_of(place, ["id"], ["rank"]).drop("rank")


def covering_circles(boxes: DataFrame, step: int, most: int = 32) -> DataFrame:
    """(area_id, i, j, cx, cy, truncated): centres of cells of ``step`` that cover x0..x1, y0..y1; at most ``most``, rows first."""
    span = lambda a, b: F.greatest(F.ceil((F.col(b) - F.col(a)) / step), F.lit(1)).cast("long")
    n = boxes.select("area_id", "x0", "y0", span("x0", "x1").alias("nx"), span("y0", "y1").alias("ny"))
    grid = n.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    kept = grid.where(F.col("j") * F.col("nx") + F.col("i") < most)
    return kept.select("area_id", "i", "j", (F.col("x0") + F.col("i") * step + step // 2).alias("cx"), (F.col("y0") + F.col("j") * step + step // 2).alias("cy"), (F.col("nx") * F.col("ny") > most).alias("truncated"))


def matrix_cells(rows: DataFrame, matrix: str, unit: str) -> DataFrame:
    """(…, i, j, metres, reachable) of an array of arrays of distances; a null cell has no route."""
    keep = [c for c in rows.columns if c not in (matrix, unit)]
    lines = rows.select(*keep, unit, F.posexplode(matrix).alias("i", "line"))
    cells = lines.select(*keep, unit, "i", F.posexplode("line").alias("j", "d"))
    factor = F.when(F.col(unit) == "miles", 1609.344).otherwise(1000.0)
    return cells.select(*keep, "i", "j", (F.col("d") * factor).alias("metres"), F.col("d").isNotNull().alias("reachable"))


def latest_build(builds: DataFrame, day: Column, back: int = 7) -> DataFrame:
    """Per asked day the last live build in the days before it: builds(asked, built, live)."""
    seen = builds.where("live").where((F.col("built") <= day) & (F.col("built") >= F.date_sub(day, back)))
    return seen.groupBy("asked").agg(F.max("built").alias("build"))


def event_log(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parsed JSON lines; broken ones are left out."""
    return lines.select(F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("e")).where("e is not null").select("e.*")


def walk_lines(edges: DataFrame, window: tuple) -> DataFrame:
    """Lines (edge_id, x0, y0, x1, y1, way) whose box overlaps the window and that may be walked; motorways may not."""
    low, high = (F.least("x0", "x1"), F.least("y0", "y1")), (F.greatest("x0", "x1"), F.greatest("y0", "y1"))
    return edges.where(boxes_overlap(*low, *high, *map(F.lit, window))).where(~F.col("way").isin(*NOT_WALKED))


def fallback_requests(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Names to ask the geocoder for, once each: those asked without a window that no scan has found."""
    return asked.where("not has_window").select("name").distinct().join(hits.select("name"), "name", "left_anti")
