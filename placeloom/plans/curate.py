"""Composite plans: merging records, upserting into what is stored, frames, tile windows, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.serialize import artifact_digests
from ..operators import merge, resolve, spatial


def merge_records(records: DataFrame, names: DataFrame, obs: DataFrame) -> DataFrame:
    """Winners per cluster and field: resolve, cluster, merge."""
    found = resolve.matched_clusters(records, names)
    return merge.winners(obs.join(found.select(F.col("place_id").alias("site_id"), "cluster"), "site_id").drop("site_id").withColumnRenamed("cluster", "site_id"))


def upsert(stored: DataFrame, incoming: DataFrame, metres: float = resolve.EPSILON_M) -> DataFrame:
    """(key, site, how) of incoming rows (key, gers_id, lon, lat): the stored one of their identifier, else the nearest without a clash, else new.

    Stored sites are never joined to each other.
    """
    by_id = incoming.where("gers_id is not null").join(stored.where("gers_id is not null").groupBy("gers_id").agg(F.min("key").alias("site")), "gers_id").select("key", "site", F.lit("gers_id").alias("how"))
    open_rows = incoming.join(by_id.select("key"), "key", "left_anti")
    without = lambda df, has: df.where(f"gers_id is {'not ' if has else ''}null")
    # Two different identifiers never match, so rows with one look only at sites without.
    near = resolve.nearest(without(open_rows, False), stored, metres).unionByName(resolve.nearest(without(open_rows, True), without(stored, False), metres))
    placed = by_id.unionByName(near.select("key", F.col("match").alias("site"), F.lit("spatial").alias("how")))
    new = incoming.select("key").join(placed.select("key"), "key", "left_anti").select("key", F.lit(None).cast("long").alias("site"), F.lit("new").alias("how"))
    return placed.unionByName(new)


def local_frame(areas: DataFrame, countries: DataFrame, zones: DataFrame) -> DataFrame:
    """(area_id, country, zone): both from the largest overlap, or neither."""
    country = spatial.largest_overlap(areas, countries).select("area_id", F.col("zone").alias("country"))
    zone = spatial.largest_overlap(areas, zones).select("area_id", "zone")
    both = areas.select("area_id").join(country, "area_id", "left").join(zone, "area_id", "left")
    whole = F.col("country").isNotNull() & F.col("zone").isNotNull()
    return both.select("area_id", F.when(whole, F.col("country")).alias("country"), F.when(whole, F.col("zone")).alias("zone"))


def tile_window(points: DataFrame, buffer_m: float = 1000.0, least_m: float = 2000.0) -> DataFrame:
    """Per key a window around its points: their circular mean longitude, spans in metres, buffered, at least so wide, rounded outward."""
    mean = points.groupBy("key").agg(F.degrees(F.atan2(F.avg(F.sin(F.radians("lon"))), F.avg(F.cos(F.radians("lon"))))).alias("lon0"), F.avg("lat").alias("lat0"))
    near = points.join(mean, "key").withColumn("dx", F.pmod(F.col("lon") - F.col("lon0") + 540, F.lit(360.0)) - 180)
    span = near.groupBy("key", "lon0", "lat0").agg(F.min("dx").alias("w"), F.max("dx").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    per_x = F.lit(111_320.0) * F.greatest(F.cos(F.radians("lat0")), F.lit(0.01))
    pad = lambda low, high, per: F.greatest(F.lit(buffer_m), (F.lit(least_m) - (high - low) * per) / 2) / per
    px, py = pad(F.col("w"), F.col("e"), per_x), pad(F.col("s"), F.col("n"), F.lit(111_320.0))
    wrap = lambda x: F.pmod(x + 540, F.lit(360.0)) - 180
    down, up = (lambda x: F.floor(x * 1e6) / 1e6), (lambda x: F.ceil(x * 1e6) / 1e6)
    return span.select("key", down(wrap(F.col("lon0") + F.col("w") - px)).alias("west"), down(F.col("s") - py).alias("south"), up(wrap(F.col("lon0") + F.col("e") + px)).alias("east"), up(F.col("n") + py).alias("north"))


def publish(spark: SparkSession, folder: str, artifacts: dict[str, DataFrame]) -> DataFrame:
    """Writes each artifact, then, last of all, the manifest (path, size, sha256): a bundle without one does not exist."""
    if any(p.startswith("/") or "\\" in p or ".." in p.split("/") for p in artifacts):
        raise ValueError("unsafe path")
    for path, df in artifacts.items():
        df.write.mode("overwrite").json(f"{folder}/{path}")
    manifest = artifact_digests(spark, folder).where(~F.col("path").rlike("/(?:_SUCCESS|[^/]*\\.crc)$"))
    root = manifest.withColumn("path", F.regexp_replace("path", "^.*?" + folder.rstrip("/").split("/")[-1] + "/", ""))
    rows = [tuple(r) for r in root.orderBy("path").collect()]  # one row per artifact file of a bundle of at most 200 MB
    sealed = spark.createDataFrame(rows, root.schema)
    sealed.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return sealed
