"""Whether an itinerary's references resolve: stops are positions, legs have ids, nothing points at what is not there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def itinerary_faults(stops: DataFrame, legs: DataFrame, entries: DataFrame) -> DataFrame:
    """(plan_id, fault, ref): stops(plan_id, position, stop_order), legs(plan_id, leg_id, from_stop, to_stop), entries(plan_id, position, stop_order, leg_id).

    Faults: ``misnumbered`` (ref: the position), ``repeated_leg``, ``from_nowhere``, ``to_nowhere``, ``to_itself``
    (the leg's id), ``lost_stop``, ``lost_leg`` and ``not_one_target`` (the entry's position).
    """
    fault = lambda df, name, ref: df.select("plan_id", F.lit(name).alias("fault"), F.col(ref).cast("string").alias("ref"))
    known = stops.select("plan_id", F.col("stop_order").alias("known")).distinct()
    ids = legs.select("plan_id", F.col("leg_id").alias("known_leg")).distinct()
    missing = lambda df, column, right, key: df.where(F.col(column).isNotNull()).join(right, (df["plan_id"] == right["plan_id"]) & (df[column] == right[key]), "left_anti")
    again = legs.withColumn("n", F.count("*").over(W.partitionBy("plan_id", "leg_id"))).where("n > 1").select("plan_id", "leg_id").distinct()
    found = [
        fault(stops.where(~F.col("stop_order").eqNullSafe(F.col("position"))), "misnumbered", "position"),
        fault(again, "repeated_leg", "leg_id"),
        fault(missing(legs, "from_stop", known, "known"), "from_nowhere", "leg_id"),
        fault(missing(legs, "to_stop", known, "known"), "to_nowhere", "leg_id"),
        fault(legs.where("from_stop = to_stop"), "to_itself", "leg_id"),
        fault(missing(entries, "stop_order", known, "known"), "lost_stop", "position"),
        fault(missing(entries, "leg_id", ids, "known_leg"), "lost_leg", "position"),
        fault(entries.where("(stop_order is null) = (leg_id is null)"), "not_one_target", "position"),
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def timeline(stops: DataFrame, stored: DataFrame) -> DataFrame:
    """(plan_id, seq, entry, ref): a plan's stored entries if it has any, else its stops with the legs into them between."""
    bare = stops.join(stored.select("plan_id").distinct(), "plan_id", "left_anti")
    walked = bare.select("plan_id", (F.col("stop_order") * 2).alias("seq"), F.lit("stop").alias("entry"), F.col("place_id").alias("ref"))
    legs = bare.where("stop_order > 0").select("plan_id", (F.col("stop_order") * 2 - 1).alias("seq"), F.lit("leg").alias("entry"), F.col("leg_m").alias("ref"))
    return stored.select("plan_id", "seq", "entry", "ref").unionByName(walked).unionByName(legs)
