"""Is a day feasible: schedules, midnight rollover, budgets, opening windows, verdicts.

Stops are rows (plan_id, stop_order, place_id, dwell, start_min, leg_m, leg_s), the leg being the one into the stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import staged

#: Seconds in a day; tolerance of a budget.
DAY_S, TOLERANCE = 86_400, 1e-9
#: Sites, as counted, up to which they are broadcast.
FEW_SITES = 100_000


def running_schedule(stops: DataFrame, day_start_min: int = 540) -> DataFrame:
    """start_clock per stop: legs in whole minutes up, dwell added, from the day's start."""
    order = W.partitionBy("plan_id").orderBy("stop_order")
    walk = F.when(F.col("stop_order") == 0, 0).otherwise(F.ceil(F.col("leg_s") / 60)).cast("long")
    dwell = F.coalesce(F.sum("dwell").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return stops.select("plan_id", "stop_order", (day_start_min + F.sum(walk).over(order.rowsBetween(W.unboundedPreceding, 0)) + dwell).cast("long").alias("start_clock"))


def _started(stops: DataFrame, *carry: str) -> DataFrame:
    """(plan_id, out) per plan: its stops in order, with start_s and the columns ``carry``."""
    fields = dict.fromkeys(("stop_order", "start_min", "dwell", "leg_s", *carry))
    listed = stops.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("day"))
    types = dict(stops.dtypes)

    def step(a, s):
        fell = a["offset"] + F.when(s["start_min"] < a["clock"], 1).otherwise(0)
        start = s["start_min"] * 60 + fell * DAY_S
        late = F.when(a["end"] >= 0, F.greatest(F.floor((a["end"] + s["leg_s"] - start) / DAY_S), F.lit(0))).otherwise(F.lit(0))
        begin = (start + late * DAY_S).cast("long")
        stop = F.struct(s["stop_order"].cast("long").alias("stop_order"), begin.alias("start_s"), *(s[c].alias(c) for c in carry))
        return F.struct((fell + late).cast("long").alias("offset"), s["start_min"].cast("long").alias("clock"), (begin + s["dwell"] * 60).cast("long").alias("end"), F.concat(a["out"], F.array(stop)).alias("out"))

    held = "".join(f",{c}:{types[c]}" for c in carry)
    zero = F.expr(f"named_struct('offset', 0L, 'clock', -1L, 'end', -1L, 'out', cast(array() as array<struct<stop_order:bigint,start_s:bigint{held}>>))")
    return listed.select("plan_id", F.aggregate("day", zero, step, lambda a: a["out"]).alias("out"))


def local_starts(stops: DataFrame) -> DataFrame:
    """start_s per stop, seconds since the day's midnight.

    A clock that falls is the next day; a start that misses the earliest arrival by whole days moves by them.
    One ordered fold per plan (its stops are one bounded array): a window cannot carry the catch-up forward.
    """
    return _started(stops).select("plan_id", F.inline("out")).select("plan_id", "stop_order", "start_s")


def exceeds(total: Column, budget: Column) -> Column:
    return (total > budget) & (F.abs(total - budget) > TOLERANCE * F.greatest(F.abs(total), F.abs(budget)))


def walking_totals(stops: DataFrame, plans: DataFrame) -> DataFrame:
    """Per plan the metres walked (whole ones, so sums are exact) against its budget."""
    sums = stops.groupBy("plan_id").agg(F.sum("leg_m").cast("long").alias("walked_m"), F.count("*").alias("n_stops"))
    return sums.join(plans.select("plan_id", "budget_m"), "plan_id").withColumn("over", exceeds(F.col("walked_m").cast("double"), F.col("budget_m").cast("double")))


def unknown_sites(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Stops whose place is not on record."""
    return stops.select("plan_id", "stop_order", "place_id").join(places.select("place_id"), "place_id", "left_anti")


def first_uncovered(stops: DataFrame, opening: DataFrame) -> DataFrame:
    """(plan_id, stop_order, minute): the first minute of [start, start + max(dwell, 1)) when the place is shut.

    opening(place_id, open_min, close_min) are merged windows of the day.  Intervals, not minutes: the first gap
    is the start itself or the end of a window that the visit outlasts.
    """
    s = stops.select("plan_id", "stop_order", "place_id", F.col("start_min").cast("long").alias("a"), (F.col("start_min") + F.greatest("dwell", F.lit(1))).cast("long").alias("b"))
    listed = opening.groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct(F.col("open_min").alias("o"), F.col("close_min").alias("c")))).alias("w"))
    met = s.join(listed, "place_id", "left")
    reach = F.aggregate(F.coalesce("w", F.expr("cast(array() as array<struct<o:bigint,c:bigint>>)")), F.col("a"), lambda at, w: F.when((w["o"] <= at) & (w["c"] > at), w["c"]).otherwise(at))
    return met.withColumn("minute", reach).where("minute < b").select("plan_id", "stop_order", "minute")


def hours_guard(expression: Column, timezone: Column, country: Column) -> Column:
    """Why an opening-hours text cannot be judged, in order; null if it can be parsed on."""
    plain = F.regexp_replace(expression, '"[^"]*"', " ")
    token = lambda t: plain.rlike(f"(?<![A-Za-z])(?:{t})(?![A-Za-z])")
    return (
        F.when(expression.isNull() | (F.trim(expression) == ""), "no_expression")
        .when(token("SH"), "school_holiday_selector")
        .when(token("PH") & country.isNull(), "public_holiday_without_country")
        .when(token("sunrise|sunset|dawn|dusk"), "sun_event_unsupported")
        .when(timezone.isNull(), "unknown_timezone")
    )


def verdicts(stops: DataFrame, plans: DataFrame, places: DataFrame, opening: DataFrame) -> DataFrame:
    """(plan_id, code, stop_order, blocking): walking budget, then per stop an unknown site or a shut one."""
    over = walking_totals(stops, plans).where("over").select("plan_id", F.lit("walking_budget").alias("code"), F.lit(-1).cast("long").alias("stop_order"))
    lost = unknown_sites(stops, places).select("plan_id", F.lit("unknown_site").alias("code"), F.col("stop_order").cast("long"))
    known = stops.join(places.select("place_id"), "place_id", "left_semi")
    shut = first_uncovered(known, opening).select("plan_id", F.lit("outside_opening_window").alias("code"), F.col("stop_order").cast("long"))
    return over.unionByName(lost).unionByName(shut).withColumn("blocking", F.col("code") != "hours_unknown")


def day_verdicts(stops: DataFrame, plans: DataFrame, sites: DataFrame, opening: DataFrame) -> DataFrame:
    """(plan_id, code, stop_order, reason, blocking) of whole days; stop_order is null for a budget.

    ``plans``: plan_id, budget_m, budget_h, day (a date), timezone (null: no local frame); ``sites``: place_id,
    unreadable (why its hours cannot be judged, null if they can); ``opening``: place_id, week_from, week_to, merged
    minutes of the week from Monday.  Budgets are of metres and of hours from the first start to the last end.  Each
    stop gives one verdict at most: an unknown site, hours that cannot be judged (advisory), or the first minute of
    the visit that is shut, on the day that its start falls on after rollovers.
    """
    begun = _started(stops, "place_id", "dwell", "leg_m").join(plans.select("plan_id", "budget_m", "budget_h", "day", "timezone"), "plan_id")
    # Stops stay with their plan, so they are dealt out once; its budgets go with them as rows without a place.
    legs = F.filter(F.transform("out", lambda s: s["leg_m"]), lambda m: m.isNotNull())
    walked = F.when(F.size(legs) > 0, F.aggregate(legs, F.lit(0).cast("long"), lambda t, m: t + m))
    first, last = F.element_at("out", 1), F.element_at("out", -1)
    elapsed = last["start_s"] + last["dwell"] * 60 - first["start_s"]
    over = F.array_compact(F.array(
        F.when(exceeds(walked.cast("double"), F.col("budget_m").cast("double")), "walking_budget"),
        F.when(exceeds(elapsed / 3600, F.col("budget_h").cast("double")), "time_budget"),
    ))
    row = lambda s, code: F.struct(*(s[c].alias(c) if code is None else F.lit(None).cast(t).alias(c) for c, t in kinds.items()), (F.lit(None).cast("string") if code is None else code).alias("over"))
    kinds = {"stop_order": "long", "start_s": "long", "place_id": dict(stops.dtypes)["place_id"], "dwell": dict(stops.dtypes)["dwell"]}
    rows = F.concat(F.transform("out", lambda s: row(s, None)), F.transform(over, lambda code: row(None, code)))
    each = begun.select("plan_id", "day", "timezone", F.inline(rows))
    listed = opening.groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct(F.col("week_from").cast("long").alias("o"), F.col("week_to").cast("long").alias("c")))).alias("w"))
    told = staged(sites.select("place_id", "unreadable", F.lit(True).alias("known")).join(listed, "place_id", "left"))
    told = F.broadcast(told) if told.count() <= FEW_SITES else told
    # The visit in minutes of its week; windows of a week are read twice, so that a visit may pass its end.
    week = 7 * 1440
    begins = (F.weekday(F.date_add("day", F.floor(F.col("start_s") / DAY_S).cast("int"))) * 1440 + F.floor(F.pmod("start_s", F.lit(DAY_S)) / 60)).cast("long")
    cause = F.when(F.col("known").isNull(), "unknown_site").when(F.col("timezone").isNull(), "no_timezone").otherwise(F.col("unreadable"))
    judged = each.join(told, "place_id", "left").select("plan_id", "stop_order", "over", "w", F.when(F.col("over").isNull(), cause).alias("cause"), begins.alias("a"), (begins + F.greatest("dwell", F.lit(1))).alias("b"))
    twice = F.concat("w", F.transform("w", lambda x: F.struct((x["o"] + week).alias("o"), (x["c"] + week).alias("c"))))
    reach = F.aggregate(F.coalesce(twice, F.expr("cast(array() as array<struct<o:bigint,c:bigint>>)")), F.col("a"), lambda at, x: F.when((x["o"] <= at) & (x["c"] > at), x["c"]).otherwise(at))
    judged = judged.withColumn("at", F.when(F.col("over").isNull() & F.col("cause").isNull(), reach))
    shut = F.concat(F.lit("closed at "), F.lpad(F.floor(F.pmod("at", F.lit(1440)) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod("at", F.lit(60)).cast("string"), 2, "0"))
    code = F.when(F.col("over").isNotNull(), F.col("over")).when(F.col("cause") == "unknown_site", "unknown_site").when(F.col("cause").isNotNull(), "hours_unknown").when(F.expr("at < b"), "outside_opening_window")
    found = judged.select("plan_id", code.alias("code"), "stop_order", F.when(F.col("over").isNull(), F.coalesce(F.nullif("cause", F.lit("unknown_site")), F.when(F.col("cause").isNull(), shut))).alias("reason")).where("code is not null")
    return found.withColumn("blocking", F.col("code") != "hours_unknown")
