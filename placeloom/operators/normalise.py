"""Rows of sources as stamped records: why a row is dropped, licenses by pointer, names, categories, confidence, legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag keys that say what a place is, in order of category; tag values that say nothing.
CATEGORY_TAGS = ("amenity", "tourism", "historic", "leisure", "shop", "craft", "office", "natural", "man_made", "place", "public_transport")
EMPTY_VALUES = ("yes", "no")
#: Fixed value: tags of languages that are stored.
LANGUAGE_TAG = "^[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?$"
# Confidence where a source states none, of a value and of opening hours.
CONFIDENCE = {"overture": (0.5, 0.5), "osm": (0.7, 0.5), "wikivoyage": (0.6, 0.3)}
#: Error codes of a routing engine that mean there is no way, not that it failed.
NO_ROUTE = (170, 171, 442)


def license_for(sources: Column, pointer: str) -> Column:
    """The license stated for the pointer, the first of several; else the last one of the record (property ""); null if none.

    ``sources``: array of (property, license); entries without a license state nothing.
    """
    stated = F.filter(sources, lambda s: F.coalesce(s["license"], F.lit("")) != "")
    own = F.filter(stated, lambda s: s["property"] == pointer)
    record = F.filter(stated, lambda s: s["property"] == "")
    return F.coalesce(F.get(own, F.lit(0))["license"], F.get(record, F.size(record) - 1)["license"])


def _with_plain(named: Column, plain: Column) -> Column:
    """Under ``und`` the plain name, if it is none of the others."""
    adds = (F.coalesce(plain, F.lit("")) != "") & ~F.array_contains(F.map_values(named), F.coalesce(plain, F.lit("")))
    return F.when(adds, F.map_concat(F.map_filter(named, lambda k, _: k != "und"), F.create_map(F.lit("und"), plain))).otherwise(named)


def common_names(common: Column, primary: Column) -> tuple[Column, Column]:
    """(names by language tag, how many tags are unusable) of a map of tags and a primary name."""
    said = F.map_filter(F.coalesce(common, F.expr("cast(map() as map<string,string>)")), lambda _, v: F.coalesce(v, F.lit("")) != "")
    named = F.map_filter(said, lambda k, _: k.rlike(LANGUAGE_TAG))
    return _with_plain(named, primary), (F.size(said) - F.size(named)).cast("long")


def tag_names(tags: Column) -> tuple[Column, Column]:
    """As ``common_names``, of the tags ``name:<language>`` and ``name``."""
    prefixed = F.map_filter(tags, lambda k, _: k.startswith("name:"))
    return common_names(F.transform_keys(prefixed, lambda k, _: F.substring(k, 6, 1000)), F.try_element_at(tags, F.lit("name")))


def tag_categories(tags: Column) -> Column:
    """key.value of the tags that say what a place is."""
    each = F.transform(F.array(*map(F.lit, CATEGORY_TAGS)), lambda k: F.when(~F.coalesce(F.try_element_at(tags, k), F.lit("")).isin("", *EMPTY_VALUES), F.concat(k, F.lit("."), F.try_element_at(tags, k))))
    return F.array_distinct(F.array_compact(each))


def tag_address(tags: Column) -> Column:
    """Street and number, postcode, city and country as they are written; null if there are none."""
    at = lambda k: F.nullif(F.try_element_at(tags, F.lit(f"addr:{k}")), F.lit(""))
    street = F.nullif(F.concat_ws(" ", at("street"), at("housenumber")), F.lit(""))
    return F.nullif(F.concat_ws(", ", street, at("postcode"), at("city"), at("country")), F.lit(""))


def confidence(kind: Column, stated: Column, hours: bool = False) -> Column:
    """The stated confidence between 0 and 1, where the source states any; else the source's own."""
    own = F.coalesce(*(F.when(kind == k, F.lit(v[hours])) for k, v in CONFIDENCE.items()))
    return F.when(kind == "overture", F.least(F.greatest(F.coalesce(stated, own), F.lit(0.0)), F.lit(1.0))).otherwise(own)


def drop_reason(ident: Column, lon: Column, lat: Column, inside: Column, license_: Column, names: Column) -> Column:
    """The first reason to drop a row, null to keep it."""
    return (
        F.when(ident.isNull(), "no_id")
        .when(lon.isNull() | lat.isNull(), "no_geometry")
        .when(F.isnan(lon) | F.isnan(lat) | (F.abs(lon) > 180) | (F.abs(lat) > 90), "invalid_geometry")
        .when(~F.coalesce(inside, F.lit(False)), "outside")
        .when(F.coalesce(license_, F.lit("")) == "", "no_license")
        .when(F.size(names) == 0, "no_name")
    )


def kept_and_dropped(rows: DataFrame, reason: str = "drop_reason") -> tuple[DataFrame, DataFrame]:
    """(rows to keep, how many were dropped for each reason)."""
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def page_records(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """Pages (title, lon, lat, text) with their own coordinates, else those of the search hit; without any they are dropped.

    A page without text has no story, but is a place.
    """
    found = hits.select("title", F.col("lon").alias("hit_lon"), F.col("lat").alias("hit_lat"))
    own = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    at = lambda c: F.when(own, F.col(c)).otherwise(F.col(f"hit_{c}"))
    placed = pages.join(found, "title", "left").withColumn("at_lon", at("lon")).withColumn("at_lat", at("lat"))
    story = F.nullif("text", F.lit(""))
    return placed.where("at_lon is not null and at_lat is not null").select("title", F.col("at_lon").alias("lon"), F.col("at_lat").alias("lat"), own.alias("own"), story.alias("story"))


def trip_legs(replies: DataFrame, key: str = "key") -> DataFrame:
    """A row per leg of replies (key, error_code, units, legs: array of (shape, length, time)): place, metres, whole seconds.

    A reply without legs, or with a code of NO_ROUTE, is one row with ``no_route``; any other code is an error.
    """
    legs = F.when(F.col("error_code").isNull(), F.col("legs"))
    scale = F.when(F.col("units") == "miles", 1609.344).otherwise(1000.0)
    failed = F.col("error_code").isNotNull() & ~F.col("error_code").isin(*NO_ROUTE)
    checked = replies.where(F.when(failed, F.raise_error(F.concat(F.lit("routing failed with code "), F.col("error_code").cast("string")))).otherwise(F.lit(True)))
    each = checked.select(key, "units", F.posexplode_outer(legs).alias("leg", "l"))
    return each.select(key, "leg", F.col("l.shape").alias("shape"), (F.col("l.length") * scale).alias("metres"), F.bround("l.time", 0).cast("long").alias("seconds"), F.col("leg").isNull().alias("no_route"))
