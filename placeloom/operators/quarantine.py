"""License quarantine: what may leave, what is withheld, and credits for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions.licenses import bundleable, canonical

# Licenses that demand a credit.
CREDITED = ("ODbL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CDLA-Permissive-2.0", "Apache-2.0", "MIT")


def judged(obs: DataFrame) -> DataFrame:
    """Observations with their path before any removal, and whether they may enter a bundle."""
    place = F.row_number().over(W.partitionBy("site_id", "field").orderBy("value", "src", "kind", "license", "confidence", "observed_at")) - 1
    return obs.withColumn("path", F.concat(F.lit("/"), F.col("field"), F.lit("/"), place.cast("string"))).withColumn("ok", bundleable(F.col("kind"), F.col("license")))


def withheld(obs: DataFrame, anchor: str) -> DataFrame:
    """(site_id, path, reason): refused values; a site whose anchor field is refused logs that path alone."""
    j = judged(obs).withColumn("gone", F.max((F.col("field") == anchor) & ~F.col("ok")).over(W.partitionBy("site_id")))
    reason = F.when(F.col("gone"), "site").otherwise("value")
    return j.where(~F.col("ok") & (~F.col("gone") | (F.col("field") == anchor))).select("site_id", "path", reason.alias("reason"))


def released(obs: DataFrame, anchor: str) -> DataFrame:
    """Values that stay: allowed ones of sites whose anchor field is not refused."""
    j = judged(obs)
    refused = j.where(~F.col("ok") & (F.col("field") == anchor)).select("site_id").distinct()
    return j.where("ok").join(refused, "site_id", "left_anti")


def require_legs(legs: DataFrame) -> DataFrame:
    """Legs, or an error if any may not leave: legs are refused as a whole, never dropped."""
    ok = bundleable(F.col("kind"), F.col("license"))
    return legs.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("leg may not leave: "), F.coalesce("license", F.lit("none"))))))


def reject_user_values(batch: DataFrame) -> DataFrame:
    """The batch, or an error if any of it came from a user."""
    return batch.where(F.when(F.col("kind") == "user", F.raise_error(F.lit("user values are not stored"))).otherwise(F.lit(True)))


def credits(obs: DataFrame) -> DataFrame:
    """(section, license, kind, attribution, n, label): counts per license, kind and credit, the share-alike database license first, then by name."""
    named = obs.withColumn("license", canonical(F.col("license"))).where("license is not null")
    grouped = named.groupBy("license", "kind", "attribution").agg(F.count("*").alias("n"))
    section = F.when(F.col("license") == "ODbL-1.0", 0).otherwise(1)
    return grouped.select(section.alias("section"), "license", "kind", "attribution", "n", F.when(F.col("n") == 1, "1 value").otherwise(F.concat(F.col("n").cast("string"), F.lit(" values"))).alias("label"))


def articles(revisions: DataFrame, *by: str) -> DataFrame:
    """Per article the least of its revisions' urls, and the others in order."""
    urls = revisions.groupBy(*by).agg(F.array_sort(F.collect_set("url")).alias("urls"))
    return urls.select(*by, F.get("urls", F.lit(0)).alias("main"), F.slice("urls", F.lit(2), F.greatest(F.size("urls") - 1, F.lit(0))).alias("others"))


def text_license(obs: DataFrame) -> DataFrame:
    """Per site the distinct canonical licenses joined by AND; null if none."""
    return obs.groupBy("site_id").agg(F.nullif(F.array_join(F.array_sort(F.collect_set(canonical(F.col("license")))), " AND "), F.lit("")).alias("text_license"))


def uncredited(obs: DataFrame, credit: str) -> DataFrame:
    """Rows that must not be published: not allowed, or owing a credit that is missing."""
    c = canonical(F.col("license"))
    return obs.where(~bundleable(F.col("kind"), F.col("license")) | (c.isin(*CREDITED) & (F.coalesce(F.col(credit), F.lit("")) == "")))


class UnknownStructure(ValueError):
    """A structure that no rule covers: the job stops before it reads a row, rather than let it pass."""


_NO_PATHS = "cast(array() as array<string>)"


def quarantined(column: Column, kind: T.DataType, containers: frozenset[str], never: frozenset[str]) -> tuple[Column, Column]:
    """(the nested value without what may not leave, the paths of what was withheld, as they were before).

    The type decides: a struct of ``value`` and ``source`` is a stamped value; another struct with ``source`` is
    ruled on and then searched; one without must be named in ``containers`` or ``never`` (by its path without
    places, as ``stories[]`` or ``names{}``), else UnknownStructure is raised.  Maps and lists lose their refused
    entries; elsewhere what is refused becomes null.
    """
    kept, dropped, paths = _ruled(column, kind, F.lit(""), "", containers, never)
    return F.when(~dropped, kept), paths


def _ruled(x: Column, kind: T.DataType, path: Column, shape: str, containers, never) -> tuple[Column, Column, Column]:
    """(kept, whether it is dropped, withheld paths)."""
    none = F.expr(_NO_PATHS)
    if isinstance(kind, T.ArrayType):
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        part = lambda j: lambda e, i: _ruled(e, kind.elementType, at(i), shape + "[]", containers, never)[j]
        each = F.transform(x, lambda e, i: F.struct(part(0)(e, i).alias("kept"), part(1)(e, i).alias("gone")))
        kept = F.transform(F.filter(each, lambda e: ~e["gone"]), lambda e: e["kept"])
        return kept, F.lit(False), F.coalesce(F.flatten(F.transform(x, part(2))), none)
    if isinstance(kind, T.MapType):
        at = lambda k: F.concat(path, F.lit("."), k.cast("string"))
        part = lambda j: lambda e: _ruled(e["value"], kind.valueType, at(e["key"]), shape + "{}", containers, never)[j]
        listed = F.map_entries(x)
        each = F.transform(listed, lambda e: F.struct(e["key"].alias("key"), part(0)(e).alias("kept"), part(1)(e).alias("gone")))
        kept = F.map_from_entries(F.transform(F.filter(each, lambda e: ~e["gone"]), lambda e: F.struct(e["key"], e["kept"])))
        return kept, F.lit(False), F.coalesce(F.flatten(F.transform(listed, part(2))), none)
    if not isinstance(kind, T.StructType):
        return x, F.lit(False), none
    if shape in never:
        return F.lit(None).cast(kind), x.isNotNull(), F.when(x.isNotNull(), F.array(path)).otherwise(none)
    names = kind.fieldNames()
    if "source" not in names and shape not in containers:
        raise UnknownStructure(f"no rule for the structure at {shape or 'the top'!r}")
    dropped = F.lit(False)
    if "source" in names:
        dropped = x.isNotNull() & ~F.coalesce(bundleable(x["source"]["kind"], x["source"]["license"]), F.lit(False))
    if {"value", "source"} <= set(names):
        return x, dropped, F.when(dropped, F.array(path)).otherwise(none)
    inner = {f.name: _ruled(x[f.name], f.dataType, F.concat(path, F.lit("." if shape else ""), F.lit(f.name)), f"{shape}.{f.name}".lstrip("."), containers, never) for f in kind.fields if f.name != "source"}
    kept = F.struct(*(x["source"].alias("source") if n == "source" else F.when(~inner[n][1], inner[n][0]).alias(n) for n in names))
    paths = F.flatten(F.array(*(p for _, _, p in inner.values()))) if inner else none
    return F.when(x.isNotNull(), kept), dropped, F.when(dropped, F.array(path)).otherwise(F.coalesce(paths, none))
