"""Merging observations per site and field: winners, conflicts, unions, the ledger.

Observations are long: site_id, field, value, kind, src, license, confidence, observed_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.licenses import trust_rank


def _rank():
    """Ascending order of the winner policy: confidence, trust, recency, then the content."""
    return F.struct((-F.col("confidence")).alias("c"), trust_rank(F.col("kind")).alias("t"), (-F.unix_date("observed_at")).alias("d"), F.col("kind"), F.col("src"), F.col("value").cast("string").alias("v"))


def winners(obs: DataFrame, *by: str) -> DataFrame:
    """The winning value per site and field: one partial minimum, no sort."""
    keys = by or ("site_id", "field")
    best = obs.groupBy(*keys).agg(F.min_by(F.struct("value", "kind", "src", "confidence", "observed_at"), _rank()).alias("w"))
    return best.select(*keys, "w.*")


def conflicts(obs: DataFrame) -> DataFrame:
    """Fields with more than one value: candidates in winner order, and the resolution."""
    grouped = obs.groupBy("site_id", "field").agg(F.countDistinct("value").alias("n_values"), F.sort_array(F.collect_list(_rank())).alias("ranked")).where("n_values > 1")
    return grouped.select("site_id", "field", "n_values", F.size("ranked").cast("long").alias("n_candidates"), F.concat(F.lit("picked:"), F.element_at("ranked", 1)["src"].cast("string")).alias("resolution"), F.array_join(F.transform("ranked", lambda r: r["v"]), ",").alias("candidates"))


def union_values(obs: DataFrame) -> DataFrame:
    best = obs.groupBy("site_id", "field", "value").agg(F.min_by(F.struct("kind", "src", "confidence"), _rank()).alias("w"))
    return best.select("site_id", "field", "value", "w.*")


def record_level(obs: DataFrame) -> DataFrame:
    """Per site: the last day seen, fields, values, and the sorted distinct kinds."""
    return obs.groupBy("site_id").agg(F.max("observed_at").alias("updated_at"), F.countDistinct("field").alias("n_fields"), F.countDistinct("field", "value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def source_refs(obs: DataFrame) -> DataFrame:
    return obs.select("site_id", "kind", "src", "license").distinct()


def attributions(obs: DataFrame) -> DataFrame:
    """Sorted distinct credits per site; those of losing values too."""
    return obs.groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_set(F.nullif(F.concat_ws("/", "kind", "license"), F.lit("")))), "; ").alias("credits"))


def ledger_rows(obs: DataFrame) -> DataFrame:
    """Rows under their natural key: site, field, day and digests of source and value."""
    source, value = F.md5(F.to_json(F.struct("kind", "license", "src"))), F.md5(F.col("value").cast("string"))
    return obs.select("site_id", "field", "observed_at", source.alias("source_md5"), value.alias("value_md5"))


def append_ledger(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """What an idempotent append adds: each new natural key once."""
    keys = ["site_id", "field", "observed_at", "source_md5", "value_md5"]
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def without_duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each natural key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def ranked(lists: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """(list_id, place_id, rank, refused) of lists (list_id, asked) over candidates (list_id, place_id, at).

    Those asked for come in that order, the others behind in their own; the first ``most`` stay.  A list that names a
    place twice, or one that is no candidate, is one row that says so.
    """
    twice = F.size("asked") > F.size(F.array_distinct("asked"))
    named = lists.select("list_id", F.posexplode("asked").alias("place_at", "place_id"))
    strange = named.join(candidates.select("list_id", "place_id"), ["list_id", "place_id"], "left_anti").select("list_id").distinct().withColumn("strange", F.lit(True))
    judged = lists.join(strange, "list_id", "left").select("list_id", F.when(twice, "repeated").when(F.col("strange"), "unknown").alias("refused"))
    good = candidates.join(judged.where("refused is null").select("list_id"), "list_id", "left_semi")
    placed = good.join(named, ["list_id", "place_id"], "left").withColumn("order", F.struct(F.col("place_at").isNull().alias("own"), F.coalesce("place_at", "at").alias("n"), F.col("place_id").alias("id")))
    order = placed.withColumn("rank", F.row_number().over(W.partitionBy("list_id").orderBy("order"))).where(F.col("rank") <= most)
    none = F.lit(None)
    return order.select("list_id", "place_id", "rank", none.cast("string").alias("refused")).unionByName(judged.where("refused is not null").select("list_id", none.cast("long").alias("place_id"), none.cast("int").alias("rank"), "refused"))


def merged(records: DataFrame, obs: DataFrame) -> DataFrame:
    """A row per cluster of records (site_id, cluster, gers_id): its least id, first identifier, last day, fields and conflicts.

    ``fields`` maps each to its winner's value, source and canonical value; ``conflicts`` lists the fields that have
    more than one value with the distinct candidates in order of the policy; ``credits`` holds the losers' too.
    """
    whole = records.groupBy("cluster").agg(F.min("site_id").alias("site_id"), F.min("gers_id").alias("gers_id"), F.collect_set("site_id").alias("members"))
    mine = obs.join(records.select("site_id", "cluster"), "site_id").drop("site_id").withColumnRenamed("cluster", "site_id")
    won = winners(mine).groupBy("site_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("value", "kind", "src"))))).alias("fields"))
    odd = union_values(mine).groupBy("site_id", "field").agg(F.count("*").alias("n")).where("n > 1").groupBy("site_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "field", "n"))).alias("conflicts"))
    last = mine.groupBy("site_id").agg(F.max("observed_at").alias("updated_at"))
    out = whole
    for part in (won, odd, last, attributions(mine)):
        out = out.join(part.withColumnRenamed("site_id", "cluster"), "cluster", "left")
    return out.select("cluster", "site_id", "gers_id", F.size("members").alias("n_members"), "updated_at", "fields", F.coalesce("conflicts", F.expr("cast(array() as array<string>)")).alias("conflicts"), "credits")
