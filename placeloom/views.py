"""Views that give the driver's tables the domain's shape, each one definition for Spark and for the oracle.

``{name}`` stands for a table or another view; Spark fills in DataFrames, the oracle names of CTEs.  All
arithmetic is on integers, or rounded, so both engines agree to the bit.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "places": """
        select place_id, name, x, y, cast(x as double) / 100000 as lon, cast(y as double) / 100000 as lat,
               case mod(place_id, 5) when 0 then 'overture' when 1 then 'osm' when 2 then 'wikivoyage' when 3 then 'user' else 'open_web' end as kind,
               case mod(place_id, 7) when 0 then 'ODbL' when 1 then 'cc0' when 2 then 'CC-BY-SA-4.0' when 3 then 'proprietary' when 4 then ' Apache-2.0 ' when 5 then 'CDLA-Permissive-2.0' else '' end as license,
               mod(place_id * 37, 101) as confidence, case when mod(place_id, 3) = 0 then concat('g', cast(mod(place_id, 400) as varchar(20))) end as gers_id, area_key
        from (select c_custkey * 2 as place_id, c_name as name, 2821000 + mod(c_custkey * 7919, 2000) as x, 3644000 + mod(c_custkey * 104729, 1100) as y, c_nationkey as area_key from {customer}
              union all
              select s_suppkey * 2 + 1, s_name, 2821000 + mod(s_suppkey * 7907, 2000), 3644000 + mod(s_suppkey * 104723, 1100), s_nationkey from {supplier}
              union all
              select 3000000000 + n_nationkey * 2, concat('Museum of ', n_name), 2821000 + mod(n_nationkey * 7919, 2000), 3644000 + mod(n_nationkey * 104729, 1100), n_nationkey from {nation}
              union all
              select 3000000000 + n_nationkey * 2 + 1, concat('museum  of ', lower(n_name)), 2821002 + mod(n_nationkey * 7919, 2000), 3644001 + mod(n_nationkey * 104729, 1100), n_nationkey from {nation}) q""",
    "observation": """
        select l_partkey as site_id, l_returnflag as field, cast(l_quantity as bigint) as value, mod(l_suppkey, 11) as src,
               case mod(l_linenumber, 5) when 0 then 'overture' when 1 then 'osm' when 2 then 'wikivoyage' when 3 then 'user' else 'open_web' end as kind,
               case mod(l_suppkey, 6) when 0 then 'ODbL-1.0' when 1 then 'CC0-1.0' when 2 then 'CC-BY-SA-4.0' when 3 then 'proprietary' when 4 then 'MIT' else 'unknown' end as license,
               cast(round(l_discount * 100) as bigint) as confidence, cast(l_shipdate as date) as observed_at
        from {lineitem}""",
    "area": """
        select cast(n_nationkey as bigint) as area_id, n_name as name, cast(n_regionkey as bigint) as created_by, 2821000 + mod(n_nationkey * 331, 1500) as x0, 3644000 + mod(n_nationkey * 173, 700) as y0,
               2821000 + mod(n_nationkey * 331, 1500) + 100 + mod(n_nationkey * 7, 5) * 100 as x1, 3644000 + mod(n_nationkey * 173, 700) + 100 + mod(n_nationkey * 3, 4) * 100 as y1, mod(n_nationkey, 3) <> 0 as researched
        from {nation}""",
    "zone": """
        select cast(r_regionkey as bigint) as zone_id, r_name as zone, 2821000 + r_regionkey * 400 as x0, 3644000 as y0, 2821000 + r_regionkey * 400 + 600 as x1, 3644000 + 900 as y1 from {region}""",
    "plan": """
        select o_orderkey as plan_id, o_custkey as user_id, case o_orderstatus when 'F' then 'compiled' when 'O' then 'compiling' else 'proposed' end as status, o_orderdate as created_at, cast(round(o_totalprice) as bigint) as budget_m, mod(o_orderkey, 5) as revision
        from {orders}""",
    "stop": """
        select plan_id, cast(n - 1 as bigint) as stop_order, place_id, dwell, start_min, leg_m, leg_s from (
            select l_orderkey as plan_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as n,
                   mod(l_partkey, 3300) as place_id, cast(l_quantity as bigint) as dwell, mod(l_suppkey * 13 + l_linenumber * 97, 1440) as start_min,
                   mod(cast(round(l_extendedprice) as bigint), 5000) as leg_m, mod(cast(round(l_extendedprice) as bigint), 5000) * 9 as leg_s
            from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate from {lineitem} group by all) d) q""",
    "graph_edge": """select distinct mod(l_partkey, 997) as u, 1000 + mod(l_suppkey * 31 + l_linenumber, 499) as v from {lineitem}""",
    "step": """select plan_id, status, revision from {plan}""",
}

#: Tables that Spark deals out once by the key that a view's steps all keep.
DEALT = {"stop": {"lineitem": "l_orderkey"}}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    parts = {n: view(spark, sf_dir, n) for n in _needs(sql)}
    return spark.sql(sql, **{n: df.repartition(DEALT[name][n]) if n in DEALT.get(name, ()) else df for n, df in parts.items()})


def oracle(sql: str) -> str:
    """SQL over tables and ``{views}`` as one statement with the views as CTEs."""
    ctes: dict[str, str] = {}

    def add(text: str) -> str:
        for n in _needs(text):
            if n in VIEWS and n not in ctes:
                ctes[n] = add(VIEWS[n])
        return text.format(**{n: n for n in _needs(text)})

    body = add(sql)
    if not ctes:
        return body
    lead = ", ".join(f"{n} as ({s})" for n, s in ctes.items())
    recursive = body.lstrip().lower().startswith("with recursive")
    rest = body.lstrip()[len("with recursive") :] if recursive else body.lstrip()[len("with") :] if body.lstrip().lower().startswith("with ") else None
    return f"with {'recursive ' if recursive else ''}{lead}{',' + rest if rest is not None else ' ' + body}"
