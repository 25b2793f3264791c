"""Registered queries: each operator on the driver's tables, with the same result in SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import geo, hours, prose, serialize, text
from .functions.licenses import bundleable, bundleable_sql, canonical, canonical_sql, trust_sql
from .operators import feasibility, integrity, merge, network, quarantine, resolve, spatial
from .plans import curate, lifecycle
from .registry import ORACLES, QUERIES, query
from .runtime import shared_dir, staged
from .sources import scans, wikitext
from .streaming import ledger

WINDOW = (2821200, 3644200, 2822000, 3644800)
HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"

# ---------------------------------------------------------------- scans


@query("select place_id, name, x, y from {places} where x <= 2822000 and x >= 2821200 and y <= 3644800 and y >= 3644200")
def s1_bbox_scan(v):
    return scans.bbox_scan(v("places"), WINDOW).select("place_id", "name", "x", "y")


@query("select place_id, name from {places} where x <= 2822000 and x >= 2821200 and y <= 3644800 and y >= 3644200 order by place_id limit 25")
def s1_bbox_scan_limit(v):
    return scans.bbox_scan(v("places"), WINDOW, 25).select("place_id", "name")


@query("select c_custkey, c_name from {customer} where contains(" + text.area_fold_sql("c_name") + ", 'omer#00000001')")
def s2_name_scan(v):
    return scans.name_scan(v("customer"), "OMER#00000001", text.area_fold, "c_name").select("c_custkey", "c_name")


@query("select place_id, name from {places} where x between 2821200 and 2822000 and y between 3644200 and 3644800 and contains(" + text.area_fold_sql("name") + ", 'supplier')")
def s3_name_in_window(v):
    return scans.name_scan(scans.bbox_scan(v("places"), WINDOW), "Supplier", text.area_fold).select("place_id", "name")


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice from {lineitem} where l_orderkey in (select o_orderkey from {orders} where o_totalprice > 400000)")
def s4_late_materialise(v):
    narrow = v("orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").alias("low"), F.col("o_orderkey").alias("high"))
    wide = v("lineitem").withColumn("low", F.col("l_orderkey")).withColumn("high", F.col("l_orderkey"))
    return scans.late_materialise(narrow, wide, "l_orderkey", ("low", "high")).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("select id, kind, name from (select id, kind, name, row_number() over (partition by id order by rank) as r from (select c_custkey as id, 'node' as kind, c_name as name, 0 as rank from {customer} union all select s_suppkey, 'way', s_name, 1 from {supplier}) q) w where r = 1")
def s7_first_by_type(v):
    nodes = v("customer").select(F.col("c_custkey").alias("id"), F.lit("node").alias("kind"), F.col("c_name").alias("name"), F.lit(0).alias("rank"))
    ways = v("supplier").select(F.col("s_suppkey").alias("id"), F.lit("way").alias("kind"), F.col("s_name").alias("name"), F.lit(1).alias("rank"))
    return scans.first_of(nodes.unionByName(ways), ["id"], ["rank"]).drop("rank")


@query("""select area_id, i, j, x0 + i * 60 + 30 as cx, y0 + j * 60 + 30 as cy, nx * ny > 32 as truncated from (select area_id, x0, y0, greatest(cast(ceil((x1 - x0) / 60.0) as bigint), 1) as nx, greatest(cast(ceil((y1 - y0) / 60.0) as bigint), 1) as ny from {area}) a,
 lateral (select unnest(range(0, nx)) as i) gi, lateral (select unnest(range(0, ny)) as j) gj where j * nx + i < 32""")
def s11_cover_circles(v):
    return scans.covering_circles(v("area"), 60)


@query("""select p, cast(i as int) as i, cast(j as int) as j, round(d * case when mod(p, 2) = 0 then 1609.344 else 1000.0 end, 3) as metres, d is not null as reachable from (
 select p_partkey as p, i, j, case when mod(p_partkey + i * 3 + j, 7) = 0 then null else cast(mod(p_partkey * (i + 1) * (j + 2), 1000) as double) / 8 end as d from {part}, (select unnest(range(0, 3)) as i) a, (select unnest(range(0, 3)) as j) b) q""")
def s17_matrix_cells(v):
    cell = lambda i: lambda j: F.when((F.col("p_partkey") + i * 3 + j) % 7 != 0, ((F.col("p_partkey") * (i + 1) * (j + 2)) % 1000).cast("double") / 8)
    three = F.array(*(F.lit(k).cast("long") for k in range(3)))
    rows = v("part").select(F.col("p_partkey").alias("p"), F.transform(three, lambda i: F.transform(three, cell(i))).alias("m"), F.when(F.col("p_partkey") % 2 == 0, "miles").otherwise("km").alias("unit"))
    return scans.matrix_cells(rows, "m", "unit").select("p", "i", "j", F.round("metres", 3).alias("metres"), "reachable")


@query("""select cast(asked as date) as asked, max(built) as build from (select distinct cast(ts as date) as asked from {events}) a join (select distinct cast(ts as date) as built from {events} where mod(day(ts), 3) = 0) b on built <= asked and built >= asked - 7 group by asked""")
def s18_latest_build(v):
    days = v("events").select(F.to_date("ts").alias("d")).distinct()
    builds = days.withColumn("asked", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.date_add("d", k)))).select("asked", F.col("d").alias("built"), (F.dayofmonth("d") % 3 == 0).alias("live"))
    return scans.latest_build(builds.join(days, F.col("asked") == days.d, "left_semi"), F.col("asked"))


@query("select event_id, user_id, json_extract_string(props, '$.k') as k from {events} where json_valid(props)")
def s19_event_log(v):
    parsed = v("events").where("try_parse_json(props) is not null").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    return parsed


# ---------------------------------------------------------------- rows


@query("""select p_partkey, string_agg(c, '|' order by i) as categories from (select p_partkey, c, min(i) as i from (select p_partkey, p_brand as c, 0 as i from {part} union all select p_partkey, p_type, 1 from {part} union all select p_partkey, p_brand, 2 from {part} union all select p_partkey, split_part(p_type, ' ', 1), 3 from {part}) q where c <> '' group by p_partkey, c) w group by p_partkey""")
def p3_categories(v):
    listed = F.array("p_brand", "p_type", "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)))
    return v("part").select("p_partkey", F.array_join(F.array_distinct(F.filter(listed, lambda x: x != "")), "|").alias("categories"))


@query("select c_custkey, nullif(concat_ws(', ', nullif(c_name, ''), nullif(c_mktsegment, ''), cast(c_nationkey as varchar)), '') as address from {customer}")
def p5_address(v):
    blank = F.lit("")
    return v("customer").select("c_custkey", F.nullif(F.concat_ws(", ", F.nullif("c_name", blank), F.nullif("c_mktsegment", blank), F.col("c_nationkey").cast("string")), blank).alias("address"))


@query("""select kind, case when trim(license) = '' then 'no_license' when license = 'proprietary' then 'refused' else 'kept' end as reason, count(*) as n from {places} group by all""")
def p8_drop_counters(v):
    reason = F.when(F.trim("license") == "", "no_license").when(F.col("license") == "proprietary", "refused").otherwise("kept")
    return v("places").groupBy("kind", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("select page_id, url || case when contains(url, '?') then '&' else '?' end || 'oldid=' || cast(page_id * 7 as varchar) as pinned from {pages}")
def p9_pinned_url(v):
    return v("pages").select("page_id", F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("oldid="), (F.col("page_id") * 7).cast("string")).alias("pinned"))


@query("""select source, min_by(lang, case when lang like 'en%' then 0 when lang like '%-Latn' then 1 else 2 end * 1000 + length(lang) * 10 + case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 3 end) as shown from {documents} group by source""")
def p10_display_name(v):
    tier = F.when(F.col("lang").startswith("en"), 0).when(F.col("lang").endswith("-Latn"), 1).otherwise(2)
    return v("documents").groupBy("source").agg(F.min_by("lang", F.struct(tier, F.length("lang"), F.col("lang"))).alias("shown"))


@query("select count(*) as n, sum(case when license <> '' and confidence between 0 and 100 and kind is not null then 0 else 1 end)::bigint as rejected from {places}")
def p11_valid_rows(v):
    ok = (F.col("license") != "") & F.col("confidence").between(0, 100) & F.col("kind").isNotNull()
    return v("places").agg(F.count("*").alias("n"), F.sum(F.when(ok, 0).otherwise(1)).alias("rejected"))


@query("select plan_id, min(start_min) as first_min, max(start_min + dwell) as last_min, count(*) as n_stops from {stop} group by plan_id")
def p12_summaries(v):
    return v("stop").groupBy("plan_id").agg(F.min("start_min").alias("first_min"), F.max(F.col("start_min") + F.col("dwell")).alias("last_min"), F.count("*").alias("n_stops"))


@query("""select plan_id, stop_order as seq, 'stop' as entry, place_id as ref from {stop} where mod(plan_id, 3) = 0 and mod(stop_order, 2) = 0
 union all select plan_id, 2 * stop_order as seq, 'stop' as entry, place_id as ref from {stop} where mod(plan_id, 3) <> 0 union all select plan_id, 2 * stop_order - 1, 'leg', leg_m from {stop} where stop_order > 0 and mod(plan_id, 3) <> 0""")
def p14_timeline(v):
    s = v("stop")
    stored = s.where("plan_id % 3 = 0 and stop_order % 2 = 0").select("plan_id", F.col("stop_order").alias("seq"), F.lit("stop").alias("entry"), F.col("place_id").alias("ref"))
    return integrity.timeline(s, stored)


@query("select conv_id, count(*) as n_turns, string_agg(role, '>' order by turn) as roles from {conversations} group by conv_id")
def p15_keyed_lists(v):
    return v("conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]), ">").alias("roles"))


@query("""select n_name as label from {nation} union select r_name from {region}""")
def p20_label_text(v):
    return v("nation").select(F.col("n_name").alias("label")).union(v("region").select("r_name")).distinct()


@query("select area_id, name, x0, y0, x1, y1, researched from {area}")
def p21_disambiguation(v):
    return v("area").select("area_id", "name", "x0", "y0", "x1", "y1", "researched")


# ---------------------------------------------------------------- predicates

HEX = "[(2821300,3644100),(2821900,3644150),(2822200,3644500),(2821800,3644900),(2821400,3644800),(2821200,3644400)]"


def _ring():
    points = [tuple(map(int, p.split(","))) for p in HEX[2:-2].split("),(")]
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


_SIDES = "(values " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(*(lambda p: (p, p[1:] + p[:1]))([tuple(map(int, q.split(","))) for q in HEX[2:-2].split("),(")]))) + ") s(ax, ay, ex, ey)"
_INSIDE = f"""select place_id, sum(case when (ay > y) <> (ey > y) and x < (ex - ax)::double * (y - ay) / nullif(ey - ay, 0) + ax then 1 else 0 end) % 2 = 1 as crossed,
 bool_or((ex - ax) * (y - ay) - (ey - ay) * (x - ax) = 0 and x between least(ax, ex) and greatest(ax, ex) and y between least(ay, ey) and greatest(ay, ey)) as edge from {{places}}, {_SIDES} group by place_id"""


@query("select place_id from {places} where x between 2821200 and 2822000 and y between 3644200 and 3644800")
def f1_point_in_box(v):
    return v("places").where(geo.in_box(F.col("x"), F.col("y"), *map(F.lit, WINDOW))).select("place_id")


@query(f"select place_id from ({_INSIDE}) q where crossed and not edge")
def f2_within_ring(v):
    return v("places").where(geo.within(_ring(), F.col("x").cast("double"), F.col("y").cast("double"))).select("place_id")


@query(f"select place_id from ({_INSIDE}) q where crossed or edge")
def f3_ring_covers(v):
    return v("places").where(geo.covers(_ring(), F.col("x").cast("double"), F.col("y").cast("double"))).select("place_id")


@query("select place_id, round(d, 3) as distance_m from (select place_id, " + HAVERSINE.format(a="", b="28.22::double + 0 * ").replace("28.22::double + 0 * lat", "36.445::double").replace("28.22::double + 0 * lon", "28.22::double") + " as d from {places}) q where d <= 300")
def f4_within_distance(v):
    d = geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(28.22), F.lit(36.445))
    return v("places").withColumn("d", d).where("d <= 300").select("place_id", F.round("d", 3).alias("distance_m"))


HELD = ("ring", "small ring of the coast", "WIDGET", "bolts")


@query("select p_partkey, held from {part}, (values " + ", ".join(f"('{h}')" for h in HELD) + ") h(held) where contains(" + text.area_fold_sql("p_name") + ", " + text.area_fold_sql("held") + ") or contains(" + text.area_fold_sql("held") + ", " + text.area_fold_sql("p_name") + ")")
def f5_name_containment(v):
    a, b = text.area_fold(F.col("p_name")), text.area_fold(F.col("held"))
    return v("part").select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, HELD))).alias("held")).where(F.contains(a, b) | F.contains(b, a)).select("p_partkey", "held")


@query(f"select place_id, {canonical_sql('license')} as canonical, {bundleable_sql('kind', 'license')} as bundleable from {{places}}")
def f6_license_gate(v):
    return v("places").select("place_id", canonical(F.col("license")).alias("canonical"), bundleable(F.col("kind"), F.col("license")).alias("bundleable"))


@query("select area_id, x0 < x1 and y0 < y1 as valid, x1 - x0 as width, y1 - y0 as height from {area}")
def f8_box_valid(v):
    return v("area").select("area_id", ((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).alias("valid"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))


@query(r"""select page_id, path, not (path = '' or starts_with(path, '/') or contains(path, chr(92)) or contains(path, '/../') or starts_with(path, '../') or ends_with(path, '/..') or path = '..') as safe from (select page_id, case mod(page_id, 4) when 0 then url when 1 then '/' || url when 2 then replace(url, '//', '/../') else '' end as path from {pages}) q""")
def f9_path_safety(v):
    path = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/"), F.col("url"))).when(F.col("page_id") % 4 == 2, F.replace("url", F.lit("//"), F.lit("/../"))).otherwise("")
    p = F.col("path")
    bad = (p == "") | p.startswith("/") | F.contains(p, F.lit("\\")) | F.contains(p, F.lit("\0")) | F.exists(F.split(p, "/"), lambda s: s == "..")
    return v("pages").select("page_id", path.alias("path")).withColumn("safe", ~bad)


@query("select plan_id, user_id, status from {plan} where user_id = 7")
def f11_owner_scope(v):
    return v("plan").where("user_id = 7").select("plan_id", "user_id", "status")


@query("select plan_id, budget_m > 1000 as walk_ok, revision between 0 and 4 as revision_ok, budget_m > 1000 and revision between 0 and 4 as ok from {plan}")
def f12_plan_form(v):
    walk, revision = F.col("budget_m") > 1000, F.col("revision").between(0, 4)
    return v("plan").select("plan_id", walk.alias("walk_ok"), revision.alias("revision_ok"), (walk & revision).alias("ok"))


@query("""select event_id, min_by(action, rank) as action from (select event_id, action, rank from {events}, (values ('cl%', 'deny', 0), ('%a%', 'ask', 1), ('%', 'allow', 2)) r(p, action, rank) where event_type like p) q group by event_id""")
def f13_rule_precedence(v):
    e = F.col("event_type")
    rules = F.array_compact(F.array(F.when(e.like("cl%"), "0deny"), F.when(e.like("%a%"), "1ask"), F.lit("2allow")))
    return v("events").select("event_id", F.substring(F.array_min(rules), 2, 9).alias("action"))


@query("select event_id, (case when mod(event_id, 3) = 0 then user_id end is null) <> (case when mod(event_id, 2) = 0 then user_id end is null) as one_target from {events}")
def f15_one_target(v):
    a, b = F.when(F.col("event_id") % 3 == 0, F.col("user_id")), F.when(F.col("event_id") % 2 == 0, F.col("user_id"))
    return v("events").select("event_id", (a.isNull() != b.isNull()).alias("one_target"))


@query("select c_custkey, coalesce(p, b, n) as source from (select c_custkey, case when mod(c_custkey, 5) = 0 then 'polygon' end as p, case when mod(c_custkey, 3) = 0 then 'box' end as b, 'name' as n from {customer}) q")
def f17_input_precedence(v):
    k = F.col("c_custkey")
    return v("customer").select("c_custkey", F.coalesce(F.when(k % 5 == 0, "polygon"), F.when(k % 3 == 0, "box"), F.lit("name")).alias("source"))


@query("select l_orderkey, l_linenumber, count(*) as n from {lineitem} group by all having count(*) > 1")
def f19_duplicate_paths(v):
    return v("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("select p_partkey, entry, ref from (select p_partkey, 'brand' as entry, p_brand as ref from {part} union all select p_partkey, 'type', p_type from {part}) q join (select distinct p_type as t from {part} where p_size < 10) k on ref = t")
def f22_fetchable_paths(v):
    long = v("part").select("p_partkey", F.expr("stack(2, 'brand', p_brand, 'type', p_type) as (entry, ref)"))
    return long.join(v("part").where("p_size < 10").select(F.col("p_type").alias("ref")).distinct(), "ref", "left_semi").select("p_partkey", "entry", "ref")


@query("select plan_id, count(*) as n from {stop} where leg_m > 0 group by plan_id having count(*) >= 2")
def f23_feature_cleanup(v):
    return v("stop").where("leg_m > 0").groupBy("plan_id").agg(F.count("*").alias("n")).where("n >= 2")


# ---------------------------------------------------------------- joins


@query("select a.place_id as a, b.place_id as b from {places} a join {places} b on a.gers_id = b.gers_id and a.place_id < b.place_id")
def j1_id_pairs(v):
    return resolve.id_pairs(v("places"))


@query("select a.place_id as a, b.place_id as b, round(" + HAVERSINE.format(a="a.", b="b.") + ", 3) as distance_m from {places} a join {places} b on a.place_id < b.place_id and abs(a.y - b.y) < 40 and abs(a.x - b.x) < 60 where " + HAVERSINE.format(a="a.", b="b.") + " <= 25")
def j2_near_pairs(v):
    return resolve.near_pairs(v("places")).select("a", "b", F.round("distance_m", 3).alias("distance_m"))


@query("""select key, match, round(d, 3) as distance_m from (select i.s_suppkey as key, p.c_custkey as match, d, row_number() over (partition by i.s_suppkey order by d, p.c_custkey) as r from (select *, row_number() over () from (select place_id, lon, lat, cast((place_id - 1) / 2 as bigint) as s_suppkey from {places} where mod(place_id, 2) = 1) z) i,
 lateral (select cast(place_id / 2 as bigint) as c_custkey, """ + HAVERSINE.format(a="i.", b="q.") + """ as d from {places} q where mod(place_id, 2) = 0) p where d <= 25) w where r = 1""")
def j3_nearest(v):
    p = v("places")
    incoming = p.where("place_id % 2 = 1").select(F.expr("(place_id - 1) div 2").alias("key"), "lon", "lat")
    stored = p.where("place_id % 2 = 0").select(F.expr("place_id div 2").alias("key"), "lon", "lat")
    return resolve.nearest(incoming, stored).select("key", "match", F.round("distance_m", 3).alias("distance_m"))


@query("""select area_id, zone, shared from (select area_id, zone, shared, row_number() over (partition by area_id order by shared desc, zone) as r from (select area_id, zone, sum(greatest(least(a.x1, z.x1) - greatest(a.x0, z.x0), 0) * greatest(least(a.y1, z.y1) - greatest(a.y0, z.y0), 0))::bigint as shared from {area} a, {zone} z group by area_id, zone) s where shared > 0) q where r = 1""")
def j4_largest_overlap(v):
    return spatial.largest_overlap(v("area"), v("zone"))


@query("""with xs as (select distinct z.zone_id, unnest([greatest(z.x0, a.x0), least(z.x1, a.x1)]) as e from {zone} z, {area} a where a.researched and z.x0 < a.x1 and z.x1 > a.x0 and z.y0 < a.y1 and z.y1 > a.y0),
 ys as (select distinct z.zone_id, unnest([greatest(z.y0, a.y0), least(z.y1, a.y1)]) as e from {zone} z, {area} a where a.researched and z.x0 < a.x1 and z.x1 > a.x0 and z.y0 < a.y1 and z.y1 > a.y0),
 cx as (select zone_id, e as c0, lead(e) over (partition by zone_id order by e) as c1 from xs), cy as (select zone_id, e as d0, lead(e) over (partition by zone_id order by e) as d1 from ys),
 hit as (select distinct cx.zone_id, c0, c1, d0, d1 from cx join cy using (zone_id) join {area} a on a.researched and a.x0 <= c0 and a.x1 >= c1 and a.y0 <= d0 and a.y1 >= d1 where c1 is not null and d1 is not null)
 select z.zone_id as request_id, ((z.x1 - z.x0) * (z.y1 - z.y0))::bigint as asked, coalesce((select sum((c1 - c0) * (d1 - d0)) from hit where hit.zone_id = z.zone_id), 0)::bigint as covered from {zone} z""")
def j5_coverage(v):
    return spatial.coverage(v("zone").select(F.col("zone_id").alias("request_id"), "x0", "y0", "x1", "y1"), v("area").where("researched"))


@query("select area_id, place_id from {area} a join {places} p on p.x between a.x0 and a.x1 and p.y between a.y0 and a.y1")
def j6_places_in_area(v):
    return spatial.places_in(v("area"), v("places"))


@query("select site_id, field, count(*) as n from {observation} where site_id in (select p_partkey from {part} where p_size > 40) group by all")
def j7_semi_join(v):
    return v("observation").join(v("part").where("p_size > 40").select(F.col("p_partkey").alias("site_id")), "site_id", "left_semi").groupBy("site_id", "field").agg(F.count("*").alias("n"))


@query("select s.plan_id, s.stop_order, p.name, p.place_id is null as unknown_site from {stop} s left join {places} p using (place_id)")
def j8_stops_with_sites(v):
    p = v("places").select("place_id", "name", F.lit(True).alias("hit"))
    return v("stop").join(p, "place_id", "left").select("plan_id", "stop_order", "name", F.col("hit").isNull().alias("unknown_site"))


@query("select plan_id, place_id, max_by(leg_m, stop_order) as leg_m from {stop} group by plan_id, place_id")
def j9_last_leg_wins(v):
    return v("stop").groupBy("plan_id", "place_id").agg(F.max_by("leg_m", "stop_order").alias("leg_m"))


@query("select plan_id, stop_order, place_id from {stop} s where not exists (select 1 from {places} p where p.place_id = s.place_id)")
def j10_absent_sites(v):
    return feasibility.unknown_sites(v("stop"), v("places"))


@query("select user_id, count(*) as n from {events} a where event_type = 'click' and not exists (select 1 from {events} b where b.event_type = 'purchase' and b.user_id = a.user_id and cast(b.ts as date) = cast(a.ts as date)) group by user_id")
def j11_pre_without_post(v):
    e = v("events").withColumn("day", F.to_date("ts"))
    return e.where("event_type = 'click'").join(e.where("event_type = 'purchase'").select("user_id", "day").distinct(), ["user_id", "day"], "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


_SEGMENTS = "s as (select place_id as seg_id, area_key, x as x0, y as y0, x + mod(place_id * 31, 61) - 30 as x1, y + mod(place_id * 17, 61) - 30 as y1 from {places})"
_SNAPS = """n as (select zone_id, seg_id, area_key, sqrt(pow(px - x0 - t * (x1 - x0), 2) + pow(py - y0 - t * (y1 - y0), 2)) as distance from (select zone_id, z.x0 + 150 as px, z.y0 + 300 as py, s.*,
 least(greatest(coalesce(((z.x0 + 150 - s.x0) * (s.x1 - s.x0) + (z.y0 + 300 - s.y0) * (s.y1 - s.y0)) / nullif(((s.x1 - s.x0) * (s.x1 - s.x0) + (s.y1 - s.y0) * (s.y1 - s.y0))::double, 0), 0), 0), 1) as t from {zone} z, s) q)"""


def _anchors(v):
    return v("zone").select(F.col("zone_id").alias("key"), (F.col("x0") + 150).alias("x"), (F.col("y0") + 300).alias("y"))


@query(f"with {_SEGMENTS}, {_SNAPS} select zone_id as key, min_by(seg_id, distance * 1e12 + seg_id) as seg_id, round(min(distance), 6) as distance from n where distance <= 400 group by zone_id")
def j13_nearest_edge(v):
    return network.nearest_edges(_anchors(v), _segments(v), 400).select("key", "seg_id", F.round("distance", 6).alias("distance"))


@query("select d.lang, g.g as glyph_range from (select distinct lang from {documents}) d, (select unnest(range(0, 40)) as g) g where not exists (select 1 from (select lang, unnest(list_distinct(list_transform(string_split(text, ''), lambda c: cast(floor(unicode(c) / 256) as bigint)))) as r from {documents}) u where u.lang = d.lang and u.r = g.g)")
def j14_blind_ranges(v):
    used = t15_ranges(v("documents"))
    langs = v("documents").select("lang").distinct().withColumn("glyph_range", F.explode(F.sequence(F.lit(0), F.lit(39)).cast("array<bigint>")))
    return langs.join(used, ["lang", "glyph_range"], "left_anti")


@query("select o.o_orderkey, o.o_orderdate from {orders} o join (select o_orderkey from {orders} where o_totalprice > 300000 union select l_orderkey from {lineitem} where l_quantity > 49) k using (o_orderkey)")
def j15_keep_ids(v):
    ids = v("orders").where("o_totalprice > 300000").select("o_orderkey").union(v("lineitem").where("l_quantity > 49").select("l_orderkey")).distinct()
    return v("orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_orderdate")


@query("select o_orderkey, coalesce(case when mod(o_orderkey, 4) <> 0 then o_orderpriority end, c_mktsegment) as frame from {orders} left join {customer} on o_custkey = c_custkey and c_acctbal > 0")
def j16_backfill(v):
    c = v("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return v("orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")), F.col("c_mktsegment")).alias("frame"))


@query("select plan_id, user_id, c_name from {plan} left join {customer} on user_id = c_custkey")
def j17_plan_index(v):
    return v("plan").join(v("customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left").select("plan_id", "user_id", "c_name")


# ---------------------------------------------------------------- merging and aggregation

ORDER = f"confidence desc, {trust_sql('kind')}, observed_at desc, kind, src, cast(value as varchar)"


@query("select area_id, count(distinct p.place_id) as n, min(observed_at) as first_seen from {area} a left join {places} p on p.x between a.x0 and a.x1 and p.y between a.y0 and a.y1 left join {observation} o on o.site_id = p.place_id group by area_id")
def a1_site_counts(v):
    seen = v("observation").groupBy(F.col("site_id").alias("place_id")).agg(F.min("observed_at").alias("first"))
    inside = spatial.places_in(v("area"), v("places")).join(seen, "place_id", "left").groupBy("area_id").agg(F.count("*").alias("n"), F.min("first").alias("first_seen"))
    return v("area").select("area_id").join(inside, "area_id", "left").select("area_id", F.coalesce("n", F.lit(0)).alias("n"), "first_seen")


@query(f"select site_id, field, value, kind, src, confidence, observed_at from (select *, row_number() over (partition by site_id, field order by {ORDER}) as r from {{observation}}) q where r = 1")
def a3_winners(v):
    return merge.winners(v("observation"))


@query(f"select site_id, field, count(distinct value) as n_values, count(*) as n_candidates, 'picked:' || cast(first(src order by {ORDER}) as varchar) as resolution, string_agg(cast(value as varchar), ',' order by {ORDER}) as candidates from {{observation}} group by site_id, field having count(distinct value) > 1")
def a4_conflicts(v):
    return merge.conflicts(v("observation"))


@query(f"select site_id, field, value, kind, src, confidence from (select *, row_number() over (partition by site_id, field, value order by {ORDER}) as r from {{observation}}) q where r = 1")
def a5_unions(v):
    return merge.union_values(v("observation"))


@query("select site_id, max(observed_at) as updated_at, count(distinct field) as n_fields, count(distinct (field, value)) as n_values, string_agg(distinct kind, ',' order by kind) as kinds from {observation} group by site_id")
def a6_record_level(v):
    return merge.record_level(v("observation"))


@query(f"select site_id, resolution, count(*) as n from (select distinct site_id, field, 'picked:' || cast(first(src order by {ORDER}) as varchar) as resolution from {{observation}} group by site_id, field having count(distinct value) > 1) q group by all")
def a7_carried_conflicts(v):
    return merge.conflicts(v("observation")).select("site_id", "field", "resolution").distinct().groupBy("site_id", "resolution").agg(F.count("*").alias("n"))


@query("select distinct site_id, kind, src, license from {observation}")
def a8_source_refs(v):
    return merge.source_refs(v("observation"))


@query("select site_id, string_agg(distinct kind || '/' || license, '; ' order by kind || '/' || license) as credits from {observation} group by site_id")
def a9_attributions(v):
    return merge.attributions(v("observation"))


@query(f"select case when license = 'ODbL-1.0' then 0 else 1 end as section, license, kind, attribution, n, case when n = 1 then '1 value' else n || ' values' end as label from (select {canonical_sql('license')} as license, kind, case when src <> 3 then 'source ' || src end as attribution, count(*) as n from {{observation}} group by all) q where license is not null")
def a10_credits(v):
    return quarantine.credits(v("observation").withColumn("attribution", F.when(F.col("src") != 3, F.concat(F.lit("source "), F.col("src").cast("string")))))


@query("select conv_id, role, 'turn/' || lpad(min(turn)::varchar, 6, '0') as main, coalesce(string_agg('turn/' || lpad(turn::varchar, 6, '0'), ',' order by turn) filter (turn > first), '') as others from (select distinct conv_id, role, turn, min(turn) over (partition by conv_id, role) as first from {conversations}) q group by conv_id, role")
def a11_articles(v):
    revisions = v("conversations").select("conv_id", "role", F.concat(F.lit("turn/"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("url"))
    return quarantine.articles(revisions, "conv_id", "role").select("conv_id", "role", "main", F.array_join("others", ",").alias("others"))


@query(f"select site_id, string_agg(distinct {canonical_sql('license')}, ' AND ' order by {canonical_sql('license')}) as text_license from {{observation}} group by site_id")
def a12_text_license(v):
    return quarantine.text_license(v("observation"))


@query("select plan_id, sum(leg_m)::bigint as walked_m, count(*) as n_stops, budget_m, sum(leg_m) > budget_m and abs(sum(leg_m) - budget_m) > 1e-9 * greatest(sum(leg_m), budget_m) as over from {stop} join {plan} using (plan_id) group by plan_id, budget_m")
def a13_walking_totals(v):
    return feasibility.walking_totals(v("stop"), v("plan"))


@query("select kind, count(*) as n, count(gers_id) as with_id, sum(case when license = 'proprietary' then 1 else 0 end)::bigint as refused from {places} group by kind")
def a14_research_summary(v):
    return v("places").groupBy("kind").agg(F.count("*").alias("n"), F.count("gers_id").alias("with_id"), F.sum(F.when(F.col("license") == "proprietary", 1).otherwise(0)).alias("refused"))


@query("select event_type, hour(ts) as hour, count(*) as n from {events} group by all")
def a16_buckets(v):
    return v("events").groupBy("event_type", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query("select plan_id, string_agg(distinct p.kind, ',' order by p.kind) as credits from {stop} join {places} p using (place_id) group by plan_id")
def a18_plan_credits(v):
    return v("stop").join(v("places").select("place_id", "kind"), "place_id").groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("credits"))


@query("select source, sum(size)::bigint as bytes, sum(size) > 200000 as over from (select distinct source, n_chars as size, doc_id from {documents}) q group by source")
def a20_bundle_size(v):
    files = v("documents").select("source", F.col("n_chars").alias("size"), "doc_id").distinct()
    return files.groupBy("source").agg(F.sum("size").alias("bytes")).withColumn("over", F.col("bytes") > 200000)


@query("select area_key, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from {places} group by area_key")
def a21_bounds(v):
    return v("places").groupBy("area_key").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as r from {lineitem}) q where r = 1")
def w1_dedupe(v):
    return merge.without_duplicates(v("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("""with recursive walk as (select plan_id, stop_order, start_min, dwell, cast(0 as bigint) as off, cast(start_min * 60 as bigint) as start_s from {stop} where stop_order = 0
 union all select plan_id, stop_order, start_min, dwell, fell + late, start_min * 60 + (fell + late) * 86400 from (select s.plan_id, s.stop_order, s.start_min, s.dwell, fell, greatest(cast(floor((w.start_s + w.dwell * 60 + s.leg_s - s.start_min * 60 - fell * 86400) / 86400.0) as bigint), 0) as late from walk w join (select * from {stop}) s on s.plan_id = w.plan_id and s.stop_order = w.stop_order + 1, lateral (select w.off + case when s.start_min < w.start_min then 1 else 0 end as fell) f) q)
 select plan_id, stop_order, start_s from walk""")
def w2_midnight_rollover(v):
    return feasibility.local_starts(v("stop"))


@query("""select plan_id, stop_order, (540 + sum(case when stop_order = 0 then 0 else ceil(leg_s / 60.0) end) over o + coalesce(sum(dwell) over (partition by plan_id order by stop_order rows between unbounded preceding and 1 preceding), 0))::bigint as start_clock from {stop} window o as (partition by plan_id order by stop_order rows between unbounded preceding and current row)""")
def w3_running_schedule(v):
    return feasibility.running_schedule(v("stop"))


@query("select plan_id, stop_order, lag(place_id) over (partition by plan_id order by stop_order) as from_place, place_id as to_place from {stop} where leg_m >= 500")
def w4_routable_pairs(v):
    kept = v("stop").where("leg_m >= 500")
    return kept.select("plan_id", "stop_order", F.lag("place_id").over(W.partitionBy("plan_id").orderBy("stop_order")).alias("from_place"), F.col("place_id").alias("to_place"))


@query("select area_key, round(sum(d), 1) as length_m from (select area_key, " + HAVERSINE.format(a="", b="n").replace("nlat", "nlat").replace("nlon", "nlon") + " as d from (select area_key, lon, lat, lead(lon) over w as nlon, lead(lat) over w as nlat from {places} window w as (partition by area_key order by place_id)) q where nlon is not null) s group by area_key")
def w5_path_length(v):
    along = W.partitionBy("area_key").orderBy("place_id")
    ahead = v("places").select("area_key", "lon", "lat", F.lead("lon").over(along).alias("to_lon"), F.lead("lat").over(along).alias("to_lat")).where("to_lon is not null")
    length = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("to_lon"), F.col("to_lat"))
    return ahead.groupBy("area_key").agg(F.round(F.sum(length), 1).alias("length_m"))


@query("select plan_id, created_at, status from {plan} order by created_at desc, plan_id desc limit 50")
def o1_newest(v):
    return lifecycle.newest(v("plan")).select("plan_id", "created_at", "status")


@query("select place_id, row_number() over (order by coalesce(list_position([40, 2, 30, 4], place_id), 4 + place_id + 1)) as rank from {places}")
def o2_rank_by_list(v):
    asked = F.array(*(F.lit(k).cast("long") for k in (40, 2, 30, 4)))
    at = F.nullif(F.array_position(asked, F.col("place_id")), F.lit(0).cast("long"))
    keyed = v("places").select("place_id", F.coalesce(at, F.col("place_id") + 5).alias("key"))
    # Ranks within ranges, and the rows of the ranges before.
    ranged = staged(keyed.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row per range
    within = ranged.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("key")))
    return within.join(F.broadcast(offsets), "part").select("place_id", (F.col("r") + F.col("before")).cast("long").alias("rank"))


@query("select plan_id, place_id, r from (select plan_id, place_id, row_number() over (partition by plan_id order by first_order) as r from (select plan_id, place_id, min(stop_order) as first_order from {stop} group by all) q) w where r <= 3")
def o3_cap_stops(v):
    once = v("stop").groupBy("plan_id", "place_id").agg(F.min("stop_order").alias("first_order"))
    return once.withColumn("r", F.row_number().over(W.partitionBy("plan_id").orderBy("first_order")).cast("long")).where("r <= 3").select("plan_id", "place_id", "r")


@query("select l_partkey as id from {lineitem} where l_quantity < 2 union select p_partkey from {part} where p_size = 1")
def u1_union_ids(v):
    return v("lineitem").where("l_quantity < 2").select(F.col("l_partkey").alias("id")).union(v("part").where("p_size = 1").select("p_partkey")).distinct()


@query("select kind, count(*) as n from (select kind from {places} union all select kind from {observation}) q group by kind")
def u2_bag_union(v):
    return v("places").select("kind").unionByName(v("observation").select("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("select a.source, string_agg(a.lang, ',' order by a.lang) as shared from (select distinct source, lang from {documents}) a join (select distinct lang from {documents} where source = 'src0') b using (lang) group by a.source")
def u3_key_intersection(v):
    held = v("documents").select("source", "lang").distinct()
    wanted = held.where("source = 'src0'").select("lang")
    return held.join(wanted, "lang", "left_semi").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("shared"))


# ---------------------------------------------------------------- geometry, graphs


@query("select a.place_id as a, round(" + HAVERSINE.format(a="a.", b="b.") + ", 3) as m, round(300 / (111320.0::double * greatest(cos(radians(a.lat)), 0.01)), 9) as radius from {places} a join {places} b on b.place_id = a.place_id + 2")
def g2_haversine(v):
    p = v("places")
    b = p.select((F.col("place_id") - 2).alias("place_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return p.join(b, "place_id").select(F.col("place_id").alias("a"), F.round(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 3).alias("m"), F.round(geo.degree_radius(F.lit(300.0), F.col("lat")), 9).alias("radius"))


@query("select place_id, lon between -180 and 180 and lat between -90 and 90 as ok, '{{\"type\":\"Point\",\"x\":' || x || ',\"y\":' || y || '}}' as point from {places}")
def g3_point_json(v):
    ok = geo.valid_lon(F.col("lon")) & geo.valid_lat(F.col("lat"))
    return v("places").select("place_id", ok.alias("ok"), F.to_json(F.struct(F.lit("Point").alias("type"), "x", "y")).alias("point"))


@query("""with recursive pairs as (select u, v from {graph_edge} union select v, u from {graph_edge}), reach as (select u as node, u as root from pairs union select p.v, r.root from reach r join pairs p on p.u = r.node and p.v > r.root),
 best as (select node, min(root) as root from reach group by node), sizes as (select root, count(*) as n_nodes from best group by root) select s.root, n_nodes, count(*) as n_edges from sizes s join best b on b.root = s.root join {graph_edge} e on e.u = b.node group by all""")
def g6_components(v):
    return spatial.component_sizes(v("graph_edge"))


@query("select plan_id, datediff('day', cast(created_at as date), date '2000-01-01') as age_days, datediff('day', cast(created_at as date), date '2000-01-01') > 1000 as stale from {plan}")
def g8_staleness(v):
    age = F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("created_at")).cast("long")
    return v("plan").select("plan_id", age.alias("age_days"), (age > 1000).alias("stale"))


# ---------------------------------------------------------------- text


@query("select n_nationkey, " + text.area_fold_sql("n_name || '  ß' || chr(9) || 'ς'") + " as folded from {nation}")
def t4_area_fold(v):
    return v("nation").select("n_nationkey", text.area_fold(F.concat("n_name", F.lit("  ß\tς"))).alias("folded"))


@query("""select n_nationkey, case when n = 'nation_1' then 1.0 when starts_with(n, 'nation_1') or starts_with('nation_1', n) then 0.6 when contains(n, 'nation_1') or contains('nation_1', n) then 0.45 else 0.0 end::double as confidence from (select n_nationkey, lower(n_name) as n from {nation}) q""")
def t5_match_confidence(v):
    return v("nation").select("n_nationkey", text.match_confidence(F.lit("nation_1"), text.area_fold(F.col("n_name"))).alias("confidence"))


@query("""select needle, case when strong = 1 or (strong = 0 and plausible = 1) then 'chosen' when strong + plausible > 0 then 'ambiguous' else 'unresolvable' end as outcome from (select needle, count(*) filter (c >= 0.8) as strong, count(*) filter (c >= 0.4) as plausible from (select r.r_name as needle, case when n = lower(r.r_name) then 1.0 when starts_with(n, lower(r.r_name)) or starts_with(lower(r.r_name), n) then 0.6 when contains(n, lower(r.r_name)) or contains(lower(r.r_name), n) then 0.45 else 0.0 end as c from {region} r, (select lower(n_name) as n from {nation} union all select lower(r_name) from {region} where r_regionkey < 3 union all select lower(r_name) from {region} where r_regionkey < 1) x) q group by needle) w""")
def t6_choose(v):
    names = v("nation").select(text.area_fold(F.col("n_name")).alias("n")).unionAll(v("region").where("r_regionkey < 3").select(text.area_fold(F.col("r_name")))).unionAll(v("region").where("r_regionkey < 1").select(text.area_fold(F.col("r_name"))))
    scored = v("region").select(F.col("r_name").alias("needle")).join(F.broadcast(names), F.lit(True)).withColumn("c", text.match_confidence(text.area_fold(F.col("needle")), F.col("n")))  # both of fixed size
    counts = scored.groupBy("needle").agg(F.count(F.when(F.col("c") >= 0.8, 1)).alias("strong"), F.count(F.when(F.col("c") >= 0.4, 1)).alias("plausible"))
    return counts.select("needle", F.when((F.col("strong") == 1) | ((F.col("strong") == 0) & (F.col("plausible") == 1)), "chosen").when(F.col("strong") + F.col("plausible") > 0, "ambiguous").otherwise("unresolvable").alias("outcome"))


@query(r"select doc_id, length(regexp_replace(text, '[^A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]|[^\p{L}]', '', 'g'))::bigint as latin from {documents}".replace("{C0}", "{{C0}}").replace("{24F}", "{{24F}}").replace("{1E00}", "{{1E00}}").replace("{1EFF}", "{{1EFF}}").replace("{L}", "{{L}}"))
def t7_script_counts(v):
    found = F.filter(text.script_counts(F.coalesce("text", F.lit("")), ("Latn",)), lambda c: c["script"] == "Latn")
    return v("documents").select("doc_id", F.coalesce(F.get(found, F.lit(0))["n"], F.lit(0)).cast("long").alias("latin"))


@query(r"select doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))::bigint as words, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) between 40 and 220 as fits from {documents}")
def t10_word_bounds(v):
    words = text.word_count(F.coalesce("text", F.lit(""))).cast("long")
    return v("documents").select("doc_id", words.alias("words"), words.between(40, 220).alias("fits"))


@query(r"""with d as (select doc_id, unnest(list_distinct(list_transform(range(1, len(t) - 19), lambda i: array_to_string(t[i:i+20], ' ')))) as g from (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as t from {documents}) q where len(t) >= 21),
 b as (select item_id, unnest(list_distinct(list_transform(range(1, len(t) - 19), lambda i: array_to_string(t[i:i+20], ' ')))) as g from (select item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as t from {benchmark}) q where len(t) >= 21)
 select doc_id, item_id, count(*) as n_runs from d join b using (g) group by all""")
def t11_verbatim_runs(v):
    docs = v("documents").select("doc_id", text.word_tokens(F.col("text")).alias("t"))
    items = v("benchmark").select("item_id", text.word_tokens(F.col("text")).alias("t"))
    return text.shared_runs(docs, items, "doc_id", "item_id", 21)


@query(r"select doc_id, len(regexp_extract_all(text, '[-+]?[0-9]{{1,3}}\.[0-9]+[ ,;]+[-+]?[0-9]{{1,3}}\.[0-9]+'))::bigint as pairs from {documents}")
def t12_coordinate_pairs(v):
    return v("documents").select("doc_id", F.regexp_count("text", F.lit(r"[-+]?[0-9]{1,3}\.[0-9]+[ ,;]+[-+]?[0-9]{1,3}\.[0-9]+")).cast("long").alias("pairs"))


@query("select event_id, json_valid(props) and json_type(props) = 'OBJECT' as usable from {events}")
def t13_reply_shape(v):
    usable = F.coalesce(F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT"), F.lit(False))
    return v("events").select("event_id", usable.alias("usable"))


@query("select doc_id, case when regexp_matches(id, '^[a-z]{{2}}:.+$') then substr(id, 4) end as title from (select doc_id, lang || ':' || source as id from {documents}) q")
def t14_titles(v):
    ident = F.concat_ws(":", "lang", "source")
    return v("documents").select("doc_id", F.when(ident.rlike("^[a-z]{2}:.+$"), F.substring(ident, 4, 1 << 20)).alias("title"))


def t15_ranges(documents: DataFrame) -> DataFrame:
    """(lang, glyph_range) of code points by 256."""
    chars = documents.select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").distinct()
    code = F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("long")
    return chars.select("lang", F.floor(code / 256).alias("glyph_range")).distinct()


@query("select distinct lang, glyph_range from (select lang, unnest(list_distinct(list_transform(string_split(text, ''), lambda c: cast(floor(unicode(c) / 256) as bigint)))) as glyph_range from {documents}) q where glyph_range >= 0")
def t15_glyph_ranges(v):
    return t15_ranges(v("documents"))


@query(r"select distinct lower(split_part(regexp_replace(cmd, '^([A-Z]+=[^ ]* )+', ''), ' ', 1)) as head from (select 'ENV=' || o_orderstatus || ' ' || o_orderpriority as cmd from {orders}) q")
def t18_rule_heads(v):
    cmd = F.concat(F.lit("ENV="), F.col("o_orderstatus"), F.lit(" "), F.col("o_orderpriority"))
    return v("orders").select(F.lower(F.split_part(F.regexp_replace(cmd, "^([A-Z]+=[^ ]* )+", ""), F.lit(" "), F.lit(1))).alias("head")).distinct()


# ---------------------------------------------------------------- hours, serialisation, quarantine

_HOURS = "case mod(p_partkey, 7) when 0 then null when 1 then 'Mo-Fr 09:00-17:00' when 2 then 'SH off' when 3 then 'PH off; Mo 10:00-12:00' when 4 then 'sunrise-sunset' when 5 then 'Mo \"SHop\"' else ' ' end"


@query(f"""select p_partkey, case when h is null or trim(h) = '' then 'no_expression' when regexp_matches(p, '(^|[^A-Za-z])SH([^A-Za-z]|$)') then 'school_holiday_selector' when regexp_matches(p, '(^|[^A-Za-z])PH([^A-Za-z]|$)') and c is null then 'public_holiday_without_country' when regexp_matches(p, '(^|[^A-Za-z])(sunrise|sunset|dawn|dusk)([^A-Za-z]|$)') then 'sun_event_unsupported' when z is null then 'unknown_timezone' end as guard
 from (select p_partkey, {_HOURS} as h, regexp_replace({_HOURS}, '"[^"]*"', ' ', 'g') as p, case when mod(p_partkey, 2) = 0 then 'GR' end as c, case when mod(p_partkey, 5) > 0 then 'Europe/Athens' end as z from {{part}}) q""")
def d2_hours_guards(v):
    k = F.col("p_partkey")
    guard = feasibility.hours_guard(F.expr(_HOURS), F.when(k % 5 > 0, "Europe/Athens"), F.when(k % 2 == 0, "GR"))
    return v("part").select("p_partkey", guard.alias("guard"))


@query("""select plan_id, stop_order, minute from (select s.plan_id, s.stop_order, case when s.start_min >= mod(p.place_id, 5) * 60 + 360 and s.start_min < mod(p.place_id, 5) * 60 + 960 then mod(p.place_id, 5) * 60 + 960 else s.start_min end as minute, s.start_min + greatest(s.dwell, 1) as b from {stop} s join {places} p using (place_id)) q where minute < b""")
def d1_first_uncovered(v):
    opening = v("places").select("place_id", (F.col("place_id") % 5 * 60 + 360).alias("open_min"), (F.col("place_id") % 5 * 60 + 960).alias("close_min"))
    return feasibility.first_uncovered(v("stop").join(opening.select("place_id"), "place_id", "left_semi"), opening)


@query("""with w as (select plan_id, sum(leg_m) as m from {stop} group by plan_id) select plan_id, 'walking_budget' as code, cast(-1 as bigint) as stop_order, true as blocking from w join {plan} using (plan_id) where m > budget_m
 union all select plan_id, 'unknown_site', stop_order, true from {stop} s where not exists (select 1 from {places} p where p.place_id = s.place_id)
 union all select plan_id, 'outside_opening_window', stop_order, true from (select s.plan_id, s.stop_order, case when s.start_min >= 480 and s.start_min < 1080 then 1080 else s.start_min end as minute, s.start_min + greatest(s.dwell, 1) as b from {stop} s join {places} p using (place_id)) q where minute < b""")
def feasibility_verdicts(v):
    opening = v("places").select("place_id", F.lit(480).cast("long").alias("open_min"), F.lit(1080).cast("long").alias("close_min"))
    return feasibility.verdicts(v("stop"), v("plan"), v("places"), opening)


@query("select page_id, sha256(html) as digest, md5(url) as key, 'bnd_' || replace(md5(url), '-', '') as bundle_id from {pages}")
def k2_digests(v):
    return v("pages").select("page_id", F.sha2("html", 256).alias("digest"), F.md5("url").alias("key"), F.concat(F.lit("bnd_"), F.replace(F.md5("url"), F.lit("-"), F.lit(""))).alias("bundle_id"))


@query("select site_id, sha256(string_agg(line, ',' order by line)) as digest from (select distinct site_id, field || ':' || value as line from {observation}) q group by site_id")
def k2_directory_digest(v):
    lines = v("observation").select("site_id", F.concat_ws(":", "field", "value").alias("line")).distinct()
    return lines.groupBy("site_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ","), 256).alias("digest"))


_JUDGED = f"select *, '/' || field || '/' || (row_number() over (partition by site_id, field order by value, src, kind, license, confidence, observed_at) - 1) as path, {bundleable_sql('kind', 'license')} as ok from {{observation}}"


@query(f"select site_id, path, case when gone then 'site' else 'value' end as reason from (select *, bool_or(field = 'R' and not ok) over (partition by site_id) as gone from ({_JUDGED}) j) q where not ok and (not gone or field = 'R')")
def q1_quarantine(v):
    return quarantine.withheld(v("observation"), "R")


@query(f"select site_id, count(*) as n, sum(value)::bigint as total from ({_JUDGED}) j where ok and site_id not in (select site_id from ({_JUDGED}) k where not ok and field = 'R') group by site_id")
def q2_released(v):
    return quarantine.released(v("observation"), "R").groupBy("site_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("select count(*) as n, sum(case when kind = 'user' then 1 else 0 end)::bigint as from_users from {observation}")
def q5_user_gate(v):
    return v("observation").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "user", 1).otherwise(0)).alias("from_users"))


@query(f"select site_id, field, value, license, kind from {{observation}} where not {bundleable_sql('kind', 'license')} or ({canonical_sql('license')} in ('ODbL-1.0','CC-BY-4.0','CC-BY-SA-4.0','CDLA-Permissive-2.0','Apache-2.0','MIT') and mod(src, 4) = 0)")
def f18_uncredited(v):
    credited = v("observation").withColumn("credit", F.when(F.col("src") % 4 != 0, F.col("kind")))
    return quarantine.uncredited(credited, "credit").select("site_id", "field", "value", "license", "kind")


# ---------------------------------------------------------------- lifecycle, streams

_ACTION = "case mod(l_partkey + l_linenumber, 8) when 0 then 'propose' when 1 then 'approve' when 2 then 'claim' when 3 then 'finish' when 4 then 'fail' when 5 then 'rearm' when 6 then case when mod(l_suppkey, 4) = 0 then 'supersede' else 'propose' end else 'approve' end"


def _log(v):
    return v("lineitem").selectExpr("l_orderkey as plan_id", "l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey as seq", f"{_ACTION} as action").distinct()


@query(f"""with recursive log as (select plan_id, seq, action, row_number() over (partition by plan_id order by seq) as n from (select distinct l_orderkey as plan_id, cast(l_linenumber as bigint) * 100000000 + l_partkey * 10000 + l_suppkey as seq, {_ACTION} as action from {{lineitem}}) d),
 fold as (select plan_id, cast(0 as bigint) as n, 'proposing' as state, cast(0 as bigint) as applied from (select distinct plan_id from log) p union all
 select plan_id, n, state2, applied + case when state2 <> state then 1 else 0 end from (select f.plan_id, l.n, f.state, f.applied, case when action = 'propose' and state in ('proposing', 'proposed') then 'proposed' when action = 'approve' and state = 'proposed' then 'approved' when action = 'claim' and state = 'approved' then 'compiling' when action = 'finish' and state = 'compiling' then 'compiled' when action = 'fail' and state = 'compiling' then 'failed' when action = 'rearm' and state = 'failed' then 'approved' when action = 'supersede' and state in ('proposing', 'proposed', 'approved') then 'superseded' else state end as state2 from fold f join log l on l.plan_id = f.plan_id and l.n = f.n + 1) q)
 select plan_id, arg_max(state, n) as state, max(applied) as n_applied from fold group by plan_id""")
def c7_fold_states(v):
    return lifecycle.fold_states(_log(v))


@query("""select plan_id, revision, case when mod(plan_id, 5) = 0 and status in ('proposing', 'proposed', 'approved') then 'superseded' else status end as status, case when mod(plan_id, 5) = 0 and status in ('proposing', 'proposed', 'approved') then plan_id + 4000000000 end as superseded_by from {plan}
 union all select plan_id + 4000000000, revision + 1, 'proposing', null from {plan} where mod(plan_id, 5) = 0 and status in ('proposing', 'proposed', 'approved')""")
def l8_superseded(v):
    plans = v("plan").select("plan_id", "revision", "status")
    asked = plans.where("plan_id % 5 = 0").select("plan_id", (F.col("plan_id") + 4_000_000_000).alias("new_id"))
    return lifecycle.supersede(plans, asked)


@query("select plan_id, created_at from {plan} where status = 'compiling' and created_at < timestamp '1996-01-01' - interval 30 minute")
def l7_stale_claims(v):
    return lifecycle.stale(v("plan"), F.lit("1996-01-01").cast("timestamp_ntz")).select("plan_id", "created_at")


@query("""select plan_id, c as check_name from (select plan_id, unnest([case when status in ('approved','compiling','compiled','failed') and (a is null or not f) then 'approval' end, case when (a is null) <> (b is null) then 'approver' end, case when (status = 'superseded') <> (s is not null) then 'superseded' end]) as c from (select plan_id, status, case when mod(plan_id, 3) > 0 then created_at end as a, case when mod(plan_id, 4) > 0 then user_id end as b, mod(plan_id, 7) > 0 as f, case when mod(plan_id, 11) = 0 then plan_id end as s from {plan}) q) w where c is not null""")
def l9_row_checks(v):
    k = F.col("plan_id")
    return lifecycle.broken_rows(v("plan").withColumns({"approved_at": F.when(k % 3 > 0, F.col("created_at")), "approved_by": F.when(k % 4 > 0, F.col("user_id")), "feasible": k % 7 > 0, "superseded_by": F.when(k % 11 == 0, k)}))


@query("""select plan_id, case when mod(plan_id, 9) = 0 then 'plan_stale' when status in ('approved','compiling','compiled','failed') then 'already_approved' when status = 'superseded' then 'superseded' when mod(plan_id, 7) = 0 then 'infeasible' when status <> 'proposed' then 'not_approvable' end as refusal from {plan}""")
def l3_refusals(v):
    k = F.col("plan_id")
    return v("plan").select("plan_id", lifecycle.refusal(k, k % 9 != 0, F.col("status"), k % 7 != 0).alias("refusal"))


@query("select count(*) as n from (select distinct site_id, field, observed_at, kind, license, src, value from {observation}) q")
def c6_ledger_append(v):
    rows = merge.ledger_rows(v("observation"))
    return merge.append_ledger(rows.limit(0), rows).agg(F.count("*").alias("n"))


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from {events} group by all")
def st_tumbling(v):
    return ledger.tumbling(v("events"))


@query("select conv_id, string_agg(role, ',' order by turn) like '%user%assistant%' as in_order from {conversations} group by conv_id")
def st4_phase_order(v):
    return v("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]), ",").like("%user%assistant%").alias("in_order"))


# ---------------------------------------------------------------- composites without an SQL form


def _names(v):
    p = v("places")
    shown = F.regexp_replace("name", "#0+", " ")
    return p.select(F.col("place_id").alias("key"), F.lit("und").alias("tag"), shown.alias("name")).union(p.where("place_id % 2 = 0").select("place_id", F.lit("en"), shown))


@query()
def j2_match_edges(v):
    return resolve.match_edges(v("places"), _names(v))


@query()
def c1_clusters(v):
    return resolve.matched_clusters(v("places"), _names(v))


@query()
def g1_geodesic(v):
    near = resolve.near_pairs(v("places"), metres=50.0, distance=geo.geodesic_m)
    return near.select("a", "b", F.round("distance_m", 3).alias("distance_m"))


@query()
def t1_name_fold(v):
    return v("documents").select("doc_id", text.name_fold("text").alias("folded"))


@query()
def t8_romanise(v):
    return v("nation").select("n_nationkey", text.romanise_greek(F.concat(F.lit("Ρόδος Αύγουστος μπαρ "), F.col("n_name"))).alias("latin"))


# ---------------------------------------------------------------- more of each kind


@query("select o_orderkey, o_orderpriority from {orders} where o_orderstatus = 'F'")
def s5_partition_scan(v):
    orders = v("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    folder = shared_dir(orders.sparkSession)
    orders.write.partitionBy("o_orderstatus").parquet(folder)
    return orders.sparkSession.read.option("basePath", folder).parquet(folder).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")


@query("select p_partkey, case when mod(p_partkey, 2) = 0 then 'see' else 'eat' end as template, p_name as name from {part} where p_name <> ''")
def s10_listings(v):
    page = F.concat(F.lit("x {{"), F.when(F.col("p_partkey") % 2 == 0, "see").otherwise("Eat"), F.lit(" | name="), F.col("p_name"), F.lit(" | alt=[[a|b]] {{c|d}} | url= }} {{nope|name=z}}"))
    parsed = v("part").select("p_partkey", F.explode(wikitext.parse_listings(page)).alias("l"))
    return parsed.select("p_partkey", F.col("l.template").alias("template"), F.element_at("l.fields", "name").alias("name"))


@query("select event_id, case mod(event_id, 4) when 0 then 'advisory' when 1 then 'blocking' when 2 then null else 'blocking' end as verdict from {events}")
def p13_verdict_split(v):
    entry = F.parse_json(F.expr("""case event_id % 4 when 0 then '{"code":"a","blocking":false}' when 1 then '"bare"' when 2 then '5' else '{"code":"b","blocking":"maybe"}' end"""))
    kind = F.schema_of_variant(entry)
    flag = F.when(kind.startswith("OBJECT"), F.try_variant_get(entry, "$.blocking", "string"))
    return v("events").select("event_id", F.when(kind == "STRING", "blocking").when(kind.startswith("OBJECT"), F.when(flag == "false", "advisory").otherwise("blocking")).alias("verdict"))


@query("select doc_id, coalesce(case when lang = 'en' then 'English' when lang = 'de' then 'Deutsch' end, lang) as title from {documents}")
def p17_title_remap(v):
    remap = v("documents").sparkSession.createDataFrame([("en", "English"), ("de", "Deutsch")], "lang string, to string")
    return v("documents").join(F.broadcast(remap), "lang", "left").select("doc_id", F.coalesce("to", "lang").alias("title"))


@query("select place_id, '{{\"kind\":\"' || kind || '\",\"value\":{{\"type\":\"Point\",\"coordinates\":[' || x || ',' || y || ']}}}}' as candidate from {places}")
def p19_candidate_json(v):
    point = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    return v("places").select("place_id", F.to_json(F.struct("kind", point.alias("value"))).alias("candidate"))


@query(f"""with {_SEGMENTS}, {_SNAPS}, size as (select area_key as root, count(*) as n_nodes from s group by area_key), snap as (select zone_id, area_key as root, min(distance) as snap from n where distance <= 900 group by all),
 whole as (select root, round(sum(snap), 3) as total, count(*) as n from snap group by root) select root, n_nodes, total from whole join size using (root) where n = (select count(*) from {{zone}}) order by total, n_nodes desc, root limit 1""")
def j12_serving_component(v):
    owner = v("places").select(F.col("place_id").alias("seg_id"), F.col("area_key").alias("root"))
    size = owner.groupBy("root").agg(F.count("*").alias("n_nodes"))
    near = network.snaps(_anchors(v), _segments(v), 900).join(owner, "seg_id").groupBy(F.col("key").alias("anchor"), "root").agg(F.min("distance").alias("snap"))
    return spatial.serving_component(near.join(size, "root"), v("zone").count()).select("root", "n_nodes", F.round("total", 3).alias("total"))


@query("select n_nationkey, case mod(n_nationkey, 4) when 0 then 'Latn' when 1 then 'Grek' when 2 then 'Cyrl' end as script from {nation}")
def a15_dominant_script(v):
    name = F.element_at(F.array(F.lit("Rhodes ς"), F.lit("Ρόδος x"), F.lit("Родос 5"), F.lit("123")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return v("nation").select("n_nationkey", text.dominant_script(name).alias("script"))


@query("""select key, round(lon0 + w - greatest(1000.0::double, (2000 - (e - w) * px) / 2) / px, 4) as west, round(s - greatest(1000.0::double, (2000 - (n - s) * 111320) / 2) / 111320, 4) as south from (
 select key, lon0, min(lon - lon0) as w, max(lon - lon0) as e, min(lat) as s, max(lat) as n, 111320.0::double * cos(radians(lat0)) as px from (select area_key as key, lon, lat, degrees(atan2(avg(sin(radians(lon))) over (partition by area_key), avg(cos(radians(lon))) over (partition by area_key))) as lon0, avg(lat) over (partition by area_key) as lat0 from {places}) q group by key, lon0, lat0) w""")
def a17_tile_window(v):
    return curate.tile_window(v("places").select(F.col("area_key").alias("key"), "lon", "lat")).select("key", F.round(F.col("west"), 4).alias("west"), F.round(F.col("south"), 4).alias("south"))


@query(r"select doc_id, array_to_string(list_distinct(regexp_extract_all(text, '(?m)^Released under the ([A-Za-z0-9 .-]+) License', 1)), ',') as headings from {documents} where contains(text, 'Released under the')")
def a19_license_headings(v):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^Released under the ([A-Za-z0-9 .-]+) License"), F.lit(1)))
    return v("documents").where(F.contains("text", F.lit("Released under the"))).select("doc_id", F.array_join(found, ",").alias("headings"))


@query("""with w as (with xs as (select distinct z.area_id, unnest([greatest(z.x0, a.x0), least(z.x1, a.x1)]) as e from {area} z, {zone} a where z.x0 < a.x1 and z.x1 > a.x0 and z.y0 < a.y1 and z.y1 > a.y0),
 ys as (select distinct z.area_id, unnest([greatest(z.y0, a.y0), least(z.y1, a.y1)]) as e from {area} z, {zone} a where z.x0 < a.x1 and z.x1 > a.x0 and z.y0 < a.y1 and z.y1 > a.y0),
 cx as (select area_id, e as c0, lead(e) over (partition by area_id order by e) as c1 from xs), cy as (select area_id, e as d0, lead(e) over (partition by area_id order by e) as d1 from ys),
 hit as (select distinct cx.area_id, c0, c1, d0, d1 from cx join cy using (area_id) join {zone} a on a.x0 <= c0 and a.x1 >= c1 and a.y0 <= d0 and a.y1 >= d1 where c1 is not null and d1 is not null)
 select z.area_id as request_id, ((z.x1 - z.x0) * (z.y1 - z.y0))::bigint as asked, coalesce((select sum((c1 - c0) * (d1 - d0)) from hit where hit.area_id = z.area_id), 0)::bigint as covered from {area} z) select request_id, covered::double / asked >= 0.99 as reuse from w""")
def f16_reuse(v):
    asked = v("area").select(F.col("area_id").alias("request_id"), "x0", "y0", "x1", "y1")
    fraction = spatial.coverage(asked, v("zone")).withColumn("f", F.col("covered") / F.col("asked"))
    return fraction.select("request_id", (F.col("f") >= 0.99).alias("reuse"))


@query("select page_id, case when mod(page_id, 3) > 0 then url end as found from {pages}")
def f20_absolute_urls(v):
    tree = F.to_json(F.struct(F.lit("a/b").alias("url"), F.array(F.struct(F.when(F.col("page_id") % 3 > 0, F.col("url")).otherwise("fonts/x").alias("glyphs"))).alias("layers")))
    return v("pages").select("page_id", F.get(serialize.absolute_urls(tree), F.lit(0)).alias("found"))


@query("select place_id, name from {places} where place_id = 42 and license <> ''")
def f21_key_lookup(v):
    return v("places").where("place_id = 42 and license <> ''").select("place_id", "name")


@query("select p_partkey, case mod(p_partkey, 4) when 0 then 'open' when 1 then 'closed' when 2 then 'hours_unknown' else 'open' end as state from {part}")
def d1_hours_state(v):
    text_of = F.element_at(F.array(F.lit("Mo-Fr 09:00-17:00; We 12:00-13:00"), F.lit("Sa,Su 10:00-12:00"), F.lit("week 1-10 open"), F.lit("Tu 22:00-02:00")), (F.col("p_partkey") % 4 + 1).cast("int"))
    at = F.when(F.col("p_partkey") % 4 == 3, F.lit("2024-01-03 01:30:00")).otherwise(F.lit("2024-01-03 12:30:00")).cast("timestamp_ntz")
    return v("part").select("p_partkey", hours.state_at(hours.weekly_intervals(text_of), at).alias("state"))


@query("""with o as (select area_id, zone, sum(greatest(least(a.x1, z.x1) - greatest(a.x0, z.x0), 0) * greatest(least(a.y1, z.y1) - greatest(a.y0, z.y0), 0)) as shared from {area} a, {zone} z group by all),
 b as (select area_id, zone from (select *, row_number() over (partition by area_id order by shared desc, zone) as r from o where shared > 0) q where r = 1) select area_id, zone as country, zone from {area} left join b using (area_id)""")
def d4_local_frame(v):
    return curate.local_frame(v("area"), v("zone"), v("zone"))


@query("select plan_id, stop_order, round_even(leg_m / (least(greatest(mod(plan_id, 7)::double, 3.5::double), 5.0::double) / 3.6::double), 0)::bigint as seconds from {stop}")
def m1_walk_seconds(v):
    return v("stop").select("plan_id", "stop_order", prose.walk_seconds(F.col("leg_m"), (F.col("plan_id") % 7).cast("double")).alias("seconds"))


@query("select l_suppkey as k, '{{\"a\":' || l_suppkey || ',\"b\":[true,null,\"é\"],\"é\":1.5}}' as canonical from (select distinct l_suppkey from {lineitem}) q")
def k1_canonical_json(v):
    raw = F.concat(F.lit('{"é": 1.50, "b" : [true, null, "\\u00e9"], "a": '), F.col("l_suppkey").cast("string"), F.lit(".0}"))
    return v("lineitem").select("l_suppkey").distinct().select(F.col("l_suppkey").alias("k"), serialize.jcs(raw).alias("canonical"))


@query("select page_id, 'bnd_' || md5(url) as bundle, substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4) || '-' || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21) as uuid from {pages}")
def k4_bundle_ids(v):
    uuid = F.regexp_replace(F.md5("url"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    made = v("pages").select("page_id", serialize.bundle_id(uuid).alias("bundle"))
    return made.select("page_id", "bundle", serialize.uuid_of(F.col("bundle")).alias("uuid"))


@query("select event_id, event_type as event, cast(event_id as varchar) as data from {events}")
def t19_event_frames(v):
    stream = F.concat(F.lit(": hi\r\nevent: "), F.col("event_type"), F.lit("\r\ndata: "), F.col("event_id").cast("string"), F.lit("\r\n\r\ndata: cut"))
    return v("events").select("event_id", F.explode(prose.event_frames(stream)).alias("f")).select("event_id", F.col("f.event").alias("event"), F.col("f.data").alias("data"))


@query()
def g5_noded_pieces(v):
    return network.noded(_segments(v))


@query()
def g9_graph_verdict(v):
    return network.graph_verdict(network.noded(_segments(v)))


def _segments(v):
    """A short way from every place."""
    k = F.col("place_id")
    return v("places").select(k.alias("seg_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + k * 31 % 61 - 30).alias("x1"), (F.col("y") + k * 17 % 61 - 30).alias("y1"))


@query()
def g10_shortest_paths(v):
    edges = v("graph_edge").select(F.lit(0).cast("long").alias("graph_id"), "u", "v", (F.col("u") % 7 + 1).cast("double").alias("length"))
    asked = edges.select("graph_id", F.lit(5).cast("long").alias("source"), F.col("v").alias("target")).distinct()
    return network.shortest_paths(edges, asked)


@query()
def c3_merge_records(v):
    return curate.merge_records(v("places"), _names(v), v("observation"))


@query()
def c5_upsert(v):
    p = v("places").select(F.col("place_id").alias("key"), "gers_id", "lon", "lat")
    return curate.upsert(p.where("key % 2 = 0"), p.where("key % 2 = 1"))


@query()
def t16_wrapped(v):
    return v("benchmark").select("item_id", prose.fenced(prose.wrapped("text")).alias("shown"))


@query("select case when mod(place_id, 2) = 0 then 'node/' else 'way/' end || place_id as id, lon, lat, name from {places}")
def s6_element_feed(v):
    return _fed(v("places"))


def _fed(p, size=20_000):
    """The places written as a feed, a document per ``size`` ids, and read again."""
    centre = F.struct(F.col("lat"), F.col("lon"))
    node = F.col("place_id") % 2 == 0
    element = F.struct(F.when(node, "node").otherwise("way").alias("type"), F.col("place_id").alias("id"), F.when(node, F.col("lat")).alias("lat"), F.when(node, F.col("lon")).alias("lon"), F.when(~node, centre).alias("center"), F.create_map(F.lit("name"), F.col("name")).alias("tags"))
    folder = shared_dir(p.sparkSession)
    documents = p.select(F.floor(F.col("place_id") / size).alias("document"), element.alias("e")).groupBy("document").agg(F.collect_list("e").alias("elements"))
    documents.write.partitionBy("document").json(folder)  # a file per document
    return scans.element_feed(p.sparkSession, folder).select("id", "lon", "lat", F.element_at("tags", "name").alias("name"))


@query("select zone_id, zone from {zone} where zone <> 'ASIA' union all select area_id, name from {area} where name <> 'NATION_3'")
def s13_country_polygons(v):
    both = v("zone").select("zone_id", "zone").unionByName(v("area").select(F.col("area_id").alias("zone_id"), F.col("name").alias("zone")))
    return both.where(~F.col("zone").isin("ASIA", "NATION_3"))


@query("""select site_id, coalesce(min_by(license, lpad(src::varchar, 3, '0') || lpad(value::varchar, 6, '0') || license) filter (field = 'N'), min_by(license, lpad(src::varchar, 3, '0') || lpad(value::varchar, 6, '0') || license)) as license from {observation} group by site_id""")
def p2b_first_record_level(v):
    at = F.struct("src", "value", "license")
    record = F.min_by(F.when(F.col("field") == "N", F.col("license")), F.when(F.col("field") == "N", at))
    return v("observation").groupBy("site_id").agg(F.coalesce(record, F.min_by("license", at)).alias("license"))


@query("select site_id, count(distinct (field, observed_at, md5(kind || '|' || license || '|' || src), md5(cast(value as varchar)))) as keys from {observation} group by site_id")
def k3_natural_keys(v):
    rows = merge.ledger_rows(v("observation"))
    return rows.distinct().groupBy("site_id").agg(F.count("*").alias("keys"))


@query("select count(*) as files, true as sealed from (values (1), (2)) t(i)")
def k6_artifact_digests(v):
    spark = v("region").sparkSession
    folder = shared_dir(spark)
    manifest = curate.publish(spark, folder, {"regions": v("region").coalesce(1), "nations": v("nation").coalesce(1)})
    return manifest.agg(F.count("*").alias("files"), F.bool_and((F.length("sha256") == 64) & (F.col("size") > 0)).alias("sealed"))


@query("select area_id, mod(area_id, 3) = 0 as valid from {area}")
def f7_valid_rings(v):
    k = F.col("area_id") % 3
    point = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    square, bow, line = (F.array(*(point(*p) for p in ps)) for ps in (((0, 0), (2, 0), (2, 2), (0, 2)), ((0, 0), (2, 2), (2, 0), (0, 2)), ((0, 0), (1, 1), (2, 2))))
    return v("area").select("area_id", network.ring_is_valid(F.when(k == 0, square).when(k == 1, bow).otherwise(line)).alias("valid"))


@query()
def s16_decoded_paths(v):
    return v("nation").select("n_nationkey", F.size(geo.decode_polyline6(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@"))).alias("n_points"))


@query()
def t2_name_agreement(v):
    return resolve.near_agreement(v("places"), _names(v), metres=40.0).select("a", "b", F.round("score", 6).alias("score"), "tag")


from . import row_queries  # noqa: E402, F401  (registers the queries of rows)
