"""Operators against brute force and against properties that must hold."""

import difflib
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo, licenses, text
from placeloom.operators import feasibility, merge, quarantine, resolve, spatial
from placeloom.plans import lifecycle
from placeloom.runtime import components
from placeloom.sources import remote, scans, wikitext
from placeloom.streaming import ledger


def meters(a, b):
    y1, y2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("lat", [0.0, 36.4, 59.9999, 61.0, -75.0, 89.9995])
@pytest.mark.parametrize("lon", [28.2, 179.9999, -180.0])
def test_blocking_finds_what_brute_force_finds(spark, lat, lon):
    rng = random.Random(hash((lat, lon)))
    spread = 0.002 / max(0.01, math.cos(math.radians(lat)))
    points = [(i, (lon + rng.uniform(-spread, spread) + 180) % 360 - 180, max(-90.0, min(90.0, lat + rng.uniform(-0.002, 0.002)))) for i in range(60)]
    df = spark.createDataFrame(points, "place_id long, lon double, lat double")
    found = {(r.a, r.b) for r in resolve.near_pairs(df, metres=60.0).collect()}
    assert found == {(i, j) for (i, *p), (j, *q) in itertools.combinations(points, 2) if meters(p, q) <= 60.0}


def test_near_pairs_is_an_equi_join(spark):
    df = spark.range(50).selectExpr("id as place_id", "double(id) / 1000 as lon", "double(id) / 900 as lat")
    plan = resolve.near_pairs(df)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scan_pushes_the_box(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = rows.where("o_totalprice > 1000").select("o_orderkey")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderpriority" not in plan.split("== Physical Plan ==")[1]


def test_geodesic_known_lengths(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (5.0, 50.0, 5.0, 50.0), (179.5, 0.0, -179.5, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.geodesic_m("a", "b", "c", "d")).collect()]
    assert got == pytest.approx([111319.4908, 110574.3886, 0.0, 111319.4908], abs=1e-3)


def test_components_and_guarded_clusters(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.root for r in components(df).collect()} == {n: find(n) for e in edges for n in e}
    # Two identifiers chained by a record without one stay apart.
    records = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "place_id long, gers_id string")
    pairs = spark.createDataFrame([(1, 2, "n"), (2, 3, "n")], "a long, b long, rule string")
    assert {r.place_id: r.cluster for r in resolve.clusters(records, pairs).collect()} == {1: 1, 2: 1, 3: 3}


OBS = "site_id long, field string, value long, src long, kind string, license string, confidence long, observed_at date"


def observations(rng, n):
    import datetime

    kinds = ["overture", "osm", "wikivoyage", "user", "open_web", "strange"]
    return [(rng.randrange(3), rng.choice("ab"), rng.randrange(4), rng.randrange(3), rng.choice(kinds), rng.choice(["odbl", "cc0", "x"]), rng.randrange(3), datetime.date(2024, 1, 1 + rng.randrange(3))) for _ in range(n)]


def test_winner_is_the_same_in_any_order_and_for_itself(spark):
    rows = observations(random.Random(1), 60)
    first = sorted(map(tuple, merge.winners(spark.createDataFrame(rows, OBS)).collect()))
    random.Random(2).shuffle(rows)
    assert first == sorted(map(tuple, merge.winners(spark.createDataFrame(rows, OBS)).collect()))
    assert first == sorted(map(tuple, merge.winners(spark.createDataFrame(rows + rows, OBS)).collect()))


def test_no_source_is_lost(spark):
    rows = observations(random.Random(4), 40)
    assert {tuple(r) for r in merge.source_refs(spark.createDataFrame(rows, OBS)).collect()} == {(r[0], r[4], r[3], r[5]) for r in rows}


def test_ledger_append_is_idempotent(spark):
    rows = merge.ledger_rows(spark.createDataFrame(observations(random.Random(5), 30), OBS))
    assert merge.append_ledger(rows, rows).count() == 0
    assert merge.append_ledger(rows.limit(0), rows.union(rows)).count() == rows.distinct().count()


def test_refusals_raise(spark):
    legs = spark.createDataFrame([("osm", "odbl"), ("open_web", "cc0")], "kind string, license string")
    with pytest.raises(Exception, match="leg may not leave"):
        quarantine.require_legs(legs).collect()
    with pytest.raises(Exception, match="user values"):
        quarantine.reject_user_values(spark.createDataFrame([("user",)], "kind string")).collect()


def test_licenses(spark):
    df = spark.createDataFrame([("osm", " ODbL "), ("open_web", "cc0"), (None, "mit"), ("osm", None), ("osm", "proprietary")], "k string, l string")
    assert [r[0] for r in df.select(licenses.bundleable(F.col("k"), F.col("l"))).collect()] == [True, False, True, False, False]


def test_similarity_is_symmetric_and_folded(spark):
    pairs = [("St. Nicholas Tower", "st nicholas tower"), ("Ρόδος", "Ροδος"), ("abc", ""), ("gate one", "one gate"), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string").select(text.name_fold("a").alias("a"), text.name_fold("b").alias("b"))
    forth, back = ([r[0] for r in df.select(text.fold_similarity(x, y)).collect()] for x, y in (("a", "b"), ("b", "a")))
    assert forth == back and forth[:3] == [1.0, 1.0, 0.0] and forth[4] == 0.0
    assert forth[3] == difflib.SequenceMatcher(None, "gate one", "one gate", autojunk=False).ratio()


def test_romanise(spark):
    words = {"Ρόδος": "Rodos", "ΑΘΗΝΑ": "ATHINA", "μπαρ": "bar", "λάμπα": "lampa", "Αύγουστος": "Avgoustos", "προϋπόθεση": "proypothesi", "άγγελος": "angelos", "ευχαριστώ": "efcharisto", "Rhodes, 5": "Rhodes, 5", "πλάι": "plai", "Ναύπλιο (x)": "Nafplio (x)"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(text.romanise_greek("w")).collect()] == list(words.values())


def test_scripts(spark):
    df = spark.createDataFrame([("Ρόδος Rhodes",), ("Ρόδος",), ("123",), ("東京タワー",), (None,)], "t string")
    assert [r[0] for r in df.select(text.dominant_script(F.col("t"))).collect()] == ["Latn", "Grek", None, "Kana", None]
    counts = [{c["script"]: c["n"] for c in r[0] or []} for r in df.select(text.script_counts(F.col("t"))).collect()]
    assert counts[0] == {"Latn": 6, "Grek": 5} and counts[1] == {"Grek": 5} and counts[2] == {} and counts[3]["Hani"] == 2


def test_rollover_fold(spark):
    stops = [(1, 0, 7, 60, 22 * 60, 0, 0), (1, 1, 8, 30, 60, 0, 600), (1, 2, 9, 10, 120, 0, 90_000), (2, 0, 7, 5, 600, 0, 0), (2, 1, 8, 5, 590, 0, 0)]
    df = spark.createDataFrame(stops, "plan_id long, stop_order long, place_id long, dwell long, start_min long, leg_m long, leg_s long")
    got = {(r.plan_id, r.stop_order): r.start_s for r in feasibility.local_starts(df).collect()}
    # The third stop is a whole day short of where its leg can end, so it moves a day.
    assert got == {(1, 0): 79200, (1, 1): 86400 + 3600, (1, 2): 2 * 86400 + 7200, (2, 0): 36000, (2, 1): 86400 + 35400}


def test_first_gap(spark):
    stops = spark.createDataFrame([(1, 0, 7, 60, 500, 0, 0), (1, 1, 7, 0, 700, 0, 0), (1, 2, 8, 5, 10, 0, 0), (1, 3, 7, 200, 560, 0, 0)], "plan_id long, stop_order long, place_id long, dwell long, start_min long, leg_m long, leg_s long")
    opening = spark.createDataFrame([(7, 480, 600), (7, 600, 720)], "place_id long, open_min long, close_min long")
    assert {r.stop_order: r.minute for r in feasibility.first_uncovered(stops, opening).collect()} == {2: 10, 3: 720}


def test_coverage_does_not_count_twice(spark):
    boxes = spark.createDataFrame([(0, 0, 10, 10), (5, 5, 15, 15), (5, 5, 15, 15), (90, 0, 95, 5)], "x0 long, y0 long, x1 long, y1 long")
    asked = spark.createDataFrame([(1, 0, 0, 20, 20), (2, 50, 50, 60, 60), (3, 2, 2, 8, 8)], "request_id long, x0 long, y0 long, x1 long, y1 long")
    assert {r.request_id: r.covered for r in spatial.coverage(asked, boxes).collect()} == {1: 175, 2: 0, 3: 36}


def test_serving_component(spark):
    snaps = spark.createDataFrame([(1, 10, 5, 1.0), (2, 10, 5, 1.0), (1, 20, 9, 0.5), (2, 20, 9, 1.5), (1, 30, 99, 0.1)], "anchor long, root long, n_nodes long, snap double")
    assert spatial.serving_component(snaps, 2).first().root == 20


def test_lifecycle(spark):
    log = spark.createDataFrame([(1, 1, "approve"), (1, 2, "propose"), (1, 3, "approve"), (1, 4, "claim"), (1, 5, "finish"), (1, 6, "supersede"), (2, 1, "supersede"), (2, 2, "propose")], "plan_id long, seq long, action string")
    assert {r.plan_id: (r.state, r.n_applied) for r in lifecycle.fold_states(log).collect()} == {1: ("compiled", 4), 2: ("superseded", 1)}


def test_polyline(spark):
    def encode(points):
        out, last = "", (0, 0)
        for p in points:
            for now, before in zip(p, last):
                v = (now - before) << 1
                v = ~v if v < 0 else v
                while v >= 32:
                    out, v = out + chr((v & 31 | 32) + 63), v >> 5
                out += chr(v + 63)
            last = p
        return out

    path = [(36444120, 28223400), (36444000, 28224500), (-1, -5)]
    df = spark.createDataFrame([(encode(path),), ("",), (None,), ("_",)], "s string")
    got = [r[0] for r in df.select(geo.decode_polyline6("s")).collect()]
    assert [(p.lat, p.lon) for p in got[0]] == [(y / 1e6, x / 1e6) for y, x in path] and got[1] == [] and got[2] is None and got[3] is None


def test_wikitext_listings():
    page = "intro {{see | name=Old {{small|gate}} | url= | lat = 1 }} x {{eat|name=[[A|B]]|alt=c}} {{drink|name=open"
    assert wikitext.listings(page) == [{"template": "see", "fields": {"name": "Old {{small|gate}}", "lat": "1"}}, {"template": "eat", "fields": {"name": "[[A|B]]", "alt": "c"}}]


def test_element_feed(spark, tmp_path):
    elements = [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "a"}}, {"type": "way", "id": 1, "center": {"lat": 3.0, "lon": 4.0}}, {"type": "node", "id": 1, "lat": 9.0, "lon": 9.0}]
    (tmp_path / "f.json").write_text(json.dumps({"elements": elements}, indent=1))
    got = {r.id: (r.lon, r.lat) for r in scans.element_feed(spark, str(tmp_path / "f.json")).collect()}
    assert set(got) == {"node/1", "way/1"} and got["way/1"] == (4.0, 3.0)


def test_retry_degrades():
    answers, naps = [(503, 7.0, []), (429, None, []), (200, None, [1])], []
    assert remote.fetch_with_retry(lambda u, p: answers.pop(0), "u", {}, sleep=naps.append) == ([1], None)
    assert naps[0] == 7.0 and 0.5 <= naps[1] <= 1.0
    assert remote.fetch_with_retry(lambda u, p: (404, None, []), "u", {}) == ([], "HTTP 404")
    assert len(remote.title_batches([str(i) for i in range(41)])) == 3


def test_remote_source(spark):
    def fetch(url, params):
        return (200, None, [{"n": params["n"]}]) if params["n"] else (404, None, [])

    spark.dataSource.register(remote.remote_source("feed", fetch))
    rows = spark.read.format("feed").option("parts", json.dumps([{"n": 0}, {"n": 1}])).load().collect()
    assert sorted((r.degraded, r.record, r.reason) for r in rows) == [(False, '{"n": 1}', None), (True, None, "HTTP 404")]


def test_ledger_stream_appends_once(spark, tmp_path):
    rows = merge.ledger_rows(spark.createDataFrame(observations(random.Random(6), 30), OBS))
    for i in range(2):
        rows.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ledger.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.distinct().count()


def test_refresh_stream_converges(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5, 50), (1, "a", 7, 90), (1, "a", 3, 90), (2, "b", 1, 1)], "site_id long, field string, value long, confidence long")
    for i in range(2):
        rows.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ledger.refresh_stream(stream).writeStream.outputMode("update").format("memory").queryName("refreshed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("refreshed").collect()} == {(1, "a", 3, 90), (2, "b", 1, 1)}


def test_canonical_json_numbers_and_keys():
    from placeloom.functions import serialize

    numbers = {1.0: "1", 0.1: "0.1", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-7: "1e-7", 0.000001: "0.000001", -0.0: "0", 123456.789: "123456.789", 4.5e-10: "4.5e-10", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 9007199254740994.0: "9007199254740994", -33.25: "-33.25"}
    assert {x: serialize._number(x) for x in numbers} == numbers
    keys = {"€": 1, "\r": 2, "דּ": 3, "1": 4, "\U0001f600": 5, "\x80": 6, "ö": 7}
    assert [v for v in json.loads(serialize.canonical_json(keys)).values()] == [2, 4, 6, 7, 1, 5, 3]


def test_weekly_hours():
    from placeloom.functions import hours

    assert hours.weekly("24/7") == [(0, 7 * 1440)]
    assert hours.weekly("Mo 22:00-02:00; Su 23:00-01:00") == [(0, 60), (1320, 1560), (6 * 1440 + 1380, 7 * 1440)]
    assert hours.weekly('Mo-Fr 09:00-17:00 "ask"; We off') == [(d * 1440 + 540, d * 1440 + 1020) for d in (0, 1, 3, 4)]
    assert hours.weekly("Fr-Mo 10:00-11:00,12:00-13:00")[0] == (600, 660) and hours.weekly("week 1 Mo") is None and hours.weekly(" ") is None and hours.weekly("25:00-26:00") is None


def test_rings():
    from placeloom.operators.network import valid_ring

    assert valid_ring([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]) and not valid_ring([(0, 0), (4, 4), (4, 0), (0, 4)]) and not valid_ring([(0, 0), (1, 1), (2, 2)]) and not valid_ring([(0, 0), (200, 0), (0, 1)]) and not valid_ring(None)


def test_noding_by_brute_force(spark):
    from placeloom.operators import network

    segments = [(1, 0, 0, 10, 10), (2, 0, 10, 10, 0), (3, 5, 5, 5, 20), (4, 20, 0, 30, 0), (5, 25, 0, 40, 0), (6, 100, 100, 110, 100)]
    got = {tuple(r)[1:] for r in network.noded(spark.createDataFrame(segments, "seg_id long, x0 long, y0 long, x1 long, y1 long"), 8).collect()}
    assert got == {(0, 0, 5, 5), (5, 5, 10, 10), (0, 10, 5, 5), (5, 5, 10, 0), (5, 5, 5, 20), (20, 0, 25, 0), (25, 0, 30, 0), (30, 0, 40, 0), (100, 100, 110, 100)}
    verdict = network.graph_verdict(spark.createDataFrame([(1, *p) for p in got], "seg_id long, x0 long, y0 long, x1 long, y1 long")).first()
    assert (verdict.components, verdict.pieces, verdict.kept) == (3, 9, 5)


def test_shortest_paths(spark):
    from placeloom.operators import network

    edges = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 1, 3, 5.0), (1, 8, 9, 1.0), (2, 1, 3, 7.0)], "graph_id long, u long, v long, length double")
    asked = spark.createDataFrame([(1, 1, 3), (1, 1, 9), (2, 3, 1)], "graph_id long, source long, target long")
    assert {(r.graph_id, r.target): r.length for r in network.shortest_paths(edges, asked).collect()} == {(1, 3): 2.0, (1, 9): None, (2, 1): 7.0}


def test_upsert_never_joins_different_identifiers(spark):
    from placeloom.plans import curate

    stored = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, None, 1.0, 0.0)], "key long, gers_id string, lon double, lat double")
    incoming = spark.createDataFrame([(1, "b", 0.0, 0.0), (2, "a", 9.0, 9.0), (3, None, 0.0, 0.0001), (4, "c", 1.0, 0.0), (5, None, 5.0, 5.0)], "key long, gers_id string, lon double, lat double")
    assert {r.key: (r.site, r.how) for r in curate.upsert(stored, incoming).collect()} == {1: (None, "new"), 2: (1, "gers_id"), 3: (1, "spatial"), 4: (2, "spatial"), 5: (None, "new")}


def test_tile_window_across_the_antimeridian(spark):
    from placeloom.plans import curate

    df = spark.createDataFrame([(1, 179.99, 0.0), (1, -179.99, 0.0), (2, 10.0, 50.0)], "key long, lon double, lat double")
    got = {r.key: r for r in curate.tile_window(df).collect()}
    assert got[1].west == pytest.approx(179.981, abs=1e-3) and got[1].east == pytest.approx(-179.981, abs=1e-3)
    assert (got[2].north - got[2].south) * 111_320 == pytest.approx(2000, abs=1)


def test_publish_writes_the_manifest_last(spark, tmp_path):
    from placeloom.plans import curate

    manifest = curate.publish(spark, f"file://{tmp_path}/b", {"sites": spark.range(3), "legs": spark.range(1)}).collect()
    assert manifest and all(r.size > 0 and len(r.sha256) == 64 for r in manifest) and (tmp_path / "b/manifest").exists()
    with pytest.raises(ValueError, match="unsafe"):
        curate.publish(spark, f"file://{tmp_path}/b", {"../x": spark.range(1)})


def test_wrapped_and_fenced(spark):
    from placeloom.functions import prose

    df = spark.createDataFrame([("word " * 40 + "x" * 120,), ("a ``` b",), (None,)], "t string")
    got = [r[0] for r in df.select(prose.fenced(prose.wrapped("t"))).collect()]
    assert max(map(len, got[0].split("\n")[1:-2])) <= 92 and got[1].startswith("````\n") and got[2] is None


def test_network_queries_take_all_of_lineitem(spark, tmp_path):
    from placeloom.queries import QUERIES

    rng = random.Random(3)
    rows = [(rng.randrange(1, 400), rng.choice([5, *range(40)]), rng.randrange(12), rng.randrange(1, 5)) for _ in range(60)] + [(1, 5, 1, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = {(p % 997, 1000 + (s * 31 + n) % 499) for _, p, s, n in rows}
    root = {x: x for e in edges for x in e}
    best = {5: 0.0}
    for _ in range(len(root)):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
            for a, b in ((u, v), (v, u)):
                if a in best:
                    best[b] = min(best.get(b, math.inf), best[a] + u % 7 + 1)
    want = sorted((r, sum(x == r for x in root.values()), sum(root[u] == r for u, _ in edges)) for r in set(root.values()))
    assert sorted((r.root, r.n_nodes, r.n_edges) for r in QUERIES["g6_components"](spark, str(tmp_path)).collect()) == want
    got = {r.target: r.length for r in QUERIES["g10_shortest_paths"](spark, str(tmp_path)).collect()}
    assert {k: None if x is None or x != x else x for k, x in got.items()} == {v: best.get(v) for _, v in edges}


def test_name_fold_query_folds_whole_texts(spark, tmp_path):
    from placeloom.queries import QUERIES

    rows = [(1, "Ródos, Ágios " * 30 + "END"), (2, "short"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.folded for r in QUERIES["t1_name_fold"](spark, str(tmp_path)).collect()}
    assert got == {1: "rodos agios " * 30 + "end", 2: "short", 3: None, 4: ""}


def test_segments_come_from_all_places(spark, tmp_path):
    """Customers give places 2k, suppliers 2k + 1; a short way leads from each, by brute force over exact crossings."""
    from fractions import Fraction

    from placeloom.queries import QUERIES

    ids = [*range(195, 235), *range(901, 1400)]
    for table, c, n in (("customer", "c_cust", "c"), ("supplier", "s_supp", "s")):
        spark.createDataFrame([(i, f"n{i}", 1) for i in ids], f"{c}key long, {n}_name string, {n}_nationkey long").write.parquet(str(tmp_path / f"{table}.parquet"))
    spark.createDataFrame([], "n_nationkey long, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    at = {2 * i: (2821000 + i * 7919 % 2000, 3644000 + i * 104729 % 1100) for i in ids} | {2 * i + 1: (2821000 + i * 7907 % 2000, 3644000 + i * 104723 % 1100) for i in ids}
    segments = {i: (x, y, x + i * 31 % 61 - 30, y + i * 17 % 61 - 30) for i, (x, y) in at.items()}
    segments = {i: s for i, s in segments.items() if s[:2] != s[2:]}
    near = lambda x: math.floor(x + Fraction(1, 2))
    pieces = set()
    for i, (ax, ay, bx, by) in segments.items():
        cuts = {(ax, ay), (bx, by)}
        for j, (px, py, qx, qy) in segments.items():
            det = (bx - ax) * (qy - py) - (by - ay) * (qx - px)
            if i != j and det:
                t, u = Fraction((px - ax) * (qy - py) - (py - ay) * (qx - px), det), Fraction((px - ax) * (by - ay) - (py - ay) * (bx - ax), det)
                if 0 <= t <= 1 and 0 <= u <= 1:
                    cuts.add((near(ax + t * (bx - ax)), near(ay + t * (by - ay))))
        line = sorted(cuts, key=lambda p: ((p[0] - ax) ** 2 + (p[1] - ay) ** 2, p))
        pieces |= {tuple(sorted(x)) for x in zip(line, line[1:])}
    got = {((r.x0, r.y0), (r.x1, r.y1)) for r in QUERIES["g5_noded_pieces"](spark, str(tmp_path)).collect()}
    assert got == pieces and len(pieces) > len(segments) > 12
    root = {p: p for x in pieces for p in x}
    for _ in root:
        for a, b in pieces:
            root[a] = root[b] = min(root[a], root[b])
    per = [sum(root[a] == r for a, _ in pieces) for r in set(root.values())]
    assert tuple(QUERIES["g9_graph_verdict"](spark, str(tmp_path)).first()) == (len(per), len(pieces), max(per))


def test_whole_feeds_ranks_and_records(spark):
    from placeloom.queries import QUERIES
    from placeloom.views import view

    sf = "/root/testdata/sf0.01"  # ids on both sides of the old bounds
    places = {r.place_id: r for r in view(spark, sf, "places").collect()}
    assert max(places) > 500
    fed = {r.id: (r.lon, r.lat, r.name) for r in QUERIES["s6_element_feed"](spark, sf).collect()}
    assert fed == {("way/" if i % 2 else "node/") + str(i): (p.lon, p.lat, p.name) for i, p in places.items()}
    asked = [40, 2, 30, 4]
    order = sorted(places, key=lambda i: asked.index(i) + 1 if i in asked else i + 5)
    got = QUERIES["o2_rank_by_list"](spark, sf).collect()
    assert {r["rank"]: r.place_id for r in got} == dict(enumerate(order, 1)) and len(got) == len(order)
    sites = {}
    for r in view(spark, sf, "observation").collect():
        sites.setdefault(r.site_id, []).append(((r.src, r.value, r.license), r.field, r.license))
    want = {site: (min((x for x in rows if x[1] == "N"), default=None) or min(rows))[2] for site, rows in sites.items()}
    assert max(want) >= 100 and {r.site_id: r.license for r in QUERIES["p2b_first_record_level"](spark, sf).collect()} == want


def test_feed_of_many_documents(spark):
    from placeloom.queries import _fed

    places = spark.createDataFrame([(i, f"n{i}", 1.0 * i, 2.0) for i in range(25)], "place_id long, name string, lon double, lat double")
    assert sorted((r.name, r.lon) for r in _fed(places, 10).collect()) == sorted((f"n{i}", 1.0 * i) for i in range(25))
