"""Row operators on small fixtures: odd values, ties, refusals, and brute force where SQL is not the judge."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.functions import ranges, serialize, text, times
from placeloom.operators import feasibility, merge, normalise, quarantine, resolve, spatial
from placeloom.queries import QUERIES
from placeloom.views import view

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(5)

    def boxes(n):
        out = []
        for i in range(n):
            side = rng.choice((0, 1, 7, 60, 900, 40_000))
            x, y = rng.randrange(-1000, 50_000), rng.randrange(-1000, 50_000)
            if i % 2:
                x, y = rng.randrange(0, 300), rng.randrange(0, 300)
            out.append((i, x, y, x + rng.randint(0, side), y + rng.randint(0, side)))
        return out

    a, b = boxes(120), boxes(120)
    left = spark.createDataFrame(a, "a long, x0 long, y0 long, x1 long, y1 long")
    right = spark.createDataFrame(b, "b long, u0 long, v0 long, u1 long, v1 long")
    got = [(r.a, r.b) for r in spatial.meeting(left, right, 10).collect()]
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted(got) == sorted(want) and len(want) > 500
    plan = spatial.meeting(left, right, 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = left.limit(0)
    assert spatial.meeting(none, right, 10).count() == spatial.meeting(left, right.limit(0), 10).count() == 0


def test_stars_cluster_as_all_pairs_do(spark):
    rng = random.Random(8)
    records = [(i, f"g{rng.randrange(6)}" if rng.random() < 0.6 else None) for i in range(60)]
    near = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(40)]
    ident = dict(records)
    near = sorted({(a, b) for a, b in near if ident[a] is None or ident[b] is None})

    def brute(edges):
        parent, held = list(range(60)), [{g} - {None} for _, g in records]

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in sorted(edges):
            x, y = sorted((find(a), find(b)))
            if x != y and len(held[x] | held[y]) <= 1:
                parent[y], held[x] = x, held[x] | held[y]
        return {i: find(i) for i in range(60)}

    everyone = [(a, b) for a, b in itertools.combinations(range(60), 2) if ident[a] and ident[a] == ident[b]]
    frame = spark.createDataFrame(records, "place_id long, gers_id string")
    links = [(r.a, r.b) for r in resolve.id_links(frame).collect()]
    assert len(links) == sum(n - 1 for n in collections.Counter(g for _, g in records if g).values())
    edges = spark.createDataFrame(near + links, "a long, b long")
    got = {r.place_id: r.cluster for r in resolve.clusters(frame, edges).collect()}
    assert got == brute(near + links) == brute(near + everyone)


def test_clusters_replay_lists_of_edges():
    """All edges of a record at once give what one after another does, identifiers refused alike."""
    rng = random.Random(21)
    for _ in range(200):
        n = rng.randint(2, 25)
        idents = [rng.choice([-1, -1, 5, 6, 7]) for _ in range(n)]
        edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, 60))})
        parent, held = list(range(n)), [{g} - {-1} for g in idents]

        def find(x):
            while parent[x] != x:  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            if x != y and len(held[x] | held[y]) <= 1:
                parent[y], held[x] = x, held[x] | held[y]
        starts = sorted({a for a, _ in edges})
        lists = [np.array([10 * b for a, b in edges if a == s]) for s in starts]
        got = resolve._replay(np.arange(n) * 10, np.array(idents), np.array(starts) * 10, lists)
        assert (got // 10).tolist() == [find(x) for x in range(n)]


def test_edges_are_packed_together():
    """Edges that come in many batches make one list a record and one tree, not one a batch."""
    import pyarrow as pa

    edges = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    random.Random(3).shuffle(edges)
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*edges[i : i + 10])], ["a", "b"]) for i in range(0, len(edges), 10)]
    rows = [r for batch in resolve._packed(iter(batches)) for r in batch.to_pylist()]
    assert sorted((r["a"], b) for r in rows if r["least"] is None for b in r["others"]) == sorted(edges) and sum(r["least"] is None for r in rows) == 39
    assert [(r["a"], r["least"]) for r in rows if r["least"] is not None] == [(x, 0) for x in range(1, 40)]
    assert not list(resolve._packed(iter([])))


def test_alike_folds_and_shared_positions(spark):
    """Bounds never change the verdict of the ratio, and records of one position are told apart once, not pair by pair."""
    rng = random.Random(5)
    names = ["", *("".join(rng.choices("abc 12", k=rng.randint(1, 9))) for _ in range(30)), "customer 12", "supplier 12", "customer 977"]
    pairs = spark.createDataFrame([(x, y) for x in names for y in names], "x string, y string")
    for r in pairs.select(text.fold_similarity("x", "y").alias("s"), text.folds_alike(0.6)("x", "y").alias("alike")).collect():
        assert r.alike == (r.s >= 0.6)
    people = spark.createDataFrame([(i, 28.0 + i % 3 / 10000, 36.0) for i in range(90)], "place_id long, lon double, lat double")
    found = resolve.near_pairs(people, metres=12.0, distance=resolve.haversine_m)
    assert {(r.a, r.b) for r in found.collect()} == {(a, b) for a, b in itertools.combinations(range(90), 2) if abs(a % 3 - b % 3) < 2}
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a, b, c, d):
        asked.add(1)
        return 1.0

    assert resolve.near_pairs(people, metres=12.0, distance=counted).count() == 90 * 89 // 2 and asked.value <= 12


def test_planted_places_are_matched(spark):
    """Each nation has a museum that two sources name alike: near, and one of them at least without an identifier."""
    edges = {(r.a, r.b): r.rule for r in QUERIES["j2_match_edges"](spark, SF).collect()}
    ids = {r.place_id: r.gers_id for r in view(spark, SF, "places").select("place_id", "gers_id").collect()}
    clusters = {r.place_id: r.cluster for r in QUERIES["c1_clusters"](spark, SF).collect()}
    for k in range(25):
        a, b = 3_000_000_000 + 2 * k, 3_000_000_001 + 2 * k
        assert edges.get((a, b)) == "spatial_name" and (ids[a] is None or ids[b] is None)
    assert len(clusters) == len(ids) and any(clusters[3_000_000_000 + 2 * k] == clusters[3_000_000_001 + 2 * k] for k in range(25))
    assert all(ids[a] == ids[b] for (a, b), rule in edges.items() if rule == "gers_id")


@pytest.mark.parametrize(("header", "size", "want"), [
    (None, 10, (200, 0, 9)), ("", 10, (200, 0, 9)), ("bytes=0-0", 10, (206, 0, 0)), ("bytes=5-", 10, (206, 5, 9)), ("bytes=-3", 10, (206, 7, 9)), ("bytes=-30", 10, (206, 0, 9)),
    ("bytes=-0", 10, (200, 0, 9)), ("bytes=7-3", 10, (200, 0, 9)), ("bytes=1-2,4-5", 10, (200, 0, 9)), ("  bytes = 2 - 3", 10, (200, 0, 9)), ("bytes=10-", 10, (416, None, None)), ("bytes=0-", 0, (416, None, None)),
    ("bytes=0-99999999999999999999", 10, (206, 0, 9)), ("Bytes=0-1", 10, (200, 0, 9)),
])
def test_byte_ranges(spark, header, size, want):
    assert tuple(one(spark, ranges.served(ranges.parse_range(F.lit(header).cast("string")), F.lit(size)))) == want


def test_licenses_by_pointer(spark):
    rows = [
        ([("/names", "A"), ("/names", "B"), ("", "C")], "A"), ([("", "C"), (None, "D"), ("", "E"), ("", None)], "E"), ([(None, "D")], None), ([], None), (None, None), ([("/names", ""), ("", "F")], "F"),
    ]
    df = spark.createDataFrame(rows, "s array<struct<property:string,license:string>>, want string")
    assert all(r.got == r.want for r in df.select(normalise.license_for(F.col("s"), "/names").alias("got"), "want").collect())


def test_names_and_addresses(spark):
    tags = {"name": "X", "name:en": "X", "name:zh-Hant-TW": "甲", "name:left": "l", "name:de": "", "name:en-us": "no", "addr:street": "Way", "addr:housenumber": "5", "addr:city": "Town"}
    column = F.create_map(*(F.lit(x) for p in tags.items() for x in p))
    names, bad = normalise.tag_names(column)
    assert one(spark, names) == {"en": "X", "zh-Hant-TW": "甲"} and one(spark, bad) == 2
    assert one(spark, normalise.tag_address(column)) == "Way 5, Town" and one(spark, normalise.tag_address(F.create_map(F.lit("a"), F.lit("b")))) is None
    plain, none = normalise.common_names(F.lit(None).cast("map<string,string>"), F.lit("P"))
    assert one(spark, plain) == {"und": "P"} and one(spark, none) == 0


def test_routing_errors_are_no_missing_ways(spark):
    schema = "key long, error_code int, units string, legs array<struct<shape:string,length:double,time:double>>"
    good = spark.createDataFrame([(1, None, "miles", [("s", 1.0, 2.5), ("t", 2.0, 3.5)]), (2, None, "kilometers", []), (3, 442, None, None), (4, None, "kilometers", None)], schema)
    got = {(r.key, r.leg): (r.metres, r.seconds, r.no_route) for r in normalise.trip_legs(good).collect()}
    assert got == {(1, 0): (1609.344, 2, False), (1, 1): (3218.688, 4, False), (2, None): (None, None, True), (3, None): (None, None, True), (4, None): (None, None, True)}
    with pytest.raises(Exception, match="routing failed with code 500"):
        normalise.trip_legs(spark.createDataFrame([(1, 500, None, None)], schema)).collect()


@pytest.mark.parametrize(("value", "tag", "want"), [
    ("Ρόδος (Rhodes)", "el", "match"), ("Rhodes", "el", "mismatch"), ("Ρόδος", "el-Latn", "mismatch"), ("Родос", "he", "mismatch"), ("123", "el", "empty"), ("abc", "tlh", "unknown"),
    ("Ρό Ро", "el", "mismatch"), ("Ρόδ Ро", "el", "match"), ("Beograd", "sr", "match"), ("東京タワー", "ja", "match"), ("x", "EN-gb", "match"),
])
def test_scripts_of_tags(spark, value, tag, want):
    assert one(spark, text.script_check(F.lit(value), F.lit(tag))) == want


def test_quarantine_refuses_what_it_does_not_know():
    source = T.StructType([T.StructField("kind", T.StringType()), T.StructField("license", T.StringType())])
    inner = T.StructType([T.StructField("odd", T.StructType([T.StructField("x", T.LongType())])), T.StructField("source", source)])
    with pytest.raises(quarantine.UnknownStructure, match=r"stories\[\]\.odd"):
        quarantine.quarantined(F.lit(None), T.StructType([T.StructField("stories", T.ArrayType(inner))]), frozenset({""}), frozenset())
    with pytest.raises(quarantine.UnknownStructure, match="the top"):
        quarantine.quarantined(F.lit(None), T.StructType([]), frozenset(), frozenset())


def test_quarantine_of_nulls(spark):
    """Null structures, lists and maps withhold nothing; a stamp without a kind and license may not leave."""
    schema = "r struct<names:map<string,struct<value:string,source:struct<kind:string,license:string>>>,stories:array<struct<text:string,source:struct<kind:string,license:string>>>,reviews:struct<stars:double>>"
    rows = [(None,), ((None, None, None),), (({"en": ("x", None), "de": ("y", ("osm", "MIT")), "fr": None}, [("t", ("osm", None)), None, ("u", ("osm", "MIT"))], (1.0,)),)]
    df = spark.createDataFrame(rows, schema)
    kept, paths = quarantine.quarantined(F.col("r"), df.schema["r"].dataType, frozenset({""}), frozenset({"reviews"}))
    got = df.select(kept.alias("k"), paths.alias("p")).collect()
    assert [r.p for r in got] == [[], [], ["names.en", "stories[0]", "reviews"]]
    assert got[0].k is None and set(got[2].k.names) == {"de", "fr"} and [s and s.text for s in got[2].k.stories] == [None, "u"] and got[2].k.reviews is None


def test_freezing_needs_the_whole_frame(spark):
    plan, frame = F.struct(F.lit(1).alias("a")), lambda c: F.struct(F.lit("Z").alias("timezone"), c.alias("country"))
    assert one(spark, serialize.frozen(plan, frame(F.lit("GR")), ["a"], ["timezone", "country"])) == '{"a":1,"country":"GR","timezone":"Z"}'
    with pytest.raises(ValueError, match="overwrite a"):
        serialize.frozen(plan, plan, ["a"], ["a"])
    with pytest.raises(Exception, match="whole local frame"):
        one(spark, serialize.frozen(plan, frame(F.lit(None).cast("string")), ["a"], ["timezone", "country"]))


def test_visits_past_midnight_and_the_week(spark):
    """A bar that opens Sunday night is open on Monday at one; a visit that outlasts it is told the minute it shuts."""
    stops = spark.createDataFrame([(1, 0, 7, 30, 60, 0, 0), (2, 0, 7, 200, 60, 0, 0), (3, 0, 8, 30, 600, 0, 0), (4, 0, 99, 30, 600, 0, 0)], "plan_id long, stop_order long, place_id long, dwell long, start_min long, leg_m long, leg_s long")
    plans = spark.createDataFrame([(1, 100, 24, "2024-01-01", "Z"), (2, 100, 3, "2024-01-01", "Z"), (3, 100, 24, "2024-01-01", None), (4, 100, 24, "2024-01-01", None)], "plan_id long, budget_m long, budget_h long, day string, timezone string").withColumn("day", F.to_date("day"))
    sites = spark.createDataFrame([(7, None), (8, "unreadable")], "place_id long, unreadable string")
    opening = spark.createDataFrame([(7, 6 * 1440 + 1320, 7 * 1440), (7, 0, 180)], "place_id long, week_from long, week_to long")
    got = {(r.plan_id, r.code, r.reason, r.blocking) for r in feasibility.day_verdicts(stops, plans, sites, opening).collect()}
    assert got == {(2, "outside_opening_window", "closed at 03:00", True), (2, "time_budget", None, True), (3, "hours_unknown", "no_timezone", False), (4, "unknown_site", None, True)}


def test_network_pieces_by_brute_force(spark):
    """Every crossing of two segments is an end of pieces of both."""
    from placeloom.operators import network

    rng = random.Random(2)
    segs = [(i, *(8 * rng.randrange(12) for _ in range(4))) for i in range(25)]
    segs = [s for s in segs if s[1:3] != s[3:5]]
    pieces = [tuple(r) for r in network.noded(spark.createDataFrame(segs, "seg_id long, x0 long, y0 long, x1 long, y1 long"), step=16).collect()]
    by = collections.defaultdict(list)
    for i, x0, y0, x1, y1 in pieces:
        by[i].append(((x0, y0), (x1, y1)))
    everywhere = {p for v in by.values() for piece in v for p in piece}
    for (i, ax, ay, bx, by_), (j, px, py, qx, qy) in itertools.combinations(segs, 2):
        det = (bx - ax) * (qy - py) - (by_ - ay) * (qx - px)
        if det:
            t, u = ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / det, ((px - ax) * (by_ - ay) - (py - ay) * (bx - ax)) / det
            if 0 <= t <= 1 and 0 <= u <= 1:
                x, y = ax + t * (bx - ax), ay + t * (by_ - ay)
                assert any(abs(p[0] - x) <= 0.5 and abs(p[1] - y) <= 0.5 for p in everywhere)


@pytest.mark.parametrize(("said", "at", "refused"), [
    ("2024-02-30T00:00:00Z", None, "no such time"), ("2024-02-29T23:59:59.5+01:00", 1709247599, None), ("2024-02-29", None, "a day, no instant"), ("2024-02-29T10:00:00", None, "no offset"), ("now", None, "no offset"), (None, None, "missing"), ("", None, "no offset"),
])
def test_instants_say_their_offset(spark, said, at, refused):
    got = spark.range(1).select(times.instant(F.lit(said).cast("string")).alias("i")).select(F.unix_timestamp("i.at").alias("at"), "i.refused").first()
    assert (got.at, got.refused) == (at, refused)


def test_clocks_are_never_mixed(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' t, date'2024-01-01' d, 5 m")
    assert times.require_clocks(df, ["t"], ["m"], ["d"]) is df
    for wrong in ({"instants": ["d"]}, {"minutes": ["t"]}, {"days": ["t"]}):
        with pytest.raises(TypeError):
            times.require_clocks(df, **wrong)
    assert one(spark, times.clock_minute(F.lit("24:00"))) is None and one(spark, times.clock_minute(F.lit("23:59"))) == 1439 and one(spark, times.calendar_day(F.lit("2024-01-01T00:00:00Z"))) is None


def test_ranking_refuses_what_it_cannot_place(spark):
    lists = spark.createDataFrame([(1, [3, 1]), (2, [1, 1]), (3, [9]), (4, []), (5, [2])], "list_id long, asked array<long>")
    places = spark.createDataFrame([(i, p, p) for i in (1, 2, 3, 4, 5) for p in (1, 2, 3)], "list_id long, place_id long, at int")
    got = sorted((r.list_id, r["rank"] or 0, r.place_id, r.refused) for r in merge.ranked(lists, places, 2).collect())
    assert got == [(1, 1, 3, None), (1, 2, 1, None), (2, 0, None, "repeated"), (3, 0, None, "unknown"), (4, 1, 1, None), (4, 2, 2, None), (5, 1, 2, None), (5, 2, 1, None)]


def test_points_in_zone_polygons(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    zones = spark.createDataFrame([("B", ring((0, 0), (10, 0), (0, 10))), ("A", ring((0, 0), (4, 0), (4, 4), (0, 4))), ("-99", ring((0, 0), (99, 0), (99, 99), (0, 99)))], "zone string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 2, 2), (2, 5, 5), (3, 6, 6), (4, 0, 10), (5, 4, 4)], "key long, x long, y long")
    assert {r.key: r.zone for r in spatial.zones_at(points, zones).collect()} == {1: "A", 2: "B", 4: "B", 5: "A"}


def test_graph_serves_all_anchors_or_is_refused(spark):
    """Of two parts the one that every anchor reaches stays, the other is pruned; anchors no part serves are an error."""
    from placeloom.operators import network

    left = [(0, 0, 10, 0), (10, 0, 20, 0), (20, 0, 20, 10)]
    right = [(100, 0, 110, 0), (110, 0, 110, 10), (110, 10, 100, 0), (110, 10, 120, 10)]
    pieces = spark.createDataFrame([(i, *p) for i, p in enumerate(left + right)], "seg_id long, x0 long, y0 long, x1 long, y1 long")
    anchors = lambda *p: spark.createDataFrame([(i, *a) for i, a in enumerate(p)], "key long, x long, y long")
    kept = lambda *p: {tuple(r)[1:] for r in network.served_graph(pieces, anchors(*p), 30).collect()}
    assert kept((0, 5), (25, 5)) == set(left) and kept((105, 5), (130, 10)) == set(right)
    with pytest.raises(ValueError, match="serves every anchor"):
        kept((0, 5), (130, 10))


def test_ratios_of_many_names_are_those_of_one():
    import difflib

    rng = random.Random(4)
    names = {"".join(rng.choice("abc 12é") for _ in range(rng.randrange(9))) for _ in range(60)} | {f"customer {rng.randrange(9000)}" for _ in range(40)} | {"museum of japan", "ab" * 30, "ba" * 40}
    names = sorted(names)
    i, j = (c.ravel() for c in np.indices((len(names), len(names))))
    want = [difflib.SequenceMatcher(None, *sorted((names[p], names[q])), autojunk=False).ratio() if names[p] and names[q] else 0.0 for p, q in zip(i.tolist(), j.tolist())]
    assert text.fold_ratios(names, i, j).tolist() == want


@pytest.mark.parametrize("several", [False, True])
def test_names_of_positions_agree_as_those_of_pairs(spark, monkeypatch, several):
    monkeypatch.setattr(resolve, "MEET", 3)
    rng = random.Random(6)
    places = spark.createDataFrame([(i, 23.7 + rng.randrange(6) * 1e-4, 38.0) for i in range(60)] + ([(7, 23.7, 38.0)] if several else []), "place_id long, lon double, lat double")
    said = [(i, t, f"Café {rng.randrange(30)}") for i in range(60) for t in rng.choice((["und"], ["en"], ["el", "und"], ["el", "en"], [None])) for _ in "xy"[: 1 + several]]
    if not several:
        said = [(i, t, f"Bar {i % 9}" if i else None) for i, t, _ in said]
    names = spark.createDataFrame(said, "key long, tag string, name string")
    want = resolve.name_agreement(resolve.near_pairs(places, metres=15.0), names)
    assert sorted(map(str, resolve.near_agreement(places, names, 15.0).collect())) == sorted(map(str, want.collect())) != []


@pytest.mark.parametrize("seed", (0, 2, 3))
def test_clusters_without_edges(spark, seed):
    """Clusters replayed by records are those of all edges in order; a heap of records at one place makes no pairs."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abc 1", k=rng.randint(1, 6)))
    spots = [(28.0 + rng.randrange(12) / 5000, 36.0 + rng.randrange(3) / 5000) for _ in range(25)]
    share = (0.0, 0.1, 0.3, 0.5, 0.8, 0.02)[seed]
    rows = [(i, *rng.choice(spots), f"g{rng.randrange(6)}" if rng.random() < share else None) for i in rng.sample(range(1000), 140)]
    rows += [(2000, None, None, None), (2001, None, None, "g1"), (2002, 28.0, None, "g2"), (2003, -70.0, 10.0, None), (2004, -70.0, 10.0, None), (2005, *spots[0], None)]
    records = spark.createDataFrame(rows, "place_id long, lon double, lat double, gers_id string")
    named = [(i, rng.choice(["und", "en", "el", None]) if rng.random() < 0.7 else "und", word()) for i, *_ in rows for _ in range(1 if rng.random() < 0.7 else 2)]
    named += [(2003, "und", "same"), (2004, "en", "same"), (2005, "und", None), (2005, "und", "  ")]
    names = spark.createDataFrame(named, "key long, tag string, name string")
    want = resolve.clusters(records.select("place_id", "gers_id"), resolve.match_edges(records, names))
    got = {r.place_id: r.cluster for r in resolve.matched_clusters(records, names).collect()}
    assert got == {r.place_id: r.cluster for r in want.collect()} and len(got) == len(rows) > len(set(got.values()))
    n = 30_000
    keys, none = np.arange(n), np.zeros(n, np.int64)
    heap = resolve._absorb(keys, none, pa.array(["name 1"] * n), pa.array(["und"] * n), np.where(keys % 3 == 0, keys % 7, -1), none[:1], none[:1], 0.6)
    assert set(heap[1].tolist()) == {0, 3, 6, 9, 12, 15, 18} and (heap[1] == 0).sum() > 20_000


def test_equal_segments_are_cut_once(spark):
    """Many copies of two crossing ways, one long way and halves: four pieces and more, each of the least copy, without pairs of copies."""
    from placeloom.operators import network

    many = spark.range(100, 60_100).selectExpr("id as seg_id", "case when id % 2 = 0 then 0 else 10 end as x0", "0 as y0", "case when id % 2 = 0 then 10 else 0 end as x1", "10 as y1")
    others = spark.createDataFrame([(1, -500, 2, 500, 2), (2, -3, -4, -4, -4), (3, -4, -5, -3, -4), (4, 7, 7, 7, 7), (5, -7, -7, -4, -4)], "seg_id long, x0 long, y0 long, x1 long, y1 long")
    got = {tuple(r) for r in network.noded(many.unionByName(others)).collect()}
    want = {(100, 0, 0, 2, 2), (100, 2, 2, 5, 5), (100, 5, 5, 7, 7), (100, 7, 7, 10, 10), (101, 8, 2, 10, 0), (101, 5, 5, 8, 2), (101, 0, 10, 5, 5), (1, -500, 2, 2, 2), (1, 2, 2, 8, 2), (1, 8, 2, 500, 2)}
    want |= {(2, -4, -4, -3, -4), (3, -4, -5, -3, -4), (5, -7, -7, -4, -4)}
    assert got == want


def test_stops_of_days_are_read_and_dealt_once(spark):
    plan = QUERIES["feasibility_day"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 3


def test_verdicts_make_their_pieces_once(spark):
    from placeloom.operators import network

    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    pieces = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 2), (5, 5, 6, 6)], "x0 long, y0 long, x1 long, y1 long").withColumn("y1", counted("y1"))
    assert tuple(network.graph_verdict(pieces).first()) == (2, 3, 2) and made.value == 3
