"""Hand-worked cases: gates, ties, boundaries."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbflow.functions import scalar as S
from kerbflow.operators import ordered, place, robust, spatial, tracking


def one(spark, expression):
    return spark.sql(f"select {expression} v").first().v


@pytest.mark.parametrize("rgb, name", [((54, 67, 75), "grey"), ((150, 40, 40), "red"), ((45, 65, 130), "blue"), ((170, 150, 115), "silver")])
def test_colour(spark, rgb, name):
    assert one(spark, S.colour(*map(str, rgb))) == name


def test_scalars(spark):
    assert one(spark, S.heading("0e0", "0e0", "1e0", "0e0")) == 0 and one(spark, S.heading("0e0", "0e0", "0e0", "1e0")) == pytest.approx(90)
    assert [one(spark, S.confidence(str(n))) for n in (1, 2, 5, 8)] == [0.0, 0.4, 0.87, 0.97]
    assert one(spark, S.spaces("42.7e0")) == 6
    assert [one(spark, S.plausible(h, x)) for h, x in (("'residential'", "null"), ("'secondary'", "'2;3'"), ("'secondary'", "null"), ("'secondary'", "'two'"), ("'primary'", "'2'"))] == [True, True, False, False, False]
    assert [one(spark, S.verdict(f"({m}e0)", "1e0")) for m in ("0.8", "1.0", "1.2", "-1.2")] == ["ambiguous", "ambiguous", "inside", "outside"]


def test_margin_takes_either_winding(spark):
    ring = [("0e0", "0e0"), ("10e0", "0e0"), ("10e0", "4e0"), ("0e0", "4e0")]
    for corners in (ring, ring[::-1]):
        assert one(spark, S.signed_margin(corners, "5e0", "1e0")) == 1 and one(spark, S.signed_margin(corners, "5e0", "-2e0")) == -2
    assert one(spark, S.signed_margin(ring[::-1], "5e0", "1e0", ccw_only=True)) == -1


def sightings(spark, rows):
    return spark.createDataFrame([(i, 25.0 + m / 110_540, -80.0, 0.0, 2.0, 1.8, c, "car", ts) for i, m, c, ts in rows], "id long, lat double, lon double, heading double, sa double, sc double, color string, cls string, ts double")


def test_match_is_mutual_and_one_to_one(spark):
    a = sightings(spark, [(1, 0.0, "grey", 0.0), (2, 2.0, "grey", 0.0), (3, 9.0, "red", 0.0)])
    b = sightings(spark, [(1, 1.9, "grey", 1200.0), (2, 9.0, "blue", 1200.0)])
    assert [(r.a_id, r.b_id) for r in spatial.match(a, b).collect()] == [(2, 1)]
    assert [(r.a_id, r.b_id) for r in spatial.match(b, a).collect()] == [(1, 2)]
    assert spatial.overstay(a, b, 1200.0).count() == 1 and spatial.overstay(a, b, 1200.1).count() == 0
    assert spatial.match(a.where("id < 0"), b).count() == 0


def test_synthetic_replay_finds_stayers_only(spark):
    cars = [(i, 12.0 * i, ["grey", "black", "red"][i % 3], 0.0) for i in range(40)]
    stay = [(100 + i, m + (i % 5 - 2) * 0.5, c, 2400.0) for i, m, c, _ in cars if i % 5 < 3]
    found = spatial.overstay(sightings(spark, cars), sightings(spark, stay), 1200.0).collect()
    assert {(r.a_id, r.b_id) for r in found} == {(i, 100 + i) for i in range(40) if i % 5 < 3}


def test_nearest_is_strict(spark):
    d = 30.0 / 110_540
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lat double, lon double")
    at = lambda x: spark.createDataFrame([(7, "z", x, 0.0)], "anchor int, zone string, lat double, lon double")
    assert spatial.nearest(p, at(d * 1.0000001), "id", 30.0).first().anchor is None
    assert spatial.nearest(p, at(d * 0.999), "id", 30.0).first().anchor == 7


def test_asof_brackets_and_extrapolates(spark):
    track = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 10.0, 1.0, 0.0), (1, 20.0, 1.0, 1.0)], "vid int, t double, lat double, lon double")
    q = spark.createDataFrame([(1, x) for x in (-5.0, 5.0, 10.0, 20.0, 25.0)], "vid int, q double")
    got = ordered.asof(q, track, "vid", "q", "t", ["lat", "lon"]).selectExpr("q", "lat + (lat_2 - lat) * (q - t) / (t_2 - t) lat", "lon + (lon_2 - lon) * (q - t) / (t_2 - t) lon").orderBy("q").collect()
    assert [(r.lat, r.lon) for r in got] == [(-0.5, 0.0), (0.5, 0.0), (1.0, 0.0), (1.0, 1.0), (1.0, 1.5)]


def test_series(spark):
    d = spark.createDataFrame([(1, i, m) for i, m in enumerate((0.0, 10.0, 10.0, 0.0, 5.0))], "k int, i int, m double")
    got = d.select("i", ordered.moving_average("m", "k", "i", 5).alias("s")).withColumn("k", F.lit(1)).withColumn("p", ordered.prefix("s", "k", "i")).orderBy("i").collect()
    assert [r.s for r in got] == [4, 4, 5, 5, 3] and [r.p for r in got] == [0, 4, 8, 13, 18]
    d = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 6.0), (1, 4, None), (2, 0, None)], "k int, i int, m double")
    assert [r.f for r in d.select("k", "i", ordered.fill("m", "k", "i").alias("f")).orderBy("k", "i").collect()] == [2, 2, 4, 6, 6, 0]
    d = spark.createDataFrame([(1, i, m) for i, m in enumerate((0, 3, 3, 0, 3))], "k int, i int, m int")
    assert sorted((r.island, r.i) for r in ordered.islands(d, "k", "i", F.col("m") >= 3).collect()) == [(1, 1), (1, 2), (2, 4)]


def views(spark, rows):
    return spark.createDataFrame([(1, s, b) for s, b in rows], "k int, s_cam double, bearing double")


@pytest.mark.parametrize("rows, want", [([(10.0, -45.0)], (17.0, 3.0, 1)), ([(0.0, -20.0)], None), ([(0.0, -45.0), (10.0, -45.0), (20.0, -45.0)], None)])
def test_triangulate(spark, rows, want):
    got = robust.triangulate(views(spark, rows), ["k"]).collect()
    assert [(pytest.approx(r.s), r.sigma, r.n_dets) for r in got] == ([want] if want else [])
    s, n = tracking.placements(np.zeros(len(rows)), *np.array(rows).T)
    assert (s.tolist(), n.tolist()) == (([pytest.approx(want[0])], [want[2]]) if want else ([], []))


def test_placements_of_many_tracks_equal_triangulate(spark):
    rng = np.random.default_rng(3)
    track, s_cam, bearing = rng.integers(0, 40, 300), rng.random(300) * 30, -20 - rng.random(300) * 65
    s, n = tracking.placements(track, s_cam, bearing)
    d = spark.createDataFrame([(int(k), float(a), float(b)) for k, a, b in zip(track, s_cam, bearing)], "k int, s_cam double, bearing double")
    want = robust.triangulate(d, ["k"]).orderBy("k").collect()
    assert s.tolist() == pytest.approx([r.s for r in want]) and n.tolist() == [r.n_dets for r in want]


def test_slot_moves_after_absorbing(spark):
    t = spark.createDataFrame([(1, "left", i, s, 2.0, n, "grey", "car") for i, (s, n) in enumerate([(0.0, 5), (4.0, 3), (8.0, 2)])], "segment long, side string, track_id long, s double, sigma double, n_dets long, color string, cls string")
    assert [(r.s, r.n_dets, r.n_tracklets) for r in tracking.slot(t).orderBy("s").collect()] == [(1.5, 8, 2), (8.0, 2, 1)]


def brute_slots(rows, apart=4.5):
    """[position, sigma, views, tracklets] of cars: every tracklet against all cars so far."""
    cars = []
    for s, sigma, n in sorted(rows, key=lambda r: -r[2]):
        near = min(cars, key=lambda c: abs(c[0] - s), default=None)
        if near and abs(near[0] - s) < apart:
            near[:] = [(near[0] * near[2] + s * n) / (near[2] + n), min(near[1], sigma), near[2] + n, near[3] + 1]
        else:
            cars.append([s, max(sigma, 1.0), n, 1])
    return sorted(cars)


def test_slots_equal_a_search_over_all_cars(spark):
    rng = np.random.default_rng(2)
    groups = {g: [(float(a), float(b), int(n)) for a, b, n in zip(rng.random(60) * 90, rng.random(60) * 3, rng.integers(2, 9, 60))] for g in range(5)}
    t = spark.createDataFrame([(g, "left", i, s, sigma, n, "grey", "car", i, i + 5) for g, rows in groups.items() for i, (s, sigma, n) in enumerate(rows)], "segment long, side string, track_id long, s double, sigma double, n_dets long, color string, cls string, first_frame long, last_frame long")
    got = tracking.slot(t).orderBy("segment", "s").collect()
    for g, rows in groups.items():
        want = brute_slots(rows)
        mine = [r for r in got if r.segment == g]
        assert [(r.sigma, r.n_dets, r.n_tracklets) for r in mine] == [tuple(w[1:]) for w in want]
        assert [r.s for r in mine] == pytest.approx([w[0] for w in want]) and all(r.first_frame < r.last_frame for r in mine)


def one_car(segment, s, color, frames=range(6)):
    """Detections of a car at s that the camera passes, 7 m beside it."""
    out = []
    for f in frames:
        cam = s - 4.0 + f
        bearing = -math.degrees(math.atan2(7.0, abs(s - cam) + 0.5))
        out.append((segment, "left", f + int(s) * 3, len(out) + int(s) * 100 + segment * 10**6, f / 4.0 + s, cam, bearing, 900.0 - 20 * f, 500.0, 100.0, color, "car"))
    return out


DETECTION = "segment long, side string, frame long, ord long, t double, s_cam double, bearing double, cx double, cy double, bh double, color string, cls string"


def test_parked_cars_from_detections_to_places(spark):
    import kerbflow

    d = spark.createDataFrame(one_car(1, 20.0, "grey") + one_car(1, 60.0, None) + one_car(2, 20.0, "red", range(2)), DETECTION)
    cars = kerbflow.track_parked(d).orderBy("segment", "along_m").collect()
    assert [(r.segment, r.color) for r in cars] == [(1, "grey"), (1, None), (2, "red")]
    assert all(r.first_t <= r.abeam_t <= r.last_t and r.abeam_t > 0 for r in cars) and cars[0].n_dets >= 4 and cars[0].confidence > 0.7
    assert {r.segment for r in kerbflow.track_parked(d, min_frames=3).collect()} == {1}
    track = spark.createDataFrame([(1, 0.0, 25.0, -80.0), (1, 100.0, 25.01, -80.0)], "segment long, t double, lat double, lon double")
    placed = kerbflow.geolocate(kerbflow.track_parked(d), track, epoch="2024-01-01 00:00:00").collect()
    mirrored = kerbflow.geolocate(kerbflow.track_parked(d), track, mirrored=True).collect()
    assert len(placed) == 2 and all(r.lon < -80.0 and r.heading == 0 and r.timestamp.year == 2024 for r in placed) and all(r.lon > -80.0 for r in mirrored)
    west = math.radians(-80.0 - placed[0].lon) * 6378137 * math.cos(math.radians(25.0))
    assert abs(abs(west) - 7.0) < 0.01


def test_positions_by_arc_length_and_from_times(spark):
    track = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 5.0, 0.001, 0.0), (1, 6.0, 0.002, 0.0)], "k int, t double, lat double, lon double")
    arcs = [r.arc for r in place.arc_lengths(track, "k").orderBy("t").collect()]
    assert arcs == pytest.approx([0, 110.54, 221.08])
    at = place.position_at_arc(spark.createDataFrame([(1, 55.27), (1, 165.81)], "k int, s double"), track, "k", "s", left_m=5.0).orderBy("s").collect()
    assert [r.at_lat for r in at] == pytest.approx([0.0005, 0.0015]) and all(r.at_lon < 0 for r in at)
    fixes = spark.sql("select 1 k, timestamp'2024-01-01 00:00:07.5' time, 1e0 lat, 2e0 lon union all select 1, timestamp'2024-01-01 00:00:05', 0e0, 2e0")
    assert sorted(r.t for r in place.gps_track(fixes, "k").collect()) == [0.0, 2.5]


def test_wide_sigmas_keep_their_partners(spark):
    rows = lambda shift, ts: [(i, 25.0 + (i * 200 + shift) / 110_540, -80.0, 0.0, sigma, sigma, "grey", "car", ts) for i, sigma in enumerate((0.5, 2.0, 10.0, 40.0))]
    kind = "id long, lat double, lon double, heading double, sa double, sc double, color string, cls string, ts double"
    a = spark.createDataFrame(rows(0, 0.0), kind)
    for shift, want in ((1.0, {0, 1, 2, 3}), (4.9, {1, 2, 3}), (24.9, {2, 3}), (99.0, {3})):
        assert {r.a_id for r in spatial.match(a, spark.createDataFrame(rows(shift, 9.0), kind)).where("a_id = b_id").collect()} == want
    probes = spark.createDataFrame([(1, 25.0 + 679.0 / 110_540, -80.0)], "probe int, plat double, plon double")
    assert {r.id for r in spatial.presence(a, probes).collect()} == {3}


def test_long_segments_are_found_along_their_whole_length(spark):
    rng = np.random.default_rng(5)
    seg = [(k, 0, "residential", "s", 25.0 + float(rng.random()) / 50, -80.0 + float(rng.random()) / 50, 25.0 + float(rng.random()) / 50, -80.0 + float(rng.random()) / 50) for k in range(30)]
    segments = spark.createDataFrame(seg, "way int, idx int, highway string, street string, alat double, alon double, blat double, blon double")
    pts = [(i, 24.99 + float(rng.random()) / 25, -80.01 + float(rng.random()) / 25) for i in range(200)] + [(999, 26.5, -80.0)]
    points = spark.createDataFrame(pts, "id int, lat double, lon double")
    d = points.crossJoin(segments).withColumn("d", F.expr(S.segment_distance("lat", "lon"))).groupBy("id").agg(F.min(F.struct("d", "way")).alias("m")).collect()
    want = {r.id: (r.m.way, r.m.d) for r in d}
    got = {r.id: (r.way, r.distance) for r in spatial.nearest_segment(points, segments, "id").collect()}
    assert got == want
    assert {r.id for r in spatial.nearest_segment(points, segments, "id", 25.0).collect()} == {i for i, (_, x) in want.items() if x <= 25.0}
    boxes = spatial.zone_boxes(segments, segments.selectExpr("way", "idx", "'z' zone"))
    inside = points.select("id", "lat", "lon").crossJoin(boxes).withColumn("margin", F.expr(spatial.MARGIN)).where("margin > -1").select("id").distinct().collect()
    assert {r.id for r in spatial.judge(points, boxes, "id", 1.0).where("verdict <> 'outside'").collect()} == {r.id for r in inside}


def test_summary_of_verdicts(spark):
    judged = spark.createDataFrame([("inside", 2.0, "1"), ("inside", 4.0, "2"), ("inside", 3.0, "1"), ("ambiguous", 0.1, "1"), ("outside", None, None)], "verdict string, margin double, zone string")
    r = spatial.summarise(judged).first()
    assert (r.cars, r.in_paid_zone, r.outside_any_zone, r.ambiguous, r.ambiguous_share, r.by_zone, r.median_margin_inside) == (5, 3, 1, 1, 0.2, {"1": 2, "2": 1}, 3.0)
    none = spatial.summarise(judged.limit(0)).first()
    assert none.cars == 0 and none.ambiguous_share == 0.0 and none.by_zone == {} and none.median_margin_inside is None


def test_components_of_chains_stars_and_loops(spark):
    from kerbflow.operators.graph import components
    from kerbflow.scratch import Workspace

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}


def test_suppression_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    box = [(int(i % 3), i, *(float(v) for v in (x, y, x + 40, y + 40)), float(s)) for i, (x, y, s) in enumerate(zip(rng.integers(0, 80, 60), rng.integers(0, 80, 60), rng.random(60)))]
    got = {r.ord for r in tracking.box_nms(spark.createDataFrame(box, "image long, ord long, x1 double, y1 double, x2 double, y2 double, score double")).collect()}
    want = []
    for b in sorted(box, key=lambda b: -b[6]):
        over = lambda k: max(min(b[4], k[4]) - max(b[2], k[2]), 0) * max(min(b[5], k[5]) - max(b[3], k[3]), 0)
        if not any(k[0] == b[0] and over(k) / (3200 - over(k)) > 0.55 for k in want):
            want.append(b)
    assert got == {b[1] for b in want}


def frame_rows(rows):
    return pd.DataFrame([(f, i, cx, 500.0, 100.0, c, k) for i, (f, cx, c, k) in enumerate(rows)], columns=["frame", "ord", "cx", "cy", "bh", "color", "cls"])


def test_associate_rules():
    ids = lambda rows: tracking.track_ids(frame_rows(rows), 1920, 1080, 0.14, 4, 25)
    assert ids([(0, 900.0, "grey", "car"), (1, 880.0, "grey", "car")]) == [0, 0]
    assert ids([(0, 900.0, "grey", "car"), (1, 930.0, "grey", "car")]) == [0, 1]  # jumps right
    assert ids([(0, 900.0, "grey", "car"), (5, 890.0, "grey", "car")]) == [0, 1]  # too old
    assert ids([(0, 900.0, "grey", "car"), (1, 880.0, "red", "car")]) == [0, 0]  # only colour differs
    assert ids([(0, 900.0, "grey", "car"), (1, 880.0, "red", "truck")]) == [0, 1]


def test_nms_and_sinks(spark, tmp_path):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 0.0, 11.0, 10.0, 0.8), (1, 3, 8.0, 0.0, 18.0, 10.0, 0.7)], "image long, ord long, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r.ord for r in tracking.box_nms(b).collect()) == [1, 3]
    from kerbflow.sources import files, sinks

    (tmp_path / "z.json").write_text('[{"id":"9","signageCode":null,"geometry":[{"latitude":0,"longitude":0},{"latitude":0,"longitude":-80},{"latitude":null,"longitude":-80}]}]')
    assert [(r.signage_code, r.lat, r.lon) for r in files.read_zones(spark, str(tmp_path / "z.json")).collect()] == [("9", 0.0, -80.0)]
    (tmp_path / "s.json").write_text('{"elements":[{"type":"way","id":5,"nodes":[1,2],"geometry":[{"lat":1,"lon":2},{"lat":3,"lon":4}],"tags":{"highway":"tertiary"}}]}')
    assert [(r.way, r.idx, r.node, r.street) for r in files.read_streets(spark, str(tmp_path / "s.json")).orderBy("idx").collect()] == [(5, 0, 1, "way/5"), (5, 1, 2, "way/5")]
    row = spark.sql("select array(named_struct('lon', 1.0D, 'lat', 2.0D), named_struct('lon', 3.0D, 'lat', 4.0D)) ring, 'a<b' name, '#112233' c")
    got = row.select(sinks.wkt(F.col("ring")).alias("w"), sinks.placemark(F.col("name"), F.col("ring"), F.col("c")).alias("p"), sinks.polygon_feature(F.col("ring"), name=F.col("name")).alias("g")).first()
    assert got.w == "POLYGON ((1.0 2.0, 3.0 4.0))" and "a&lt;b" in got.p and "ff332211" in got.p and '"coordinates":[[[1.0,2.0],[3.0,4.0]]]' in got.g
    log = sightings(spark, [(1, 0.0, "grey", 5.0), (2, 1.0, "red", 1.0)]).withColumn("zone", F.lit(None).cast("string"))
    sinks.write_log_csv(log, str(tmp_path / "log"))
    assert [r.id for r in spark.read.option("header", True).csv(str(tmp_path / "log")).where("zone = 'UNKNOWN'").collect()]


def test_streams_plan(spark, tmp_path):
    from kerbflow.streaming import live

    s = sightings(spark, [(1, 0.0, "grey", 9000.0)]).withColumn("time", F.timestamp_seconds("ts"))
    s.write.parquet(str(tmp_path / "a"))
    s.withColumn("id", F.lit(2).cast("long")).withColumn("time", F.timestamp_seconds(F.lit(10800.0))).write.parquet(str(tmp_path / "b"))
    read = lambda n: spark.readStream.schema(s.schema).parquet(str(tmp_path / n))
    q = live.overstay_stream(read("a"), read("b")).writeStream.format("memory").queryName("over").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [(r.a_id, r.b_id) for r in spark.table("over").collect()] == [(1, 2)]
    q = live.presence_counts(read("a")).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("seen").collect()] == [1]


def test_candidates_behind_many_close_ones_are_kept(spark):
    from kerbflow.operators.tracking import candidate_dedupe

    near = range(-7, 8)
    rows = [(100 * c + a, 100 * c + b, 1000.0 - c - 0.5 * (a != 0 or b != 0)) for c in range(1, 21) for a in near for b in near]
    got = candidate_dedupe(spark.createDataFrame(rows, "i long, j long, sim double")).collect()
    assert sorted(r.i for r in got) == [100 * c for c in range(1, 21)]


def recorded(monkeypatch):
    """Rows of every table that a workspace writes, by name, and the plan that wrote it."""
    from kerbflow.scratch import Workspace

    seen, plain = {}, Workspace.table

    def table(self, df, name):
        out = plain(self, df, name)
        seen[name] = out.count(), df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(Workspace, "table", table)
    return seen


def test_nearest_asks_once_a_place(spark, monkeypatch):
    """Copies of a place are one question and one answer, and a place that has found its nearest asks no more."""
    seen = recorded(monkeypatch)
    at = lambda i: (25.7 + (i % 5) * 40 / 110_540, -80.2)
    points = spark.createDataFrame([(i, *at(i)) for i in range(500)] + [(900, None, -80.2), (901, 26.5, -80.2)], "id long, lat double, lon double")
    anchors = spark.createDataFrame([(7 * i, *at(i), str(i)) for i in range(1, 500) if i % 5 != 4] + [(-1, None, None, "x")], "anchor long, lat double, lon double, zone string")
    got = {r.id: (r.anchor, r.zone, r.distance and round(r.distance, 6)) for r in spatial.nearest(points, anchors, "id", 50.0).collect()}
    want = {0: (35, "5", 0.0), 1: (7, "1", 0.0), 2: (14, "2", 0.0), 3: (21, "3", 0.0)}
    assert all(got[i] == want[i % 5] for i in range(500) if i % 5 != 4)
    assert {got[i][0] for i in range(4, 500, 5)} == {21} and got[4][2] == pytest.approx(40.0, abs=0.1) and got[900] == got[901] == (None, None, None)
    assert (seen["places"][0], seen["anchors"][0], seen["found-0"][0], seen["left-0"][0]) == (6, 4, 4, 2)


def pieces(rows, link_m):
    """Least id of each single-linkage piece, by comparing all with all."""
    of = {r[0]: r[0] for r in rows}
    metres = lambda a, b: math.hypot((a[2] - b[2]) * 110_540, (a[3] - b[3]) * 111_320 * math.cos(math.radians(a[2])))
    near = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and metres(a, b) < link_m]
    while True:
        before = dict(of)
        for a, b in near:
            of[a] = of[b] = min(of[a], of[b])
        if of == before:
            return of


@pytest.mark.parametrize("gap_m", [299.0, 301.0])
def test_linked_points_of_crowds(spark, monkeypatch, gap_m):
    """Crowds whose nearest members lie just within or beyond the link: found without pairs of all their members."""
    from kerbflow.scratch import Workspace

    seen, rng = recorded(monkeypatch), np.random.default_rng(3)
    line = [*-rng.uniform(0, 180, 60), 0.0, *gap_m + rng.uniform(0, 180, 60), gap_m]
    rows = [(i, "a", 25.7 + float(y) / 110_540, -80.2) for i, y in enumerate(line)]
    rows += [(1000 + i, "b", 25.7 + y / 110_540, -80.2 + x / 100_000) for i, (y, x) in enumerate(rng.uniform(0, 4000, (150, 2)).tolist())]
    rows += [(5000 + i, *rows[0][1:]) for i in range(2000)]
    points = spark.createDataFrame(rows, "id long, zone string, lat double, lon double")
    got = {r.id: r.comp for r in spatial.linked_points(points, "id", "zone", 300.0, Workspace(spark, "test")).collect()}
    want = pieces([r for r in rows if r[0] < 5000], 300.0)
    assert got == want | {5000 + i: want[0] for i in range(2000)} and len({got[i] for i in range(122)}) == (1 if gap_m < 300 else 2)
    assert seen["near"][0] < 3000 and "BroadcastExchange" not in seen["near"][1]


def test_stretches_are_tracked_side_by_side():
    """Stretches of quiet, busy and crowded frames get the numbers that each gets by itself."""
    rng, rows = np.random.default_rng(5), []
    for c in range(60):
        crowd = (2, 7, 30)[c % 3]
        for frame in np.cumsum(rng.integers(1, 4, rng.integers(1, 25))):
            rows += [(c, int(frame), float(rng.integers(0, 6) * 20), float(rng.integers(0, 3) * 30), 100.0 + rng.integers(0, 3) * 10, *rng.choice(["a", "b", "c"], 2)) for _ in range(rng.integers(1, crowd + 1))]
    d = pd.DataFrame(rows, columns=["chain", "frame", "cx", "cy", "bh", "color", "cls"])
    got = tracking.track_many(*(d[c].to_numpy() for c in ("chain", "frame", "cx", "cy", "bh")), [pd.factorize(d[c])[0] for c in ("color", "cls")])
    for c, part in d.assign(got=got).groupby("chain"):
        assert part["got"].tolist() == tracking.track_ids(part, 1920, 1080, 0.14, 4, 25)
    assert tracking.track_many(*(np.empty(0, int),) * 5, []).tolist() == []


def test_kerb_in_pieces_equals_the_whole_kerb(spark):
    """Cars of a kerb that is cut where nothing lies close are those of the kerb as a whole."""
    rng = np.random.default_rng(8)
    s, n = np.cumsum(rng.choice([0.4, 2.0, 4.4, 4.5, 9.0], 400)), rng.integers(1, 9, 400)
    rows = [(1, "left", i, float(a), 1.5, int(b), "red", "car") for i, (a, b) in enumerate(zip(s, n))]
    got = tracking.slot(spark.createDataFrame(rows, "segment long, side string, track_id long, s double, sigma double, n_dets long, color string, cls string"))
    order = np.lexsort((np.arange(400), -n))
    car, at = tracking.cars_of(s[order], n[order], 4.5)
    spots = lambda pairs: sorted((round(float(a), 9), int(b)) for a, b in pairs)
    assert spots((r.s, r.n_dets) for r in got.collect()) == spots(zip(at, np.bincount(car, weights=n[order])))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_piece" in plan and "FlatMapGroupsInPandas" not in plan


def test_resamples_of_blocks_add_up(spark):
    """Streets are cut into blocks, whose resamples count the cars that each block has by itself."""
    rows = [(k % 2, "left", 20 * k + i, 100 * k + i, float(i), 12.0 * k + i / 10, -50.0, 900.0 - 9 * i, 500.0, 100.0, "red", "car") for k in range(30) for i in range(4)]
    d = spark.createDataFrame(rows, "segment long, side string, frame long, ord long, t double, s_cam double, bearing double, cx double, cy double, bh double, color string, cls string")
    assert tracking.blocks(d).select("segment", "block").distinct().count() == 30
    counts = {(r.boot, r.min_frames): r.n for r in tracking.bootstrap_counts(d, (2, 4), boots=3).collect()}
    assert counts[0, 2] == counts[0, 4] == 30 and len(counts) == 8
    for boot in (1, 2, 3):
        views = [sum(tracking.kept_frames(np.array([20 * k + i]), boot, 0.9, 7)[0] for i in range(4)) for k in range(30)]
        assert [counts[boot, t] for t in (2, 4)] == [sum(v >= t for v in views) for t in (2, 4)]


def test_exported_boxes_are_worked_out_once(spark, monkeypatch):
    """All three documents read one written table."""
    from kerbflow.plans.catalogue import QUERIES

    seen = recorded(monkeypatch)
    out = QUERIES["export_documents"](spark, "/root/testdata/sf0.001")
    assert seen["boxes"][0] == out.count() > 0
