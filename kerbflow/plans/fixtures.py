"""Domain tables derived from the test tables: one text that Spark and DuckDB both read (integer arithmetic only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages")

SIGHTINGS = """select event_id id, cast(event_id % 2 + 1 as int) pass, cast(floor(event_id / 200e0) as bigint) street,
 25e0 + floor(event_id / 200e0) * 0.005e0 + ((user_id % 50) * 6e0 + ((event_id * 7919) % 1000) / 250e0) / 110540e0 lat,
 -80e0 + ((event_id * 104729) % 1000) / 50000000e0 lon, cast(floor(event_id / 200e0) as bigint) % 36 * 10e0 heading,
 3e0 + event_id % 5 sa, 1.8e0 sc, event_type color, case when event_id % 7 = 0 then 'truck' else 'car' end cls,
 event_id % 200 * 10e0 + (event_id % 2) * 1500e0 ts from {events}"""

DETECTIONS = """select o_orderkey car, o_orderkey % 64 segment, case when o_orderkey % 128 < 64 then 'left' else 'right' end side,
 cast(floor(o_orderkey / 128e0) as bigint) * 3 + l_linenumber frame, (floor(o_orderkey / 128e0) * 3 + l_linenumber) / 4e0 t,
 floor(o_orderkey / 128e0) * 7e0 - 7e0 + l_linenumber * 0.5e0 + (l_partkey % 10) / 20e0 s_cam,
 -(20e0 + l_linenumber * 9 + l_partkey % 5) bearing, 900e0 - l_linenumber * 18 - l_partkey % 7 cx, 500e0 + o_orderkey % 40 cy,
 100e0 + l_linenumber * 2 bh, 150e0 + l_linenumber * 3 bw,
 case o_orderkey % 5 when 0 then 'grey' when 1 then 'black' when 2 then 'white' when 3 then 'red' else 'silver' end color,
 case when o_orderkey % 9 = 0 then 'truck' else 'car' end cls, l_orderkey * 8 + l_linenumber ord
 from {lineitem} join {orders} on l_orderkey = o_orderkey"""

BOXES = """select l_orderkey image, l_orderkey * 8 + l_linenumber ord, (l_partkey * 37) % 200 * 1e0 x1, (l_suppkey * 53) % 150 * 1e0 y1,
 (l_partkey * 37) % 200 + 60e0 + l_quantity x2, (l_suppkey * 53) % 150 + 40e0 + l_quantity y2,
 ((l_orderkey * 7 + l_linenumber * 13) % 100) / 100e0 score, cast(1 + (l_partkey % 9) as int) class_id from {lineitem}"""

WAYS = """select s_suppkey way, cast(s_suppkey % 2 as int) vertical, case when s_suppkey % 2 = 0 then (s_suppkey * 3) % 20 else s_suppkey % 20 end x0,
 case when s_suppkey % 2 = 0 then cast(floor(s_suppkey / 2e0) as bigint) else cast(floor(s_suppkey / 2e0) as bigint) - 2 end y0,
 case s_suppkey % 5 when 0 then 'residential' when 1 then 'tertiary' when 2 then 'secondary' when 3 then 'primary' else 'unclassified' end highway,
 case s_suppkey % 7 when 0 then '2' when 1 then '2;3' when 2 then '4' when 3 then 'two' end lanes, s_name street from {supplier}"""

VERTICES = """select way, highway, lanes, street, cast(i as int) idx, 4 last_idx, (x0 + i * (1 - vertical)) * 100000 + y0 + i * vertical node,
 25.7e0 + (y0 + i * vertical) * 120e0 / 110540e0 lat, -80.2e0 + (x0 + i * (1 - vertical)) * 120e0 / 100000e0 lon
 from (""" + WAYS + """) w cross join (select 0 i union all select 1 union all select 2 union all select 3 union all select 4) k"""

SEGMENTS = """select way, idx, highway, lanes, street, lat alat, lon alon, blat, blon from (select *, lead(lat) over (partition by way order by idx) blat,
 lead(lon) over (partition by way order by idx) blon from (""" + VERTICES + """) v) s where blat is not null"""

ANCHORS = """select c_custkey anchor, cast(40700 + c_nationkey as varchar(9)) zone,
 25.7e0 + ((c_custkey * 7) % 500) * 12e0 / 110540e0 + (c_custkey % 11) / 110540e0 lat,
 -80.2e0 + ((c_custkey * 13) % 240) * 12e0 / 100000e0 + (c_custkey % 7) / 100000e0 lon from {customer}"""

TRACK = """select user_id vid, event_id * 1e0 t, 25.7e0 + ((event_id * 37) % 1000) / 100000e0 lat, -80.2e0 + ((event_id * 91) % 1000) / 100000e0 lon,
 event_id from {events}"""

ODOMETRY = """select user_id vid, cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) frame, value mag,
 case when event_id % 4 = 0 then null else value end flow, event_id from {events}"""

SURVEY = """select user_id vid, cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) sample,
 cast((event_id * 7) % 6 as bigint) kerb, event_id from {events}"""

DESCRIPTORS = "select vec_id t, embedding vec from {embeddings}"
RGB = """select p_partkey part, cast((p_partkey * 37) % 256 as int) r, cast((p_size * 5 + p_partkey * 11) % 256 as int) g,
 cast((p_partkey * 73) % 256 as int) b from {part}"""

RAW = """select l_orderkey * 8 + l_linenumber ord, l_quantity * 4e0 bh, (l_partkey * 53) % 1920 * 1e0 cx, (l_suppkey * 31) % 1240 * 1e0 cy from {lineitem}"""

MOVING = """select car, segment, side, ord, case when car % 4 = 0 then s_cam * 10 else s_cam end s_cam, case when car % 4 = 0 then -45e0 - ord % 3 else bearing end bearing from (""" + DETECTIONS + """) d"""

KNOWN = """select event_id * 1e0 lo, event_id * 1e0 + case when event_id % 970 = 0 then 300 else event_id % 23 end hi from {events} where event_id % 97 = 0"""

FLOW = """select l_suppkey frame, l_orderkey * 8 + l_linenumber point, l_quantity % 3 <> 0 still, x, y,
 s * (cos(turn) * x - sin(turn) * y) + l_suppkey % 9 - 4 + (l_partkey % 11 - 5) * 0.05e0 + case when l_quantity % 3 <> 0 then 0 else 30 + l_orderkey % 17 end x2,
 s * (sin(turn) * x + cos(turn) * y) + 1.5e0 + (l_orderkey % 13 - 6) * 0.04e0 - case when l_quantity % 3 <> 0 then 0 else 25 end y2
 from (select *, (l_partkey * 37 + l_linenumber * 211) % 1900 * 1e0 x, (l_orderkey * 13) % 1060 * 1e0 y, 1 + (l_suppkey % 5) * 0.004e0 s,
 (l_suppkey % 7 - 3) * 0.002e0 turn from {lineitem}) f"""

MATCHES = """select pair, point, x, y, case when good then mx else (point * 53) % 1900 * 1e0 end x2, case when good then my else (point * 29) % 1060 * 1e0 end y2, mx, my
 from (select *, (1.02e0 * x + 0.01e0 * y + 12) / (1 + 0.0001e0 * x + 0.00005e0 * y) mx, (0.98e0 * y - 0.01e0 * x - 7) / (1 + 0.0001e0 * x + 0.00005e0 * y) my
 from (select cast(floor(o_custkey / 6e0) as bigint) pair, o_orderkey point, (o_orderkey * 37) % 1900 * 1e0 x, (o_orderkey * 91) % 1060 * 1e0 y,
 o_orderkey % 12 < cast(floor(o_custkey / 6e0) as bigint) % 13 good from {orders}) m) n"""

FIXTURES = {
    "sightings": SIGHTINGS, "detections": DETECTIONS, "boxes": BOXES, "ways": WAYS, "vertices": VERTICES, "segments": SEGMENTS, "anchors": ANCHORS,
    "track": TRACK, "odometry": ODOMETRY, "survey": SURVEY, "descriptors": DESCRIPTORS, "rgb": RGB,
    "raw": RAW, "moving": MOVING, "known": KNOWN, "flow": FLOW, "matches": MATCHES,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a test table as it is."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("varchar(9)", "string"), **used)


def ctes(*names: str) -> str:
    """The same fixtures as a DuckDB WITH list."""
    return "with " + ", ".join(f"{n} as ({FIXTURES[n].format(**{t: t for t in TABLES})})" for n in names)
