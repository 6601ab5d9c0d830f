"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode as E
from ..model import Bounds, Lod, PointQuery, VoxelKey
from ..operators import hierarchy as H
from ..operators import predicates as P
from ..operators import stats as S
from ..operators.lod import KEY, octant_of
from .bridge import BOX, CLOUD_SQL, assigned, events_cloud, lod_sql

QUERY_BOX = Bounds((10.0, 50.0, 0.0), (60.0, 300.0, 24.0))
FACE_BOX = Bounds((20.0, 0.0, 5.0), (20.0, 500.0, 5.0))
RECORD = 30
GAP = 4000
SCALE = (0.01, 0.01, 0.01)
OFFSET = (0.0, 0.0, 0.0)
POINT = ["x", "y", "z", "gps_time", "classification"]
_CLOUD = f"with {CLOUD_SQL} "
_LOD = lod_sql()
_BOXED = "x between {0} and {3} and y between {1} and {4} and z between {2} and {5}"


def _inside(b: Bounds) -> str:
    return _BOXED.format(*(f"{v!r}" for v in (*b.min, *b.max)))


def _meets(b: Bounds) -> str:
    """SQL for: the node's box touches b; needs columns cx, cy, cz, half and the key."""
    side = "(half * 2.0 / pow(2.0, level))"
    return " and ".join(f"(c{a} - half + k{a} * {side}) <= {hi!r} and (c{a} - half + k{a} * {side}) + {side} >= {lo!r}" for a, lo, hi in zip("xyz", b.min, b.max))


Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _registry[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _registry.items() if sql}


@query(_CLOUD + "select * from cloud")
def scan_points(spark, sf):
    return events_cloud(spark, sf)


@query(_CLOUD + "select idx, x, y, z from cloud")
def project_xyz(spark, sf):
    return events_cloud(spark, sf).select("idx", "x", "y", "z")


@query(_CLOUD + "select x, z, intensity, classification, gps_time from cloud")
def project_layout_order(spark, sf):
    from ..functions.schema import projected

    cloud = events_cloud(spark, sf)
    return cloud.select(*projected(cloud.columns, ["gps_time", "classification", "nir", "x", "intensity", "z", "x"]))


@query(_CLOUD + f"select idx, {', '.join(POINT)} from cloud where {_inside(QUERY_BOX)}")
def filter_box_closed(spark, sf):
    return events_cloud(spark, sf).filter(P.in_box(QUERY_BOX)).select("idx", *POINT)


@query(_CLOUD + f"select idx, x, y, z from cloud where {_inside(FACE_BOX)}")
def filter_box_touching_face(spark, sf):
    return events_cloud(spark, sf).filter(P.in_box(FACE_BOX)).select("idx", "x", "y", "z")


@query(_CLOUD + "select min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from cloud")
def bounds_agg(spark, sf):
    return S.bounds_of(events_cloud(spark, sf))


@query(_CLOUD + "select min(gps_time) as gps_min, max(gps_time) as gps_max from cloud")
def gps_range(spark, sf):
    return events_cloud(spark, sf).agg(F.min("gps_time").alias("gps_min"), F.max("gps_time").alias("gps_max"))


@query(_CLOUD + ", n as (select return_number as r, count(*) as c from cloud group by 1) select cast(i as integer) as return_number, coalesce(c, 0) as points from range(1, 16) t(i) left join n on r = i")
def return_histogram(spark, sf):
    return S.return_histogram(events_cloud(spark, sf))


@query(_CLOUD + "select count(*) as points from cloud")
def point_count(spark, sf):
    return events_cloud(spark, sf).agg(F.count(F.lit(1)).alias("points"))


@query(_CLOUD + "select idx, cast(round(x / cast(0.01 as double)) as integer) as ix, cast(round(y / cast(0.01 as double)) as integer) as iy, cast(round(z / cast(0.01 as double)) as integer) as iz from cloud")
def quantize_xyz(spark, sf):
    return events_cloud(spark, sf).select("idx", *[E.quantize(F.col(a), s, o).alias(f"i{a}") for a, s, o in zip("xyz", SCALE, OFFSET)])


@query(_CLOUD + "select idx, cast(round(x / cast(0.01 as double)) as integer) * cast(0.01 as double) + cast(0 as double) as x, cast(round(y / cast(0.01 as double)) as integer) * cast(0.01 as double) + cast(0 as double) as y from cloud")
def dequantize_xyz(spark, sf):
    return events_cloud(spark, sf).select("idx", *[E.dequantize(E.quantize(F.col(a), 0.01, 0.0), 0.01, 0.0).alias(a) for a in "xy"])


@query(_CLOUD + ", s as (select idx, cast(round(cast(cast(scan_angle as double) / cast(cast(0.006 as float) as double) as float)) as smallint) as steps from cloud) select idx, steps, cast(steps as float) * cast(0.006 as float) as degrees from s")
def scan_angle_codec(spark, sf):
    steps = events_cloud(spark, sf).select("idx", E.angle_steps(F.col("scan_angle")).alias("steps"))
    return steps.select("idx", "steps", E.angle_degrees(F.col("steps")).alias("degrees"))


@query("select event_id as idx, cast((event_id % 5 + 1) | (5 << 4) as integer) as returns, cast((case when event_id % 11 = 0 then 1 else 0 end) + (case when event_id % 13 = 0 then 2 else 0 end) + (case when event_id % 17 = 0 then 4 else 0 end) + (case when event_id % 19 = 0 then 8 else 0 end) + (event_id % 4) * 16 + (event_id % 2) * 64 + (case when event_id % 7 = 0 then 128 else 0 end) as integer) as flags from events")
def flags_pack(spark, sf):
    i = F.col("idx")
    every = lambda n: i % n == 0
    return events_cloud(spark, sf).select("idx", E.pack_returns(F.col("return_number"), F.lit(5)).alias("returns"), E.pack_flags(every(11), every(13), every(17), every(19), i % 4, i % 2 == 1, every(7)).cast("int").alias("flags"))


@query("select event_id as idx, cast(event_id % 5 + 1 as integer) as return_number, 5 as number_of_returns, event_id % 11 = 0 as synthetic, event_id % 13 = 0 as key_point, event_id % 17 = 0 as withheld, event_id % 19 = 0 as overlap, cast(event_id % 4 as integer) as scan_channel, event_id % 2 = 1 as scan_direction_flag, event_id % 7 = 0 as edge_of_flight_line from events")
def flags_unpack(spark, sf):
    packed = flags_pack(spark, sf)
    return packed.select("idx", *[c.alias(n) for n, c in (E.unpack_returns(F.col("returns")) | E.unpack_flags(F.col("flags"))).items()])


@query(_CLOUD + "select case when classification = 12 then 1 else classification end as classification, count(*) as points from cloud group by 1")
def class_overlap_remap(spark, sf):
    return events_cloud(spark, sf).groupBy(E.class_read(F.col("classification")).alias("classification")).agg(F.count(F.lit(1)).alias("points"))


@query(_CLOUD + "select idx, cast((case when x >= 75 then 1 else 0 end) + (case when y >= 245 then 2 else 0 end) + (case when z >= 12 then 4 else 0 end) as integer) as octant from cloud")
def octant_assign(spark, sf):
    return events_cloud(spark, sf).select("idx", octant_of(*(F.col(a) for a in "xyz"), F.lit(75.0), F.lit(245.0), F.lit(12.0)).alias("octant"))


@query("select i as octant, 3 as level, 2 + (i & 1) as kx, 4 + ((i >> 1) & 1) as ky, 6 + ((i >> 2) & 1) as kz from range(8) t(i)")
def child_key(spark, sf):
    kids = [VoxelKey(2, 1, 2, 3).child(o) for o in range(8)]
    return spark.createDataFrame([(o, k.level, k.x, k.y, k.z) for o, k in enumerate(kids)], "octant long, level int, kx long, ky long, kz long")


@query(_LOD + " select idx, level, kx, ky, kz, pos from lod")
def lod_assign(spark, sf):
    return assigned(spark, sf)[0].select("idx", *KEY, "pos")


_NODES = _LOD + f", n as (select level, kx, ky, kz, count(*) as point_count, count(*) * {RECORD} as byte_size from lod group by all), nodes as (select level, kx, ky, kz, cast(375 + coalesce(sum(byte_size) over (order by level, kx, ky, kz rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", byte_size, point_count from n)"


def _nodes(spark, sf):
    cloud, box = assigned(spark, sf)
    return H.nodes_of(cloud, RECORD, 375), box


@query(_NODES + " select * from nodes")
def hierarchy_nodes(spark, sf):
    return _nodes(spark, sf)[0]


@query(_NODES + " select cast(sum(point_count) as bigint) as points, count(*) as nodes from nodes")
def hierarchy_total(spark, sf):
    return H.total_points(_nodes(spark, sf)[0])


@query(_NODES + " select level, count(*) as nodes, cast(sum(point_count) as bigint) as points, max(point_count) as fullest from nodes group by 1")
def node_fill(spark, sf):
    return _nodes(spark, sf)[0].groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.sum("point_count").alias("points"), F.max("point_count").alias("fullest"))


@query(_NODES + " select *, case when point_count = -1 then 'page' when point_count = 0 then 'empty' else 'points' end as kind from nodes")
def entry_kinds(spark, sf):
    return _nodes(spark, sf)[0].withColumn("kind", P.entry_kind())


def _query(spark, sf, q: PointQuery) -> DataFrame:
    cloud, box = assigned(spark, sf)
    center, half = box.root_cube()
    return cloud.filter(P.in_levels(q, half / 128) & P.node_meets(q.bounds, center, half) & P.in_box(q.bounds))


@query(_LOD + " select idx, x, y, z from lod where level = 1")
def lod_level(spark, sf):
    return _query(spark, sf, PointQuery(Lod.level(1))).select("idx", "x", "y", "z")


@query(_LOD + " select idx, level from lod where level >= 1 and level < 3")
def lod_level_range(spark, sf):
    return _query(spark, sf, PointQuery(Lod.range(1, 3))).select("idx", "level")


@query(_LOD + " select idx, level from lod where level < (select greatest(1, cast(ceil(log2(half / 128 / 1.2)) as integer) + 1) from cube)")
def lod_resolution(spark, sf):
    return _query(spark, sf, PointQuery(Lod.up_to(1.2))).select("idx", "level")


_SIDE = "(half * 2.0 / pow(2.0, level))"


@query(_NODES + " select level, kx, ky, kz, " + ", ".join(f"c{a} - half + k{a} * {_SIDE} as {a}min, (c{a} - half + k{a} * {_SIDE}) + {_SIDE} as {a}max" for a in "xyz") + " from nodes cross join cube")
def voxel_bounds(spark, sf):
    nodes, box = _nodes(spark, sf)
    return nodes.select(*KEY, *[c.alias(n) for n, c in P.voxel_box(*box.root_cube()).items()])


@query(_NODES + f" select nodes.* from nodes cross join cube where {_meets(QUERY_BOX)}")
def chunk_prune(spark, sf):
    nodes, box = _nodes(spark, sf)
    center, half = box.root_cube()
    return P.selected_nodes(nodes, PointQuery(bounds=QUERY_BOX), center, half, half / 128)


@query(_NODES + f" select cast(coalesce(sum(point_count), 0) as bigint) as candidates from nodes cross join cube where {_meets(QUERY_BOX)}")
def query_candidates(spark, sf):
    return chunk_prune(spark, sf).agg(F.coalesce(F.sum("point_count"), F.lit(0)).alias("candidates"))


@query(_LOD + f" select idx, {', '.join(POINT)}, level from lod cross join cube where level < 2 and {_meets(QUERY_BOX)} and {_inside(QUERY_BOX)}")
def query_box_lod(spark, sf):
    return _query(spark, sf, PointQuery(Lod.range(0, 2), QUERY_BOX)).select("idx", *POINT, "level")


@query(_LOD + f" select idx, {', '.join(POINT)}, level from lod cross join cube where {_meets(QUERY_BOX)} and {_inside(QUERY_BOX)}")
def query_box_all(spark, sf):
    return _query(spark, sf, PointQuery(bounds=QUERY_BOX)).select("idx", *POINT, "level")


@query(_NODES + f""", s as (select nodes.* from nodes cross join cube where {_meets(QUERY_BOX)}), e as (select *, max("offset" + byte_size) over (order by "offset", level, kx, ky, kz rows between unbounded preceding and 1 preceding) as prev from s)
 select level, kx, ky, kz, "offset", byte_size, point_count, cast(sum(case when prev is null or "offset" > prev + {GAP} then 1 else 0 end) over (order by "offset", level, kx, ky, kz rows unbounded preceding) as bigint) as grp from e""")
def coalesce_ranges(spark, sf):
    return H.coalesce_ranges(chunk_prune(spark, sf), GAP)


_PAGE = 6


@query(_NODES + f""", up as (select n.*, p.level as pl, p.kx as px, p.ky as py, p.kz as pz from nodes n join nodes p on p.level <= n.level and n.kx >> (n.level - p.level) = p.kx and n.ky >> (n.level - p.level) = p.ky and n.kz >> (n.level - p.level) = p.kz),
 size as (select pl, px, py, pz, count(*) as c from up group by all), fit as (select up.*, row_number() over (partition by level, kx, ky, kz order by pl) as rn from up join size using (pl, px, py, pz) where c <= {_PAGE})
 select n.level, n.kx, n.ky, n.kz, n.point_count, cast(coalesce(f.pl, n.level) as integer) as page_level, cast(coalesce(f.px, n.kx) as integer) as page_x, cast(coalesce(f.py, n.ky) as integer) as page_y, cast(coalesce(f.pz, n.kz) as integer) as page_z from nodes n left join fit f on f.rn = 1 and (f.level, f.kx, f.ky, f.kz) = (n.level, n.kx, n.ky, n.kz)""")
def page_plan(spark, sf):
    return H.page_roots(_nodes(spark, sf)[0], _PAGE).drop("offset", "byte_size")


@query(_LOD + " select idx, level, row_number() over (order by level, kx, ky, kz, pos) as place from lod")
def order_file(spark, sf):
    """The place of each point in stored order: its node's start plus its place in the node."""
    cloud, _ = assigned(spark, sf)
    nodes = H.nodes_of(cloud, 1)
    return cloud.join(nodes.select(*KEY, "offset"), KEY).select("idx", "level", (F.col("offset") + F.col("pos") + 1).alias("place"))


@query(_LOD + " select idx, level, kx, ky, kz from (select *, row_number() over (partition by level, kx, ky, kz order by pos) as rn from lod) where rn <= 5")
def lod_prefix_topk(spark, sf):
    return H.first_of_nodes(assigned(spark, sf)[0], 5).select("idx", *KEY)


@query(_CLOUD + ", e as (select cast(idx % 50 as integer) as level, 0 as kx, 0 as ky, 0 as kz, idx as seq, intensity as point_count from cloud) select level, kx, ky, kz, arg_max(point_count, seq) as point_count from e group by all")
def latest_entries(spark, sf):
    e = events_cloud(spark, sf).select((F.col("idx") % 50).cast("int").alias("level"), F.lit(0).alias("kx"), F.lit(0).alias("ky"), F.lit(0).alias("kz"), F.col("idx").alias("seq"), F.col("intensity").alias("point_count"))
    return H.latest_entries(e, "seq")


@query(_NODES + " select level, kx, ky, kz, point_count from nodes where level >= 1 and (kx >> (level - 1)) = 0 and (ky >> (level - 1)) = 0 and (kz >> (level - 1)) = 0")
def subtree(spark, sf):
    nodes, _ = _nodes(spark, sf)
    return nodes.filter(F.col("level") >= 1).filter(P.below(1, 0, 0, 0)).select(*KEY, "point_count")


@query(_CLOUD + "select cast(date_part('year', date_add(date '1970-01-01', cast(idx as integer))) as integer) as year, cast(date_part('doy', date_add(date '1970-01-01', cast(idx as integer))) as integer) as day, idx from cloud")
def civil_days(spark, sf):
    year, day = E.civil_day(F.col("idx"))
    return events_cloud(spark, sf).select(year.alias("year"), day.alias("day"), "idx")
