"""The driver's tables as point clouds, with the same adapters in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Bounds
from ..operators.lod import assign_lod
from ..operators.scratch import Scratch

CODES = {"view": 1, "click": 2, "signup": 6, "purchase": 12, "error": 7}
BOX = Bounds((-1.0, 0.0, 0.0), (1_000_000.0, 1_000_000.0, 24.0))
CAPACITY = 1000

CLOUD_SQL = f"""cloud as (
  select event_id as idx, cast(user_id as double) as x, value as y, cast(hour(ts) as double) as z,
    cast(floor(epoch(ts)) as double) as gps_time, cast(event_id % 65536 as integer) as intensity, cast(event_id % 5 + 1 as integer) as return_number,
    cast(case event_type {" ".join(f"when '{k}' then {v}" for k, v in CODES.items())} else 0 end as integer) as classification,
    cast(cast((event_id % 180) - 90 as double) * 0.5 as float) as scan_angle
  from events)"""


def events_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as points: x user, y value, z hour; event_id is the ordinal."""
    code = F.lit(0)
    for k, v in CODES.items():
        code = F.when(F.col("event_type") == k, F.lit(v)).otherwise(code)
    i = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        i.alias("idx"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), F.hour("ts").cast("double").alias("z"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").cast("double").alias("gps_time"),
        (i % 65536).cast("int").alias("intensity"), (i % 5 + 1).cast("int").alias("return_number"), code.cast("int").alias("classification"),
        (((i % 180) - 90).cast("double") * 0.5).cast("float").alias("scan_angle"),
    )


def cloud_bounds(points: DataFrame) -> Bounds:
    r = points.agg(*[f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"]).first()
    return Bounds(tuple(r[f"lo{a}"] for a in "xyz"), tuple(r[f"hi{a}"] for a in "xyz"))


_assigned: dict[tuple[str, str], tuple[DataFrame, Bounds]] = {}


def assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Bounds]:
    """The events cloud with its level-of-detail keys, written once a session and table."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _assigned:
        points = events_cloud(spark, sf_dir)
        box = cloud_bounds(points)
        _assigned[at] = (Scratch(spark, "cloud").save(assign_lod(points, box, CAPACITY)), box)
    return _assigned[at]


def lod_sql(levels: int = 8, capacity: int = CAPACITY) -> str:
    """The assignment as unrolled windows, for checking; table ``lod``."""
    cube = ", ".join(f"min({a}) + (max({a}) - min({a})) * 0.5 as c{a}" for a in "xyz")
    half = "greatest(greatest(" + ", ".join(f"max({a}) - min({a})" for a in "xyz") + ") / 2, 1e-6)"
    out = [CLOUD_SQL, f"cube as (select {cube}, {half} as half from cloud)"]
    out.append("l0 as (select cloud.*, 0 as kx, 0 as ky, 0 as kz, " + ", ".join(f"c{a} - half as lo{a}, c{a} + half as hi{a}" for a in "xyz") + " from cloud cross join cube)")
    for k in range(levels):
        octant = " + ".join(f"case when {a} >= (lo{a} + hi{a}) * 0.5 then {1 << i} else 0 end" for i, a in enumerate("xyz"))
        out.append(f"a{k} as (select *, count(*) over (partition by kx, ky, kz) as n, {octant} as o from l{k})")
        out.append(f"b{k} as (select *, row_number() over (partition by kx, ky, kz, o order by idx) as r, row_number() over (partition by kx, ky, kz order by idx) as p from a{k})")
        out.append(f"c{k} as (select *, row_number() over (partition by kx, ky, kz order by r, o) as s from b{k})")
        up = {a: f"(o >> {i}) & 1" for i, a in enumerate("xyz")}
        boxes = ", ".join(f"case when {up[a]} = 1 then (lo{a} + hi{a}) * 0.5 else lo{a} end as lo{a}, case when {up[a]} = 1 then hi{a} else (lo{a} + hi{a}) * 0.5 end as hi{a}" for a in "xyz")
        keys = ", ".join(f"k{a} * 2 + ({up[a]}) as k{a}" for a in "xyz")
        cols = "idx, x, y, z, gps_time, intensity, return_number, classification, scan_angle"
        out.append(f"l{k + 1} as (select {cols}, {keys}, {boxes} from c{k} where n > {capacity} and s > {capacity})")
    chosen = [f"select {cols}, {k} as level, kx, ky, kz, case when n <= {capacity} then p - 1 else s - 1 end as pos from c{k} where n <= {capacity} or s <= {capacity}" for k in range(levels)]
    out.append("lod as (" + " union all ".join(chosen) + ")")
    return "with " + ", ".join(out)
