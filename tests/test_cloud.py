import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapoint.functions import encode as E
from stratapoint.model import Bounds, InvalidInput, Lod, PointQuery, Unsupported
from stratapoint.operators.hierarchy import page_roots, plan_pages
from stratapoint.operators.lod import KEY, assign_lod
from stratapoint.operators.stats import validate, violations
from stratapoint.plans.cloud import Cloud, Metadata, carried, write_cloud
from stratapoint.model import Entry, VoxelKey


def grid(spark, n=1500):
    i = F.col("idx")
    return spark.range(n).withColumnRenamed("id", "idx").select(
        "idx", (i % 31 - 15).cast("double").alias("x"), (F.floor(i / 31) % 29 - 14).cast("double").alias("y"), (F.floor(i / 899) % 23 - 11).cast("double").alias("z"),
        (i % 4 + 1).cast("short").alias("return_number"), F.lit(4).cast("short").alias("number_of_returns"), ((i % 90) - 45).cast("float").alias("scan_angle"), (i * 0.25 + 1e9).alias("gps_time"),
        *[(i * k % 65535).cast("int").alias(c) for c, k in (("red", 1), ("green", 3), ("blue", 7))],
    )


def plain_lod(points, box, cap):
    """The assignment by a work list over Python lists."""
    center, half = box.root_cube()
    todo, out = [(VoxelKey.root(), Bounds.cube(center, half), sorted(points))], {}
    while todo:
        key, cube, own = todo.pop()
        if len(own) <= cap or key.level >= 30:
            out |= {p[0]: (key, i) for i, p in enumerate(own)}
            continue
        c = cube.center()
        parts = [[] for _ in range(8)]
        for p in own:
            parts[sum((p[1 + a] >= c[a]) << a for a in range(3))].append(p)
        at, place = [0] * 8, 0
        while place < cap:
            for o in range(8):
                if at[o] < len(parts[o]) and place < cap:
                    out[parts[o][at[o]][0]] = (key, place)
                    at[o] += 1
                    place += 1
        todo += [(key.child(o), cube.octant(o), parts[o][at[o] :]) for o in range(8) if len(parts[o]) > at[o]]
    return out


@pytest.mark.parametrize(("n", "cap", "chunk"), [(257, 7, 16), (1200, 60, 100)])
def test_assignment_equals_the_plain_one(spark, n, cap, chunk):
    rows = [(i, float(37 * i % 101), float(53 * i % 103), float(71 * i % 107)) for i in range(n)]
    box = Bounds(tuple(min(r[a] for r in rows) for a in (1, 2, 3)), tuple(max(r[a] for r in rows) for a in (1, 2, 3)))
    got = assign_lod(spark.createDataFrame(rows, "idx long, x double, y double, z double"), box, cap, chunk=chunk).collect()
    want = plain_lod(rows, box, cap)
    assert len(got) == n and {r["idx"]: (VoxelKey(*(r[k] for k in KEY)), r["pos"]) for r in got} == want


def test_round_trip_and_queries(spark, tmp_path):
    df = grid(spark)
    cloud = write_cloud(df, f"{tmp_path}/c", max_points_per_node=64, metadata=Metadata(vlrs=[("mine", 5, "kept", b"\1", True)], crs_wkt=" WKT "))
    again = Cloud.open(spark, f"{tmp_path}/c")
    assert again.points.count() == 1500 == again.size_hint()[0] and again.hierarchy.agg(F.max("point_count")).first()[0] <= 64
    assert sorted(map(tuple, again.query(columns=["gps_time", "x", "nir"]).collect())) == sorted(map(tuple, df.select("x", "gps_time").collect()))
    assert [r["data"] for r in again.vlrs.collect()] == [b"WKT\0", b"\1"] and again.header["returns"][:4] == [375] * 4
    box = Bounds((-4.0, -3.5, -12.0), (5.0, 4.5, -9.0))
    inside = df.filter("x between -4 and 5 and y between -3.5 and 4.5 and z between -12 and -9").count()
    assert cloud.query(PointQuery(bounds=box)).count() == inside > 0
    low, high = cloud.size_hint(PointQuery(bounds=box))
    assert low == 0 and inside <= high < 1500
    by_level = {r["level"]: r["count"] for r in cloud.points.groupBy("level").count().collect()}
    assert cloud.query(PointQuery(Lod.level(1))).count() == by_level[1] and cloud.query(PointQuery(Lod.range(1, 1))).count() == 0
    assert cloud.query(PointQuery(Lod.up_to(cloud.info.spacing / 2))).count() == by_level[0] + by_level[1]
    place = [tuple(r[k] for k in (*KEY, "pos")) for r in cloud.ordered().collect()]
    assert place == sorted(place)
    with pytest.raises(InvalidInput):
        write_cloud(df, f"{tmp_path}/c")
    assert [p.name for p in tmp_path.iterdir()] == ["c"]


def test_page_roots_equal_the_plan(spark):
    keys = [VoxelKey.root(), *(VoxelKey.root().child(o) for o in range(8)), *(VoxelKey.root().child(3).child(o) for o in range(8)), VoxelKey.root().child(3).child(1).child(0)]
    df = spark.createDataFrame([(k.level, k.x, k.y, k.z) for k in keys], "level int, kx int, ky int, kz int")
    got = {VoxelKey(*(r[k] for k in KEY)): VoxelKey(r["page_level"], r["page_x"], r["page_y"], r["page_z"]) for r in page_roots(df, 4).collect()}
    assert got == {e.key: root for root, own, _ in plan_pages([Entry(k, 0, 1, 1) for k in keys], 4) for e in own}


@pytest.mark.parametrize(("change", "message"), [
    ({"x": "double('nan')"}, "x coordinate must be finite"), ({"x": "5000000D"}, "outside the declared bounds"), ({"gps_time": "double('inf')"}, "GPS time"),
    ({"return_number": "smallint(16)"}, "return_number must be 0..15"), ({"scan_angle": "float(400)"}, "scan_angle"), ({"red": "70000"}, "red must be"),
])
def test_bad_points_are_named(spark, change, message):
    df = grid(spark, 40)
    for c, v in change.items():
        df = df.withColumn(c, F.when(F.col("idx") >= 17, F.expr(v)).otherwise(F.col(c)))
    with pytest.raises(InvalidInput, match=f"point 17: .*{message}"):
        validate(df, Bounds((-15, -14, -11), (15, 14, 11)), (0.001,) * 3, (0.0,) * 3)
    assert violations(df, Bounds((-15, -14, -11), (15, 14, 11)), (0.001,) * 3, (0.0,) * 3).filter("broken > 0").count() >= 1


def test_rejections_leave_nothing(spark, tmp_path):
    df = grid(spark, 10)
    for bad, error in ((df.drop("red"), InvalidInput), (df.withColumn("nir", F.lit(1)), Unsupported), (df.filter("idx < 0"), InvalidInput), (df.drop("z"), InvalidInput), (df.withColumn("x", F.lit("a")), InvalidInput)):
        with pytest.raises(error):
            write_cloud(bad, f"{tmp_path}/c")
    with pytest.raises(InvalidInput):
        write_cloud(df, f"{tmp_path}/c", metadata=Metadata(scale=(1e-9,) * 3))
    with pytest.raises(Unsupported):
        carried([("LASF_Projection", 34735, "", b"", False)], "  ")
    assert not list(tmp_path.iterdir())


def test_codecs(spark):
    got = spark.createDataFrame([(v,) for v in (0.5, -0.5, 2.5, -2.5, 0.49999999999999994, 3e9, float("nan"))], "v double").select(E.quantize(F.col("v"), 1.0, 0.0)).collect()
    assert [r[0] for r in got] == [1, -1, 3, -3, 0, None, None]
    angles = np.linspace(-180, 180, 999).astype(np.float32)
    steps = [r[0] for r in spark.createDataFrame([(float(a),) for a in angles], "a double").select(E.angle_steps(F.col("a").cast("float"))).collect()]
    q = angles / np.float32(0.006)
    assert steps == (np.sign(q) * np.floor(np.abs(q.astype(np.float64)) + 0.5)).astype(int).tolist()
