"""Clustered files written and read back, stores, codecs, cancellation and the octree on odd ordinals."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapoint.model import Bounds, InvalidInput, Lod, PointQuery, Unsupported
from stratapoint.operators.hierarchy import coalesce_ranges, plan_pages
from stratapoint.operators.lod import assign_lod
from stratapoint.operators.prefix import bucket_offsets, ranked
from stratapoint.operators.scratch import Scratch
from stratapoint.plans import cloud as C
from stratapoint.plans import files as Q
from stratapoint.sources import chunks
from stratapoint.sources.clustered import open_index, read_clustered, write_clustered
from stratapoint.sources.las import LasSource, decode, encode, export_las, nearest
from stratapoint.sources.records import RecordBatches, RecordSpill, spill_records, spill_rows
from stratapoint.sources.ranges import BytesRanges, CountedRanges, FileRanges, StoreRanges, ranges_of


def points(spark, n=3000):
    i = F.col("idx")
    df = spark.range(n).withColumnRenamed("id", "idx")
    return df.select("idx", ((i * 37 % 101) * 1.0).alias("x"), ((i * 53 % 97) * 1.0).alias("y"), ((i * 71 % 89) * 1.0).alias("z"), (i % 5 + 1).cast("int").alias("return_number"), (i % 7).cast("int").alias("intensity"),
        (i % 256).cast("int").alias("red"), F.lit(2).alias("green"), F.lit(3).alias("blue"), (i * 0.5).alias("gps_time"), F.concat(F.lit("e"), (i % 10).cast("string")).cast("binary").alias("extra_bytes"))


def test_a_written_file_reads_back(spark, tmp_path):
    cloud = C.write_cloud(points(spark), f"{tmp_path}/cloud", None, 200, C.Metadata(scale=(0.01,) * 3, vlrs=[("u", 7, "d", b"abc", False), ("v", 8, "d", b"defg", True)], encoding=8, gps_standard_time=True), 2)
    path = f"{tmp_path}/a.copc.las"
    write_clustered(cloud, path, page_entries=5)
    names = ["x", "y", "z", "intensity", "return_number", "red", "gps_time", "extra_bytes", "level", "kx", "ky", "kz"]
    got = read_clustered(spark, path).select(*names)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, cloud.points.select(*names).collect()))
    index = open_index(ranges_of(path))
    assert len(index.loaded) > 1 and index.header.encoding == 1 | 8 | 16 and index.header.extra == 2
    assert [(r.user_id, r.record_id) for r in index.header.records] == [("copc", 1), ("laszip encoded", 22204), ("u", 7), ("copc", 1000), ("v", 8)]
    box = PointQuery(Lod.range(0, 2), Bounds((10, 10, 10), (40, 60, 50)))
    assert sorted(map(repr, read_clustered(spark, path, box, ["x", "level"]).collect())) == sorted(map(repr, cloud.ordered(box).select("x", "level").collect()))
    counted = CountedRanges(FileRanges(path))
    lazy = open_index(counted, eager=False)
    few = sum(e.byte_size for e in lazy.chunks(box))
    assert few < sum(e.byte_size for e in index.chunks(PointQuery())) and len(lazy.loaded) < len(index.loaded)
    assert len(index.reads(PointQuery())) == 1
    rows = [b.num_rows for e in index.chunks(PointQuery()) for b in index.chunk(e, ["x"], step=64)]
    assert sum(rows) == 3000 and max(rows) <= 64
    with pytest.raises(InvalidInput):
        write_clustered(cloud, path)


def test_other_compressors_need_a_codec(spark, tmp_path):
    cloud = C.write_cloud(points(spark, 50).drop("extra_bytes"), f"{tmp_path}/cloud")
    with pytest.raises(Unsupported):
        write_clustered(cloud, f"{tmp_path}/b.las", compressor=3)
    raw = Q._small_file()
    with pytest.raises(Unsupported):
        chunks.codec(9)
    assert chunks.codec(0)(raw[:60], 2, 30) == raw[:60]


def test_stores_and_exported_files(spark, tmp_path):
    path = f"{tmp_path}/c.las"
    export_las(points(spark).drop("extra_bytes"), path, fmt=7, scale=(0.01,) * 3)
    spark.dataSource.register(LasSource)
    got = spark.read.format("las").load(path).select("idx", "x", "intensity", "red", "gps_time")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, points(spark).select("idx", "x", "intensity", "red", "gps_time").collect()))
    store, plain = StoreRanges(f"file://{path}"), FileRanges(path)
    assert store.size() == plain.size() and store.read(100, 50) == plain.read(100, 50)


def test_ties_of_the_exporter_go_away_from_zero():
    assert nearest(np.array([0.5, 1.5, -0.5, -2.5, 2.4])).tolist() == [1, 2, -1, -3, 2]
    rows = {a: np.array([0.0]) for a in "xyz"} | {"scan_angle": np.array([0.003], np.float32)}
    assert decode(encode(rows, 6, 0, (1.0,) * 3, (0.0,) * 3), 6, 0, (1.0,) * 3, (0.0,) * 3, ["scan_angle"])["scan_angle"].to_pylist() == [pytest.approx(0.006)]


def test_the_octree_does_not_depend_on_chunks_or_sparse_ordinals(spark):
    df = points(spark, 2000).select("idx", "x", "y", "z")
    box = Bounds((0, 0, 0), (100, 96, 88))
    keys = ["idx", "level", "kx", "ky", "kz", "pos"]
    want = sorted(map(tuple, assign_lod(df, box, 50).select(*keys).collect()))
    assert want == sorted(map(tuple, assign_lod(df, box, 50, chunk=16).select(*keys).collect()))
    far = df.withColumn("idx", F.col("idx") * 1_000_003)
    assert [(i // 1_000_003, *r) for i, *r in sorted(map(tuple, assign_lod(far, box, 50, chunk=16).select(*keys).collect()))] == want


def test_equal_points_end_in_one_deepest_node(spark, monkeypatch):
    monkeypatch.setattr("stratapoint.operators.lod.MAX_LEVEL", 4)
    df = spark.range(60).select(F.col("id").alias("idx"), *[F.lit(1.0).alias(a) for a in "xyz"])
    got = assign_lod(df, Bounds((0, 0, 0), (2, 2, 2)), 1, chunk=8).groupBy("level").count().collect()
    assert {r["level"]: r["count"] for r in got} == {k: 1 for k in range(4)} | {4: 56}


def test_running_sums_in_two_levels_and_by_ranges(spark, monkeypatch):
    from stratapoint.operators import prefix

    monkeypatch.setattr(prefix, "ONE_WINDOW", 7)
    df = spark.range(100).select(F.lit("g").alias("g"), F.col("id").alias("b"), (F.col("id") % 5).alias("n"))
    got = {r["b"]: r["s"] for r in bucket_offsets(df, ["g"], "b", {"n": "s"}, 100).collect()}
    assert got == {i: sum(j % 5 for j in range(i)) for i in range(100)}
    rows = ranked(df, [F.col("b")], "r", Scratch(spark, "t"), {"n": "s"}, {"n": "m"}).collect()
    assert all(r["r"] == r["b"] and r["s"] == got[r["b"]] and r["m"] == (max(j % 5 for j in range(r["b"])) if r["b"] else None) for r in rows)
    table = spark.createDataFrame([(0, 0, 0, i, i * 10, 4 + 20 * (i == 3)) for i in range(30)], "level int, kx int, ky int, kz int, `offset` long, byte_size long")
    assert [r["grp"] for r in coalesce_ranges(table, 0).orderBy("offset").collect()] == [1, 2, 3, *[4] * 3, *range(5, 29)]


def test_pages_of_a_deep_index_are_planned_in_one_pass():
    from stratapoint.model import Entry, VoxelKey

    entries = [Entry(VoxelKey(k, 0, 0, 0), k, 1, 1) for k in range(31)]
    plan = plan_pages(entries, 4)
    assert sorted(e.key.level for _, own, _ in plan for e in own) == list(range(31)) and len(plan) == 28


def test_a_tagged_scan_is_cancelled(spark, tmp_path):
    cloud = C.write_cloud(points(spark, 600).drop("extra_bytes"), f"{tmp_path}/cloud")

    def slow(batches):
        for b in batches:
            time.sleep(0.5)
            yield b

    stop = threading.Timer(4, lambda: cloud.cancel("stop-me"))
    began = time.time()
    try:
        rows = cloud.tagged("stop-me").points.select("idx").repartition(300).mapInArrow(slow, "idx long")
        stop.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            rows.collect()
    finally:
        stop.cancel()
        cloud.untagged("stop-me")
    assert time.time() - began < 20


def test_a_source_in_memory_is_read(spark):
    index = open_index(BytesRanges(Q._small_file()))
    assert [r for e in index.chunks(PointQuery()) for b in index.chunk(e, ["x"]) for r in b.column("x").to_pylist()] == [0, 1, 2, 3]


def test_records_are_spilled_in_batches(spark):
    spill = RecordSpill(spark, ["x", "y", "z", "red", "synthetic"], batch=4)
    for i in range(10):
        spill.append({"x": i * 0.5, "y": 0.0, "z": 1.0, "red": i, "synthetic": i % 2 == 0})
    got = spill.finish().orderBy("idx").collect()
    assert [(r["idx"], r["x"], r["red"], r["synthetic"]) for r in got] == [(i, i * 0.5, i, i % 2 == 0) for i in range(10)]
    with pytest.raises(InvalidInput):
        spill.append({"x": 0.0})
    spill.drop()
    assert spill_records(spark, [], ["x", "y", "z"]).count() == 0
    with pytest.raises(InvalidInput):
        RecordSpill(spark, ["x"])


def test_filters_reach_the_index(spark, tmp_path):
    """Boxes and levels that are asked for as plain filters choose the chunks that are read."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual
    from stratapoint.sources.clustered import ClusteredSource, PushedReader, convert_clustered
    from stratapoint.sources.las import read_header

    export_las(points(spark, 2000).drop("extra_bytes"), f"{tmp_path}/a.las", fmt=7, scale=(0.01,) * 3)
    path = f"{tmp_path}/a.copc.las"
    convert_clustered(spark, f"{tmp_path}/a.las", path, 100)
    assert read_header(ranges_of(path)).points == 2000
    source = ClusteredSource({"path": path})
    every = [c for part in PushedReader({"path": path}, source.schema()).partitions() for c in part.chunks]
    reader = PushedReader({"path": path}, source.schema())
    asked = [GreaterThan(("x",), 60.0), LessThanOrEqual(("y",), 30), EqualTo(("level",), 1)]
    assert list(reader.pushFilters(asked)) == asked
    some = [c for part in reader.partitions() for c in part.chunks]
    assert {c[0] for c in some} == {1} and len(some) < len(every)
    spark.dataSource.register(ClusteredSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("clustered").option("pushdown", "true").load(path)
        got = df.filter("x > 60 and y <= 30 and level = 1").select("x", "y", "z").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    want = [r for r in spark.read.format("clustered").load(path).select("x", "y", "z", "level").collect() if r["x"] > 60 and r["y"] <= 30 and r["level"] == 1]
    assert got and sorted(map(tuple, got)) == sorted((r["x"], r["y"], r["z"]) for r in want)


VLRS = [("u", 7, "d", b"abc", False), ("v", 8, "d", b"defg", True)]


def by_tasks_and_by_the_driver(monkeypatch, df, write):
    """The bytes that tasks put in their places, which never visit the driver, and those of its own way for other stores."""
    from stratapoint.sources import placed

    asked, plain = [], type(df).toLocalIterator
    monkeypatch.setattr(type(df), "toLocalIterator", lambda df, *a: asked.append(df) or plain(df, *a))
    first = write("a")
    assert not asked
    monkeypatch.setattr(placed, "shared_path", lambda *_: None)
    second = write("b")
    assert len(asked) == 1
    return first, second


def test_records_of_a_plain_file_pass_by_the_driver(spark, tmp_path, monkeypatch):
    rows = points(spark, 30_000).repartition(7, "x").drop("extra_bytes")  # several batches and partitions

    def write(name):
        export_las(rows, f"{tmp_path}/{name}.las", fmt=7, scale=(0.01,) * 3, vlrs=VLRS)
        return (tmp_path / f"{name}.las").read_bytes()

    first, second = by_tasks_and_by_the_driver(monkeypatch, rows, write)
    assert first == second
    spark.dataSource.register(LasSource)
    got = spark.read.format("las").load(f"{tmp_path}/a.las").select("idx", "x", "gps_time").orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(i, i * 37 % 101 * 1.0, i * 0.5) for i in range(30_000)]
    assert not [p.name for p in tmp_path.iterdir() if "writing" in p.name]


def test_chunks_of_a_clustered_file_pass_by_the_driver(spark, tmp_path, monkeypatch):
    rows = points(spark, 30_000).repartition(7, "x").drop("extra_bytes")
    cloud = C.write_cloud(rows, f"{tmp_path}/cloud", None, 200, C.Metadata(scale=(0.01,) * 3, vlrs=VLRS))

    def write(name):
        write_clustered(cloud, f"{tmp_path}/{name}.copc.las")
        return (tmp_path / f"{name}.copc.las").read_bytes()

    first, second = by_tasks_and_by_the_driver(monkeypatch, rows, write)
    assert first == second
    names = ["x", "y", "gps_time", "level", "kx", "ky", "kz"]
    got = read_clustered(spark, f"{tmp_path}/a.copc.las").select(*names).collect()
    assert len(got) == 30_000 and sorted(map(tuple, got)) == sorted(map(tuple, cloud.points.select(*names).collect()))


def test_first_points_need_no_file(spark, monkeypatch):
    """The points and hints of the native cloud don't wait for the clustered file."""
    from stratapoint.sources import clustered

    monkeypatch.setattr(clustered, "write_clustered", lambda *_, **__: pytest.fail("a file was written"))
    monkeypatch.setattr(Q, "_written", {})
    got = Q.cloud_first_points(spark, "/root/testdata/sf0.001").collect()
    assert [r["place"] for r in got] == list(range(1, 101)) and Q.size_hints(spark, "/root/testdata/sf0.001").count() == 1


def test_rows_are_fed_to_spills_in_tasks(spark, monkeypatch):
    """Each task feeds its range record by record; no row visits the driver."""
    rows = points(spark, 5000).repartition(5, "x")
    monkeypatch.setattr(type(rows), "toLocalIterator", lambda *_: pytest.fail("rows went to the driver"))
    got = spill_rows(rows.withColumn("idx", F.col("idx") * 3 + 7), "idx", ["x", "y", "z", "intensity"], 300).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(i, i * 37 % 101 * 1.0, i * 53 % 97 * 1.0, i * 71 % 89 * 1.0, i % 7) for i in range(5000)]
    assert spill_rows(rows.filter("idx < 0"), "idx", ["x", "y", "z"]).count() == 0
    own = RecordBatches(["x", "y", "z"], 2)
    assert own.append({"x": 0.0, "y": 0.0, "z": 0.0}) is None and own.append({"x": 1.0, "y": 0.0, "z": 0.0}).num_rows == 2 and own.take() is None
    with pytest.raises(InvalidInput):
        own.append({"x": 0.0})
    assert Q.record_stream(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
