"""Native clouds: Parquet points partitioned by level and sorted by node, with their index and file information."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import angle_degrees, angle_steps, class_read, dequantize, quantize
from ..functions.schema import DIMENSIONS, check_schema, projected
from ..model import Bounds, Info, InvalidInput, PointQuery, Unsupported
from ..operators.hierarchy import nodes_of, page_roots
from ..operators.lod import KEY, assign_lod
from ..operators.predicates import in_box, in_levels, node_meets, selected_nodes
from ..operators.stats import validate

COLOUR = ("red", "green", "blue")
WKT_BIT, CARRIED_BITS = 1 << 4, 1 << 3  # fixed values: bits of the global encoding
WRITTEN = [d for d in DIMENSIONS if d not in ("nir", "wave_packet_index", "wave_packet_offset", "wave_packet_size", "wave_return_location")]


@dataclass
class Metadata:
    """What a cloud carries beside its points; None for scale and offset means 0.001 and the minimum corner."""

    scale: tuple[float, float, float] | None = None
    offset: tuple[float, float, float] | None = None
    crs_wkt: str | None = None
    file_source_id: int = 0
    guid: str = "00000000-0000-0000-0000-000000000000"
    system_identifier: str = "stratapoint"
    generating_software: str = "stratapoint"
    created: str | None = None
    gps_standard_time: bool = False
    vlrs: list[tuple[str, int, str, bytes, bool]] = field(default_factory=list)  # user, record, description, data, extended
    encoding: int = 0  # global encoding of the header that the points came from

    @property
    def global_encoding(self) -> int:
        """Time base, and what is carried of a source header: bit 3 (synthetic return numbers); bit 4 says that the reference system is WKT."""
        return int(self.gps_standard_time) | self.encoding & CARRIED_BITS | WKT_BIT


def carried(vlrs: list[tuple[str, int, str, bytes, bool]], crs_wkt: str | None) -> list[tuple[str, int, str, bytes, bool]]:
    """Records that go on with a cloud: those the writer makes itself are left out; GeoTIFF needs a WKT record or override."""
    geo = [v for v in vlrs if v[0] == "LASF_Projection" and v[1] in (34735, 34736, 34737)]
    wkt = [v for v in vlrs if v[0] == "LASF_Projection" and v[1] == 2112]
    text = crs_wkt.strip("\0 \t\r\n") if crs_wkt else ""
    if geo and not wkt and not text:
        raise Unsupported("GeoTIFF-to-WKT CRS conversion is not supported; give crs_wkt")
    own = {("copc", 1), ("copc", 1000), ("laszip encoded", 22204)}
    rest = [v for v in vlrs if (v[0], v[1]) not in own and v not in geo and v not in wkt]
    made = wkt or ([("LASF_Projection", 2112, "", text.encode() + b"\0", False)] if text else [])
    return made + rest


def normalized(df: DataFrame) -> DataFrame:
    """Any DataFrame with x, y, z as write rows: what is missing is 0 or false, colour is all or nothing."""
    check_schema(df.select(*[c for c in df.columns if c in DIMENSIONS]).schema)
    if missing := [a for a in "xyz" if a not in df.columns]:
        raise InvalidInput(f"columns {', '.join(missing)} are required")
    if lost := [c for c in DIMENSIONS if c in df.columns and c not in WRITTEN]:
        raise Unsupported(f"cannot preserve {', '.join(lost)}")
    has = [c for c in COLOUR if c in df.columns]
    if has and len(has) < 3:
        raise InvalidInput("red, green and blue must be supplied together")
    skip = set(COLOUR) - set(has) | ({"extra_bytes"} - set(df.columns))
    cols = []
    for d in WRITTEN:
        if d in skip:
            continue
        none = F.lit(0 if d not in ("synthetic", "key_point", "withheld", "overlap", "scan_direction_flag", "edge_of_flight_line") else False)
        cols.append(F.coalesce(F.col(d), none.cast(df.schema[d].dataType)).alias(d) if d in df.columns and d != "extra_bytes" else F.col(d) if d in df.columns else none.cast(DIMENSIONS[d]).alias(d))
    return df.select("idx", *cols)


def write_cloud(df: DataFrame, path: str, bounds: Bounds | None = None, max_points_per_node: int = 100_000, metadata: Metadata | None = None, extra: int = 0) -> Cloud:
    """Validate, assign, quantize and write; the cloud appears under its name only when it is whole.

    ``df`` holds x, y, z, any other dimensions and a distinct ordinal ``idx``.
    """
    spark, meta = df.sparkSession, metadata or Metadata()
    records = carried(meta.vlrs, meta.crs_wkt)
    points = normalized(df)
    first = points.agg(*[f(F.when(~F.isnan(a), F.col(a))).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"]).first()
    if first["lox"] is None:
        raise InvalidInput("cannot write empty cloud")
    box = bounds or Bounds(tuple(first[f"lo{a}"] for a in "xyz"), tuple(first[f"hi{a}"] for a in "xyz"))
    scale, offset = meta.scale or (0.001,) * 3, meta.offset or box.min
    seen = validate(points, box, scale, offset, extra)
    keyed = assign_lod(points, box, max_points_per_node)
    stored = {a: dequantize(quantize(F.col(a), s, o), s, o) for a, s, o in zip("xyz", scale, offset)}
    stored |= {"scan_angle": angle_degrees(angle_steps(F.col("scan_angle"))), "classification": class_read(F.col("classification")).cast("short")}
    keyed = keyed.withColumns(stored)
    temp = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        keyed.repartitionByRange(*KEY, "pos").sortWithinPartitions(*KEY, "pos").write.partitionBy("level").parquet(f"{temp}/points")
        record = 36 if "red" in points.columns else 30
        hierarchy = nodes_of(spark.read.parquet(f"{temp}/points"), record + extra, 375)
        hierarchy.coalesce(1).write.parquet(f"{temp}/hierarchy")
        center, half = box.root_cube()
        spark.createDataFrame([(*center, half, half / 128, float(seen["gps_min"]), float(seen["gps_max"]), *box.min, *box.max, *scale, *offset, int(seen["n"]), [int(seen[f"return_{k}"]) for k in range(1, 16)], meta.file_source_id, meta.guid, meta.system_identifier, meta.generating_software, meta.created, meta.gps_standard_time, meta.global_encoding)],
            "cx double, cy double, cz double, halfsize double, spacing double, gps_min double, gps_max double, minx double, miny double, minz double, maxx double, maxy double, maxz double, sx double, sy double, sz double, ox double, oy double, oz double, points long, returns array<long>, file_source_id int, guid string, system_identifier string, generating_software string, created string, gps_standard_time boolean, global_encoding int").coalesce(1).write.parquet(f"{temp}/info")
        spark.createDataFrame([(i, *v) for i, v in enumerate(records)], "seq int, user_id string, record_id int, description string, data binary, is_extended boolean").coalesce(1).write.parquet(f"{temp}/vlrs")
        if fs.exists(fs_path(path)) or not fs.rename(fs_path(temp), fs_path(path)):
            raise InvalidInput(f"{path} exists or cannot be written")
    except BaseException:
        fs.delete(fs_path(temp), True)
        raise
    return Cloud.open(spark, path)


@dataclass
class Cloud:
    spark: SparkSession
    points: DataFrame
    hierarchy: DataFrame
    info: Info
    header: dict
    vlrs: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Cloud:
        read = lambda n: spark.read.parquet(f"{path}/{n}")
        h = read("info").first().asDict()
        info = Info((h["cx"], h["cy"], h["cz"]), h["halfsize"], h["spacing"], 0, 0, h["gps_min"], h["gps_max"])
        return cls(spark, read("points"), read("hierarchy"), info, h, read("vlrs").orderBy("seq"))

    def query(self, q: PointQuery = PointQuery(), columns: list[str] | None = None) -> DataFrame:
        """Points of the selected nodes inside the box; an empty selection keeps the row count."""
        rows = self.points.filter(in_levels(q, self.info.spacing) & node_meets(q.bounds, self.info.center, self.info.halfsize) & in_box(q.bounds))
        return rows.select(*projected(self.points.columns, columns))

    def ordered(self, q: PointQuery = PointQuery()) -> DataFrame:
        """The same points in stored order."""
        rows = self.points.filter(in_levels(q, self.info.spacing) & node_meets(q.bounds, self.info.center, self.info.halfsize) & in_box(q.bounds))
        return rows.orderBy(*KEY, "pos")

    def nodes(self, q: PointQuery = PointQuery()) -> DataFrame:
        return selected_nodes(self.hierarchy, q, self.info.center, self.info.halfsize, self.info.spacing)

    def size_hint(self, q: PointQuery = PointQuery()) -> tuple[int, int]:
        """Least and most rows of a query, from the index alone; equal without a box."""
        n = self.nodes(q).agg(F.sum("point_count")).first()[0] or 0
        return (0 if q.bounds else n), n

    def pages(self, limit: int = 4096) -> DataFrame:
        return page_roots(self.hierarchy, limit)

    def tagged(self, tag: str) -> Cloud:
        """Jobs that this thread runs from here on carry the tag, by which any thread can cancel them."""
        self.spark.sparkContext.addJobTag(tag)
        return self

    def cancel(self, tag: str) -> None:
        """End all running jobs of the tag: their action raises."""
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def untagged(self, tag: str) -> Cloud:
        self.spark.sparkContext.removeJobTag(tag)
        return self
