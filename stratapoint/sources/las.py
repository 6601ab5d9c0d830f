"""LAS files: metadata on the driver, points by a Python data source that yields Arrow batches.

Uncompressed records of every point format are decoded with NumPy; compressed
chunks need a codec, which is looked up when they are read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import BASE_LENGTH, FORMATS, layout, schema_for_format
from ..model import Form, InvalidData, LasError, Unsupported
from .placed import write_placed
from .ranges import ranges_of

HEADER = 375  # fixed value: bytes of a version 1.4 header
MOST_RECORDS = 4096  # fixed value: VLRs or EVLRs of a file
VLR, EVLR = Form("<2x16sHH32s"), Form("<2x16sHQ32s")


def text_of(raw: bytes) -> str:
    """A fixed-width string up to its first NUL; what isn't UTF-8 is empty."""
    try:
        return raw.split(b"\0", 1)[0].decode("utf-8")
    except UnicodeDecodeError:
        return ""


def padded(text: str, n: int) -> bytes:
    return text.encode()[:n].ljust(n, b"\0")


@dataclass(frozen=True)
class Record:
    """A variable-length record; data is read on demand."""

    user_id: str
    record_id: int
    description: str
    at: int
    size: int
    extended: bool


@dataclass
class Header:
    version: tuple[int, int]
    point_format: int
    compressed: bool
    record_length: int
    points: int
    points_at: int
    header_size: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    file_source_id: int = 0
    encoding: int = 0
    guid: bytes = b"\0" * 16
    system_identifier: str = ""
    generating_software: str = ""
    created: tuple[int, int] = (0, 0)  # day of the year, year
    vlr_count: int = 0
    evlr_at: int = 0
    evlr_count: int = 0
    returns: tuple[int, ...] = (0,) * 15
    records: list[Record] = field(default_factory=list)

    @property
    def extra(self) -> int:
        return self.record_length - BASE_LENGTH[self.point_format]


def parse_header(raw: bytes, length: int) -> Header:
    if len(raw) < 227 or raw[:4] != b"LASF":
        raise InvalidData("not a LAS file: signature or size")
    source, encoding = struct.unpack_from("<HH", raw, 4)
    version = tuple(raw[24:26])
    day, year, size, points_at, vlrs, fmt, width, legacy = struct.unpack_from("<HHHIIBHI", raw, 90)
    if size > length or points_at > length or points_at < size:
        raise InvalidData("header offsets lie outside the file")
    doubles = struct.unpack_from("<12d", raw, 131)
    out = Header(version, fmt & 0x3F, bool(fmt & 0x80), width, legacy, points_at, size, doubles[:3], doubles[3:6], tuple(doubles[7:12:2]), tuple(doubles[6:12:2]),
        source, encoding, raw[8:24], text_of(raw[26:58]), text_of(raw[58:90]), (day, year), vlrs)
    out.returns = (*struct.unpack_from("<5I", raw, 111), *(0,) * 10)
    if version >= (1, 4):
        if size < HEADER or len(raw) < HEADER:
            raise InvalidData(f"version 1.4 header has {size} bytes, expected {HEADER}")
        out.evlr_at, out.evlr_count, out.points = struct.unpack_from("<QIQ", raw, 235)
        out.returns = struct.unpack_from("<15Q", raw, 255)
    if out.point_format not in FORMATS:
        raise LasError(f"point format {out.point_format} is not known")
    if out.extra < 0:
        raise InvalidData(f"record length {width} is below the {BASE_LENGTH[out.point_format]} bytes of format {out.point_format}")
    if vlrs > MOST_RECORDS or out.evlr_count > MOST_RECORDS:
        raise InvalidData(f"more than {MOST_RECORDS} records")
    return out


def walk_records(source, h: Header, length: int, extended: bool) -> list[Record]:
    at, n, form, last = (h.evlr_at, h.evlr_count, EVLR, length) if extended else (h.header_size, h.vlr_count, VLR, h.points_at)
    out = []
    for _ in range(n):
        if at + form.size > last:
            raise InvalidData(f"record header at {at} exceeds file length {last}")
        user, number, size, text = form.unpack_from(source.read(at, form.size))
        at += form.size
        if at + size > last:
            raise InvalidData(f"record of {size} bytes at {at} exceeds file length {last}")
        out.append(Record(text_of(user), number, text_of(text), at, size, extended))
        at += size
    return out


def read_header(source) -> Header:
    length = source.size()
    h = parse_header(source.read(0, min(HEADER, length)), length)
    h.records = walk_records(source, h, length, False) + (walk_records(source, h, length, True) if h.evlr_count else [])
    return h


def record_dtype(fmt: int, extra: int) -> np.dtype:
    has = FORMATS[fmt]
    f = [("ix", "<i4"), ("iy", "<i4"), ("iz", "<i4"), ("intensity", "<u2"), ("b14", "u1"), ("b15", "u1")]
    f += [("classification", "u1"), ("user_data", "u1"), ("angle", "<i2"), ("point_source_id", "<u2")] if fmt >= 6 else [("angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
    f += [("gps_time", "<f8")] * ("g" in has) + [(c, "<u2") for c in ("red", "green", "blue")] * ("c" in has) + [("nir", "<u2")] * ("n" in has)
    f += [("wave_packet_index", "u1"), ("wave_packet_offset", "<u8"), ("wave_packet_size", "<u4"), ("wave_return_location", "<f4"), ("wave_xyz", "V12")] * ("w" in has)
    return np.dtype(f + [("extra_bytes", f"V{extra}")] * bool(extra))


def decode(raw: bytes, fmt: int, extra: int, scale, offset, names: list[str]) -> dict[str, pa.Array]:
    """Columns of packed records; only those asked for are made."""
    r = np.frombuffer(raw, record_dtype(fmt, extra))
    a, b, new = r["b14"], r["b15"], fmt >= 6
    made = {
        "return_number": lambda: a & (15 if new else 7), "number_of_returns": lambda: a >> 4 if new else a >> 3 & 7,
        "scan_direction_flag": lambda: (b if new else a) >> 6 & 1 == 1, "edge_of_flight_line": lambda: (b if new else a) >> 7 == 1,
        "classification": lambda: np.where(r["classification"] == 12, 1, r["classification"]) if new else np.where(b & 31 == 12, 1, b & 31),
        "synthetic": lambda: (b & 1 if new else b >> 5 & 1) == 1, "key_point": lambda: (b >> 1 & 1 if new else b >> 6 & 1) == 1, "withheld": lambda: (b >> 2 & 1 if new else b >> 7) == 1,
        "overlap": lambda: b >> 3 & 1 == 1 if new else b & 31 == 12, "scan_channel": lambda: b >> 4 & 3 if new else np.zeros(len(r), np.uint8),
        "scan_angle": lambda: r["angle"].astype(np.float32) * np.float32(0.006) if new else r["angle"].astype(np.float32),
    }
    out = {}
    for i, axis in enumerate("xyz"):
        if axis in names:
            out[axis] = pa.array(r[f"i{axis}"] * scale[i] + offset[i])
    for n in names:
        if n in out:
            continue
        if n == "extra_bytes":
            out[n] = pa.array([bytes(v) for v in r["extra_bytes"].tolist()], pa.binary())
            continue
        v = made[n]() if n in made else r[n]
        kind = {"bool": pa.bool_(), "float32": pa.float32(), "float64": pa.float64()}.get(v.dtype.name)
        if kind is None:
            kind = pa.int16() if n in ("return_number", "number_of_returns", "classification", "user_data", "scan_channel", "wave_packet_index") else pa.int64() if n == "wave_packet_size" else pa.int32()
        out[n] = pa.array([int(x) for x in v], pa.decimal128(20, 0)) if n == "wave_packet_offset" else pa.array(v.astype(kind.to_pandas_dtype()), kind)
    return out


def nearest(v: np.ndarray) -> np.ndarray:
    """The nearest whole number, halves away from zero; what isn't finite stays so."""
    whole = np.trunc(v)
    return whole + np.sign(v) * (np.abs(v - whole) >= 0.5)


def encode(rows: dict[str, np.ndarray], fmt: int, extra: int, scale, offset) -> bytes:
    """Packed records of an extended format from columns of numbers."""
    n = len(rows["x"])
    r = np.zeros(n, record_dtype(fmt, extra))
    get = lambda k: np.asarray(rows[k]) if k in rows else np.zeros(n, np.int64)
    for i, a in enumerate("xyz"):
        steps = nearest((np.asarray(rows[a], float) - offset[i]) / scale[i])
        if not ((steps >= -(2**31)) & (steps <= 2**31 - 1)).all():
            raise InvalidData(f"{a} is outside LAS i32 range")
        r[f"i{a}"] = steps
    r["b14"] = get("return_number").astype(int) & 15 | (get("number_of_returns").astype(int) & 15) << 4
    flags = (get("scan_channel").astype(int) & 3) << 4
    for bit, k in ((0, "synthetic"), (1, "key_point"), (2, "withheld"), (3, "overlap"), (6, "scan_direction_flag"), (7, "edge_of_flight_line")):
        flags |= get(k).astype(int) << bit
    angle = nearest((get("scan_angle").astype(np.float32).astype(float) / float(np.float32(0.006))).astype(np.float32))
    if not ((angle >= -32768) & (angle <= 32767)).all():
        raise InvalidData("scan_angle must be finite and fit 16 bits")
    r["b15"], r["angle"] = flags, angle
    for k in ("intensity", "classification", "user_data", "point_source_id", "gps_time", "red", "green", "blue", "nir"):
        if k in r.dtype.names:
            r[k] = get(k)
    if extra:
        r["extra_bytes"] = np.frombuffer(b"".join(rows["extra_bytes"]), f"V{extra}")
    return r.tobytes()


def header_bytes(h: Header) -> bytes:
    """A version 1.4 header; the legacy counts are 0."""
    corner = [v for lo, hi in zip(h.low, h.high) for v in (hi, lo)]
    raw = struct.pack("<4sHH16sBB32s32sHHHIIBHI20s", b"LASF", h.file_source_id, h.encoding, h.guid, 1, 4, padded(h.system_identifier, 32), padded(h.generating_software, 32), *h.created, HEADER, h.points_at, h.vlr_count, h.point_format | 0x80 * h.compressed, h.record_length, 0, b"")
    return raw + struct.pack("<12d", *h.scale, *h.offset, *corner) + struct.pack("<QQIQ", 0, h.evlr_at, h.evlr_count, h.points) + struct.pack("<15Q", *h.returns)


def write_las(path: str, rows: dict[str, np.ndarray], fmt: int = 6, scale=(0.001,) * 3, offset=(0.0,) * 3, extra: int = 0, vlrs: list[tuple] = (), made: date | None = None, guid: uuid.UUID | None = None) -> None:
    """A version 1.4 file from driver-side columns: an exporter for what fits one machine."""
    body = encode(rows, fmt, extra, scale, offset)
    head = [v for v in vlrs if not v[4]]
    tail = [v for v in vlrs if v[4]]
    records = b"".join(VLR.pack(padded(u, 16), i, len(d), padded(t, 32)) + d for u, i, t, d, _ in head)
    at, n, day = HEADER + len(records), len(rows["x"]), made or date(2024, 1, 1)
    counts = np.bincount(np.asarray(rows.get("return_number", np.zeros(n)), int), minlength=16)[1:16]
    corner = [f(np.asarray(rows[a], float)) for f in (np.min, np.max) for a in "xyz"]
    raw = header_bytes(Header((1, 4), fmt, False, BASE_LENGTH[fmt] + extra, n, at, HEADER, tuple(scale), tuple(offset), tuple(corner[:3]), tuple(corner[3:]), 0, 16,
        (guid or uuid.UUID(int=0)).bytes_le, "stratapoint", "stratapoint", (day.timetuple().tm_yday, day.year), len(head), at + len(body) if tail else 0, len(tail), tuple(map(int, counts))))
    with open(path, "wb") as f:
        f.write(raw + records + body)
        for u, i, t, d, _ in tail:
            f.write(EVLR.pack(padded(u, 16), i, len(d), padded(t, 32)) + d)


def _packed(fmt: int, extra: int, scale, offset, ordinal: str):
    """Sorted rows as packed records, one row a batch, named by its partition and its place there in bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                cols = {c: (batch.column(c).to_pylist() if c == "extra_bytes" else batch.column(c).to_numpy(zero_copy_only=False)) for c in batch.schema.names if c != ordinal}
                body = encode(cols, fmt, extra, scale, offset)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(body)], pa.int64()), pa.array([body], pa.binary())], names=["part", "at", "size", "body"])
                at += len(body)

    return pack


def export_las(points: DataFrame, path: str, fmt: int = 6, scale=(0.001,) * 3, offset=(0.0,) * 3, extra: int = 0, vlrs: list[tuple] = (), ordinal: str = "idx") -> None:
    """Points as an uncompressed version 1.4 file in the order of ``ordinal``.

    Records are made in tasks, kept in the shared folder and put in their places by tasks (``placed.py``);
    the driver knows only how many bytes each partition has.
    """
    from ..operators.scratch import Scratch

    spark = points.sparkSession
    has = "return_number" in points.columns
    row = points.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))], *([F.count(F.when(F.col("return_number") == k, 1)).alias(f"r{k}") for k in range(1, 16)] if has else [])).first()
    if not row["n"]:
        raise InvalidData("cannot write empty file")
    own = [c for c in points.columns if c == ordinal or c in layout(fmt, extra)]
    sorted_rows = points.select(*own).repartitionByRange(F.col(ordinal)).sortWithinPartitions(ordinal)
    body = Scratch(spark, "las").save(sorted_rows.mapInArrow(_packed(fmt, extra, scale, offset, ordinal), "part int, at long, size long, body binary"))
    starts, length = {}, 0
    for r in body.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect():
        starts[r["part"]] = length
        length += r["size"]
    head, tail = [v for v in vlrs if not v[4]], [v for v in vlrs if v[4]]
    records = b"".join(VLR.pack(padded(u, 16), i, len(d), padded(t, 32)) + d for u, i, t, d, _ in head)
    width, at = BASE_LENGTH[fmt] + extra, HEADER + len(records)
    if length != row["n"] * width:
        raise InvalidData(f"{length} bytes of records were made for {row['n']} points")
    h = Header((1, 4), fmt, False, width, row["n"], at, HEADER, tuple(scale), tuple(offset), tuple(row[f"lo{a}"] for a in "xyz"), tuple(row[f"hi{a}"] for a in "xyz"), 0, 16, bytes(16), "stratapoint", "stratapoint", (1, 2024),
        len(head), at + length if tail else 0, len(tail), tuple(row[f"r{k}"] for k in range(1, 16)) if has else (0,) * 15)
    behind = b"".join(EVLR.pack(padded(u, 16), i, len(d), padded(t, 32)) + d for u, i, t, d, _ in tail)
    write_placed(spark, path, header_bytes(h) + records, body, starts, length, behind, replace=True)


@dataclass
class Span(InputPartition):
    first: int
    count: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.rows = int(options.get("rowsPerPartition", "1000000"))
        self.header = read_header(ranges_of(self.path))
        if self.header.compressed:
            raise Unsupported("compressed points need a LAZ codec, which is not installed")

    def partitions(self) -> list[Span]:
        n = self.header.points
        return [Span(i, min(self.rows, n - i)) for i in range(0, n, self.rows)] or [Span(0, 0)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        h, source, names = self.header, ranges_of(self.path), self.schema.names
        for i in range(part.first, part.first + part.count, 65536):
            n = min(65536, part.first + part.count - i)
            cols = decode(source.read(h.points_at + i * h.record_length, n * h.record_length), h.point_format, h.extra, h.scale, h.offset, [c for c in names if c != "idx"])
            if "idx" in names:
                cols["idx"] = pa.array(np.arange(i, i + n))
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)


class LasSource(DataSource):
    """``spark.read.format("las").load(path)``: idx and the format's dimensions; a narrower schema reads only its columns."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> T.StructType:
        h = read_header(ranges_of(self.options["path"]))
        return T.StructType([T.StructField("idx", T.LongType())] + schema_for_format(h.point_format, h.extra).fields)

    def reader(self, schema: T.StructType) -> LasReader:
        return LasReader(self.options, schema)


def convert_las(spark: SparkSession, las: str, path: str, max_points_per_node: int = 100_000, crs_wkt: str | None = None):
    """A LAS file as a native cloud, with its transform, ids, date and records."""
    from ..plans.cloud import Metadata, write_cloud

    source = ranges_of(las)
    h = read_header(source)
    if {"n", "w"} & set(FORMATS[h.point_format]):
        raise Unsupported("cannot preserve nir or waveform dimensions")
    spark.dataSource.register(LasSource)
    records = [(r.user_id, r.record_id, r.description, source.read(r.at, r.size), r.extended) for r in h.records]
    meta = Metadata(h.scale, h.offset, crs_wkt, h.file_source_id, str(uuid.UUID(bytes_le=h.guid)), h.system_identifier, h.generating_software, f"{h.created[1]}-{h.created[0]:03d}", bool(h.encoding & 1), records, h.encoding)
    points: DataFrame = spark.read.format("las").load(las)
    return write_cloud(points, path, None, max_points_per_node, meta, h.extra)


def dimensions_of(h: Header) -> list[str]:
    return layout(h.point_format, h.extra)
