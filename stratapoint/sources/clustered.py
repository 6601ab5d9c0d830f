"""Clustered-octree LAS files: eager and lazy metadata, query planning, points, and the writer.

Only pages that a query may reach are fetched by the lazy reader; chunks are read
in coalesced ranges, in tasks, by the data source ``clustered``. How chunks are stored is
a matter of ``chunks.py``. The writer encodes nodes in tasks, which put them into one file.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.schema import BASE_LENGTH, schema_for_format
from ..model import ENTRY, INFO, Bounds, Entry, Info, InvalidData, InvalidInput, Lod, PointQuery, Unsupported, VoxelKey, unpack_page
from ..operators.hierarchy import GAP, PAGE_ENTRIES, plan_pages
from ..operators.lod import KEY
from ..operators.scratch import Scratch
from .chunks import PLAIN, Compression, chunk_table, codec
from .las import EVLR, HEADER, VLR, Header, decode, encode, header_bytes, padded, read_header, record_dtype
from .placed import write_placed
from .ranges import ranges_of

PAGE_BYTES, ALL_BYTES = 64 << 20, 256 << 20  # fixed values: bytes of one page and of all
RECORD_BYTES = 64 << 20  # fixed value: bytes of the record section that the lazy reader takes
HIERARCHY_SCHEMA = 'level int, kx int, ky int, kz int, `offset` long, byte_size int, point_count int'


@dataclass
class Index:
    """The node index of one file; pages are loaded by a work list, each at most once."""

    source: object
    header: Header
    info: Info
    entries: dict[VoxelKey, Entry] = field(default_factory=dict)
    loaded: set[tuple[int, int]] = field(default_factory=set)
    bytes_read: int = 0
    compression: Compression = Compression(PLAIN, ())
    points_seen: int = 0

    def load(self, at: int, size: int) -> None:
        if (at, size) in self.loaded:
            return
        if size <= 0 or size % ENTRY.size or size > PAGE_BYTES:
            raise InvalidData(f"hierarchy page of {size} bytes is not valid")
        self.bytes_read += size
        if self.bytes_read > ALL_BYTES:
            raise InvalidData("hierarchy pages exceed their total limit")
        if at + size > self.source.size():
            raise InvalidData(f"hierarchy page at {at} exceeds file length")
        for e in unpack_page(self.source.read(at, size)):
            e.kind  # noqa: B018  a count below -1 raises
            have = self.entries.get(e.key)
            if e.kind != "page" or have is None or have.kind == "page":
                self.points_seen += max(e.point_count, 0) - max(have.point_count if have else 0, 0)
                self.entries[e.key] = e
        self.loaded.add((at, size))
        if self.points_seen > self.header.points:
            raise InvalidData(f"hierarchy point total {self.points_seen} exceeds the header's {self.header.points}")

    def fetch(self, q: PointQuery | None = None) -> None:
        """Load pages until none that the query may reach is missing; without a query, all."""
        levels = q.lod.levels(self.info.spacing) if q else None
        while True:
            todo = [e for e in self.entries.values() if e.kind == "page" and (e.offset, e.byte_size) not in self.loaded and (q is None or self._reaches(e.key, q.bounds, levels[1]))]
            if not todo:
                return
            for e in todo:
                self.load(e.offset, e.byte_size)

    def _reaches(self, k: VoxelKey, box: Bounds | None, high: int) -> bool:
        if min(k.level, k.x, k.y, k.z) < 0:
            return True
        return k.level < high and (box is None or k.bounds(self.info.center, self.info.halfsize).intersects(box))

    def chunks(self, q: PointQuery) -> list[Entry]:
        """The entries a query reads, by offset and key."""
        self.fetch(q)
        low, high = q.lod.levels(self.info.spacing)
        out, length = [], self.source.size()
        for e in self.entries.values():
            if e.kind != "points":
                continue
            if e.byte_size <= 0:
                raise InvalidData(f"chunk {e.key} has {e.byte_size} bytes")
            if e.offset + e.byte_size > length:
                raise InvalidData(f"chunk {e.key} at {e.offset} exceeds file length {length}")
            if low <= e.key.level < high and (q.bounds is None or e.key.bounds(self.info.center, self.info.halfsize).intersects(q.bounds)):
                out.append(e)
        return sorted(out, key=lambda e: (e.offset, e.key))

    def reads(self, q: PointQuery, gap: int = GAP) -> list[tuple[int, int, list[Entry]]]:
        """(start, end, chunks): chunks at most gap bytes apart in one range."""
        out: list[tuple[int, int, list[Entry]]] = []
        for e in self.chunks(q):
            if out and e.offset <= out[-1][1] + gap:
                out[-1] = (out[-1][0], max(out[-1][1], e.offset + e.byte_size), [*out[-1][2], e])
            else:
                out.append((e.offset, e.offset + e.byte_size, [e]))
        return out

    def frame(self, spark: SparkSession, q: PointQuery | None = None) -> DataFrame:
        """The loaded index as a DataFrame, in key order."""
        self.fetch(q)
        rows = [(e.key.level, e.key.x, e.key.y, e.key.z, e.offset, e.byte_size, e.point_count) for e in sorted(self.entries.values(), key=lambda e: e.key)]
        return spark.createDataFrame(rows, HIERARCHY_SCHEMA)

    def chunk(self, e: Entry, names: list[str] | None = None, step: int = 65536) -> Iterator[pa.RecordBatch]:
        """One chunk's points as record batches of at most ``step`` rows; only the named dimensions are made."""
        return chunk_batches(self.source.read(e.offset, e.byte_size), e, self.header, self.compression, names or schema_for_format(self.header.point_format, self.header.extra).names, None, step)


def chunk_batches(raw: bytes, e: Entry, h: Header, how: Compression, names: list[str], box: Bounds | None, step: int = 65536) -> Iterator[pa.RecordBatch]:
    """Points of a stored chunk inside the box; ``level``, ``kx``, ``ky`` and ``kz`` may be named beside dimensions."""
    packed = codec(how.compressor)(raw, e.point_count, h.record_length)
    node = dict(zip(KEY, (e.key.level, e.key.x, e.key.y, e.key.z)))
    for first in range(0, e.point_count, step):
        n = min(step, e.point_count - first)
        piece = packed[first * h.record_length : (first + n) * h.record_length]
        if box is not None:
            r = np.frombuffer(piece, record_dtype(h.point_format, h.extra))
            at = [r[f"i{a}"] * h.scale[i] + h.offset[i] for i, a in enumerate("xyz")]
            inside = np.logical_and.reduce([(v >= lo) & (v <= hi) for v, lo, hi in zip(at, box.min, box.max)])
            piece, n = r[inside].tobytes(), int(inside.sum())
        cols = decode(piece, h.point_format, h.extra, h.scale, h.offset, [c for c in names if c not in node])
        cols |= {k: pa.array(np.full(n, v, np.int32)) for k, v in node.items() if k in names}
        yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names) if names else pa.RecordBatch.from_struct_array(pa.array([{}] * n, pa.struct([])))


def open_index(source, eager: bool = True) -> Index:
    """Header, info and root page; all pages and the record checks when eager."""
    h = read_header(source)
    if not eager and h.points_at - h.header_size > RECORD_BYTES:
        raise InvalidData(f"record section of {h.points_at - h.header_size} bytes exceeds {RECORD_BYTES}")
    if h.point_format < 6:
        raise Unsupported(f"column reads need an extended point format, not {h.point_format}")
    found = {(r.user_id, r.record_id): r for r in h.records}
    info = found.get(("copc", 1))
    if info is None or ("laszip encoded", 22204) not in found:
        raise InvalidData("the info or the compression record is missing")
    packing = found["laszip encoded", 22204]
    how = Compression.unpack(source.read(packing.at, packing.size)).check(h.record_length)
    index = Index(source, h, Info.unpack(source.read(info.at, info.size)), compression=how)
    if eager:
        pages = found.get(("copc", 1000))
        if pages is None or pages.at != index.info.root_offset:
            raise InvalidData("the info's root offset is not where the hierarchy record begins")
    index.load(index.info.root_offset, index.info.root_size)
    if eager:
        index.fetch()
    return index


def page_bytes(entries: list[Entry], at: int, limit: int = PAGE_ENTRIES) -> tuple[bytes, int]:
    """The hierarchy of a file that begins at ``at``: pages in plan order with pointers to those below, and the root page's size."""
    plan = plan_pages(entries, limit)
    place, where = at, {}
    for root, own, below in plan:
        where[root] = (place, ENTRY.size * (len(own) + len(below)))
        place += where[root][1]
    out = b"".join(b"".join(e.pack() for e in own) + b"".join(Entry(k, *where[k], -1).pack() for k in below) for _, own, below in plan)
    return out, where[plan[0][0]][1]


def _query_options(q: PointQuery) -> dict[str, str]:
    return {"query": json.dumps({"lod": [q.lod.how, q.lod.low, q.lod.high, q.lod.resolution], "box": [*q.bounds.min, *q.bounds.max] if q.bounds else None})}


def _query_of(options: dict) -> PointQuery:
    got = json.loads(options.get("query", "null"))
    if not got:
        return PointQuery()
    how, low, high, resolution = got["lod"]
    box = got["box"]
    return PointQuery(Lod(how, low, high, resolution), Bounds(tuple(box[:3]), tuple(box[3:])) if box else None)


@dataclass
class Reads(InputPartition):
    """One range and the chunks in it."""

    first: int
    end: int
    chunks: tuple[tuple[int, int, int, int, int, int, int], ...]


class ClusteredReader(DataSourceReader):
    """The index is read on the driver; each task reads one coalesced range and decodes its chunks."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.names, self.query = options["path"], schema.names, _query_of(options)
        self.most, self.gap = int(options.get("rangeBytes", str(64 << 20))), int(options.get("gapBytes", str(GAP)))
        index = open_index(ranges_of(self.path), eager=False)
        codec(index.compression.compressor)
        self.header, self.compression = replace(index.header, records=[]), index.compression

    def _cut(self, one: tuple[int, int, list[Entry]]) -> Iterator[Reads]:
        own: list[Entry] = []
        for e in one[2]:
            if own and e.offset + e.byte_size - own[0].offset > self.most:
                yield self._reads(own)
                own = []
            own.append(e)
        yield self._reads(own)

    def _reads(self, es: list[Entry]) -> Reads:
        return Reads(min(e.offset for e in es), max(e.offset + e.byte_size for e in es), tuple((e.key.level, e.key.x, e.key.y, e.key.z, e.offset, e.byte_size, e.point_count) for e in es))

    def partitions(self) -> list[Reads]:
        index = open_index(ranges_of(self.path), eager=False)
        return [r for one in index.reads(self.query, self.gap) for r in self._cut(one)] or [Reads(0, 0, ())]

    def read(self, part: Reads) -> Iterator[pa.RecordBatch]:
        raw = ranges_of(self.path).read(part.first, part.end - part.first) if part.chunks else b""
        for *key, at, size, n in part.chunks:
            stored = raw[at - part.first : at - part.first + size]
            yield from chunk_batches(stored, Entry(VoxelKey(*key), at, size, n), self.header, self.compression, self.names, self.query.bounds)


class PushedReader(ClusteredReader):
    """Takes filters, which Spark only allows where ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of x, y and z narrow the box by which nodes and points are chosen, those of ``level`` the levels; Spark tests all of them again."""
        low, high = {a: -np.inf for a in (*"xyz", "level")}, {a: np.inf for a in (*"xyz", "level")}
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in low and f.value is not None:
                a, v = f.attribute[0], float(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low[a] = max(low[a], v)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high[a] = min(high[a], v)
        box, lod = self.query.bounds, self.query.lod
        least = [max(low[a], box.min[i]) if box else low[a] for i, a in enumerate("xyz")]
        most = [min(high[a], box.max[i]) if box else high[a] for i, a in enumerate("xyz")]
        if any(np.isfinite(v) for v in (*least, *most)):
            box = Bounds(tuple(least), tuple(most))
        if lod.how == "all" and (np.isfinite(low["level"]) or np.isfinite(high["level"])):
            first = int(max(0, np.ceil(low["level"]))) if np.isfinite(low["level"]) else 0
            lod = Lod.range(first, max(first, int(np.floor(high["level"])) + 1) if np.isfinite(high["level"]) else 2**31 - 1)
        self.query = PointQuery(lod, box)
        return iter(filters)


class ClusteredSource(DataSource):
    """``spark.read.format("clustered").load(path)``: the format's dimensions and the node's key; a narrower schema makes only its columns.

    With the option ``pushdown`` (and the session's setting for it) filters choose the chunks, beside the query in the options.
    """

    @classmethod
    def name(cls) -> str:
        return "clustered"

    def schema(self) -> T.StructType:
        h = read_header(ranges_of(self.options["path"]))
        return T.StructType(schema_for_format(h.point_format, h.extra).fields + [T.StructField(k, T.IntegerType()) for k in KEY])

    def reader(self, schema: T.StructType) -> ClusteredReader:
        kind = PushedReader if self.options.get("pushdown", "false").lower() == "true" else ClusteredReader
        return kind(self.options, schema)


def read_clustered(spark: SparkSession, path: str, q: PointQuery = PointQuery(), columns: list[str] | None = None) -> DataFrame:
    """Points of a file that a query selects; with columns, only those are decoded."""
    spark.dataSource.register(ClusteredSource)
    reader = spark.read.format("clustered").options(**_query_options(q))
    if columns is not None:
        h = read_header(ranges_of(path))
        every = {f.name: f for f in [*schema_for_format(h.point_format, h.extra).fields, *(T.StructField(k, T.IntegerType()) for k in KEY)]}
        wanted = [every[c] for c in every if c in set(columns)]
        if not wanted:
            raise InvalidInput("none of the columns is in the file")
        reader = reader.schema(T.StructType(wanted))
    return reader.load(path)


def _nodes_packed(fmt: int, extra: int, scale, offset, compressor: int):
    """Sorted points of a partition as one row a node: its stored chunk, with the partition and its place there in bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, part, at = None, [], TaskContext.get().partitionId(), 0

        def stored(key, parts) -> pa.RecordBatch:
            nonlocal at
            rows = pa.Table.from_batches(parts)
            n = rows.num_rows
            cols = {c: (rows.column(c).to_pylist() if c == "extra_bytes" else rows.column(c).to_numpy()) for c in rows.column_names if c not in KEY}
            width = BASE_LENGTH[fmt] + extra
            body = codec(compressor, packing=True)(encode(cols, fmt, extra, scale, offset), n, width)
            at += len(body)
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in (*key, part)], *[pa.array([v], pa.int64()) for v in (at - len(body), n, len(body))], pa.array([body], pa.binary())], names=[*KEY, "part", "at", "point_count", "byte_size", "body"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in KEY], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(int(v) for v in keys[a])
                if key != now and parts:
                    yield stored(now, parts)
                    parts = []
                now = key
                parts.append(batch.slice(a, b - a))
        if parts:
            yield stored(now, parts)

    return pack


def write_clustered(cloud, path: str, compressor: int = PLAIN, page_entries: int = PAGE_ENTRIES) -> None:
    """A native cloud as one clustered file: records, chunks in node order, their table, and the index's pages.

    Nodes are encoded in tasks, kept in the shared folder and put in their places by tasks (``placed.py``); the driver has
    the index, a row a node. The file appears under its name only when it is whole. Extra bytes keep their width.
    """
    spark, h = cloud.spark, cloud.header
    codec(compressor, packing=True)
    names = cloud.points.columns
    fmt = 7 if "red" in names else 6
    extra = (cloud.points.select(F.max(F.octet_length("extra_bytes"))).first()[0] or 0) if "extra_bytes" in names else 0
    scale, offset = (h["sx"], h["sy"], h["sz"]), (h["ox"], h["oy"], h["oz"])
    scratch = Scratch(spark, "clustered")
    rows = cloud.points.drop("idx").repartitionByRange(*KEY).sortWithinPartitions(*KEY, "pos").drop("pos")
    chunks = scratch.save(rows.mapInArrow(_nodes_packed(fmt, extra, scale, offset, compressor), "level int, kx int, ky int, kz int, part int, at long, point_count long, byte_size long, body binary"))
    sizes = chunks.select(*KEY, "part", "at", "point_count", "byte_size").orderBy(*KEY).collect()  # the index: a row a node
    own = Compression.of_format(compressor, fmt, extra)
    carried = [(r["user_id"], r["record_id"], r["description"], bytes(r["data"]), r["is_extended"]) for r in cloud.vlrs.collect()]
    head = [("copc", 1, "info", bytes(INFO.size), False), ("laszip encoded", 22204, "compression", own.pack(), False), *(v for v in carried if not v[4])]
    tail = [v for v in carried if v[4]]
    points_at = HEADER + sum(VLR.size + len(v[3]) for v in head)
    at, entries, starts = points_at + 8, [], {}
    for r in sizes:
        if starts.setdefault(r["part"], at - points_at - 8) + r["at"] != at - points_at - 8:
            raise InvalidData("chunks were not made in key order")
        entries.append(Entry(VoxelKey(*(r[k] for k in KEY)), at, r["byte_size"], r["point_count"]))
        at += r["byte_size"]
    table_at, table = at, chunk_table([r["byte_size"] for r in sizes], [r["point_count"] for r in sizes])
    evlr_at = table_at + len(table)
    pages, root = page_bytes(entries, evlr_at + EVLR.size, page_entries)
    info = replace(cloud.info, root_offset=evlr_at + EVLR.size, root_size=root)
    head[0] = ("copc", 1, "info", info.pack(), False)
    year, day = (int(x) for x in (h["created"] or "0-0").split("-")[:2]) if (h["created"] or "").count("-") == 1 else (0, 0)
    header = Header((1, 4), fmt, compressor != PLAIN, BASE_LENGTH[fmt] + extra, h["points"], points_at, HEADER, scale, offset, tuple(h[f"min{a}"] for a in "xyz"), tuple(h[f"max{a}"] for a in "xyz"),
        h["file_source_id"], h["global_encoding"], uuid.UUID(h["guid"]).bytes_le, h["system_identifier"], h["generating_software"], (day, year), len(head), evlr_at, 1 + len(tail), tuple(h["returns"]))
    front = header_bytes(header) + b"".join(VLR.pack(padded(u, 16), i, len(d), padded(t, 32)) + d for u, i, t, d, _ in head) + struct.pack("<q", table_at)
    behind = table + b"".join(EVLR.pack(padded(u, 16), i, len(d), padded(t, 32)) + d for u, i, t, d, _ in [("copc", 1000, "index", pages, True), *tail])
    write_placed(spark, path, front, chunks, starts, table_at - points_at - 8, behind)


def convert_clustered(spark: SparkSession, las: str, path: str, max_points_per_node: int = 100_000, crs_wkt: str | None = None, compressor: int = PLAIN) -> None:
    """A LAS file as one clustered file, by way of a native cloud in the shared folder."""
    from .las import convert_las

    cloud = convert_las(spark, las, f"{Scratch(spark, 'convert').base}/cloud", max_points_per_node, crs_wkt)
    write_clustered(cloud, path, compressor)
