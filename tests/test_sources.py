import http.server
import struct
import threading

import numpy as np
import pytest

from stratapoint.model import Bounds, Entry, Info, InvalidData, Lod, PointQuery, Unsupported, VoxelKey
from stratapoint.sources.chunks import Compression
from stratapoint.sources.clustered import open_index
from stratapoint.sources.las import EVLR, LasSource, convert_las, padded, read_header, write_las
from stratapoint.sources.ranges import BytesRanges, CountedRanges, FileRanges, HttpRanges


def rows(n=500):
    i = np.arange(n)
    return {"x": (i * 37 % 251) * 0.5, "y": (i * 53 % 257) * 1.0, "z": (i * 71 % 63) * 1.0, "intensity": i % 65536, "return_number": i % 4 + 1, "number_of_returns": np.full(n, 4), "synthetic": i % 11 == 0, "overlap": i % 19 == 0,
        "scan_channel": i % 4, "edge_of_flight_line": i % 7 == 0, "classification": i % 18, "scan_angle": ((i % 61) - 30) * 0.006, "gps_time": 1e9 + i, "red": i % 65535, "green": i * 3 % 65535, "blue": i * 7 % 65535, "extra_bytes": [bytes([k % 256, 7]) for k in i]}


def test_las_read_and_convert(spark, tmp_path):
    path, data = f"{tmp_path}/a.las", rows()
    write_las(path, data, 7, (0.01,) * 3, (0.0,) * 3, 2, [("LASF_Projection", 2112, "", b"WKT\0", False), ("mine", 9, "far", b"abc", True)])
    h = read_header(FileRanges(path))
    assert (h.points, h.point_format, h.extra, h.version) == (500, 7, 2, (1, 4)) and [r.record_id for r in h.records] == [2112, 9] and h.returns[:4] == (125,) * 4
    spark.dataSource.register(LasSource)
    got = spark.read.format("las").option("rowsPerPartition", 64).load(path).orderBy("idx").collect()
    assert len(got) == 500
    for k in ("x", "y", "z", "intensity", "return_number", "synthetic", "overlap", "scan_channel", "edge_of_flight_line", "gps_time", "blue", "extra_bytes"):
        assert [r[k] for r in got] == pytest.approx(list(data[k])) if k in "xyz" else [r[k] for r in got] == list(data[k]), k
    assert [r["classification"] for r in got] == [1 if c == 12 else c for c in data["classification"]]
    assert spark.read.format("las").schema("gps_time double, idx long").load(path).columns == ["gps_time", "idx"]
    cloud = convert_las(spark, path, f"{tmp_path}/cloud", 64)
    assert cloud.points.count() == 500 and cloud.header["sx"] == 0.01 and [r["record_id"] for r in cloud.vlrs.collect()] == [2112, 9]


def test_hostile_headers(tmp_path):
    path = f"{tmp_path}/a.las"
    write_las(path, rows(5), 7, extra=2, vlrs=[("a", 1, "", b"xx", False)])
    raw = bytearray(open(path, "rb").read())
    for at, form, value in ((0, "<4s", b"NOPE"), (94, "<H", 2000), (96, "<I", 10**9), (100, "<I", 4097), (105, "<H", 20), (375 + 20, "<H", 65000)):
        bad = bytearray(raw)
        struct.pack_into(form, bad, at, value)
        with pytest.raises(InvalidData):
            read_header(BytesRanges(bytes(bad)))
    for n in (0, 10, 226, 300, 374, 380):
        with pytest.raises(InvalidData):
            read_header(BytesRanges(bytes(raw[:n])))


def clustered(points=12, chain=0, root_size=None):
    """A small file: root node and a pointer to a page with two nodes; the chunks are zeros."""
    write_las(p := "/tmp/stratapoint-test.las", {k: v for k, v in rows(points).items() if k != "extra_bytes"}, 7, vlrs=[("copc", 1, "", bytes(160), False), ("laszip encoded", 22204, "", Compression.of_format(3, 7, 0).pack(), False)])
    raw = bytearray(open(p, "rb").read())
    child = VoxelKey.root().child(3)
    at = len(raw) + EVLR.size
    first = Entry(VoxelKey.root(), 700, 10, 5).pack() + Entry(child, at + 64, 64, -1).pack()
    page = Entry(child, 710, 10, 4).pack() + Entry(child.child(5), 200_000, 10, 3).pack()
    raw += EVLR.pack(padded("copc", 16), 1000, 128, bytes(32)) + first + page
    struct.pack_into("<QI", raw, 235, at - EVLR.size, 1)
    h = read_header(BytesRanges(bytes(raw)))
    info = next(r for r in h.records if r.record_id == 1)
    raw[info.at : info.at + 160] = Info((0.0, 0.0, 0.0), 10.0, 1.0, at, root_size or 64, 0.0, 0.0).pack()
    return bytes(raw).ljust(200_100, b"\0")


def test_eager_and_lazy_index(spark):
    raw = clustered()
    eager = open_index(BytesRanges(raw))
    assert len(eager.entries) == 3 and eager.frame(spark).count() == 3 and [len(r[2]) for r in eager.reads(PointQuery())] == [2, 1]
    lazy = open_index(source := CountedRanges(BytesRanges(raw)), eager=False)
    before = len(source.asked)
    assert [e.point_count for e in lazy.chunks(PointQuery(Lod.level(0)))] == [5] and len(source.asked) == before
    assert [e.point_count for e in lazy.chunks(PointQuery(bounds=Bounds((-9, -9, -9), (-8, -8, -8))))] == [5] and len(source.asked) == before
    assert [e.point_count for e in lazy.chunks(PointQuery())] == [5, 4, 3] and len(source.asked) == before + 1
    with pytest.raises(Unsupported):
        list(eager.chunk(eager.chunks(PointQuery())[0]))


def test_index_limits():
    with pytest.raises(InvalidData, match="point total"):
        open_index(BytesRanges(clustered(11)))
    for size in (31, 32 + (64 << 20), 32 * 10**6):
        with pytest.raises(InvalidData):
            open_index(BytesRanges(clustered(root_size=size)))


def test_http_ranges(tmp_path):
    body = bytes(range(256)) * 8

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            part = body[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(body)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    s = HttpRanges(f"http://127.0.0.1:{server.server_port}/x")
    assert s.size() == 2048 and s.read(10, 5) == body[10:15]
    server.shutdown()
