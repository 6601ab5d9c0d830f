import math
import struct

import pytest

from stratapoint.functions.schema import FORMATS, layout, projected, schema_for_format, selection
from stratapoint.model import INFO, Bounds, Entry, Info, InvalidData, InvalidInput, Lod, VoxelKey, unpack_page
from stratapoint.operators.hierarchy import plan_pages
from stratapoint.sources.clustered import page_bytes


def test_boxes_are_closed_and_nan_is_outside():
    b = Bounds((0, 0, 0), (2, 2, 2))
    assert b.contains(0, 2, 1) and not b.contains(math.nan, 1, 1) and not b.contains(2.1, 1, 1)
    assert b.intersects(Bounds((2, 2, 2), (3, 3, 3))) and not b.intersects(Bounds((2.1, 0, 0), (3, 3, 3)))
    assert Bounds.point(1, 1, 1).extend(math.nan, 0, 5) == Bounds((1, 0, 1), (1, 1, 5))
    assert b.octant(0) == Bounds((0, 0, 0), (1, 1, 1)) and b.octant(5) == Bounds((1, 0, 1), (2, 1, 2))
    for bad in (Bounds((0, 0, 0), (math.inf, 1, 1)), Bounds((1, 0, 0), (0, 1, 1)), Bounds((-1.7e308, 0, 0), (1.7e308, 1, 1))):
        with pytest.raises(InvalidInput):
            bad.check()


def test_keys():
    k = VoxelKey.root().child(5).child(2)
    assert k == VoxelKey(2, 2, 1, 2) and VoxelKey(1, 1, 0, 1).holds(k) and not VoxelKey(1, 0, 0, 1).holds(k)
    assert VoxelKey(1, 1, 0, 0).bounds((0, 0, 0), 4) == Bounds((0, -4, -4), (4, 0, 0))
    with pytest.raises(InvalidData):
        VoxelKey(1, -1, 0, 0).bounds((0, 0, 0), 1)


def test_entries_and_info_round_trip():
    e = Entry(VoxelKey(3, 1, 2, 3), 2**40, 77, -1)
    assert Entry.unpack(e.pack()) == e and e.kind == "page" and len(e.pack()) == 32
    assert unpack_page(e.pack() * 3) == [e] * 3
    for raw in (b"", b"x" * 31):
        with pytest.raises(InvalidData):
            unpack_page(raw)
    with pytest.raises(InvalidData):
        Entry(VoxelKey.root(), 0, 0, -2).kind  # noqa: B018
    i = Info((1.0, 2.0, 3.0), 4.0, 5.0, 6, 7, 8.0, 9.0)
    assert Info.unpack(i.pack()) == i and INFO.size == 160 and i.pack()[72:] == bytes(88)
    with pytest.raises(InvalidData):
        Info.unpack(b"short")


def test_level_ranges():
    assert Lod.level(2).levels(1) == (2, 3) and Lod.range(1, 1).levels(1) == (1, 1)
    assert Lod.up_to(0.5).levels(1.0) == (0, 2) and Lod.up_to(8).levels(1.0) == (0, 1) and Lod.up_to(2.0**-29).levels(1.0) == (0, 30)
    assert Lod.up_to(5e-324).levels(1e300)[1] == 2**31 - 1
    for bad in (Lod.level(-1), Lod.level(2**31 - 1), Lod.range(2, 1), Lod.range(-1, 1), Lod.up_to(0), Lod.up_to(math.nan)):
        with pytest.raises(InvalidInput):
            bad.levels(1.0)


def test_layouts():
    assert len(layout(6)) == 18 and layout(7)[-3:] == ["red", "green", "blue"] and layout(8, 2)[-2:] == ["nir", "extra_bytes"] and len(layout(0)) == 17
    assert set(FORMATS) == set(range(11)) and schema_for_format(10)["wave_packet_offset"].dataType.simpleString() == "decimal(20,0)"
    assert selection(["z", "x", "z"]) == ["z", "x"] and projected(layout(6), ["red", "z", "x"]) == ["x", "z"]
    with pytest.raises(InvalidInput):
        selection(["nope"])


def test_pages():
    root = VoxelKey.root()
    nodes = [Entry(root, 0, 1, 1)] + [Entry(VoxelKey(4, x, y, z), 0, 1, 1) for x in range(16) for y in range(16) for z in range(16)]
    plan = plan_pages(nodes)
    assert len(plan) == 9 and len(plan[0][2]) == 8 and sorted(e.key for _, own, _ in plan for e in own) == sorted(e.key for e in nodes)
    assert len(plan_pages(nodes[:4096])) == 1
    raw, size = page_bytes(nodes, 1000)
    assert size == 32 * 9 and len(raw) == 32 * (4097 + 8)
    assert sum(struct.unpack_from("<i", raw, at + 28)[0] == -1 for at in range(0, len(raw), 32)) == 8
