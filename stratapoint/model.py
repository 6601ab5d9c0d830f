"""Boxes, octree keys, index entries, file information, queries and errors: plain driver-side values."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

@dataclass(frozen=True)
class Form:
    """A binary layout that can be sent to executors, which ``struct.Struct`` cannot."""

    text: str

    @property
    def size(self) -> int:
        return struct.calcsize(self.text)

    def pack(self, *values) -> bytes:
        return struct.pack(self.text, *values)

    def unpack_from(self, raw: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.text, raw, at)


MAX_LEVEL = 30  # fixed value: deepest octree level
ENTRY = Form("<4iQ2i")  # fixed format: level, x, y, z, offset, byte size, point count
INFO = Form("<5d2Q2d88x")  # fixed format: 160 bytes with a reserved tail


class CloudError(Exception):
    """Base of all errors of this package."""


class InvalidInput(CloudError):
    pass


class InvalidData(CloudError):
    pass


class LasError(CloudError):
    pass


class CloudIoError(CloudError):
    pass


class Cancelled(CloudError):
    pass


class Unsupported(CloudError):
    pass


@dataclass(frozen=True)
class Bounds:
    """A closed axis-aligned box."""

    min: tuple[float, float, float]
    max: tuple[float, float, float]

    @classmethod
    def point(cls, x: float, y: float, z: float) -> Bounds:
        return cls((x, y, z), (x, y, z))

    @classmethod
    def cube(cls, center: tuple[float, float, float], half: float) -> Bounds:
        return cls(tuple(c - half for c in center), tuple(c + half for c in center))

    def extend(self, x: float, y: float, z: float) -> Bounds:
        keep = lambda a, b, pick: a if math.isnan(b) else b if math.isnan(a) else pick(a, b)
        p = (x, y, z)
        return Bounds(tuple(keep(a, b, min) for a, b in zip(self.min, p)), tuple(keep(a, b, max) for a, b in zip(self.max, p)))

    def center(self) -> tuple[float, float, float]:
        return tuple((a + b) * 0.5 for a, b in zip(self.min, self.max))

    def octant(self, n: int) -> Bounds:
        """The n-th eighth by halving; bit 0 is the upper x half, bit 1 y, bit 2 z."""
        mid = self.center()
        lo = tuple(m if n >> i & 1 else a for i, (a, m) in enumerate(zip(self.min, mid)))
        hi = tuple(b if n >> i & 1 else m for i, (b, m) in enumerate(zip(self.max, mid)))
        return Bounds(lo, hi)

    def intersects(self, other: Bounds) -> bool:
        return all(a <= d and c <= b for a, b, c, d in zip(self.min, self.max, other.min, other.max))

    def contains(self, x: float, y: float, z: float) -> bool:
        return all(a <= v <= b for a, v, b in zip(self.min, (x, y, z), self.max))

    def check(self) -> Bounds:
        """Raise unless the box is finite, ordered and of finite span."""
        for a, b in zip(self.min, self.max):
            if not (math.isfinite(a) and math.isfinite(b) and math.isfinite(b - a)):
                raise InvalidInput("bounds and their span must be finite")
            if a > b:
                raise InvalidInput("bounds minimum must not exceed maximum")
        return self

    def root_cube(self) -> tuple[tuple[float, float, float], float]:
        """Centre and half size of the octree's root."""
        d = [b - a for a, b in zip(self.min, self.max)]
        return tuple(a + s * 0.5 for a, s in zip(self.min, d)), max(max(d) / 2, 1e-6)


@dataclass(frozen=True, order=True)
class VoxelKey:
    level: int
    x: int
    y: int
    z: int

    @classmethod
    def root(cls) -> VoxelKey:
        return cls(0, 0, 0, 0)

    def child(self, octant: int) -> VoxelKey:
        return VoxelKey(self.level + 1, *(v * 2 + (octant >> i & 1) for i, v in enumerate((self.x, self.y, self.z))))

    def holds(self, other: VoxelKey) -> bool:
        """Whether the other key is this one or below it."""
        up = other.level - self.level
        return up >= 0 and (other.x >> up, other.y >> up, other.z >> up) == (self.x, self.y, self.z)

    def bounds(self, center: tuple[float, float, float], half: float) -> Bounds:
        """The reader's box: root corner plus key times side (not bit-equal to repeated halving)."""
        if min(self.level, self.x, self.y, self.z) < 0:
            raise InvalidData(f"negative voxel key {self}")
        side = half * 2.0 / 2.0**self.level
        lo = tuple(c - half + k * side for c, k in zip(center, (self.x, self.y, self.z)))
        return Bounds(lo, tuple(v + side for v in lo))


@dataclass(frozen=True)
class Entry:
    key: VoxelKey
    offset: int
    byte_size: int
    point_count: int

    @property
    def kind(self) -> str:
        """``points``, ``empty`` or ``page``; a count below -1 is an error."""
        if self.point_count < -1:
            raise InvalidData(f"hierarchy entry {self.key} has point count {self.point_count}")
        return "page" if self.point_count == -1 else "points" if self.point_count else "empty"

    def pack(self) -> bytes:
        k = self.key
        return ENTRY.pack(k.level, k.x, k.y, k.z, self.offset, self.byte_size, self.point_count)

    @classmethod
    def unpack(cls, raw: bytes, at: int = 0) -> Entry:
        if len(raw) - at < ENTRY.size:
            raise InvalidData("hierarchy entry is truncated")
        *key, offset, size, count = ENTRY.unpack_from(raw, at)
        return cls(VoxelKey(*key), offset, size, count)


def unpack_page(raw: bytes) -> list[Entry]:
    if not raw or len(raw) % ENTRY.size:
        raise InvalidData(f"hierarchy page of {len(raw)} bytes is not a positive multiple of {ENTRY.size}")
    return [Entry.unpack(raw, at) for at in range(0, len(raw), ENTRY.size)]


@dataclass(frozen=True)
class Info:
    center: tuple[float, float, float]
    halfsize: float
    spacing: float
    root_offset: int
    root_size: int
    gps_min: float
    gps_max: float

    def pack(self) -> bytes:
        return INFO.pack(*self.center, self.halfsize, self.spacing, self.root_offset, self.root_size, self.gps_min, self.gps_max)

    @classmethod
    def unpack(cls, raw: bytes) -> Info:
        if len(raw) < INFO.size:
            raise InvalidData("info record is truncated")
        v = INFO.unpack_from(raw)
        return cls(v[:3], *v[3:])


@dataclass(frozen=True)
class Lod:
    """Which levels a query takes: all, one, a half-open range, or those up to a resolution."""

    how: str = "all"
    low: int = 0
    high: int = 0
    resolution: float = 0.0

    @classmethod
    def all(cls) -> Lod:
        return cls()

    @classmethod
    def level(cls, n: int) -> Lod:
        return cls("level", n)

    @classmethod
    def range(cls, low: int, high: int) -> Lod:
        return cls("range", low, high)

    @classmethod
    def up_to(cls, resolution: float) -> Lod:
        return cls("resolution", resolution=resolution)

    def levels(self, spacing: float) -> tuple[int, int]:
        """The half-open level range. Logarithms are taken here, not in Spark, whose log2 rounds powers of two up."""
        last = 2**31 - 1
        if self.how == "all":
            return 0, last
        if self.how == "level":
            if not 0 <= self.low < last:
                raise InvalidInput(f"level {self.low} is out of range")
            return self.low, self.low + 1
        if self.how == "range":
            if self.low < 0 or self.high < self.low:
                raise InvalidInput(f"level range {self.low}..{self.high} is not valid")
            return self.low, self.high
        for name, v in (("resolution", self.resolution), ("spacing", spacing)):
            if not (math.isfinite(v) and v > 0):
                raise InvalidInput(f"{name} must be finite and positive")
        ratio = spacing / self.resolution
        return (0, last) if math.isinf(ratio) else (0, max(1, math.ceil(math.log2(ratio)) + 1 if ratio > 0 else 1))


@dataclass(frozen=True)
class PointQuery:
    lod: Lod = field(default_factory=Lod)
    bounds: Bounds | None = None
