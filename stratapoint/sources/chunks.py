"""How a node's packed records are stored: the compression record, and codecs by its compressor number.

Compressor 0 keeps the records as they are. Others, such as the layered arithmetic coder of
public LAZ files, can be registered by whoever has one; without, such files are refused when
their points are asked for, and their header, records and index are still read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.schema import FORMATS
from ..model import Form, InvalidData, Unsupported

HEAD = Form("<HHBBHIIqqH")  # fixed format: compressor, coder, version (3), options, chunk size, two counts, number of items
ITEM = Form("<3H")  # fixed format: type, size, version
# fixed values: item types of extended formats, and the chunk size of chunks that differ in size
POINT, COLOUR, COLOUR_NIR, BYTES, WAVE = 10, 11, 12, 14, 13
VARIABLE = 0xFFFFFFFF
PLAIN = 0


@dataclass(frozen=True)
class Compression:
    compressor: int
    items: tuple[tuple[int, int, int], ...]

    @classmethod
    def of_format(cls, compressor: int, point_format: int, extra: int) -> Compression:
        has = FORMATS[point_format]
        items = [(POINT, 30, 3)]
        if "n" in has:
            items.append((COLOUR_NIR, 8, 3))
        elif "c" in has:
            items.append((COLOUR, 6, 3))
        if "w" in has:
            items.append((WAVE, 29, 3))
        return cls(compressor, tuple(items + [(BYTES, extra, 3)] * bool(extra)))

    @classmethod
    def unpack(cls, raw: bytes) -> Compression:
        if len(raw) < HEAD.size:
            raise InvalidData("the compression record is truncated")
        compressor, *_, n = HEAD.unpack_from(raw)
        if len(raw) < HEAD.size + n * ITEM.size:
            raise InvalidData("the compression record's items are truncated")
        return cls(compressor, tuple(ITEM.unpack_from(raw, HEAD.size + i * ITEM.size) for i in range(n)))

    def pack(self) -> bytes:
        return HEAD.pack(self.compressor, 0, 3, 4, 0, 0, VARIABLE, -1, -1, len(self.items)) + b"".join(ITEM.pack(*i) for i in self.items)

    def check(self, record_length: int) -> Compression:
        """Raise unless the items make up a record."""
        size = sum(s for _, s, _ in self.items)
        if size != record_length:
            raise InvalidData(f"compressed items have {size} bytes, the header's records {record_length}")
        return self


Unpack = Callable[[bytes, int, int], bytes]  # stored chunk, points, record length -> packed records
Pack = Callable[[bytes, int, int], bytes]


def _plain(raw: bytes, points: int, record_length: int) -> bytes:
    if len(raw) != points * record_length:
        raise InvalidData(f"chunk of {len(raw)} bytes does not hold {points} records of {record_length}")
    return raw


_codecs: dict[int, tuple[Unpack, Pack | None]] = {PLAIN: (_plain, _plain)}


def register(compressor: int, unpack: Unpack, pack: Pack | None = None) -> None:
    _codecs[compressor] = (unpack, pack)


def codec(compressor: int, packing: bool = False) -> Callable[[bytes, int, int], bytes]:
    found = _codecs.get(compressor)
    if found is None or found[packing] is None:
        raise Unsupported(f"chunks of compressor {compressor} need a codec, which is not registered")
    return found[packing]


def chunk_table(sizes: list[int], counts: list[int]) -> bytes:
    """Version, number of chunks and their points and bytes; uncompressed."""
    return struct.pack("<II", 0, len(sizes)) + b"".join(struct.pack("<QQ", n, s) for n, s in zip(counts, sizes))
