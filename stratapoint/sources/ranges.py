"""Byte ranges of local files, HTTP servers, other stores and memory; all can be sent to tasks."""

from __future__ import annotations

import os
import re
import urllib.request
from dataclasses import dataclass, field
from urllib.parse import urlparse

from ..model import CloudIoError, InvalidData


@dataclass
class FileRanges:
    path: str

    def size(self) -> int:
        return os.path.getsize(self.path)

    def read(self, at: int, n: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(at)
            got = f.read(n)
        if len(got) != n:
            raise CloudIoError(f"range {at}+{n} ends beyond {self.path}")
        return got


@dataclass
class HttpRanges:
    """A server that answers range requests with 206; the length comes from a one-byte probe."""

    url: str
    timeout: float = 30.0

    def _get(self, first: int, last: int):
        ask = urllib.request.Request(self.url, headers={"Range": f"bytes={first}-{last}"})
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as r:
                if r.status != 206:
                    raise CloudIoError(f"{self.url} answers {r.status} to a range request, expected 206")
                return r.headers.get("Content-Range", ""), r.read()
        except OSError as e:
            raise CloudIoError(f"{self.url}: {e}") from e

    def size(self) -> int:
        m = re.fullmatch(r"bytes \d+-\d+/(\d+)", self._get(0, 0)[0].strip())
        if not m:
            raise CloudIoError(f"{self.url} gives no total length")
        return int(m[1])

    def read(self, at: int, n: int) -> bytes:
        if not n:
            return b""
        got = self._get(at, at + n - 1)[1]
        if len(got) != n:
            raise CloudIoError(f"{self.url} gave {len(got)} bytes of {n}")
        return got


@dataclass
class StoreRanges:
    """A file in any store that pyarrow opens by its address (hdfs, s3, gs, abfs)."""

    uri: str

    def _open(self):
        from pyarrow import fs

        try:
            store, path = fs.FileSystem.from_uri(self.uri)
            return store.open_input_file(path)
        except (OSError, ValueError) as e:
            raise CloudIoError(f"{self.uri}: {e}") from e

    def size(self) -> int:
        with self._open() as f:
            return f.size()

    def read(self, at: int, n: int) -> bytes:
        with self._open() as f:
            got = f.read_at(n, at)
        if len(got) != n:
            raise CloudIoError(f"range {at}+{n} ends beyond {self.uri}")
        return got


@dataclass
class CountedRanges:
    """Another source, with a list of the ranges that were read."""

    inner: object
    asked: list[tuple[int, int]] = field(default_factory=list)

    def size(self) -> int:
        return self.inner.size()

    def read(self, at: int, n: int) -> bytes:
        self.asked.append((at, n))
        return self.inner.read(at, n)


@dataclass
class BytesRanges:
    raw: bytes

    def size(self) -> int:
        return len(self.raw)

    def read(self, at: int, n: int) -> bytes:
        return within(self.raw, at, n)


def within(raw: bytes, at: int, n: int) -> bytes:
    if at < 0 or n < 0 or at + n > len(raw):
        raise InvalidData(f"range {at}+{n} exceeds file length {len(raw)}")
    return raw[at : at + n]


def ranges_of(path: str):
    """A source by its address: http(s), a local file, or another store."""
    kind = urlparse(path).scheme
    if kind in ("http", "https"):
        return HttpRanges(path)
    if kind in ("", "file"):
        return FileRanges(re.sub(r"^file:(//)?", "", path))
    return StoreRanges(path)
