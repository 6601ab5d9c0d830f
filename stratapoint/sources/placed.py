"""One file made by tasks: each puts its bytes where they belong, and the driver only what stands before and behind them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CloudIoError, InvalidInput
from ..operators.scratch import checkpoint_root


def shared_path(spark: SparkSession, path: str) -> str | None:
    """The name by which every task can open the file: any local one on a single machine, one in the shared folder on a cluster; else None."""
    at, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    uri = lambda p: at(p).getFileSystem(conf).makeQualified(at(p)).toUri()
    own = uri(path)
    if own.getScheme() != "file":
        return None
    if spark.sparkContext.master.split("[")[0] == "local":
        return own.getPath()
    root = uri(checkpoint_root(spark))
    return own.getPath() if root.getScheme() == "file" and own.getPath().startswith(root.getPath().rstrip("/") + "/") else None


def _place(path: str, base: int, starts: dict[int, int]):
    """Pieces at their places of an existing file; a task that runs twice writes the same bytes again."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, n = os.open(path, os.O_WRONLY), 0
        try:
            for batch in batches:
                for part, at, body in zip(*(batch.column(c) for c in ("part", "at", "body"))):
                    raw, where = memoryview(body.as_buffer()), base + starts[part.as_py()] + at.as_py()
                    n += len(raw)
                    while len(raw):
                        done = os.pwrite(to, raw, where)
                        raw, where = raw[done:], where + done
        finally:
            os.close(to)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return place


def write_placed(spark: SparkSession, path: str, head: bytes, pieces: DataFrame, starts: dict[int, int], length: int, tail: bytes, replace: bool = False) -> None:
    """head, ``length`` bytes of the pieces and tail as one file, which appears under its name only when it is whole.

    ``pieces`` has part, at and body: a body begins at ``starts[part] + at`` behind the head, and parts and
    bodies follow each other without gaps. Where tasks can't open the file (other stores, folders
    that the session doesn't share), the driver passes bodies on one by one.
    """
    to = spark._jvm.org.apache.hadoop.fs.Path
    temp = f"{path}.writing-{uuid.uuid4().hex}"
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    local = shared_path(spark, temp)
    try:
        if local:
            fs.mkdirs(to(temp).getParent())
            with open(local, "wb") as f:
                f.write(head)
                f.truncate(len(head) + length)
                f.seek(len(head) + length)
                f.write(tail)
            done = pieces.select("part", "at", "body").mapInArrow(_place(local, len(head), starts), "n long").agg(F.sum("n")).first()[0] or 0
        else:
            out, done = fs.create(to(temp)), 0
            try:
                out.write(bytearray(head))
                for r in pieces.orderBy("part", "at").select("body").toLocalIterator():
                    out.write(bytearray(r["body"]))
                    done += len(r["body"])
                out.write(bytearray(tail))
            finally:
                out.close()
        if done != length:
            raise CloudIoError(f"{done} bytes of {length} were written to {path}")
        if replace:
            fs.delete(to(path), False)
        if fs.exists(to(path)) or not fs.rename(to(temp), to(path)):
            raise InvalidInput(f"{path} exists or cannot be written")
    except BaseException:
        fs.delete(to(temp), False)
        raise
