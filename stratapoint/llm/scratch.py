"""Scratch tables (shared with the rest of the library) and the handling of callers' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scratch import Scratch, checkpoint_root, spread

__all__ = ["Scratch", "checkpoint_root", "extended", "packed", "spread", "unpacked"]


def packed(docs: DataFrame, keep: list[str], results: list[str], **named) -> DataFrame:
    """Kept columns as one struct ``_keep``, beside named columns, so that no name of the caller's meets one of ours.

    A kept column with the name of a result is left out: the result takes its place.
    """
    taken = {r.lower() for r in results}
    own = [F.col(f"`{c}`") for c in keep if c.lower() not in taken]
    return docs.select(F.struct(*own if own else [F.lit(None).cast("int").alias("_none")]).alias("_keep"), *[c.alias(n) for n, c in named.items()])


def unpacked(df: DataFrame, *results) -> DataFrame:
    """The kept columns again, with the results."""
    own = [F.col("_keep")[c].alias(c) for c in df.schema["_keep"].dataType.names if c != "_none"]
    return df.select(*own, *results)


def extended(df: DataFrame, drop: list[str], **more: T.DataType) -> T.StructType:
    """df's schema without some columns and with more."""
    return T.StructType([f for f in df.schema.fields if f.name not in drop] + [T.StructField(n, t) for n, t in more.items()])
