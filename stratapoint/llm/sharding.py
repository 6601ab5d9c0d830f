"""Sharding by histogram sort: exact byte counts below probes until the splitters settle, then one exchange.

Rows are ordered by (number from the MD5 of the text, of the row). Each round counts the
exact bytes in the cells around every open splitter, 4096 cells a splitter, and
narrows it to one cell. It stops when the cell holds less than the tolerance. The
driver sees cells, never rows. A group of equal texts stays in one shard unless
it is large enough to unbalance it; then it is split by the row hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.prefix import bucket_offsets
from .scratch import Scratch, packed, unpacked

BITS = 12
LOWEST = -(2**63)
SAME = 24  # bits of the second key that tell equal rows apart


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    tolerance: float = 0.001  # of a shard's bytes, by which a splitter may miss
    group_slack: float = 0.02  # of a shard's bytes; a group of copies above it may be split
    bucket_rows: int = 4096  # rows that one window orders


def md5_number(text: Column) -> Column:
    """A number below 2**60 that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _narrow(keys: DataFrame, key: str, fixed: Column | None, wanted: dict[int, float], start: float, tol: float) -> dict[int, tuple[int, int, float, float, bool]]:
    """For each wanted splitter (bytes below it), the cell of ``key`` it falls in: (first value, end, bytes below, bytes in, several rows of one value)."""
    rows = keys.filter(fixed) if fixed is not None else keys
    state = {j: (LOWEST, start, float("inf"), 0, 2) for j in wanted}  # cell start, bytes below, bytes in, bits known, rows in
    while True:
        todo = {j for j, s in state.items() if s[2] > tol and s[3] < 64 and s[4] > 1}
        if not todo:
            return {j: (s[0], min(s[0] + (1 << (64 - s[3])), 2**63 - 1), s[1], s[2], s[3] >= 64 and s[4] > 1) for j, s in state.items()}
        known = state[next(iter(todo))][3]
        bits = min(64, known + BITS)
        found = rows
        if known:
            found = rows.filter(F.shiftright(key, 64 - known).isin(sorted({state[j][0] >> (64 - known) for j in todo})))
        cells = found.groupBy((F.shiftright(key, 64 - bits) if bits < 64 else F.col(key)).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        cells.sort(key=lambda r: r["cell"])
        for j in todo:
            first, below = state[j][0], state[j][1]
            last = first + (1 << (64 - known)) if known else 2**63
            own = [(r["cell"] << (64 - bits), r["bytes"], r["n"]) for r in cells if first <= r["cell"] << (64 - bits) < last]
            for at, inside, n in own:
                if below + inside >= wanted[j] or at == own[-1][0]:
                    state[j] = (at, below, inside, bits, n)
                    break
                below += inside


def splitters(keys: DataFrame, p: ShardParams) -> list[tuple[int, int]]:
    """p.shards - 1 ascending (k1, k2) lower bounds of shards 1, 2, ...; keys has k1, k2 and size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    ideal = total / p.shards
    if not total:
        return [(2**63 - 1, 2**63 - 1)] * (p.shards - 1)
    wanted = {j: ideal * j for j in range(1, p.shards)}
    tol = p.tolerance * ideal
    found, out = _narrow(keys, "k1", None, wanted, 0.0, tol), {}
    heavy: dict[int, list[int]] = {}
    for j, (at, end, below, inside, single) in found.items():
        if single and inside > p.group_slack * ideal:
            heavy.setdefault(at, []).append(j)
        else:
            out[j] = (at if wanted[j] - below <= below + inside - wanted[j] else end, LOWEST)
    for at, js in heavy.items():
        below = found[js[0]][2]
        for j, (first, end, b, n, _) in _narrow(keys, "k2", F.col("k1") == at, {j: wanted[j] for j in js}, below, tol).items():
            out[j] = (at, first if wanted[j] - b <= b + n - wanted[j] else end)
    return sorted(out.values())


def shard_rows(rows: DataFrame, text: Column, ident: list[str], size: Column, p: ShardParams = ShardParams()) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in each shard), by the ``bytes`` law.

    Shards hold nearly equal bytes. Rows with equal texts share a shard unless
    their group alone exceeds the slack. Null texts count as empty ones. Repeated
    rows are separate rows. Reruns agree however the rows are dealt out. No rows: no rows. Columns of the caller named size,
    shard or slot give way to the results.
    """
    scratch = Scratch(rows.sparkSession, "shard")
    # of the row's own columns, so that reruns agree; the low bits only tell rows apart that are equal in all columns
    row = md5_number(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in [*ident, *(c for c in rows.columns if c not in ident)]]))
    k2 = row.bitwiseAND(F.lit(-(1 << SAME))).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << SAME) - 1)))
    keyed = packed(rows, rows.columns, ["size", "shard", "slot"], size=size, k1=md5_number(F.coalesce(text, F.lit(""))), k2=k2)
    keyed = scratch.save(keyed)  # freezes what tells equal rows apart
    bounds = splitters(keyed.select("k1", "k2", "size"), p)
    above = [((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b))).cast("int") for a, b in bounds]
    n = max(1, -(-keyed.count() // (p.shards * p.bucket_rows)))
    dealt = keyed.withColumns({"shard": reduce(lambda x, y: x + y, above, F.lit(0)), "_sub": F.pmod(F.shiftright("k2", SAME), F.lit(n))})
    before = bucket_offsets(dealt.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("n")), ["shard"], "_sub", {"n": "_n0"}, n)
    slot = F.row_number().over(W.partitionBy("shard", "_sub").orderBy("k2", "k1")) - 1 + F.col("_n0")
    return unpacked(dealt.join(before, ["shard", "_sub"]).withColumn("slot", slot.cast("long")), "size", "shard", "slot")
