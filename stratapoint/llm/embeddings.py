"""Near-duplicate vectors by an inverted multi-index and exact verification.

Vectors are scaled to unit length, rotated, and cut in halves. Each half has its
own codebook, fitted on a bounded sample; the pairs of codes are the cells of a
product grid, in which every vector is indexed. A vector visits cells nearest
first by the multi-sequence algorithm, where a cell's distance is how far beyond
the boundaries of both its codes the vector lies. It stops at the distance of a link over the root of 2, which
loses no link: the vectors of a link lie on both sides of the boundaries between their
codes, so how far each is beyond them adds up, half by half, to the link's distance at most, and the
nearer of the two visits the other's cell.

Only sketches travel to the visited cells: some coordinates of the rotated vector, whose distance is never
above that of the vectors. Who meets nobody within a link's distance of the sketches
goes no further; whole vectors follow for the others and are verified in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, spread


@dataclass(frozen=True)
class VectorParams:
    cosine: float = 0.98
    sample: int = 4096  # vectors that the codebooks are fitted on, at most
    cell_rows: int = 2048  # vectors of one label that a cell should hold on average
    sampled: int = 16  # vectors of the sample for each code, at least
    chunk: int = 4096  # vectors of a cell in one block
    asks: int = 1024  # vectors that are compared with a block at once
    sketch: int = 16  # coordinates that travel to visited cells
    rounds: int = 12
    seed: int = 11


@dataclass
class Codebook:
    rotation: np.ndarray
    halves: list[np.ndarray]
    gaps: list[np.ndarray]  # distances between codes
    radius: float

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return x @ self.rotation

    def beyond(self, y: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half, the own code of each row and how far each code's cell is beyond the own cell's boundary."""
        at, own, far = 0, [], []
        for codes, gap in zip(self.halves, self.gaps):
            part = y[:, at : at + codes.shape[1]]
            at += codes.shape[1]
            d = ((part**2).sum(1)[:, None] - 2 * part @ codes.T) + (codes**2).sum(1)[None, :]
            a = d.argmin(1)
            own.append(a)
            far.append((d - d[np.arange(len(d)), a][:, None]) / (2 * gap[a]))
        return own, far


def fit_codebook(sample: np.ndarray, codes: int, p: VectorParams) -> Codebook:
    """Lloyd's algorithm on each half of the rotated unit vectors."""
    rng = np.random.default_rng(p.seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    y, cut = sample @ rotation, (d + 1) // 2
    halves, gaps = [], []
    for part in (y[:, :cut], y[:, cut:]):
        c = np.unique(part, axis=0)
        c = c[rng.permutation(len(c))[:codes]]
        for _ in range(p.rounds):
            own = ((part[:, None, :] - c[None]) ** 2).sum(2).argmin(1) if part.size < 1 << 20 else np.concatenate([((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1) for x in np.array_split(part, 16)])
            for k in range(len(c)):
                if (own == k).any():
                    c[k] = part[own == k].mean(0)
        gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
        gap[gap == 0] = np.inf
        halves.append(c)
        gaps.append(gap)
    link = math.sqrt(2 * (1 - p.cosine))
    return Codebook(rotation, halves, gaps, link / math.sqrt(2) + 1e-9)


def nearest_cells(far1: np.ndarray, far2: np.ndarray, radius: float) -> list[int]:
    """Cells (code of half 1 * codes of half 2 + code of half 2) within the radius, nearest first, by the multi-sequence algorithm."""
    o1, o2 = np.argsort(far1, kind="stable"), np.argsort(far2, kind="stable")
    s1, s2, n2 = far1[o1] ** 2, far2[o2] ** 2, len(far2)
    heap, seen, out = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, []
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > radius * radius:
            break
        out.append(int(o1[i]) * n2 + int(o2[j]))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < n2 and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return out


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(kind: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            raw, off = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), kind), lists.offsets.to_numpy()
            packed = [raw[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("grp"), batch.column("copies"), pa.array(packed, pa.binary())], names=["uid", "grp", "copies", "raw"])

    return pack


def _assign(books: dict[int, Codebook], kind: str, size: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            cell, visits, sketch = np.zeros(len(raw), np.int64), [[0]] * len(raw), [b""] * len(raw)
            width = np.array([len(r) for r in raw])
            for w in np.unique(width):
                book, at = books.get(int(w)), np.flatnonzero(width == w)
                if book is None:
                    continue  # a dimension that the sample doesn't hold is one cell
                y = book.rotated(_unit([raw[i] for i in at], kind))
                own, far = book.beyond(y)
                few = np.ascontiguousarray(y[:, :size], "<f4")
                cell[at] = own[0] * len(book.halves[1]) + own[1]
                for k, i in enumerate(at):
                    visits[i] = nearest_cells(far[0][k], far[1][k], book.radius)
                    sketch[i] = few[k].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch, pa.binary()), pa.array(cell), pa.array(visits, pa.list_(pa.int64()))], names=[*batch.schema.names, "sketch", "cell", "visits"])

    return assign


def _screen(p: VectorParams):
    """Which members and askers of a block have another within a link's distance of their sketches; without sketches, all."""
    most = 2 * (1 - p.cosine) + 1e-3

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T <= most

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, asking, hit = None, [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal hit, asking
            if not members or not asking:
                asking = []
                return
            uid, other = np.array([r[0] for r in asking]), np.array([r[0] for r in members])
            if members[0][1]:
                q, m = (np.frombuffer(b"".join(r[1] for r in rows), "<f4").reshape(len(rows), -1) for rows in (asking, members))
                met = near(q, m) & (uid[:, None] != other[None, :])
            else:
                met = uid[:, None] != other[None, :]
            hit = met.any(0) if hit is None else hit | met.any(0)
            yield told(uid[met.any(1)], True)
            asking = []

        def told(uid: np.ndarray, asks: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(np.full(len(uid), v, np.int64)) for v in now], pa.array(np.full(len(uid), asks)), pa.array(uid.astype(np.int64))], names=["grp", "cell", "chunk", "asks", "uid"])

        def close() -> Iterator[pa.RecordBatch]:
            yield from flush()
            if hit is not None:
                yield told(np.array([r[0] for r in members])[hit], False)

        for batch in batches:
            for *key, asks, uid, sketch in zip(*(batch.column(c).to_pylist() for c in ("grp", "cell", "chunk", "asks", "uid", "sketch"))):
                if key != now:
                    yield from close()
                    now, members, asking, hit = key, [], [], None
                if not asks:
                    members.append((uid, sketch))
                    continue
                asking.append((uid, sketch))
                if len(asking) == p.asks:
                    yield from flush()
        yield from close()

    return screen


def _match(books: dict[int, Codebook], kind: str, p: VectorParams):
    def compare(members: list, asking: list) -> pa.RecordBatch:
        mu, mc, qu, qc = (np.array([r[i] for r in rows], np.int64) for rows in (members, asking) for i in (0, 1))
        m, q = _unit([r[2] for r in members], kind), _unit([r[2] for r in asking], kind)
        links = (q @ m.T >= p.cosine) & (qu[:, None] != mu[None, :])
        n_q, n_m = links.astype(np.int64) @ mc, np.zeros(len(mu), np.int64)
        qi, mi = np.nonzero(links)
        book = books.get(len(members[0][2]))
        if book is not None and len(qi):  # a member that doesn't visit the asking vector's cell has this link from here
            n2, cell = len(book.halves[1]), np.array([r[3] for r in asking])[qi]
            far = book.beyond(book.rotated(m))[1]
            back = far[0][mi, cell // n2] ** 2 + far[1][mi, cell % n2] ** 2 <= book.radius**2
            np.add.at(n_m, mi[~back], qc[qi[~back]])
        uid, n = np.concatenate([qu, mu]), np.concatenate([n_q, n_m])
        root_q, root_m = np.arange(len(qu)), len(qu) + np.arange(len(mu))
        while len(qi):
            new_m, new_q = root_m.copy(), root_q.copy()
            np.minimum.at(new_m, mi, root_q[qi])
            np.minimum.at(new_q, qi, new_m[mi])
            if (new_m == root_m).all() and (new_q == root_q).all():
                break
            root_m, root_q = new_m, new_q
        root = np.concatenate([root_q, root_m])
        some = np.flatnonzero((n > 0) | (root != np.arange(len(root))))
        return pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(n[some]), pa.array(uid[root[some]])], names=["uid", "links", "root"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, asking = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("grp", "cell", "chunk")))
            for key, asks, row in zip(keys, batch.column("asks").to_pylist(), zip(*(batch.column(c).to_pylist() for c in ("uid", "copies", "raw", "own")))):
                if key != now:
                    if members and asking:
                        yield compare(members, asking)
                    now, members, asking = key, [], []
                if not asks:
                    members.append(row)
                    continue
                asking.append(row)
                if len(asking) == p.asks:
                    if members:
                        yield compare(members, asking)
                    asking = []
        if members and asking:
            yield compare(members, asking)

    return match


def near_vectors(rows: DataFrame, key: str, vector: str, label: str, p: VectorParams = VectorParams()) -> DataFrame:
    """One row per row: key, n_links, component_id, kept.

    Only rows with equal labels that are not null, and equal lengths, are compared. A
    vector that is null, empty, all zero or holds a null or non-finite number
    links with nothing. ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the least key reachable. Equal rows are compared once and
    counted as often as they are there. No rows: no rows. A result with the name of the key is left out. Equality of label and vector
    is taken from a 64-bit hash.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    item = rows.schema[vector].dataType.elementType.simpleString()
    kind = "<f4" if item == "float" else "<f8"
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    good = F.coalesce((F.size(v) > 0) & finite & F.col("label").isNotNull(), F.lit(False))
    every = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<float>" if item == "float" else "array<double>").alias("vector"), F.col(f"`{label}`").alias("label"))
    every = every.select("key", "vector", F.when(good, F.xxhash64("label", F.size("vector"))).alias("grp"), F.when(good, F.xxhash64("label", "vector")).alias("uid"))
    merged = every.filter("uid is not null").groupBy("uid").agg(F.min("key").alias("least_key"), F.count(F.lit(1)).alias("copies"), F.first("grp").alias("grp"), F.first("vector").alias("vector"))
    classes = scratch.save(merged)
    packed = scratch.save(classes.select("uid", "grp", "copies", "vector").mapInArrow(_pack(kind), "uid long, grp long, copies long, raw binary"))
    most = packed.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    codes = max(1, min(p.sample // p.sampled, math.ceil(math.sqrt(most / p.cell_rows))))
    sample = packed.select("raw", "uid").orderBy(F.xxhash64("uid")).limit(p.sample).collect()
    books = {}
    for width in {len(r["raw"]) for r in sample}:
        books[width] = fit_codebook(_unit([bytes(r["raw"]) for r in sample if len(r["raw"]) == width], kind), codes, p)
    placed = scratch.save(packed.repartition(spread(spark)).mapInArrow(_assign(books, kind, p.sketch), "uid long, grp long, copies long, raw binary, sketch binary, cell long, visits array<long>"))
    cells = scratch.save(placed.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / p.chunk).cast("long").alias("chunks")))
    place = ["grp", "cell", "chunk"]
    held = placed.join(cells, ["grp", "cell"]).select("grp", "cell", F.pmod(F.xxhash64("uid"), "chunks").alias("chunk"), F.lit(False).alias("asks"), "uid", "sketch")
    asked = placed.select("grp", F.explode("visits").alias("cell"), "uid", "sketch").join(cells, ["grp", "cell"])
    asked = asked.select("grp", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("asks"), "uid", "sketch")
    dealt = held.unionByName(asked).repartition(spread(spark), *place).sortWithinPartitions(*place, "asks")
    met = scratch.save(dealt.mapInArrow(_screen(p), "grp long, cell long, chunk long, asks boolean, uid long"))
    whole = met.join(placed.select("uid", "copies", "raw", F.col("cell").alias("own")), "uid")
    whole = whole.repartition(spread(spark), *place).sortWithinPartitions(*place, "asks")
    found = scratch.save(whole.mapInArrow(_match(books, kind, p), "uid long, links long, root long"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")), scratch)
    linked = classes.select("uid", "least_key", "copies").join(found.groupBy("uid").agg(F.sum("links").alias("links")), "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = linked.groupBy("root").agg(F.min("least_key").alias("component_id"))
    linked = linked.join(least, "root").select("uid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = every.select("key", "uid").join(linked, "uid", "left")
    component = F.when(F.col("uid").isNull(), F.col("key")).otherwise(F.col("component_id"))
    results = {"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": component, "kept": F.col("key").eqNullSafe(component)}
    return out.select(F.col("key").alias(key), *[c.alias(n) for n, c in results.items() if n != key])
