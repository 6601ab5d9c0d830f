"""n-gram Jaccard join by a MinHash LSH forest and exact verification.

1. Every text gives its shingle-set identity and, for each tree of the forest, a
   trie key of eight one-byte MinHash labels. Texts with equal sets form one class;
   only classes go on.
2. Sorted trie keys meet in the nodes of the tries. Matched prefixes have the length at which two texts at
   the threshold meet in some tree with the target recall. A prefix that very many classes
   share is not matched at that length: its classes go on to a second forest with whole keys and as
   many more trees as make the recall the same, so that prefixes are only as short as a node's
   load allows. A pair is lost only if it shares no prefix in the first forest, or shares
   prefixes of crowded nodes alone and then no key in the second.
3. In each trie node, sorted members are compared by signature with the
   node's leaders. A member as similar to a leader as the threshold asks joins it; others lead
   in turn. By the triangle inequality of Jaccard distance every link of a
   member leads to a text that is tied to the same leader, so the ties, a few a
   member, connect all candidates without listing pairs.
4. Each connected set of candidates is verified exactly in blocks of shingle sets: links are
   counted, and a spanning forest of the links gives the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, spread
from .shingles import mixed, per_text, shingled, slices


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 8  # labels of a trie key, one byte each
    recall: float = 0.9995
    slack: float = 0.13  # three to four standard errors of a similarity estimated from trees * depth labels
    leaders: int = 256  # kept for one trie node; further ones are tied to the first
    node_rows: int = 4096  # classes that a node of the first forest may hold; a larger one of the second is salted
    seed: int = 7
    block: int = 256  # classes in a block of the exact verification


def matched_depth(p: JaccardParams) -> int:
    """The longest prefix at which texts of the threshold's similarity share a node in some tree with the target recall."""
    for d in range(p.depth, 1, -1):
        if 1 - (1 - p.threshold**d) ** p.trees >= p.recall:
            return d
    return 1


def trees_for(p: JaccardParams, depth: int) -> int:
    """The least trees in which texts of the threshold's similarity share a prefix of that length with the target recall."""
    return math.ceil(math.log(1 - p.recall) / math.log1p(-(p.threshold**depth)))


def _signer(p: JaccardParams):
    multipliers = np.random.default_rng(p.seed).integers(1, 2**63, p.trees * p.depth, dtype=np.uint64) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = shingled(batch.column("text"), p.words)
            uid = per_text(s, mixed(s.values + np.uint64(0x9E3779B97F4A7C15)), np.add) ^ mixed(s.counts.astype(np.uint64))
            labels = np.zeros((batch.num_rows, len(multipliers)), np.uint8)
            buffer = np.empty_like(s.values)
            for j, m in enumerate(multipliers):
                np.multiply(s.values, m, out=buffer)
                labels[:, j] = (per_text(s, buffer, np.minimum) >> np.uint64(20)).astype(np.uint8)
            none = s.counts == 0
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(uid.view(np.int64), mask=none), pa.array(s.counts.astype(np.int64)),
                pa.array([None if none[i] else labels[i].tobytes() for i in range(len(labels))], pa.binary()),
            ], names=[*[c for c in batch.schema.names if c != "text"], "uid", "n_shingles", "sig"])

    return sign


def _tie(p: JaccardParams):
    """Leader clustering of the members of trie nodes, which arrive sorted by node."""
    core, near = p.threshold, 2 * p.threshold - 1 - p.slack

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, lead, lead_id, size = None, None, None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("tree", "node", "salt"))))
            uid, first = batch.column("uid").to_numpy(), batch.column("first_uid").to_numpy()
            salted = batch.column("parts").to_numpy() > 1
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(len(uid), -1)
            a, b = [], []
            for i, key in enumerate(keys):
                if key != node:
                    node, size, tied = key, 0, np.zeros(p.leaders, np.int64)
                    lead, lead_id = np.zeros((4, sig.shape[1]), np.uint8), np.zeros(4, np.int64)
                like = (lead[:size] == sig[i]).mean(axis=1) if size else np.zeros(0)
                close = np.flatnonzero(like >= near)
                sets, at = np.unique(tied[close], return_index=True)
                for j in close[at]:  # one leader of each set that is not tied together yet
                    a.append(uid[i])
                    b.append(lead_id[j])
                if len(sets) > 1:
                    tied[:size][np.isin(tied[:size], sets)] = sets[0]
                if size and like.max() >= core:
                    continue
                if salted[i] or size >= p.leaders:
                    a.append(uid[i])
                    b.append(first[i] if salted[i] else lead_id[0])
                if size < p.leaders:
                    if size == len(lead):
                        lead, lead_id = np.concatenate([lead, np.zeros_like(lead)]), np.concatenate([lead_id, np.zeros_like(lead_id)])
                    lead[size], lead_id[size], tied[size] = sig[i], uid[i], sets[0] if len(sets) else size
                    size += 1
            pairs = np.unique(np.array([a, b], np.int64), axis=1) if a else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return tie


def _shingle_sets(p: JaccardParams):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = shingled(batch.column("text"), p.words)
            raw = s.values.tobytes()
            packed = [raw[8 * a : 8 * (a + n)] for a, n in zip(s.starts.tolist(), s.counts.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c != "text"] + [pa.array(packed, pa.binary())], names=[c for c in batch.schema.names if c != "text"] + ["shingles"])

    return sets


def linked(sets: list[np.ndarray], threshold: float, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Boolean matrix: sets i (of ``left``) and j (of ``right``) have Jaccard similarity of the threshold at least."""
    counts = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), counts)
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[code] > 1  # others meet no partner
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(left), len(right)), np.float32)
    rank = np.cumsum(np.concatenate([[0], (code[1:] != code[:-1]).astype(np.int64)])) if len(code) else code
    for c in range(0, int(rank[-1]) + 1 if len(rank) else 0, 4096):
        lo, hi = np.searchsorted(rank, [c, c + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[lo:hi], rank[lo:hi] - c] = 1
        both += m[left] @ m[right].T
    union = counts[left][:, None] + counts[right][None, :] - both
    return both >= threshold * union - 1e-6


def forest(links: np.ndarray) -> np.ndarray:
    """For each row of a square symmetric matrix the least index it is connected to."""
    root = np.arange(len(links))
    while True:
        low = np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(root, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _verify(p: JaccardParams):
    def flush(rows: list) -> pa.RecordBatch:
        uid, copies = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        side, inner = np.array([r[2] for r in rows]), rows[0][3]
        every = np.arange(len(rows))
        left, right = (every, every) if inner else (every[side == 0], every[side == 1])
        n, root = np.zeros(len(rows), np.int64), every
        if len(left) and len(right):
            part = linked([r[4] for r in rows], p.threshold, left, right)
            full = np.zeros((len(rows), len(rows)), bool)
            full[np.ix_(left, right)] = part
            full |= full.T
            np.fill_diagonal(full, False)
            n, root = full.astype(np.int64) @ copies, forest(full)
        some = np.flatnonzero(n)
        whole = np.full(len(some), rows[0][5] == 1)
        return pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(n[some]), pa.array(uid[root[some]]), pa.array(whole)], names=["uid", "links", "root", "whole"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for cand, i, j, uid, copies, side, raw, blocks in zip(*(batch.column(c).to_pylist() for c in ("cand", "bi", "bj", "uid", "copies", "side", "shingles", "blocks"))):
                if now == (cand, i, j) and rows[-1][0] == uid:
                    continue  # a repeated row
                if now != (cand, i, j):
                    if len(rows) > 1:
                        yield flush(rows)
                    now, rows = (cand, i, j), []
                rows.append((uid, copies, side, i == j, np.frombuffer(raw, np.uint64), blocks))
        if len(rows) > 1:
            yield flush(rows)

    return verify


def _trie(classes: DataFrame, p: JaccardParams, depth: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(uid, tree, node) for prefixes of that length, and the nodes of two classes or more (tree, node, n, first_uid)."""
    prefix = [F.struct(F.lit(t).alias("tree"), F.substring("sig", t * p.depth + 1, depth).alias("node")) for t in range(p.trees)]
    trie = classes.select("uid", F.explode(F.array(*prefix)).alias("t")).select("uid", "t.tree", "t.node")
    nodes = trie.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first_uid")).filter("n > 1")
    return trie, scratch.save(nodes)


def _tied(trie: DataFrame, nodes: DataFrame, classes: DataFrame, p: JaccardParams, width: int) -> DataFrame:
    """(a, b): ties of the nodes' members to leaders."""
    members = trie.join(nodes, ["tree", "node"]).withColumn("parts", F.ceil(F.col("n") / p.node_rows).cast("long"))
    members = members.join(classes.select("uid", "sig"), "uid")
    members = members.select("tree", "node", F.pmod(F.xxhash64("uid"), "parts").alias("salt"), "parts", "first_uid", "uid", "sig")
    dealt = members.repartition(width, "tree", "node", "salt").sortWithinPartitions("tree", "node", "salt", "sig", "uid")
    return dealt.mapInArrow(_tie(p), "a long, b long")


def jaccard_join(docs: DataFrame, key: str, text: str, p: JaccardParams = JaccardParams()) -> DataFrame:
    """One row per row of docs: key, row_hash, class_id, class_size, n_links, component_id, kept.

    ``class_id`` is the least key among texts with the same shingle set, ``n_links`` the number of other
    rows whose similarity reaches the threshold (copies included), ``component_id`` the least key
    reachable by links and ``kept`` whether the row's key is that one. Texts
    without words link with nothing and are kept. Null keys sort last; repeated
    rows are copies of each other. No documents: no rows. Identities of shingle
    sets are 64-bit hashes. ``row_hash`` is a hash of all of the row's columns. A result with the name of the key is left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    named = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_hash"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    rows = scratch.save(named.mapInArrow(_signer(p), f"key {kind}, row_hash long, uid long, n_shingles long, sig binary"))
    # a class: the least row (null keys last) stands for it
    classes = scratch.save(rows.filter("uid is not null").groupBy("uid").agg(F.min(F.struct(F.col("key").isNull(), "key", "row_hash")).alias("r"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")).select("uid", F.col("r.key").alias("rep_key"), F.col("r.row_hash").alias("rep_hash"), "copies", "sig"))
    width = spread(spark)
    trie, nodes = _trie(classes, p, matched_depth(p), scratch)
    ties = _tied(trie, nodes.filter(F.col("n") <= p.node_rows), classes, p, width)
    crowded = nodes.filter(F.col("n") > p.node_rows)
    if not crowded.isEmpty():
        deeper = replace(p, trees=trees_for(p, p.depth), seed=p.seed + 1)
        heavy = trie.join(crowded.select("tree", "node"), ["tree", "node"]).select("uid").distinct()
        heavy = classes.join(heavy, "uid").select("rep_key", "rep_hash")
        again = named.join(heavy.hint("merge"), named["key"].eqNullSafe(heavy["rep_key"]) & (named["row_hash"] == heavy["rep_hash"])).select("text")
        signed = scratch.save(again.mapInArrow(_signer(deeper), "uid long, n_shingles long, sig binary").dropDuplicates(["uid"]))
        trie, nodes = _trie(signed, deeper, p.depth, scratch)
        ties = ties.unionByName(_tied(trie, nodes, signed, deeper, width))
    cand = components(ties, scratch).select(F.col("node").alias("uid"), F.col("root").alias("cand"))
    cand = scratch.save(cand.join(classes.drop("sig"), "uid"))
    blocks = cand.groupBy("cand").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("long").alias("blocks"))
    wanted = scratch.save(cand.join(blocks, "cand").select("uid", "cand", "copies", "rep_key", "rep_hash", "blocks"))
    # always by a shuffle, so that the cost stays in proportion at every size
    texts = named.join(wanted.hint("merge"), named["key"].eqNullSafe(wanted["rep_key"]) & (named["row_hash"] == wanted["rep_hash"])).select("uid", "cand", "copies", "blocks", "text")
    sets = texts.mapInArrow(_shingle_sets(p), "uid long, cand long, copies long, blocks long, shingles binary")
    own = F.pmod(F.xxhash64("uid"), "blocks")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("bi"), F.greatest(o, F.col("own")).alias("bj"), (F.col("own") > o).cast("int").alias("side")))
    spreaded = sets.withColumn("own", own).withColumn("b", F.explode(pairs)).select("cand", "b.bi", "b.bj", "b.side", "uid", "copies", "blocks", "shingles")
    spreaded = spreaded.repartition(width, "cand", "bi", "bj").sortWithinPartitions("cand", "bi", "bj", "uid")
    found = scratch.save(spreaded.mapInArrow(_verify(p), "uid long, links long, root long, whole boolean"))
    # candidates of one block are whole components there; only those of several blocks have to be put together
    parts = components(found.filter("not whole").select(F.col("uid").alias("a"), F.col("root").alias("b")), scratch)
    roots = found.filter("whole").select("uid", "root").unionByName(parts.withColumnRenamed("node", "uid"))
    linked = found.select("uid", "links", F.lit(None).cast("long").alias("root")).unionByName(roots.select("uid", F.lit(0).cast("long").alias("links"), "root"))
    linked = scratch.save(linked.groupBy("uid").agg(F.sum("links").alias("links"), F.min("root").alias("root")))
    class_rows = classes.drop("sig").join(linked, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = class_rows.groupBy("root").agg(F.min(F.struct(F.col("rep_key").isNull(), "rep_key", "rep_hash")).alias("c"))
    class_rows = scratch.save(class_rows.join(least, "root").select("uid", F.col("rep_key").alias("class_id"), F.col("copies").alias("class_size"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("c.rep_key").alias("component_id"), F.col("c.rep_hash").alias("kept_hash")))
    out = rows.drop("sig").join(class_rows, "uid", "left")
    alone = F.col("uid").isNull()
    results = (
        "row_hash", F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("key").eqNullSafe(F.col("component_id")) & (F.col("row_hash") == F.col("kept_hash")))).alias("kept"),
    )
    names = ("row_hash", "class_id", "class_size", "n_links", "component_id", "kept")
    return out.select(F.col("key").alias(key), *[F.col(c).alias(c) if isinstance(c, str) else c for n, c in zip(names, results) if n != key])
