"""Word shingles of whole texts as NumPy arrays, for code that runs inside Arrow batches.

A word is a run of characters other than white space, lower-cased; a shingle is
``k`` consecutive words, as a 64-bit hash. A text of 1 to k - 1 words is one shingle of all
its words; a text without words (null, empty, white space) has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_MULTIPLIERS = np.random.default_rng(20240501).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Shingled:
    """Distinct shingles of several texts, sorted inside each: text i has values[starts[i]:starts[i] + counts[i]]."""

    values: np.ndarray
    starts: np.ndarray
    counts: np.ndarray


def shingled(texts: pa.Array, k: int = 5) -> Shingled:
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    off = lists.offsets.to_numpy().astype(np.int64)
    flat = pc.dictionary_encode(lists.flatten())
    n_docs, n = len(off) - 1, np.diff(off)
    words = flat.dictionary.to_numpy(zero_copy_only=False)
    w = pd.util.hash_array(words, categorize=False)[flat.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    blank = np.array([i for i, x in enumerate(words) if x == ""])
    if len(blank):
        n = n - np.bincount(np.repeat(np.arange(n_docs), n)[np.isin(flat.indices.to_numpy(), blank)], minlength=n_docs)
    size = len(w)
    w = np.concatenate([w, np.zeros(k, np.uint64)])
    s = np.zeros(size, np.uint64)
    for j in range(k):
        s += w[j : size + j] * _MULTIPLIERS[j]
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    left = off[1:][doc] - np.arange(size)
    whole = left >= k
    small = np.flatnonzero((n > 0) & (n < k))
    extra = np.zeros(len(small), np.uint64)
    for j in range(k):
        extra += np.where(j < n[small], w[np.minimum(off[small] + j, size)] * _MULTIPLIERS[j], np.uint64(0))
    extra += n[small].astype(np.uint64) * _MULTIPLIERS[-1]
    values = mixed(np.concatenate([s[whole], extra]))
    owner = np.concatenate([doc[whole], small])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    counts = np.bincount(owner, minlength=n_docs)
    return Shingled(values, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts)


def per_text(s: Shingled, values: np.ndarray, how: np.ufunc) -> np.ndarray:
    """how.reduce over each text's entries of ``values``; 0 for a text without shingles."""
    out = np.zeros(len(s.counts), values.dtype)
    full = np.flatnonzero(s.counts)
    if len(full):
        out[full] = how.reduceat(values, s.starts[full])
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about SLICE_BYTES of text (one row at least), so that memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to
