"""Token counts by greedy longest match over a word-piece vocabulary, in one pass over each word.

The vocabulary's trie carries failure links: where a node has no arc for the next
character, its link leads to the node from which matching goes on, and a
precomputed count says how many pieces are complete by then. A word's length in
pieces is thus a sum of counts; no piece is ever built. A SentencePiece vocabulary is one trie of
whole pieces, read over the space mark and the word; characters that no piece
covers count as their byte pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import extended, packed, unpacked
from .shingles import slices

BEGIN, INNER = 0, 1  # the two roots: of a word, and of what follows its first piece
SPACE = "▁"  # stands for the blank before a word in a SentencePiece model


def _bytes(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


@dataclass
class PieceCounter:
    arcs: dict[tuple[int, str], int]
    link: list[int]
    popped: list[int]
    mark: str = ""  # read before every word; with a mark, words begin at INNER as well
    spelled: bool = False  # a character that no piece covers counts its UTF-8 bytes
    memory: int = 400_000  # words whose counts are kept
    _known: dict[str, int] = field(default_factory=dict)

    @classmethod
    def build(cls, first: set[str], inner: set[str], spelled: bool = False, mark: str = "") -> PieceCounter:
        """From the pieces that begin a word and the pieces that continue one; ``spelled``: every byte is a piece too."""
        arcs: dict[tuple[int, str], int] = {}
        final, parent, char = [False, False], [-1, -1], ["", ""]
        for root, pieces in ((BEGIN, first), (INNER, inner)):
            for piece in sorted(pieces):
                node = root
                for c in piece:
                    to = arcs.get((node, c))
                    if to is None:
                        to = arcs[node, c] = len(final)
                        final.append(False)
                        parent.append(node)
                        char.append(c)
                    node = to
                if piece:
                    final[node] = True
        spell: dict[int, int] = {}  # nodes of single characters that are no pieces, and their bytes
        if spelled:
            for c in set(char) - {""}:
                node = arcs.get((INNER, c))
                if node is None:  # only within pieces
                    node = arcs[INNER, c] = len(final)
                    final.append(False)
                    parent.append(INNER)
                    char.append(c)
                if not final[node]:
                    final[node], spell[node] = True, _bytes(c)
        link, popped = [-1] * len(final), [0] * len(final)
        below: dict[int, list[int]] = {}
        for (node, _), to in arcs.items():
            below.setdefault(node, []).append(to)
        todo = deque(below.get(BEGIN, []) + below.get(INNER, []))
        while todo:  # shallow nodes first: a link always leads to a shallower node
            v = todo.popleft()
            todo.extend(below.get(v, ()))
            if final[v]:
                link[v], popped[v] = INNER, spell.get(v, 1)
                continue
            at, n = link[parent[v]], popped[parent[v]]
            while at >= 0 and (at, char[v]) not in arcs:
                at, n = link[at], n + popped[at]
            if at >= 0:
                link[v], popped[v] = arcs[at, char[v]], n
        return cls(arcs, link, popped, mark, spelled)

    @classmethod
    def whole(cls, pieces: set[str], spelled: bool) -> PieceCounter:
        """From whole pieces, in which the space mark stands for the blank before a word."""
        return cls.build(set(), pieces, spelled, SPACE)

    @classmethod
    def from_sentencepiece(cls, path: str) -> PieceCounter:
        """All pieces of a public SentencePiece model, the space mark alone and byte pieces included."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = {model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        return cls.whole(pieces, sum(model.is_byte(i) for i in ids) == 256)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if it can't be matched to its end, and is one unknown token."""
        arcs, link, popped = self.arcs, self.link, self.popped
        at = INNER if self.mark else BEGIN
        n = 0
        for c in self.mark + word:
            to = arcs.get((at, c))
            while to is None:
                if at == INNER and self.spelled:  # in no piece
                    n += _bytes(c)
                    to = INNER
                    break
                n += popped[at]
                at = link[at]
                if at < 0:
                    return -1
                to = arcs.get((at, c))
            at = to
        while at != INNER:
            n += popped[at]
            at = link[at]
            if at < 0:
                return -1
        return n

    def text(self, text: str) -> tuple[int, int, int]:
        """Words, unknown words and tokens of a whole text."""
        known, words, unknown, tokens = self._known, text.split(), 0, 0
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) >= self.memory:
                    known.clear()
                n = self.count(w)
                if len(w) <= 64:
                    known[w] = n
            if n < 0:
                unknown += 1
                tokens += 1
            else:
                tokens += n
        return len(words), unknown, tokens


def count_tokens(docs: DataFrame, keep: list[str], text: str, counter: PieceCounter) -> DataFrame:
    """Kept columns, n_words, n_unknown and n_tokens (long) of every whole text.

    Words are runs of characters other than Unicode white space; a word without
    a full match is one unknown token. Null, empty and white texts count 0. One row
    per row, repeated or not. Kept columns named like a result give way to it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = [counter.text(t) for t in pc.fill_null(batch.column("text"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([g[i] for g in got], pa.int64()) for i in range(3)]], names=[*batch.schema.names[:-1], "n_words", "n_unknown", "n_tokens"])

    results = ["n_words", "n_unknown", "n_tokens"]
    rows = packed(docs, keep, results, text=F.col(f"`{text}`"))
    return unpacked(rows.mapInArrow(count, extended(rows, ["text"], **dict.fromkeys(results, T.LongType()))), *results)
