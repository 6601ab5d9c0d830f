"""Personal data: exact base patterns, then bootstrapped contextual extraction.

Base entities of four kinds come from fixed patterns over the whole text. They seed a
pattern-instance graph: instances are base entities, other tokens with digits or an at sign,
and runs of digit groups that blanks, line ends, dots, hyphens and brackets join, with the runs' parts.
Patterns are lexical: the word to the left, the two words to the left, the word to the right, the words on both sides, and
the instance's own form, that is its groups of digits and letters, the signs between them and
whether its digits pass the check that its kind may have. Nothing says which of them tell a kind: Spark scores
patterns by the share of their instances' scores that is of a kind (an instance of no known kind counts less against it if it may be of that kind), and instances by their best pattern, round by
round until a round adds none; an instance that a high-confidence pattern points at becomes one of that kind,
with the pattern's score, and counts for the patterns of the next round. So a form that only known cards have finds
a card that stands right beside another one, where the base pattern sees one long number.
A part of a run is a candidate too, but doesn't count for a pattern's score. Every place of a known instance
is a span, also where the base patterns passed it over; of overlapping spans found so the first and longest stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, extended, packed, unpacked
from .shingles import slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LOCAL_CHARS = "".join(sorted(LOCAL))
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TOKEN = re.compile(r"(?<!\S)\S*?[0-9@]\S*+")
PIECES = re.compile(r"[0-9]+|[^\W\d_]+|\s+")
GROUP = re.compile(r"\+?\(?[0-9][0-9().-]*+")
BLANKS = " \xa0\u202f\n\r\t"
EDGE = re.compile(r"^\W+|\W+$")
LUHN = [[int(c) for c in "0123456789"], [int(c) for c in "0246813579"]]


@dataclass(frozen=True)
class PiiParams:
    support: int = 8  # distinct known instances of a pattern, at least
    confidence: float = 0.9
    unknown: float = 0.25  # what an instance of no known kind counts against a kind that it may be of; others count whole
    word: int = 64  # characters of a neighbouring word; a longer one is no context


def luhn(digits: str) -> bool:
    return sum(LUHN[i & 1][int(c)] for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and then start; offsets are code points, ends exclusive."""
    out = []
    at, last = text.find("@"), 0  # last: where the next match may begin
    while at >= 0:
        left = text[last:at]
        start = at - (len(left) - len(left.rstrip(LOCAL_CHARS)))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m[0])) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def possible(token: str) -> list[str]:
    """The kinds that a token outside the base patterns may be, by its digits and signs."""
    digits = sum(c in "0123456789" for c in token)
    letters = sum(c.isalpha() for c in token)
    out = []
    if token.count("@") == 1 and letters:
        out.append("email")
    if not letters and token.count(".") == 3 and 4 <= digits <= 12:
        out.append("ip")
    if not letters and 12 <= digits <= 19:
        out.append("card")
    if not letters and 7 <= digits <= 15 and token.count(".") != 3:
        out.append("phone")
    return out


def _words(text: str, at: int, step: int, p: PiiParams) -> list[str]:
    """The next two words to the left (step -1) or right of a position, nearest first; a word that is too long ends the list."""
    reach = 2 * p.word + 4
    piece = text[max(0, at - reach) : at] if step < 0 else text[at : at + reach]
    cut = at > reach if step < 0 else at + reach < len(text)
    words = piece.split()[::step]
    if cut and words and not piece[0 if step < 0 else -1].isspace():
        words.pop()  # goes on beyond the reach
    out = []
    for w in words[:2]:
        w = EDGE.sub("", w.lower())
        if not w or len(w) > p.word:
            break
        out.append(w)
    return out


def form(surface: str) -> str:
    """Groups of digits by length, letters and blanks as such, other signs as they are; and which checks the digits pass."""
    digits = "".join(DIGITS.findall(surface))
    parts = surface.split(".")
    octets = len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in parts)
    passed = "L" * (len(digits) >= 12 and luhn(digits)) + "I" * octets
    return PIECES.sub(lambda m: " " if m[0].isspace() else f"d{len(m[0])}" if m[0][0] in "0123456789" else "a", surface) + f" {passed}"


def patterns(surface: str, left: list[str], right: list[str]) -> list[str]:
    """The patterns of one place of an instance."""
    out = [f"F {form(surface)}"]
    if left:
        out.append(f"L {left[0]}")
    if right:
        out.append(f"R {right[0]}")
    if len(left) > 1:
        out.append(f"LL {left[1]} {left[0]}")
    if left and right:
        out.append(f"B {left[0]} {right[0]}")
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A run without brackets that open or close nothing in it, or that hold all of it."""
    x = text[a:b]
    if x[0] == "(" and x.find(")") in (-1, len(x) - 1):
        a += 1
    if x[-1] == ")" and "(" not in text[a:b]:
        b -= len(x) - len(x.rstrip(")"))
    return a, b


def _runs(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, list[str], bool]]:
    """(start, end, possible kinds, whole) of runs of two or more digit groups with blanks or line ends between them, outside the base spans, and of the runs' parts."""
    runs, end, i = [], -1, 0  # end: of the group before, if a run may go on there
    for m in GROUP.finditer(text):
        a, b = m.start(), m.start() + len(m[0].rstrip(".-("))
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        around = text[a - 1 : a] + text[b : b + 1]
        if i < len(taken) and taken[i][0] < b or any(c.isalnum() or c in "_@" for c in around):
            end = -1
            continue
        gap = text[end:a] if end >= 0 else ""
        if not gap or gap.strip(BLANKS + "().-") or not any(c in BLANKS for c in gap):
            runs.append([])
        runs[-1].append((a, b, len(DIGITS.findall(m[0]))))
        end = b
    out = []
    for run in runs:
        for first in range(len(run)):
            digits = 0
            for last in range(first, len(run)):  # single groups too, for a run of several
                digits += run[last][2]
                a, b = _trimmed(text, run[first][0], run[last][1])
                if digits > 19:
                    break
                kinds = ["card"] * (digits >= 12) + ["phone"] * (7 <= digits <= 15)  # the others need no blanks
                if kinds and len(run) > 1:
                    out.append((a, b, kinds, last - first == len(run) - 1))
    return out


def occurrences(text: str, base: list[tuple[str, int, int]], p: PiiParams) -> list[tuple]:
    """(kind or None, start, end, surface, possible kinds, patterns, main) of base spans and of other identifier-like tokens and runs; parts of a run aren't main."""
    taken = sorted((a, b) for _, a, b in base)
    runs = _runs(text, taken)
    found = [(k, a, b, [k], True) for k, a, b in base] + [(None, a, b, kinds, whole) for a, b, kinds, whole in runs]
    parts = {(a, b) for a, b, _, _ in runs}
    whole = [(a, b) for a, b, _, w in runs if w]
    i = j = 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        word = m[0]
        a, b = a + len(word) - len(word.lstrip("\"'([{<,;:")), b - (len(word) - len(word.rstrip("\"')]}>,;:.!?#$%&*|")))
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= b or (a, b) in parts or i < len(taken) and taken[i][0] < b:
            continue
        while j < len(whole) and whole[j][1] <= a:
            j += 1
        found.append((None, a, b, possible(text[a:b]), j == len(whole) or whole[j][0] >= b))
    out = []
    for k, a, b, kinds, main in found:
        surface = " ".join(text[a:b].split())
        out.append((k, a, b, surface, kinds, patterns(surface, _words(text, a, -1, p), _words(text, b, 1, p)), main))
    return out


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


OCCURRENCE = "array<struct<kind:string,start:int,stop:int,instance:long,possible:array<string>,patterns:array<long>,main:boolean>>"
_OCCURRENCE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.int64()), ("possible", pa.list_(pa.string())), ("patterns", pa.list_(pa.int64())), ("main", pa.bool_())]))


def _scan(p: PiiParams):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            found, bases, hashes = [], [], []
            for text in texts:
                base = base_spans(text)
                bases.append(joined(base))
                hashes.append(hashlib.sha256(bases[-1].encode()).hexdigest())
                found.append([
                    {"kind": k, "start": a, "stop": b, "instance": _hash(s), "possible": kinds, "patterns": [_hash(x) for x in told], "main": main}
                    for k, a, b, s, kinds, told, main in occurrences(text, base, p)
                ])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bases), pa.array(hashes), pa.array(found, _OCCURRENCE)], names=[*batch.schema.names[:-1], "base", "base_sha256", "found"])

    return scan


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and longest of overlapping spans of a row."""
    for batch in batches:
        out = []
        for spans in batch.column("more").to_pylist():
            kept, end = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                if s["start"] >= end:
                    kept.append(s)
                    end = s["stop"]
            out.append(kept)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, batch.schema.field("more").type)], names=["_row", "more"])


def _named(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["a"].cast("string"), s["b"].cast("string"))


def find_pii(docs: DataFrame, keep: list[str], text: str, p: PiiParams = PiiParams()) -> DataFrame:
    """Kept columns, n_email, n_ip, n_card, n_phone (all spans of a kind), base_sha256, spans and base (the spans of the base patterns), one row per row of docs.

    Null and empty texts have no spans. Repeated rows are separate rows and each
    has its spans; an instance counts once for a pattern however often
    it occurs. No documents: no rows. Kept columns named like a result give way to it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    rows = packed(docs, keep, [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "base"], text=F.col(f"`{text}`"))
    rows = rows.mapInArrow(_scan(p), extended(rows, ["text"], base=T.StringType(), base_sha256=T.StringType(), found=T.DataType.fromDDL(OCCURRENCE)))
    rows = scratch.save(rows.withColumn("_row", F.monotonically_increasing_id()))
    seen = rows.select("_row", F.explode("found").alias("o")).select("_row", "o.*")
    edges = scratch.save(seen.select("instance", "kind", "possible", "main", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.first("possible").alias("possible"), F.max("main").alias("main")))
    labels = scratch.save(edges.filter("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0)))
    while True:
        tagged = edges.drop("kind").join(labels, "instance", "left")
        per_kind = [c for k in KINDS for c in (F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(f"s_{k}"), F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}"), F.count(F.when(F.col("kind").isNull() & F.array_contains("possible", k), 1)).alias(f"u_{k}"))]
        counts = tagged.filter("main").groupBy("pattern").agg(F.count(F.lit(1)).alias("all"), *per_kind)
        share = lambda k: F.coalesce(f"s_{k}", F.lit(0.0)) / F.greatest(F.col("all") - (1 - p.unknown) * F.col(f"u_{k}"), F.lit(p.unknown))
        best = F.array_max(F.array(*[F.struct(share(k).alias("share"), F.col(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for k in KINDS]))
        strong = counts.withColumn("best", best).select("pattern", F.col("best.kind").alias("as"), "best.n", "best.share")
        strong = strong.filter((F.col("n") >= p.support) & (F.col("share") >= p.confidence)).drop("n")
        new = tagged.filter("kind is null").join(strong, "pattern").filter(F.array_contains("possible", F.col("as")))
        new = scratch.save(new.groupBy("instance").agg(F.max(F.struct(F.col("share").alias("score"), F.col("as").alias("kind"))).alias("b")).select("instance", "b.kind", "b.score"))
        if new.isEmpty():
            break
        labels = scratch.save(labels.unionByName(new))
    places = seen.filter("kind is null").select("_row", "instance", "start", "stop", "possible")
    spans = places.join(labels.select("instance", "kind"), "instance").filter(F.array_contains("possible", F.col("kind")))
    more = spans.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("more")).mapInArrow(_apart, "_row long, more array<struct<kind:string,start:int,stop:int>>")
    empty = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    base = F.transform(F.filter("found", lambda o: o["kind"].isNotNull()), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["stop"].alias("stop")))
    every = rows.join(more, "_row", "left").withColumn("every", F.concat(base, F.coalesce("more", empty)))
    of = lambda k: F.filter("every", lambda s: s["kind"] == k)
    sorted_of = lambda k: F.array_sort(F.transform(of(k), lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"))))
    text_of = F.concat(*[F.transform(sorted_of(k), _named(k)) for k in KINDS])
    return unpacked(every, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS], "base_sha256", F.array_join(text_of, ",").alias("spans"), "base")
