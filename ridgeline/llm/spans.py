"""Long exact spans shared between records.

Line hashing alone can't give the required result: a shared span need not hold one whole line, nor
begin or end at one. So units are cut by content: within every window of `span` characters the
k-gram with the smallest hash is the window's anchor, the same one wherever the window occurs. The
windows of one anchor form a unit, the stretch of text they cover. Unit digests are grouped globally
as line digests would be, after map-side combining; a unit that occurs in two records is shared
whole. Where units of one anchor differ, their windows are digested singly, once per distinct unit.
The result is exact (up to collisions of 128-bit digests), without pairs of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import spread, staged

SPAN = 160
GRAM = 64
_MASK = np.uint64((1 << 24) - 1)
#: Characters a numpy pass works on; a longer text is cut into stretches that overlap by a span.
STRETCH = 1 << 20
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))


_POWERS = [_Powers(b) for b in _BASES]


def _prefix(codes: np.ndarray, which: int) -> np.ndarray:
    p = _POWERS[which]
    p.need(len(codes) + 1)
    values = _mix(codes.astype(np.uint64) + np.uint64(0x51 + 0x1000003 * which))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * p.up[: len(codes)], dtype=np.uint64, out=out[1:])
    return out


def _digest(prefix: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of codes[start:end], by position-free polynomial hashes."""
    return _mix((prefix[end] - prefix[start]) * _POWERS[which].down[start])


def _units(codes: np.ndarray, ends: np.ndarray, span: int, gram: int):
    """Per unit: (record number, anchor hash, unit digest, start, length). `codes` are records end to end."""
    n, width = len(codes), span - gram + 1
    if n < span:
        return (np.empty(0, np.int64),) * 5
    one, two = _prefix(codes, 0), _prefix(codes, 1)
    at = np.arange(n - gram + 1)
    grams = _digest(one, 0, at, at + gram)
    key = (grams & ~_MASK) | (_MASK - (at.astype(np.uint64) & _MASK))  # ties: the rightmost
    low, size = key, 1
    while size * 2 <= width:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < width:
        low = np.minimum(low[: n - span + 1], low[width - size :][: n - span + 1])
    windows = np.arange(n - span + 1)
    record = np.searchsorted(ends, windows, side="right")
    inside = windows + span <= ends[record]
    # the anchor's place, from its low bits (a window is shorter than the range of the bits)
    anchor = windows + ((_MASK - (low & _MASK)).astype(np.int64) - windows & int(_MASK))
    first = np.flatnonzero(inside & np.r_[True, (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (record[1:] != record[:-1])])
    last = np.flatnonzero(inside & np.r_[(anchor[1:] != anchor[:-1]) | ~inside[1:] | (record[1:] != record[:-1]), True])
    a, z = windows[first], windows[last] + span
    return record[first], grams[anchor[first]].view(np.int64), _digest(two, 1, a, z).view(np.int64), a, z - a


def _stretches(ids: list, texts: list[str], span: int) -> Iterator[tuple[list, list[int], np.ndarray, np.ndarray]]:
    """Records gathered to about STRETCH characters: (ids, offset of each in its record, codes, ends)."""
    own: list[tuple[int, int, str]] = []
    size = 0

    def ready():
        codes = np.frombuffer("".join(t for _, _, t in own).encode("utf-32-le", "surrogatepass"), np.uint32)
        return [i for i, _, _ in own], [o for _, o, _ in own], codes, np.cumsum([len(t) for _, _, t in own])

    for i, t in zip(ids, texts):
        if t is None or i is None or len(t) < span:
            continue
        for o in range(0, max(1, len(t) - span + 1), STRETCH):
            part = t[o : o + STRETCH + span - 1]
            if size + len(part) > 2 * STRETCH and own:
                yield ready()
                own, size = [], 0
            own.append((i, o, part))
            size += len(part)
    if own:
        yield ready()


def _cut(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, offsets, codes, ends in _stretches(b.column("id").to_pylist(), b.column("text").to_pylist(), span):
                record, anchor, digest, start, length = _units(codes, ends, span, gram)
                begin = np.r_[0, ends[:-1]]
                place = start - begin[record] + np.asarray(offsets)[record] if len(record) else start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(ids, np.int64)[record]), pa.array(anchor), pa.array(digest), pa.array(place.astype(np.int32)), pa.array(length.astype(np.int32))],
                    names=["id", "anchor", "unit", "start", "length"],
                )

    return run


def _windows(span: int):
    """The single windows of the units asked for: (anchor, unit, offset, window digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[list[np.ndarray]] = [[] for _ in range(7)]
            for text, asked in zip(b.column("text").to_pylist(), b.column("asked").to_pylist()):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                one, two = _prefix(codes, 0), _prefix(codes, 1)
                for u in asked:
                    s = np.arange(u["start"], u["start"] + u["length"] - span + 1)
                    for k, v in enumerate((u["anchor"], u["unit"], None, None, None, u["lo"], u["hi"])):
                        if v is not None:
                            got[k].append(np.full(len(s), v, np.int64))
                    got[2].append((s - u["start"]).astype(np.int32))
                    got[3].append(_digest(one, 0, s, s + span).view(np.int64))
                    got[4].append(_digest(two, 1, s, s + span).view(np.int64))
            if got[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g)) for g in got], names=["anchor", "unit", "offset", "w1", "w2", "lo", "hi"])

    return run


def shared_stretches(records: DataFrame, span: int = SPAN, gram: int = GRAM, earliest: bool = False) -> DataFrame:
    """(id, start, end, first): stretches of `records` (id BIGINT, text STRING) whose every window of
    `span` characters occurs verbatim in a record with another id; with `earliest`, `first` is the
    smallest id that has those windows (else some id). Offsets are code points; stretches of a record may touch or overlap; together they
    cover exactly the shared characters.

    Repeated rows count once; NULL ids or texts and texts shorter than `span` give nothing.
    """
    units = staged(spread(records.select("id", "text")).mapInArrow(_cut(span, gram), "id long, anchor long, unit long, start int, length int"), "units")
    # anchors in more than one record; the first shuffle holds one row per distinct anchor and task
    several = units.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("anchor")
    candidates = staged(units.join(several, "anchor"), "candidates")
    distinct = staged(
        candidates.groupBy("anchor", "unit").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(F.struct("id", "start", "length")).alias("at")),
        "distinct-units",
    )
    whole = distinct.where("lo <> hi").select("anchor", "unit", F.col("lo").alias("first"))
    # anchors whose units differ: each distinct unit is looked at once, in the record that holds it first
    differ = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("lo") == F.col("hi"), 1)).alias("single"))
    differ = differ.where("n > 1" if earliest else "n > 1 and single > 0").select("anchor")
    asked = (
        distinct.join(differ, "anchor")
        .groupBy(F.col("at.id").alias("id"))
        .agg(F.collect_set(F.struct("anchor", "unit", F.col("at.start").alias("start"), F.col("at.length").alias("length"), "lo", "hi")).alias("asked"))
    )
    windows = staged(
        records.select("id", "text").where(f"length(text) >= {span}").join(asked, "id").select("text", "asked")
        .mapInArrow(_windows(span), "anchor long, unit long, offset int, w1 long, w2 long, lo long, hi long"),
        "windows",
    )
    twice = windows.groupBy("w1", "w2").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first <> last").select("w1", "w2", "first")
    found = windows.join(twice, ["w1", "w2"])
    if not earliest:
        found = found.join(whole.select("anchor", "unit"), ["anchor", "unit"], "left_anti")
    # else a unit shared whole may hold windows that a still earlier record has
    first = found.groupBy("anchor", "unit", "first").agg(F.array_sort(F.collect_set("offset")).alias("offsets"))  # at most `span` offsets
    # runs of offsets: [first, last]
    partial = first.select(
        "anchor", "unit", "first",
        F.explode(
            F.expr("""transform(filter(offsets, o -> not array_contains(offsets, o - 1)),
                      o -> struct(o as a, array_min(filter(offsets, p -> p >= o and not array_contains(offsets, p + 1))) as z))""")
        ).alias("run"),
    )
    spans = (
        whole.withColumn("a", F.lit(0)).withColumn("z", F.lit(None).cast("int"))
        .unionByName(partial.select("anchor", "unit", "first", F.col("run.a").alias("a"), F.col("run.z").alias("z")))
    )
    return candidates.join(spans, ["anchor", "unit"]).select(
        "id", (F.col("start") + F.col("a")).alias("start"),
        (F.col("start") + F.when(F.col("z").isNull(), F.col("length")).otherwise(F.col("z") + span)).alias("end"), "first",
    )


_LENGTH = "aggregate(spans, 0, (n, s) -> n + s.end - s.start)"


def _merged(stretches: DataFrame) -> DataFrame:
    """(id, spans): the maximal intervals that a record's stretches cover together, in order. A sort of each
    record's stretches, which may spill; no list is copied step by step."""
    w = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = stretches.select("id", "start", "end").distinct().withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    islands = opens.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = islands.groupBy("id", "_island").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("s"))
    return whole.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("spans"))


def shared_characters(records: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, spans, shared_chars): per record with a shared span, the maximal covered intervals and their length."""
    return _merged(shared_stretches(records, span, gram)).select("id", "spans", F.expr(_LENGTH).alias("shared_chars"))


def without_repeats(records: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, text, removed, removed_chars): each record less what a record with a smaller id has already.

    The earliest record keeps a shared span; in later ones it is cut out, and `removed` has the
    intervals, in offsets of the original text. Records without any keep their text and an empty
    `removed`. A row per distinct (id, text); NULL texts stay NULL.
    """
    gone = _merged(shared_stretches(records, span, gram, earliest=True).where("first < id")).select("id", "spans", F.expr(_LENGTH).alias("n"))
    pieces = """array_join(transform(sequence(0, size(spans)), i -> substring(text,
        if(i = 0, 0, spans[i - 1].end) + 1, if(i = size(spans), length(text), spans[i].start) - if(i = 0, 0, spans[i - 1].end))), '')"""
    both = records.select("id", "text").distinct().join(gone, "id", "left")
    return both.select(
        "id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.expr(pieces.replace("spans[i - 1]", "spans[greatest(i - 1, 0)]").replace("spans[i]", "spans[least(i, size(spans) - 1)]"))).alias("text"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("removed"), F.coalesce("n", F.lit(0)).alias("removed_chars"),
    )
