"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import bisect
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT = 2000
OVERLAP = 200

# The code points of the Unicode White_Space property.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_JOINING = (0x200D, 0xFE0F)
_WHITE = np.zeros(0x3001, bool)
_WHITE[[ord(c) for c in WHITE_SPACE]] = True
_BLANK = re.compile(f"[{WHITE_SPACE}]+")
#: Boundaries from strong to weak: after blank lines, after a line, after a sentence, after a word.
_LINES = re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+|\n|\r(?!\n)")
_SENTENCE = re.compile(f"[.!?;\u3002\uff01\uff1f][\"')\\]]*[{WHITE_SPACE}]*")
_WORD = re.compile(f"[{WHITE_SPACE}]+")

PIECES = "project string, chunk_id long, piece int, start_line int, end_line int, n_chars int, text string"


def ink(text: str) -> int:
    """Characters that are not Unicode white space."""
    return len(text) - sum(len(m) for m in _BLANK.findall(text))


def ink_places(text: str) -> array:
    """The offsets of the characters that are not white space, four bytes each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return array("I", np.flatnonzero(~_WHITE[np.minimum(codes, 0x3000)] | (codes > 0x3000)).astype(np.uint32).tobytes())


def _atoms(text: str, inks: array, most: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at its end): segments of at most `most` inked characters."""

    def count(a: int, b: int) -> int:
        return bisect.bisect_left(inks, b) - bisect.bisect_left(inks, a)

    def cut(a: int, b: int, level: int) -> Iterator[tuple[int, int, int]]:
        if level == 3:
            at = a
            while count(at, b) > most:  # no boundary at all: cut between characters, keeping combined ones together
                end = inks[bisect.bisect_left(inks, at) + most - 1] + 1
                while end - 1 > at + 1 and (0x300 <= ord(text[end]) <= 0x36F or ord(text[end]) in _JOINING or ord(text[end - 1]) == 0x200D):
                    end -= 1
                yield at, end, 0
                at = end
            yield at, b, 1
            return
        pattern = (_LINES, _SENTENCE, _WORD)[level]
        at = a
        for m in pattern.finditer(text, a, b):
            end = m.end()
            if end <= at:
                continue
            strength = (4 + (m.group().count("\n") > 1), 3, 2)[level]
            yield from whole(at, end, level, strength)
            at = end
        if at < b:
            yield from whole(at, b, level, 5 if level == 0 else 1)

    def whole(a: int, b: int, level: int, strength: int) -> Iterator[tuple[int, int, int]]:
        if count(a, b) <= most:
            yield a, b, strength
        else:
            parts = list(cut(a, b, level + 1))
            yield from parts[:-1]
            x, y, _ = parts[-1]
            yield x, y, strength

    return list(cut(0, len(text), 0))


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of `text`; a text within the limit is one piece, an empty one none.

    Agglomerative: the atomic segments are lines (longer ones cut into sentences, words, characters).
    Adjacent segments are merged, weakest boundary first and smaller union first, while the union and
    the overlap fit into `limit`. Each piece after the first starts up to `overlap` inked characters
    before its own segments, moved forward to the start of a word where one lies within.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    inks = ink_places(text)
    if len(inks) <= limit:
        return [(0, len(text))] if text else []
    room = limit - overlap
    atoms = _atoms(text, inks, room)
    n = len(atoms)
    place = [bisect.bisect_left(inks, a) for a, _, _ in atoms] + [len(inks)]
    sizes = [place[i + 1] - place[i] for i in range(n)]
    strength = [s for _, _, s in atoms]
    right, left, alive, version = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, [0] * n
    last = list(range(n))  # the last atom of the segment that begins at i
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        j = right[i]
        if j < n and sizes[i] + sizes[j] <= (limit if left[i] < 0 else room):
            heapq.heappush(heap, (strength[last[i]], sizes[i] + sizes[j], i, version[i], version[j]))

    for i in range(n):
        push(i)
    while heap:
        _, _, i, vi, vj = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or version[i] != vi or j >= n or version[j] != vj:
            continue
        sizes[i] += sizes[j]
        last[i], right[i], alive[j] = last[j], right[j], False
        version[i] += 1
        version[j] += 1
        if right[i] < n:
            left[right[i]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    pieces = []
    i = 0
    while i < n:
        start, end = atoms[i][0], atoms[last[i]][1]
        if pieces and overlap:
            first = place[i]  # ink before this piece
            back = max(first - overlap, bisect.bisect_left(inks, pieces[-1][0]))
            at = inks[back] if back < first else start
            if 0 < at < start and not text[at - 1].isspace():
                blank = _BLANK.search(text, at, start)
                at = blank.end() if blank and blank.end() < start else at
            start = at
        pieces.append((start, end))
        i = right[i]
    return pieces


def _run(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for project, cid, base, text in zip(*(b.column(c).to_pylist() for c in ("project", "chunk_id", "start_line", "text"))):
                spans = split_text(text, limit, overlap)
                if len(spans) < 2:
                    continue
                base = base if base and base > 0 else 1
                seen, line = 0, base
                for k, (a, z) in enumerate(spans):
                    line = line + text.count("\n", seen, a) if a >= seen else line - text.count("\n", a, seen)
                    seen = a
                    piece = text[a:z]
                    end = max(line, line + piece.count("\n") - piece.endswith("\n"))
                    for col, v in zip(out, (project, cid, k, line, end, ink(piece), piece)):
                        col.append(v)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["project", "chunk_id", "piece", "start_line", "end_line", "n_chars", "text"])

    return run


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each text of more than `limit` characters that are not white space (columns: PIECES).

    `piece` counts from 0. Lines are counted from the row's start_line, or from 1 where that is NULL
    or less than 1; n_chars is counted anew. NULL and smaller texts give no row. Repeated rows give
    their pieces once; rows of one chunk_id with different texts give the pieces of each.
    """
    long = chunks.select("project", "chunk_id", "start_line", "text").where(f"length(text) > {limit}").distinct()
    return long.mapInArrow(_run(limit, overlap), PIECES)
