"""Line-addressable chunks of files, without loss: joined without overlap they are the file again."""

from __future__ import annotations

import bisect
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import fixed
from ridgeline.session import spread

_INK = re.compile(r"\S")
_WHITE = np.array([chr(i).isspace() for i in range(0x3001)])
#: Natural boundaries: runs of line feeds (longer ones are stronger), sentence ends, blanks.
_BREAK = re.compile(r"(?P<lines>\n(?:[ \t]*\n)*)|(?P<sentence>[.!?;]+[\"')\]]*[ \t]+)|(?P<word>[^\S\n]+)")
_HEADING = re.compile(r"^#{1,6} ", re.M)

CHUNK = "ord int, start_line int, end_line int, n_chars int, sha256 string, text string, header string"


def _boundaries(text: str, markdown: bool) -> tuple[list[int], list[int]]:
    """(offsets after which a cut is natural, their strength)."""
    at, strength = [], []
    for m in _BREAK.finditer(text):
        at.append(m.end())
        strength.append(2 + min(m.group().count("\n"), 8) if m.lastgroup == "lines" else 1 if m.lastgroup == "sentence" else 0)
    if markdown:
        heads = {m.start() for m in _HEADING.finditer(text)}
        strength = [s + 10 if a in heads else s for a, s in zip(at, strength)]
    return at, strength


def chunk_spans(text: str, size: int = fixed.CHUNK_CHARS, overlap: int = fixed.CHUNK_OVERLAP, markdown: bool = False) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text; each holds at most `size` characters that aren't white space.

    A chunk ends at the last of the strongest boundaries it can reach, so a blank line wins over a
    line break even where more would fit. Blank texts have no chunk. With an overlap, a chunk begins
    up to that many inked characters before the end of the one before, at a line if it can, and always after its start.
    """
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be smaller than the window {size}")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # the offsets of characters that aren't white space, four bytes each
    inks = array("I", np.flatnonzero((codes > 0x3000) | ~_WHITE[np.minimum(codes, 0x3000)]).astype(np.uint32).tobytes())
    if not inks:
        return []
    at, strength = _boundaries(text, markdown)
    out, start = [], 0
    while True:
        before = bisect.bisect_left(inks, start)
        if len(inks) - before <= size:
            out.append((start, len(text)))
            return out
        most = inks[before + size]  # the first character too many
        past = out[-1][1] if out else 0  # every chunk ends after the one before
        hi = bisect.bisect_right(at, most)
        lo = min(hi, bisect.bisect_right(at, max(past, inks[before])))
        if hi > lo:
            top = max(strength[lo:hi])
            end = next(at[i] for i in range(hi - 1, lo - 1, -1) if strength[i] == top)
        else:
            end = most
            while end > max(start, past) + 1 and (0x300 <= ord(text[end]) <= 0x36F or ord(text[end]) in (0x200D, 0xFE0F) or ord(text[end - 1]) == 0x200D):
                end -= 1
        out.append((start, end))
        if overlap:
            inside = bisect.bisect_left(inks, end)
            back = inks[max(inside - overlap, 0)]
            lines = [a for a in at[bisect.bisect_left(at, back) : bisect.bisect_left(at, end)] if a > start and text[a - 1] == "\n"]
            start = lines[0] if lines else max(back, start + 1) if back > start else end
        else:
            start = end


def chunk_text(text: str, rel_path: str = "", size: int = fixed.CHUNK_CHARS, overlap: int = fixed.CHUNK_OVERLAP, header: bool = True, markdown: bool = False) -> list[tuple]:
    """Rows of CHUNK for one file; a single pass over its line feeds."""
    rows, seen, line = [], 0, 1
    for n, (a, z) in enumerate(chunk_spans(text, size, overlap, markdown)):
        line += text.count("\n", seen, a) if a >= seen else -text.count("\n", a, seen)
        seen, body = a, text[a:z]
        end = max(line, line + body.count("\n") - body.endswith("\n"))
        rows.append((n, line, end, len(_INK.findall(body)), hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), body, rel_path if header else ""))
    return rows


def chunk_files(files: DataFrame, size: int = fixed.CHUNK_CHARS, overlap: int = fixed.CHUNK_OVERLAP, header: bool = True, markdown: bool = False) -> DataFrame:
    """(project, path, CHUNK…) of (project, path, text)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for paths, texts in batches:
            yield pd.Series([[dict(zip(names, r)) for r in chunk_text(t or "", p or "", size, overlap, header, markdown)] for p, t in zip(paths, texts)])

    names = [c.split()[0] for c in CHUNK.split(", ")]
    kind = "array<struct<" + ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in CHUNK.split(", ")) + ">>"

    udf = F.pandas_udf(_typed(run), kind)
    return spread(files.select("project", "path", "text")).select("project", "path", F.inline(udf("path", "text")))


def _typed(run):
    """`run` with the hints by which Spark tells an iterator of several columns."""

    def chunks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return run(batches)

    return chunks
