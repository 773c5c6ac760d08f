"""Telling hand-written source from generated, minified, third-party and data files.

Linear support-vector classifiers, one for each kind, on hashed character n-grams and path components of
a bounded sample, with the giveaway headers masked. Labels come from markers that rarely lie (well-known
folders and suffixes, texts that are nearly all numbers); they train and are never asked for a decision.
Repositories fall into folds, and each is judged by classifiers and thresholds that come from the others.
A file whose only sign is a header reads like any other once the header is masked; such files are left
out of training, and those the classifiers take for hand-written are checked for a header afterwards. A
file's score is a sum over its chunks, so no file is gathered in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import lowest, spread, staged

KINDS = ("generated", "minified", "third_party", "data")
#: Files of each side (with a label, without) that the classifiers are fitted on, at most.
SAMPLE = 2_500
SHAPES, GRAMS, PATHS = 2048, 2048, 1 << 17
TEXT = SHAPES + GRAMS
WIDTH = TEXT + PATHS
#: A line of more characters counts as one of this length, so that one embedded blob doesn't outweigh a file.
LINE = 300
STRETCH = 1 << 20
#: Parts of the repositories for validation.
FOLDS = 3
#: Characters by which a text's n-grams are drawn towards none, so that short texts tell little.
PRIOR = 40
#: What a path component weighs against a text: the value of its feature, and what text features are divided by.
PATH_VALUE, TEXT_SCALE = 6.0, 11.3
#: Files whose chunks the first pass keeps for the sample, of all files.
KEPT = 40_000

# Folders, suffixes and header phrases by which tools and people mark such files.
THIRD_PARTY_DIRS = (
    "node_modules", "bower_components", "third_party", "third-party", "thirdparty", "3rdparty", "vendor", "vendored", "external", "externals",
    "site-packages", "Pods", "Carthage",
)
LOCK_FILES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "uv.lock", "Cargo.lock",
    "Gemfile.lock", "composer.lock", "go.sum", "mix.lock", "pubspec.lock", "packages.lock.json", "flake.lock",
)
GENERATED_SUFFIX = (
    r"\.pb\.(?:go|cc|h|swift|dart)|\.pb\.gw\.go|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts)|_grpc_pb\.js|\.g\.(?:dart|cs)|\.g\.i\.cs|\.freezed\.dart|\.[Dd]esigner\.(?:cs|vb)"
    r"|[._]generated\.\w+|[._]gen\.(?:go|ts|js|cs)|_string\.go|\.mocks\.dart"
)
MINIFIED_NAME = r"[.-]min\.(?:js|mjs|cjs|css)|\.(?:bundle|chunk)\.(?:js|css)|(?:^|[./-])(?:bundle|chunk|main|vendor|app|runtime)[.-][0-9a-f]{6,32}\.(?:js|css)"
_BY_ITSELF = r"(?:automatically|automatisch|automatiquement|automáticamente|automaticamente)"
_MADE = r"(?:generated|created|generiert|erzeugt|erstellt|g[eé]n[eé]r[eé]e?s?|generad[oa]|generat[oa]|gerad[oa])"
GENERATED_HEADER = (
    r"code generated (?:by|from)\b|@generated\b|<auto-?generated\b|\bauto-?generated\b"
    # made by itself, in either order of the words
    rf"|\b{_BY_ITSELF} {_MADE}\b|\b{_MADE} {_BY_ITSELF}\b"
    # a file that says what made it
    rf"|^\W*(?:this (?:file|code) (?:is|was) )?{_MADE} (?:by|from|using|with)\b.*(?:\bdo not|\bedits?\b|\boverwritten|\bcompiler\b|\.\w+$)|this (?:file|code) (?:is|was) generated\b"
    # changes that don't last
    r"|\b(?:edits?|changes|modifications)\b[^.;]{0,30}\b(?:will be|are|gets?) (?:lost|overwritten|discarded|erased)\b|\bany (?:edit|change|modification)s?\b[^.;]{0,20}\b(?:disappears?|vanish(?:es)?)\b"
)
THIRD_PARTY_HEADER = (
    r"^\W*vendored (?:from|copy)\b|\bthird[- ]party copy of\b|^\W*upstream: *\S+ v?\d|@preserve\b.*\d+\.\d+|^\W*copied (?:unchanged |verbatim )?from (?:the )?\S+ (?:project\b|v?\d)"
    r"|\(c\) (?:\d{4}(?:-\d{4})? )?the \S+ contributors\b.*\blicen[cs]e"
)
BANNER = r"^\W*/\*! *@?\w[\w./-]* +v?\d+\.\d+"

_PATH = re.compile(rf"(?P<third_party>(?:^|/)[A-Za-z][\w.-]*-\d+\.\d+\.\d+/|(?:^|/)(?:{'|'.join(map(re.escape, THIRD_PARTY_DIRS))})/)|(?P<minified>{MINIFIED_NAME}$)|(?P<generated>(?:{GENERATED_SUFFIX})$|(?:^|/)(?:{'|'.join(map(re.escape, LOCK_FILES))})$)")
_HEADERS = {k: re.compile(p, re.I | re.M) for k, p in (("generated", GENERATED_HEADER), ("third_party", THIRD_PARTY_HEADER), ("minified", BANNER))}
_MASK = re.compile("|".join(f"(?:{p})" for p in (GENERATED_HEADER, THIRD_PARTY_HEADER, BANNER)), re.I)
#: Comment and blank lines at the start of a file.
_LEAD = re.compile(r"\A(?:[ \t]*(?://|#|--|/\*|\*|;|<!--|<\?|\"\"\"|'''|@?rem\b)[^\n]*(?:\n|\Z)|[ \t\r]*\n)*")
_INSERT = re.compile(r"^[ \t]*insert[ \t]+into\b[^\n]*\bvalues\b", re.I | re.M)
_BLOB = re.compile(r"^\W*(?:[bru]{0,2}[\"'])?[A-Za-z0-9+/=]{40,}[^A-Za-z0-9]*$", re.M)
_COMMENT = re.compile(r"[ \t]*(?://|#|--|/\*|\*|;|<!--)")

_SHAPE = np.arange(0x110000, dtype=np.uint32)
_SHAPE[0x80:] = 0x7F
for _a, _z, _to in ((0x61, 0x7B, 0x61), (0x41, 0x5B, 0x41), (0x30, 0x3A, 0x30)):
    _SHAPE[_a:_z] = _to


def path_kind(path: str | None) -> str | None:
    """The kind a path names by a well-known folder or suffix, if any."""
    found = _PATH.search(path or "")
    return found.lastgroup if found else None


def header_kinds(text: str) -> set[str]:
    """The kinds that the comments at the start of a text name."""
    return _kinds(_LEAD.match(text).group())


def footer_kinds(text: str) -> set[str]:
    """The kinds that the comments at the end of a text name."""
    end = begin = len(text.rstrip())
    while begin > 0:
        line = text.rfind("\n", 0, begin) + 1
        if text[line:begin].strip() and not _COMMENT.match(text, line):
            break
        begin = max(line - 1, 0)
        if not line:
            break
    return _kinds(text[begin:end])


def _kinds(comments: str) -> set[str]:
    return {k for k in ("generated", "third_party") if _HEADERS[k].search(comments)}


def _path_features(path: str) -> list[int]:
    """Buckets of a path's folders, the shapes of those with numbers (a version is one), its suffixes and the words of its name."""
    *dirs, name = (path or "").split("/")
    stem, *suffixes = name.split(".")
    parts = {f"d:{d}" for d in dirs} | {"s:" + re.sub(r"[A-Za-z]+(?:[-.][A-Za-z]+)*", "a", re.sub(r"\d+", "0", d)) for d in dirs if re.search(r"\d", d)}
    parts |= {f"e:{x}" for x in suffixes} | {f"w:{x}" for x in re.split(r"[^A-Za-z0-9]+", stem) if x} | {"x:" + re.sub(r"[0-9a-f]{6,}", "h", x) for x in suffixes}
    return [SHAPES + GRAMS + xxhash.xxh3_64_intdigest(p) % PATHS for p in sorted(parts)]


def fold_of(project: str | None) -> int:
    """The part of the repositories that a project belongs to."""
    return xxhash.xxh3_64_intdigest(project or "") % FOLDS


@dataclass
class _Block:
    """n-grams of some texts: bucket and weight of each character's two n-grams, and where each text begins."""

    shapes: np.ndarray
    grams: np.ndarray
    weight: np.ndarray
    begin: np.ndarray
    stats: np.ndarray = field(default_factory=lambda: np.empty((0, 4)))


def _statistics(codes, weight, begin, sizes, ends, length, edge) -> np.ndarray:
    # per text: inked characters, digits and separators of literals, lines of ordinary length, lines, each line capped
    literal = ((codes >= 48) & (codes < 58)) | np.isin(codes, np.frombuffer(",.[]{}:\"-".encode("utf-32-le"), np.uint32))
    ink = codes > 32
    line_no = np.cumsum(np.r_[False, edge[:-1]])
    inked_lines = np.bincount(line_no, weights=ink, minlength=len(ends)) > 0
    # lines that differ from the one before in their numbers only: a hash of the characters with each run of digits as one
    digit = (codes >= 48) & (codes < 58)
    value = np.where(digit, 48, codes).astype(np.uint64)
    value[1:][digit[1:] & digit[:-1]] = 0
    some = value > 0
    rank = np.cumsum(some) - 1
    start = np.r_[0, ends[:-1] + 1]
    power = np.cumprod(np.full(int(length.max(initial=1)) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    term = np.where(some, value * power[np.minimum(rank - rank[start][line_no] + 1, len(power) - 1)], 0).astype(np.uint64)
    line_hash = np.add.reduceat(term, start)
    repeats = np.r_[False, (line_hash[1:] == line_hash[:-1])] & inked_lines
    owner = np.searchsorted(begin, ends, side="right") - 1
    per = lambda v: np.add.reduceat(np.r_[v, 0.0], begin)[: len(begin)] * (sizes > 0)
    wide = (codes > 0x2E7F).astype(np.float64)
    return np.stack(
        [
            per(ink * weight), per((literal & ink) * weight), per(((codes >= 48) & (codes < 58)) * weight),
            np.bincount(owner, weights=inked_lines & (length <= 200), minlength=len(begin)), np.bincount(owner, weights=inked_lines, minlength=len(begin)),
            per((~ink) * weight), per(wide), np.bincount(owner, weights=repeats, minlength=len(begin)),
        ],
        axis=1,
    )


def _block(texts: list[str], plain: bool = False) -> _Block:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    n = len(codes)
    breaks = codes == 10
    edge = breaks.copy()
    edge[begin[1:] - 1] = True
    edge[-1:] = True
    ends = np.flatnonzero(edge)
    length = np.diff(np.r_[-1, ends])
    weight = np.repeat(np.minimum(1.0, LINE / length).astype(np.float32), length)
    for t, b in zip(texts, begin) if not plain else ():
        for m in _MASK.finditer(t):
            a = t.rfind("\n", 0, m.start()) + 1
            z = t.find("\n", m.end())
            weight[b + a : b + (len(t) if z < 0 else z)] = 0
    if plain:
        return _Block(codes, codes, weight, begin, _statistics(codes, weight, begin, sizes, ends, length, edge))
    h = _SHAPE[codes]
    s5, g4 = h.copy(), codes.astype(np.uint32).copy()
    for k in range(1, 5):
        s5[: n - k] = s5[: n - k] * np.uint32(0x01000193) + h[k:]
    for k in range(1, 4):
        g4[: n - k] = g4[: n - k] * np.uint32(0x85EBCA6B) + codes[k:]
    mix = lambda x, m: ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - m)
    stats = _statistics(codes, weight, begin, sizes, ends, length, edge)
    tail = np.zeros(n, bool)
    for k in range(1, 5):
        z = begin + sizes - k
        tail[z[(z >= begin)]] = True
    weight = np.where(tail, 0, weight)
    return _Block(mix(s5, 11).astype(np.int32), mix(g4, 11).astype(np.int32) + SHAPES, weight, begin, stats)


def _blocks(texts: list[str], plain: bool = False, groups: np.ndarray | None = None) -> Iterator[tuple[int, int, _Block]]:
    """Blocks of about STRETCH characters; with `groups` (ascending), of one group each."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= STRETCH and (groups is None or groups[j] == groups[i])):
            size += len(texts[j])
            j += 1
        yield i, j, _block(texts[i:j], plain)
        i = j


_STATS = ("ink", "literals", "digits", "short_lines", "lines", "blanks", "wide", "repeats", "inserts", "blobs")


def _describe(weights: np.ndarray | None, plain: bool = False):
    """Per chunk: header flags, statistics, the weight of its n-grams, and unless `plain` either their scores or their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            texts = [t or "\n" for t in b.column("text").to_pylist()]  # every text has a character
            first = b.column("ord").to_pylist()
            kinds = [header_kinds(t) if not o else set() for t, o in zip(texts, first)]
            feet = [footer_kinds(t) for t in texts]
            stats, total, scores, at, n = [], [], [], [], []
            order = np.arange(len(texts))
            if weights is not None:  # texts of one fold together
                folds = np.array([fold_of(p) for p in b.column("project").to_pylist()])
                order = np.argsort(folds, kind="stable")
            texts_in = [texts[i] for i in order]
            for i, j, k in _blocks(texts_in, plain, None if weights is None else folds[order]):
                sizes = np.array([len(t) for t in texts_in[i:j]])
                per = lambda v: np.add.reduceat(np.concatenate([v, np.zeros((1, *v.shape[1:]), v.dtype)]), k.begin)[: j - i]  # noqa: E731, B023
                stats.append(k.stats)
                total.append(np.where(sizes > 0, per(k.weight.astype(np.float64)), 0))
                if plain:
                    continue
                if weights is not None:
                    own = weights[folds[order[i]]]
                    w = (own[k.shapes] + own[k.grams]) * k.weight[:, None]
                    scores.append(np.where(sizes[:, None] > 0, per(w), 0))
                else:
                    owner = np.repeat(np.arange(j - i), sizes)
                    key = np.r_[owner * TEXT + k.shapes, owner * TEXT + k.grams]
                    u, inv = np.unique(key, return_inverse=True)
                    c = np.bincount(inv, weights=np.r_[k.weight, k.weight])
                    for d in range(j - i):
                        a, z = np.searchsorted(u, (d * TEXT, (d + 1) * TEXT))
                        at.append((u[a:z] - d * TEXT).astype(np.int32))
                        n.append(c[a:z].astype(np.float32))
            back = np.argsort(order, kind="stable")
            stats, total = np.concatenate(stats)[back], np.concatenate(total)[back]
            out = {"project": b.column("project"), "path": b.column("path"), "ord": b.column("ord"), "chunk_id": b.column("chunk_id")}
            out |= {f"h_{k}": pa.array([k in x for x in kinds]) for k in ("generated", "third_party")}
            out |= {f"f_{k}": pa.array([k in x for x in feet]) for k in ("generated", "third_party")}
            inserts = [len(_INSERT.findall(t)) if "INSERT" in t or "insert" in t else 0 for t in texts]
            stats = np.column_stack([stats, inserts, [len(_BLOB.findall(t)) for t in texts]])
            out |= {s: pa.array(stats[:, i].astype(np.float64)) for i, s in enumerate(_STATS)}
            out["weight"] = pa.array(total)
            if plain:
                out["text"] = pc.if_else(b.column("keep"), b.column("text"), pa.scalar(None, b.column("text").type))
            elif weights is not None:
                scores = np.concatenate(scores)[back].astype(np.float64)
                out |= {f"s{i}": pa.array(scores[:, i]) for i in range(len(KINDS))}
            else:
                out |= {"at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(n, pa.list_(pa.float32()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


_CHUNK = "project string, path string, ord int, chunk_id long, h_generated boolean, h_third_party boolean, f_generated boolean, f_third_party boolean, " + ", ".join(f"{s} double" for s in _STATS) + ", weight double"


def _texts(chunks: DataFrame) -> DataFrame:
    return spread(chunks.select("project", "path", "ord", "chunk_id", "text")).select("project", "path", F.coalesce("ord", F.lit(1)).alias("ord"), "chunk_id", F.coalesce("text", F.lit("")).alias("text"))


def _per_file(described: DataFrame, extra: list[str]) -> DataFrame:
    """Sums over the distinct chunks of a file; two steps, both map-side combined."""
    sums, marks, feet = [*_STATS, "weight", *extra], ("h_generated", "h_third_party"), ("f_generated", "f_third_party")
    one = described.groupBy("project", "path", "ord", "chunk_id").agg(*[F.max(c).alias(c) for c in (*marks, *feet, *sums)])
    # a footer counts in the last chunk only
    return one.groupBy("project", "path").agg(*[F.max(c).alias(c) for c in marks], *[F.max_by(c, F.struct("ord", "chunk_id")).alias(c) for c in feet], *[F.sum(c).alias(c) for c in sums])


def _label(files: DataFrame) -> DataFrame:
    """`files` (per-file statistics and path) with `header`, the kind that a header or footer names, and
    `label`, for training only: the kind that the path names or extreme statistics show, '' for a file
    with nothing but a header (which is left out), NULL without any sign."""
    kind = F.pandas_udf(_path_kinds, "string")
    code = ~F.lower("path").rlike(r"\.(md|markdown|rst|txt|adoc)$") & (F.col("ink") > 0)
    per = lambda c: F.col(c) / F.greatest(F.col("ink"), F.lit(1.0))
    lines = F.col("lines") + 4.0  # a few lines prove little
    # nearly all digits and separators of literals, or nearly no words between them
    data = code & ((per("digits") > 0.45) | ((per("digits") > 0.3) & (per("literals") > 0.5)) | ((F.col("inserts") + F.col("blobs")) / lines > 0.5))
    small = code & (F.col("short_lines") <= 0.5 * F.col("lines")) & (per("blanks") < 0.08) & (per("wide") < 0.05)
    repeated = code & (F.col("repeats") / lines > 0.55)
    by_path = kind("path")
    header = F.when(F.col("h_generated") | F.col("f_generated"), "generated").when(F.col("h_third_party") | F.col("f_third_party"), "third_party")
    told = F.when(by_path.isNotNull(), by_path).when(data, "data").when(repeated, "generated").when(small, "minified")
    return files.withColumn("header", header).withColumn("label", F.coalesce(told, F.when(F.col("header").isNotNull(), "")))


def _path_kinds(paths):
    return paths.map(path_kind, na_action=None)


@dataclass
class Classifiers:
    """For each fold what the other folds gave: weights (folds, WIDTH, kinds) for n-gram sums divided by
    their weight plus PRIOR and for path features, biases and thresholds (folds, kinds). `validation` has
    (kind, true positives, false positives, missed, files) on all folds, each held out."""

    weights: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray
    validation: list[tuple[str, int, int, int, int]]


def _svm(x: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int = 200, c: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Linear classifiers with squared hinge loss, one a column of y (+1, -1), by accelerated gradient steps.

    x: dense text features; at: places of the path features of each row, padded by PATHS, each of PATH_VALUE.
    """
    n, d, k = len(x), x.shape[1], y.shape[1]
    share = np.maximum((y > 0).mean(0), 1.0 / n)
    cost = np.where(y > 0, 0.5 / share, 0.5 / np.maximum(1 - share, 1.0 / n)).astype(np.float32) * c / n

    def times(w: np.ndarray) -> np.ndarray:
        return x @ w[:d] + PATH_VALUE * w[d:][at].sum(1)

    def back(s: np.ndarray) -> np.ndarray:
        flat = at.ravel()
        paths = np.stack([np.bincount(flat, weights=np.repeat(s[:, i], at.shape[1]), minlength=PATHS + 1) for i in range(s.shape[1])], 1)
        paths[PATHS] = 0  # the padding
        return np.concatenate([x.T @ s, PATH_VALUE * paths.astype(np.float32)])

    w, b = np.zeros((d + PATHS + 1, k), np.float32), np.zeros(k, np.float32)
    vw, vb, t = w.copy(), b.copy(), 1.0
    v = np.random.default_rng(3).standard_normal((len(w), 1)).astype(np.float32)
    v[-1] = 0
    for _ in range(15):  # the largest curvature, by power iteration
        v = back(times(v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1.0 / (1.0 + 2 * float(cost.max()) * float(np.linalg.norm(times(v)) ** 2 + n))
    for _ in range(rounds):
        slack = (np.maximum(0, 1 - y * (times(vw) + vb)) * cost * -2 * y).astype(np.float32)
        nw, nb = vw - step * (vw + back(slack)), vb - step * slack.sum(0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w[:-1], b


#: Files whose sums a task holds at once.
HELD = 256


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, n) with the rows of each file summed, as far as they come together."""
    sums: dict[int, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        at = [np.flatnonzero(v).astype(np.int32) for v in sums.values()]
        n = [v[a] for v, a in zip(sums.values(), at)]
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((list(sums), at, n), kinds)], names=["file", "at", "n"])

    for b in batches:
        at, n = b.column("at"), b.column("n")
        o, flat, values = at.offsets.to_numpy(), at.values.to_numpy(), n.values.to_numpy()
        shift = n.offsets.to_numpy()[0] - o[0]
        for i, f in enumerate(b.column("file").to_pylist()):
            if f not in sums:
                if len(sums) >= HELD:
                    yield rows()
                    sums.clear()
                sums[f] = np.zeros(TEXT, np.float32)
            sums[f][flat[o[i] : o[i + 1]]] += values[o[i] + shift : o[i + 1] + shift]  # a row has a place once
    if sums:
        yield rows()


def fit(labelled: DataFrame, chunks: DataFrame, sample: int = SAMPLE) -> Classifiers | None:
    """Classifiers from at most `sample` files with and `sample` without a label, those of the smallest hash.

    chunks: those of the files that may be chosen. n-grams are counted per file on the executors, so the
    driver gets at most 2 x sample rows of TEXT numbers, however long the files are. A fold's weights
    come from the other folds; its thresholds from margins of the other folds' files, each given by
    weights that its own fold had no part in. None without a labelled file.
    """
    spark = labelled.sparkSession
    h = F.xxhash64("project", "path")
    keys = labelled.where("label is null or label <> ''").select("project", "path", "label")
    n = {r["told"]: r["n"] for r in keys.groupBy(F.col("label").isNotNull().alias("told")).agg(F.count(F.lit(1)).alias("n")).collect()}
    some = lowest(keys.where("label is not null"), h, sample, n.get(True, 0)).unionByName(lowest(keys.where("label is null"), h, sample, n.get(False, 0))).collect()
    if not any(r["label"] for r in some):
        return None
    label = {(r["project"], r["path"]): r["label"] for r in some}
    chosen = F.broadcast(spark.createDataFrame([(r["project"], r["path"], i) for i, r in enumerate(some)], "project string, path string, file int"))  # at most 2 x sample rows
    rows = _texts(chunks.join(chosen.drop("file"), ["project", "path"], "left_semi")).dropDuplicates(["project", "path", "ord", "chunk_id"]).mapInArrow(_describe(None), f"{_CHUNK}, at array<int>, n array<float>")
    # summed where the chunks are, then a row a file and task is left to be brought together
    parts = rows.join(chosen, ["project", "path"]).select("file", "at", "n").mapInArrow(_combined, "file int, at array<int>, n array<float>")
    packed = parts.groupBy("file").applyInArrow(lambda t: pa.Table.from_batches(list(_combined(t.combine_chunks().to_batches()))), "file int, at array<int>, n array<float>")
    x = np.zeros((len(label), TEXT), np.float32)
    for b in packed.toArrow().to_batches():
        at, v = b.column("at"), b.column("n")
        o = at.offsets.to_numpy()
        row = np.repeat(b.column("file").to_numpy(), np.diff(o))
        x[row, at.values.to_numpy()[o[0] : o[-1]]] = v.values.to_numpy()[o[0] : o[-1]]
    x /= x[:, :SHAPES].sum(1, keepdims=True) + PRIOR
    parts = [[p - TEXT for p in _path_features(k[1])] for k in label]
    at = np.full((len(parts), max(map(len, parts))), PATHS)
    for i, p in enumerate(parts):
        at[i, : len(p)] = p
    y = np.array([[1 if v == k else -1 for k in KINDS] for v in label.values()], np.float32)
    fold = np.array([fold_of(p) for p, _ in label])
    scale = ((np.sqrt((x * x).mean(0)) + 2e-5) * TEXT_SCALE).astype(np.float32)
    x /= scale
    margin, truth = np.full_like(y, -np.inf), y > 0
    weights, bias = np.zeros((FOLDS, WIDTH, len(KINDS)), np.float32), np.full((FOLDS, len(KINDS)), -1.0)
    for k in range(FOLDS):
        held = fold == k
        if (~held).any():
            w, b = _svm(x[~held], at[~held], y[~held])
            weights[k, :TEXT], weights[k, TEXT:], bias[k] = w[:TEXT] / scale[:, None], w[TEXT:] * PATH_VALUE, b
            padded = np.concatenate([w[TEXT:], np.zeros((1, len(KINDS)), np.float32)])
            margin[held] = x[held] @ w[:TEXT] + PATH_VALUE * padded[at[held]].sum(1) + b
    thresholds = np.array([[_threshold(margin[fold != k, i], truth[fold != k, i]) for i in range(len(KINDS))] for k in range(FOLDS)])
    guess = margin > thresholds[fold]
    validation = [(k, int((guess[:, i] & truth[:, i]).sum()), int((guess[:, i] & ~truth[:, i]).sum()), int((~guess[:, i] & truth[:, i]).sum()), len(y)) for i, k in enumerate(KINDS)]
    return Classifiers(weights, bias, thresholds, validation)


def _threshold(margin: np.ndarray, truth: np.ndarray) -> float:
    """The margin above which precision and recall are best together (their F measure, precision counting double);
    half-way to the next lower margin, so that it isn't drawn to a single file."""
    order = np.argsort(-margin, kind="stable")
    hits, n, all_true = np.cumsum(truth[order]), np.arange(1, len(order) + 1), max(int(truth.sum()), 1)
    score = 1.25 * hits / (0.25 * all_true + n)
    if not len(order) or not hits[-1]:
        return float("inf")
    best = int(score.argmax())
    below = margin[order[best + 1]] if best + 1 < len(order) else margin[order[best]] - 1
    return float((margin[order[best]] + below) / 2)


def classify(files: DataFrame, chunks: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Classifiers | None]:
    """(file_id, project, path, kind, told_by, margin): a row per file_id; kind is NULL for hand-written files.

    A file is of the kind whose classifier's margin exceeds its threshold most (told_by 'classifier');
    `margin` is that excess. Of the files that no classifier claims, those with a header or footer by
    which tools and people mark such files are of the kind it names (told_by 'header'). Files without
    any text leave nothing to classify; a well-known folder or suffix names their kind (told_by 'path').
    Repeated rows count once; NULL texts are empty; empty tables give
    an empty result.
    """
    known = files.groupBy("file_id").agg(F.max(F.struct("project", "path")).alias("k")).select("file_id", "k.project", "k.path")
    # one pass over the texts for the statistics; it also keeps the chunks that the sample is taken of
    total = max(files.count(), 1)
    may = F.xxhash64("project", "path") <= min((1 << 63) - 1, int(-(1 << 63) + KEPT / total * (1 << 64)))
    plain = staged(_texts(chunks).withColumn("keep", may).mapInArrow(_describe(None, plain=True), _CHUNK + ", text string"), "plain")
    labelled = _label(staged(_per_file(plain, []), "statistics"))
    model = fit(labelled.where(may), plain.where("text is not null"), sample)
    weights = np.zeros((FOLDS, WIDTH, len(KINDS)), np.float32) if model is None else model.weights
    bias = np.full((FOLDS, len(KINDS)), -1.0) if model is None else model.bias
    least = np.full((FOLDS, len(KINDS)), 1e9) if model is None else np.minimum(model.thresholds, 1e9)
    s = [f"s{i}" for i in range(len(KINDS))]
    scored = _per_file(_texts(chunks).mapInArrow(_describe(weights), _CHUNK + "".join(f", {c} double" for c in s)), s)
    every = _label(known.join(scored, ["project", "path"], "left").fillna(0.0, [*_STATS, "weight", *s]))
    # what a path and the thresholds of its fold add to each kind's margin
    part = F.pandas_udf(_path_scores(weights, bias - least), "array<double>")
    every = every.withColumn("_p", part(F.coalesce("project", F.lit("")), F.coalesce("path", F.lit(""))))
    best = F.greatest(*[F.struct((F.col(c) / (F.col("weight") + PRIOR) + F.col("_p")[i]).alias("m"), F.lit(k).alias("k")) for i, (c, k) in enumerate(zip(s, KINDS))])
    every = every.withColumn("_b", best)
    found = F.when((F.col("_b.m") > 0) & (F.col("ink") > 0), F.col("_b.k"))
    by_path = F.when(F.col("ink") == 0, F.pandas_udf(_path_kinds, "string")("path"))
    return every.select(
        "file_id", "project", "path", F.coalesce(found, "header", by_path).alias("kind"),
        F.when(found.isNotNull(), "classifier").when(F.col("header").isNotNull(), "header").when(by_path.isNotNull(), "path").alias("told_by"), F.round("_b.m", 6).alias("margin"),
    ), model


def _path_scores(weights: np.ndarray, offset: np.ndarray):
    def run(projects, paths):
        return paths.__class__([(weights[f][_path_features(p)].sum(0) + offset[f]).astype(float).tolist() for f, p in zip(map(fold_of, projects), paths)], index=paths.index, dtype=object)

    run.__annotations__ = {"projects": pd.Series, "paths": pd.Series, "return": pd.Series}
    return run


def validation_report(spark: SparkSession, model: Classifiers | None) -> DataFrame:
    """Precision and recall of each classifier against the labels, on repositories that neither trained it nor set its threshold."""
    rows = [] if model is None else [(k, f, t + m, t / (t + w) if t + w else None, t / (t + m) if t + m else None) for k, t, w, m, f in model.validation]
    return spark.createDataFrame(rows, "kind string, files int, labelled int, precision double, recall double")
