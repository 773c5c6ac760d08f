"""Path predicates and labels as Columns."""

from __future__ import annotations

import fnmatch
import json
import hashlib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions import fixed


def glob_regex(glob: str) -> str:
    """A glob as a Java pattern for the whole string: `*` spans `/`, case matters."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + (i < len(glob) and glob[i] == "!")
            j += j < len(glob) and glob[j] == "]"
            end = glob.find("]", j)
            if end < 0:
                out += "\\["
                continue
            inside = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + inside[1:] if inside.startswith("!") else "\\" + inside if inside.startswith("^") else inside) + "]"
            i = end + 1
        else:
            out += "\\" + c if not (c.isalnum() or c in "_/ ") else c
    return rf"(?s)^(?:{out})\z"


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    """Whether the path, or the path and a closing slash, matches any glob."""
    pattern = "|".join(glob_regex(g) for g in globs)
    if not pattern:
        return F.lit(False)
    return path.rlike(pattern) | F.concat(path, F.lit("/")).rlike(pattern)


def _name_matches(name: Column, globs: Iterable[str]) -> Column:
    return name.rlike("|".join(glob_regex(g) for g in globs))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last suffix with its dot; '' for names that only begin with one or end in one."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1)


def lang_of(path: Column) -> Column:
    """The language of a path by its name, else by its suffix, else ''."""
    names = F.create_map(*[F.lit(x) for kv in fixed.NAME_LANGUAGE.items() for x in kv])
    suffixes = F.create_map(*[F.lit(x) for kv in fixed.SUFFIX_LANGUAGE.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(basename(path))), F.try_element_at(suffixes, F.lower(suffix(path))), F.lit(""))


def in_ignored_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(d) for d in fixed.IGNORE_DIRS]))


def is_ignored_name(path: Column) -> Column:
    return F.lower(basename(path)).isin(list(fixed.IGNORE_NAMES))


def is_secret(path: Column) -> Column:
    name = F.lower(basename(path))
    return ~_name_matches(name, fixed.SECRET_EXEMPT) & (name.isin(list(fixed.SECRET_NAMES)) | _name_matches(name, fixed.SECRET_GLOBS))


def is_image(path: Column) -> Column:
    return F.lower(suffix(path)).isin(list(fixed.IMAGE_SUFFIXES))


def is_binary_suffix(path: Column) -> Column:
    return F.lower(suffix(path)).isin(list(fixed.BINARY_SUFFIXES))


def looks_binary(content: Column) -> Column:
    """A NUL byte among the first bytes."""
    return F.contains(F.hex(F.substring(content, 1, fixed.SNIFF_BYTES)).cast("string"), F.lit("00")) & F.hex(F.substring(content, 1, fixed.SNIFF_BYTES)).rlike("^(?:..)*00")


def indexable(path: Column, exclude: Iterable[str] = (), include: Iterable[str] = (), defaults: bool = True) -> Column:
    """Whether a path takes part: `include` wins back what `exclude` takes, nothing else."""
    out = ~(matches_any(path, exclude) & ~matches_any(path, include)) & ~is_secret(path) & ~is_image(path) & ~is_binary_suffix(path)
    if defaults:
        out = out & ~in_ignored_dir(path) & ~is_ignored_name(path) & ~matches_any(path, fixed.DEFAULT_IGNORES)
    return F.coalesce(out, F.lit(False))


def ancestors(path: Column) -> Column:
    """The path and all folders above it, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def store_key(path: Column) -> Column:
    return F.concat(basename(path), F.lit("-"), F.substring(F.sha2(path, 256), 1, 16))


def within(path: Column, root: Column) -> Column:
    """Whether `path` is `root` or lies under it."""
    return (path == root) | F.startswith(path, F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))


def uri_path(uri: Column) -> Column:
    """The path of a file URI, percent-decoded; a plus sign stays one."""
    return F.url_decode(F.replace(F.parse_url(uri, F.lit("PATH")), F.lit("+"), F.lit("%2B")))


def matches_glob(path: str, globs: Iterable[str]) -> bool:
    """`matches_any` for one path on the driver."""
    return any(fnmatch.fnmatchcase(p, g) for p in (path, path + "/") for g in globs)


#: Roots that are never indexed themselves, and trees of which nothing is.
FORBIDDEN_ROOTS = ("/", "/tmp")
FORBIDDEN_TREES = ("/var", "/usr", "/etc", "/proc", "/sys", "/dev")


def is_forbidden_root(root: str) -> bool:
    p, home = Path(root), Path.home()
    trees = [Path(t) for t in FORBIDDEN_TREES] + [home / d for d in (".cache", ".local", ".config")]
    return p == home or str(p) in FORBIDDEN_ROOTS or any(p == t or t in p.parents for t in trees)


def config_signature(exclude: Iterable[str], include: Iterable[str], respect_gitignore: bool, use_default_ignores: bool) -> str:
    """A digest of what decides which files are indexed; the order of patterns doesn't matter."""
    what = {"exclude": sorted(exclude), "include": sorted(include), "respect_gitignore": respect_gitignore, "use_default_ignores": use_default_ignores}
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()[:16]
