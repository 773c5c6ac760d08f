"""Bringing visually identical text to one form.

Two forms. The canonical one is text to work on: compatibility form, blanks and line ends mapped,
ignorables removed, case folded, and look-alike letters put right where they stand in words of another
script; words of one script stay what they are. The visual one is only a key to compare by: what looks
the same has the same key, so there every look-alike letter counts as the letter it looks like.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import spread

# Letters of Greek and Cyrillic whose usual shape is that of a Latin letter, in pairs; they
# come before the Unicode confusables data, which lack a few of them.
LOOK_ALIKE = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "α": "a",
    "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    # Armenian and Latin forms
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ɡ": "g", "ı": "i", "ɑ": "a",
}

#: Decompositions that change how a character looks on screen; such characters stay as they are in the visual form.
_VISIBLE_TAGS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<font>")
_JOINER, _KEPT = "\u200d", "\ue000"


def _ignorable(cp: int) -> bool:
    """Default_Ignorable_Code_Point, by rule: format characters that show nothing, fillers, selectors."""
    if cp in (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0xFEFF):
        return True
    return (
        0x180B <= cp <= 0x180F or 0x200B <= cp <= 0x200F or 0x202A <= cp <= 0x202E or 0x2060 <= cp <= 0x206F
        or 0xFE00 <= cp <= 0xFE0F or 0xFFF0 <= cp <= 0xFFF8 or 0x1BCA0 <= cp <= 0x1BCA3 or 0x1D173 <= cp <= 0x1D17A
        or 0xE0000 <= cp <= 0xE0FFF
    )


def _pictograph(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk") or c == "\ufe0f"


@functools.lru_cache(maxsize=1)
def _candidates() -> list[str]:
    """Letters that may look like a Latin one: all but those of ASCII, of Latin script and ideographs."""
    out = []
    for cp in range(0x80, 0x20000):
        c = chr(cp)
        if unicodedata.category(c) in ("Lu", "Ll", "Lo") and not unicodedata.name(c, "LATIN").startswith(("LATIN", "CJK", "HANGUL", "FULLWIDTH", "MATHEMATICAL")):
            out.append(c)
    return out


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letter -> the ASCII letter that it looks like, from the Unicode confusables data of the ICU library
    that Spark brings along (its version is that of `unicode_version`), for letters of all other scripts.

    The data has one prototype for each class of characters that look alike; the letter is the class's
    ASCII letter of the same case. LOOK_ALIKE comes before it. Without the library it is an error, as
    LOOK_ALIKE alone has far fewer letters.
    """
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except Exception as e:
        raise RuntimeError("the confusables data can't be had: the ICU library of Spark (com.ibm.icu) is missing or broken") from e
    ascii_letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    asked = ascii_letters + _candidates()
    shapes = checker.getSkeleton("\n".join(asked)).split("\n")  # one call for all
    if len(shapes) != len(asked):
        raise RuntimeError(f"the ICU library gave {len(shapes)} shapes for {len(asked)} letters")
    of: dict[str, dict[bool, str]] = {}
    for c, shape in zip(ascii_letters, shapes):
        of.setdefault(shape, {})[c.isupper()] = c
    out = {}
    for c, shape in zip(asked[52:], shapes[52:]):
        members = of.get(shape, {})
        letter = members.get(not c.islower()) or members.get(c.isupper())
        if letter:
            out[c] = letter
    return out | LOOK_ALIKE


def unicode_version(spark: SparkSession) -> str | None:
    """The version of the Unicode data that `confusables` reads."""
    try:
        return spark._jvm.com.ibm.icu.lang.UCharacter.getUnicodeVersion().toString()
    except Exception:  # noqa: BLE001
        return None


class Forms:
    """The forms of texts by one table of look-alike letters; the per-character tables fill by rule as characters turn up."""

    def __init__(self, look_alike: Mapping[str, str] = LOOK_ALIKE) -> None:
        self.look_alike = dict(look_alike)
        self._plain, self._shown = _Table({}, False), _Table(self.look_alike, True)
        self._any = re.compile("[" + "".join(map(re.escape, self.look_alike)) + "]")
        #: Letters of which both cases look like the two cases of one letter.
        self._both = {
            c for c, to in self.look_alike.items()
            if len(c.upper()) == len(c.lower()) == 1 and self.look_alike.get(c.upper(), "?").lower() == self.look_alike.get(c.lower(), "!").lower() == to.lower()
        }

    def __reduce__(self):
        return Forms, (self.look_alike,)

    def visual(self, text: str) -> str:
        """What shows of a text: case counts, and characters whose compatibility form looks otherwise
        (superscripts, fractions, circled) stay."""
        text = _line_ends(text)
        return text if text.isascii() else _composed(text, self._shown)

    def canonical(self, text: str) -> str:
        text = _line_ends(text)
        if text.isascii():
            return text.lower()
        text = _composed(text, self._plain)
        if self._any.search(text):
            text = self._put_right(text)
        folded = text.casefold()
        return folded if folded.isascii() else unicodedata.normalize("NFKC", folded)

    def _put_right(self, text: str) -> str:
        """Look-alike letters in words that hold Latin letters too, and in words of nothing but letters
        of which both cases look alike if the text has no real word of their script."""
        words = _WORD.findall(text)
        scripts = {_script(c) for w in words for c in w if c.isalpha() and not c.isascii() and c not in self._both and "LATIN" not in {_script(x) for x in w if x.isalpha()}}

        def one(m: re.Match) -> str:
            w = m.group()
            if w.isascii():
                return w
            letters = [c for c in w if c.isalpha()]
            mixed = any(_script(c) == "LATIN" for c in letters)
            if not mixed and not (letters and all(c in self._both and _script(c) not in scripts for c in letters)):
                return w
            return "".join(self.look_alike.get(c, c) for c in w)

        return _WORD.sub(one, text)


_WORD = re.compile(r"\w+")


@functools.lru_cache(maxsize=65536)
def _script(c: str) -> str:
    """The first word of a character's name, which for letters is their script."""
    return "LATIN" if c.isascii() else unicodedata.name(c, "?").split(" ")[0].split("-")[0]


class _Table(dict):
    """A translation table that is filled by rule as characters turn up."""

    def __init__(self, look_alike: Mapping[str, str], visual: bool) -> None:
        self.look_alike, self.visual = look_alike, visual

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        if _ignorable(cp):
            out = ""
        elif unicodedata.category(c) == "Zs":
            out = " "
        elif cp in (0x85, 0x2028, 0x2029):
            out = "\n"
        elif cp in (0x2010, 0x2011):  # hyphens, one of them without a break
            out = "-"
        elif self.visual and unicodedata.decomposition(c).startswith(_VISIBLE_TAGS):
            out = c
        else:
            out = "".join(self.look_alike.get(x, x) for x in unicodedata.normalize("NFKD", c))
        self[cp] = out
        return out


def _line_ends(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _composed(text: str, table: _Table) -> str:
    return unicodedata.normalize("NFC", _keep_joiners(text).translate(table)).replace(_KEPT, _JOINER)


def _keep_joiners(text: str) -> str:
    """Mark the joiners between two pictographs, which do show, with a private character."""
    if _JOINER not in text:
        return text
    out = list(text)
    for i, c in enumerate(out):
        if c == _JOINER and 0 < i < len(out) - 1 and _pictograph(text[i - 1]) and _pictograph(text[i + 1]):
            out[i] = _KEPT
    return "".join(out)


BASIC = Forms()


def canonical(text: str | None, fold: bool = True, forms: Forms = BASIC) -> str | None:
    """The one form of a text. NULL stays NULL, '' stays ''.

    With `fold` the canonical form: compatibility form composed, every blank to a space and every line
    end to a line feed, default-ignorable characters removed (a joiner between two pictographs stays:
    it changes the picture), look-alike letters of other scripts replaced in words of mixed script,
    full case folding. A word of one script keeps its letters, so texts that differ in case alone
    have one form. Without `fold` the visual form, for comparisons.
    """
    if text is None:
        return None
    return forms.canonical(text) if fold else forms.visual(text)


@functools.lru_cache(maxsize=1)
def _invisible() -> frozenset:
    return frozenset(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace() or unicodedata.category(chr(i)) in ("Cc", "Cf", "Zs", "Zl", "Zp") or _ignorable(i))


def shows(text: str) -> bool:
    """Whether anything of the text is visible."""
    stripped = text.strip()
    return bool(stripped) and (stripped[0].isalnum() or not all(c in _invisible() for c in stripped))


def _forms_of(values: pa.Array, of) -> tuple[pa.Array, pa.Array]:
    """(forms, plain) of distinct values: ASCII ones by Arrow functions (`plain`), the others by `of` one by one."""
    plain = pc.fill_null(pc.string_is_ascii(values), True)
    ends = pc.replace_substring(pc.replace_substring(values, "\r\n", "\n"), "\r", "\n")
    other = pa.array([of(x) for x in values.filter(pc.invert(plain)).to_pylist()], pa.string())
    return pc.replace_with_mask(ends, pc.invert(plain), other), plain


def normalise_texts(df: DataFrame, column: str = "text", into: str = "canonical", fold: bool = True) -> DataFrame:
    """`df` with the canonical form of `column` in `into` (replaced if it exists), worked out once per distinct value of a batch."""
    schema = df.withColumn(into, F.col(column).cast("string")).schema
    forms = Forms(confusables(df.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column(column).dictionary_encode()
            made, plain = _forms_of(d.dictionary, lambda x: canonical(x, fold, forms))
            if fold:
                made = pc.if_else(plain, pc.ascii_lower(made), made)
            arrays = {n: b.column(n) for n in b.schema.names} | {into: made.take(d.indices)}
            yield pa.RecordBatch.from_arrays([arrays[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def _keys(forms: Forms):
    digest = lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column("text").dictionary_encode()
            made, _ = _forms_of(d.dictionary, forms.visual)
            memo: list[tuple[bytes, bytes] | None] = []
            for t, form in zip(d.dictionary.to_pylist(), made.to_pylist()):
                raw = digest(t)
                memo.append(None if not shows(form) else (raw, raw) if form == t else (digest(form), raw))
            ids, keys, texts = [], [], []
            for i, k in zip(b.column("doc_id").to_pylist(), d.indices.to_pylist()):
                if k is not None and memo[k]:
                    ids.append(i)
                    keys.append(memo[k][0])
                    texts.append(memo[k][1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "form", "raw"])

    return run


def _keyed(documents: DataFrame) -> DataFrame:
    forms = Forms(confusables(documents.sparkSession))
    return spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text")).mapInArrow(_keys(forms), "doc_id long, form binary, raw binary")


def look_alikes(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents whose texts differ but have one visual form.

    NULL, empty and invisible texts give no pair, nor do exact copies of one text. Only digests are
    shuffled. Texts are paired first, one row per distinct text, then their documents joined, so the
    work of a group of copies is the size of its result. Rows with a NULL doc_id are left out.
    """
    keys = _keyed(documents)
    # forms with more than one text: the first shuffle holds two digests a distinct text after map-side combining
    several = keys.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    members = keys.join(several, "form").distinct()
    variants = members.select("form", "raw").distinct()
    pairs = variants.select("form", F.col("raw").alias("ra")).join(variants.select("form", F.col("raw").alias("rb")), "form").where("ra < rb")
    a = members.select("form", F.col("raw").alias("ra"), F.col("doc_id").alias("a"))
    b = members.select("form", F.col("raw").alias("rb"), F.col("doc_id").alias("b"))
    both = pairs.join(a, ["form", "ra"]).join(b, ["form", "rb"]).where("a <> b")
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def look_alike_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, variants, links): a row per document with a look-alike, instead of all pairs.

    class_id is the smallest doc_id of one visual form, `variants` its number of different texts, and
    `links` the number of documents that look like this one with another text.
    """
    keys = _keyed(documents).distinct()
    texts = keys.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"))
    forms = texts.groupBy("form").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("all"), F.min("lo").alias("class_id")).where("variants > 1")
    sized = texts.join(forms, "form").select("form", "raw", "class_id", "variants", (F.col("all") - F.col("n")).alias("links"))
    return keys.join(sized, ["form", "raw"]).select("doc_id", "class_id", "variants", "links")
