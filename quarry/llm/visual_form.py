"""Problem 2: one consistent form for texts that look the same.

Compatibility normalisation to composed form, removal of default-ignorable
characters, mapped white space and hyphens, and look-alike letters of another
alphabet brought to the alphabet of their word. The form keeps case, since a
reader sees it; beside it stands its full case folding, for comparisons that
ignore case.

Superscripts, subscripts, fractions and circled characters stay: a reader can
tell them from plain digits and letters. Null texts have no form (null), the
empty text has the empty form.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernel as K

# Letters that look alike, by alphabet, beside their Latin twins.
CYRILLIC, CYRILLIC_LATIN = "аеорсухіјѕһԁԛԝѵАВЕКМНОРСТУХІЈЅԌԚԜ", "aeopcyxijshdqwvABEKMHOPCTYXIJSGQW"
GREEK, GREEK_LATIN = "οναΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳ", "ovaABEZHIKMNOPTYXj"
# Kinds of hyphen that look like "-", and of white space.
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63\uff0d"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

SALTS = 8  #: parts of the rows of one text

_IGNORABLES = r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U000e0000-\U000e0fff"
_IGNORABLE = re.compile(f"[{_IGNORABLES}]")
_TOUCHED = re.compile(rf"[{_IGNORABLES}{re.escape(HYPHENS + SPACES)}\r\u0085\u2028\u2029\u0370-\u052f]")
_MAP = {ord(c): "-" for c in HYPHENS} | {ord(c): " " for c in SPACES} | {0x2028: "\n", 0x2029: "\n", 0x85: "\n"}
_TO_LATIN = {ord(a): b for a, b in zip(CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN, strict=True)}
_TO_CYRILLIC = {ord(b): a for a, b in zip(CYRILLIC, CYRILLIC_LATIN, strict=True)}
_TO_GREEK = {ord(b): a for a, b in zip(GREEK, GREEK_LATIN, strict=True)}
_FOREIGN = re.compile(r"[^\W\d_]*[Ͱ-ԯ][^\W\d_]*")
_KEPT = re.compile("([" + "".join(re.escape(chr(c)) for c in range(0x80, 0x3400) if unicodedata.decomposition(chr(c)).startswith(("<super>", "<sub>", "<fraction>", "<circle>", "<square>"))) + "]+)")
_LATIN_LETTER = re.compile(r"[A-Za-zÀ-ɏ]")


def _word(latin_text: bool):
    def fix(m: re.Match) -> str:
        w = m[0]
        own = [c for c in w if "Ͱ" <= c <= "ԯ"]
        true = [c for c in own if ord(c) not in _TO_LATIN]
        if not true and (latin_text or len(own) < len(w)):
            return w.translate(_TO_LATIN)
        if true and len(own) < len(w):
            return w.translate(_TO_CYRILLIC if true[0] >= "Ѐ" else _TO_GREEK)
        return w

    return fix


def form(text: str) -> str:
    """The consistent form of one text."""
    if text.isascii() and "\r" not in text:
        return text
    if not _TOUCHED.search(text) and unicodedata.is_normalized("NFKC", text):
        return text
    t = _IGNORABLE.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    t = "".join(p if i % 2 else unicodedata.normalize("NFKC", p) for i, p in enumerate(_KEPT.split(t.translate(_MAP))))
    t = unicodedata.normalize("NFC", t.translate(_MAP))
    foreign = sum(map(len, _FOREIGN.findall(t)))
    return _FOREIGN.sub(_word(2 * foreign < len(_LATIN_LETTER.findall(t)) + foreign), t) if foreign else t


def look(text: str) -> str:
    """What a reader sees: the form with all look-alike letters as Latin ones. Equal for texts that look the same."""
    t = form(text)
    return t if t.isascii() else t.translate(_TO_LATIN)


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _once(f, values: pd.Series) -> pd.Series:
    """f per distinct value of the batch; nulls stay."""
    known = {v: f(v) for v in values.dropna().unique()}
    return pd.Series([known.get(v) if isinstance(v, str) else None for v in values], index=values.index, dtype=object)


def folded(text: str) -> str:
    """The full case folding of the form, composed again."""
    return unicodedata.normalize("NFC", form(text).casefold())


def with_form(df: DataFrame, col: str = "content", to: str = "form", fold_to: str | None = None) -> DataFrame:
    """df and a column of consistent forms, and of case-folded ones where fold_to names it; nulls stay null. Existing columns of these names are replaced."""

    @F.pandas_udf("string")
    def forms(s: pd.Series) -> pd.Series:
        return _once(form, s)

    @F.pandas_udf("string")
    def folds(s: pd.Series) -> pd.Series:
        return _once(folded, s)

    out = {to: forms(F.col(col))}
    if fold_to:
        out[fold_to] = folds(F.col(col))
    return df.withColumns(out)


def form_keys(df: DataFrame, row_id: str, col: str) -> DataFrame:
    """row_id, and 128-bit keys of the text and of what a reader sees of it. Null texts drop out."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"row_id": b.row_id, "raw": _once(digest, b.text), "seen": _once(lambda t: digest(look(t)), b.text)})

    src = df.select(F.col(row_id).cast("string").alias("row_id"), F.col(col).alias("text")).where("text IS NOT NULL AND row_id IS NOT NULL")
    return src.mapInPandas(keys, "row_id string, raw string, seen string")


def look_alikes(df: DataFrame, row_id: str, col: str) -> DataFrame:
    """Pairs of rows whose texts differ in their characters but look the same: row_id_1 < row_id_2.

    Keys alone are shuffled. Pairs are formed of distinct texts, so copies of
    one text meet nobody; the rows of either text come to its pairs afterwards,
    in SALTS parts, so no task holds all copies of a text.
    """
    keys = K.checkpointed(df.sparkSession, form_keys(df, row_id, col).distinct())
    mixed = keys.groupBy("seen").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("seen")
    few = keys.join(mixed, "seen", "left_semi").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    texts = few.select("seen", "raw").distinct()
    pairs = texts.withColumnRenamed("raw", "a").join(texts.withColumnRenamed("raw", "b"), "seen").where("a < b").select("a", "b")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = pairs.select("a", "b", salts.alias("salt")).join(few.select(F.col("raw").alias("a"), "salt", F.col("row_id").alias("x")), ["a", "salt"])
    both = left.join(few.select(F.col("raw").alias("b"), F.col("row_id").alias("y"), salts.alias("salt")), ["b", "salt"])
    return both.where("x <> y").select(F.least("x", "y").alias("row_id_1"), F.greatest("x", "y").alias("row_id_2")).distinct()
