"""Text normalisers. Each one feeds other comparisons, so they stay apart (clean, fold, fold_dotless, name keys)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NOT_ALNUM = re.compile(r"[^a-z0-9]+")


def fold_text(text: str | None) -> str | None:
    """Lower case, compatibility decomposition, marks dropped, all but a-z and 0-9 a space, squeezed. Null stays null."""
    if text is None:
        return None
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return _NOT_ALNUM.sub(" ", low).strip()


#: Items repeat far more than whole texts do.
_fold_item = lru_cache(maxsize=50_000)(fold_text)


def fold_items(csv: str | None) -> list[str]:
    """The folded items of a CSV field, split at commas only; items that fold to nothing are dropped, repeats kept."""
    return [] if csv is None else [x for x in map(_fold_item, csv.split(",")) if x]


@F.pandas_udf(T.StringType())
def _fold_udf(text: pd.Series) -> pd.Series:
    return text.map(fold_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_items_udf(csv: pd.Series) -> pd.Series:
    return csv.map(lambda x: fold_items(x if isinstance(x, str) else None))


def fold(text: Column) -> Column:
    """Exact fold of any Unicode text (Arrow batches; Spark has no decomposition of its own)."""
    return _fold_udf(text)


def folded_items(csv: Column) -> Column:
    """array<string>: the folded items of a CSV field."""
    return _fold_items_udf(csv)


#: The letters that a Latin-script catalog has beside ASCII, and what fold makes of them.
_FROM = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžșț"
_TO = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzzst"


def fold_latin(text: Column) -> Column:
    """fold for Latin-script text as built-in expressions only (whole-stage code): for hot paths over clean catalogs."""
    low = F.translate(F.translate(F.lower(text), _FROM, _TO), "̧̇̈́̃̂", "")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def fold_dotless(text: Column) -> Column:
    """fold_latin with the dotless i read as i."""
    return fold_latin(F.translate(text, "ıİ", "ii"))


def clean(text: Column) -> Column:
    """Lower, trimmed, white space squeezed; all but a-z, 0-9, space, hyphen and point deleted (not replaced)."""
    squeezed = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    return F.regexp_replace(squeezed, r"[^a-z0-9\s\-.]", "")


#: What counts as white space in any text, controls and wide spaces included.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def clean_any(text: Column) -> Column:
    """clean for text of any script and spacing; nothing comes out empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"^{_SPACE}|{_SPACE}$", "")
    return F.regexp_replace(F.regexp_replace(bare, _SPACE, " "), r"[^a-z0-9 \-.]", "")


def name_key(text: Column, keep_apostrophe: bool = True) -> Column:
    """Name comparison key: years and bracketed years dropped, word characters (and apostrophes) kept."""
    low = F.lower(F.translate(text, "’", "'"))
    low = F.regexp_replace(low, r"\((19|20)\d{2}\)", " ")
    low = F.regexp_replace(low, r"\b(19|20)\d{2}\b", " ")
    low = F.regexp_replace(low, r"(?U)[^\w\s']" if keep_apostrophe else r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def ws_lower(text: Column) -> Column:
    """Lower case with white space squeezed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def csv_items(csv: Column) -> Column:
    """Trimmed, lower-cased, non-empty items of a CSV field, in order."""
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
