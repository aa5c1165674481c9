"""Text clean-up used to compare column names, aliases and values."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

# Letters folded to one spelling, then Arabic-Indic and Persian digits to ASCII.
LETTERS_FROM = "يىئكۀةؤ‌‍"
LETTERS_TO = "یییکههو  "
LETTERS_DROPPED = "ـ﻿"
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"

_FOLD = str.maketrans(LETTERS_FROM + DIGITS_FROM, LETTERS_TO + DIGITS_TO, LETTERS_DROPPED)


@F.pandas_udf(StringType())
def _fold_unicode(values: pd.Series) -> pd.Series:
    def fold(s):
        return None if s is None else unicodedata.normalize("NFKC", s.strip()).translate(_FOLD).casefold()

    return values.map(fold)


def _tail(folded: Column) -> Column:
    spaced = F.regexp_replace(folded, r"[_\-./\\]+", " ")
    spaced = F.regexp_replace(spaced, r"[^\p{L}\p{N}\s]", " ")
    spaced = F.trim(F.regexp_replace(spaced, r"\s+", " "))
    return F.regexp_replace(spaced, r"\s+[0-9]+$", "")


def fold_letters(col: Column) -> Column:
    """One spelling for letters and digits that have several."""
    return F.translate(col, LETTERS_FROM + DIGITS_FROM + LETTERS_DROPPED, LETTERS_TO + DIGITS_TO)


def normalize_text(col: Column, unicode: bool = False) -> Column:
    """Comparable form of a name: folded letters and digits, spaces for separators, no trailing number.

    ``unicode`` adds compatibility composition and full case folding, which no
    built-in column function offers; only texts beyond ASCII go that way. It
    can't be used inside a higher-order function.
    """
    value = F.coalesce(col.cast("string"), F.lit(""))
    plain = F.lower(F.trim(fold_letters(value)))
    if unicode:
        plain = F.coalesce(_fold_unicode(F.when(value.rlike(r"[^\x00-\x7f]"), value)), plain)
    return _tail(plain)


def compact_normalize(col: Column, unicode: bool = False) -> Column:
    return F.replace(normalize_text(col, unicode), F.lit(" "), F.lit(""))


def clean_string(col: Column) -> Column:
    """Squeeze blanks; an empty result is missing."""
    squeezed = F.trim(F.regexp_replace(col, r"\s+", " "))
    return F.when(squeezed != "", squeezed)


def dedup_key(col: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


def tokens(normalized: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def token_similarity(left: Column, right: Column) -> Column:
    """0.65 x Jaccard + 0.35 x containment of two normalised names; null when either has no token."""
    a, b = tokens(left), tokens(right)
    shared = F.size(F.array_intersect(a, b))
    jaccard = F.try_divide(shared, F.size(F.array_union(a, b)))
    contained = F.try_divide(shared, F.least(F.size(a), F.size(b)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 0.65 * jaccard + 0.35 * contained)


def name_matcher(b: str):
    """Function scoring a normalised name against ``b``: 1 equal, 0.985 equal without blanks, else characters and tokens.

    The index of ``b`` is built once and serves every name.
    """
    compact, right = b.replace(" ", ""), set(b.split())
    matcher = SequenceMatcher(None)
    matcher.set_seq2(b)

    def score(a: str) -> float:
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        if a.replace(" ", "") == compact:
            return 0.985
        matcher.set_seq1(a)
        ratio = matcher.ratio()
        left = set(a.split())
        if not left or not right:
            return ratio
        shared = len(left & right)
        token = 0.65 * shared / len(left | right) + 0.35 * shared / min(len(left), len(right))
        return 0.65 * ratio + 0.35 * token

    return score


def name_bound(b: str):
    """Function giving a value that :func:`name_matcher` of ``b`` can't exceed: letters are counted instead of matched."""
    compact, right, letters = b.replace(" ", ""), set(b.split()), Counter(b)

    def bound(a: str, own: Counter) -> float:
        if not a or not b:
            return 0.0
        if a == b or a.replace(" ", "") == compact:
            return 1.0
        longest = len(a) + len(b)
        ratio = 2.0 * sum(min(n, letters[c]) for c, n in own.items() if c in letters) / longest
        left = set(a.split())
        if not left or not right:
            return ratio
        shared = len(left & right)
        return 0.65 * ratio + 0.35 * (0.65 * shared / len(left | right) + 0.35 * shared / min(len(left), len(right)))

    return bound


def name_similarity(a: str, b: str) -> float:
    return name_matcher(b)(a)


@F.pandas_udf(DoubleType())
def string_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Full similarity of two normalised name columns (Arrow batches)."""
    return pd.Series([name_similarity(a or "", b or "") for a, b in zip(left, right)])


def sanitize_name(name: str, mode: str = "full") -> str:
    """Column name without symbols; ``full`` also deletes digits and squeezes underscores."""
    if mode == "simple":
        return re.sub(r"\W", "_", name)
    if mode != "full":
        raise ValueError(f"unknown mode: {mode!r}")
    cleaned = re.sub(r"_+", "_", re.sub(r"\W", "_", re.sub(r"\d+", "", name)))
    return cleaned.strip("_")


def sanitize_column(col: Column, mode: str = "full") -> Column:
    """Column form of :func:`sanitize_name` for a table that lists names."""
    word = r"[^\p{L}\p{N}_]"
    if mode == "simple":
        return F.regexp_replace(col, word, "_")
    if mode != "full":
        raise ValueError(f"unknown mode: {mode!r}")
    squeezed = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r"\p{Nd}+", ""), word, "_"), "_+", "_")
    return F.regexp_replace(squeezed, "^_+|_+$", "")
