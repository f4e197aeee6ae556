"""Accent folding, tokens and lexicon sentiment as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import java_round

MIN_CLOUD_LENGTH = 4
MIN_SENTIMENT_LENGTH = 3

# Sentiment lexicon.
POSITIVE_WORDS = [
    "agreable", "calme", "propre", "securitaire", "dynamique", "belle", "bien", "excellent", "parfait",
    "magnifique", "tranquille", "verdoyant", "accueillant", "pratique", "moderne", "formidable", "qualite",
    "bon", "bonne", "super",
]
NEGATIVE_WORDS = [
    "bruyant", "sale", "dangereux", "cher", "pollue", "degrade", "insecurite", "probleme", "difficile",
    "mauvais", "nul", "horrible", "pire", "manque", "abandon", "bruit", "nuisance", "cruel",
]

_MARKS = [chr(cp) for cp in range(0x300, 0x370)]


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """(source, target) for `translate`: composed lower-case characters to their base, marks to nothing.

    Generated from Unicode decomposition; Hangul is left out because it has no diacritics.
    """
    source, target = [], []
    for cp in [*range(0x80, 0x300), *range(0x370, 0x2200)]:
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if c not in _MARKS)
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source + _MARKS), "".join(target)


def fold_accents(c: Column) -> Column:
    """Lower case without diacritics. Text without multi-byte characters has nothing to fold."""
    source, target = fold_table()
    low = F.lower(c)
    return F.when(F.octet_length(c) > F.length(c), F.translate(low, source, target)).otherwise(low)


def tokens(c: Column, min_length: int = 1) -> Column:
    """Folded words of at least `min_length` letters."""
    return F.regexp_extract_all(fold_accents(c), F.lit(f"[a-z]{{{min_length},}}"), F.lit(0))


def score_words(words: Column) -> Column:
    """(positive - negative) / total * 10 clamped to [-1, 1], before rounding; 0 without words."""
    total = F.size(words)
    positive = F.size(F.filter(words, lambda w: w.isin(POSITIVE_WORDS)))
    negative = F.size(F.filter(words, lambda w: w.isin(NEGATIVE_WORDS)))
    raw = (positive - negative).cast("double") / total.cast("double") * F.lit(10.0)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    return F.coalesce(F.when(total > 0, clamped), F.lit(0.0))


def label_score(score: Column) -> Column:
    """Label of an unrounded score."""
    return F.when(score > 0.1, "POSITIVE").when(score < -0.1, "NEGATIVE").otherwise("NEUTRAL")


def sentiment_score(c: Column) -> Column:
    return java_round(score_words(tokens(c, MIN_SENTIMENT_LENGTH)), 3)


def sentiment_label(c: Column) -> Column:
    return label_score(score_words(tokens(c, MIN_SENTIMENT_LENGTH)))
