"""Tokens for keyword search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words.
STOP_WORDS = (
    "the", "is", "at", "which", "on",
    "a", "an", "and", "or", "but",
    "in", "with", "to", "for", "of",
    "it", "by", "from", "as", "be",
    "was", "are", "were", "been", "has",
    "have", "had", "do", "does", "did",
    "will", "would", "could", "should",
    "this", "that", "these", "those",
    "not", "no", "so", "if", "then",
)


_WORDS = r"[\p{L}\p{Nd}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORDS), F.lit(0))
    return F.filter(found, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOP_WORDS))
