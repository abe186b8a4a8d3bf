"""Name normalisation as JVM-side column expressions.

Java regexes are made Unicode-aware with ``(?U)`` so ``\\w \\s \\b`` and case
folding agree with Python's ``re`` on non-ASCII names; ``(?d)`` makes ``.``
stop only at ``\\n`` as Python's does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

PROFILES = ("batch", "api")


def stop_words(profile: str) -> list[str]:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    return K.STOP_WORDS_BATCH if profile == "batch" else K.STOP_WORDS_API


def null_to_empty(c: Column) -> Column:
    """Null rule: a missing name is the empty string on every path."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lower(c: Column) -> Column:                                   # P1
    return F.lower(c)


def collapse_repeats(c: Column) -> Column:                        # P2
    return F.regexp_replace(c, r"(?d)(.)\1+", "$1")


def char_map(c: Column) -> Column:                                # P3
    src = "".join(a for a, _ in K.CHAR_MAP)
    dst = "".join(b for _, b in K.CHAR_MAP)
    return F.translate(c, src, dst)


def bigram_map(c: Column) -> Column:                              # P4
    for old, new in K.BIGRAM_MAP:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def squeeze_spaces(c: Column) -> Column:                          # P5
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def drop_a_after_consonant(c: Column) -> Column:                  # P6
    return F.regexp_replace(c, f"(?<=[{K.CONSONANTS}{K.CONSONANTS.upper()}])a", "")


def drop_special_chars(c: Column) -> Column:                      # P7
    c = F.regexp_replace(c, r"\.", "")
    return strip(F.regexp_replace(c, "(?U)" + K.SPECIAL_CHARS_CLASS, ""))


def strip_salutation(c: Column) -> Column:                        # P8
    return strip(F.regexp_replace(c, "(?iU)" + K.SALUTATION_PATTERN, ""))


def cut_parent_suffix(c: Column, strict: bool = False) -> Column:  # P9
    """``strict`` cuts only at whole words (``Sonia Gandhi`` stays), unlike the original."""
    pattern = K.PARENT_SPOUSE_PATTERN
    if strict:
        pattern = pattern.replace("(?:", r"(?<!\w)(?:", 1).replace(r")\s*[", r")(?!\w)\s*[", 1)
    return strip(F.regexp_replace(c, "(?iU)" + pattern, ""))


def drop_mohammad_variants(c: Column) -> Column:                  # P10
    return strip(F.regexp_replace(c, "(?iU)" + K.MOHAMMAD_VARIANTS_PATTERN, ""))


def drop_agarwal_variants(c: Column) -> Column:                   # P11
    return strip(F.regexp_replace(c, "(?iU)" + K.AGARWAL_VARIANTS_PATTERN, ""))


def words(c: Column) -> Column:
    """Python ``str.split()``: whitespace-separated words, no empty entries."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != F.lit(""))


def drop_stop_words(c: Column, profile: str = "batch") -> Column:  # P12
    stops = F.array(*[F.lit(w) for w in stop_words(profile)])
    return F.array_join(F.filter(words(c), lambda w: ~F.array_contains(stops, F.lower(w))), " ")


def n1(c: Column, profile: str = "api") -> Column:                # P13: layer-1 (api)
    return drop_stop_words(squeeze_spaces(lower(c)), profile)


def n2(c: Column, profile: str = "batch") -> Column:              # P14: layer-2
    c = strip_salutation(c)
    c = cut_parent_suffix(c)
    c = drop_mohammad_variants(c)
    c = drop_agarwal_variants(c)
    c = lower(c)
    c = collapse_repeats(c)
    c = char_map(c)
    c = bigram_map(c)
    c = drop_a_after_consonant(c)
    c = drop_special_chars(c)
    c = squeeze_spaces(c)
    return drop_stop_words(c, profile)


def n3(c: Column, profile: str = "batch") -> Column:              # P15: layer-3
    c = drop_stop_words(lower(c), profile)
    c = drop_mohammad_variants(c)
    return drop_agarwal_variants(c)


# ---------------------------------------------------------------------------
# Keyword predicates (K1, K2) and layer-1 token tests (K3, K4)
# ---------------------------------------------------------------------------

def _java_quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in s)


def keyword_pattern(fixed_keywords: bool = False) -> str:
    return "|".join(_java_quote(k) for k in K.live_keywords(fixed_keywords))


def has_keyword(raw: Column, fixed_keywords: bool = False) -> Column:  # K1
    """``fixed_keywords`` parts the entries that the original's list runs together."""
    return F.lower(null_to_empty(raw)).rlike(keyword_pattern(fixed_keywords))


def keywords_agree(raw1: Column, raw2: Column) -> Column:         # K2
    return has_keyword(raw1) == has_keyword(raw2)


def token_subset(n1a: Column, n1b: Column) -> Column:             # K3
    ta, tb = F.split(n1a, " "), F.split(n1b, " ")
    ta = F.filter(ta, lambda w: w != F.lit(""))
    tb = F.filter(tb, lambda w: w != F.lit(""))
    return (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0)


def sorted_chars(c: Column) -> Column:                            # O7
    return F.array_sort(F.filter(F.split(c, ""), lambda x: x != F.lit("")))


def permutation_match(n1a: Column, n1b: Column) -> Column:        # K4
    return sorted_chars(F.replace(n1a, F.lit(" "), F.lit(""))) == \
        sorted_chars(F.replace(n1b, F.lit(" "), F.lit("")))
