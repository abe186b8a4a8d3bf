"""Native (JVM-side) pair similarities: M6, M7, M8, token forms for M3/M4,
the embedding stand-in for M9, and the layer-2 weighted score M12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def levenshtein_similarity(a: Column, b: Column) -> Column:       # M6
    mx = F.greatest(F.length(a), F.length(b))
    return F.when(mx == 0, F.lit(1.0)).otherwise((mx - F.levenshtein(a, b)).cast("double") / mx)


def char_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != F.lit("")))


def jaccard_chars(a: Column, b: Column) -> Column:                # M8
    sa, sb = char_set(a), char_set(b)
    union = F.size(F.array_union(sa, sb))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(sa, sb)).cast("double") / union)


def soundex(c: Column) -> Column:
    """Soundex keeping a non-letter first character (Spark's built-in returns
    such input unchanged); the code of the rest is the same as after a vowel."""
    first = F.substring(c, 1, 1)
    letter_first = first.rlike("^[A-Za-z]$")
    rest = F.substr(F.soundex(F.concat(F.lit("A"), F.substr(c, F.lit(2)))), F.lit(2), F.lit(3))
    return (F.when(F.length(c) == 0, F.lit(""))
             .when(letter_first, F.soundex(c))
             .otherwise(F.concat(F.upper(first), rest)))


def with_jaro_winkler(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Jaro-Winkler similarity of two string columns into ``out`` (prefix scale
    0.1, at most 4, boost above 0.7; 0.0 when either is empty).

    Written with higher-order functions so it stays in the JVM; the matching
    state is materialised once as a column and then read by the scoring
    expression. Meant for short strings such as phonetic codes.
    """
    ca, cb = F.col(a), F.col(b)
    la, lb = F.length(ca), F.length(cb)
    rng = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))
    init = F.struct(F.array_repeat(F.lit(False), lb).alias("fb"),
                    F.array().cast("array<int>").alias("ma"))

    def step(st, i):
        lo = F.greatest(i - rng, F.lit(0))
        hi = F.least(i + rng, lb - 1)
        ch = F.substr(ca, i + 1, F.lit(1))
        cand = F.when(lo <= hi, F.filter(
            F.sequence(lo, hi),
            lambda j: (~F.get(st["fb"], j)) & (F.substr(cb, j + 1, F.lit(1)) == ch)))
        j = F.get(cand, 0)
        return F.when(j.isNull(), st).otherwise(F.struct(
            F.transform(st["fb"], lambda f, idx: f | (idx == j)).alias("fb"),
            F.concat(st["ma"], F.array(i)).alias("ma")))

    positions = F.when(la > 0, F.sequence(F.lit(0), la - 1)).otherwise(F.array().cast("array<int>"))
    tmp = f"_{out}_st"
    df = df.withColumn(tmp, F.aggregate(positions, init, step))
    st = F.col(tmp)
    m = F.size(st["ma"])
    a_chars = F.transform(st["ma"], lambda i: F.substr(ca, i + 1, F.lit(1)))
    b_chars = F.filter(F.transform(st["fb"], lambda f, j: F.when(f, F.substr(cb, j + 1, F.lit(1)))),
                       lambda x: x.isNotNull())
    trans = F.floor(F.size(F.filter(F.zip_with(a_chars, b_chars, lambda x, y: x != y),
                                    lambda d: d)) / 2)
    md = m.cast("double")
    jaro = (md / la + md / lb + (md - trans) / md) / 3.0
    prefix = sum((F.when((F.least(la, lb) >= n) &
                         (F.substring(ca, 1, n) == F.substring(cb, 1, n)), F.lit(1)).otherwise(F.lit(0))
                  for n in range(1, 5)), F.lit(0))
    tj = f"_{out}_jaro"
    df = df.withColumn(tj, F.when((la == 0) | (lb == 0) | (m == 0), F.lit(0.0)).otherwise(jaro))
    df = df.withColumn(f"_{out}_pre", prefix)
    jv, pv = F.col(tj), F.col(f"_{out}_pre")
    df = df.withColumn(out, F.when(jv > 0.7, jv + pv * 0.1 * (F.lit(1.0) - jv)).otherwise(jv))
    return df.drop(tmp, tj, f"_{out}_pre")


def with_phonetic_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:  # M7
    """Jaro-Winkler of the Soundex codes of two columns."""
    sa, sb = f"_{out}_sxa", f"_{out}_sxb"
    df = df.withColumn(sa, soundex(F.col(a))).withColumn(sb, soundex(F.col(b)))
    return with_jaro_winkler(df, sa, sb, out).drop(sa, sb)


def trigrams(c: Column) -> Column:
    p = F.concat(F.lit(" "), c, F.lit(" "))
    return F.array_distinct(F.transform(
        F.when(F.length(p) >= 3, F.sequence(F.lit(1), F.length(p) - 2))
         .otherwise(F.array().cast("array<int>")),
        lambda i: F.substr(p, i, F.lit(3))))


def trigram_cosine(a: Column, b: Column) -> Column:
    """Embedding stand-in for M9: cosine of binary character-trigram vectors.

    Identical strings score 1.0 (as two equal sentence embeddings would). This
    is *not* the original's model score; users pass real vectors instead.
    """
    ta, tb = trigrams(a), trigrams(b)
    inter = F.size(F.array_intersect(ta, tb)).cast("double")
    return (F.when(a == b, F.lit(1.0))
             .when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0))
             .otherwise(inter / F.sqrt(F.size(ta) * F.size(tb))))


def weighted_score(emb: Column, lev: Column, pho: Column, jac: Column, fuz: Column) -> Column:  # M12
    w = K.LAYER2_WEIGHTS
    return (emb * F.lit(w["embedding"]) + lev * F.lit(w["levenshtein"]) + pho * F.lit(w["phonetic"])
            + jac * F.lit(w["jaccard"]) + fuz * F.lit(w["fuzzy"]))


# ---------------------------------------------------------------------------
# token forms used by the sort / set ratios
# ---------------------------------------------------------------------------

def clean_for_tokens(c: Column) -> Column:
    """Drop U+0080-U+00FF, non-word characters -> space, lower-case, strip."""
    c = F.regexp_replace(c, "[\\x{80}-\\x{FF}]", "")
    c = F.lower(F.regexp_replace(c, r"(?U)\W", " "))
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_tokens(c: Column) -> Column:
    return F.filter(F.split(clean_for_tokens(c), r"(?U)\s+"), lambda w: w != F.lit(""))


def sorted_token_string(c: Column) -> Column:
    return F.array_join(F.array_sort(clean_tokens(c)), " ")


def token_set_parts(a: Column, b: Column):
    """(intersection, intersection + a-only, intersection + b-only, any_empty) as strings."""
    ta, tb = F.array_distinct(clean_tokens(a)), F.array_distinct(clean_tokens(b))
    sect = F.array_sort(F.array_intersect(ta, tb))
    d12 = F.array_sort(F.array_except(ta, tb))
    d21 = F.array_sort(F.array_except(tb, ta))
    empty = (F.size(ta) == 0) | (F.size(tb) == 0)
    return (F.array_join(sect, " "), F.array_join(F.concat(sect, d12), " "),
            F.array_join(F.concat(sect, d21), " "), empty)
