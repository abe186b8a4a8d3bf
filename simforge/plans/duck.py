"""DuckDB SQL expression builders for the oracle side of the name queries.

DuckDB's RE2 has no look-behind and no back-references and its ``\\w \\s \\b``
are ASCII, so the oracle inputs are ASCII and two steps are rewritten with
list functions (SURVEY §5.3). Each builder takes a SQL expression string and
returns one.
"""

from __future__ import annotations

from ..functions import constants as K
from ..functions.normalize import keyword_pattern, stop_words


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse_repeats(x: str) -> str:
    parts = f"string_split({x}, '')"
    return f"array_to_string(list_filter({parts}, lambda ch, i: i = 1 or ch <> {parts}[i - 1]), '')"


def char_map(x: str) -> str:
    src = "".join(a for a, _ in K.CHAR_MAP)
    dst = "".join(b for _, b in K.CHAR_MAP)
    return f"translate({x}, {q(src)}, {q(dst)})"


def bigram_map(x: str) -> str:
    for old, new in K.BIGRAM_MAP:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def squeeze_spaces(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def drop_a_after_consonant(x: str) -> str:
    return f"regexp_replace({x}, '([{K.CONSONANTS}{K.CONSONANTS.upper()}])a', '\\1', 'g')"


def drop_special_chars(x: str) -> str:
    x = f"replace({x}, '.', '')"
    return strip(f"regexp_replace({x}, {q(K.SPECIAL_CHARS_CLASS)}, '', 'g')")


def strip_salutation(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(K.SALUTATION_PATTERN)}, '', 'i')")


def cut_parent_suffix(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(K.PARENT_SPOUSE_PATTERN)}, '', 'i')")


def drop_mohammad_variants(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(K.MOHAMMAD_VARIANTS_PATTERN)}, '', 'gi')")


def drop_agarwal_variants(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(K.AGARWAL_VARIANTS_PATTERN)}, '', 'gi')")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def drop_stop_words(x: str, profile: str) -> str:
    stops = ", ".join(q(w) for w in stop_words(profile))
    return f"array_to_string(list_filter({words(x)}, lambda w: lower(w) not in ({stops})), ' ')"


def n1(x: str, profile: str = "api") -> str:
    return drop_stop_words(squeeze_spaces(f"lower({x})"), profile)


def n2(x: str, profile: str = "batch") -> str:
    x = strip_salutation(x)
    x = cut_parent_suffix(x)
    x = drop_mohammad_variants(x)
    x = drop_agarwal_variants(x)
    x = f"lower({x})"
    x = collapse_repeats(x)
    x = char_map(x)
    x = bigram_map(x)
    x = drop_a_after_consonant(x)
    x = drop_special_chars(x)
    x = squeeze_spaces(x)
    return drop_stop_words(x, profile)


def n3(x: str, profile: str = "batch") -> str:
    x = drop_stop_words(f"lower({x})", profile)
    x = drop_mohammad_variants(x)
    return drop_agarwal_variants(x)


def has_keyword(x: str, fixed_keywords: bool = False) -> str:
    return f"regexp_matches(lower(coalesce({x}, '')), {q(keyword_pattern(fixed_keywords))})"


def token_subset(a: str, b: str) -> str:
    ta, tb = f"list_filter(string_split({a}, ' '), lambda w: w <> '')", \
        f"list_filter(string_split({b}, ' '), lambda w: w <> '')"
    return f"(list_has_all({tb}, {ta}) or list_has_all({ta}, {tb}))"


def sorted_chars(x: str) -> str:
    return f"list_sort(list_filter(string_split({x}, ''), lambda ch: ch <> ''))"


def permutation_match(a: str, b: str) -> str:
    return f"({sorted_chars(f"replace({a}, ' ', '')")} = {sorted_chars(f"replace({b}, ' ', '')")})"


# ---------------------------------------------------------------------------
# Similarities
# ---------------------------------------------------------------------------

def lcs(p: str, t: str) -> str:
    """Bit-parallel LCS length (HUGEINT: exact up to 126 characters of ``p``)."""
    m = f"length({p})"
    full = f"((1::HUGEINT << {m}) - 1)"
    mask = (f"list_reduce(list_transform(range({m}), lambda i: case when {p}[i + 1] = ch "
            f"then (1::HUGEINT << i) else 0::HUGEINT end), lambda x, y: x | y, 0::HUGEINT)")
    step = f"(((v + (v & {mask})) | (v - (v & {mask}))) & {full})"
    v = f"list_reduce(string_split({t}, ''), lambda v, ch: {step}, {full})"
    return f"({m} - bit_count({v}))"


def ratio(a: str, b: str) -> str:
    """Edit ratio 0-100 (equal -> 100, one empty -> 0, half-even rounding)."""
    r = f"(2 * {lcs(a, b)})::DOUBLE / (length({a}) + length({b}))"
    return (f"(case when {a} = {b} then 100 when length({a}) = 0 or length({b}) = 0 then 0 "
            f"else round_even(100 * ({r}), 0)::INTEGER end)")


def partial_ratio_full(a: str, b: str) -> str:
    """Partial ratio over every full-length window of the longer string."""
    s = f"(case when length({a}) <= length({b}) then {a} else {b} end)"
    l_ = f"(case when length({a}) <= length({b}) then {b} else {a} end)"
    best = (f"list_max(list_transform(range(0, length({l_}) - length({s}) + 1), "
            f"lambda st: {lcs(s, f'substr({l_}, st + 1, length({s}))')}))")
    r = f"((2 * {best})::DOUBLE / (2 * length({s})))"
    return (f"(case when {a} = {b} then 100 when length({a}) = 0 or length({b}) = 0 then 0 "
            f"when {r} > 0.995 then 100 else round_even(100 * {r}, 0)::INTEGER end)")


def clean_tokens(x: str) -> str:
    """Token form used by the sort/set ratios (ASCII): non-word -> space, lower, split."""
    cleaned = f"trim(lower(regexp_replace({x}, '[^a-zA-Z0-9_]', ' ', 'g')))"
    return f"list_filter(string_split({cleaned}, ' '), lambda w: w <> '')"


def token_sort_ratio(a: str, b: str) -> str:
    sa = f"array_to_string(list_sort({clean_tokens(a)}), ' ')"
    sb = f"array_to_string(list_sort({clean_tokens(b)}), ' ')"
    return ratio(sa, sb)


def token_set_ratio(a: str, b: str) -> str:
    ta, tb = f"list_distinct({clean_tokens(a)})", f"list_distinct({clean_tokens(b)})"
    sect = f"list_sort(list_filter({ta}, lambda w: list_contains({tb}, w)))"
    d12 = f"list_sort(list_filter({ta}, lambda w: not list_contains({tb}, w)))"
    d21 = f"list_sort(list_filter({tb}, lambda w: not list_contains({ta}, w)))"
    s = f"array_to_string({sect}, ' ')"
    c12 = f"array_to_string(list_concat({sect}, {d12}), ' ')"
    c21 = f"array_to_string(list_concat({sect}, {d21}), ' ')"
    return (f"(case when len({ta}) = 0 or len({tb}) = 0 then 0 else "
            f"greatest({ratio(s, c12)}, {ratio(s, c21)}, {ratio(c12, c21)}) end)")


def fuzzy_average(a: str, b: str) -> str:
    """(M1 + M2(full) + M3 + M4) / 400 summed in the original's order."""
    h = "100.0::DOUBLE"
    return (f"((({ratio(a, b)} / {h} + {partial_ratio_full(a, b)} / {h}) + "
            f"{token_sort_ratio(a, b)} / {h} + {token_set_ratio(a, b)} / {h}) / 4.0::DOUBLE)")


def levenshtein_similarity(a: str, b: str) -> str:
    mx = f"greatest(length({a}), length({b}))"
    return (f"(case when {mx} = 0 then 1.0::DOUBLE "
            f"else ({mx} - levenshtein({a}, {b}))::DOUBLE / {mx} end)")


def char_set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ''), lambda ch: ch <> ''))"


def jaccard_chars(a: str, b: str) -> str:
    sa, sb = char_set(a), char_set(b)
    inter = f"len(list_filter({sa}, lambda ch: list_contains({sb}, ch)))"
    union = f"(len({sa}) + len({sb}) - {inter})"
    return f"(case when {union} = 0 then 1.0::DOUBLE else {inter}::DOUBLE / {union} end)"


def _sx_code(c: str) -> str:
    return (f"(case when {c} in ('B','F','P','V') then '1' when {c} in ('C','G','J','K','Q','S','X','Z') "
            f"then '2' when {c} in ('D','T') then '3' when {c} = 'L' then '4' when {c} in ('M','N') "
            f"then '5' when {c} = 'R' then '6' when {c} in ('H','W') then 'h' else '0' end)")


def soundex(x: str) -> str:
    """Soundex with the first character kept as is (ASCII input)."""
    s = f"upper({x})"
    first = f"substr({s}, 1, 1)"
    init = f"{{'r': {first}, 'l': {_sx_code(first)}}}"
    c = "ch"
    step = (f"case when {_sx_code(c)} in ('1','2','3','4','5','6') then "
            f"{{'r': case when {_sx_code(c)} <> acc.l and length(acc.r) < 4 then acc.r || {_sx_code(c)} "
            f"else acc.r end, 'l': {_sx_code(c)}}} when {_sx_code(c)} = 'h' then acc "
            f"else {{'r': acc.r, 'l': '0'}} end")
    red = f"list_reduce(string_split(substr({s}, 2), ''), lambda acc, ch: {step}, {init})"
    return f"(case when length({x}) = 0 then '' else rpad(({red}).r, 4, '0') end)"


def phonetic_similarity(a: str, b: str) -> str:
    return f"jaro_winkler_similarity({soundex(a)}, {soundex(b)})"


def trigrams(x: str) -> str:
    p = f"(' ' || {x} || ' ')"
    return f"list_distinct(list_transform(range(1, length({p}) - 1), lambda i: substr({p}, i, 3)))"


def trigram_cosine(a: str, b: str) -> str:
    ta, tb = trigrams(a), trigrams(b)
    inter = f"len(list_filter({ta}, lambda g: list_contains({tb}, g)))"
    return (f"(case when {a} = {b} then 1.0::DOUBLE when len({ta}) = 0 or len({tb}) = 0 then 0.0::DOUBLE "
            f"else {inter}::DOUBLE / sqrt(len({ta}) * len({tb})) end)")


def weighted_score(emb: str, lev: str, pho: str, jac: str, fuz: str) -> str:
    w = K.LAYER2_WEIGHTS
    return (f"({emb} * {w['embedding']!r}::DOUBLE + {lev} * {w['levenshtein']!r}::DOUBLE + "
            f"{pho} * {w['phonetic']!r}::DOUBLE + {jac} * {w['jaccard']!r}::DOUBLE + "
            f"{fuz} * {w['fuzzy']!r}::DOUBLE)")
