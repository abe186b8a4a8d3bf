"""Edit ratios M1-M5.

Only the longest-common-subsequence kernel runs in Python: one Arrow-batched
pandas UDF per fuzzy average takes the prepared strings of a pair and returns
a struct of its six ratios. Token cleaning, sorting and set algebra for the
token ratios are native column expressions.

The partial ratio over all windows (``full``) is semi-local: one pass over a pair
combs the strands of its alignment grid, after which the LCS of the shorter
string with every window of the longer one is a count of strands.

Ratio semantics: ``round_half_even(100 * 2*LCS / (len1 + len2))``; equal
strings -> 100; one empty -> 0. A null input returns null, which is how the
cascade skips rows already decided (the kernel drops them before scoring).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import clean_tokens

PARTIAL_MODES = ("aligned", "full")

#: Pairs whose shorter string fits one machine word are scored together, this many at once.
WORD = 64
BATCH = 8192
#: Strands that are combed at once.
CELLS = 1 << 20


def lcs_length(a: str, b: str) -> int:
    """LCS length by the bit-parallel recurrence (Allison-Dix / Hyyrö).

    One bit per character of the shorter string (Python ints have no width
    limit, so any length works): V' = (V + (V & M[c])) | (V - (V & M[c])).
    """
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    bit = 1
    for ch in a:
        masks[ch] = masks.get(ch, 0) | bit
        bit <<= 1
    full = bit - 1
    v = full
    for ch in b:
        m = masks.get(ch)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _code_points(strings: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(strings), width), np.uint32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    row = np.repeat(np.arange(len(strings)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _lcs_words(short: list[str], long: list[str]) -> np.ndarray:
    """The same recurrence for a whole batch, one 64-bit word per pair."""
    m = np.fromiter(map(len, short), np.int64, len(short))
    n = np.fromiter(map(len, long), np.int64, len(long))
    a = _code_points(short, WORD)
    b = _code_points(long, int(n.max()))
    live = np.arange(WORD) < m[:, None]
    v = np.full(len(short), np.iinfo(np.uint64).max, np.uint64)
    for j in range(b.shape[1]):
        hit = (a == b[:, j, None]) & live & (j < n)[:, None]
        mask = np.packbits(hit, axis=1, bitorder="little").view(np.uint64)[:, 0]
        u = v & mask
        v = (v + u) | (v - u)
    ones = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    return m - (ones & live).sum(1)


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """LCS length of each pair: vectorised up to 64 characters of the shorter string."""
    out = np.zeros(len(left), np.int64)
    small = []
    for i, (a, b) in enumerate(zip(left, right)):
        if not a or not b:
            continue
        if min(len(a), len(b)) <= WORD and max(len(a), len(b)) <= 4 * WORD:
            small.append(i)
        else:
            out[i] = lcs_length(a, b)
    small.sort(key=lambda i: max(len(left[i]), len(right[i])))
    for s in range(0, len(small), BATCH):
        part = small[s:s + BATCH]
        pairs = [(left[i], right[i]) if len(left[i]) <= len(right[i]) else (right[i], left[i]) for i in part]
        out[part] = _lcs_words([p[0] for p in pairs], [p[1] for p in pairs])
    return out


def _combed(short: list[str], long: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For a batch, LCS(short, long) and the largest LCS of short with a window of its length of long.

    Strands enter the alignment grid at its left and top and leave at its
    bottom and right; two cross where characters differ and they have not met
    before. A column's strand that enters at p >= s and leaves at r < e costs
    one character of long[s:e], so LCS(short, long[s:e]) = e - s less the
    number of such strands. Cells of a diagonal are independent and are
    processed together for all pairs; padding matches nothing.
    """
    m = np.fromiter(map(len, short), np.int64, len(short))[:, None]
    n = np.fromiter(map(len, long), np.int64, len(long))[:, None]
    rows, cols = int(m.max()), int(n.max())
    a = _code_points(short, rows)[:, ::-1]  # as the strands at the left, from the bottom up
    b = _code_points(long, cols)
    b[np.arange(cols) >= n] = np.iinfo(np.uint32).max
    a[np.arange(rows)[::-1] >= m] = np.iinfo(np.uint32).max - 1
    side = np.tile(np.arange(rows, dtype=np.int32), (len(short), 1))
    top = np.tile(np.arange(rows, rows + cols, dtype=np.int32), (len(short), 1))
    for d in range(rows + cols - 1):
        first, last = max(0, d - cols + 1), min(rows - 1, d)
        h, v = slice(rows - 1 - last, rows - first), slice(d - last, d - first + 1)
        x, y = side[:, h], top[:, v]
        swap = (a[:, h] == b[:, v]) | (x > y)
        side[:, h], top[:, v] = np.where(swap, y, x), np.where(swap, x, y)
    enters, leaves = top - rows, np.arange(cols)[None]
    falls = (enters >= 0) & (leaves < n)
    whole = n[:, 0] - falls.sum(1)
    # a strand costs the windows that begin after leaves - m, up to where it enters
    begin, end = np.maximum(leaves - m + 1, 0), np.minimum(enters, n - m) + 1
    pair, at = np.nonzero(falls & (begin < end))
    cost = np.zeros((len(short), cols + 2), np.int32)
    np.add.at(cost, (pair, begin[pair, at]), 1)
    np.add.at(cost, (pair, end[pair, at]), -1)
    cost = np.cumsum(cost, axis=1)
    cost[np.arange(cols + 2) > n - m] = np.iinfo(np.int32).max
    return whole, m[:, 0] - cost.min(1)


def window_lcs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair, the LCS and the largest LCS of the shorter string with a window of its length of the longer one."""
    whole, best = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right)]
    todo = sorted((i for i, (a, _) in enumerate(pairs) if a), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    while todo:
        # pairs of like lengths, as many as fit a bound on cells
        size = max(1, min(BATCH, CELLS // (len(pairs[todo[0]][1]) + len(pairs[todo[0]][0]))))
        part = todo[:size]
        widest = max(1, CELLS // (2 * len(pairs[part[-1]][1])))
        part, todo = part[:widest], todo[min(size, widest):]
        whole[part], best[part] = _combed([pairs[i][0] for i in part], [pairs[i][1] for i in part])
    return whole, best


def full_ratio_values(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """M1 and M2 (``full``) of each pair from one pass."""
    whole, best = window_lcs(left, right)
    total = np.fromiter((len(a) + len(b) for a, b in zip(left, right)), np.float64, len(left))
    short = np.fromiter((min(len(a), len(b)) for a, b in zip(left, right)), np.float64, len(left))
    same = np.fromiter((a == b for a, b in zip(left, right)), bool, len(left))
    ratio = 2 * whole / np.where(total == 0, 1, total)
    partial = 2 * best / np.where(short == 0, 1, 2 * short)
    return (np.where(same, 100, np.rint(100 * ratio)).astype(np.int64),
            np.where(same | (partial > 0.995), 100, np.rint(100 * partial)).astype(np.int64))


def ratio_values(left: list[str], right: list[str]) -> np.ndarray:
    """M1 of each pair."""
    total = np.fromiter((len(a) + len(b) for a, b in zip(left, right)), np.float64, len(left))
    same = np.fromiter((a == b for a, b in zip(left, right)), bool, len(left))
    ratio = 2 * lcs_lengths(left, right) / np.where(total == 0, 1, total)
    return np.where(same, 100, np.rint(100 * ratio)).astype(np.int64)


def _window_starts(shorter: str, longer: str) -> list[int]:
    # autojunk would ignore frequent characters of strings of 200 and more
    blocks = SequenceMatcher(None, shorter, longer, autojunk=False).get_matching_blocks()
    return sorted({max(j - i, 0) for i, j, _ in blocks})


def partial_ratio_values(left: list[str], right: list[str], mode: str = "aligned") -> np.ndarray:
    """M2 of each pair: the best ratio of the shorter string and a window of the longer one."""
    if mode == "full":
        return full_ratio_values(left, right)[1]
    out = np.zeros(len(left), np.int64)
    pair, window, short = [], [], []
    best = np.zeros(len(left))

    def score() -> None:
        if pair:
            total = np.fromiter((len(a) + len(b) for a, b in zip(short, window)), np.float64, len(pair))
            np.maximum.at(best, pair, 2 * lcs_lengths(short, window) / total)
            pair.clear(), window.clear(), short.clear()

    for i, (a, b) in enumerate(zip(left, right)):
        if a == b:
            out[i] = 100
        elif a and b:
            shorter, longer = (a, b) if len(a) <= len(b) else (b, a)
            for s in _window_starts(shorter, longer):
                pair.append(i)
                short.append(shorter)
                window.append(longer[s:s + len(shorter)])
            if len(pair) >= BATCH:
                score()
    score()
    return np.where(best > 0.995, 100, np.maximum(out, np.rint(100 * best))).astype(np.int64)


def ratio_value(a: str, b: str) -> int:
    return int(ratio_values([a], [b])[0])


def partial_ratio_value(a: str, b: str, mode: str = "aligned") -> int:
    return int(partial_ratio_values([a], [b], mode)[0])


PARTS = ("ratio", "partial", "token_sort", "set_1", "set_2", "set_12")
#: Prepared strings of a pair of columns.
PREPARED = ("a", "b", "sa", "sb", "both", "w1", "w2")


def _kernel(mode: str, n: int):
    """The six ratios of ``n`` pairs of columns of prepared strings, as one struct column."""
    struct = T.StructType([T.StructField(f"{p}{i}", T.IntegerType()) for i in range(n) for p in PARTS])

    @F.pandas_udf(struct)
    def ratios(*columns: pd.Series) -> pd.DataFrame:
        groups = [columns[i * len(PREPARED):(i + 1) * len(PREPARED)] for i in range(n)]
        live = [(g[0].notna() & g[1].notna()).to_numpy() for g in groups]
        a, b, sa, sb, both, w1, w2 = ([x for g, some in zip(groups, live) for x in g[j][some]] for j in range(len(PREPARED)))
        whole = full_ratio_values(a, b) if mode == "full" else (ratio_values(a, b), partial_ratio_values(a, b, mode))
        # the token ratios of all groups together
        rest = ratio_values([*sa, *both, *both, *w1], [*sb, *w1, *w2, *w2]).reshape(4, -1)
        out, begin = {}, 0
        for i, some in enumerate(live):
            end = begin + int(some.sum())
            for name, values in zip(PARTS, (*whole, *rest)):
                col = np.zeros(len(some), np.int64)
                col[some] = values[begin:end]
                out[f"{name}{i}"] = pd.Series(pd.array(col, dtype="Int32")).mask(~some)
            begin = end
        return pd.DataFrame(out)

    # The kernels are pure functions, but they are declared non-deterministic on
    # purpose: that keeps Catalyst's CollapseProject from inlining the projection
    # chains of a cascade into one giant expression tree, which can take the
    # optimiser minutes. The loss: filters on other columns don't move below them.
    return ratios.asNondeterministic()


def _with_parts(df: DataFrame, pairs: list[tuple[str, str, str]], mode: str) -> DataFrame:
    """Adds ``{p}parts`` (struct of the six ratios) and ``{p}empty`` for each pair of columns and prefix (a, b, p).

    Token forms are materialised as columns first, so each regex / array
    expression runs once per row; all ratios share one Arrow round trip.
    """
    if mode not in PARTIAL_MODES:
        raise ValueError(f"mode must be one of {PARTIAL_MODES}")
    join = lambda x: F.array_join(x, " ")
    tokens, forms = {}, {}
    for a, b, p in pairs:
        tokens |= {p + t: F.when(F.col(x).isNotNull(), clean_tokens(F.col(x))) for t, x in (("ta", a), ("tb", b))}
        ta, tb = F.col(p + "ta"), F.col(p + "tb")
        da, db = F.array_distinct(ta), F.array_distinct(tb)
        sect = F.array_sort(F.array_intersect(da, db))
        forms |= {
            p + "sa": join(F.array_sort(ta)), p + "sb": join(F.array_sort(tb)), p + "both": join(sect),
            p + "w1": join(F.concat(sect, F.array_sort(F.array_except(da, db)))),
            p + "w2": join(F.concat(sect, F.array_sort(F.array_except(db, da)))),
            p + "empty": (F.size(ta) == 0) | (F.size(tb) == 0),
        }
    df = df.withColumns(tokens).withColumns(forms)
    prepared = [F.col(c) for a, b, p in pairs for c in (a, b, *(p + x for x in PREPARED[2:]))]
    df = df.withColumn("_ratios", _kernel(mode, len(pairs))(*prepared))
    df = df.withColumns({p + "parts": F.struct(*(F.col("_ratios")[f"{x}{i}"].alias(x) for x in PARTS)) for i, (_, _, p) in enumerate(pairs)})
    return df.drop("_ratios", *(p + x for _, _, p in pairs for x in ("ta", "tb", *PREPARED[2:])))


def _token_set(p: str) -> Column:
    parts = F.col(p + "parts")
    best = F.greatest(parts["set_1"], parts["set_2"], parts["set_12"])
    return F.when(parts["ratio"].isNull(), F.lit(None).cast("int")).when(F.col(p + "empty"), F.lit(0)).otherwise(best)


def with_fuzzy_ratios(df: DataFrame, a: str, b: str, mode: str = "aligned") -> DataFrame:
    """M1-M4 of columns ``a``/``b``: one Arrow round trip. Null input -> null output."""
    p, parts = "_m_", F.col("_m_parts")
    return _with_parts(df, [(a, b, p)], mode).withColumns({
        "m1_ratio": parts["ratio"], "m2_partial_ratio": parts["partial"], "m3_token_sort_ratio": parts["token_sort"],
        "m4_token_set_ratio": _token_set(p),
    }).drop(p + "parts", p + "empty")


def with_fuzzy_averages(df: DataFrame, pairs: list[tuple[str, str, str]], mode: str = "aligned") -> DataFrame:
    """M5 of several pairs of columns (a, b, out): adds each ``out`` = (M1 + M2 + M3 + M4) / 400.

    One Arrow round trip for all. Terms are added in the original's order, so
    threshold tests on the result agree to the last bit. Null input -> null output.
    """
    h, prefix = F.lit(100.0), lambda out: f"_{out}_"
    df = _with_parts(df, [(a, b, prefix(out)) for a, b, out in pairs], mode)
    averages = {}
    for _, _, out in pairs:
        parts = F.col(prefix(out) + "parts")
        total = ((parts["ratio"] / h + parts["partial"] / h) + parts["token_sort"] / h) + _token_set(prefix(out)) / h
        averages[out] = total / F.lit(4.0)
    return df.withColumns(averages).drop(*(prefix(out) + x for _, _, out in pairs for x in ("parts", "empty")))


def with_fuzzy_average(df: DataFrame, a: str, b: str, out: str, mode: str = "aligned") -> DataFrame:
    """M5 of columns ``a``/``b``; see :func:`with_fuzzy_averages`."""
    return with_fuzzy_averages(df, [(a, b, out)], mode)
