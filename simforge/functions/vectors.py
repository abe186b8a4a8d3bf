"""Vector column expressions (M11, J2) and the numpy kernel of the blocked
top-k operators.

Semantics of the similarity (SURVEY V9): the dot product pairs elements by
position, so vectors of unequal length contribute their common prefix, while
each norm uses all elements of its own vector. Null, empty or zero vectors
give a null similarity (safe division).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot_prefix(a: Column, b: Column) -> Column:
    """Sum of a[i]*b[i] over the common prefix; null if either is null/empty."""
    prods = F.zip_with(a, b, lambda x, y: x * y)
    total = F.aggregate(prods, F.lit(0.0).cast("double"),
                        lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, null when undefined (zero/empty/null)."""
    return F.try_divide(dot_prefix(a, b), norm(a) * norm(b))


def similarity_percentage(a: Column, b: Column) -> Column:
    """V9: ``SAFE_DIVIDE(dot, |a|*|b|) * 100``; round only what is shown, never what is ranked."""
    return cosine_similarity(a, b) * F.lit(100.0)


def mean_pool(vectors: Column) -> Column:
    """M10 for an array of token vectors held in one row: positional average."""
    n = F.size(vectors)
    width = F.aggregate(vectors, F.lit(0), lambda acc, v: F.greatest(acc, F.size(v)))
    return F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda i: F.aggregate(vectors, F.lit(0.0).cast("double"),
                              lambda acc, v: acc + F.coalesce(F.get(v, i), F.lit(0.0))) / n)


# ---------------------------------------------------------------------------
# numpy kernel: runs inside one task on one block (or block pair) of rows
# ---------------------------------------------------------------------------

def stack_vectors(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ragged arrays -> (zero-padded matrix, full-vector norms, non-empty mask); a null component counts as 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    width = int(lens.max(initial=0))
    values = column.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if values.null_count:
        flat = np.nan_to_num(flat, nan=0.0)
    if len(lens) and (lens == width).all():
        mat = flat.reshape(len(lens), width)
    else:
        mat = np.zeros((len(lens), width), dtype=np.float64)
        mat[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    norms = np.zeros(len(mat))
    for a in range(0, len(mat), 4096):  # no second matrix of the squares
        norms[a : a + 4096] = np.sqrt((mat[a : a + 4096] * mat[a : a + 4096]).sum(axis=1))
    return mat, norms, lens > 0


METRICS = ("cosine", "euclidean")
#: Similarities that a cell holds at once, and left rows that it finishes together.
SCORES, STEP = 1 << 20, 512


def pair_similarity(dot, ln, rn, valid, metric: str):
    """Percent similarity ``(1 - distance) * 100`` from dot products and norms; NaN where undefined."""
    if metric == "cosine":
        denom = ln * rn
        valid = valid & (denom != 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(valid, dot / np.where(valid, denom, 1.0) * 100.0, np.nan)
    if metric == "euclidean":
        gap = np.sqrt(np.maximum(ln * ln + rn * rn - 2 * dot, 0.0))
        return np.where(valid, (1.0 - gap) * 100.0, np.nan)
    raise ValueError(f"metric must be one of {METRICS}")


def id_codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Integers in the order of the ids, -1 for null, equal on both sides for equal ids."""
    ids = [pd.Series(x.to_numpy(), dtype=object) if pa.types.is_string(x.type) else x.to_pandas() for x in (left, right)]
    codes, _ = pd.factorize(pd.concat(ids, ignore_index=True), sort=True)
    return codes[:len(left)], codes[len(left):]


class Side:
    """One side of a cell: rows ``id, vec, copies, rowkey`` as matrices; the vectors are held once.

    Where a cell holds several lists (see ``ivf``), base rows name theirs (``list_id``), and query rows
    those that are open to them (``open``) and their k-th best so far (``limit``, an angle or distance).
    """

    def __init__(self, rows: pa.Table):
        self.mat, self.norms, self.full = stack_vectors(rows["vec"])
        self.copies = rows["copies"].to_numpy()
        self.rows = rows.drop_columns("vec")


#: Columns of a candidate besides its ids: the query row's key and copies, the base row's key and copies, and their similarity.
CANDIDATE = [("query_key", pa.int64()), ("query_copies", pa.int64()), ("rowkey", pa.int64()),
             ("similarity_percentage", pa.float64()), ("copies", pa.int64())]


def candidates(query_ids, base_ids, query_key, query_copies, rowkey, similarity, copies) -> pa.Table:
    columns = [pa.array(x, t) for x, (_, t) in zip((query_key, query_copies, rowkey, similarity, copies), CANDIDATE)]
    return pa.table([query_ids, base_ids, *columns], names=["query_uri", "compared_uri", *(c for c, _ in CANDIDATE)])


def no_candidates(ids: pa.ChunkedArray) -> pa.Table:
    return candidates(ids.slice(0, 0), ids.slice(0, 0), [], [], [], [], [])


class _Groups:
    """Rows of a side with equal vectors (and lists) as one, the rows of a group in the order of their ids."""

    def __init__(self, side: Side, ids: np.ndarray, width: int, some: np.ndarray):
        order = some[np.argsort(ids[some], kind="stable")]
        lists = side.rows["list_id"].to_numpy() if "list_id" in side.rows.column_names else np.zeros(len(ids), np.int32)
        parts = np.empty((len(order), width + 3))
        parts[:, 0], parts[:, 1], parts[:, 2] = lists[order], side.norms[order], side.full[order]
        np.take(side.mat[:, :width], order, axis=0, out=parts[:, 3:])
        parts[:, 3:] += 0.0  # equal to its negative, but not in bytes
        _, first, group = np.unique(parts.view(f"V{parts.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(group, kind="stable")
        self.members = order[by]
        self.size = np.bincount(group, minlength=len(first))
        self.begin = np.cumsum(self.size) - self.size
        at = order[first]
        self.mat, self.norms, self.full = parts[first, 3:], side.norms[at], side.full[at]
        own = ids[self.members]
        self.ids = int(ids.max(initial=0)) + 1
        #: Sorted: where the rows of an id stand in a group.
        self.keys = group[by] * self.ids + own
        self.first = own[self.begin]
        other = np.where(own == np.repeat(self.first, self.size), NO_OTHER, own)
        self.second = np.minimum.reduceat(other, self.begin)
        #: The list of each group; groups of a list stand together.
        self.lists = lists[at]

    def rows(self, groups: np.ndarray, k: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``groups``, row): the first k rows of each group whose id isn't the one in ``without``."""
        begin, size = self.begin[groups], self.size[groups]
        low = high = begin
        if without is not None:
            known = without < self.ids
            own = groups * self.ids + np.where(known, without, 0)
            low, high = (np.where(known, np.searchsorted(self.keys, own, side), begin) for side in ("left", "right"))
        again, place = _first(begin, size, low, high, k)
        return again, self.members[place]


def _first(begin: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, place): the first k places of each stretch of ``size`` places from ``begin`` on, without those from ``low`` to ``high``."""
    take = np.minimum(size - (high - low), k)
    again = np.repeat(np.arange(len(take)), take)
    place = begin[again] + np.arange(len(again)) - np.repeat(np.cumsum(take) - take, take)
    return again, place + np.where(place >= low[again], (high - low)[again], 0)


#: Stands for the id of a row that doesn't exist.
NO_OTHER = np.iinfo(np.int64).max


def _open_lists(queries: Side, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Whether each of ``lists`` (sorted) is open to each of the query rows."""
    of = queries.rows["open"].combine_chunks().take(pa.array(rows))
    n = of.value_lengths().to_numpy(zero_copy_only=False)
    found = of.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(lists, found), len(lists) - 1)
    here = lists[place] == found
    out = np.zeros((len(rows), len(lists)), bool)
    out[np.repeat(np.arange(len(rows)), n)[here], place[here]] = True
    return out


def _hits(now: np.ndarray, enough: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the few values that reach their row's ``enough``; eight are passed over at once."""
    wide = -(-now.shape[1] // 8) * 8
    hit = room[: len(now) * wide].reshape(len(now), wide)
    hit[:, now.shape[1] :] = False
    np.greater_equal(now, enough[:, None], out=hit[:, : now.shape[1]])
    eight = np.flatnonzero(hit.reshape(-1).view(np.uint64))
    at, place = np.nonzero(hit.reshape(-1, 8)[eight])
    return np.divmod(eight[at] * 8 + place, wide)


def _until(rows: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Whether the copies of a row's entries before, in their order, are fewer than k; ``rows`` is sorted."""
    before = np.cumsum(copies) - copies
    return before - before[np.searchsorted(rows, rows)] < k


def _best(left: Side, right: Side, k: int, exclude_self: bool, metric: str, limits: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(left row, right row, similarity, NaN where undefined) of ``topk_rows``."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    l_ids, r_ids = id_codes(left.rows["id"], right.rows["id"])
    l_rows = np.flatnonzero(l_ids >= 0) if exclude_self else np.arange(len(l_ids))  # a null id differs from nothing
    r_rows = np.flatnonzero(r_ids >= 0) if exclude_self else np.arange(len(r_ids))
    if not len(l_rows) or not len(r_rows):
        return nothing
    width = min(left.mat.shape[1], right.mat.shape[1])
    cosine = metric == "cosine"
    several = "open" in left.rows.column_names
    found_rows, found_cols, found_percent = [nothing[0]], [nothing[1]], [nothing[2]]

    def keep(rows: np.ndarray, cols: np.ndarray, percent: np.ndarray) -> None:
        some = _until(rows, right.copies[cols], k)
        found_rows.append(rows[some])
        found_cols.append(cols[some])
        found_percent.append(percent[some])

    known_rows = left.full & (left.norms > 0) if cosine else left.full
    if not several and not known_rows[l_rows].all():  # nothing is similar to these: the first ids, without a look at the vectors
        blank, l_rows = l_rows[~known_rows[l_rows]], l_rows[known_rows[l_rows]]
        order = r_rows[np.argsort(r_ids[r_rows], kind="stable")]
        begin = np.zeros(len(blank), np.int64)
        low, high = (np.searchsorted(r_ids[order], l_ids[blank], side) for side in ("left", "right")) if exclude_self else (begin, begin)
        again, place = _first(begin, begin + len(order), low, high, k)
        keep(blank[again], order[place], np.full(len(again), np.nan))
    base = _Groups(right, r_ids, width, r_rows)
    defined = base.full & (base.norms > 0) if cosine else base.full
    scale = np.where(base.norms > 0, base.norms, 1.0)[:, None] if cosine else 1.0
    # cosines are selected in single precision: unit vectors' products are off by (width + 4) units of it at most, either way
    points = (base.mat / scale).astype(np.float32).T if cosine else base.mat.T
    undefined = -1e30 if cosine else -1e300
    squares = base.norms**2
    if several:
        lists, part = np.unique(base.lists, return_inverse=True)
    if exclude_self:  # groups of one id alone, in the order of these ids
        alone = np.flatnonzero(base.second == NO_OTHER)
        alone = alone[np.argsort(base.first[alone], kind="stable")]

    def exact(rows: np.ndarray, groups: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for a in range(0, len(rows), 1 << 14):
            r, g = rows[a : a + (1 << 14)], groups[a : a + (1 << 14)]
            dot = np.einsum("ij,ij->i", left.mat[r, :width], base.mat[g])
            out[a : a + (1 << 14)] = pair_similarity(dot, left.norms[r], base.norms[g], left.full[r] & base.full[g], metric)
        return out

    def as_key(percent: np.ndarray) -> np.ndarray:
        """What the matrix products estimate: the cosine, or the negative square of the distance."""
        return np.where(np.isnan(percent), undefined, percent / 100 if cosine else -((1 - percent / 100) ** 2))

    wide = max(256, SCORES // STEP)
    # the same memory for every step
    scores, hits = np.empty(STEP * wide, points.dtype), np.empty(STEP * wide, bool)
    for a in range(0, len(l_rows), STEP):
        own = l_rows[a : a + STEP]
        known = known_rows[own]
        x = left.mat[own, :width] / (np.where(left.norms[own] > 0, left.norms[own], 1.0)[:, None] if cosine else 1.0)
        if cosine:
            x = x.astype(np.float32)
        margin = np.full(len(own), 2 * (width + 4) * 2.0**-24) if cosine else 1e-9 * (1 + left.norms[own] ** 2 + squares.max())
        least = np.full(len(own), -np.inf)
        if limits is not None:
            far = ~(limits[own] < (np.pi if cosine else np.inf))
            least = np.where(far, -np.inf, (np.cos(limits[own]) if cosine else -limits[own] ** 2) - margin)

        def raised(kth: np.ndarray) -> np.ndarray:
            return np.maximum(least, np.where(kth > undefined / 10, kth - margin, np.where(kth > -np.inf, 2 * undefined, -np.inf)))

        open_ = _open_lists(left, own, lists) if several else None
        if exclude_self:  # only a group of nothing but the row's own id is out
            low, high = (np.searchsorted(base.first[alone], l_ids[own], side) for side in ("left", "right"))
            self_row, place = _first(low, high - low, low, low, len(alone))
            self_group = alone[place]
        row, group, key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        waiting: list[tuple[np.ndarray, ...]] = []
        b = 0
        while b < len(squares):
            # as many again as have passed, so that few rows of a wide step are looked at before there is a k-th best
            some = slice(b, min(len(squares), b + (wide if (least > undefined).all() else min(wide, max(256, b)))))
            b = some.stop
            use = np.flatnonzero(open_[:, np.unique(part[some])].any(1)) if several else np.arange(len(own))
            if len(use):
                now = scores[: len(use) * (some.stop - some.start)].reshape(len(use), -1)
                np.matmul(x if len(use) == len(own) else x[use], points[:, some], out=now)
                if not cosine:
                    now *= 2
                    now -= squares[some]
                    now -= (left.norms[own[use]] ** 2)[:, None]
                if not defined[some].all():
                    now[:, ~defined[some]] = undefined
                if not known[use].all():
                    now[~known[use]] = undefined
                if exclude_self:
                    here = (self_group >= some.start) & (self_group < some.stop)
                    r, c = self_row[here], self_group[here] - some.start
                    if len(use) < len(own):
                        at = np.full(len(own), -1)
                        at[use] = np.arange(len(use))
                        r, c = at[r[at[r] >= 0]], c[at[r] >= 0]
                    now[r, c] = -np.inf
                if some.start == 0 and not several and now.shape[1] > k:
                    now[np.isnan(now)] = -np.inf
                    least = raised(np.partition(now, now.shape[1] - k, axis=1)[:, now.shape[1] - k].astype(np.float64))
                enough = np.nextafter(np.maximum(least[use], 10 * undefined).astype(now.dtype), -np.inf, dtype=now.dtype)
                r, c = _hits(now, enough, hits)
                got = now[r, c].astype(np.float64)
                r, c = use[r], c + some.start
                if several:
                    here = open_[r, part[c]]
                    r, c, got = r[here], c[here], got[here]
                waiting.append((r, c, got))
            more = sum(len(x[0]) for x in waiting)
            if not more or b < len(squares) and more < 2 * len(own) and (least > undefined).all():
                continue  # few new ones wouldn't raise the k-th best much
            row, group, key = (np.concatenate(x) for x in zip((row, group, key), *waiting))
            waiting = []
            crowded = len(row) > 64 * (k + 1) * len(own)
            if crowded:  # many near ties: settle them by exact similarity and id
                key = as_key(exact(own[row], group))
                ids = base.first[group]
                ids = np.where(ids != l_ids[own[row]], ids, base.second[group]) if exclude_self else ids
                by = np.lexsort((ids, -key, row))
            else:
                by = np.lexsort((-key, row))
            row, group, key = row[by], group[by], key[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = place == k - 1
            kth = np.full(len(own), -np.inf)
            kth[row[last]] = key[last]
            least = raised(kth)
            stay = (place < k) if crowded else (key >= least[row])
            row, group, key = row[stay], group[stay], key[stay]
        percent = exact(own[row], group)
        again, cols = base.rows(group, k, l_ids[own[row]] if exclude_self else None)
        rows, percent = own[row][again], percent[again]
        order = np.lexsort((r_ids[cols], -np.where(np.isnan(percent), -np.inf, percent), rows))
        keep(rows[order], cols[order], percent[order])
    rows, cols, percent = (np.concatenate(x) for x in (found_rows, found_cols, found_percent))
    return rows, cols, percent


def topk_rows(left: Side, right: Side, k: int, exclude_self: bool, metric: str = "cosine") -> pa.Table:
    """Per left row, the k best right rows by (similarity desc, nulls last, id asc).

    Right rows with equal vectors are scored once. They pass in steps, each
    compared with the k-th best so far, so few similarities are looked at
    twice. The matrix products only select, with a margin for their rounding;
    what they leave is scored again one by one, so equal vectors score equally
    in every block. ``copies`` counts equal rows collapsed before; an entry
    stands for all of them, and rows are kept until the copies before them reach k.
    Left rows are finished ``STEP`` at a time, so that beside the vectors only
    the k entries of each row are held. Left rows without a direction have no
    similarity to anything: they get the first ids and no product is taken.
    Lists that are not open to a row are left out, and so is what its limit
    shows to be worse than its k best.
    """
    limits = left.rows["limit"].to_numpy() if "limit" in left.rows.column_names else None
    rows, cols, percent = _best(left, right, k, exclude_self, metric, limits)
    if not rows.size:
        return no_candidates(left.rows["id"])
    q, b = left.rows.select(["id", "rowkey"]).take(pa.array(rows)), right.rows.select(["id", "rowkey"]).take(pa.array(cols))
    similarity = pa.array(percent, mask=np.isnan(percent))
    return candidates(q["id"], b["id"], q["rowkey"].combine_chunks(), left.copies[rows], b["rowkey"].combine_chunks(), similarity, right.copies[cols])


class Running:
    """``topk_rows`` of one side against right sides that come one after another; only the k best so far are held."""

    def __init__(self, left: Side, k: int, exclude_self: bool, metric: str = "cosine"):
        self.left, self.k, self.exclude_self, self.metric = left, k, exclude_self, metric
        self.rows, self.percent = np.zeros(0, np.int64), np.zeros(0)
        self.found = None  # id, rowkey and copies of each entry
        self.limits = None

    def meet(self, right: Side) -> None:
        rows, cols, percent = _best(self.left, right, self.k, self.exclude_self, self.metric, self.limits)
        found = right.rows.select(["id", "rowkey", "copies"]).take(pa.array(cols))
        if self.found is not None:
            rows, percent = np.r_[self.rows, rows], np.r_[self.percent, percent]
            found = pa.concat_tables([self.found, found])
        codes, _ = id_codes(found["id"], found["id"].slice(0, 0))
        order = np.lexsort((codes, -np.where(np.isnan(percent), -np.inf, percent), rows))
        rows, copies = rows[order], found["copies"].to_numpy()[order]
        some = _until(rows, copies, self.k)
        self.rows, copies, order = rows[some], copies[some], order[some]
        self.percent, self.found = percent[order], found.take(pa.array(order)).combine_chunks()
        held = np.bincount(self.rows, copies, len(self.left.rows)) >= self.k
        last = np.flatnonzero(np.r_[self.rows[1:] != self.rows[:-1], True][: len(self.rows)])
        kth = np.full(len(self.left.rows), np.nan)
        kth[self.rows[last]] = self.percent[last] / 100
        cosine = self.metric == "cosine"
        self.limits = np.where(held & ~np.isnan(kth), np.arccos(np.clip(kth, -1, 1)) if cosine else 1 - kth, np.pi if cosine else np.inf)

    def table(self) -> pa.Table:
        if self.found is None or not len(self.rows):
            return no_candidates(self.left.rows["id"])
        q = self.left.rows.select(["id", "rowkey"]).take(pa.array(self.rows))
        similarity = pa.array(self.percent, mask=np.isnan(self.percent))
        return candidates(q["id"], self.found["id"], q["rowkey"].combine_chunks(), self.left.copies[self.rows],
                          self.found["rowkey"].combine_chunks(), similarity, self.found["copies"].combine_chunks())
