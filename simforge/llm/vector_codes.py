"""Vector codes: product codebooks trained and searched by equal averages.

Vectors are scaled to integers and cut into equal parts; each part has a codebook of its
own.  By the Cauchy-Schwarz inequality the squared difference of two parts' component
sums, divided by their dimension, is at most their squared distance.  So the entries are
sorted by component sum, a part starts at its own sum and goes outward in both
directions, and a direction ends where that quotient strictly exceeds the best distance
met (an equal one may still hold a tie).  Parts are searched in blocks of near sums, so
that each step is one matrix product; a part leaves its block's steps on its own terms.

A round of training sums, in each task, the parts of every entry that the task has seen;
only these sums are shuffled.  The codebooks are the one thing that goes through the
driver: ``entries`` rows of the vectors' width, whatever the number of vectors.

Defined cases: rows whose vector is null, or holds null or non-finite components, are
dropped.  Shorter vectors count as if zeros followed, up to the longest one's length,
rounded up to a multiple of the number of parts.  The first codebook takes rows by
(vec_id, vector), a null vec_id after all others; with fewer rows than entries there are
as many entries as rows.  Rows that repeat an id each have a code.  Magnitudes whose
distances don't fit a long raise.  An empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm import frames

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Parts of near sums that are searched together, entries of one step, and vectors turned into a matrix at once.
BLOCK, STEP, SLICE = 512, 32, 4096

_FINE = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def quantise(column: pa.Array, width: int, scale: float = SCALE) -> np.ndarray:
    """floor(scale * component) of each vector, as whole doubles, with zeros up to ``width``."""
    n = np.asarray(pc.list_value_length(column)).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _exact(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles while every square stays exact, else as longs."""
    reach = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) * x.shape[1]
    if reach >= 2.0**30:
        raise OverflowError("components too large for exact distances")
    if reach < 2.0**25:  # (2 * reach) ** 2 < 2 ** 53
        return x.astype(np.float64), book.astype(np.float64)
    return x.astype(np.int64), book.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray, met: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part's nearest entry, ties to the lower one.  ``met`` gets the numbers of distances computed."""
    x, book = _exact(x, book)
    dim = max(1, x.shape[1])
    order = np.argsort(book.sum(1), kind="stable")
    total, square = book.sum(1)[order], (book * book).sum(1)
    sums = x.sum(1)
    entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    by = np.argsort(sums, kind="stable")
    for begin in range(0, len(by), BLOCK):
        rows = by[begin : begin + BLOCK]
        part, s = x[rows], sums[rows]
        own, best, at = (part * part).sum(1), np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(book))

        def step(some: np.ndarray, a: int, b: int) -> None:
            columns = np.sort(order[a:b])  # by index, so that the first least one is the lowest
            d = own[some, None] - 2 * (part[some] @ book[columns].T) + square[columns]
            first = d.argmin(1)
            d, c = d[np.arange(len(some)), first].astype(np.int64), columns[first]
            better = (d < best[some]) | (d == best[some]) & (c < at[some])
            best[some[better]], at[some[better]] = d[better], c[better]
            if met is not None:
                met.append(len(some) * (b - a))

        middle = int(np.searchsorted(total, s[len(s) // 2]))
        low, high = max(0, middle - STEP // 2), min(len(total), middle + STEP // 2)
        step(np.arange(len(rows)), low, high)
        while low > 0 or high < len(total):
            if high < len(total):
                gap = np.maximum(total[high] - s, 0)
                some = np.flatnonzero(gap * gap <= dim * best.astype(gap.dtype))
                end = min(len(total), high + STEP) if len(some) else len(total)
                if len(some):
                    step(some, high, end)
                high = end
            if low > 0:
                gap = np.maximum(s - total[low - 1], 0)
                some = np.flatnonzero(gap * gap <= dim * best.astype(gap.dtype))
                end = max(0, low - STEP) if len(some) else 0
                if len(some):
                    step(some, end, low)
                low = end
        entry[rows], distance[rows] = at, best
    return entry, distance


def _matrices(batches: Iterator[pa.RecordBatch], width: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            some = batch.slice(a, SLICE)
            yield some, quantise(some["embedding"], width, scale)


def _cut(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for p, part in enumerate(np.split(x, len(books), axis=1)):
        yield p, part


def _summed(books: np.ndarray, scale: float):
    """The sums of the parts nearest to each entry, of what one task has read."""
    parts, entries, dim = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, x in _matrices(batches, parts * dim, scale):
            for p, part in _cut(x, books):
                entry, _ = nearest(part, books[p])
                np.add.at(total[p], entry, part.astype(np.int64))
                count[p] += np.bincount(entry, minlength=entries)
        p, e = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * dim, pa.int32()), pa.array(total[p, e].reshape(-1), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), sums], ["part", "entry", "n", "sums"])

    return run


def usable(vectors: DataFrame, *others: str) -> DataFrame:
    """(vec_id, embedding, others) of the rows that take part."""
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), *others).filter(_FINE)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> np.ndarray:
    """Codebooks as whole numbers: part, entry, component."""
    rows = usable(vectors)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toArrow()
    x = quantise(first["embedding"].combine_chunks(), width, scale).astype(np.int64)
    books = np.stack(np.split(x, parts, axis=1))
    for _ in range(rounds if len(first) and width else 0):
        seen = rows.select("embedding").mapInArrow(_summed(books, scale), "part int, entry int, n long, sums array<long>")
        seen = seen.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at")
        sums = seen.agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("string").alias("x"), F.sum("n").alias("n")).toArrow()
        part, entry, at, x, n = (sums[c].to_pylist() for c in ("part", "entry", "at", "x", "n"))
        books = books.copy()
        books[part, entry, at] = [int(a) // b for a, b in zip(x, n)]
    return books


def encode(vectors: DataFrame, books: np.ndarray, *others: str, scale: float = SCALE) -> DataFrame:
    """(vec_id, others, code, error): each part's entry in two hexadecimal digits, and the squared distances summed."""
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = ", ".join(["vec_id long", *(f"`{c}` {types[c]}" for c in others), "code string", "error long"])
    digits = np.array([f"{i:02x}" for i in range(max(256, books.shape[1]))], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, books.shape[0] * books.shape[2], scale):
            code, error = np.full(len(x), "", dtype=object), np.zeros(len(x), np.int64)
            for p, part in _cut(x, books):
                entry, distance = nearest(part, books[p])
                code, error = code + digits[entry], error + distance
            names = ["vec_id", *others]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(code, pa.string()), pa.array(error)], [*names, "code", "error"])

    return usable(vectors, *others).mapInArrow(run, schema)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The whole numbers that a code stands for."""
    return np.concatenate([book[int(code[2 * p : 2 * p + 2], 16)] for p, book in enumerate(books)])


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def coded(vectors: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """Codes and errors, each label's summed error, and a digest of the codebooks."""
    books = train(vectors, entries=entries)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    rows = frames.settled(encode(vectors, books, "label"), "codes")
    # A written table of one row a label: Spark broadcasts it while it is small, else splits skewed labels.
    sums = frames.settled(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    joined = rows.join(sums, rows["label"].eqNullSafe(sums["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(i: int) -> str:
    """Codebook i from the parts' nearest entries of codebook i - 1."""
    return f""", a{i} as (
  select p.vec_id, p.part, any_value(p.v) v,
    min(cast(list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v) as bigint) * 256 + b.entry) best
  from p join b{i - 1} b using (part) group by p.vec_id, p.part
), m{i} as (
  select part, best % 256 entry, pos, floor(sum(x) / count(*)) x
  from (select part, best, unnest(v) x, unnest(range(len(v))) pos from a{i}) group by part, best % 256, pos
), b{i} as (
  select b.part, b.entry, coalesce(m.v, b.v) v from b{i - 1} b
  left join (select part, entry, list(x order by pos) v from m{i} group by part, entry) m on m.part = b.part and m.entry = b.entry
)"""


ORACLE = f"""
with kept as (
  select vec_id, label, list_transform(cast(embedding as double[]), lambda x: floor(1024 * x)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as (
  select vec_id, label, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] v
  from kept, (select unnest(range(4)) part)
), b0 as (
  select part, v, row_number() over (partition by part order by vec_id) - 1 entry
  from p where vec_id in (select vec_id from kept order by vec_id limit 256)
){"".join(_round(i) for i in range(1, 6))}, coded as (
  select vec_id, string_agg(format('{{:02x}}', best % 256), '' order by part) code, cast(sum(best // 256) as bigint) error
  from a5 group by vec_id
)
select c.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) label_error,
  (select sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by part, entry, pos))
   from (select part, entry, unnest(v) x, unnest(range(len(v))) pos from b4)) codebooks_sha256
from coded c join kept k using (vec_id)
"""
