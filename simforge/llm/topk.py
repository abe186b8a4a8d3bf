"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are cut into segments.  With the mean m and the deviation norm s of each, the
inner product of two vectors is at most sum(length * m m' + s s') over the segments,
which is a lower bound of their distance as |q - x|^2 = |q|^2 + |x|^2 - 2 q x.  A block of
vectors is bounded for a block of queries with a few segments first, then, where a pair
could still enter the query's best k, with more; the exact product is taken for the
survivors.  Bounds are matrix products of the statistics and get a margin for rounding.

Blocks of the stated queries meet blocks of all vectors, one pair of blocks a row, so
that tasks are bounded and even; each pair returns at most k rows of a query.  Neither
side passes through the driver.

Defined cases: rows with a null id, a null vector, or a null or non-finite component
take no part; of rows that repeat an id the least vector counts; vectors of unequal
length are compared over the shorter one's length; products beyond 2 ** 63 raise; with
fewer than k candidates all are returned; an empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK, CHUNK = 16_384, 4096, 1024
SEGMENTS = (4, 16)


def quantise(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """floor(256 * component) of each vector, with zeros up to the longest."""
    n = np.asarray(pc.list_value_length(column)).astype(np.int64)
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(n), max(int(n.max(initial=0)), width or 0)))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviation norms, whose products bound inner products from above."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        mean = x[:, a:b].mean(1)
        out += [mean * np.sqrt(b - a), np.sqrt(((x[:, a:b] - mean[:, None]) ** 2).sum(1))]
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products as integers."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if top >= 2.0**63:
        raise OverflowError("an inner product does not fit a long")
    if top < 2.0**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))


def best(queries: np.ndarray, query_id: np.ndarray, base: np.ndarray, base_id: np.ndarray, k: int, met: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """(query row, id, score) of each query's best k of a block.  ``met`` gets the numbers of exact products."""
    order = np.argsort(-(base**2).sum(1), kind="stable")  # long vectors first: thresholds rise early
    base, base_id = base[order], base_id[order]
    levels = [(statistics(queries, s), statistics(base, s)) for s in SEGMENTS]
    q_norm, norm = np.sqrt((queries**2).sum(1)), np.sqrt((base**2).sum(1))
    top = np.abs(queries).max(initial=0) * np.abs(base).max(initial=0) * max(1, queries.shape[1])
    rows, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    least = np.full(len(queries), -np.inf)
    for a in range(0, len(base), CHUNK):
        chunk = slice(a, min(a + CHUNK, len(base)))
        alive = query_id[:, None] != base_id[None, chunk]
        for of_query, of_base in levels:
            some = np.flatnonzero(alive.any(1))
            bound = of_query[some] @ of_base[chunk].T
            # rounding grows with the terms of the sum, which the norms bound
            alive[some] &= bound + 1e-6 + 1e-12 * q_norm[some, None] * norm[None, chunk] >= least[some, None]
        r, c = np.nonzero(alive)
        if not len(r):
            continue
        if met is not None:
            met.append(len(r))
        if top < 2.0**53 and len(r) > alive.size // 32:  # most survive: one exact matrix product
            some = np.flatnonzero(alive.any(1))
            product = np.where(alive[some], queries[some] @ base[chunk].T, -np.inf)
            if product.shape[1] > k:  # what can't be among the best of this chunk alone
                kth = np.partition(product, product.shape[1] - k, axis=1)[:, product.shape[1] - k]
                product[product < np.maximum(kth, least[some])[:, None]] = -np.inf
            r, c = np.nonzero(product > -np.inf)
            got, r = product[r, c].astype(np.int64), some[r]
        else:
            got = np.concatenate([_exact(queries[r[i : i + 200_000]], base[a + c[i : i + 200_000]]) for i in range(0, len(r), 200_000)])
            enter = got >= least[r]
            r, c, got = r[enter], c[enter], got[enter]
        rows, ids, scores = np.r_[rows, r], np.r_[ids, base_id[a + c]], np.r_[scores, got]
        by = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[by], ids[by], scores[by]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
        last = place[keep] == k - 1
        least[rows[last]] = scores[last]
    return rows, ids, scores


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, base in zip(batch["queries"], batch["vectors"]):
                queries, base = queries.values, base.values
                width = max(int(pc.max(pc.list_value_length(x.field("embedding"))).as_py() or 0) for x in (queries, base))
                q, x = (quantise(v.field("embedding"), width) for v in (queries, base))
                query_id, base_id = (v.field("vec_id").to_numpy() for v in (queries, base))
                rows, ids, scores = best(q, query_id, x, base_id, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_id[rows]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` holds, against all others."""
    fine = "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(fine)
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = rows.agg(F.count("*"), F.count_if(F.expr(is_query))).first()
    base_blocks, query_blocks = max(1, -(-sizes[0] // BLOCK)), max(1, -(-sizes[1] // QUERY_BLOCK))
    member = F.collect_list(F.struct("vec_id", "embedding"))
    base = rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(base_blocks)).cast("int").alias("b")).agg(member.alias("vectors"))
    queries = rows.filter(is_query).groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("q")).agg(member.alias("queries"))
    base = base.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = queries.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(base_blocks - 1))))
    # merged, never broadcast: by the size of the queries before they are repeated for each block, the driver would gather all repeats
    found = base.join(queries.hint("merge"), ["q", "b"]).select("queries", "vectors").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")


ORACLE = """
with v as (
  select vec_id, list_transform(cast(embedding as double[]), lambda x: floor(256 * x)) e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id query_id, b.vec_id, cast(list_inner_product(q.e, b.e) as bigint) score
  from v q join v b on q.vec_id <> b.vec_id
  where q.vec_id % 50 = 0
)
select query_id, cast(r as int) "rank", vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) r from scored
) where r <= 5
"""
