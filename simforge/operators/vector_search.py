"""Exact and blocked vector similarity operators.

Design at scale
---------------
All-pairs similarity is quadratic by nature; what must not happen is an
n*n row shuffle or one task holding a hot key. Rows are

1. collapsed to distinct ``(id, vector, other columns)`` with a copy count
   (map-side partial aggregation, so a key holding a third of all rows
   collapses before the shuffle and exact copies are scored once);
2. dealt by a hash of id *and* vector, so a hot id with many distinct vectors
   is still spread: as queries to parts and as base rows to bands, both of a
   few blocks of a fixed number of *bytes*, so wide vectors don't overfill a task;
3. brought together in cells, one a part and band, of which each is one task:
   a row goes to one cell a band as a query and to one cell a part as a base row;
4. scored as they stream in: a task holds its queries, meets the base rows of
   its band one block after another by matrix products, and carries each
   query's k-th best from one to the next, so that later blocks yield few
   candidates; it emits k of them per query: n * bands * k in all;
5. reduced to the final top-k per id with ``row_number() <= k``, which
   Catalyst plans as a partial + final ``WindowGroupLimit``.

Vectors without a direction are similar to nothing, so as queries they get the
first ids without a product.

Ranking uses the unrounded similarity; only the shown columns are rounded.
Searches (``knn_join``) use the same kernel with the query side replicated
over base blocks, which is a shuffle of the (small) query set instead of a
driver-side broadcast. For corpora where all pairs are too many, see ``ivf``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import Running, Side, no_candidates, similarity_percentage, topk_rows

PCT_SCALE = 4
#: Vectors of one side of a cell, in bytes.
BLOCK_BYTES = 16 << 20
#: Blocks of query rows that one task holds, and blocks of base rows that it meets at most, one after another.
QUERY_BLOCKS, BAND_BLOCKS = 2, 8


def _parallelism(df: DataFrame) -> int:
    try:
        return max(1, df.sparkSession.sparkContext.defaultParallelism)
    except Exception:  # pragma: no cover - connect sessions
        return 8


def row_key(df: DataFrame, id_col: str, vec_col: str) -> Column:
    """Tells rows of one id apart by vector and other columns."""
    others = [F.col(c) for c in sorted(df.columns) if c not in (id_col, vec_col)]
    return F.xxhash64(F.col(vec_col).cast("array<double>"), *others)


def collapse_copies(df: DataFrame, id_col: str, vec_col: str, null_ids: bool = False) -> DataFrame:
    """Distinct rows as ``id, vec, rowkey`` with the number of ``copies``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                     row_key(df, id_col, vec_col).alias("rowkey"))
    if not null_ids:
        rows = rows.where(F.col("id").isNotNull())
    return rows.groupBy("id", "vec", "rowkey").agg(F.count(F.lit(1)).alias("copies"))


def block_rows_for(width: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(256, block_bytes // (8 * max(1, width)))


def _size(df: DataFrame, vec_col: str) -> tuple[int, int]:
    """Rows and widest vector, in one pass."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("w")).first()
    return r["n"], max(1, r["w"] or 1)


def least_cells(n_rows: int, parallelism: int, block_rows: int) -> int:
    """2x the cores, and where a cell takes long 4x, so that the last ones don't leave cores idle."""
    return (4 if n_rows > block_rows else 2) * parallelism


def choose_blocks(n_rows: int, parallelism: int, block_rows: int) -> int:
    """Parts of the queries, of ``QUERY_BLOCKS`` blocks at most, or about as many as bands where that would be too few cells."""
    few = math.isqrt(least_cells(n_rows, parallelism, block_rows) - 1) + 1
    return max(1, math.ceil(n_rows / (max(1, block_rows) * QUERY_BLOCKS)), min(n_rows, few))


def choose_bands(n_rows: int, parallelism: int, block_rows: int, blocks: int) -> int:
    """Bands of base rows, of ``BAND_BLOCKS`` blocks at most."""
    few = math.ceil(least_cells(n_rows, parallelism, block_rows) / blocks)
    return max(1, math.ceil(n_rows / (max(1, block_rows) * BAND_BLOCKS)), min(n_rows, few))


def _result_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("query_uri", id_type),
        T.StructField("compared_uri", id_type),
        T.StructField("query_key", T.LongType()),
        T.StructField("query_copies", T.LongType()),
        T.StructField("rowkey", T.LongType()),
        T.StructField("similarity_percentage", T.DoubleType()),
        T.StructField("copies", T.LongType()),
    ])


def ranked_topk(cands: DataFrame, k: int, per_row: bool = True) -> DataFrame:
    """Expand collapsed copies (at most k per candidate) and rank, unrounded.

    ``per_row``: every query row has its own k best, and a row given several
    times gets its hits as often. Otherwise all rows of an id share one ranking.
    """
    copies = F.col("copies") if per_row else F.col("copies") * F.col("query_copies")
    expanded = cands.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(copies, F.lit(k)).cast("long"))))
    w = Window.partitionBy("query_uri", *["query_key"] * per_row).orderBy(
        F.col("similarity_percentage").desc_nulls_last(), F.col("compared_uri").asc(), F.col("rowkey").asc())
    ranked = expanded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if per_row:
        ranked = ranked.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("query_copies"))))
    return ranked.select("query_uri", F.col("rank").cast("long").alias("rank"), "compared_uri", "rowkey", "similarity_percentage")


def shown(hits: DataFrame) -> DataFrame:
    """The public columns, with the similarity rounded."""
    return hits.select("query_uri", "rank", "compared_uri",
                       F.round("similarity_percentage", PCT_SCALE).alias("similarity_percentage"))


def knn_self_join(df: DataFrame, id_col: str = "uri", vec_col: str = "embedding", k: int = 10,
                  exclude_self: bool = True, block_rows: int | None = None,
                  num_blocks: int | None = None, metric: str = "cosine") -> DataFrame:
    """V9 + J1 + V10 (flat): for every id, its k most similar other rows.

    Output ``query_uri, rank, compared_uri, similarity_percentage``; ids without
    any partner are absent; null similarities rank last; ties by id. One
    aggregate over the table sizes the cells; ``num_blocks`` sets the number of
    parts of the queries.
    """
    id_type = df.schema[id_col].dataType
    rows = collapse_copies(df, id_col, vec_col, null_ids=not exclude_self)
    n, width = _size(df, vec_col)
    per_block = block_rows or block_rows_for(width)
    blocks = int(num_blocks or choose_blocks(n, _parallelism(df), per_block))
    bands = choose_bands(n, _parallelism(df), per_block, blocks)
    # the two parts of a cell, its queries before its base rows
    h = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 40))
    own = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: 2 * (F.col("h") % blocks * bands + i))
    other = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: 2 * (i * bands + F.shiftright("h", 20) % bands) + 1)
    cells = rows.withColumn("h", h).withColumn("part", F.explode(F.concat(own, other).cast("array<int>"))).drop("h")
    dealt = cells.repartitionById(blocks * bands, F.shiftright("part", 1)).sortWithinPartitions("part")
    schema = _result_schema(id_type)
    cands = dealt.mapInArrow(_streamed_topk(k, exclude_self, metric, per_block), schema)
    return shown(ranked_topk(cands, k, per_row=False))


def _streamed_topk(k: int, exclude_self: bool, metric: str, block_rows: int):
    """Of rows sorted by ``part``, 2 c for the queries of a cell c and 2 c + 1 for its base rows, each query's k best."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            part = batch["part"].to_numpy()
            begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            for a, b in zip(begin, [*begin[1:], len(part)]):
                yield int(part[a]), batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, best = -1, None

        def passed() -> None:
            nonlocal best
            if held:
                side = Side(pa.Table.from_batches(held))
                held.clear()
                if at % 2 == 0:
                    best = Running(side, k, exclude_self, metric)
                elif best is not None:
                    best.meet(side)

        for part, piece in parts(batches):
            if part != at:
                passed()
                if part // 2 != at // 2:
                    if best is not None:
                        yield from best.table().to_batches()
                    best = None
                at = part
            held.append(piece)
            if at % 2 and sum(map(len, held)) >= block_rows:
                passed()
        passed()
        if best is not None:
            yield from best.table().to_batches()

    return run


def knn_join(queries: DataFrame, base: DataFrame, k: int = 10, q_id: str = "uri",
             q_vec: str = "embedding", b_id: str = "uri", b_vec: str = "embedding",
             exclude_self: bool = False, block_rows: int | None = None,
             query_blocks: int | None = None, base_blocks: int | None = None,
             metric: str = "cosine") -> DataFrame:
    """J5 / V6 for many queries: every query row x its k nearest base rows, unrounded.

    A query row given several times gets its k nearest rows as often.

    Query and base are split into blocks; each cell (query block, base block)
    is one cogroup task. Queries are replicated once per base block and base
    rows once per query block, so a single query costs no base replication.
    """
    id_type = queries.schema[q_id].dataType
    q = collapse_copies(queries, q_id, q_vec, null_ids=not exclude_self)
    b = collapse_copies(base, b_id, b_vec, null_ids=not exclude_self)
    if base_blocks is None or query_blocks is None:
        n, width = _size(base, b_vec)
        per_block = block_rows or block_rows_for(width)
        query_blocks = query_blocks or max(1, math.ceil(queries.count() / per_block))
        base_blocks = base_blocks or max(2 * _parallelism(base) // query_blocks, math.ceil(n / per_block), 1)
    QB, BB = int(query_blocks), int(base_blocks)
    qx = (q.withColumn("qb", F.pmod(F.xxhash64("id", "vec"), F.lit(QB)).cast("int"))
           .withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(BB - 1)))))
    bx = (b.withColumn("bb", F.pmod(F.xxhash64("id", "vec"), F.lit(BB)).cast("int"))
           .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(QB - 1)))))
    return ranked_topk(cogroup_topk(qx, bx, ["qb", "bb"], k, exclude_self, id_type, metric, QB * BB), k)


def cogroup_topk(qx: DataFrame, bx: DataFrame, keys: list[str], k: int, exclude_self: bool,
                 id_type: T.DataType, metric: str = "cosine", cells: int = 0,
                 of_queries: list[str] | None = None, of_base: list[str] | None = None) -> DataFrame:
    """Partial top-k candidates per cell; both sides hold ``id, vec, rowkey, copies`` + ``keys``.

    ``cells``: how many there are, where known, for two partitions each. ``of_queries`` and
    ``of_base``: columns of one side that the kernel reads (see ``Side``).
    """

    def cell(queries: pa.Table, base: pa.Table) -> pa.Table:
        if not len(queries) or not len(base):
            return no_candidates((queries if len(queries) else base)["id"])
        return topk_rows(Side(queries), Side(base), k, exclude_self, metric)

    cols = ["id", "vec", "rowkey", "copies", *keys]
    parts = max(int(qx.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * cells)
    dealt = [x.select(*cols, *(more or [])).repartition(parts, *keys).groupBy(*keys) for x, more in ((qx, of_queries), (bx, of_base))]
    return (dealt[0].cogroup(dealt[1])
              .applyInArrow(cell, schema=_result_schema(id_type)))


def neighbours_nested(flat: DataFrame) -> DataFrame:
    """``query_uri, top_10_similar ARRAY<STRUCT<compared_uri, similarity_percentage>>``.

    The per-query list is already limited to k rows, so collecting it is bounded.
    """
    return (flat.groupBy("query_uri")
                .agg(F.array_sort(F.collect_list(F.struct("rank", "compared_uri",
                                                          "similarity_percentage"))).alias("l"))
                .select("query_uri",
                        F.transform("l", lambda s: F.struct(
                            s["compared_uri"].alias("compared_uri"),
                            s["similarity_percentage"].alias("similarity_percentage")))
                        .alias("top_10_similar")))


def search_by_id(base: DataFrame, query_uri, k: int = 10, id_col: str = "uri",
                 vec_col: str = "embedding", exclude_self: bool = False, metric: str = "cosine") -> DataFrame:
    """V6 + V8 for one query given by id (K7 point lookup; D14: unknown id -> empty).

    The query vector is looked up with a pushed-down point filter and joined
    to the base through the blocked kernel, so no row passes through the driver.
    """
    queries = base.where(F.col(id_col) == F.lit(query_uri))
    return search(base, queries, k=k, id_col=id_col, vec_col=vec_col, exclude_self=exclude_self,
                  query_blocks=1, metric=metric)


def search(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "uri",
           vec_col: str = "embedding", exclude_self: bool = False,
           query_blocks: int | None = None, metric: str = "cosine") -> DataFrame:
    """V6/V8: ``query_uri, rank, uri, distance, similarity_percentage`` + base columns.

    Hits carry the key of the base row itself, so rows that share an id keep
    their own columns.
    """
    hits = knn_join(queries, base, k=k, q_id=id_col, q_vec=vec_col, b_id=id_col, b_vec=vec_col,
                    exclude_self=exclude_self, query_blocks=query_blocks, metric=metric)
    others = [c for c in base.columns if c not in (id_col, vec_col)]
    if others:
        own = base.select(F.col(id_col).alias("_uri"), row_key(base, id_col, vec_col).alias("_key"), *others).distinct()
        hits = hits.join(own, hits["compared_uri"].eqNullSafe(own["_uri"]) & (hits["rowkey"] == own["_key"]), "left")
    return hits.select(
        "query_uri", "rank", F.col("compared_uri").alias(id_col),
        F.round(F.lit(1.0) - F.col("similarity_percentage") / 100.0, 6).alias("distance"),
        F.round("similarity_percentage", PCT_SCALE).alias("similarity_percentage"), *others)


def search_single_native(base: DataFrame, query_vector: list[float], k: int = 10,
                         id_col: str = "uri", vec_col: str = "embedding") -> DataFrame:
    """V6 for one literal query vector with JVM-side expressions only.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each partition
    keeps its k best rows, so only k rows per partition are exchanged.
    """
    qv = F.array(*[F.lit(float(x)) for x in query_vector]).cast("array<double>")
    scored = base.select(F.col(id_col), similarity_percentage(qv, F.col(vec_col).cast("array<double>"))
                         .alias("_similarity"))
    best = scored.orderBy(F.col("_similarity").desc_nulls_last(), F.col(id_col).asc()).limit(k)
    return best.select(id_col, F.round("_similarity", PCT_SCALE).alias("similarity_percentage"))


def dedupe_by_uri(df: DataFrame, id_col: str = "uri", order_cols=None) -> DataFrame:
    """V3 / O4 / O5 (D8 re-aimed): the first row of each id by the given columns, nulls last, then by the others.

    A minimum of structs combines before the shuffle, so a hot id is no sort of one task.
    """
    others = [c for c in df.columns if c != id_col]
    order = [*(order_cols or others), *others]
    key = F.struct(*(x for i, c in enumerate(dict.fromkeys(order)) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))))
    place = {c: f"c{i}" for i, c in enumerate(dict.fromkeys(order))}
    first = df.groupBy(id_col).agg(F.min(key).alias("_first"))
    return first.select(*(F.col(c) if c == id_col else F.col("_first")[place[c]].alias(c) for c in df.columns))


def limit_rows(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """V2 / O3: a deterministic LIMIT (the reference's row cap before inference)."""
    return df.orderBy(F.col(order_col).asc()).limit(n)


def empty_embeddings(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """K8: rows whose vector is empty."""
    return df.where(F.size(F.col(vec_col)) == 0)


def drop_empty_embeddings(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """K8 delete: the complement of :func:`empty_embeddings` (null vectors kept, as SQL would)."""
    return df.where(~(F.coalesce(F.size(F.col(vec_col)) == 0, F.lit(False))))
