"""IVF index (V4), exact and approximate search (V5), and all pairs of clustered vectors.

Index
-----
Lists have two levels: some top centroids, and under each some leaf centroids.
Both are fitted on bounded samples (``SAMPLE_BYTES`` for the tops,
``LEAF_SAMPLE`` rows a list for the leaves, those of one top in one task); a
vector goes to the nearest leaf of its nearest top. The index is a written
table partitioned by ``list_id`` plus one row a list: centroid, number of
rows, and radius, the largest angle (or distance) of a member. Only that
small table passes the driver, bounded by ``MAX_CENTROID_BYTES``, not by the
data. Vectors that have no direction (null, empty, zero) are kept in
``ODD_LIST``; their similarities are null and rank last, by id, so a few
of the smallest ids stand for them in every search.

Search
------
By the triangle inequality no member of a list is nearer to a query than the
distance to its centroid less its radius. A first round reads the lists
nearest to each query and gives its k-th best so far; the second round ships
the query only to lists which that bound lets hold something better, and a
list that no query needs is not read at all (partition pruning). That is
exact for ``stop=1``. A smaller ``stop`` shrinks the radii; ``stop_for``
chooses it by the recall measured on a sample of queries.

Neighbouring lists that a block has room for share a shelf. A query row goes
once to a shelf, with the names of its lists there and its k-th best so far,
so rows are repeated by shelves, not by lists, and only the lists named are
scored. A cell is ``(shelf, sub-block of the shelf, block of the shelf's
queries)``, numbered by the counts of both, so neither a long list nor many
queries of one shelf fill a task.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import METRICS, stack_vectors
from ..session import settled, shared_folder
from .vector_search import (_parallelism, _result_schema, block_rows_for, cogroup_topk, collapse_copies, ranked_topk,
                            shown)

#: Centroids are sent to every task; more than this is refused.
MAX_CENTROID_BYTES = 64 << 20
#: Vectors on which the top centroids are fitted, in bytes, and rows a list on which the leaves are.
SAMPLE_BYTES, LEAF_SAMPLE = 16 << 20, 64
#: Queries on which the recall of a search is measured.
RECALL_SAMPLE = 256
ODD_LIST = -1
#: Angles of query rows to centroids that a task holds at once.
PAIRS = 1 << 20
#: For the rounding of angles and distances.
MARGIN = 1e-6


@dataclass
class IvfIndex:
    assignments: DataFrame      # id, vec, rowkey, copies, list_id
    centroids: np.ndarray       # num_lists x dim (unit length for cosine)
    id_type: T.DataType
    radius: np.ndarray          # largest angle or distance of a member
    rows: np.ndarray            # distinct rows of each list
    metric: str = "cosine"
    odd_rows: int = 0
    path: str | None = None
    #: Lists and (query row, list) pairs that the last search read or shipped, and could have.
    read: dict = field(default_factory=dict)


# ---------------------------------------------------------------------------
# centroids
# ---------------------------------------------------------------------------

def _points(vectors: pa.ChunkedArray | pa.Array, width: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as the metric sees them, with ``width`` components, and the norms of the whole vectors."""
    mat, norms, _ = stack_vectors(vectors)
    if metric == "cosine":
        mat = mat / np.where(norms > 0, norms, 1.0)[:, None]
    out = np.zeros((len(mat), width))
    common = min(width, mat.shape[1])
    out[:, :common] = mat[:, :common]
    return out, norms


def _distances(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Angles, or Euclidean distances, of points to centroids."""
    dot = x @ centroids.T
    if metric == "cosine":
        return np.arccos(np.clip(dot, -1.0, 1.0))
    return np.sqrt(np.maximum((norms**2)[:, None] + (centroids**2).sum(1) - 2 * dot, 0.0))


def _kmeans(x: np.ndarray, k: int, metric: str, rounds: int, seed: int) -> np.ndarray:
    """At most k centroids of a bounded sample, by spread-out starts and Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    start = [int(rng.integers(len(x)))]
    near = ((x - x[start[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        total = near.sum()
        start.append(int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x))))
        near = np.minimum(near, ((x - x[start[-1]]) ** 2).sum(1))
    centroids = np.unique(x[start], axis=0)
    for _ in range(rounds):
        own = ((centroids**2).sum(1)[None] - 2 * x @ centroids.T).argmin(1)
        count = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
        if metric == "cosine":
            length = np.sqrt((moved**2).sum(1))
            moved = np.where(length[:, None] > 0, moved / np.where(length > 0, length, 1.0)[:, None], centroids)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def _shares(weights: np.ndarray, total: int) -> np.ndarray:
    """``total`` split in whole numbers by weight, at least one each."""
    exact = weights / weights.sum() * (total - len(weights))
    out = np.floor(exact).astype(int)
    out[np.argsort(out - exact, kind="stable")[: total - len(weights) - out.sum()]] += 1
    return out + 1


def _fit(plain: DataFrame, n: int, width: int, num_lists: int, metric: str, rounds: int, seed: int, sample_bytes: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(top centroids, first list of each top, leaf centroids of each top)."""
    part = F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 30))

    def some(rows: int) -> DataFrame:
        return plain.select("vec") if n <= rows else plain.where(part < int((1 << 30) * rows / n)).select("vec")

    tops_wanted = max(1, math.ceil(math.sqrt(num_lists)))
    sample, _ = _points(some(max(1, sample_bytes // (8 * width))).toArrow()["vec"], width, metric)
    tops = _kmeans(sample, tops_wanted, metric, rounds, seed)
    if not len(tops):
        return np.zeros((0, width)), np.zeros(0, np.int64), []
    own = _distances(sample, np.sqrt((sample**2).sum(1)), tops, metric).argmin(1)
    leaves = _shares(np.bincount(own, minlength=len(tops)) + 1e-9, max(num_lists, len(tops)))
    if n * width * 8 <= sample_bytes:  # the sample is the whole table
        found = [_kmeans(sample[own == t], int(k), metric, rounds, seed) for t, k in enumerate(leaves)]
    else:
        def by_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, norms = _points(batch["vec"], width, metric)
                near = _distances(x, norms if metric == "euclidean" else np.ones(len(x)), tops, metric).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch["vec"]], ["top", "vec"])

        def leaf(rows: pa.Table) -> pa.Table:
            t = rows["top"][0].as_py()
            x, _ = _points(rows["vec"], width, metric)
            return pa.table({"top": [t], "leaves": [_kmeans(x, int(leaves[t]), metric, rounds, seed).tolist()]},
                            schema=pa.schema([("top", pa.int32()), ("leaves", pa.list_(pa.list_(pa.float64())))]))

        dealt = some(LEAF_SAMPLE * num_lists).mapInArrow(by_top, "top int, vec array<double>")
        got = {r["top"]: np.array(r["leaves"]) for r in dealt.groupBy("top").applyInArrow(leaf, "top int, leaves array<array<double>>").collect()}
        found = [got.get(t, tops[t : t + 1]) for t in range(len(tops))]
    found = [x if len(x) else tops[t : t + 1] for t, x in enumerate(found)]
    first = np.r_[0, np.cumsum([len(x) for x in found])[:-1]]
    return tops, first, found


def _assign(tops: np.ndarray, first: np.ndarray, leaves: list[np.ndarray], metric: str):
    """The list of each row, and its angle or distance to the list's centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norms = _points(batch["vec"], tops.shape[1], metric)
            top = _distances(x, norms, tops, metric).argmin(1)
            lists, away = np.zeros(len(x), np.int32), np.zeros(len(x))
            for t in np.unique(top):
                rows = np.flatnonzero(top == t)
                d = _distances(x[rows], norms[rows], leaves[t], metric)
                own = d.argmin(1)
                lists[rows], away[rows] = first[t] + own, d[np.arange(len(rows)), own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists), pa.array(away)], [*batch.schema.names, "list_id", "away"])

    return run


# ---------------------------------------------------------------------------
# index
# ---------------------------------------------------------------------------

def _squares() -> F.Column:
    """Sum of squares, with null components as 0; null for a null vector."""
    return F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0)))


def _has_direction(metric: str) -> F.Column:
    found = (F.size("vec") > 0) & (_squares() > 0) if metric == "cosine" else F.size("vec") > 0
    return F.coalesce(found, F.lit(False))


def build_ivf(df: DataFrame, id_col: str = "uri", vec_col: str = "embedding", num_lists: int = 10,
              seed: int = 1, max_iter: int = 20, max_centroid_bytes: int = MAX_CENTROID_BYTES,
              path: str | None = None, metric: str = "cosine", sample_bytes: int = SAMPLE_BYTES,
              null_ids: bool = True) -> IvfIndex:
    """Write the index under ``path`` (by default in the shared folder) and open it."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = df.sparkSession
    rows = collapse_copies(df, id_col, vec_col, null_ids=null_ids)
    path = path or f"{shared_folder(spark)}/ivf-{uuid.uuid4().hex}"
    rows.withColumn("plain", _has_direction(metric)).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("plain", T.BooleanType())])).parquet(f"{path}/rows")
    plain = rows.where("plain").drop("plain")
    size = plain.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("w")).first()
    n, width = size["n"], size["w"] or 0
    if num_lists < 1 or 8 * width * num_lists > max_centroid_bytes:
        raise ValueError(f"{num_lists} lists of {width} components exceed {max_centroid_bytes} bytes")
    schema = T.StructType([*plain.schema.fields, T.StructField("list_id", T.IntegerType()), T.StructField("away", T.DoubleType())])
    dealt = rows.where("not plain").drop("plain").withColumns({"list_id": F.lit(ODD_LIST), "away": F.lit(0.0)})
    centroids = np.zeros((0, width))
    if n:
        tops, first, leaves = _fit(plain, n, width, num_lists, metric, max_iter, seed, sample_bytes)
        centroids = np.concatenate(leaves)
        dealt = plain.mapInArrow(_assign(tops, first, leaves, metric), schema).unionByName(dealt)
    # rows of a list in as many files as it has sub-blocks, so that a long list is not written by one task
    salt = F.pmod(F.xxhash64("id", "vec"), F.lit(max(1, math.ceil(n / max(1, len(centroids)) / block_rows_for(width)))))
    dealt.repartition("list_id", salt).write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
    stored = spark.read.schema(schema).parquet(f"{path}/lists")
    stats = stored.groupBy("list_id").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius"))
    of = {r["list_id"]: r for r in stats.collect()}  # one row a list
    ids = range(-1, len(centroids))
    meta = pa.table({
        "list_id": pa.array(ids, pa.int32()), "centroid": pa.array([centroids[i].tolist() if i >= 0 else None for i in ids], pa.list_(pa.float64())),
        "rows": pa.array([of[i]["rows"] if i in of else 0 for i in ids], pa.int64()),
        "radius": pa.array([of[i]["radius"] if i in of else 0.0 for i in ids], pa.float64()), "metric": pa.array([metric] * len(ids)),
        "schema": pa.array([schema.json()] * len(ids))})
    spark.createDataFrame(meta).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return load_ivf(spark, path)


_META = "list_id int, centroid array<double>, rows long, radius double, metric string, schema string"


def save_ivf(index: IvfIndex, path: str) -> None:
    """Copy the index: vectors partitioned by list, and the centroids."""
    spark = index.assignments.sparkSession
    index.assignments.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
    spark.read.schema(_META).parquet(f"{index.path}/centroids").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load_ivf(spark: SparkSession, path: str) -> IvfIndex:
    """Open a written index; a search reads the folders of the lists it needs."""
    meta = spark.read.schema(_META).parquet(f"{path}/centroids").orderBy("list_id").collect()  # bounded when built
    odd, own = meta[0], meta[1:]
    lists = spark.read.schema(T.StructType.fromJson(json.loads(odd["schema"]))).parquet(f"{path}/lists")
    width = len(own[0]["centroid"]) if own else 0
    centroids = np.array([r["centroid"] for r in own], dtype=np.float64).reshape(len(own), width)
    columns = ["id", "vec", "rowkey", "copies", F.col("list_id").cast("int").alias("list_id")]
    return IvfIndex(lists.select(*columns), centroids, lists.schema["id"].dataType, np.array([r["radius"] for r in own]),
                    np.array([r["rows"] for r in own], dtype=np.int64), odd["metric"], odd["rows"], path)


# ---------------------------------------------------------------------------
# search
# ---------------------------------------------------------------------------

def _probes(index: IvfIndex, k: int, nprobe: int | None, stop: float):
    """lists(vectors, limit): for each query row the lists of a round.

    Without ``limit`` the first round: the ``nprobe`` nearest lists, or as many as hold 2 k rows.
    With the angle (or distance) of the k-th best so far, those of the second round.
    """
    centroids, radius, rows, metric = index.centroids, index.radius, index.rows, index.metric

    def lists(vectors: pa.Array, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        x, norms = _points(vectors, centroids.shape[1], metric)
        away = _distances(x, norms, centroids, metric)
        order = np.argsort(away, axis=1, kind="stable")
        if nprobe is not None:
            count = np.full(len(x), min(nprobe, len(centroids)))
        else:
            held = np.cumsum(rows[order], axis=1)
            count = np.minimum((held < 2 * k).sum(1) + 1, len(centroids))
        place = np.arange(len(centroids))[None] < count[:, None]
        if limit is not None:
            near = np.take_along_axis(away - stop * (radius + MARGIN)[None], order, 1)
            place = ~place & (near <= limit[:, None] + MARGIN)
        place &= rows[order] > 0
        row, at = np.nonzero(place)
        return row, order[row, at]

    return lists


def _routed(n_lists: int, batches: Iterator[pa.RecordBatch], lists) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Query rows with their (row, list) pairs, so many at once that a matrix of rows and lists stays small."""
    rows = max(1, PAIRS // max(1, n_lists))
    for whole in batches:
        for a in range(0, len(whole), rows):
            batch = whole.slice(a, rows)
            yield batch, *lists(batch["vec"], batch["limit"].to_numpy(zero_copy_only=False) if "limit" in batch.schema.names else None)


def _counted(n_lists: int, queries: DataFrame, lists) -> tuple[dict[int, int], int]:
    """Queries of each list, one row a list and task; and how many queries have a list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_lists + 1, np.int64)
        for _, row, found in _routed(n_lists, batches, lists):
            total[:-1] += np.bincount(found, minlength=len(total) - 1)
            total[-1] += len(np.unique(row))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"list_id": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    columns = ["vec", *(c for c in ("limit",) if c in queries.columns)]
    found = queries.select(*columns).mapInArrow(run, "list_id int, n long").groupBy("list_id").agg(F.sum("n").alias("n"))
    counts = {r["list_id"]: r["n"] for r in found.collect()}
    return counts, counts.pop(n_lists, 0)


def _shelves(rows: dict[int, int], most: int) -> dict[int, int]:
    """The shelf of each list: neighbours by number, of ``most`` rows in all; a longer list has its own."""
    out, shelf, held = {}, -1, most
    for i in sorted(rows):
        if held + rows[i] > most:
            shelf, held = shelf + 1, 0
        out[i], held = shelf, held + rows[i]
    return out


def probed_rows(index: IvfIndex, probed: list[tuple[int, ...]]) -> DataFrame:
    """The base rows of the probed (list_id, sub-blocks, query blocks, shelf); other lists' folders are not read.

    The table of lists is bounded with the centroids, hence the broadcast; its filter lets Spark prune by it.
    """
    spark = index.assignments.sparkSession
    path = f"{shared_folder(spark)}/probed-{uuid.uuid4().hex}"
    names = ["of", "subs", "blocks", "shelf"][: len(probed[0]) if probed else 4]
    columns = [pa.array(x, pa.int32()) for x in zip(*probed)] if probed else [pa.array([], pa.int32())] * len(names)
    spark.createDataFrame(pa.table(columns, names=names)).coalesce(1).write.parquet(path)
    lists = spark.read.schema(", ".join(f"{c} int" for c in names)).parquet(path).where("blocks > 0")
    return index.assignments.join(F.broadcast(lists), F.col("list_id") == F.col("of")).drop("of")


def _cells(index: IvfIndex, queries: DataFrame, lists, k: int, exclude_self: bool, block_rows: int) -> DataFrame | None:
    """Candidates of one round; None if no list is needed."""
    n_lists = len(index.rows)
    counts, wanted = _counted(n_lists, queries, lists)
    index.read["pairs"] = index.read.get("pairs", 0) + sum(counts.values())
    index.read["lists"] = index.read.get("lists", set()) | set(counts)
    if not counts:
        return None
    tasks = 2 * _parallelism(queries)
    held = {i: int(index.rows[i]) for i in counts}
    shelf_of = _shelves(held, min(block_rows, max(256, math.ceil(sum(held.values()) / tasks))))
    n_shelves = max(shelf_of.values()) + 1
    base_rows, query_rows = np.zeros(n_shelves, np.int64), np.zeros(n_shelves, np.int64)
    for i, c in counts.items():
        base_rows[shelf_of[i]] += held[i]
        query_rows[shelf_of[i]] += c
    least = math.ceil(tasks / n_shelves)
    subs = np.maximum(-(-base_rows // block_rows), np.minimum(least, -(-base_rows // 256)))
    blocks = -(-np.minimum(query_rows, wanted) // block_rows)
    probed = [(i, int(subs[s]), int(blocks[s]), s) for i, s in shelf_of.items()]
    shelf = np.full(n_lists, -1)
    shelf[list(shelf_of)] = list(shelf_of.values())
    own = ["id", "vec", "rowkey", "copies", *(c for c in ("limit",) if c in queries.columns)]
    keys = ["shelf", "sub", "qb"]
    schema = T.StructType([*(queries.schema[c] for c in own), T.StructField("open", T.ArrayType(T.IntegerType())),
                           *(T.StructField(c, T.IntegerType()) for c in keys)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, found in _routed(n_lists, batches, lists):
            if not len(row):
                continue
            by = np.lexsort((found, row))  # lists are numbered along the shelves
            row, found = row[by], found[by]
            at = shelf[found]
            begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
            opened = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(row)].astype(np.int32)), pa.array(found.astype(np.int32)))
            row, at = row[begin], at[begin]
            block = batch["h"].to_numpy()[row] % blocks[at]
            again = np.repeat(np.arange(len(row)), subs[at])
            sub = np.arange(len(again)) - np.searchsorted(again, again)
            for a in range(0, len(again), 4096):  # one row repeated often must not fill a batch
                some = again[a : a + 4096]
                taken = batch.select(own).take(pa.array(row[some]))
                numbers = [pa.array(x.astype(np.int32)) for x in (at[some], sub[a : a + 4096], block[some])]
                yield pa.RecordBatch.from_arrays([*taken.columns, opened.take(pa.array(some)), *numbers], [*taken.schema.names, "open", *keys])

    h = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 40))
    base = probed_rows(index, probed)
    if exclude_self:
        base = base.where(F.col("id").isNotNull())
    bx = (base.withColumn("sub", F.pmod(F.xxhash64("id", "vec"), F.col("subs")).cast("int"))
              .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return cogroup_topk(queries.withColumn("h", h).mapInArrow(route, schema), bx, keys, k, exclude_self, index.id_type,
                        index.metric, int((subs * blocks).sum()), [*own[4:], "open"], ["list_id"])


def _smallest(rows: DataFrame, k: int, exclude_self: bool) -> list:
    """The rows that any query may need among its k smallest ids: 2 k, and k more where one id has them all."""
    if exclude_self:
        rows = rows.where(F.col("id").isNotNull())
    first = lambda df, n: df.orderBy(F.col("id").asc(), "rowkey").limit(n).collect()
    columns = rows.select("id", "rowkey", "copies")
    found = first(columns, 2 * k)
    ids = [r["id"] for r in found]
    often = next((i for i in ids if ids.count(i) > k), None) if exclude_self else None
    return found + [r for r in first(columns.where(F.col("id") != F.lit(often)), k) if r not in found] if often is not None else found


def _fillers(queries: DataFrame, rows: list, k: int, exclude_self: bool, id_type: T.DataType) -> DataFrame:
    """Candidates without a similarity: for each query row the first k of ``rows`` (a few, in the order of their ids)."""
    stand = queries.sparkSession.createDataFrame([tuple(r) for r in rows], T.StructType([
        T.StructField("compared_uri", id_type), T.StructField("base_key", T.LongType()), T.StructField("base_copies", T.LongType())]))
    packed = stand.agg(F.array_sort(F.collect_list(F.struct("compared_uri", "base_key", "base_copies"))).alias("all"))
    own = F.expr("filter(all, x -> x.compared_uri <> id)") if exclude_self else F.col("all")
    # the one row of 3 k entries at most stands in for a literal
    each = queries.select("id", "rowkey", "copies").join(F.broadcast(packed), F.lit(True)).withColumn("s", F.explode(F.slice(own, 1, k)))
    return each.select(F.col("id").alias("query_uri"), "s.compared_uri", F.col("rowkey").alias("query_key"), F.col("copies").alias("query_copies"),
                       F.col("s.base_key").alias("rowkey"), F.lit(None).cast("double").alias("similarity_percentage"), F.col("s.base_copies").alias("copies"))


def _limits(cands: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_uri, query_key, limit): the angle or distance of each query row's k-th best."""
    by = Window.partitionBy("query_uri", "query_key").orderBy(F.col("similarity_percentage").desc())
    held = F.sum("copies").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kth = F.max(F.when(F.col("held") >= k, F.col("similarity_percentage"))) / 100
    limit = F.acos(F.greatest(F.least(kth, F.lit(1.0)), F.lit(-1.0))) if metric == "cosine" else 1 - kth
    ranked = cands.where("similarity_percentage is not null").withColumn("held", held)
    return ranked.groupBy("query_uri", "query_key").agg(limit.alias("limit"))


def search_rows(index: IvfIndex, queries: DataFrame, k: int = 10, nprobe: int | None = None, stop: float = 1.0,
                exclude_self: bool = False, block_rows: int | None = None) -> DataFrame:
    """Candidates of the query rows ``id, vec, rowkey, copies``, which hold each row's k best.

    With ``nprobe`` that many lists a query; else those that ``stop`` leaves open, all that matter for 1.
    """
    index.read.clear()
    index.read.update(all_lists=int((index.rows > 0).sum()), pairs=0, lists=set())
    block_rows = block_rows or block_rows_for(index.centroids.shape[1])
    directed = queries.where(_has_direction(index.metric))
    lists = _probes(index, k, nprobe, stop)
    parts: list[DataFrame] = []
    if len(index.rows):
        first = _cells(index, directed, lists, k, exclude_self, block_rows)
        if first is not None and nprobe is not None:
            parts.append(first)
        elif first is not None:
            first = settled(first, "first-round")
            limits = _limits(first, k, index.metric)
            same = F.col("id").eqNullSafe(F.col("query_uri")) & (F.col("rowkey") == F.col("query_key"))
            far = math.pi if index.metric == "cosine" else math.inf
            limited = directed.join(limits, same, "left").select("id", "vec", "rowkey", "copies", F.coalesce("limit", F.lit(far)).alias("limit"))
            second = _cells(index, settled(limited, "limits"), lists, k, exclude_self, block_rows)
            parts += [first] if second is None else [first, second]
    odd = index.assignments.where(F.col("list_id") == ODD_LIST)
    if index.odd_rows:
        parts.append(_fillers(directed, _smallest(odd, k, exclude_self), k, exclude_self, index.id_type))
    others = queries.where(~_has_direction(index.metric))
    if others.take(1):
        parts.append(_fillers(others, _smallest(index.assignments, k, exclude_self), k, exclude_self, index.id_type))
    out = parts[0] if parts else queries.sparkSession.createDataFrame([], _result_schema(index.id_type))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ivf_search(index: IvfIndex, queries: DataFrame, k: int = 10, nprobe: int | None = 1,
               id_col: str = "uri", vec_col: str = "embedding", exclude_self: bool = False,
               block_rows: int | None = None, stop: float = 1.0) -> DataFrame:
    """V5: ``query_uri, rank, compared_uri, similarity_percentage`` from the probed lists.

    ``nprobe=None`` reads the lists that the k-th best and ``stop`` leave open (exact for 1).
    """
    rows = settled(collapse_copies(queries, id_col, vec_col, null_ids=not exclude_self), "queries")
    return shown(ranked_topk(search_rows(index, rows, k, nprobe, stop, exclude_self, block_rows), k))


def clustered_self_join(df: DataFrame, id_col: str = "uri", vec_col: str = "embedding", k: int = 10,
                        exclude_self: bool = True, num_lists: int | None = None, metric: str = "cosine",
                        seed: int = 1, block_rows: int | None = None) -> tuple[DataFrame, IvfIndex]:
    """V9 + J1 + V10 where vectors have clusters: as ``vector_search.knn_self_join``, and the index with what was read.

    Exact; rows are shipped only to lists whose bound reaches their k-th best, by default
    as many lists as the square root of the rows.
    """
    num_lists = num_lists or max(1, math.isqrt(df.count()))
    index = build_ivf(df, id_col, vec_col, num_lists, seed=seed, metric=metric, null_ids=not exclude_self)
    rows = index.assignments.drop("list_id")
    return shown(ranked_topk(search_rows(index, rows, k, None, 1.0, exclude_self, block_rows), k, per_row=False)), index


# ---------------------------------------------------------------------------
# recall
# ---------------------------------------------------------------------------

def _sampled(queries: DataFrame, sample: int, id_col: str) -> DataFrame:
    return queries.orderBy(F.xxhash64(id_col)).limit(sample)


def stop_for(index: IvfIndex, queries: DataFrame, recall: float = 0.9, k: int = 10, sample: int = RECALL_SAMPLE,
             id_col: str = "uri", vec_col: str = "embedding", exclude_self: bool = False) -> float:
    """The least ``stop`` with which a search's recall@k is ``recall`` or more by two standard errors.

    One exact search of a sample of the queries shows how far the radius of each neighbour's list
    must count for the list to stay open: (angle to the centroid - angle of the k-th best) / radius.
    """
    if not len(index.rows):
        return 1.0
    rows = settled(collapse_copies(_sampled(queries, sample, id_col), id_col, vec_col, null_ids=not exclude_self), "sample")
    cands = search_rows(index, rows, k, None, 1.0, exclude_self)
    hits = ranked_topk(cands, k).where("similarity_percentage is not null")
    where = index.assignments.select(F.col("id").alias("_id"), F.col("rowkey").alias("_key"), "list_id")
    same = F.col("compared_uri").eqNullSafe(F.col("_id")) & (F.col("rowkey") == F.col("_key"))
    own = rows.select(F.col("id").alias("_q"), "vec").dropDuplicates(["_q"])
    found = hits.join(where, same).join(own, F.col("query_uri").eqNullSafe(F.col("_q"))).select("_q", "vec", "similarity_percentage", "list_id").toArrow()
    if not len(found):
        return 1.0
    x, norms = _points(found["vec"], index.centroids.shape[1], index.metric)
    lists = found["list_id"].to_numpy()
    away = _distances(x, norms, index.centroids, index.metric)[np.arange(len(x)), lists]
    share = found["similarity_percentage"].to_numpy() / 100
    angle = np.arccos(np.clip(share, -1, 1)) if index.metric == "cosine" else 1 - share
    query = found["_q"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    kth = np.zeros(query.max() + 1)
    np.maximum.at(kth, query, angle)
    need = (away - kth[query]) / np.maximum(index.radius[lists], MARGIN)
    for stop in np.arange(0.0, 1.0, 0.02):
        shares = np.bincount(query, need <= stop) / np.bincount(query)
        if shares.mean() - 2 * shares.std() / math.sqrt(len(shares)) >= recall:
            return float(stop)
    return 1.0


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours found by the approximate search, over all queries."""
    found = approx.select("query_uri", "compared_uri", F.lit(1).alias("_hit")).dropDuplicates(
        ["query_uri", "compared_uri"])
    j = exact.select("query_uri", "compared_uri").join(found, ["query_uri", "compared_uri"], "left")
    return j.agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
