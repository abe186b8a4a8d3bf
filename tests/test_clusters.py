"""The cell kernel, clustered all pairs, and searches of a written index."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from simforge.functions import vectors as V
from simforge.operators import ivf, vector_search as vs
from simforge.plans import vector_queries as vq

from .conftest import SF
from .test_vectors import SCHEMA, brute, flat, rows_of

TYPES = {"id": pa.string(), "vec": pa.list_(pa.float64()), "rowkey": pa.int64(), "copies": pa.int64()}


def side(rows):
    return V.Side(pa.table({c: pa.chunked_array([pa.array([r[i] for r in rows], t)]) for i, (c, t) in enumerate(TYPES.items())}))


def plain_topk(left, right, k, exclude_self, metric):
    out = []
    for query, qv, key, _ in left:
        scored = []
        for base, bv, _, copies in right:
            if exclude_self and (query is None or base is None or base == query):
                continue
            similarity = None
            if qv and bv:
                n, ln, rn = min(len(qv), len(bv)), math.sqrt(sum(x * x for x in qv)), math.sqrt(sum(x * x for x in bv))
                dot = sum(x * y for x, y in zip(qv[:n], bv))
                if metric == "euclidean":
                    similarity = (1 - math.sqrt(max(ln * ln + rn * rn - 2 * dot, 0))) * 100
                elif ln * rn:
                    similarity = dot / (ln * rn) * 100
            scored += [(similarity is None, -round(similarity or 0.0, 5))] * copies
        out += [(key, None if none else -s + 0.0) for none, s in sorted(scored)[:k]]
    return Counter(out)


@pytest.mark.parametrize("seed", range(120))
def test_kernel_matches_the_definition(seed):
    """Ties, equal vectors, null ids and vectors, vectors of unequal length, copies, both metrics."""
    rng = random.Random(seed)
    size, values = rng.choice([1, 2, 3]), rng.choice([[0, 1], [-1, 0, 1, 2], [0.5, -2, 3, 1, 7, 9]])
    ids = [None, *(f"u{i:02}" for i in range(rng.choice([3, 10, 60])))]

    def vector():
        x = rng.random()
        return None if x < 0.05 else [float(rng.choice(values)) for _ in range(0 if x < 0.1 else rng.randint(1, size) if x < 0.2 else size)]

    left, right = ([(rng.choice(ids), vector(), i, rng.choice([1, 1, 1, 3])) for i in range(rng.randint(1, 40))] for _ in range(2))
    k, exclude_self, metric = rng.choice([1, 2, 5]), rng.random() < 0.5, rng.choice(V.METRICS)
    got = defaultdict(list)
    table = V.topk_rows(side(left), side(right), k, exclude_self, metric)
    for key, s, copies in zip(*(table[c].to_pylist() for c in ("query_key", "similarity_percentage", "copies"))):
        got[key] += [(key, None if s is None else round(s, 5) + 0.0)] * copies
    assert Counter(x for v in got.values() for x in v[:k]) == plain_topk(left, right, k, exclude_self, metric)


def test_kernel_on_one_common_vector_and_on_crowds_of_ties():
    rng = np.random.default_rng(0)
    common = [(f"{i:05}", [1.0, 2.0], i, 1) for i in range(3000)] + [(f"x{i:04}", rng.normal(size=2).tolist(), 3000 + i, 1) for i in range(500)]
    table = V.topk_rows(side(common[-3:]), side(common), 4, True)
    assert len(table) == 12
    crowd = [(f"{i:05}", [float(j == i % 8) for j in range(8)], i, 1) for i in range(4000)]
    table = V.topk_rows(side(crowd[:9]), side(crowd), 3, True).to_pylist()
    assert [r["compared_uri"] for r in table if r["query_uri"] == "00000"] == ["00008", "00016", "00024"]


def clustered(n_clusters=14, size=30, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, 12))
    return [(f"id{c:02}-{i:02}", (centres[c] + 0.03 * rng.normal(size=12)).tolist(), c) for c in range(n_clusters) for i in range(size)]


def test_clustered_all_pairs_skip_cells(spark):
    rows = clustered()
    got, index = ivf.clustered_self_join(spark.createDataFrame(rows, SCHEMA), k=5, num_lists=14)
    assert flat(got) == brute(rows, 5)
    # pairs of a row and a list: nearly all are skipped
    assert index.read["pairs"] <= 2 * len(rows) and index.read["all_lists"] * len(rows) > 4000


@pytest.mark.parametrize("exclude_self", [True, False])
def test_clustered_all_pairs_of_odd_rows(spark, exclude_self):
    rows = clustered(4, 12) + rows_of(20)[-5:] + [("id00-00", None, 3), ("id00-00", [], 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, _ = ivf.clustered_self_join(df, k=60, num_lists=5, exclude_self=exclude_self)
    assert flat(got) == flat(vs.knn_self_join(df, k=60, exclude_self=exclude_self))


def test_euclidean_index(spark):
    df = spark.createDataFrame([(u, [x * (1 + i % 5) for x in v], n) for i, (u, v, n) in enumerate(clustered(6, 15))] + [("none", None, 1)], SCHEMA)
    got, index = ivf.clustered_self_join(df, k=4, num_lists=9, metric="euclidean")
    assert flat(got) == flat(vs.knn_self_join(df, k=4, metric="euclidean"))
    assert index.metric == "euclidean"


def test_tables_without_a_direction(spark):
    odd = spark.createDataFrame([("a", None, 1), ("b", [], 1), ("c", [0.0], 1)], SCHEMA)
    assert flat(ivf.clustered_self_join(odd, k=2)[0]) == flat(vs.knn_self_join(odd, k=2))
    assert ivf.clustered_self_join(odd.limit(0), k=2)[0].count() == 0


def test_leaves_fitted_on_samples(spark):
    """As on a table larger than the sample: tops on the driver, leaves in tasks."""
    rows = clustered()
    df = spark.createDataFrame(rows, SCHEMA)
    index = ivf.build_ivf(df, num_lists=20, sample_bytes=8 * 12 * 100)
    assert index.rows.sum() == len(rows) and 8 < len(index.rows) <= 20
    exact = flat(vs.shown(vs.knn_join(df, df, k=3)))
    assert flat(ivf.ivf_search(index, df, k=3, nprobe=None)) == exact


def test_recall_by_stop(spark):
    e = vq.embeddings(spark, SF)
    index = ivf.build_ivf(e, num_lists=12, seed=2)
    stop = ivf.stop_for(index, e, recall=0.9, k=10)
    found = ivf.ivf_search(index, e, k=10, nprobe=None, stop=stop)
    pairs = index.read["pairs"]
    recall = ivf.recall_at_k(found, vs.shown(vs.knn_join(e, e, k=10))).first()[0]
    assert 0.9 <= recall <= 1.0 and stop < 1.0 and pairs < e.count() * 12


def test_stored_index_reads_only_the_probed_lists(spark, tmp_path):
    rows = clustered()
    df = spark.createDataFrame(rows, SCHEMA)
    ivf.build_ivf(df, num_lists=14, path=str(tmp_path / "ivf"))
    index = ivf.load_ivf(spark, str(tmp_path / "ivf"))
    queries = df.where("uri like 'id03-0%'")
    got = ivf.ivf_search(index, queries, k=5, nprobe=None)
    assert flat(got) == [r for r in flat(vs.shown(vs.knn_join(queries, df, k=5)))]
    assert len(index.read["lists"]) <= 3
    probed = ivf.probed_rows(index, [(2, 1, 1)])
    plan = probed._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    probed.collect()
    scan = probed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan
    assert {r.list_id for r in probed.select("list_id").distinct().collect()} == {2}


def test_search_by_uri_strings_with_repeated_rows(spark):
    rows = rows_of(30)
    df = spark.createDataFrame(rows, SCHEMA)
    twice = df.where("uri in ('id003', 'id007')")
    hits = vs.search(df, twice.unionAll(twice), k=3)
    want = [r for r in brute(rows, 3, exclude_self=False) if r[0] in ("id003", "id007")]
    assert sorted(((r.query_uri, r["rank"], r.uri, r.similarity_percentage) for r in hits.collect()), key=str) == sorted(want * 2, key=str)
    assert vs.knn_self_join(df.limit(3), k=2).count() >= 2


def test_kernel_finishes_rows_in_steps():
    """Beside the vectors a cell holds little, also where every vector has many copies."""
    vectors = np.repeat(np.random.default_rng(4).normal(size=(300, 8)), 20, axis=0).tolist()
    rows = side([(f"{i:05}", v, i, 1) for i, v in enumerate(vectors)])
    tracemalloc.start()
    try:
        table = V.topk_rows(rows, rows, 10, True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(table) == 60000 and peak < 40 << 20


def test_kernel_passes_over_the_rows_of_one_id():
    """More than 2 k rows of the query's own id, with others' behind them, share one vector."""
    rows = [("a", [1.0, 2.0], i, 1) for i in range(3)] + [("b", [1.0, 2.0], 3 + i, 1) for i in range(30)] + [("c", [1.0, 2.0], 40, 1)]
    table = V.topk_rows(side([("b", [1.0, 2.0], 3, 1)]), side(rows), 4, True)
    assert table["compared_uri"].to_pylist() == ["a", "a", "a", "c"]


def test_rows_without_a_direction_are_not_scored(monkeypatch):
    """They get the first ids; before, each was scored with every row and all the ties were sorted."""
    scored = []
    plain = V.pair_similarity
    monkeypatch.setattr(V, "pair_similarity", lambda dot, *args: (scored.append(len(dot)), plain(dot, *args))[1])
    rng = np.random.default_rng(5)
    rows = [(f"{i:03}", (None, [], [0.0, -0.0, 0.0, 0.0])[i % 3] if i % 2 else rng.normal(size=4).tolist(), i, 1) for i in range(900)]
    got = V.topk_rows(side(rows), side(rows), 3, True).to_pylist()
    blank = {q: [r["compared_uri"] for r in got if r["query_uri"] == q] for q in ("001", "003", "899")}
    assert blank == {"001": ["000", "002", "003"], "003": ["000", "001", "002"], "899": ["000", "001", "002"]}
    assert all((r["similarity_percentage"] is None) == (int(r["query_uri"]) % 2 == 1) for r in got)
    assert len(got) == 2700 and sum(scored) < 40 * 900


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("exclude_self", [True, False])
def test_running_best_of_pieces(metric, exclude_self):
    """Ties, copies, null ids and odd vectors that come in pieces, as all at once."""
    rng = random.Random(8)
    vector = lambda: rng.choice([None, [], [0.0, 0.0], [rng.choice([-1.0, 1.0])], *([[float(rng.choice([-1, 0, 1, 2])), 1.0]] * 6)])
    rows = [(rng.choice([None, *(f"u{i:02}" for i in range(50))]), vector(), i, rng.choice([1, 1, 2])) for i in range(300)]
    best = V.Running(side(rows[:90]), 4, exclude_self, metric)
    for a in range(0, 300, 40):
        best.meet(side(rows[a : a + 40]))
    got = defaultdict(list)
    for r in best.table().to_pylist():
        s = r["similarity_percentage"]
        got[r["query_key"]] += [(r["query_key"], None if s is None else round(s, 5) + 0.0)] * r["copies"]
    assert Counter(x for v in got.values() for x in v[:4]) == plain_topk(rows[:90], rows, 4, exclude_self, metric)


def test_all_pairs_pass_in_blocks(spark, monkeypatch):
    """Queries of several parts against bands of several blocks."""
    monkeypatch.setattr(vs, "BAND_BLOCKS", 2)
    rows = rows_of(150, 2) + [("id003", [0.5] * 8, 9), ("id004", None, 9), ("twin", None, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert flat(vs.knn_self_join(df, k=200, block_rows=20)) == flat(vs.shown(vs.ranked_topk(whole(df, 200), 200, per_row=False)))
    alone = rows_of(150, 2)
    assert flat(vs.knn_self_join(spark.createDataFrame(alone, SCHEMA), k=6, block_rows=20)) == brute(alone, 6)
    assert vs.knn_self_join(df.limit(0), k=3).count() == 0


def whole(df, k):
    """The candidates of all pairs by one call of the kernel."""
    table = vs.collapse_copies(df, "uri", "embedding").toArrow()
    found = V.topk_rows(V.Side(table), V.Side(table), k, True)
    return df.sparkSession.createDataFrame(found)


def test_rows_go_to_shelves_of_lists(spark, monkeypatch):
    """Where bounds leave nearly all lists open, rows are not repeated by lists."""
    shipped = []
    plain = ivf.cogroup_topk
    monkeypatch.setattr(ivf, "cogroup_topk", lambda qx, *args: (shipped.append(qx.count()), plain(qx, *args))[1])
    rng = np.random.default_rng(6)
    rows = [(f"id{i:04}", rng.normal(size=16).tolist(), i) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, index = ivf.clustered_self_join(df, k=3, num_lists=60)
    assert index.read["pairs"] > 30 * len(rows) and sum(shipped) < index.read["pairs"] / 3
    assert flat(got) == flat(vs.knn_self_join(df, k=3))
