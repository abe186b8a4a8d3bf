"""Vector search, all pairs, IVF and embeddings."""

import numpy as np
import pytest

from simforge.functions.embed import char_count_model, embed
from simforge.operators import ivf, vector_search as vs
from simforge.sources.tables import embeddings, odd_embeddings

from .conftest import SF

SCHEMA = "uri string, embedding array<double>, label int"


def brute(rows, k, exclude_self=True):
    """(query, rank, other, similarity) by the definition, unrounded ranking."""
    out = []
    for q, v, _ in rows:
        scored = []
        for b, w, _ in rows:
            if exclude_self and q == b:
                continue
            sim = None
            if v and w:
                n = min(len(v), len(w))
                norms = np.linalg.norm(v) * np.linalg.norm(w)
                if norms:
                    sim = float(np.dot(v[:n], w[:n]) / norms * 100)
            scored.append((sim is None, -(sim or 0), b, sim))
        scored.sort(key=lambda s: s[:3])
        out += [(q, i + 1, s[2], None if s[3] is None else round(s[3], 4)) for i, s in enumerate(scored[:k])]
    return sorted(out, key=str)


def flat(df):
    return sorted(((r.query_uri, r["rank"], r.compared_uri, r.similarity_percentage) for r in df.collect()), key=str)


def rows_of(n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"id{i:03}", rng.normal(size=8).tolist(), i % 3) for i in range(n)]
    return [*rows, ("zero", [0.0] * 8, 0), ("empty", [], 1), ("null", None, 2), ("short", [1.0, 2.0], 3), ("twin", rows[0][1], 4)]


def test_all_pairs_match_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    assert flat(vs.knn_self_join(df, k=7, num_blocks=3)) == brute(rows, 7)


def test_ranking_is_not_on_rounded_values(spark):
    rows = [(f"{i:02}", [float(np.cos(i * 1e-5)), float(np.sin(i * 1e-5))], 0) for i in range(20)]
    df = spark.createDataFrame(rows[::-1], SCHEMA)
    got = {(r.query_uri, r["rank"]): r.compared_uri for r in vs.knn_self_join(df, k=3).collect()}
    assert [got["00", i] for i in (1, 2, 3)] == ["01", "02", "03"]
    spun = spark.createDataFrame([(f"{i:02}", [float(np.cos((20 - i) * 1e-5)), float(np.sin((20 - i) * 1e-5))], 0) for i in range(1, 20)] + [("00", [1.0, 0.0], 0)], SCHEMA)
    assert [r.uri for r in vs.search_by_id(spun, "00", k=4).orderBy("rank").collect()] == ["00", "19", "18", "17"]
    assert [r.uri for r in vs.search_single_native(spun, [1.0, 0.0], k=4).collect()] == ["00", "19", "18", "17"]


def test_rows_that_share_an_id_keep_their_columns(spark):
    rows = [("1", [1.0, 0.0], 7), ("1", [1.0, 0.0], 8), ("2", [0.0, 1.0], 9), ("2", [0.0, 1.0], 9)]
    got = vs.search_by_id(spark.createDataFrame(rows, SCHEMA), "2", k=10)
    assert sorted(r.label for r in got.where("query_uri = '2' and uri = '1'").distinct().collect()) == [7, 8]


def test_unknown_id_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), ("a", [1.0, 0.1], 2)], SCHEMA)
    assert vs.search_by_id(df, "nobody").count() == 0
    assert [r.uri for r in vs.search_by_id(df, "a", k=5).orderBy("rank").collect()] == ["a", None]
    assert vs.search_by_id(df, "a", k=5, exclude_self=True).count() == 0


def test_metric(spark):
    rows = [("a", [0.0, 0.0], 0), ("b", [3.0, 4.0], 0), ("c", [0.6, 0.8], 0)]
    got = vs.search_by_id(spark.createDataFrame(rows, SCHEMA), "a", metric="euclidean").orderBy("rank").collect()
    assert [(r.uri, r.distance) for r in got] == [("a", 0.0), ("c", 1.0), ("b", 5.0)]
    with pytest.raises(Exception, match="metric"):
        vs.search_by_id(spark.createDataFrame(rows, SCHEMA), "a", metric="other").collect()


def test_full_probe_equals_exact(spark):
    odd = odd_embeddings(spark, SF)
    index = ivf.build_ivf(odd, num_lists=5, seed=3)
    assert index.assignments.count() == odd.count()
    exact = flat(vs.shown(vs.knn_join(odd, odd, k=6)))
    assert flat(ivf.ivf_search(index, odd, k=6, nprobe=5, block_rows=64)) == exact


def test_written_index_gives_the_same(spark, tmp_path):
    e = embeddings(spark, SF)
    index = ivf.build_ivf(e, num_lists=4, seed=3)
    ivf.save_ivf(index, str(tmp_path / "ivf"))
    again = ivf.load_ivf(spark, str(tmp_path / "ivf"))
    assert flat(ivf.ivf_search(again, e, k=3, nprobe=2)) == flat(ivf.ivf_search(index, e, k=3, nprobe=2))


def test_ivf_bounds(spark):
    with pytest.raises(ValueError, match="bytes"):
        ivf.build_ivf(embeddings(spark, SF), num_lists=10, max_centroid_bytes=100)
    empty = embeddings(spark, SF).limit(0)
    index = ivf.build_ivf(empty, num_lists=3)
    assert ivf.ivf_search(index, empty, k=3).count() == 0


def test_cells_stay_bounded_on_a_skewed_list(spark, monkeypatch):
    """One list with nearly all rows is split by its own size."""
    rng = np.random.default_rng(1)
    rows = [(f"{i}", (np.array([1.0, 0, 0, 0]) + rng.normal(size=4) * 1e-3).tolist(), 0) for i in range(900)]
    rows += [(f"x{i}", rng.normal(size=4).tolist(), 0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = {}

    def spy(qx, bx, keys, *args):
        seen["q"] = qx.groupBy(*keys).count().agg({"count": "max"}).first()[0]
        seen["b"] = bx.groupBy(*keys).count().agg({"count": "max"}).first()[0]
        return vs.cogroup_topk(qx, bx, keys, *args)

    monkeypatch.setattr(ivf, "cogroup_topk", spy)
    ivf.ivf_search(ivf.build_ivf(df, num_lists=2), df, k=3, nprobe=2, block_rows=100).count()
    assert max(seen.values()) <= 200


def test_embed_checks_the_dimension(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "text string")
    got = embed(df, "text", char_count_model(4), 4).collect()
    assert [r.ml_generate_embedding_result for r in got] == [[0.0, 1.0, 1.0, 0.0], [0.0] * 4, [0.0] * 4]
    with pytest.raises(Exception, match="shape"):
        embed(df, "text", char_count_model(4), 5).collect()
