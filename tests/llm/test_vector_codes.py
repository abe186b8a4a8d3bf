"""op11 against full searches, a plain training loop and its SQL."""

import duckdb
import numpy as np
import pytest

from simforge.llm import vector_codes as V

from .conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int, error long"


@pytest.mark.parametrize("spread", [0, 40, 400])
@pytest.mark.parametrize("scale", [1, 100, 1 << 19])
def test_nearest_is_the_full_search(spread, scale):
    rng = np.random.default_rng(spread + scale)
    x = np.floor(scale * (rng.normal(size=(1500, 8)) + spread / 10 * rng.normal(size=(1500, 1))))
    book = np.r_[x[:90], x[:5], np.round(x[100:120] / scale) * scale]  # repeated entries and ties
    entry, distance = V.nearest(x, book)
    full = ((x[:, None].astype(np.int64) - book[None].astype(np.int64)) ** 2).sum(2)
    assert (entry == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_search_ends_early_where_sums_differ():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(2000, 16)) * 10 + 100 * rng.normal(size=(2000, 1)))
    met: list[int] = []
    V.nearest(x, x[:256], met)
    assert sum(met) < 0.35 * 2000 * 256


def test_too_large_components_raise():
    with pytest.raises(OverflowError):
        V.nearest(np.full((1, 4), 1e12), np.zeros((1, 4)))


def plain(rows, parts=4, entries=256, rounds=4):
    """The definition, row by row."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(v)))) for v in e]) for i, e, *_ in rows
            if e is not None and all(v is not None and np.isfinite(v) for v in e)]
    width = -(-max((len(e) for _, e in kept), default=0) // parts) * parts
    kept = sorted(((i, e + [0] * (width - len(e))) for i, e in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // parts
    cut = lambda e: [tuple(e[p * w : p * w + w]) for p in range(parts)]
    books = [[cut(e)[p] for _, e in kept[:entries]] for p in range(parts)]
    best = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own: dict = {}
            for _, e in kept:
                own.setdefault(best(cut(e)[p], books[p])[1], []).append(cut(e)[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*own[j])) if j in own else b for j, b in enumerate(books[p])]
    out = []
    for i, e in kept:
        found = [best(v, book) for v, book in zip(cut(e), books)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return sorted(out, key=str), books


def test_edge_rows_match_the_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist(), i % 3 if i % 5 else None, "x", 1, 2) for i in range(40)]
    rows += [(40, None, 1, None, None, None), (41, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1, "", 0, 0), (42, [float("nan")] * 6, 1, "", 0, 0),
             (43, [float("inf")] * 6, None, "", 0, 0), (44, [], 2, "", 0, 0), (45, [0.5, -0.25], None, "", 0, 0), rows[3], rows[3],
             (None, rows[7][1], 2, "", 0, 0), (46, rows[7][1], None, "", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want, books = plain(rows, entries=8)
    got = V.train(df, entries=8)
    assert got.tolist() == [[list(e) for e in b] for b in books]
    codes = V.encode(df, got, "label")
    assert codes.columns == ["vec_id", "label", "code", "error"]
    assert sorted(((r.vec_id, r.code, r.error) for r in codes.collect()), key=str) == want
    assert V.decode(want[0][1], got).shape == (8,)
    whole = V.coded(df, entries=8).collect()
    by_label: dict = {}
    for r in codes.collect():
        by_label[r.label] = by_label.get(r.label, 0) + r.error
    assert len(whole) == len(want) and {r.label_error for r in whole} == set(by_label.values())


def test_empty_table(spark):
    assert V.coded(spark.createDataFrame([], SCHEMA)).count() == 0
    assert V.coded(spark.createDataFrame([(1, None, 1, "", 1, 1)], SCHEMA)).count() == 0
    assert [r.code for r in V.coded(spark.createDataFrame([(1, [], 1, "", 1, 1)], SCHEMA)).collect()] == ["00000000"]


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(V.ORACLE).fetchall()
    assert sorted(map(tuple, V.op11_vector_codes(spark, SF).collect())) == sorted(want)
