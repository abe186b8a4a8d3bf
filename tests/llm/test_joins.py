"""N-gram join, components, top-k and revisits against brute force."""

import math
import random
import re

import pytest

from simforge.llm import ngram_join, revisits, topk
from simforge.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, k=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_groups(rows, percent=85):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def groups(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs).collect()]


def edited(rng, words, share):
    return [f"e{rng.randint(0, 999)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_match_brute_force_near_the_threshold(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(220):
        words = edited(rng, rng.choice(bases), rng.choice([0, 0.005, 0.02, 0.04, 0.08]))
        if rng.random() < 0.2:
            words = words + passage
        rows.append((i, " ".join(words).upper() if rng.random() < 0.3 else "  ".join(words)))
    rows += [(900, None), (901, ""), (902, "a"), (903, "A"), (904, "a b c"), (905, "a b c d")]
    rng.shuffle(rows)
    assert sorted(groups(spark, rows)) == sorted(brute_groups(rows))


def test_groups_match_brute_force_on_documents(spark, documents):
    assert sorted(groups(spark, documents)) == sorted(brute_groups(documents))


def test_search_of_lists_finds_every_pair_of_other_components():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    rows = [(token, fp, rng.randint(20, 60), rng.randint(0, 8), rng.randint(0, 3)) for token in range(3) for fp in rng.sample(range(100), 40)]
    cols = [pa.array(x, pa.int64()) for x in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(cols, ["token", "fp", "n", "pos", "comp"])
    got = set()
    for out in ngram_join._search_lists(85)(iter([batch.slice(0, 50), batch.slice(50)])):
        got |= set(zip(out["a"].to_pylist(), out["b"].to_pylist()))
    expected = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1] and x[4] != y[4]:
                n1, n2 = x[2], y[2]
                reach = min(x[3], y[3]) + min(n1 - x[3], n2 - y[3])
                if 100 * min(n1, n2) >= 85 * max(n1, n2) and 185 * reach >= 85 * (n1 + n2):
                    expected.add((x[1], y[1]))
    assert got == expected and expected
    assert np.all(ngram_join.prefix_length(np.array([1, 2, 20, 100]), 85) == [1, 1, 4, 16])


def test_group_edge_rows(spark, edge_docs, edge_rows, empty_docs):
    from simforge.llm import frames

    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(edge_docs.select("doc_id", "text", "k", "n")).collect()]
    expected = brute_groups([r[:2] for r in edge_rows])
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = ngram_join.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "10", "11", "2", "3", "5", "8", "None"]
    assert ngram_join.near_groups(empty_docs).count() == 0
    assert frames.keyed(edge_docs).filter("t = 0").count() == 0  # ids repeat, so texts tell rows apart


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(5, 5)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_topk(rows, is_query, k=5):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(256 * x) for x in v]
            fine[i] = min(fine.get(i, v), v)
    out = []
    for q in fine:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("width", [1, 3, 64])
def test_topk_matches_brute_force(spark, width, monkeypatch):
    rng = random.Random(width)
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CHUNK", 32)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 1)]) for _ in range(width)]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(None, [1.0] * width), (500, None), (501, [None] * width), (502, [float("nan")] * width), (503, [float("inf")] * width), (504, []), (505, [1.0] * (width + 2)), (0, [9.0] * width), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, query_id string")
    assert found(topk.top_k(df, "vec_id % 10 = 0")) == brute_topk(rows, lambda i: i % 10 == 0)


def test_topk_with_few_or_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(topk.top_k(df, "vec_id % 50 = 0")) == [(0, 1, 1, 256 * 128 - 512 * 256)]
    assert topk.top_k(df.filter("false"), "vec_id % 50 = 0").count() == 0
    big = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        topk.top_k(big, "vec_id = 0").collect()


def test_topk_sends_no_block_through_the_driver(spark, monkeypatch):
    """Few queries stay below the limit of a broadcast; repeated for each block of vectors they don't."""
    monkeypatch.setattr(topk, "BLOCK", 10)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 10 = 0")
    assert found(out) == brute_topk(rows, lambda i: i % 10 == 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


SCHEMA = "record_id long, kind string, url string, ts long, headers map<string,string>, payload_digest string, key string, block string"


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "response", "http://www.Example.com:80/a/?utm_source=x&b=2&a=1#top", 10, h(etag='"1"', content_length="5", server="s"), "d1"),
        (2, "response", "https://example.com/a?a=1&b=2", 20, h(etag='"2"', last_modified="m"), "d2"),
        (3, "revisit", "example.com/a?b=2&a=1", 15, h(etag='W/"1"', content_length="0", server="t"), None),
        (4, "revisit", "example.com/a?b=2&a=1", 30, h(etag='"1"'), None),
        (5, "revisit", "example.com/a?b=2&a=1", 10, h(etag='"1"'), None),
        (6, "revisit", "example.com/a?b=2&a=1", 31, h(last_modified="m"), None),
        (7, "revisit", "example.com/a?b=2&a=1", 32, h(server="u"), None),
        (8, "revisit", None, 40, h(etag='"1"'), None),
        (9, "revisit", "example.com/a?a=1&b=2", None, None, None),
        (10, "response", None, 1, None, "d0"),
        (11, "response", "https://example.com/a?a=1&b=2", 20, h(etag='"3"'), "d3"),
        (12, "revisit", "example.com/a?a=1&b=2", 21, h(etag='"3"'), None),
        (12, "revisit", "example.com/a?a=1&b=2", 21, h(etag='"3"'), None),
    ]
    df = spark.createDataFrame([(*r, "k", None) for r in rows], SCHEMA)
    got = {}
    for r in revisits.resolve(df).collect():
        got.setdefault(r.record_id, []).append((r.status, r.refers_to, r.payload_digest, r.headers))
    assert got[3] == [("resolved", 1, "d1", {"etag": 'W/"1"', "content-length": "5", "server": "t"})]
    assert got[4] == [("changed", None, None, {"etag": '"1"'})]
    assert got[5][0][0] == "no_response"
    assert got[6][0][0] == "changed" and got[7][0][0] == "no_validator"
    assert got[8][0][0] == "no_response" and got[9] == [("no_response", None, None, None)]
    assert got[12] == [("resolved", 11, "d3", {"etag": '"3"'})] * 2
    assert set(got) == {3, 4, 5, 6, 7, 8, 9, 12}
    assert revisits.resolve(df.filter("false")).count() == 0


def test_sketches_never_show_more_than_the_difference():
    """The parities of two sets differ in no more bits than the sets in members, and few fewer."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        words = list(base)
        for i in rng.integers(0, 300, rng.integers(0, 30)):
            words[i] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    row, value, n = ngram_join.shingles(pa.array([*texts, "", None]), 4)
    sketch = np.frombuffer(b"".join(ngram_join._sketches(row, value, n)), np.uint64).reshape(len(n), -1)
    sets = [set(value[row == i].tolist()) for i in range(len(n))]
    for i in range(len(n)):
        for j in range(i):
            apart, bits = len(sets[i] ^ sets[j]), int(np.bitwise_count(sketch[i] ^ sketch[j]).sum())
            assert bits <= apart and (apart > 200 or bits >= 0.7 * apart - 6)


def test_thinned_edges_have_the_same_components(spark):
    from simforge.llm import components as cc

    rng = random.Random(3)
    edges = [(a, b) for g in range(6) for a in range(g * 50, g * 50 + 40) for b in rng.sample(range(g * 50, g * 50 + 40), 9)]
    df = spark.createDataFrame(edges, "a long, b long")
    thin = cc.thinned(df.repartition(3))
    assert thin.count() < 6 * 40
    same = lambda x: sorted(map(tuple, cc.components(x).collect()))
    assert same(thin) == same(df)
    assert cc.thinned(df.limit(0)).count() == 0


def one_family(n=90, seed=11):
    """Texts with a few edits each of one base: most link with one another, some only through others."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 1, 2, 2, 3, 4])):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    return rows


def test_large_family_is_compared_set_by_set_not_pair_by_pair(spark, monkeypatch):
    rows, compared, verify = one_family(), [], ngram_join._verify

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return verify(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "_verify", counted)
    assert sorted(groups(spark, rows)) == sorted(brute_groups(rows))
    assert sum(compared) < 4 * len(rows), compared


def test_pairs_left_after_the_first_links_join_components(spark):
    import numpy as np

    names = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}
    same, other = np.arange(20, dtype=np.uint64), np.arange(100, 120, dtype=np.uint64)
    mixed = np.r_[same[:10], other[:10]]
    sets = spark.createDataFrame([(names[x], bytearray(v.tobytes())) for x, v in zip("abcde", [other, same, same, same, mixed])], "fp long, members binary")
    # 4's least partner, 1, doesn't link with it; 2 does
    rest = spark.createDataFrame([(1, 4), (2, 4), (2, 3), (3, 4), (1, 5), (2, 5)], "a long, b long")
    none = spark.createDataFrame([], "node long, label long")
    from simforge.llm import frames

    got = ngram_join._component_links(frames.settled(rest, "rest"), frames.settled(sets, "sets"), none, 85)
    assert sorted((r.node, r.label) for r in components(got).collect()) == [(2, 2), (3, 2), (4, 2)]


def test_sketches_drop_only_pairs_apart(spark):
    import numpy as np
    import pyarrow as pa

    texts = [t for _, t in one_family(12)] + [" ".join(f"z{i}x{j}" for j in range(118)) for i in range(4)]
    row, value, n = ngram_join.shingles(pa.array(texts), 4)
    sketch = ngram_join._sketches(row, value, n)
    table = spark.createDataFrame([(i, int(n[i]), bytearray(sketch[i])) for i in range(len(texts))], "fp long, n_shingles long, sketch binary")
    every = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    got = {(r.a, r.b) for r in ngram_join._close(spark.createDataFrame(every, "a long, b long"), table, 85).collect()}
    sets = [set(value[row == i].tolist()) for i in range(len(texts))]
    linked = {(i, j) for i, j in every if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert linked <= got and linked and not any(j >= 12 for _, j in got)


def test_counts_travel_in_small_integers():
    import numpy as np
    import pyarrow as pa

    texts = ["a b c d"] * 300 + [" ".join(f"w{i}" for i in range(500))]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts)], ["k", "t", "doc_id", "text"])
    blocks = [x for b in ngram_join._find_sets(4, 1 << 16)(iter([batch])) for x in b.to_pylist() if x["block"] is not None]
    assert {len(x["counts"]) for x in blocks} <= {4096, 2 * 4096}
    _, value, _ = ngram_join.shingles(pa.array(texts), 4)
    expected = np.bincount(ngram_join._slot(value, 1 << 16), minlength=1 << 16)
    parts = pa.RecordBatch.from_pylist(blocks * 2, pa.schema([("block", pa.int32()), ("counts", pa.binary())]))
    got = np.zeros(1 << 16, np.int64)
    for x in next(ngram_join._add_counts(iter([parts]))).to_pylist():
        got[x["block"] * 4096 : (x["block"] + 1) * 4096] = np.frombuffer(x["counts"], np.int64)
    assert np.array_equal(got, 2 * expected) and got.max() == 600
