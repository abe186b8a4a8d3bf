"""op13 against plain edit distances, its SQL, and states that must be parted."""

import random
import zlib

import duckdb
import pytest

from simforge.llm import spelling as S

from .conftest import SF


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [x for x in counts if is_near(w, x)] for w in counts}
    best = {w: min(((-counts[x], x) for x in v), default=None) for w, v in near.items()}
    form = {w: b[1] if b and -b[0] >= ratio * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()), key=str)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_acceptor_is_minimal_and_numbers_words():
    a = S.Acceptor(["tap", "taps", "top", "tops"])
    assert len(a.next) == 5 and a.words[a.start] == 4
    assert sorted(tuple(sorted(x)) for x in a.one_edit()) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    assert sorted(tuple(sorted(x)) for x in a.one_edit(at_end=False)) == [(0, 2), (1, 3)]


@pytest.mark.parametrize("seed", range(40))
def test_pairs_of_random_words(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(40)})
    want = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if is_near(words[i], words[j])]
    assert sorted(tuple(sorted(x)) for x in S.Acceptor(words).one_edit()) == want


@pytest.mark.parametrize("group", [2, 5, 20_000])
def test_variants_of_short_and_crowded_words(spark, group):
    """Also with states so small that words are parted down to single letters."""
    rng = random.Random(group)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(160)}
    words |= {"beginning" + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 4))) for _ in range(80)}
    words |= {"".join(rng.choice("xyz") for _ in range(rng.randint(0, 4))) + "ending" for _ in range(80)}
    counts = {w: rng.choice([2, 3, 30, 400, 5000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(S.variants(df, group=group)) == brute(counts)


def test_roots_follow_chains(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "zzzzzzz": 9}
    found = got(S.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == brute(counts) and {r[2] for r in found} == {"aaabbbb", "zzzzzzz"}


def plain_vocabulary(docs):
    import re

    counts: dict = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_vocabulary_of_edge_documents(spark, documents, edge_rows):
    long = "a" * 30_000
    rows = [*edge_rows, (77, f"Äpfelbäume {long} straße-straßen éé×÷ééé ABCDEFGH abcdefgh x1abcdefg", None, None, None, 1, 1, 1, None, None)] * 2
    rows += [(78, f"{long}b {long[1:]}", None, None, None, 1, 1, 1, None, None)] * 2
    from .conftest import DOC_SCHEMA

    df = spark.createDataFrame(rows, DOC_SCHEMA)
    want = plain_vocabulary([r[:2] for r in rows])
    assert {r.word: r.n for r in S.vocabulary(df).collect()} == want
    assert got(S.variants(S.vocabulary(df))) == brute(want)


def test_empty_tables(spark, empty_docs):
    assert S.variants(S.vocabulary(empty_docs)).count() == 0
    one = spark.createDataFrame([("lonesome", 3)], "word string, n long")
    assert got(S.variants(one)) == [("lonesome", None, "lonesome", 3, 0, None)]


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    columns = "word, form, root, n, n_near, form_n"
    want = sorted(con.execute(f"select {columns} from ({S.ORACLE})").fetchall(), key=str)
    assert got(S.op13_spelling_variants(spark, SF)) == want
