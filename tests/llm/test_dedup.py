"""Substring and line dedup against brute force."""

import hashlib
import random
import re

import pytest

from simforge.llm import frames, line_dedup, substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def ordered(rows):
    """Distinct documents in the operators' order: null id first; equal ids only with equal texts."""
    return sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))


def brute_substrings(rows, k):
    seen, out = set(), {}
    for doc_id, text in ordered(rows):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - k + 1):
            window = tuple(words[i : i + k])
            if window in seen:
                gone.update(range(i, i + k))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def brute_lines(rows, m, least_words=50):
    seen, out = set(), {}
    for doc_id, text in ordered(rows):
        lines = (text or "").split("\n")
        places = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        sizes = [len(WORD.findall(lines[i])) for i in places]
        for o in range(len(places)):
            for n in range(1, len(places) - o + 1):
                run = tuple(lines[i] for i in places[o : o + n])
                if (n >= m or sum(sizes[o : o + n]) >= least_words) and run in seen:
                    gone.update(places[o : o + n])
                seen.add(run)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[doc_id] = (len(places), len(gone), None if text is None else kept)
    return out


def substrings(spark, rows, k=20):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup.dedup_substrings(docs, k).collect()}


def lines(spark, rows, m=3, least_words=50):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(frames.keyed(docs), m, least_words).collect()}


def made_up(seed, n=60):
    """Texts over few words, with shared passages and periods."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        while len(words) < rng.randint(0, 150):
            pick = rng.random()
            words += rng.choice(passages) if pick < 0.3 else ["the"] * rng.randint(1, 45) if pick < 0.4 else [f"u{rng.randint(0, 10**6)}"]
        rows.append((i * 3 + 1, rng.choice([" ", "  ", "\t"]).join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force_on_repetitive_texts(spark, seed):
    rows = made_up(seed)
    assert substrings(spark, rows) == brute_substrings(rows, 20)


def test_substrings_of_other_lengths(spark, documents):
    rows = documents[:80]
    assert substrings(spark, rows, 9) == brute_substrings(rows, 9)


def test_substrings_match_brute_force_on_documents(spark, documents):
    assert substrings(spark, documents) == brute_substrings(documents, 20)


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_lines_match_brute_force(spark, m):
    rng = random.Random(m)
    pool = [f"line {i}" for i in range(12)] + [" ", ""]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {rng.random()}" for _ in range(rng.randint(0, 40)))) for i in range(50)]
    rows.append((50, None))
    assert lines(spark, rows, m) == brute_lines(rows, m)


@pytest.mark.parametrize("m", [3, 6])
def test_runs_of_few_long_lines_match_brute_force(spark, m):
    rng = random.Random(m)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(15)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(25)]
    assert lines(spark, rows, m, 8) == brute_lines(rows, m, 8)


def test_repeated_runs_are_maximal(spark):
    text = [f"line {i}" for i in range(40)]
    rows = [(1, "\n".join(text)), (2, "\n".join(["own a", *text[3:30], "own b", *text[10:14], "own c"])), (3, "x\n" * 20)]
    docs = frames.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.k, r.start, r.n) for r in line_dedup.repeated_runs(docs).collect()} == {(2, 1, 27), (2, 29, 4), (3, 1, 19)}
    depths = {(r.k, r.ord): r.n for r in line_dedup.later_copies(docs).collect()}
    assert depths[2, 1] == 16 and depths[2, 15] == 8 and depths[3, 1] == 16  # common prefixes, to a power of two


def test_a_passage_in_one_line_is_found(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, passage[:80]), (4, passage[:80])]
    got = lines(spark, rows)
    assert got[1] == (3, 0, rows[0][1]) and got[2] == (3, 1, "c\nd") and got[4][1] == 0


def test_lines_match_brute_force_on_documents(spark, documents):
    assert lines(spark, documents) == brute_lines(documents, 3)


def test_substring_edge_rows(spark, edge_docs, edge_rows, empty_docs):
    got = substring_dedup.dedup_substrings(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_words), set()).add((r.n_removed, r.kept_text))
    assert all(len(v) == 1 for v in by_text.values())  # repeated rows agree
    assert by_text[(0, 0)] == by_text[(1, 0)] == by_text[(2, 0)] == {(0, "")}
    assert by_text[(None, 30)] == {(0, " ".join(edge_rows[5][1].split()))}  # a null id comes first
    assert by_text[(5, 30)] == by_text[(6, 30)] == {(30, "")}
    assert by_text[(7, 32)] == {(30, "five six")}
    assert by_text[(9, 40_001)] == {(40_000, "tail")}
    assert by_text[(11, 400)] == {(399, "the")}
    assert by_text[(5, 72)] == {(6 * 12 - 6, "another text of the same id")}
    assert substring_dedup.dedup_substrings(empty_docs).count() == 0


def test_line_edge_rows(spark, edge_docs, edge_rows, empty_docs):
    got = line_dedup.dedup_lines(frames.keyed(edge_docs)).collect()
    assert len(got) == len(edge_rows)
    by = {(r.doc_id, r.n_lines): (r.n_removed, r.kept_text) for r in got}
    assert by[(0, 0)] == (0, None) and by[(1, 0)] == (0, "") and by[(2, 0)] == (0, " \t\n ")
    assert by[(None, 5)] == (0, edge_rows[5][1])
    assert by[(5, 5)] == (5, "") and by[(7, 6)] == (5, "five six")
    kept = line_dedup.drop_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, 0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11}
    assert line_dedup.drop_copies(empty_docs).count() == 0
