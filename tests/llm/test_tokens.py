"""Token ids, packing and token files: exact ids, exact round trips, lower bounds."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from simforge.llm import packing, token_files, tokens

PATH = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def plain():
    """The library alone, without cutting or remembering."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def encoded(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_encoder_gives_the_library_s_ids(plain, documents, edge_rows):
    encoder = tokens.Encoder(PATH)
    odd = ["a  b", " a", "a ", "a \n b", "a\n\nb", "it's 3.14\tx y  z", "x\x1cy \x1c z", "a   b \n", "<|endoftext|> a", "'s 're", "\n", " ", "a" * 300 + " b", "é́ ü💡. ß, a\u3000 b\u00a0 c \u2003d\u0085 e", None, ""]
    rng = random.Random(5)
    odd += ["".join(rng.choice("ab1 .,'!\n\t é\u00a0\u3000💡") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts = [*odd, *(t for _, t in documents), *(r[1] for r in edge_rows)]
    for _ in range(2):  # learnt, then remembered
        for text, got in zip(texts, encoded(encoder, texts)):
            assert got == plain(text), repr(text)[:80]
    assert encoded(encoder, []) == [] and encoded(encoder, [None]) == [[]]


def test_encoder_forgets(plain, documents, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder = tokens.Encoder(PATH)
    for _, text in documents[:40]:
        assert encoded(encoder, [text]) == [plain(text)]
    assert encoder.n < 20_000


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 32])
@pytest.mark.parametrize("block", [1, 5, 8, 4096])
def test_record_round_trip_and_random_access(bits, block):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 40, 0, 7, 300)]
    ids = np.concatenate(docs)
    segment = token_files.Segment(token_files.write_record(docs, bits, block))
    assert [segment.document(i).tolist() for i in range(len(docs))] == [d.tolist() for d in docs]
    for begin in range(0, len(ids), 37):
        for end in (begin, begin + 1, min(begin + 90, len(ids)), len(ids)):
            assert segment.ids(begin, end).tolist() == ids[begin:end].tolist()


def test_record_refuses_wide_ids():
    with pytest.raises(ValueError):
        token_files.write_record([np.array([4], np.uint32)], 2)


def expected_files(rows, plain):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*plain(text), 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_match_brute_force(spark, documents, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 5000)
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    token_files.write_tokens(docs, str(tmp_path / "t"))
    got = sorted(tuple(r) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect())
    assert got == sorted(expected_files(documents, plain))


def test_token_file_edge_rows(spark, edge_docs, edge_rows, empty_docs, plain, tmp_path):
    token_files.write_tokens(edge_docs, str(tmp_path / "t"))
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()), key=str)
    assert got == sorted(expected_files([r[:2] for r in edge_rows], plain), key=str)
    token_files.write_tokens(empty_docs, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        left = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        reach = {0}
        for length, times in left.items():
            reach = {r + length * t for r in reach for t in range(times + 1)}
        used = packing.fullest(left, room)
        assert sum(k * m for k, m in used) == max(r for r in reach if r <= room)
        assert all(m <= left[k] for k, m in used)


def test_plan_uses_every_length_once():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 400) for n in range(1, 101)}
    patterns = packing.plan(counts, 100)
    used = {}
    for bins, pattern in patterns:
        assert sum(k * m for k, m in pattern) <= 100
        for k, m in pattern:
            used[k] = used.get(k, 0) + bins * m
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(b for b, _ in patterns) <= -(-total // 100) * 1.03 + 1


def check_packing(rows, got, plain, capacity=1024):
    places = {}
    expected = {}
    for doc_id, text in rows:
        ids = np.array([*plain(text), 2], "<u4")
        pieces = packing.cut(len(ids), capacity)
        assert all(n == capacity for _, n in pieces[1:]) and sum(n for _, n in pieces) == len(ids)
        for i, (s, n) in enumerate(pieces):
            key = (doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes()))
            expected[key] = expected.get(key, 0) + 1
    found = {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        found[key] = found.get(key, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert found == expected
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(k[3] * v for k, v in expected.items())


def test_packing_on_documents(spark, documents, plain):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    sequences, total = check_packing(documents, packing.pack(docs).collect(), plain)
    assert sequences <= -(-total // 1024) * 1.01 + 1


def test_packing_edge_rows(spark, edge_docs, edge_rows, empty_docs, plain):
    check_packing([r[:2] for r in edge_rows], packing.pack(edge_docs).collect(), plain)
    assert packing.pack(empty_docs).count() == 0
