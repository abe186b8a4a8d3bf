"""Texts that hold the vocabulary's added tokens: ids of the library's plain call."""

import random

import pytest
from tokenizers import Tokenizer

from simforge.llm import packing, token_files, tokens

from .test_tokens import check_packing, encoded, expected_files

PATH = tokens.vocabulary_path()
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    bits = [END, END, "<|endof", "text|>", "<|", "|>", "a", "bc", " ", "  ", "\n", "\n\n", ".", "'s", "7", "é", "💡", "\u3000"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    return [END, f"{END} a", f"a {END}", f"a{END}b c{END}{END}", f"\n{END}\n", "<|endof", "text|> x", f"<{END}>", "w" * 100 + END + "w" * 100, "", None, *made]


def test_library_reads_the_end_token(library):
    assert library(f"{END} a") == [50256, 257]


def test_ids_of_texts_with_added_tokens(library, texts, documents):
    encoder = tokens.encoder(PATH)
    for _ in range(2):  # learnt, then remembered
        assert encoded(encoder, texts) == [library(t) for t in texts]
        for text in texts:
            assert encoded(encoder, [text]) == [library(text)], repr(text)
    plain = [t for _, t in documents]
    assert encoded(encoder, plain) == [library(t) for t in plain]


def test_token_files_and_packing_with_added_tokens(spark, library, texts, tmp_path):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_files.write_tokens(docs, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()) == sorted(expected_files(rows, library))
    check_packing(rows, packing.pack(docs).collect(), library)
