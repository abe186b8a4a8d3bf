"""op12: windows read back, their budget, history and masks."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from simforge.llm import chat_windows as C, tokens

from .conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, kind int, segment string, place long"


def by_conversation(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        out[r[0]].append((r[2] or "", r[3] or ""))
    return out


def digests(rows):
    out = {}
    for key, turns in by_conversation(rows).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[key] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|x<|<\\|", "a<b|c", "<|nl|>", "<\\", "|", "é<|💡|>"])
def test_escape_round_trip(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    turn, begin = C.formatted(text + "\n" + text, text)
    assert list(C.parse(turn + turn)) == [(text + "\n" + text, text)] * 2 and turn[begin:].startswith(C.escape(text))


def test_query_reads_every_conversation_back(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", C.TRICKY), (-1, 1, "assistant", C.TRICKY)]
    found = C.op12_chat_windows(spark, SF)
    assert read(found) == digests(rows)
    whole = {k: sum(len(C.formatted(*t)[0]) for t in v) for k, v in by_conversation(rows).items()}
    assert all(r.formatted_chars >= whole[r.conv_id] and (r.n_windows > 1 or r.formatted_chars == whole[r.conv_id]) for r in found.collect())


def edge_rows():
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 7), 0, "", 0) for i in range(61)]
    rows = [(1, -1, "system", "be brief <|im_end|>", 0, "", 0), *rows]
    rows += [(2, 0, "system", "alone", 1, None, None), (3, 0, "user", None, 1, None, 1), (3, 1, None, "x", 1, "", 1), (3, 2, "assistant", long, 1, "", 1),
             (3, 3, "assistant", "", 1, "", 1), (None, 0, "user", "no id", 1, "", 1), (None, None, "assistant", "no turn", 1, "", 1),
             (4, 0, "system", long, 1, "", 1), (4, 1, "user", "q", 1, "", 1), (4, 2, "assistant", "a", 1, "", 1), (4, 3, "system", "later", 1, "", 1)]
    rows += [(5, 0, "assistant", "same", 1, "", 1)] * 40  # repeated rows, ties on turn
    rows += [(6, 2, "line\nbreak <|", "odd role", 1, "", 1)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"segment": 8, "budget": 60, "history_tokens": 30, "history_turns": 3}, {"segment": 3, "budget": 40, "history_turns": 2}])
def test_edge_rows(spark, settings):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert read(C.read_back(*C.window_parts(df, **settings))) == digests(rows)


def test_windows_keep_the_budget_and_learn_each_answer_once(spark):
    rows = edge_rows()
    budget, history, turns = 60, 30, 3
    got = C.windows(spark.createDataFrame(rows, SCHEMA), segment=8, budget=budget, history_tokens=history, history_turns=turns).collect()
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    want = by_conversation(rows)
    for w in got:
        assert w.n_tokens == len(tokenizer.encode(w.formatted, add_special_tokens=False).ids)
        body = list(C.parse(w.formatted))
        has = int(w.has_system)
        assert len(body) == has + w.n_history + w.n_new and w.n_history <= turns
        assert body[has:] == want[w.conv_id][w.first_turn - w.n_history : w.first_turn + w.n_new] or w.n_new == 0
        assert not has or body[0] == want[w.conv_id][0]
        if w.n_tokens > budget:  # a turn alone that is too long
            assert w.n_new <= 1 and w.n_history == 0
        size = [len(tokenizer.encode(C.formatted(*t)[0], add_special_tokens=False).ids) for t in body]
        assert sum(size[has : has + w.n_history]) <= history
        assert [C.unescape(w.formatted[s.start : s.end]) for s in w.loss] == [t for r, t in body[has + w.n_history :] if r == "assistant"]
    assert {len(by) for by in [[w for w in got if w.conv_id == 1]]} != {1}


def test_spans():
    n = np.array([10, 10, 10, 50, 10, 10])
    assert list(C.spans(n, 0, 0, 30, 10, 4)) == [(0, 0, 3), (3, 3, 4), (4, 4, 6)]
    assert list(C.spans(n[:3], 0, 5, 25, 10, 4)) == [(0, 0, 2), (1, 2, 3)]
    assert list(C.spans(np.array([5, 5, 5]), 2, 0, 100, 100, 1)) == [(1, 2, 3)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.windows(empty).count() == 0 and C.read_back(*C.window_parts(empty)).count() == 0
