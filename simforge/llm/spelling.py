"""Spelling variants by finite-state composition.

Words that differ by one inserted, deleted or replaced code point are the pairs that the
composition of the vocabulary's minimal acceptor, a transducer of exactly one edit, and
the acceptor again lets through.  The transducer has two states, before and after the
edit.  Before it, both acceptors have read the same and are in the same state; after it
they must read the same to the end.  Each state knows how many words lead on from it by
smaller letters, so a path's sum is the number of its word and no text is built.  An edit
counts where two words first differ, so each pair comes once.

Pairs are enumerated per initial state.  Of two such words, with m code points in the
shorter one and h = m // 2, either the first h are equal, or the last m - h are and they
differ earlier.  A word therefore goes to the state after its first half and to the one
before its last half, for m its own length and one less; what is left between the halves
is the language that a task turns into an acceptor.  A state with more than ``GROUP``
words is parted in the same way again, until none has more or nothing is left to part
(then a state has no more words than the alphabet allows), so a beginning or ending
shared by a third of all words fills no task.  What leaves a task is one row a word and
state: its number of near words there and the commonest of them.

Forms point to words at least ``ratio`` times as common, so chains are short; roots
are found by pointer doubling.

Defined cases: a null text has no word; a null doc_id is written as nothing in the
checksum's input; repeated rows count as often as they come; an empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simforge.llm import frames

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Every so many runs by checksum lose a code point.
EVERY = 31
#: Words of an initial state that a task turns into one acceptor; more are parted again.
GROUP = 20_000


class Acceptor:
    """The minimal acyclic acceptor of sorted words, which numbers them in their order."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = []  # letter -> state
        self.skip: list[dict[str, int]] = []  # letter -> words that come before by smaller letters or by ending here
        self.final: list[bool] = []
        self.words: list[int] = []
        known: dict[tuple, int] = {}

        def close(final: bool, edges: list[tuple[str, int]]) -> int:
            key = (final, *edges)
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.next)
                n, skip = int(final), {}
                for c, to in edges:
                    skip[c] = n
                    n += self.words[to]
                self.next.append(dict(edges))
                self.skip.append(skip)
                self.final.append(final)
                self.words.append(n)
            return state

        path: list[tuple[list, list]] = [([False], [])]  # of the word read last: (final, edges to closed states)
        last = ""
        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            for i in range(len(last), same, -1):
                final, edges = path.pop()
                path[-1][1].append((last[i - 1], close(final[0], edges)))
            path += [([False], []) for _ in range(same, len(word))]
            path[-1][0][0] = True
            last = word
        for i in range(len(last), 0, -1):
            final, edges = path.pop()
            path[-1][1].append((last[i - 1], close(final[0], edges)))
        self.start = close(path[0][0][0], path[0][1])

    def common(self, u: int, v: int, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Numbers of the words that read the same from states u and v on."""
        todo = [(u, v, i, j)]
        while todo:
            u, v, i, j = todo.pop()
            if self.final[u] and self.final[v]:
                yield i, j
            a, b = self.next[u], self.next[v]
            for c in a if len(a) <= len(b) else b:
                if c in a and c in b:
                    todo.append((a[c], b[c], i + self.skip[u][c], j + self.skip[v][c]))

    def one_edit(self, at_end: bool = True) -> Iterator[tuple[int, int]]:
        """Numbers of the words that one edit parts, each pair once; ``at_end``: also where one word goes on after the other's end."""
        todo = [(self.start, 0)]
        while todo:
            u, i = todo.pop()
            edges, skip = self.next[u], self.skip[u]
            if len(edges) > 1:
                letters = list(edges)
                for x, c in enumerate(letters):
                    for d in letters[x + 1 :]:  # replaced
                        yield from self.common(edges[c], edges[d], i + skip[c], i + skip[d])
            for c, w in edges.items():
                if self.final[u] and self.final[w] and at_end:  # inserted at the end
                    yield i, i + skip[c]
                if len(edges) > 1:
                    on, more = self.next[w], self.skip[w]
                    for d in edges:  # inserted before another letter
                        if d != c and d in on:
                            yield from self.common(edges[d], on[d], i + skip[d], i + skip[c] + more[d])
                todo.append((w, i + skip[c]))


_GROUPED = "word string, n_near long, form_n long, form string"


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted rows (first, last, m, ended, middle, n), an initial state after the other."""
    out: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out) if out else [[]] * 4, types)], ["word", "n_near", "form_n", "form"])

    def solve(table: pa.Table | pa.RecordBatch) -> None:
        middle, n, m = table["middle"].to_pylist(), table["n"].to_pylist(), table["m"][0].as_py()
        shorter = [len(x) == m for x in middle]
        if sum(shorter) == 0:
            return
        first, last = table["first"][0].as_py(), table["last"][0].as_py()
        count, best = [0] * len(n), [-1] * len(n)
        for i, j in Acceptor(middle).one_edit(not table["ended"][0].as_py()):
            if shorter[i] or shorter[j]:  # two of the longer ones meet where m is their length
                for a, b in ((i, j), (j, i)):
                    count[a] += 1
                    old = best[a]
                    if old < 0 or n[b] > n[old] or n[b] == n[old] and middle[b] + last < middle[old] + last:
                        best[a] = b
        out.extend((first + middle[i] + last, x, n[best[i]], first + middle[best[i]] + last) for i, x in enumerate(count) if x)

    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None and len(rest) else table
        if len(table) < 2:
            rest = table
            continue
        change = np.zeros(len(table) - 1, bool)
        for c in ("m", "ended", "first", "last"):
            column = table[c].combine_chunks()
            change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(change) + 1]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                solve(table.slice(a, b - a))
        rest = table.slice(int(cuts[-1]))
        if len(out) > 20_000:
            yield batch_of()
            out = []
    if rest is not None and len(rest) > 1:
        solve(rest)
    yield batch_of()


_KEY = ["first", "last", "m", "ended"]


def _parted(rows: DataFrame, m: Column) -> DataFrame:
    """Rows (first, middle, last, ended) parted once: with the first half of m code points read, and with the last."""
    h = F.floor(m / 2).cast("int")
    middle, size = F.col("middle"), F.char_length("middle")
    front = F.struct(F.concat("first", F.substring(middle, F.lit(1), h)).alias("first"), F.col("last"), (m - h).cast("int").alias("m"),
                     F.col("ended"), F.substring(middle, h + 1, size).alias("middle"), "n")
    tail = m - h
    back = F.struct(F.col("first"), F.concat(F.substring(middle, size - tail + 1, tail), F.col("last")).alias("last"), h.alias("m"),
                    F.lit(True).alias("ended"), F.substring(middle, F.lit(1), size - tail).alias("middle"), "n")
    return rows.select(F.explode(F.array(front, back)).alias("s")).select("s.*")


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n), each once, that have near words; form is the commonest of them."""
    whole = words.select(F.lit("").alias("first"), F.col("word").alias("middle"), F.lit("").alias("last"), F.lit(False).alias("ended"), "n")
    size = F.char_length("middle")
    rows = whole.withColumn("m", F.explode(F.array(size, size - 1))).filter("m >= 0")
    rows = _parted(rows, F.col("m"))
    parts: list[DataFrame] = []
    while True:
        many = rows.filter("m > 1").groupBy(*_KEY).count().filter(F.col("count") > group).drop("count")
        many = frames.settled(many, "large-states")
        if not many.take(1):
            break
        parts.append(rows.join(many, _KEY, "left_anti"))
        rows = frames.settled(_parted(rows.join(many, _KEY, "left_semi"), F.col("m")), "parted")
    for part in parts:
        rows = rows.unionByName(part)
    rows = rows.select(*_KEY, "middle", "n").repartition(*_KEY).sortWithinPartitions(*_KEY, "middle")
    found = rows.mapInArrow(_near_words, _GROUPED)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), following forms to the last."""
    now = frames.settled(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        both = now.join(on, now["root"] == on["at"], "left")
        if not both.filter("further is not null").take(1):
            return now
        now = frames.settled(both.select("word", F.coalesce("further", "root").alias("root")), "roots")


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters, some without one code point by their checksum."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.expr(f"regexp_extract_all(text, '{LETTERS}{{{least_length},}}+', 0)")).alias("run"))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = runs.select("id", lower.alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = F.pmod(h, F.char_length("run").cast("long")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(h % EVERY == 0, less).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def variants(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    near = near_words(words, group).withColumnRenamed("word", "near_word")
    rows = words.join(near, words["word"] == near["near_word"], "left")
    good = F.col("form_n") >= F.col("n") * ratio
    rows = rows.select("word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                       F.when(good, F.col("form_n")).alias("form_n"))
    rows = frames.settled(rows, "variants")
    last = roots(rows.filter("form is not null")).withColumnRenamed("word", "from_word")
    rows = rows.join(last, rows["word"] == last["from_word"], "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = frames.settled(vocabulary(frames.documents(spark, sf_dir)), "vocabulary")
    return variants(words)


#: The checksum by its table, and near words by keys with one code point taken out.
ORACLE = r"""
with recursive bits(b, k, v) as (
  select b, 0, b from range(256) t(b)
  union all select b, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from bits where k < 8
), crc_table as (select list(v order by b) t from bits where k = 8),
runs as (
  select coalesce(cast(doc_id as varchar), '') id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run from documents
), counted as (select id, run, count(*) n from runs where length(run) >= 7 group by id, run),
bytes as (
  select id, run, n, hex(encode(id || ':' || run)) x from counted
), summed as (
  select id, run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(1, length(x), 2),
      lambda i: (strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)),
    lambda c, y: xor(c // 256, t[xor(c, y) % 256 + 1]))) h
  from bytes, crc_table
), v as (
  select word, cast(sum(n) as bigint) n from (
    select n, case when h % 31 = 0 then run[: h % length(run)] || run[h % length(run) + 2 :] else run end word from summed
  ) where length(word) >= 7 group by word having sum(n) >= 2
), holes as (
  select word, n, i, word[: i - 1] || word[i + 1 :] less from v, lateral (select unnest(range(1, length(word) + 1)) i)
), near as (
  select a.word, b.word other, b.n from holes a join holes b on a.less = b.less and a.i = b.i and a.word <> b.word
  union
  select a.less, a.word, a.n from holes a join v on v.word = a.less
  union
  select a.word, v.word, v.n from holes a join v on v.word = a.less
), best as (
  select word, count(*) n_near, min(struct_pack(less := -n, form := other)) top from near group by word
), formed as (
  select v.word, v.n, coalesce(b.n_near, 0) n_near,
    case when -b.top.less >= 10 * v.n then b.top.form end form, case when -b.top.less >= 10 * v.n then -b.top.less end form_n
  from v left join best b using (word)
), chain(word, place, next) as (
  select word, word, form from formed
  union all select c.word, f.word, f.form from chain c join formed f on f.word = c.next
)
select f.word, f.form, c.place root, f.n, f.n_near, f.form_n from formed f join chain c on c.word = f.word and c.next is null
"""
