"""Best-fit packing by minimum bin slack.

Documents become token ids with an end id; those longer than a sequence are cut into
full pieces, the shorter rest first.  How pieces share sequences depends on their
lengths alone, so the planning sees only how many pieces there are of each length: at
most ``capacity`` numbers, however large the corpus.  For the longest piece left, a
bitset subset-sum over the lengths left finds the combination that fills the sequence
most; it is removed as often as the counts allow, and so on.  The resulting patterns say
which ranks of each length go where; ranks are dealt in Spark, in hash blocks so that a
length shared by a third of all pieces is not ranked by one task.

Defined cases: a null or empty text is one piece with the end id alone; null and
repeated doc_ids are packed row by row; an empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simforge.llm import frames, tokens
from simforge.llm.words import slices

CAPACITY, END = 1024, 2
#: Pieces of one length that a task ranks, about.
BLOCK_ROWS = 50_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the rest first, then full ones."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _cut_pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for part in (x for batch in batches for x in slices(batch, limit=tokens.SLICE_BYTES)):
            out: list[tuple] = []
            found, at = encoder.encode(part["text"])
            for doc_id, a, b in zip(part["doc_id"].to_pylist(), at[:-1], at[1:]):
                ids = np.append(found[a:b], np.uint32(end)).astype("<u4")
                out += [(doc_id, i, s, n, zlib.crc32(ids[s : s + n])) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out) if out else [[]] * 5, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def fullest(left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the combination of ``left`` with the largest sum up to ``room``."""
    reach, stages, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted(left, reverse=True):
        times, step = min(left[length], room // length), 1
        while times and not reach >> room & 1:  # copies by 1, 2, 4, ... and the rest
            step = min(step, times)
            stages.append((length, step, reach))
            reach |= reach << length * step & mask
            times, step = times - step, step * 2
    best, used = reach.bit_length() - 1, {}
    for length, step, before in reversed(stages):
        if not before >> best & 1:
            best -= length * step
            used[length] = used.get(length, 0) + step
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, times), ...]) until no length is left."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        rest = {k: v - (k == seed) for k, v in left.items() if v > (k == seed)}
        pattern = dict(fullest(rest, capacity - seed))
        pattern[seed] = pattern.get(seed, 0) + 1
        bins = min(left[k] // m for k, m in pattern.items())
        out.append((bins, sorted(pattern.items(), reverse=True)))
        for k, m in pattern.items():
            left[k] -= m * bins
            if not left[k]:
                del left[k]
    return out


def _place(patterns: list[tuple[int, list[tuple[int, int]]]]):
    """Ranks of each length to sequences and offsets."""
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}  # length: (first rank, first sequence, times, first offset)
    taken: dict[int, int] = {}
    sequence = 0
    for bins, pattern in patterns:
        offset = 0
        for length, times in pattern:
            ranges.setdefault(length, []).append((taken.get(length, 0), sequence, times, offset))
            taken[length] = taken.get(length, 0) + bins * times
            offset += length * times
        sequence += bins
    tables = {k: np.array(v, np.int64) for k, v in ranges.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, base, times, begin = tables[n][np.searchsorted(tables[n][:, 0], rank[rows], "right") - 1].T
                sequence[rows] = base + (rank[rows] - first) // times
                offset[rows] = begin + (rank[rows] - first) % times * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    ids = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut_pieces(path or tokens.vocabulary_path(), capacity, end), _PIECES)
    pieces = frames.settled(ids, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    blocks = max(16, -(-sum(counts.values()) // BLOCK_ROWS))
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    before = blocked.groupBy("length", "block").count()
    before = before.select("length", "block", (F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = blocked.withColumn("local", local).join(before, ["length", "block"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local") - 1).alias("rank")).mapInArrow(_place(plan(counts, capacity)), _PLACED)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(frames.documents(spark, sf_dir))
