"""Substring dedup over the De Bruijn graph of token k-mers.

An edge of the graph is a window of ``k`` words, from the node of its first k-1 words
to that of its last k-1.  A word is removed if it lies in a window whose edge also has
an earlier coordinate (smaller document, or same document and earlier start).

1. Edges are dealt by *anchor*, the least hash of the ``ANCHOR``-word runs inside a
   window: consecutive windows mostly share it, so one row stands for a whole run of
   edges.  Only anchors found more than once can hold a repeated edge; the others are
   dropped, by a shuffle of one row per run.
2. Edges of repeated anchors meet under their anchor and take the least coordinate of
   each edge as their source.  Successive edges of a document whose sources are also
   successive form a nonbranching path and leave as one row.
3. Paths that were cut at anchor boundaries are compacted to maximal ones.
4. The source span of every path is digested from the source document's own words and
   joined to the copy, whose words must have the same digest.

Hot passages are pre-aggregated: a task ships at most one coordinate of an edge per
slice of text, since a later one in the same slice already has an earlier source.  The
documents are shuffled once by key; the three joins with them share that exchange.

Defined cases: a null text has no words; a null doc_id sorts before all others; rows
equal in doc_id and text are one document and each return its result; rows equal in
doc_id alone are different documents, in order of their texts' hashes.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simforge.llm import frames
from simforge.llm.words import Words, slices

WINDOW = 20
ANCHOR = 8

_ANCHORS = "anchor long, salt int, k long, t long, start int, known boolean"
_EDGES = "anchor long, salt int, k long, t long, start int, n int, k0 long, t0 long, start0 int, edges array<long>"
_PATHS = "k long, t long, start int, n int, k0 long, t0 long, start0 int"
_DIGESTS = "k0 long, t0 long, start0 int, n int, digest binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _sliding_min(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of x[i : i + width] for each i, and whether it is found twice there."""

    def beside(a, b, gap):
        """Of two neighbouring ranges, the second ``gap`` later."""
        n = min(len(a[0]), len(b[0]) - gap)
        low, other = a[0][:n], b[0][gap : gap + n]
        return np.minimum(low, other), np.where(low == other, True, np.where(low < other, a[1][:n], b[1][gap : gap + n]))

    power, size, out, covered = (x, np.zeros(len(x), bool)), 1, None, 0
    while size <= width:
        if width & size:
            out = power if out is None else beside(out, power, covered)
            covered += size
        if size * 2 <= width:
            power = beside(power, power, size)
        size *= 2
    return out


def _runs(words: Words, k: int):
    """Edges of a slice as (start word, edge hash, anchor); of each run of edges with one
    anchor the first edge, the length, and whether the anchor is found in it twice."""
    h = words.hashes()
    at, edge = words.grams(h, k)
    if not len(at):
        return at, edge, edge, at, at, at
    own, gram = words.grams(h, ANCHOR)
    full = np.full(len(h), np.uint64(2**64 - 1), np.uint64)
    full[own] = gram
    least, twice = _sliding_min(full, k - ANCHOR + 1)
    anchor, doc = least[at], words.doc[at]
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    return at, edge, anchor, head, np.diff(np.r_[head, len(at)]), np.logical_or.reduceat(twice[at], head)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _find_anchors(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part["text"])
                at, _, anchor, head, _, twice = _runs(words, k)
                if not len(head):
                    continue
                value, doc = anchor[head], words.doc[at[head]]
                order = np.argsort(value, kind="stable")
                same = value[order][1:] == value[order][:-1]
                known, salt = np.zeros(len(head), bool), np.zeros(len(head), np.int32)
                known[order[1:][same]] = known[order[:-1][same]] = True
                salt[order[1:][same]] = 1 + np.arange(same.sum())  # the first of a slice stands for it
                known |= twice  # a run can repeat its own edges
                key = [part[c].to_numpy(zero_copy_only=False)[doc] for c in ("k", "t")]
                start = (at[head] - words.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_signed(value), salt, *key, start, known)], ["anchor", "salt", "k", "t", "start", "known"])

    return run


def _find_edges(k: int):
    names = ["anchor", "salt", "k", "t", "start", "n", "k0", "t0", "start0", "edges"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part["text"])
                at, edge, anchor, head, length, _ = _runs(words, k)
                if not len(head):
                    continue
                doc = words.doc[at]
                place = at - words.first[doc]
                starts = part["starts"]
                wanted_doc = np.repeat(np.arange(len(part)), np.asarray(pc.fill_null(pc.list_value_length(starts), 0)))
                wanted = wanted_doc * (1 << 32) + starts.flatten().to_numpy()
                chosen = np.isin(doc[head] * (1 << 32) + place[head], wanted)
                use = np.repeat(chosen, length)
                at, edge, anchor, doc, place = at[use], edge[use], anchor[use], doc[use], place[use]
                if not len(at):
                    continue
                key, tag = (part[c].to_numpy(zero_copy_only=False)[doc] for c in ("k", "t"))
                run_of = np.repeat(np.arange(len(head)), length)[use]
                # the first coordinate of each edge in this slice is its source here
                order = np.lexsort((place, tag, key, edge, anchor))
                new = np.r_[True, (edge[order][1:] != edge[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])]
                source = np.empty(len(at), np.int64)
                source[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                same = (key == key[source]) & (tag == tag[source]) & (place == place[source])
                moved = np.where(same, 0, 1)
                shift = np.where(same, 0, place - place[source])
                cut = np.r_[True, (run_of[1:] != run_of[:-1]) | (moved[1:] != moved[:-1]) | (shift[1:] != shift[:-1]) | ((moved[1:] == 1) & ((key[source][1:] != key[source][:-1]) | (tag[source][1:] != tag[source][:-1])))]
                first = np.flatnonzero(cut)
                n = np.diff(np.r_[first, len(at)])
                later = moved[first] == 1
                # of rows that repeat a document one is enough
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(later, 0, n))].astype(np.int32)), pa.array(_signed(edge[moved == 0])))
                salt = np.where(later, 1 + np.arange(len(first)), 0).astype(np.int32)
                s = source[first]
                cols = [_signed(anchor[first]), salt, key[first], tag[first], place[first].astype(np.int32), n.astype(np.int32), key[s], tag[s], place[s].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), lists], names)

    return run


def _path_batch(key, tag, place, k0, t0, p0, run_of) -> pa.RecordBatch:
    """Successive edges with successive sources as paths."""
    cut = np.r_[True, (run_of[1:] != run_of[:-1]) | (place[1:] != place[:-1] + 1) | (p0[1:] != p0[:-1] + 1) | (k0[1:] != k0[:-1]) | (t0[1:] != t0[:-1])]
    first = np.flatnonzero(cut)
    n = np.diff(np.r_[first, len(place)]).astype(np.int32)
    cols = [key[first], tag[first], place[first].astype(np.int32), n, k0[first], t0[first], p0[first].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["k", "t", "start", "n", "k0", "t0", "start0"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths from edges sorted by anchor; whole anchors are resolved as they end."""

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        col = lambda c: table[c].to_numpy()
        n, rows = col("n").astype(np.int64), np.arange(len(table))
        run_of = np.repeat(rows, n)
        if not len(run_of):
            return None
        within = np.arange(len(run_of)) - np.repeat(np.cumsum(n) - n, n)
        edge = table["edges"].combine_chunks().flatten().to_numpy()
        key, tag, place, anchor = col("k")[run_of], col("t")[run_of], col("start")[run_of] + within, col("anchor")[run_of]
        order = np.lexsort((place, tag, key, edge, anchor))
        new = np.r_[True, (edge[order][1:] != edge[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])]
        source = np.empty(len(order), np.int64)
        source[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        later = np.flatnonzero((key != key[source]) | (tag != tag[source]) | (place != place[source]))
        if not len(later):
            return None
        s = source[later]
        return _path_batch(key[later], tag[later], place[later], key[s], tag[s], place[s], run_of[later])

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        decided = table.filter(pc.greater(table["salt"], 0))
        if len(decided):
            yield from decided.select(["k", "t", "start", "n", "k0", "t0", "start0"]).to_batches()
        table = table.filter(pc.equal(table["salt"], 0))
        if not len(table):
            continue
        held = pa.concat_tables([held, table]) if held is not None else table
        anchors = held["anchor"].to_numpy()
        whole = int(np.searchsorted(anchors, anchors[-1]))
        if whole:
            if (out := solve(held.slice(0, whole))) is not None:
                yield out
            held = held.slice(whole)
    if held is not None and (out := solve(held)) is not None:
        yield out


def _span_digest(words: Words, row: int, start: int, n_words: int) -> bytes:
    keep = slice(start, start + n_words)
    return hashlib.blake2b(words.joined(np.arange(words.n[row])[keep], row), digest_size=16).digest()


def _digest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part["text"])
                rows, out = part.select(["k", "t", "spans"]).to_pylist(), []
                for i, row in enumerate(rows):
                    for span in row["spans"]:
                        out.append((row["k"], row["t"], span["start0"], span["n"], _span_digest(words, i, span["start0"], span["n"] + k - 1)))
                if out:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), types)], ["k0", "t0", "start0", "n", "digest"])

    return run


def _finish(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part["text"])
                removed, kept = [], []
                for i, paths in enumerate(part["paths"].to_pylist()):
                    keep = np.ones(words.n[i], bool)
                    for p in paths or ():
                        if _span_digest(words, i, p["start"], p["n"] + k - 1) != p["digest"]:
                            raise ValueError("two different spans share their edge hashes; change the seed of words.py")
                        keep[p["start"] : p["start"] + p["n"] + k - 1] = False
                    removed.append(int((~keep).sum()))
                    kept.append(words.joined(np.flatnonzero(keep), i))
                cols = [part["doc_id"], pa.array(words.n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def find_paths(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal nonbranching paths of repeated edges of keyed documents.

    One row per path: the copy's key and first window (k, t, start), the number n of
    windows, and the source's coordinate (k0, t0, start0).
    """
    if window < ANCHOR:
        raise ValueError(f"windows have at least {ANCHOR} words")
    plain = docs.select("k", "t", "text")
    anchors = plain.mapInArrow(_find_anchors(window), _ANCHORS)
    repeated = (
        anchors.withColumn("found", F.count("*").over(Window.partitionBy("anchor", "salt")))
        .filter("known or found > 1")
        .groupBy("k", "t").agg(F.collect_list("start").alias("starts"))
    )
    edges = plain.join(repeated, ["k", "t"]).select("k", "t", "text", "starts").mapInArrow(_find_edges(window), _EDGES)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = edges.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor").mapInArrow(_resolve, _PATHS)
    paths = paths.repartition("k", "t").distinct()
    along = Window.partitionBy("k", "t").orderBy("start")
    joins = (F.lag("k0").over(along) == F.col("k0")) & (F.lag("t0").over(along) == F.col("t0")) & (F.lag(F.col("start") + F.col("n")).over(along) == F.col("start")) & (F.lag(F.col("start0") + F.col("n")).over(along) == F.col("start0"))
    return (
        paths.withColumn("head", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
        .withColumn("path", F.sum("head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k", "t", "path")
        .agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("k0").alias("k0"), F.min("t0").alias("t0"), F.min("start0").alias("start0"))
        .drop("path")
    )


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space)."""
    docs = frames.keyed(docs)
    paths = find_paths(docs, window)
    spans = paths.select(F.col("k0").alias("k"), F.col("t0").alias("t"), "start0", "n").distinct()
    spans = spans.groupBy("k", "t").agg(F.collect_list(F.struct("start0", "n")).alias("spans"))
    digests = docs.select("k", "t", "text").join(spans, ["k", "t"]).select("k", "t", "text", "spans").mapInArrow(_digest(window), _DIGESTS)
    checked = paths.join(digests, ["k0", "t0", "start0", "n"], "left")
    per_doc = checked.groupBy("k", "t").agg(F.collect_list(F.struct("start", "n", F.coalesce("digest", F.lit(b"")).alias("digest"))).alias("paths"))
    joined = docs.select("k", "t", "text").join(per_doc, ["k", "t"], "left")
    doc_id = F.when(F.col("k") != frames.NO_ID, F.col("k")).alias("doc_id")
    return joined.select(doc_id, "text", "paths").mapInArrow(_finish(window), _RESULT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(frames.documents(spark, sf_dir)).drop("kept_text")


ORACLE = """
with words as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w from documents
), spans as (
  select doc_id, w, unnest(range(1, len(w) - 18)) s from words where len(w) >= 20
), windows as (
  select doc_id, s, array_to_string(w[s : s + 19], ' ') g from spans
), firsts as (
  select doc_id, s, first_value((doc_id, s)) over (partition by g order by doc_id, s) f from windows
), later as (
  select distinct doc_id, unnest(range(s, s + 20)) p from firsts where f <> (doc_id, s)
), gone as (
  select doc_id, list(p) p from later group by doc_id
), kept as (
  select words.doc_id, w, list_filter(w, lambda x, i: not list_contains(coalesce(p, []), i)) keep
  from words left join gone on words.doc_id = gone.doc_id
)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - len(keep) as bigint) n_removed,
  sha256(array_to_string(keep, ' ')) kept_sha256
from kept
"""
