"""N-gram Jaccard join that skips by relations between sets.

A document's set holds the hashes of its distinct ``k``-word shingles.  Equal sets are
one class, named by a fingerprint, and take part once.

1. Tokens are ordered by how often they occur, rarest first, as a fixed-size table of
   counters sees it (every document is counted; a shared counter only worsens the order,
   which any order may be).  Two linked sets share tokens of their prefixes.
2. The prefixes form an inverted index: (token, set, size, position).  Lists with one set
   are dropped.
3. Answers of one set serve its neighbours: in every list the sets are first compared
   with a single hub.  Sets found to be linked through hubs have their component already,
   so no pair of them is looked at again.
4. Only lists with sets of several components are then searched for the other pairs.  A
   list is sorted by position, long ones are kept in blocks of equal position and sorted
   by size; a block whose sizes cannot meet is skipped as a whole, and so is a pair whose
   positions leave too little room for the required overlap.
5. A pair must be met in as many lists as its sizes demand: members beyond the prefixes
   add at most the longer rest, so the prefixes have to share what is missing.
6. Candidates that sketches don't keep apart are verified on their whole sets.  Only texts
   that a fixed-size bitmap of the wanted documents lets through are read into sets, and
   joined exactly after it.  A hub's set travels once for every ``HUB_PAIRS`` of its pairs,
   the others stream past it.  Of the pairs of step 4, one of each set goes first; those
   whose sets are in one component by then are left out.

Links of whole classes are found by connected components over verified pairs.

Defined cases: texts without words have an empty set and link with nothing; documents
with fewer than ``k`` words have their whole sequence as one shingle; null ids never
name a component that has another id; rows that repeat an id are compared each by its
own text.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simforge.llm import frames
from simforge.llm.components import components, thinned
from simforge.llm.words import Words, mix, slices

K, PERCENT = 4, 85
#: Counters of the frequency table: a power of two near the number of documents, within these.
COUNTERS = (1 << 16, 1 << 20)
#: Bits of the bitmap of wanted documents; it lets others through when it is full.
WANTED_BITS = 1 << 23
_COUNTER_BLOCK = 4096
#: Pairs for which a hub's set is sent once.
HUB_PAIRS = 1000
#: Longer lists are searched block by block.
LONG_LIST, PAIRS_AT_ONCE = 256, 1 << 21

#: Bits of a set's sketch: for each bit whether an odd number of members hash to it.
SKETCH_BITS = 1024
#: Members of a list from which on their sketches travel with it.
SKETCHED = 64

_SETS = "k long, t long, doc_id long, n_shingles long, fp long, sketch binary, block int, counts binary"
_POSTINGS = "token long, fp long, n int, pos int"


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted by both, and their number in each row."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    at, gram = words.grams(hashes, k)
    rows, values = [words.doc[at]], [gram]
    for short in range(1, k):
        at, gram = words.grams(hashes, short)
        own = words.n[words.doc[at]] == short
        rows.append(words.doc[at][own])
        values.append(mix(gram[own] + np.uint64(short)))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])][: len(row)]
    row, value = row[new], value[new]
    return row, value, np.bincount(row, minlength=len(words.n))


def _fingerprints(row: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each row's set; a commutative sum over scrambled members, with the size."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    out = np.zeros(len(n), np.uint64)
    if len(first):
        out[row[first]] = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A55A5A5A5A)), first)
    return mix(out + n.astype(np.uint64)).view(np.int64)


def _sketches(row: np.ndarray, value: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parities of each row's set.  A member that only one of two sets has changes one bit, so sketches
    differ in no more bits than the sets in members."""
    bit = (mix(value ^ np.uint64(0x3C3C3C3CC3C3C3C3)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(row * SKETCH_BITS + bit, minlength=len(n) * SKETCH_BITS).reshape(len(n), SKETCH_BITS) & 1
    return [x.tobytes() for x in np.packbits(odd.astype(bool), axis=1)]


def _slot(value: np.ndarray, counters: int) -> np.ndarray:
    return (value >> np.uint64(64 - int(counters).bit_length() + 1)).astype(np.int64)


def _find_sets(k: int, counters: int):
    names = ["k", "t", "doc_id", "n_shingles", "fp", "sketch", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(counters, np.int64)
        for batch in batches:
            for part in slices(batch):
                row, value, n = shingles(part["text"], k)
                table += np.bincount(_slot(value, counters), minlength=counters)
                fp = pa.array(_fingerprints(row, value, n), mask=n == 0)
                none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
                sketch = pa.array(_sketches(row, value, n), pa.binary())
                yield pa.RecordBatch.from_arrays([part["k"], part["t"], part["doc_id"], pa.array(n.astype(np.int64)), fp, sketch, *none], names)
        blocks = [(i, x.astype(np.min_scalar_type(x.max())).tobytes()) for i, x in enumerate(table.reshape(-1, _COUNTER_BLOCK)) if x.any()]
        if blocks:
            none = [*[pa.nulls(len(blocks), pa.int64())] * 5, pa.nulls(len(blocks), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([x[0] for x in blocks], pa.int32()), pa.array([x[1] for x in blocks], pa.binary())], names)

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"].to_pylist(), batch["counts"].to_pylist()):
            total.setdefault(block, np.zeros(_COUNTER_BLOCK, np.int64))[:] += np.frombuffer(counts, f"u{len(counts) // _COUNTER_BLOCK}").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _find_postings(k: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            for part in slices(batch):
                row, value, n = shingles(part["text"], k)
                fp = _fingerprints(row, value, n)
                once = np.zeros(len(n), bool)  # equal sets of a slice are posted once
                once[np.unique(fp, return_index=True)[1]] = True
                own = once[row]
                row, value = row[own], value[own]
                order = np.lexsort((value, table[_slot(value, len(table))], row))
                row, value = row[order], value[order]
                begin = np.searchsorted(row, np.arange(len(n)))
                pos = np.arange(len(row)) - begin[row]
                use = pos < prefix_length(n, percent)[row]
                row, value, pos = row[use], value[use], pos[use]
                cols = [value.view(np.int64), fp[row], n[row].astype(np.int32), pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["token", "fp", "n", "pos"])

    return run


def needed(n1, n2, percent: int):
    """The least common members of linked sets of these sizes."""
    return (percent * (n1 + n2) + 99 + percent) // (100 + percent)


def _reaches(percent: int) -> str:
    """SQL: a set of size n with the token at pos can reach a hub."""
    need = f"(({percent} * (n + hub.n) + {99 + percent}) div {100 + percent})"
    return f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n) and least(pos, hub.pos) + least(n - pos, hub.n - hub.pos) >= {need}"


def missing(n1, n2, percent: int):
    """The least common members of the prefixes of linked sets of these sizes."""
    rest = np.maximum(n1 - prefix_length(n1, percent), n2 - prefix_length(n2, percent))
    return np.maximum(1, needed(n1, n2, percent) - rest)


def _missing_sql(percent: int) -> str:
    rest = f"(({percent} * greatest(n, hub.n) + 99) div 100 - 1)"
    return f"greatest(1, ({percent} * (n + hub.n) + {99 + percent}) div {100 + percent} - {rest})"


def _fitting(x, y, n, pos, comp, percent: int) -> np.ndarray:
    """Pairs (x, y) of list entries of different components that can reach the overlap."""
    n1, n2 = n[x], n[y]
    reach = np.minimum(pos[x], pos[y]) + np.minimum(n1 - pos[x], n2 - pos[y])
    return (comp[x] != comp[y]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (reach >= needed(n1, n2, percent))


def _short_lists(begin, size, n, pos, comp, percent: int):
    """All pairs of many short lists at once."""
    done = 0
    cost = np.cumsum(size * (size - 1) // 2)
    while done < len(size):
        stop = max(done + 1, int(np.searchsorted(cost, (cost[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
        k = size[done:stop]
        rows = np.repeat(begin[done:stop] - np.cumsum(k) + k, k) + np.arange(k.sum())
        after = np.repeat(begin[done:stop] + k - 1, k) - rows
        x = np.repeat(rows, after)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)
        fits = _fitting(x, y, n, pos, comp, percent)
        if fits.any():
            yield x[fits], y[fits]
        done = stop


def _long_list(begin: int, end: int, n, pos, comp, percent: int):
    """Pairs of one list, block of equal position by block."""
    order = begin + np.lexsort((n[begin:end], pos[begin:end]))
    heads = np.flatnonzero(np.r_[True, np.diff(pos[order]) != 0, True])
    blocks = [order[a:b] for a, b in zip(heads[:-1], heads[1:])]
    for i, own in enumerate(blocks):
        for other in blocks[i:]:
            if 100 * n[own[-1]] < percent * n[other[0]] or 100 * n[other[-1]] < percent * n[own[0]]:
                continue
            low = np.searchsorted(n[other], -(-percent * n[own] // 100))
            high = np.searchsorted(n[other], 100 * n[own] // percent, "right")
            for a in range(0, len(own), 1024):
                count = np.maximum(high[a : a + 1024] - low[a : a + 1024], 0)
                x = np.repeat(own[a : a + 1024], count)
                at = np.repeat(low[a : a + 1024] - np.cumsum(count) + count, count) + np.arange(count.sum())
                y = other[at]
                fits = _fitting(x, y, n, pos, comp, percent)
                if other is own:
                    fits &= np.repeat(np.arange(a, min(a + 1024, len(own))), count) < at
                if fits.any():
                    yield x[fits], y[fits]


def _alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sketches don't show that they differ in too many members to be linked."""
    out = np.zeros(len(x), bool)
    for a in range(0, len(x), 1 << 15):
        i, j = x[a : a + (1 << 15)], y[a : a + (1 << 15)]
        apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
        out[a : a + (1 << 15)] = apart <= n[i] + n[j] - 2 * needed(n[i], n[j], percent)
    return out


def _search_lists(percent: int):
    """Candidate pairs (a, b) of different components, and how many lists they have to be in.

    Sets of a large group that are near one another, but not near enough, would meet in all
    their lists; their sketches keep them apart here."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, fp, n, pos, comp = (table[c].to_numpy().astype(np.int64) for c in ("token", "fp", "n", "pos", "comp"))
        none = bytes(SKETCH_BITS // 8)
        own = table["sketch"].to_pylist() if "sketch" in table.column_names else [None] * len(token)
        sketch = np.frombuffer(b"".join(x or none for x in own), np.uint64).reshape(len(token), -1)
        cuts = np.r_[0, np.flatnonzero(token[1:] != token[:-1]) + 1, len(token)]
        begin, size = cuts[:-1], np.diff(cuts)
        short = size <= LONG_LIST
        found = [_short_lists(begin[short], size[short], n, pos, comp, percent)]
        found += [_long_list(a, a + k, n, pos, comp, percent) for a, k in zip(begin[~short], size[~short])]
        for pairs in found:
            for x, y in pairs:
                close = _alike(x, y, n, sketch, percent)
                x, y = x[close], y[close]
                cols = [np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y]), missing(n[x], n[y], percent)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            tokens = held["token"].to_numpy()
            whole = int(np.searchsorted(tokens, tokens[-1])) if len(tokens) else 0
            if whole:
                yield from solve(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield from solve(held)

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the bitmap from slots dealt by block."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        slot = batch["slot"].to_numpy()
        for block in np.unique(slot // _COUNTER_BLOCK):
            own = total.setdefault(int(block), np.zeros(_COUNTER_BLOCK, bool))
            own[slot[slot // _COUNTER_BLOCK == block] % _COUNTER_BLOCK] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(x).tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def _sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(fp, members) of the sets that the candidate pairs name.  A few others may be among them, which no pair asks for."""
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    named = classes.filter("fp is not null").join(wanted, "fp").groupBy("fp").agg(F.min(F.struct("k", "t")).alias("rep"))
    named = frames.settled(named.select("fp", "rep.k", "rep.t"), "wanted")
    slot = F.pmod(F.xxhash64("k", "t"), F.lit(WANTED_BITS))
    marks = named.select(slot.alias("slot")).repartition(F.floor(F.col("slot") / _COUNTER_BLOCK)).mapInArrow(_mark, "block int, counts binary")
    bits = np.zeros((WANTED_BITS // _COUNTER_BLOCK, _COUNTER_BLOCK // 8), np.uint8)
    for r in marks.toLocalIterator():  # fixed size
        bits[r["block"]] |= np.frombuffer(r["counts"], np.uint8)
    bitmap = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bits.reshape(-1)).astype(bool))
    return frames.settled(docs.select("text", slot.alias("slot")).mapInArrow(_make_sets(k, bitmap), "fp long, members binary"), "members")


def _make_sets(k: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(pa.array(bitmap.value[batch["slot"].to_numpy()]))):
                row, value, n = shingles(part["text"], k)
                ends = np.cumsum(n)
                members = [value[e - m : e].tobytes() for e, m in zip(ends, n)]
                yield pa.RecordBatch.from_arrays([pa.array(_fingerprints(row, value, n)), pa.array(members, pa.binary())], ["fp", "members"])

    return run


def _compare(percent: int):
    """Linked pairs from rows sorted by (hub, salt, kind): a hub's set, then those compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, None
        for batch in batches:
            a, b = [], []
            for hub, salt, kind, fp, members in zip(*(batch[c].to_pylist() for c in ("hub", "salt", "kind", "fp", "members"))):
                members = np.frombuffer(members, np.uint64)
                if kind == 0:
                    key, mine = (hub, salt), members
                    continue
                if key != (hub, salt):
                    raise ValueError("a set to compare with is missing")
                at = np.searchsorted(mine, members)
                common = int((mine[np.minimum(at, len(mine) - 1)] == members).sum())
                if 100 * common >= percent * (len(mine) + len(members) - common):
                    a.append(hub)
                    b.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the candidate pairs (a, b)."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("salts"))
    dealt = pairs.join(salts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("fp"))
    hubs = salts.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("fp"))
    rows = dealt.unionByName(hubs).join(sets, "fp")
    return rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "kind").select("hub", "salt", "kind", "fp", "members").mapInArrow(_compare(percent), "a long, b long")


def _often(met: DataFrame) -> DataFrame:
    """The pairs (a, b) that are met in as many lists as they have to be."""
    return met.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("least").alias("least")).filter("met >= least").select("a", "b")


def _drop_apart(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = (batch[c].to_numpy() for c in ("n_a", "n_b"))
            size = len(n1)
            sketch = np.frombuffer(b"".join(batch["sketch_a"].to_pylist() + batch["sketch_b"].to_pylist()), np.uint64).reshape(2 * size, -1)
            close = _alike(np.arange(size), size + np.arange(size), np.r_[n1, n2], sketch, percent)
            yield batch.select(["a", "b"]).filter(pa.array(close))

    return run


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sketches don't show to be apart, so that the sets of the others needn't travel."""
    for c in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("fp").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
    return pairs.mapInArrow(_drop_apart(percent), "a long, b long")


def _component_links(rest: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Component edges (a, b): those of ``labels`` and those that the candidate pairs add.

    One pair of each set goes first; pairs whose sets then are in one component need no comparing, so a large
    group of sets that link with one another in very many ways is not compared pair by pair."""
    ties = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    first = frames.settled(rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = frames.settled(_verify(first, sets, percent), "links")
    ties = ties.unionByName(thinned(links))
    labels = frames.settled(components(ties), "labels")
    left = rest.join(first, ["a", "b"], "left_anti")
    for c in ("a", "b"):
        left = left.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")), c, "left")
    left = left.filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    more = frames.settled(_verify(frames.settled(left, "pairs"), sets, percent), "links")
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(thinned(more))


def link(docs: DataFrame, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes, labels) of keyed documents: (k, t, doc_id, n_shingles, fp) of each row, and the
    component (fp, label) of each class that has a link to another one."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counters = min(COUNTERS[1], max(COUNTERS[0], 1 << docs.count().bit_length()))
    found = frames.settled(docs.mapInArrow(_find_sets(k, counters), _SETS), "sets")
    classes = found.filter("block is null").drop("block", "counts")
    table = np.zeros(counters, np.int64)
    added = found.filter("block is not null").select("block", "counts").repartition("block").mapInArrow(_add_counts, "block int, counts binary")
    for r in added.toLocalIterator():  # fixed size
        table[r["block"] * _COUNTER_BLOCK : (r["block"] + 1) * _COUNTER_BLOCK] = np.frombuffer(r["counts"], np.int64)
    counts = spark.sparkContext.broadcast(table)

    own = Window.partitionBy("token")
    postings = docs.select("text").mapInArrow(_find_postings(k, percent, counts), _POSTINGS)
    # the hub's columns one by one: a struct of them would be made before the shuffle and travel with every row
    least = [F.min("fp").over(own).alias("low"), F.min_by("n", "fp").over(own).alias("low_n"), F.min_by("pos", "fp").over(own).alias("low_pos")]
    shared = postings.select("*", *least, F.max("fp").over(own).alias("high")).filter("low <> high")
    hub = F.struct(F.col("low").alias("fp"), F.col("low_n").alias("n"), F.col("low_pos").alias("pos")).alias("hub")
    shared = frames.settled(shared.select("token", "fp", "n", "pos", hub).distinct(), "postings")

    sketches = classes.filter("fp is not null").groupBy("fp").agg(F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    sketches = frames.settled(sketches, "sketches")
    near = shared.filter("fp <> hub.fp").filter(_reaches(percent))
    near = _often(near.select(F.col("hub.fp").alias("a"), F.col("fp").alias("b"), F.expr(_missing_sql(percent)).cast("long").alias("least")))
    near = frames.settled(near, "pairs")
    close = frames.settled(_close(near, sketches, percent), "pairs")
    first = frames.settled(_verify(close, _sets_of(docs, classes, close, k), percent), "links")
    labels = frames.settled(components(thinned(first)), "labels")

    comp = shared.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("token", "fp", "n", "pos", F.coalesce("label", "fp").alias("comp"))
    comp = comp.repartition(parts, "token")  # the windows and the search of short lists keep this dealing
    comp = comp.select("*", F.min("comp").over(own).alias("low"), F.max("comp").over(own).alias("high"), F.count("*").over(own).alias("size")).filter("low <> high")
    entry, met = ["token", "fp", "n", "pos", "comp"], "a long, b long, least long"
    short = comp.filter(F.col("size") <= SKETCHED).select(*entry)
    long = comp.filter(F.col("size") > SKETCHED).select(*entry).join(sketches.select("fp", "sketch"), "fp").select(*entry, "sketch").repartition(parts, "token")
    rest = _often(short.sortWithinPartitions("token").mapInArrow(_search_lists(percent), met).unionByName(long.sortWithinPartitions("token").mapInArrow(_search_lists(percent), met)))
    rest = frames.settled(rest.join(near, ["a", "b"], "left_anti"), "pairs")
    rest = frames.settled(_close(rest, sketches, percent), "pairs")
    labels = components(_component_links(rest, _sets_of(docs, classes, rest, k), labels, percent))
    return classes, labels.select(F.col("node").alias("fp"), "label")


def near_groups(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(k, t, doc_id, n_shingles, component_id, first_k, first_t) of each row; the last two name
    the first document of its component."""
    classes, labels = link(frames.keyed(docs), k, percent)
    labelled = classes.join(labels, "fp", "left").withColumn("class", F.coalesce("label", "fp"))
    least = labelled.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.min(F.struct("k", "t")).alias("first"))
    return labelled.join(least, "class", "left").select(
        "k", "t", "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("first.k", "k").alias("first_k"), F.coalesce("first.t", "t").alias("first_t"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns."""
    groups = near_groups(docs)
    firsts = groups.filter("k = first_k and t = first_t").select("k", "t").distinct()
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(frames.NO_ID))
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    marked = docs.withColumns({"__k": k, "__t": F.xxhash64("text") if repeated else F.lit(0).cast("long")})
    kept = marked.join(firsts.select(F.col("k").alias("__k"), F.col("t").alias("__t")), ["__k", "__t"])
    if repeated:
        kept = kept.dropDuplicates(["__k", "__t"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(frames.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) end s from words
), grams as (
  select doc_id, len(s) n, unnest(s) g from sets
), links as (
  select a.doc_id x, b.doc_id y from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach as (
  select doc_id x, doc_id y from sets union select reach.x, links.y from reach join links on links.x = reach.y
)
select sets.doc_id, cast(len(s) as bigint) n_shingles, (select min(y) from reach where reach.x = sets.doc_id) component_id from sets
"""
