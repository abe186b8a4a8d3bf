"""Line dedup by a suffix array over line ids.

The suffixes of all documents, read as sequences of line ids, are sorted by prefix
doubling: a suffix's rank for 2 L lines comes from the pair of its rank for L lines and
that of the suffix L lines later.  A rank is (id of the first line, place in that line's
bucket), which orders suffixes without numbering all of them in one place.  A suffix
whose prefix no other suffix shares is settled and leaves; doubling goes on until no ties
are left.  Suffixes tied at depth L are an interval of the suffix array whose longest
common prefix has L lines at least; the first of them in text order stays, each other
one is a later copy of L lines.  A suffix's greatest such L and those of the suffixes
behind it overlap to the maximal repeated runs (``repeated_runs``), and every line of
a later one is deleted.

A run counts from ``min_lines`` lines or ``min_words`` words, whichever is shorter, so that a
passage kept in one or two long lines is found as well.  Depths between two doublings up
to ``min_lines`` are ranked too, by the two overlapping parts of a prefix, for the
suffixes that make a run there.

Native: DataFrame operations alone.  Line ids are 64-bit hashes, taken as equal where a
run's ids and its lines' word counts agree.  Pairs are counted before they are ranked, so a line
in a third of all documents costs its distinct repeated continuations, not its rows.

Defined cases: lines are what \\n separates; lines without a word take no part and stay;
a null text has no lines and stays null; a null doc_id sorts before all others; rows
equal in doc_id and text are one document and lose the same lines; rows equal in doc_id
alone are different documents, in order of their texts' hashes; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simforge.llm import frames

MIN_LINES, MIN_WORDS = 3, 50
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def _lines(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(k, t, ord, h, w, need): the id of each line with a word, ranked by itself, and how
    many lines from it on make a run."""
    words = f"transform(split(text, '\\n', -1), x -> named_struct('h', xxhash64(x, regexp_count(x, '{WORD}')), 'c', regexp_count(x, '{WORD}')))"
    counted = docs.select("k", "t", F.expr(f"filter({words}, x -> x.c > 0)").alias("lines"))
    sums = [" + ".join(f"get(lines, i + {j}).c" for j in range(d)) for d in range(1, min_lines)]
    need = " ".join(f"when {x} >= {min_words} then {d}" for d, x in enumerate(sums, 1))
    need = f"case {need} else {min_lines} end" if need else f"{min_lines}"
    suffixes = F.posexplode(F.expr(f"transform(lines, (x, i) -> named_struct('h', x.h, 'need', {need}))"))
    out = counted.select("k", "t", suffixes.alias("ord", "line"))
    return out.select("k", "t", "ord", "line.h", F.lit(0).cast("long").alias("w"), "line.need").distinct()


_PLACE = ("k", "t", "ord")
_KEPT = (*_PLACE, "h", "w", "need", "copy")


def _copy(first: Column) -> Column:
    """Whether a suffix isn't the first of its interval."""
    return (F.struct(*_PLACE) != first).alias("copy")


def _shared(suffixes: DataFrame) -> DataFrame:
    """Suffixes whose first line is found again."""
    found = suffixes.groupBy("h").agg(F.count("*").alias("count"), F.min(F.struct(*_PLACE)).alias("first")).filter("count > 1")
    return suffixes.join(found, "h").withColumn("copy", _copy(F.col("first"))).select(*_KEPT)


def _extend(suffixes: DataFrame, shift: int, lines: int | None = None) -> DataFrame:
    """Ranks for ``shift`` more lines, of the suffixes (that make a run of ``lines``) that still have an equal."""
    later = suffixes.select("k", "t", (F.col("ord") - shift).alias("ord"), F.col("h").alias("h2"), F.col("w").alias("w2"))
    pairs = (suffixes if lines is None else suffixes.filter(F.col("need") <= lines)).drop("copy").join(later, list(_PLACE))
    key = ["h", "w", "h2", "w2"]
    ties = pairs.groupBy(*key).agg(F.count("*").alias("count"), F.min(F.struct(*_PLACE)).alias("first")).filter("count > 1")
    smaller = Window.partitionBy("h", "w").orderBy("h2", "w2").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ties.select(*key, "first", (F.col("w") + F.coalesce(F.sum("count").over(smaller), F.lit(0))).alias("rank"))
    return pairs.join(ranks, key).withColumn("copy", _copy(F.col("first"))).withColumn("w", F.col("rank")).select(*_KEPT)


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, t, ord, n): from line ord on, n lines of a keyed document are a later copy; n is the
    depth of the deepest interval that the suffix isn't first of."""
    suffixes = frames.settled(_shared(_lines(docs, min_lines, min_words)), "suffixes")
    found, depth = [], 1
    while suffixes.limit(1).count():
        found.append(suffixes.filter(F.col("copy") & (F.col("need") <= depth)).select(*_PLACE, F.lit(depth).alias("n")))
        for d in range(depth + 1, min(2 * depth - 1, min_lines) + 1):
            between = _extend(suffixes, d - depth, d)
            found.append(frames.settled(between.filter("copy").select(*_PLACE, F.lit(d).alias("n")), "between"))
        suffixes = frames.settled(_extend(suffixes, depth), "suffixes")
        depth *= 2
    none = docs.select("k", "t", F.lit(0).alias("ord"), F.lit(0).alias("n")).limit(0)
    for part in found:
        none = none.unionAll(part)
    return none.groupBy(*_PLACE).agg(F.max("n").alias("n"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, t, start, n): the maximal runs of lines of keyed documents that later copies cover."""
    along = Window.partitionBy("k", "t").orderBy("ord")
    before = F.max(F.col("ord") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = later_copies(docs, min_lines, min_words).withColumn("head", F.when(F.col("ord") <= before, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("k", "t", "run").agg(F.min("ord").alias("start"), F.max(F.col("ord") + F.col("n")).alias("end"))
    return runs.select("k", "t", "start", (F.col("end") - F.col("start")).alias("n"))


def _has_word(line: str) -> str:
    return f"{line} rlike '{WORD}'"


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Keyed documents with n_lines, n_removed and kept_text; other columns pass through."""
    runs = repeated_runs(docs.select("k", "t", "text"), min_lines, min_words)
    gone = frames.settled(runs.groupBy("k", "t").agg(F.collect_list(F.struct("start", "n")).alias("__runs")), "gone")
    gone = frames.small(gone, 64 + 16 * F.size("__runs"))  # else all texts are shuffled to meet the few that change
    joined = docs.join(gone, ["k", "t"], "left").withColumn("__gone", F.expr("flatten(transform(__runs, r -> sequence(r.start, r.start + r.n - 1)))"))
    joined = joined.withColumn("__lines", F.expr("case when __gone is not null then split(text, '\\n', -1) end"))
    joined = joined.withColumn("__places", F.expr(f"filter(sequence(0, size(__lines) - 1), i -> {_has_word('__lines[i]')})"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(__lines) - 1), transform(__gone, o -> __places[o])), i -> __lines[i]), '\\n')")
    counted = F.expr(f"size(filter(split(coalesce(text, ''), '\\n', -1), x -> {_has_word('x')}))").cast("long")
    return joined.withColumns({
        "n_lines": counted,
        "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept),
    }).drop("__runs", "__gone", "__lines", "__places")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(frames.keyed(frames.documents(spark, sf_dir)))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def drop_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of line runs; those left without a word go."""
    names = docs.columns
    plain = frames.keyed(docs)
    found = dedup_lines(plain, min_lines, min_words).filter("n_removed > 0").select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("kept_text").alias("__kept")).distinct()
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    marked = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(frames.NO_ID)), "__t": F.xxhash64("text") if repeated else F.lit(0).cast("long")})
    text = F.coalesce("__kept", "text")
    out = marked.join(found, ["__k", "__t"], "left").withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.filter(F.col("__kept").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*(F.col(f"`{c}`") for c in names))


ORACLE = """
with lines as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents
), words as (
  select doc_id, list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) w,
    list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^\\x20\\x09-\\x0D]')) places, l
  from lines
), counts as (
  select doc_id, w, list_transform(w, lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))) c from words
), starts as (
  select doc_id, w, c, unnest(range(1, len(w) + 1)) o from counts
), needs as (
  select doc_id, w, o, unnest(range(case when c[o] >= 50 then 1 when c[o] + c[o + 1] >= 50 then 2 else 3 end, 4)) m from starts
), runs as (
  select doc_id, o, m, array_to_string(w[o : o + m - 1], chr(10)) g from needs where o + m - 1 <= len(w)
), later as (
  select doc_id, o, m from (select doc_id, o, m, first_value((doc_id, o)) over (partition by g order by doc_id, o) f from runs)
  where f <> (doc_id, o)
), gone as (
  select words.doc_id, list(distinct places[x.o]) p
  from (select distinct doc_id, unnest(range(o, o + m)) o from later) x join words on words.doc_id = x.doc_id
  group by words.doc_id
)
select words.doc_id, cast(len(w) as bigint) n_lines, cast(coalesce(len(p), 0) as bigint) n_removed,
  sha256(array_to_string(list_filter(l, lambda x, i: not list_contains(coalesce(p, []), i)), chr(10))) kept_sha256
from words left join gone on words.doc_id = gone.doc_id
"""
