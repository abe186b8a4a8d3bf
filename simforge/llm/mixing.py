"""Mixing sources to target weights by entropy balancing.

Targets: source number i in code-point order (null last) has the weight
``WEIGHTS[i % 3]``; the sources share ``SHARE`` of all words in these proportions, but none
more than ``CAP`` times its own words, the excess going to the others by weight.

Rates: a document of s words gets r = CAP / (1 + exp(-z s / mean)) copies, the rate nearest
to even (CAP / 2) in bounded entropy under the token constraint of its source,
sum(s r) = target: an exponential tilt r / (CAP - r) = exp(z s / mean).  The multipliers z
solve the convex dual by Newton steps, kept inside a bracket.  Documents of one source
and size have one rate, so a step is an aggregate over the table of (source, size,
documents); sums are taken on integers and so don't depend on their order.  A source whose target
is its cap needs no tilt: every rate is ``CAP``.

Rounding: rates are summed along (source, size, doc_id), and each document gets the whole
numbers passed by its step, between 0 and ``CAP``.  As neighbours have like sizes, a
source's words then miss the target by at most about twice its longest document.  Where that is
more than ``SLACK`` of the target, the missing (or spare) words are settled: from the longest size that fits down, as
many documents of a size as fit the rest get one copy more (or less).  Each size used at
least halves the rest, so a source changes documents of few sizes, and it ends within the
shortest document that still has room.  Sums and places run over range partitions with
carried totals, so a source with a third of all documents is spread over many tasks.

Native: DataFrame operations alone.  Reruns agree: the rates are integers in units of
2 ** -24 and all sums are exact.

Defined cases: a null or empty text has no words, is taken once and adds none; without
words every target is 0; null sources are one source; rows that repeat an id count each;
an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simforge.llm import frames

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: A rate of one copy, in the integers that are summed.
ONE = 1 << 24
#: Share of its target by which a source may miss it, before documents leave their tilted rates.
SLACK = 0.001
#: Newton steps at most; the bracket of z.
STEPS, REACH = 80, 700.0
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(sid, source, source_size, documents, target, full) of (source, size, documents)."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"), F.sum("documents").alias("documents"))
    # one row for each source from here on
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    every = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    water = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "sid", "level"))).over(every)
    per = per.withColumn("water", water.getField("level"))
    full = F.col("water").isNull() | (F.col("water") * F.col("weight") >= F.col("limit"))
    return per.select("sid", "source", "source_size", "documents", F.when(full, F.col("limit")).otherwise(F.col("water") * F.col("weight")).alias("target"), full.alias("full"))


def _rate(z: Column, x: Column, cap: float) -> Column:
    return F.lit(float(cap)) / (1 + F.exp(-z * x))


def _exact(x: Column) -> Column:
    return F.sum(F.round(x * 1024).cast("decimal(38,0)")).cast("double") / 1024


def solve(sizes: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """``wanted`` with the multiplier z of each source."""
    mean = F.col("source_size") / F.col("documents")
    open_ = wanted.filter("not full and target > 0")
    counted = sizes.filter("size > 0").select(F.col("source").alias("__source"), "size", F.col("documents").alias("n"))
    own = counted.join(open_, counted["__source"].eqNullSafe(open_["source"])).select("sid", "size", "n", (F.col("size") / mean).alias("x"))
    own = frames.settled(own, "sizes")
    state = frames.settled(open_.select("sid", "target", F.lit(0.0).alias("z"), F.lit(-REACH).alias("low"), F.lit(REACH).alias("high")), "multipliers")
    r, words = _rate(F.col("z"), F.col("x"), cap), F.col("n") * F.col("size")
    gap, slope = F.col("got") - F.col("target"), F.col("slope")
    for _ in range(STEPS):
        sums = own.join(state.select("sid", "z"), "sid").groupBy("sid").agg(_exact(words * r).alias("got"), _exact(words * F.col("x") * r * (1 - r / cap)).alias("slope"))
        step = state.join(sums, "sid")
        step = step.withColumn("low", F.when(gap < 0, F.col("z")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("z")).otherwise(F.col("high")))
        newton = F.col("z") - gap / F.when(slope > 0, slope)
        inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
        step = step.withColumn("near", (F.abs(gap) <= 0.5 + 1e-9 * F.col("target")) | (F.col("high") - F.col("low") < 1e-12))
        step = step.withColumn("z", F.when(F.col("near"), F.col("z")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
        step = frames.settled(step, "multipliers")
        state = step.select("sid", "target", "z", "low", "high")
        if not step.filter("not near").limit(1).count():
            break
    return wanted.join(state.select("sid", "z"), "sid", "left")


def settle_words(rounded: DataFrame, cap: int = CAP) -> DataFrame:
    """``rounded`` (sid, size, target, copies, __part, doc_id) with copies changed by one where words are missing or spare.

    A source's list of sizes has at most one entry for each word of its longest document.
    """
    gaps = rounded.groupBy("sid").agg(F.first("target").alias("target"), F.round(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("gap"))
    gaps = gaps.filter(F.abs("gap") > SLACK * F.col("target")).select("sid", F.abs("gap").alias("rest"), F.signum("gap").cast("int").alias("__step"))
    marked = rounded.join(gaps, "sid", "left")
    room = (F.col("size") > 0) & (F.col("size") <= F.col("rest")) & (F.col("copies") + F.col("__step")).between(0, cap)
    free = marked.filter(room).groupBy("sid", "rest", "__step", "size", "__part").agg(F.count("*").alias("n"))
    free = frames.settled(free, "free")
    sizes = free.groupBy("sid", "rest", "__step", "size").agg(F.sum("n").alias("n")).groupBy("sid", "rest", "__step").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    fit = "least(x.n, s.rest div x.size)"
    filled = f"""aggregate(sizes, named_struct('rest', rest, 'used', cast(array() as array<struct<size:bigint,n:bigint>>)),
      (s, x) -> if({fit} > 0, named_struct('rest', s.rest - {fit} * x.size, 'used', concat(s.used, array(named_struct('size', x.size, 'n', {fit})))), s)).used"""
    used = sizes.select("sid", "__step", F.expr(f"inline({filled})")).withColumnRenamed("n", "__use")
    before = F.sum("n").over(Window.partitionBy("sid", "size").orderBy("__part")) - F.col("n")
    places = free.select("sid", "size", "__part", before.alias("__before")).join(used, ["sid", "size"]).filter("__before < __use")
    places = frames.settled(places, "places")
    # the few (source, size, part) with changes; all other rows pass as they are
    key, able = ["sid", "size", "__part"], (F.col("copies") + F.col("__step")).between(0, cap)
    met = rounded.join(places, key).withColumn("__able", able)
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*key, "__able").orderBy("doc_id", "copies"))
    step = F.when(F.col("__able") & (place <= F.col("__use")), F.col("__step")).otherwise(0)
    changed = met.withColumn("copies", F.col("copies") + step).select(*rounded.columns)
    return rounded.join(places, key, "left_anti").select(*rounded.columns).unionAll(changed)


def mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``rows`` (with source, size and an orderable doc_id) with source_size, target and copies."""
    sizes = frames.settled(rows.groupBy("source", "size").agg(F.count("*").alias("documents")), "sizes")
    solved = frames.settled(solve(sizes, frames.settled(targets(sizes, weights, share, cap), "targets"), cap), "rates")
    state = solved.select("sid", F.col("source").alias("__source"), "source_size", "target", "full", "z", (F.col("source_size") / F.col("documents")).alias("__mean"))
    given = rows.join(state, rows["source"].eqNullSafe(state["__source"]))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(_rate(F.col("z"), F.col("size") / F.col("__mean"), cap))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = given.withColumn("__rate", F.round(rate * ONE).cast("long")).repartitionByRange(parts, "sid", "size", "doc_id").withColumn("__part", F.spark_partition_id())
    ranged = frames.settled(ranged.drop("__source", "__mean", "full", "z"), "ranged")
    carried = ranged.groupBy("sid", "__part").agg(F.sum("__rate").alias("sum"))
    carried = carried.select("sid", "__part", (F.sum("sum").over(Window.partitionBy("sid").orderBy("__part")) - F.col("sum")).alias("__before"))
    along = F.sum("__rate").over(Window.partitionBy("sid", "__part").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn("__sum", along).join(carried, ["sid", "__part"])
    upto = F.col("__before") + F.col("__sum") + ONE // 2
    passed = lambda x: F.shiftright(x, ONE.bit_length() - 1)
    rounded = summed.withColumn("copies", (passed(upto) - passed(upto - F.col("__rate"))).cast("long")).drop("__rate", "__before", "__sum")
    return settle_words(frames.settled(rounded, "rounded"), cap).drop("sid", "__part")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.settled(sized(frames.documents(spark, sf_dir)).select("doc_id", "source", "size"), "sized")
    return mix(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns."""
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    tag = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    marked = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(frames.NO_ID)), "__t": tag})
    same = F.row_number().over(Window.partitionBy("__k", "__t").orderBy("source")) if repeated else F.lit(1)
    marked = marked.withColumn("__i", same)
    rows = frames.settled(sized(marked).select(F.struct("__k", "__t", "__i").alias("doc_id"), "source", "size"), "sized")
    copies = mix(rows).filter("copies > 0").select("doc_id.*", F.col("copies").alias("__copies"))
    taken = marked.join(copies, ["__k", "__t", "__i"])
    each = F.explode(F.sequence(F.lit(1), F.col("__copies")))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns), each.alias("__copy")).drop("__copy")
