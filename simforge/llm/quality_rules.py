"""Quality rules with risk-controlled thresholds.

Every document gets a few ratios (``RULES``).  For each stratum (language) and rule, a
ladder of cutoffs runs from one that rejects nothing to the strictest.  The rules of a
stratum share one budget: what is tested is the union of what they reject.

1. *Design*, without the good documents of the test: bad labelled documents against
   unlabelled ones.  Per stratum the rule and rung are taken that are expected to reject
   the most bad documents beyond good ones, then the same among the documents left, as
   long as the gain is beyond ``NOISE`` standard errors.  The ladders up to these rungs,
   one after the other, are the stratum's path.  Where fewer documents are unlabelled than
   labelled good, half of the good ones (by a hash of the id) serve the design instead and
   not the test.
2. *Test* on the good labelled documents: a place of the path that rejects k of n is safe
   if P(X <= k | n, alpha) <= the stratum's level.  The path is walked from its start and
   stops before the first place that is not safe (fixed-sequence testing, so the places of
   one path need no correction).  Strata start with delta / strata each; one whose path
   ends safely hands its level to those that are left, in equal shares (the graphical form
   of Holm's procedure).

With probability 1 - delta, every stratum keeps at least 1 - alpha of its good documents.
A stratum needs log(level) / log(1 - alpha) good labels for any cutoff: 299 with the whole
of delta, 436 with a quarter; one with fewer than 299 takes no part and gets none.
``cutoffs`` is the stricter form that tests every ladder alone, at alpha / rules and
delta / (rules x strata); it needs 2,993 good labels with four strata and isn't used here.

The holdout is all labelled documents that pass the base rules; what leaves the
workers are counts per (stratum, rule, cutoff), whose number does not grow with the
input.  The texts are read once and never shuffled.

Defined cases: a null or empty text has no words and fails the base rules; null strata
are one stratum of their own; a stratum without labels gets no cutoffs and keeps what
passes the base rules; labels with a null id or quality are left out, and of several
labels of an id the least quality counts; rows that repeat a doc_id are judged each by
its own text.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simforge.llm import frames
from simforge.llm.words import SPACE, Words, slices

#: False rejections allowed among the good documents of a stratum, and the risk of more.
ALPHA, DELTA = 0.01, 0.05
#: Rule -> the value by which a document is rejected when it is above the cutoff.
RULES = {
    "symbols": "__n_symbols / greatest(__n_words, 1)",
    "dup_lines": "__n_dup_lines / greatest(__n_lines, 1)",
    "repeats": "__n_repeat_words / greatest(__n_words, 1)",
    "long_words": "__word_chars / greatest(__n_words, 1) / 40",
    "short_words": "1 - __word_chars / greatest(__n_words, 1) / 40",
}
BASE_FAILED = "__n_words < 10 or 100 * __n_repeat_words > 20 * __n_words"
#: Standard errors by which a rule's expected gain must exceed nothing.
NOISE = 2
#: Cutoffs of each ladder, strictest last: 1, 1 - 1 / STEPS, ...
STEPS = 200

#: Strata with cutoffs, a few numbers each, up to which the cutoffs are broadcast.
FEW_STRATA = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_TEXT = "__text"
#: Bytes of text measured at once; a longer text is measured alone.
SLICE_BYTES = 1 << 20
_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _repeat_words(words: Words, hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Words of each row in k-word windows that the row has twice or more."""
    at, gram = words.grams(hashes, k)
    order = np.lexsort((gram, words.doc[at]))
    g, d = gram[order], words.doc[at][order]
    same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + k, -1)
    return np.bincount(words.doc[np.cumsum(change[:-1]) > 0], minlength=len(words.n))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, _TEXT, SLICE_BYTES):
            words = Words(part[_TEXT])
            hashes = words.hashes()
            row = np.repeat(np.arange(len(words.n)), np.diff(words.at))
            lead = (words.data & 0xC0) != 0x80
            per_row = lambda mask: np.bincount(row[mask], minlength=len(words.n))
            dup, lines = [], []
            for text in part[_TEXT].to_pylist():
                own = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
                lines.append(len(own))
                dup.append(len(own) - len(set(own)))
            cols = [words.n, per_row(lead & ~SPACE[words.data]), per_row(_SYMBOL[words.data]), dup, _repeat_words(words, hashes), lines]
            kept = [c for c in part.schema.names if c != _TEXT]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *(pa.array(np.asarray(x, np.int64)) for x in cols)], [*kept, *(f"__{c}" for c in _FEATURES)])


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and the counts of the text under names that begin with two underscores."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"__{c} long" for c in _FEATURES)])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias(_TEXT)).mapInArrow(_measure, schema)


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) for a, b in zip(n, k)])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials at p, summed in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = _log_choose(np.full(k + 1, n), i) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def _step(rule: str):
    """The first step of the ladder that rejects a document: cutoff 1 - step / STEPS lies below its value."""
    return F.greatest(F.lit(0), F.floor(F.lit(STEPS) * (1 - F.expr(rule))) + 1).cast("int")


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, step, cutoff, n_good, good_rejected, bad_rejected): the chosen cutoff of each ladder that has one."""
    truth = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    holdout = measured.filter(f"not ({BASE_FAILED})").select("doc_id", F.col(stratum).alias("stratum"), *(_step(e).alias(r) for r, e in RULES.items())).join(truth, "doc_id")
    rungs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES))).alias("x")
    counts = holdout.select("stratum", (F.col("quality") > 0).alias("good"), rungs).groupBy("stratum", "x.rule", "x.step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    ladder = Window.partitionBy("stratum", "rule")
    upto = ladder.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.select("stratum", "rule", "step", F.sum("good").over(ladder).alias("n_good"), F.sum("good").over(upto).alias("good_rejected"), F.sum("bad").over(upto).alias("bad_rejected"))
    share = alpha / len(RULES)

    def tails(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in groups:
            yield part.assign(tail=[binomial_tail(int(k), int(n), share) if k <= share * n else 1.0 for k, n in zip(part.good_rejected, part.n_good)])

    tested = steps.mapInPandas(tails, T.StructType([*steps.schema.fields, T.StructField("tail", T.DoubleType())]))
    risk = delta / (len(RULES) * max(1, counts.select("stratum").distinct().count()))
    gain = F.col("bad_rejected") - F.col("good_rejected")
    best = F.row_number().over(ladder.orderBy(F.desc("gain"), "step"))
    return (
        tested.withColumn("failed", F.sum((F.col("tail") > risk).cast("int")).over(upto)).withColumn("gain", gain)
        .filter(f"failed = 0 and gain > 0 and step <= {STEPS}").withColumn("best", best).filter("best = 1")
        .select("stratum", "rule", "step", (1 - F.col("step") / STEPS).alias("cutoff"), "n_good", "good_rejected", "bad_rejected")
    )


def _design(left: dict, sizes: dict[str, int]) -> tuple[float, str, int] | None:
    """(gain, rule, step) of the best ladder for a stratum; ``left`` has counts of each sort by (rule, step)."""
    best = None
    for rule in RULES:
        bad = other = 0
        for step in range(STEPS + 1):
            n = left.get((rule, step))
            if not n:
                continue
            bad, other = bad + n["bad"], other + n["other"]
            share = sizes["stands_for"] / max(1, sizes["other"])
            gain = bad - (share * other - (bad if sizes["mixed"] else 0))
            spread = math.sqrt((4 if sizes["mixed"] else 1) * bad + share * share * other)
            if bad and gain > NOISE * spread and (best is None or gain > best[0]):
                best = (gain, rule, step)
    return best


def walk(good: dict[int, int], n: int, level: float, alpha: float) -> int | None:
    """The first place of a path that isn't safe, None if all are; ``good`` counts the good documents that a place rejects first."""
    k = 0
    for place in sorted(good):
        k += good[place]
        if k > alpha * n or binomial_tail(k, n, alpha) > level:
            return place
    return None if binomial_tail(0, n, alpha) <= level else -1


def joint_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, step, cutoff) of the rules' last safe places, on one budget for each stratum."""
    truth = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    steps = measured.filter(f"not ({BASE_FAILED})").select("doc_id", F.col(stratum).alias("stratum"), *(_step(e).alias(r) for r, e in RULES.items()))
    sort = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") <= 0, "bad").when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, "good").otherwise("good2")
    held = frames.settled(steps.join(truth, "doc_id", "left").select("stratum", sort.alias("sort"), *RULES), "held")
    total: dict = {}
    for r in held.groupBy("stratum", "sort").count().collect():
        total.setdefault(r["stratum"], {})[r["sort"]] = r["count"]
    sizes, n_test, tested = {}, {}, {}
    for s, t in total.items():
        good, unlabelled = t.get("good", 0) + t.get("good2", 0), t.get("unlabelled", 0)
        mixed = unlabelled >= good
        other, stands_for = (unlabelled, good + t.get("bad", 0)) if mixed else (t.get("good2", 0), good)
        sizes[s] = {"mixed": mixed, "other": other, "stands_for": stands_for}
        n_test[s], tested[s] = (good, ("good", "good2")) if mixed else (t.get("good", 0), ("good",))
    open_ = {s for s in total if n_test[s] and binomial_tail(0, n_test[s], alpha) <= delta}
    paths: dict = {s: [] for s in open_}

    def rejected(s) -> F.Column:
        """Whether the ladders of a stratum's path reject a document of it."""
        found = F.lit(False)
        for rule, step in paths[s]:
            found = found | (F.col(rule) <= step)
        return F.col("stratum").eqNullSafe(F.lit(s)) & found

    growing = set(open_)
    rungs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES))).alias("x")
    while growing:
        gone, wanted = F.lit(False), F.lit(False)
        for s in growing:
            gone = gone | rejected(s)
            sorts = ["bad", "unlabelled" if sizes[s]["mixed"] else "good2"]
            wanted = wanted | (F.col("stratum").eqNullSafe(F.lit(s)) & F.col("sort").isin(sorts))
        counts = held.filter(wanted & ~gone).select("stratum", "sort", rungs).groupBy("stratum", "x.rule", "x.step").agg(F.count_if(F.col("sort") == "bad").alias("bad"), F.count_if(F.col("sort") != "bad").alias("other"))
        left: dict = {}
        for r in counts.collect():
            left.setdefault(r["stratum"], {})[r["rule"], r["step"]] = {"bad": r["bad"], "other": r["other"]}
        for s in list(growing):
            best = _design(left.get(s, {}), sizes[s])
            if best is None or best[1] in {rule for rule, _ in paths[s]}:
                growing.discard(s)
            else:
                paths[s].append(best[1:])
    open_ = {s for s in open_ if paths[s]}
    place, wanted = F.lit(None).cast("int"), F.lit(False)
    for s in open_:
        own = F.col("stratum").eqNullSafe(F.lit(s)) & F.col("sort").isin(list(tested[s]))
        first = F.least(*(F.when(F.col(r) <= step, F.col(r) + i * (STEPS + 1)) for i, (r, step) in enumerate(paths[s])), F.lit(None).cast("int"))
        place, wanted = F.when(own, first).otherwise(place), wanted | own
    good: dict = {s: {} for s in open_}
    if open_:
        for r in held.filter(wanted).groupBy("stratum", place.alias("place")).count().filter("place is not null").collect():
            good[r["stratum"]][r["place"]] = r["count"]
    level, ends, todo = {s: delta / len(open_) for s in open_}, {}, set(open_)
    while todo:
        done = {s for s in todo if walk(good[s], n_test[s], level[s], alpha) is None}
        if not done:
            break
        s = min(done, key=lambda x: (x is not None, x or ""))
        todo.discard(s)
        ends[s] = None
        for other in todo:
            level[other] += level[s] / len(todo)
    for s in todo:
        ends[s] = walk(good[s], n_test[s], level[s], alpha)
    rows = []
    for s, end in ends.items():
        for i, (rule, step) in enumerate(paths[s]):
            last = step if end is None else min(step, end - i * (STEPS + 1) - 1)
            if last >= 0:
                rows.append((s, rule, last, 1 - last / STEPS))
    kind = dict(measured.dtypes)[stratum]
    return measured.sparkSession.createDataFrame(rows, f"stratum {kind}, rule string, step int, cutoff double")


def decide(measured: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with __base_failed and __kept."""
    wide = chosen.groupBy(F.col("stratum").alias("__stratum")).agg(*(F.max(F.when(F.col("rule") == r, F.col("step"))).alias(f"__step_{r}") for r in RULES))
    if len(wide.select("__stratum").take(FEW_STRATA + 1)) <= FEW_STRATA:
        wide = F.broadcast(wide)  # else the join shuffles what was measured, texts included
    judged = measured.join(wide, F.col(f"`{stratum}`").eqNullSafe(F.col("__stratum")), "left")
    over = F.lit(False)
    for r, e in RULES.items():
        over = over | F.coalesce(_step(e) <= F.col(f"__step_{r}"), F.lit(False))
    failed = F.expr(BASE_FAILED)
    return judged.select(*(F.col(f"`{c}`") for c in measured.columns), failed.alias("__base_failed"), (~failed & ~over).alias("__kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = frames.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    measured = frames.settled(measure(docs, ["doc_id", "lang"]), "measured")
    judged = decide(measured, joint_cutoffs(measured, labels))
    return judged.select("doc_id", *(F.col(f"__{c}").alias(c) for c in [*_FEATURES[:5], "base_failed", "kept"]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    measured = frames.settled(measure(docs, ["doc_id", "lang"]), "measured")
    return decide(measure(docs, docs.columns), joint_cutoffs(measured, labels)).filter("__kept").select(*(F.col(f"`{c}`") for c in docs.columns))
