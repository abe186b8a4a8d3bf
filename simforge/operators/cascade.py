"""Three-layer decision cascades.

Plan shape
----------
* The pair table is reduced to its distinct ``(name1, name2)`` keys (null ->
  ""), with map-side partial aggregation, so a pair repeated across a third of
  all rows is scored once; results are joined back on the keys (AQE splits a
  skewed key on the large side).
* What depends on one name alone comes from a dictionary of the distinct
  names (see ``names``); a model's vectors and the similarities of phonetic
  codes are computed once a name and once a pair of codes.
* Pairs that layer 1 decides leave there: the rest goes on to layers 2 and 3,
  where names are nulled for what layer 2 decides, so the kernel of layer 3
  (one Arrow round trip a layer) does no work for them.
  ``Second_*``/``Third_*`` columns are null when the layer was not reached.
* Streams have no dictionary: there the layers are successive projections.
* Per-layer frames, combined positives and metrics are filters / one
  aggregation over the single scored frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import normalize as N
from ..functions import similarity as S
from ..functions.fuzzy import with_fuzzy_average
from ..functions.vectors import cosine_similarity
from ..session import settled
from . import names as D

EmbeddingFn = Callable[[DataFrame, str, str, str], DataFrame]

BATCH_COLUMNS = ["First_Layer_Score", "First_Layer_Pass", "Second_Layer_Score",
                 "Second_Layer_Pass", "Third_Layer_Pass", "Prediction"]
API_COLUMNS = ["First_Layer_Pass", "Second_Layer_Score", "Second_Layer_Pass",
               "Third_Layer_Pass", "Prediction"]


# ---------------------------------------------------------------------------
# M9 providers: (df, name_a_col, name_b_col, out_col) -> df
# ---------------------------------------------------------------------------

def trigram_embedding(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Stand-in for the sentence-embedding similarity; not the model's score, so callers name it."""
    return df.withColumn(out, S.trigram_cosine(F.col(a), F.col(b)))


def model_embedding(embed_udf) -> EmbeddingFn:
    """M9 with a user model: ``embed_udf`` maps a string column to a vector
    column (e.g. :func:`simforge.functions.embed.embedding_udf`). It runs once
    for each distinct name of pairs whose names differ (on a stream, once a row)."""
    def run(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
        if df.isStreaming:
            df = df.withColumn(f"_{out}_va", embed_udf(F.col(a))).withColumn(f"_{out}_vb", embed_udf(F.col(b)))
        else:
            df = D.with_vectors(df, a, b, out, D.embedded_names(df, a, b, embed_udf))
        df = df.withColumn(out, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(
            cosine_similarity(F.col(f"_{out}_va"), F.col(f"_{out}_vb"))))
        return df.drop(f"_{out}_va", f"_{out}_vb")
    return run


MISSING = ("error", "undecided")


def table_embedding(vectors: DataFrame, key: str = "name", vec: str = "embedding",
                    missing: str = "error") -> EmbeddingFn:
    """M9 from a table of precomputed vectors keyed by normalised name (two keyed joins).

    Of several vectors of a name the least is used. A name without a vector
    fails the job (``error``) or leaves layer 2 without a score, so that the
    pair goes on to layer 3 (``undecided``).
    """
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    v = vectors.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(
        F.min(F.col(vec).cast("array<double>")).alias("_v"))

    def run(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
        df = D.with_vectors(df, a, b, out, v)
        x, y = F.col(f"_{out}_va"), F.col(f"_{out}_vb")
        lost = F.col(a).isNotNull() & (F.col(a) != F.col(b)) & (x.isNull() | y.isNull())
        score = F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(cosine_similarity(x, y))
        if missing == "error":
            score = F.when(lost, F.raise_error(F.concat(F.lit("no vector for a name of: "), F.col(a), F.lit(" / "), F.col(b)))
                           .cast("double")).otherwise(score)
        return df.withColumn(out, score).drop(f"_{out}_va", f"_{out}_vb")
    return run


def _gate(df: DataFrame, src: str, dst: str, active: Column | None) -> DataFrame:
    c = F.col(src)
    return df.withColumn(dst, c if active is None else F.when(active, c))


# ---------------------------------------------------------------------------
# single layers as DataFrame transforms (usable on their own: C1-C4)
# ---------------------------------------------------------------------------

def with_layer1_batch(df: DataFrame, a: str, b: str, mode: str = "aligned") -> DataFrame:     # C1
    """``First_Layer_Score`` = M5 on raw names, ``First_Layer_Pass`` = score >= 0.75."""
    df = df.withColumn("_l1a", N.null_to_empty(F.col(a))).withColumn("_l1b", N.null_to_empty(F.col(b)))
    df = with_fuzzy_average(df, "_l1a", "_l1b", "First_Layer_Score", mode)
    return df.withColumn("First_Layer_Pass", F.col("First_Layer_Score") >= K.LAYER1_THRESHOLD_BATCH) \
             .drop("_l1a", "_l1b")


def with_layer1_api(df: DataFrame, a: str, b: str, mode: str = "aligned") -> DataFrame:       # C2
    """``First_Layer_Pass`` (0/1) = ``(K3 or K4 or M5(N1) >= 0.80) and K2``.

    The fuzzy average is only computed where neither token test passed.
    """
    ra, rb = N.null_to_empty(F.col(a)), N.null_to_empty(F.col(b))
    df = (df.withColumn("_n1a", N.n1(ra, "api")).withColumn("_n1b", N.n1(rb, "api"))
            .withColumn("_kw", N.keywords_agree(ra, rb)))
    df = df.withColumn("_quick", N.token_subset(F.col("_n1a"), F.col("_n1b")) |
                       N.permutation_match(F.col("_n1a"), F.col("_n1b")))
    df = _gate(df, "_n1a", "_fa", ~F.col("_quick"))
    df = _gate(df, "_n1b", "_fb", ~F.col("_quick"))
    df = with_fuzzy_average(df, "_fa", "_fb", "_fz", mode)
    ok = (F.col("_quick") | F.coalesce(F.col("_fz") >= K.LAYER1_THRESHOLD_API, F.lit(False))) & F.col("_kw")
    return df.withColumn("First_Layer_Pass", ok.cast("int")) \
             .drop("_n1a", "_n1b", "_kw", "_quick", "_fa", "_fb", "_fz")


def with_layer2(df: DataFrame, a: str, b: str, embedding: EmbeddingFn, profile: str = "batch",
                mode: str = "aligned", active: Column | None = None,
                out: str = "Second_Layer_Score") -> DataFrame:                                 # C3 / M12
    """Weighted score over N2 names; rows with ``active`` false get null."""
    df = _gate(df, a, "_g2a", active)
    df = _gate(df, b, "_g2b", active)
    df = df.withColumn("_n2a", N.n2(F.col("_g2a"), profile)).withColumn("_n2b", N.n2(F.col("_g2b"), profile))
    x, y = F.col("_n2a"), F.col("_n2b")
    df = embedding(df, "_n2a", "_n2b", "_emb")
    df = df.withColumn("_lev", S.levenshtein_similarity(x, y)).withColumn("_jac", S.jaccard_chars(x, y))
    df = S.with_phonetic_similarity(df, "_n2a", "_n2b", "_pho")
    df = with_fuzzy_average(df, "_n2a", "_n2b", "_fuz", mode)
    score = S.weighted_score(F.col("_emb"), F.col("_lev"), F.col("_pho"), F.col("_jac"), F.col("_fuz"))
    df = df.withColumn(out, F.when(F.col("_n2a").isNotNull(), score))
    return df.drop("_g2a", "_g2b", "_n2a", "_n2b", "_emb", "_lev", "_jac", "_pho", "_fuz")


def with_layer3(df: DataFrame, a: str, b: str, profile: str = "batch", mode: str = "aligned",
                active: Column | None = None, out: str = "Third_Layer_Pass") -> DataFrame:   # C4
    """``M5(N3 names) >= 0.75 and K2(raw names)``; rows with ``active`` false get null."""
    df = df.withColumn("_g3a", N.null_to_empty(F.col(a))).withColumn("_g3b", N.null_to_empty(F.col(b)))
    if active is not None:
        df = _gate(_gate(df, "_g3a", "_g3a", active), "_g3b", "_g3b", active)
    ga, gb = F.col("_g3a"), F.col("_g3b")
    df = df.withColumn("_n3a", N.n3(ga, profile)).withColumn("_n3b", N.n3(gb, profile))
    df = with_fuzzy_average(df, "_n3a", "_n3b", "_f3", mode)
    df = df.withColumn(out, F.when(ga.isNotNull(), (F.col("_f3") >= K.LAYER3_THRESHOLD) & N.keywords_agree(ga, gb)))
    return df.drop("_g3a", "_g3b", "_n3a", "_n3b", "_f3")


# ---------------------------------------------------------------------------
# cascades
# ---------------------------------------------------------------------------

def _passed(layer: str) -> Column:
    return F.coalesce(F.col(layer), F.lit(False))


def _cascade_batch(df: DataFrame, mode: str, embedding: EmbeddingFn) -> DataFrame:
    df = with_layer1_batch(df, "_a", "_b", mode)
    df = with_layer2(df, "_a", "_b", embedding, "batch", mode, active=~F.col("First_Layer_Pass"))
    df = df.withColumn("Second_Layer_Pass", F.col("Second_Layer_Score") >= K.LAYER2_THRESHOLD)
    df = with_layer3(df, "_a", "_b", "batch", mode,
                     active=~F.col("First_Layer_Pass") & ~_passed("Second_Layer_Pass"))
    return df.withColumn("Prediction", F.col("First_Layer_Pass") |
                         F.coalesce(F.col("Second_Layer_Pass"), F.lit(False)) |
                         F.coalesce(F.col("Third_Layer_Pass"), F.lit(False)))


def _cascade_api(df: DataFrame, mode: str, embedding: EmbeddingFn) -> DataFrame:
    df = with_layer1_api(df, "_a", "_b", mode)
    live2 = F.col("First_Layer_Pass") == 0
    df = with_layer2(df, "_a", "_b", embedding, "api", mode, active=live2)
    df = df.withColumn("Second_Layer_Pass", F.col("Second_Layer_Score") >= K.LAYER2_THRESHOLD)
    df = with_layer3(df, "_a", "_b", "api", mode, active=live2 & ~_passed("Second_Layer_Pass"))
    pred = (F.col("First_Layer_Pass") == 1) | F.coalesce(F.col("Second_Layer_Pass"), F.lit(False)) | \
        F.coalesce(F.col("Third_Layer_Pass"), F.lit(False))
    return df.withColumn("Prediction", pred.cast("int"))


def _scored(dim: DataFrame, profile: str, mode: str, embedding: EmbeddingFn) -> DataFrame:
    """The cascade over distinct pairs ``_a, _b``, with the forms of a dictionary of names."""
    df = D.with_forms(dim, D.name_dictionary(dim, "_a", "_b", profile), "_a", "_b")
    agree = F.col("_businessa") == F.col("_businessb")
    if profile == "batch":
        df = with_fuzzy_average(df, "_a", "_b", "First_Layer_Score", mode)
        df = df.withColumn("_first", F.col("First_Layer_Score") >= K.LAYER1_THRESHOLD_BATCH)
    else:
        quick = N.token_subset(F.col("_n1a"), F.col("_n1b")) | N.permutation_match(F.col("_n1a"), F.col("_n1b"))
        df = df.withColumn("_quick", quick)
        df = _gate(_gate(df, "_n1a", "_fa", ~F.col("_quick")), "_n1b", "_fb", ~F.col("_quick"))
        df = with_fuzzy_average(df, "_fa", "_fb", "_fz", mode)
        close = F.coalesce(F.col("_fz") >= K.LAYER1_THRESHOLD_API, F.lit(False))
        df = df.withColumn("_first", (F.col("_quick") | close) & agree).drop("_quick", "_fa", "_fb", "_fz")
    df = settled(df, "layer-1")
    decided, rest = df.where("_first"), df.where("not _first")
    rest = embedding(rest, "_n2a", "_n2b", "_emb")
    x, y = F.col("_n2a"), F.col("_n2b")
    rest = rest.withColumn("_lev", S.levenshtein_similarity(x, y)).withColumn("_jac", S.jaccard_chars(x, y))
    rest = D.with_code_similarity(rest, "_codea", "_codeb", "_pho")
    rest = with_fuzzy_average(rest, "_n2a", "_n2b", "_fuz", mode)
    score = S.weighted_score(F.col("_emb"), F.col("_lev"), F.col("_pho"), F.col("_jac"), F.col("_fuz"))
    rest = rest.withColumn("Second_Layer_Score", score)
    rest = rest.withColumn("Second_Layer_Pass", F.col("Second_Layer_Score") >= K.LAYER2_THRESHOLD)
    open_ = ~_passed("Second_Layer_Pass")
    rest = _gate(_gate(rest, "_n3a", "_ga", open_), "_n3b", "_gb", open_)
    rest = with_fuzzy_average(rest, "_ga", "_gb", "_f3", mode)
    rest = rest.withColumn("Third_Layer_Pass", F.when(open_, (F.col("_f3") >= K.LAYER3_THRESHOLD) & agree))
    own = ["_a", "_b", *["First_Layer_Score"] * (profile == "batch"), "_first"]
    out = rest.select(*own, "Second_Layer_Score", "Second_Layer_Pass", "Third_Layer_Pass")
    out = out.unionByName(decided.select(*own), allowMissingColumns=True)
    accepted = F.col("_first") | _passed("Second_Layer_Pass") | _passed("Third_Layer_Pass")
    flag = (lambda c: c) if profile == "batch" else (lambda c: c.cast("int"))
    out = out.withColumn("First_Layer_Pass", flag(F.col("_first"))).withColumn("Prediction", flag(accepted))
    return out.select("_a", "_b", *(BATCH_COLUMNS if profile == "batch" else API_COLUMNS))


def score_pairs(pairs: DataFrame, embedding: EmbeddingFn, profile: str = "batch",
                partial_mode: str = "aligned", dedupe: bool = True,
                name1: str = "name1", name2: str = "name2") -> DataFrame:
    """C5 (``batch``) / C6 + C9 (``api``): all input columns + the layer columns.

    ``embedding`` provides M9 (a model, a vector table, or the named stand-in).
    ``dedupe=False`` keeps the plan a pure projection (needed on streams);
    otherwise the dictionary of names and the results of layer 1 are settled.
    """
    if profile not in N.PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    run = _cascade_batch if profile == "batch" else _cascade_api
    keyed = pairs.withColumn("_a", N.null_to_empty(F.col(name1))) \
                 .withColumn("_b", N.null_to_empty(F.col(name2)))
    if not dedupe:
        return run(keyed, partial_mode, embedding).drop("_a", "_b")
    dim = _scored(keyed.select("_a", "_b").distinct(), profile, partial_mode, embedding)
    return keyed.join(dim, ["_a", "_b"], "left").drop("_a", "_b")


def layer_frames(scored: DataFrame) -> dict[int, DataFrame]:
    """Rows that reached each layer, with the columns the layer had (batch profile)."""
    base = [c for c in scored.columns if c not in BATCH_COLUMNS]
    l1 = scored.select(*base, "First_Layer_Score", "First_Layer_Pass",
                       F.col("First_Layer_Pass").alias("Prediction"))
    reached2 = scored.where(~F.col("First_Layer_Pass"))
    l2 = reached2.select(*base, "First_Layer_Score", "First_Layer_Pass", "Second_Layer_Score",
                         "Second_Layer_Pass", F.col("Second_Layer_Pass").alias("Prediction"))
    reached3 = reached2.where(~_passed("Second_Layer_Pass"))
    l3 = reached3.select(*base, "First_Layer_Score", "First_Layer_Pass", "Second_Layer_Score",
                         "Second_Layer_Pass", "Third_Layer_Pass",
                         F.col("Third_Layer_Pass").alias("Prediction"))
    return {1: l1, 2: l2, 3: l3}


def combined_positives(scored: DataFrame) -> DataFrame:
    """The positives of the three layers, gaps null.

    Equal to ``l1[pass] ∪ l2[pass] ∪ l3[pass]`` by name; as the layer sets are
    disjoint, it is one filter over the scored frame (no union, no rescan).
    """
    return scored.where(F.col("Prediction"))


def final_prediction(scored: DataFrame, key: str = "pair_id") -> DataFrame:
    """C8 (D4 intended): one row per input row, any layer passed."""
    return scored.select(key, F.col("Prediction").alias("final_prediction"))


ENRICH_COLUMNS = {
    "First_Layer_Pass": "results.first_layer_pass",
    "Second_Layer_Score": "results.second_layer_score",
    "Second_Layer_Pass": "results.second_layer_pass",
    "Third_Layer_Pass": "results.third_layer_pass",
}


def enrich_pairs(data: DataFrame, embedding: EmbeddingFn, partial_mode: str = "aligned") -> DataFrame:
    """C10 + C11 (D5 re-aimed): every input row plus the api cascade's layer results."""
    scored = score_pairs(data, embedding, "api", partial_mode)
    out = scored.select(*data.columns, *[F.col(k).alias(v) for k, v in ENRICH_COLUMNS.items()])
    return out.drop("result.name1", "result.name2")
