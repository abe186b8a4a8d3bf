"""Registered name-matching queries over the pair fixture.

Oracle SQL computes every stage as a CTE column, so DuckDB evaluates each
normalisation once per row. Registered queries use the ``full`` partial-ratio
mode, which SQL can express; ``aligned`` (the library default) is registered
without oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import fuzzy as Z
from ..functions import normalize as N
from ..functions import similarity as S
from ..operators import cascade as C
from ..operators import evaluate as E
from ..session import shared_folder
from ..sources import io as sio
from ..sources.tables import PAIRS_SQL, name_pairs, table
from . import duck as D
from .catalog import register

MODE = "full"
#: M9 of the fixture queries; the library takes a model or a vector table instead.
STAND_IN = C.trigram_embedding


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# Every step on every distinct name
# ---------------------------------------------------------------------------

_STEPS = [
    ("p1_lower", N.lower, lambda x: f"lower({x})"),
    ("p2_collapse_repeats", N.collapse_repeats, D.collapse_repeats),
    ("p3_char_map", N.char_map, D.char_map),
    ("p4_bigram_map", N.bigram_map, D.bigram_map),
    ("p5_squeeze_spaces", N.squeeze_spaces, D.squeeze_spaces),
    ("p6_drop_a_after_consonant", N.drop_a_after_consonant, D.drop_a_after_consonant),
    ("p7_drop_special_chars", N.drop_special_chars, D.drop_special_chars),
    ("p8_strip_salutation", N.strip_salutation, D.strip_salutation),
    ("p9_cut_parent_suffix", N.cut_parent_suffix, D.cut_parent_suffix),
    ("p10_drop_mohammad_variants", N.drop_mohammad_variants, D.drop_mohammad_variants),
    ("p11_drop_agarwal_variants", N.drop_agarwal_variants, D.drop_agarwal_variants),
    ("p12_stop_words_batch", lambda c: N.drop_stop_words(c, "batch"), lambda x: D.drop_stop_words(x, "batch")),
    ("p12_stop_words_api", lambda c: N.drop_stop_words(c, "api"), lambda x: D.drop_stop_words(x, "api")),
    ("p13_n1_api", lambda c: N.n1(c, "api"), lambda x: D.n1(x, "api")),
    ("p14_n2_batch", lambda c: N.n2(c, "batch"), lambda x: D.n2(x, "batch")),
    ("p14_n2_api", lambda c: N.n2(c, "api"), lambda x: D.n2(x, "api")),
    ("p15_n3_batch", lambda c: N.n3(c, "batch"), lambda x: D.n3(x, "batch")),
    ("p15_n3_api", lambda c: N.n3(c, "api"), lambda x: D.n3(x, "api")),
]

NORMALIZE_SQL = f"""
with pairs as ({PAIRS_SQL}),
names as (
  select name1 as name from pairs union select name2 from pairs
  union select c_name from customer union select s_name from supplier union select n_name from nation
  union select upper(substr(p_name, 1, 1)) || substr(p_name, 2) from part
)
select name, {", ".join(f"{sql('name')} as {col}" for col, _, sql in _STEPS)},
       {D.has_keyword('name')} as k1_has_keyword, {D.has_keyword('name', True)} as k1_has_fixed_keyword
from names where name is not null
"""


@register("p1_p15_normalize_names", NORMALIZE_SQL)
def p1_p15_normalize_names(spark, sf_dir):
    """Each normalisation step (P1-P12) and chain (P13-P15) plus K1, per distinct name."""
    pairs = name_pairs(spark, sf_dir)
    names = (pairs.select(F.col("name1").alias("name"))
             .union(pairs.select("name2"))
             .union(table(spark, sf_dir, "customer").select("c_name"))
             .union(table(spark, sf_dir, "supplier").select("s_name"))
             .union(table(spark, sf_dir, "nation").select("n_name"))
             .union(table(spark, sf_dir, "part").select(F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr("p_name", F.lit(2)))))
             .where(F.col("name").isNotNull()).distinct())
    n = F.col("name")
    return names.select("name", *[fn(n).alias(col) for col, fn, _ in _STEPS],
                        N.has_keyword(n).alias("k1_has_keyword"),
                        N.has_keyword(n, fixed_keywords=True).alias("k1_has_fixed_keyword"))


# ---------------------------------------------------------------------------
# K2-K4 on pairs
# ---------------------------------------------------------------------------

def _base_sql(pairs_sql: str) -> str:
    return f"pairs as ({pairs_sql}), b0 as (select *, coalesce(name1, '') as a, coalesce(name2, '') as b from pairs)"


_BASE = _base_sql(PAIRS_SQL)

K_SQL = f"""
with {_BASE},
b1 as (select *, {D.n1('a')} as n1a, {D.n1('b')} as n1b from b0)
select pair_id, ({D.has_keyword('a')} = {D.has_keyword('b')}) as k2_keywords_agree,
       {D.token_subset('n1a', 'n1b')} as k3_token_subset,
       {D.permutation_match('n1a', 'n1b')} as k4_permutation_match
from b1
"""


def _pairs_ab(spark, sf_dir):
    p = name_pairs(spark, sf_dir)
    return p.withColumn("a", N.null_to_empty(F.col("name1"))).withColumn("b", N.null_to_empty(F.col("name2")))


@register("k2_k4_pair_tests", K_SQL)
def k2_k4_pair_tests(spark, sf_dir):
    p = _pairs_ab(spark, sf_dir)
    a, b = F.col("a"), F.col("b")
    n1a, n1b = N.n1(a, "api"), N.n1(b, "api")
    return p.select("pair_id", N.keywords_agree(a, b).alias("k2_keywords_agree"),
                    N.token_subset(n1a, n1b).alias("k3_token_subset"),
                    N.permutation_match(n1a, n1b).alias("k4_permutation_match"))


# ---------------------------------------------------------------------------
# M1-M5
# ---------------------------------------------------------------------------

M1_M4_SQL = f"""
with {_BASE}
select pair_id, {D.ratio('a', 'b')} as m1_ratio, {D.partial_ratio_full('a', 'b')} as m2_partial_ratio,
       {D.token_sort_ratio('a', 'b')} as m3_token_sort_ratio, {D.token_set_ratio('a', 'b')} as m4_token_set_ratio
from b0
"""


@register("m1_m4_fuzzy_ratios", M1_M4_SQL)
def m1_m4_fuzzy_ratios(spark, sf_dir):
    """M1-M4 on the raw names (M2 in ``full`` window mode)."""
    p = Z.with_fuzzy_ratios(_pairs_ab(spark, sf_dir), "a", "b", MODE)
    return p.select("pair_id", "m1_ratio", "m2_partial_ratio", "m3_token_sort_ratio", "m4_token_set_ratio")


@register("m2_partial_ratio_aligned")
def m2_partial_ratio_aligned(spark, sf_dir):
    """M2 with block-aligned windows (library default; no SQL form)."""
    p = Z.with_fuzzy_ratios(_pairs_ab(spark, sf_dir), "a", "b", "aligned")
    return p.select("pair_id", "m2_partial_ratio")


# Each pair of strings is scored once, whichever names and normalisations it comes from.
_M5_FORMS = [("a", "b", "m5a_raw"), ("n1a", "n1b", "m5b_n1"), ("n2a", "n2b", "m5c_n2"), ("n3a", "n3b", "m5d_n3")]
M5_SQL = f"""
with {_BASE},
names as materialized (select distinct a as x from b0 union select b from b0),
forms as materialized (select x, {D.n1('x', 'api')} as n1, {D.n2('x', 'batch')} as n2, {D.n3('x', 'batch')} as n3 from names),
b1 as materialized (select pair_id, a, b, f.n1 as n1a, g.n1 as n1b, f.n2 as n2a, g.n2 as n2b, f.n3 as n3a, g.n3 as n3b
  from b0 join forms f on f.x = b0.a join forms g on g.x = b0.b),
strings as materialized ({" union ".join(f"select {x} as x, {y} as y from b1" for x, y, _ in _M5_FORMS)}),
scored as materialized (select x, y, {D.fuzzy_average('x', 'y')} as m5 from strings)
select pair_id, {", ".join(f"round(s{i}.m5, 6) as {out}" for i, (_, _, out) in enumerate(_M5_FORMS))}
from b1 {" ".join(f"join scored s{i} on s{i}.x = {x} and s{i}.y = {y}" for i, (x, y, _) in enumerate(_M5_FORMS))}
"""


@register("m5_fuzzy_averages", M5_SQL)
def m5_fuzzy_averages(spark, sf_dir):
    """M5a-d: fuzzy average on raw, N1 (api), N2 and N3 (batch) names, of each distinct pair in one kernel."""
    pairs = _pairs_ab(spark, sf_dir).select("pair_id", "a", "b")
    a, b = F.col("a"), F.col("b")
    p = pairs.select("a", "b").distinct().withColumns({
        "n1a": N.n1(a, "api"), "n1b": N.n1(b, "api"), "n2a": N.n2(a), "n2b": N.n2(b), "n3a": N.n3(a), "n3b": N.n3(b)})
    p = Z.with_fuzzy_averages(p, _M5_FORMS, MODE)
    return pairs.join(p, ["a", "b"]).select("pair_id", *[_r6(F.col(c)).alias(c) for _, _, c in _M5_FORMS])


# ---------------------------------------------------------------------------
# M6-M9, M12 on N2 names
# ---------------------------------------------------------------------------

_N2 = f"b1 as (select *, {D.n2('a')} as n2a, {D.n2('b')} as n2b from b0)"

M6_M9_SQL = f"""
with {_BASE}, {_N2}
select pair_id, n2a, n2b, round({D.levenshtein_similarity('n2a', 'n2b')}, 6) as m6_levenshtein,
       round({D.phonetic_similarity('n2a', 'n2b')}, 6) as m7_phonetic,
       round({D.jaccard_chars('n2a', 'n2b')}, 6) as m8_jaccard,
       round({D.trigram_cosine('n2a', 'n2b')}, 6) as m9_embedding_standin
from b1
"""


@register("m6_m9_pair_similarities", M6_M9_SQL)
def m6_m9_pair_similarities(spark, sf_dir):
    p = _pairs_ab(spark, sf_dir)
    q = p.select("pair_id", N.n2(F.col("a")).alias("n2a"), N.n2(F.col("b")).alias("n2b"))
    x, y = F.col("n2a"), F.col("n2b")
    q = S.with_phonetic_similarity(q, "n2a", "n2b", "m7_phonetic")
    return q.select("pair_id", "n2a", "n2b", _r6(S.levenshtein_similarity(x, y)).alias("m6_levenshtein"),
                    _r6(F.col("m7_phonetic")).alias("m7_phonetic"),
                    _r6(S.jaccard_chars(x, y)).alias("m8_jaccard"),
                    _r6(S.trigram_cosine(x, y)).alias("m9_embedding_standin"))


def _l2_sql(x: str, y: str, embedding=D.trigram_cosine) -> str:
    return D.weighted_score(embedding(x, y), D.levenshtein_similarity(x, y),
                            D.phonetic_similarity(x, y), D.jaccard_chars(x, y), D.fuzzy_average(x, y))


M12_SQL = f"""
with {_BASE}, {_N2}
select pair_id, round({_l2_sql('n2a', 'n2b')}, 6) as m12_weighted_score from b1
"""


@register("m12_weighted_score", M12_SQL)
def m12_weighted_score(spark, sf_dir):
    p = C.with_layer2(_pairs_ab(spark, sf_dir), "a", "b", STAND_IN, "batch", MODE, out="sc")
    return p.select("pair_id", _r6(F.col("sc")).alias("m12_weighted_score"))


# ---------------------------------------------------------------------------
# single layers on every pair
# ---------------------------------------------------------------------------

C1_SQL = f"""
with {_BASE}, s as (select pair_id, {D.fuzzy_average('a', 'b')} as sc from b0)
select pair_id, round(sc, 6) as First_Layer_Score, sc >= {K.LAYER1_THRESHOLD_BATCH} as First_Layer_Pass from s
"""


@register("c1_layer1_batch", C1_SQL)
def c1_layer1_batch(spark, sf_dir):
    s = C.with_layer1_batch(name_pairs(spark, sf_dir), "name1", "name2", MODE)
    return s.select("pair_id", _r6(F.col("First_Layer_Score")).alias("First_Layer_Score"), "First_Layer_Pass")


def _l1_api_sql(src: str) -> str:
    return f"""
l1a as materialized (select *, {D.n1('a')} as n1a, {D.n1('b')} as n1b,
           ({D.has_keyword('a')} = {D.has_keyword('b')}) as kw from {src}),
l1b as materialized (select *, ({D.token_subset('n1a', 'n1b')} or {D.permutation_match('n1a', 'n1b')}) as quick from l1a),
l1c as materialized (select *, (quick or coalesce(case when not quick then {D.fuzzy_average('n1a', 'n1b')}
           >= {K.LAYER1_THRESHOLD_API} end, false)) and kw as l1pass from l1b)"""


C2_SQL = f"""
with {_BASE}, {_l1_api_sql('b0')}
select pair_id, l1pass::INTEGER as First_Layer_Pass from l1c
"""


@register("c2_layer1_api", C2_SQL)
def c2_layer1_api(spark, sf_dir):
    s = C.with_layer1_api(name_pairs(spark, sf_dir), "name1", "name2", MODE)
    return s.select("pair_id", "First_Layer_Pass")


C3_SQL = f"""
with {_BASE}, {_N2}, s as (select pair_id, {_l2_sql('n2a', 'n2b')} as sc from b1)
select pair_id, round(sc, 6) as Second_Layer_Score, sc >= {K.LAYER2_THRESHOLD} as Second_Layer_Pass from s
"""


@register("c3_layer2", C3_SQL)
def c3_layer2(spark, sf_dir):
    s = C.with_layer2(_pairs_ab(spark, sf_dir), "a", "b", STAND_IN, "batch", MODE, out="sc")
    return s.select("pair_id", _r6(F.col("sc")).alias("Second_Layer_Score"),
                    (F.col("sc") >= K.LAYER2_THRESHOLD).alias("Second_Layer_Pass"))


def _l3_sql(src: str, profile: str, cond: str = "true") -> str:
    return f"""
l3a as materialized (select *, case when {cond} then {D.n3('a', profile)} end as n3a,
           case when {cond} then {D.n3('b', profile)} end as n3b from {src}),
l3b as materialized (select *, case when n3a is not null then {D.fuzzy_average('n3a', 'n3b')} >= {K.LAYER3_THRESHOLD}
           and ({D.has_keyword('a')} = {D.has_keyword('b')}) end as l3pass from l3a)"""


C4_SQL = f"""
with {_BASE}, {_l3_sql('b0', 'batch')}
select pair_id, l3pass as Third_Layer_Pass from l3b
"""


@register("c4_layer3", C4_SQL)
def c4_layer3(spark, sf_dir):
    s = C.with_layer3(_pairs_ab(spark, sf_dir), "a", "b", "batch", MODE)
    return s.select("pair_id", "Third_Layer_Pass")


# ---------------------------------------------------------------------------
# cascades (C5-C8, C10) and metrics
# ---------------------------------------------------------------------------

def _batch_cascade_sql() -> str:
    return f"""{_BASE},
c1 as materialized (select *, {D.fuzzy_average('a', 'b')} as s1 from b0),
c2 as materialized (select *, case when s1 < {K.LAYER1_THRESHOLD_BATCH} then {D.n2('a')} end as n2a,
                 case when s1 < {K.LAYER1_THRESHOLD_BATCH} then {D.n2('b')} end as n2b from c1),
c3 as materialized (select *, case when n2a is not null then {_l2_sql('n2a', 'n2b')} end as s2 from c2),
{_l3_sql('c3', 'batch', f's1 < {K.LAYER1_THRESHOLD_BATCH} and s2 < {K.LAYER2_THRESHOLD}')},
scored as materialized (
  select pair_id, name1, name2, labels, round(s1, 6) as First_Layer_Score,
         s1 >= {K.LAYER1_THRESHOLD_BATCH} as First_Layer_Pass,
         round(s2, 6) as Second_Layer_Score, s2 >= {K.LAYER2_THRESHOLD} as Second_Layer_Pass,
         l3pass as Third_Layer_Pass,
         (s1 >= {K.LAYER1_THRESHOLD_BATCH}) or coalesce(s2 >= {K.LAYER2_THRESHOLD}, false)
           or coalesce(l3pass, false) as Prediction
  from l3b)"""


C5_SQL = f"with {_batch_cascade_sql()} select * from scored"


def _scored_batch(spark, sf_dir, mode=MODE):
    s = C.score_pairs(name_pairs(spark, sf_dir), STAND_IN, "batch", mode)
    return s.withColumn("First_Layer_Score", _r6(F.col("First_Layer_Score"))) \
            .withColumn("Second_Layer_Score", _r6(F.col("Second_Layer_Score")))


@register("c5_batch_cascade", C5_SQL)
def c5_batch_cascade(spark, sf_dir):
    """Batch cascade (distinct pairs scored once, staged layers)."""
    return _scored_batch(spark, sf_dir)


@register("c5_batch_cascade_aligned")
def c5_batch_cascade_aligned(spark, sf_dir):
    """C5 with the default block-aligned partial ratio (no SQL form)."""
    return _scored_batch(spark, sf_dir, "aligned")


def api_cascade_sql(select: str, pairs_sql: str = PAIRS_SQL, embedding=D.trigram_cosine) -> str:
    return f"""
with {_base_sql(pairs_sql)}, {_l1_api_sql('b0')},
c2 as materialized (select *, case when not l1pass then {D.n2('a', 'api')} end as n2a,
                 case when not l1pass then {D.n2('b', 'api')} end as n2b from l1c),
c3 as materialized (select *, case when n2a is not null then {_l2_sql('n2a', 'n2b', embedding)} end as s2 from c2),
{_l3_sql('c3', 'api', f'not l1pass and s2 < {K.LAYER2_THRESHOLD}')}
{select}
from l3b
"""


C6_SQL = api_cascade_sql(f"""select pair_id, name1, name2, labels, l1pass::INTEGER as First_Layer_Pass,
       round(s2, 6) as Second_Layer_Score, s2 >= {K.LAYER2_THRESHOLD} as Second_Layer_Pass,
       l3pass as Third_Layer_Pass,
       (l1pass or coalesce(s2 >= {K.LAYER2_THRESHOLD}, false) or coalesce(l3pass, false))::INTEGER
         as Prediction""")


@register("c6_api_cascade", C6_SQL)
def c6_api_cascade(spark, sf_dir):
    """The per-request cascade, run as one batch job."""
    s = C.score_pairs(name_pairs(spark, sf_dir), STAND_IN, "api", MODE)
    return s.withColumn("Second_Layer_Score", _r6(F.col("Second_Layer_Score")))


C7_SQL = f"with {_batch_cascade_sql()} select * from scored where Prediction"


@register("c7_combined_positives", C7_SQL)
def c7_combined_positives(spark, sf_dir):
    return C.combined_positives(_scored_batch(spark, sf_dir))


C8_SQL = f"with {_batch_cascade_sql()} select pair_id, Prediction as final_prediction from scored"


@register("c8_final_prediction", C8_SQL)
def c8_final_prediction(spark, sf_dir):
    return C.final_prediction(_scored_batch(spark, sf_dir))


C10_SQL = api_cascade_sql(f"""select pair_id, name1, name2, labels,
       l1pass::INTEGER as "results.first_layer_pass",
       round(s2, 6) as "results.second_layer_score",
       s2 >= {K.LAYER2_THRESHOLD} as "results.second_layer_pass",
       l3pass as "results.third_layer_pass" """)


@register("c10_enrich_pairs", C10_SQL)
def c10_enrich_pairs(spark, sf_dir):
    """C10 + C11: every input row with the api cascade's four result columns."""
    e = C.enrich_pairs(name_pairs(spark, sf_dir), STAND_IN, MODE)
    return e.withColumn("results.second_layer_score", _r6(F.col("`results.second_layer_score`")))


def _metric_sql(counts_from: str) -> str:
    return f"""
select layer, tn, fp, fn, tp,
  round(case when n > 0 then (tp + tn) / n end, 6) as accuracy,
  round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 6) as precision,
  round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6) as recall,
  round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end, 6) as f1_score,
  round(case when tp + fn > 0 and tn + fp > 0 then (tp / (tp + fn) + tn / (tn + fp)) / 2 end, 6) as roc_auc_score
from (select layer, tn, fp, fn, tp, (tn + fp + fn + tp)::DOUBLE as n from {counts_from})"""


def _counts_sql(label: str, pred: str, where: str = "true") -> str:
    y, p = f"({label})::INTEGER = 1", f"coalesce(({pred})::INTEGER = 1, false)"
    return (f"count_if(({where}) and not ({y}) and not ({p}))::BIGINT as tn, "
            f"count_if(({where}) and not ({y}) and ({p}))::BIGINT as fp, "
            f"count_if(({where}) and ({y}) and not ({p}))::BIGINT as fn, "
            f"count_if(({where}) and ({y}) and ({p}))::BIGINT as tp")


def _layer_counts_sql() -> str:
    reach = {1: "true", 2: "not First_Layer_Pass", 3: "not First_Layer_Pass and not Second_Layer_Pass"}
    pred = {1: "First_Layer_Pass", 2: "Second_Layer_Pass", 3: "Third_Layer_Pass"}
    cols = []
    for i in (1, 2, 3):
        part = _counts_sql("labels", pred[i], reach[i])
        cols.append(part.replace(" as tn", f" as l{i}_tn").replace(" as fp", f" as l{i}_fp")
                    .replace(" as fn", f" as l{i}_fn").replace(" as tp", f" as l{i}_tp"))
    structs = ", ".join("{" + f"'layer': {i}, 'tn': l{i}_tn, 'fp': l{i}_fp, 'fn': l{i}_fn, 'tp': l{i}_tp" + "}"
                        for i in (1, 2, 3))
    return (f"wide as (select {', '.join(cols)} from scored),\n"
            f"counts as (select unnest([{structs}], recursive := true) from wide)")


E7_SQL = f"""
with {_batch_cascade_sql()},
{_layer_counts_sql()}
{_metric_sql('counts')}
"""


@register("e7_metrics_per_layer", E7_SQL)
def e7_metrics_per_layer(spark, sf_dir):
    """E1-E7 per layer of the batch cascade, from one aggregation pass."""
    return E.layer_metrics(_scored_batch(spark, sf_dir), "labels")


@register("e7_observed_metrics", E7_SQL)
def e7_observed_metrics(spark, sf_dir):
    """E7 observed while the audit files of S3 are written: one pass over the scored pairs."""
    return sio.write_layer_audit_once(_scored_batch(spark, sf_dir), f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}")


S3_SQL = f"""
with {_batch_cascade_sql()}
select layer, pair_id, name1, name2, labels, First_Layer_Score, First_Layer_Pass,
  case when layer >= 2 then Second_Layer_Score end as Second_Layer_Score,
  case when layer >= 2 then Second_Layer_Pass end as Second_Layer_Pass,
  case when layer >= 3 then Third_Layer_Pass end as Third_Layer_Pass,
  case layer when 1 then First_Layer_Pass when 2 then Second_Layer_Pass else Third_Layer_Pass end as Prediction
from scored, (select unnest([1, 2, 3]) as layer) t
where layer = 1 or (layer = 2 and not First_Layer_Pass)
  or (layer = 3 and not First_Layer_Pass and not coalesce(Second_Layer_Pass, false))
"""


@register("s3_layer_audit", S3_SQL)
def s3_layer_audit(spark, sf_dir):
    """S3: the audit files, read back: each layer with the rows that reached it."""
    scored, folder = _scored_batch(spark, sf_dir), f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    sio.write_layer_audit_once(scored, folder)
    return sio.read_layer_audit(spark, folder, scored.schema)


E1_E6_SQL = f"""
with counts as (select 0 as layer, {_counts_sql('quality', 'toxic')} from labels)
select tn, fp, fn, tp, accuracy, precision, recall, f1_score, roc_auc_score
from ({_metric_sql('counts')})
"""


@register("e1_e6_label_metrics", E1_E6_SQL)
def e1_e6_label_metrics(spark, sf_dir):
    """E1-E6 on ``labels`` (quality = truth, toxic = prediction)."""
    return E.binary_metrics(table(spark, sf_dir, "labels"), "quality", "toxic")


E8_SQL = f"with pairs as ({PAIRS_SQL}) select name1, name2, labels / 5.0::DOUBLE as similarity from pairs"


@register("e8_label_scaling", E8_SQL)
def e8_label_scaling(spark, sf_dir):
    return E.scale_labels(name_pairs(spark, sf_dir))


E1_SQL = f"""
with counts as (select {_counts_sql('quality', 'toxic')} from labels)
select [[tn, fp], [fn, tp]] as confusion_matrix from counts
"""


@register("e1_confusion_matrix_nested", E1_SQL)
def e1_confusion_matrix_nested(spark, sf_dir):
    """E1 in the nested shape ``[[TN, FP], [FN, TP]]``."""
    counts = E.binary_metrics(table(spark, sf_dir, "labels"), "quality", "toxic")
    return E.confusion_matrix(counts).select("confusion_matrix")


# ---------------------------------------------------------------------------
# M9 from a vector table: a name's vector is picked by its length and first letter
# ---------------------------------------------------------------------------

_PICK = "cast(length({n}) * 7 + case when {n} = '' then 0 else ascii({n}) end as bigint) % 100"

M9_SQL = f"""
with {_BASE}, {_N2}, v as (select vec_id, embedding::DOUBLE[] as v from embeddings),
named as (select b1.pair_id, n2a, n2b, x.v as va, y.v as vb from b1
  join v x on x.vec_id = {_PICK.format(n='n2a')} join v y on y.vec_id = {_PICK.format(n='n2b')})
select pair_id, round(case when n2a = n2b then 1.0 else list_cosine_similarity(va, vb) end, 6) as m9_embedding from named
"""


@register("m9_embedding_similarity", M9_SQL)
def m9_embedding_similarity(spark, sf_dir):
    """M9 from a table of vectors keyed by normalised name (stand-in vectors of ``embeddings``)."""
    p = _pairs_ab(spark, sf_dir)
    p = p.select("pair_id", N.n2(F.col("a")).alias("n2a"), N.n2(F.col("b")).alias("n2b"))
    names = p.select(F.col("n2a").alias("name")).union(p.select("n2b")).distinct()
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = names.withColumn("vec_id", F.expr(_PICK.format(n="name"))).join(vectors, "vec_id").select("name", "embedding")
    q = C.table_embedding(keyed)(p, "n2a", "n2b", "m9")
    return q.select("pair_id", _r6(F.col("m9")).alias("m9_embedding"))
