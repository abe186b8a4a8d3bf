"""One budget of false rejections for all rules of a stratum."""

import math
import random

from simforge.llm import frames, quality_rules


def judged(spark, docs, labels):
    measured = frames.settled(quality_rules.measure(docs, ["doc_id", "lang"]), "m")
    chosen = quality_rules.joint_cutoffs(measured, labels)
    return chosen.collect(), quality_rules.decide(measured, chosen)


def test_separable_junk_of_a_given_table_is_rejected(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = frames.documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    _, found = judged(spark, docs, labels)
    rows = found.join(labels, "doc_id").filter("not __base_failed").selectExpr("lang", "quality", "__kept", "10 * __n_symbols > __n_words as symbols").collect()
    junk = [r for r in rows if r.quality == 0 and r.symbols]
    assert len(junk) > 250 and not any(r["__kept"] for r in junk)
    for lang in {r.lang for r in rows}:
        good = [r["__kept"] for r in rows if r.lang == lang and r.quality == 1]
        assert good.count(False) <= 0.01 * len(good)


def made_up(seed, sizes, labelled, junk=True):
    """Documents of the given strata; a fifth is bad, most of it with symbols."""
    rng = random.Random(seed)
    rows, labels = [], []
    for lang, size in sizes.items():
        for _ in range(size):
            bad, i = rng.random() < 0.2, len(rows)
            words = [rng.choice("abcdefghij") * rng.randint(2, 9) + str(rng.random()) for _ in range(rng.randint(12, 30))]
            words += [f"##{rng.random()}" for _ in range(rng.randint(10, 30))] if junk and bad else []
            rows.append((i, " ".join(words), lang))
            if rng.random() < labelled:
                labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def results(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen, found = judged(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept, quality = {r.doc_id: r["__kept"] for r in found.collect()}, {i: q for i, q, _ in labels}
    return chosen, {(lang, q): [kept[i] for i, _, own in rows if own == lang and quality.get(i) == q] for _, _, lang in rows for q in (0, 1)}


def test_strata_with_enough_labels_get_cutoffs(spark):
    chosen, kept = results(spark, *made_up(1, {"en": 2000, None: 1500, "xx": 200}, 0.45))
    assert {(r.stratum, r.rule) for r in chosen} == {("en", "symbols"), (None, "symbols")}
    for lang in ("en", None):
        assert kept[lang, 0].count(True) <= 0.05 * len(kept[lang, 0]) and all(kept[lang, 1])
    assert all(kept["xx", 0])  # fewer than 299 good labels


def test_a_table_with_labels_alone_lends_half_to_the_design(spark):
    chosen, kept = results(spark, *made_up(2, {"en": 1200}, 1.0))
    assert [r.rule for r in chosen] == ["symbols"] and not any(kept["en", 0]) and all(kept["en", 1])


def test_inseparable_junk_costs_few_good_documents(spark):
    _, kept = results(spark, *made_up(3, {"en": 2500}, 0.45, junk=False))
    assert kept["en", 1].count(False) <= 0.01 * len(kept["en", 1])


def test_walk_stops_at_the_first_unsafe_place():
    for n, level in ((298, 0.05), (299, 0.05), (435, 0.0125), (436, 0.0125), (2000, 0.0125)):
        tail = lambda k: sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))  # noqa: E731, B023
        allowed = max((k for k in range(n // 100 + 1) if tail(k) <= level), default=-1)
        assert quality_rules.walk({}, n, level, 0.01) == (None if allowed >= 0 else -1)
        good = {3 * i: 1 for i in range(30)}
        assert quality_rules.walk(good, n, level, 0.01) == 3 * max(allowed, 0)
