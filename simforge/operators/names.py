"""A dictionary of names (P13-P15, K1, M7, M9): what depends on one name is computed once for it.

Pairs repeat names far more often than they repeat themselves, so the
normalised forms, the keyword test and the phonetic code are columns of a
dictionary of distinct names, which is settled as a table and joined to both
sides of the pairs. The pairs are the large side of those joins, keyed by
name; Spark broadcasts a small dictionary and AQE splits the partition of a
name that a third of the pairs hold. The same holds for the vectors of a model
and for the similarity of two phonetic codes, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import similarity as S
from ..session import settled

FORMS = ("n1", "n2", "n3", "business", "code")


def name_dictionary(pairs: DataFrame, a: str, b: str, profile: str) -> DataFrame:
    """``id, name`` and the forms of every name of the two columns (nulls left out)."""
    names = pairs.select(F.col(a).alias("name")).unionAll(pairs.select(F.col(b).alias("name")))
    names = names.where(F.col("name").isNotNull()).distinct()
    name = F.col("name")
    names = names.withColumns({"n1": N.n1(name, profile), "n2": N.n2(name, profile), "n3": N.n3(name, profile),
                               "business": N.has_keyword(name)})
    return settled(names.withColumn("code", S.soundex(F.col("n2"))).withColumn("id", F.monotonically_increasing_id()), "names")


def with_forms(pairs: DataFrame, names: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with ``_ida, _idb`` and the forms of both names, as ``_n1a`` and so on."""
    for column, side in ((a, "a"), (b, "b")):
        own = names.select(F.col("name").alias(f"_name{side}"), F.col("id").alias(f"_id{side}"),
                           *(F.col(f).alias(f"_{f}{side}") for f in FORMS))
        pairs = pairs.join(own, F.col(column) == F.col(f"_name{side}"), "left").drop(f"_name{side}")
    return pairs


def with_vectors(df: DataFrame, a: str, b: str, out: str, vectors: DataFrame) -> DataFrame:
    """Adds ``_{out}_va`` and ``_{out}_vb`` from ``vectors`` (``_k``, ``_v``; one row a name)."""
    others = [c for c, t in df.dtypes if t == "string"]
    for side, name in (("a", a), ("b", b)):
        # rows that don't reach the layer have no name: spread them, they match nothing
        spread = F.concat(F.lit("\x00"), F.xxhash64(*others).cast("string"))
        df = df.withColumn(f"_{out}_key{side}", F.coalesce(F.col(name), spread))
        own = vectors.select(F.col("_k").alias(f"_{out}_k{side}"), F.col("_v").alias(f"_{out}_v{side}"))
        df = df.join(own, F.col(f"_{out}_key{side}") == F.col(f"_{out}_k{side}"), "left")
    return df.drop(*(f"_{out}_{c}{side}" for c in ("key", "k") for side in "ab"))


def embedded_names(df: DataFrame, a: str, b: str, embed_udf) -> DataFrame:
    """``_k, _v``: the model's vector of each name of pairs whose names differ, computed once and settled."""
    differ = df.where(F.col(a) != F.col(b))
    names = differ.select(F.col(a).alias("_k")).unionAll(differ.select(F.col(b).alias("_k"))).distinct()
    return settled(names.withColumn("_v", embed_udf(F.col("_k"))), "name-vectors")


def with_code_similarity(df: DataFrame, code_a: str, code_b: str, out: str) -> DataFrame:
    """M7 through a memo of the distinct pairs of codes (rows without codes get null)."""
    codes = df.select(F.col(code_a).alias("_ca"), F.col(code_b).alias("_cb")).where("_ca is not null and _cb is not null").distinct()
    memo = settled(S.with_jaro_winkler(codes, "_ca", "_cb", out), "code-pairs")
    return df.join(memo, (F.col(code_a) == F.col("_ca")) & (F.col(code_b) == F.col("_cb")), "left").drop("_ca", "_cb")
