"""Registered streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.embed import char_count_model, embed
from ..operators import cascade as C
from ..session import settled, shared_folder
from ..sources.tables import STREAM_PAIRS_SQL, stream_pairs, table, table_stream
from ..streaming.scoring import score_stream, unique_stream, write_scores
from .catalog import register
from .name_queries import MODE, STAND_IN, api_cascade_sql

_SELECT = """select pair_id, l1pass::INTEGER as First_Layer_Pass,
       round(s2, 6) as Second_Layer_Score, s2 >= {threshold} as Second_Layer_Pass, l3pass as Third_Layer_Pass,
       (l1pass or coalesce(s2 >= {threshold}, false) or coalesce(l3pass, false))::INTEGER as Prediction""".format(
    threshold=C.K.LAYER2_THRESHOLD)
C9_SQL = api_cascade_sql(_SELECT, STREAM_PAIRS_SQL)


def _written(spark, scored):
    """The scores that an availableNow stream writes."""
    folder = f"{shared_folder(spark)}/simforge/stream-{uuid.uuid4().hex}"
    write_scores(scored, f"{folder}/scores", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema(scored.schema).parquet(f"{folder}/scores")
    return out.select("pair_id", "First_Layer_Pass", F.round("Second_Layer_Score", 6).alias("Second_Layer_Score"),
                      "Second_Layer_Pass", "Third_Layer_Pass", "Prediction")


@register("c9_stream_scoring", C9_SQL)
def c9_stream_scoring(spark, sf_dir):
    """Pairs made of each streamed part row, scored and written by an availableNow stream."""
    return _written(spark, score_stream(stream_pairs(table_stream(spark, sf_dir, "part")), STAND_IN, MODE))


DIM = 16


def _count_cosine(a: str, b: str) -> str:
    def counts(x: str) -> str:
        return (f"list_transform(range({DIM}), lambda d: len(list_filter(string_split({x}, ''), "
                f"lambda c: c <> '' and unicode(c) % {DIM} = d))::DOUBLE)")

    def dot(x: str, y: str) -> str:
        return f"list_inner_product({counts(x)}, {counts(y)})"

    return f"(case when {a} = {b} then 1.0::DOUBLE else {dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0) end)"


@register("c9_stream_with_vectors", api_cascade_sql(_SELECT, STREAM_PAIRS_SQL, _count_cosine))
def c9_stream_with_vectors(spark, sf_dir):
    """C9 + M9 from a table of a model's vectors; every pair is delivered twice, of which the stream drops one."""
    own = stream_pairs(table(spark, sf_dir, "part"))
    names = own.select(N.n2(F.col("name1"), "api").alias("name")).unionAll(own.select(N.n2(F.col("name2"), "api").alias("name")))
    vectors = embed(names.distinct(), "name", char_count_model(DIM), DIM, out="embedding")
    pairs = stream_pairs(table_stream(spark, sf_dir, "part")).withColumn("sent", F.timestamp_seconds(86_400 + F.col("pair_id") * 60))
    twice = pairs.withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_n")
    unique = unique_stream(twice, "pair_id", "sent", "1 hour").drop("sent")
    return _written(spark, score_stream(unique, C.table_embedding(settled(vectors, "vectors"), missing="undecided"), MODE))
