"""On-line pair scoring: the api cascade over a stream of pairs.

Scoring is stateless, so the plan is a projection in append mode, with
stream-static joins where M9's vectors come from a table. Repeated deliveries
are dropped before it by key within a watermark. Each micro-batch goes to a Parquet sink whose
checkpoint makes the output exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.cascade import EmbeddingFn, score_pairs


def score_stream(pairs: DataFrame, embedding: EmbeddingFn, partial_mode: str = "aligned") -> DataFrame:
    """A streaming (or batch) frame of ``name1, name2`` with the layer columns."""
    return score_pairs(pairs, embedding, "api", partial_mode, dedupe=False)


def unique_stream(pairs: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The pairs without repeated deliveries: of equal keys within ``delay`` the first counts.

    The state holds the keys of that span alone; the watermark drops older ones.
    """
    return pairs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def write_scores(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the query; with ``available_now`` it stops when the present input is done."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
