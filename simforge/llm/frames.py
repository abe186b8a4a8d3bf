"""Helpers shared by the operators: document keys and tables settled in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id, which therefore sorts before every other id.
NO_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where Spark itself is one local JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="simforge-"))
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/simforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(k, t, doc_id, text): (k, t) names a document.

    k is doc_id, with the smallest long for null. t is 0 while ids are unique; where
    rows share an id, t is a hash of the text, so that rows equal in id and text are
    one document and rows equal in id alone are different ones.
    """
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    out = docs.select(k.alias("k"), "doc_id", "text")
    twice = docs.select(k.alias("k")).groupBy("k").count().filter("count > 1").limit(1).count()
    return out.withColumn("t", F.xxhash64("text") if twice else F.lit(0).cast("long")).select("k", "t", "doc_id", "text")


def fits(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions for so many rows, never below the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


#: Bytes of a settled table up to which it is broadcast; beyond them Spark sorts both sides.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes) -> DataFrame:
    """A settled table, marked for broadcast if the bytes of its rows, by the expression ``row_bytes``, are few."""
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
