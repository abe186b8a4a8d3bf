"""Readers for the parquet tables and the fixtures derived from them.

Every fixture here is a Spark plan over the given tables, so its size grows
with the tables. The same derivations are available as SQL text
(``*_SQL`` constants) for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Full table read (S7); Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over a table's files. The path is a pattern, since a stream's plain path must be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir.rstrip('/')}/[{name[0]}]{name[1:]}.parquet")


# --------------------------------------------------------------------------
# Name pairs (stand-in for the labelled pair CSV): one row per part, paired
# with the next part; the class of variation comes from p_partkey % 8.
# 0 unrelated, 1 salutation, 2 swapped words, 3 doubled letters,
# 4 keyword conflict, 5 parent suffix, 6 stop word, 7 empty second name.
# Of class 0, p_partkey % 24 = 8 is swapped words with variant tokens (only
# layer 3 can accept it) and 16 the same with a keyword conflict.
# --------------------------------------------------------------------------

PAIRS_SQL = """
select a.p_partkey pair_id,
  case when a.p_partkey%24 in (8,16) then split_part(a.p_name,' ',1) || ' md mohd ' || split_part(a.p_name,' ',2) else
  case a.p_partkey%8 when 1 then 'Mr ' || a.p_name when 4 then a.p_name || ' traders'
       when 5 then a.p_name || ' s/o ' || b.p_name when 6 then a.p_name || ' devi'
       else a.p_name end end name1,
  case when a.p_partkey%24 = 8 then split_part(a.p_name,' ',2) || ' ' || split_part(a.p_name,' ',1) || ' ahmed'
       when a.p_partkey%24 = 16 then split_part(a.p_name,' ',2) || ' ' || split_part(a.p_name,' ',1) || ' traders' else
  case a.p_partkey%8 when 0 then b.p_name
       when 2 then split_part(a.p_name,' ',2) || ' ' || split_part(a.p_name,' ',1)
       when 3 then replace(a.p_name,'l','ll') when 7 then '' else a.p_name end end name2,
  case when a.p_partkey%8 in (1,2,3,5,6) or a.p_partkey%24 = 8 then 1 else 0 end labels
from part a join part b on b.p_partkey = a.p_partkey + 1
"""


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id BIGINT, name1 STRING, name2 STRING, labels INT``."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    a = part.alias("a")
    b = part.select(F.col("p_partkey").alias("b_key"), F.col("p_name").alias("b_name"))
    j = a.join(b, F.col("b_key") == F.col("a.p_partkey") + 1)
    cls = F.col("p_partkey") % 8
    name = F.col("p_name")
    variant = F.col("p_partkey") % 24
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    name1 = (F.when(variant.isin(8, 16), F.concat(first, F.lit(" md mohd "), second))
             .when(cls == 1, F.concat(F.lit("Mr "), name))
             .when(cls == 4, F.concat(name, F.lit(" traders")))
             .when(cls == 5, F.concat(name, F.lit(" s/o "), F.col("b_name")))
             .when(cls == 6, F.concat(name, F.lit(" devi")))
             .otherwise(name))
    name2 = (F.when(variant == 8, F.concat(second, F.lit(" "), first, F.lit(" ahmed")))
             .when(variant == 16, F.concat(second, F.lit(" "), first, F.lit(" traders")))
             .when(cls == 0, F.col("b_name"))
             .when(cls == 2, F.concat(second, F.lit(" "), first))
             .when(cls == 3, F.replace(name, F.lit("l"), F.lit("ll")))
             .when(cls == 7, F.lit(""))
             .otherwise(name))
    labels = F.when(cls.isin(1, 2, 3, 5, 6) | (variant == 8), F.lit(1)).otherwise(F.lit(0))
    pairs = j.select(F.col("p_partkey").alias("pair_id"), name1.alias("name1"),
                     name2.alias("name2"), labels.alias("labels"))
    # one row group of a file is one task, whatever it costs to score its pairs: deal them to all cores
    return pairs.repartition(2 * spark.sparkContext.defaultParallelism)


# Pairs made of one part row alone, for streams: an equality join with the next
# part would need state.
STREAM_PAIRS_SQL = """
select p_partkey pair_id, p_name name1,
  case p_partkey%4 when 0 then p_type when 1 then split_part(p_name,' ',2) || ' ' || split_part(p_name,' ',1)
       when 2 then 'Mr ' || replace(p_name,'l','ll') else split_part(p_name,' ',1) || ' mohd ' || split_part(p_name,' ',2) || ' kumar' end name2,
  0 labels
from part
"""


def stream_pairs(part: DataFrame) -> DataFrame:
    """``pair_id, name1, name2, labels`` of a batch or streaming frame of parts."""
    cls, name = F.col("p_partkey") % 4, F.col("p_name")
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    name2 = (F.when(cls == 0, F.col("p_type")).when(cls == 1, F.concat(second, F.lit(" "), first))
             .when(cls == 2, F.concat(F.lit("Mr "), F.replace(name, F.lit("l"), F.lit("ll"))))
             .otherwise(F.concat(first, F.lit(" mohd "), second, F.lit(" kumar"))))
    return part.select(F.col("p_partkey").alias("pair_id"), name.alias("name1"), name2.alias("name2"), F.lit(0).alias("labels"))


# --------------------------------------------------------------------------
# Embeddings: ``uri`` is the vector id, vectors are read as ARRAY<DOUBLE>.
# --------------------------------------------------------------------------

def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uri BIGINT, embedding ARRAY<DOUBLE>, label INT``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("uri"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label"))


# Every seventh vector is spoilt, so that empty, null, zero and short ones occur.
ODD_SQL = """
select vec_id as uri, label, case vec_id % 28 when 0 then cast([] as double[]) when 7 then null
  when 14 then list_transform(embedding::DOUBLE[], lambda x: 0.0::DOUBLE) when 21 then (embedding::DOUBLE[])[1:10]
  else embedding::DOUBLE[] end as embedding
from embeddings
"""


def odd_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with every seventh vector empty, null, zero or short."""
    e, kind = F.col("embedding"), F.col("uri") % 28
    odd = (F.when(kind == 0, F.array().cast("array<double>")).when(kind == 7, F.lit(None).cast("array<double>"))
           .when(kind == 14, F.transform(e, lambda x: F.lit(0.0))).when(kind == 21, F.slice(e, 1, 10)).otherwise(e))
    return embeddings(spark, sf_dir).withColumn("embedding", odd)
