"""Registered queries of sources, sinks and row positions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import positions as P
from ..session import shared_folder
from ..sources import io as sio
from ..sources.tables import PAIRS_SQL, name_pairs, table
from .catalog import register

# Some names hold quotes, commas and line breaks, some are missing or empty, and some rows have a label that is no number.
_AWKWARD = f"""
select case when pair_id % 5 = 0 then name1 || ' "q", ' || chr(10) || 'x' else name1 end as name1,
  case when pair_id % 7 <> 0 then name2 end as name2, labels, pair_id % 8 = 1 and pair_id % 5 <> 0 and pair_id % 7 <> 0 as bad
from ({PAIRS_SQL})
"""
S1_SQL = f"""
select case when not bad then name1 end as name1, case when not bad then name2 end as name2, case when not bad then labels end as labels,
  case when bad then name1 || ',' || name2 || ',none' end as record
from ({_AWKWARD})
"""


def _awkward(spark, sf_dir, breaks: str):
    n, name1 = F.col("pair_id"), F.col("name1")
    bad = (n % 8 == 1) & (n % 5 != 0) & (n % 7 != 0)
    return name_pairs(spark, sf_dir).select(
        F.when(n % 5 == 0, F.concat(name1, F.lit(f' "q", {breaks}x'))).otherwise(name1).alias("name1"),
        F.when(n % 7 != 0, F.col("name2")).alias("name2"), F.when(bad, F.lit("none")).otherwise(F.col("labels").cast("string")).alias("labels"))


def _round_trip(spark, rows, line_breaks: bool):
    path = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    sio.write_csv(rows, path)
    good, rejects = sio.read_csv_parted(spark, path, sio.PAIR_SCHEMA, line_breaks)
    return good.withColumn("record", F.lit(None).cast("string")).unionByName(rejects.select("record"), allowMissingColumns=True)


@register("s1_csv_round_trip", S1_SQL)
def s1_csv_round_trip(spark, sf_dir):
    """S1 + S4: pairs written as CSV and read back, the rows that don't fit the schema as rejects."""
    return _round_trip(spark, _awkward(spark, sf_dir, "\n"), line_breaks=True)


@register("s1_csv_splittable", S1_SQL.replace("|| chr(10) ", ""))
def s1_csv_splittable(spark, sf_dir):
    """The same where no cell holds a line break, so that Spark may split the files."""
    return _round_trip(spark, _awkward(spark, sf_dir, ""), line_breaks=False)


S6_SQL = "select vec_id as uri, label, len(embedding)::INTEGER as dim from embeddings where label in (1, 3)"


@register("s6_create_table_as_select", S6_SQL)
def s6_create_table_as_select(spark, sf_dir):
    """S6 + S7: a partitioned table made from a query, of which two partitions are read."""
    path = f"{shared_folder(spark)}/ctas-{uuid.uuid4().hex}"
    made = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uri"), "label", F.size("embedding").alias("dim"))
    sio.write_parquet(made, path, partition_by=["label"])
    return spark.read.schema(made.schema).parquet(path).where(F.col("label").isin(1, 3)).select("uri", "label", "dim")


@register("o4_global_row_number", """
select row_number() over (order by c_nationkey desc, c_custkey) as position, c_custkey, c_nationkey from customer
""")
def o4_global_row_number(spark, sf_dir):
    """A position over the whole table, from counts of sorted partitions."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return P.numbered(rows, F.col("c_nationkey").desc(), F.col("c_custkey").asc())


@register("j3_concat_by_position", """
with c as (select row_number() over (order by c_custkey desc) as position, c_name from customer),
s as (select row_number() over (order by s_name) as position, s_name from supplier)
select coalesce(c.position, s.position) as position, c_name, s_name from c full join s on s.position = c.position
""")
def j3_concat_by_position(spark, sf_dir):
    """Two tables side by side, row by row."""
    customers, suppliers = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "supplier").select("s_name")
    both = P.concat_by_position(customers, suppliers, (F.col("c_custkey").desc(),), ("s_name",))
    return both.select("position", "c_name", "s_name")


@register("s5_object_files")
def s5_object_files(spark, sf_dir):
    """The files under a folder as objects, by their metadata alone (SQL has no such scan)."""
    files = sio.object_table(spark, sf_dir, "*.parquet")
    return files.select(F.element_at(F.split("uri", "/"), -1).alias("object"), "content_type", "size")
