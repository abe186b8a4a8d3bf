"""Sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluate as E
from ..session import settled

PAIR_SCHEMA = T.StructType([
    T.StructField("name1", T.StringType()),
    T.StructField("name2", T.StringType()),
    T.StructField("labels", T.IntegerType()),
])

REVIEW_SCHEMA = T.StructType([
    T.StructField("query_file_name", T.StringType()),
    T.StructField("similar_file_name", T.StringType()),
    T.StructField("merchant_id_x", T.StringType()),
    T.StructField("merchant_id_y", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


#: Stands for a quoted empty cell while a file is parsed, to tell it from a missing one.
EMPTY = "\x01"
#: Holds the text of a row that doesn't fit the schema.
CORRUPT = "_corrupt_record"


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = True) -> DataFrame:
    """Header CSV with doubled quotes; an unquoted empty cell is missing (null), a
    quoted one is an empty string. Quoted line breaks make a file one task's work;
    where there are none (``line_breaks=False``) Spark splits it."""
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
          .option("quote", '"').option("escape", '"').option("multiLine", line_breaks)
          .option("columnNameOfCorruptRecord", CORRUPT)
          .option("nullValue", "").option("emptyValue", EMPTY).csv(path))
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(c) == EMPTY, F.lit("")).otherwise(F.col(c)) for c in strings})


def read_csv_parted(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1/S2 with bad rows routed aside: (rows that fit the schema, rejects ``file, record``).

    A row with a cell of the wrong type (a quoted empty number is one), or with too few or too many cells, is a
    reject with its text; nothing becomes null silently. The files are parsed
    once, whole rows, into a settled table that both frames read.
    """
    parsed = _read_csv(spark, path, T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]), line_breaks)
    parsed = settled(parsed.withColumn("_file", F.col("_metadata.file_path")), "csv")
    bad = F.col(CORRUPT).isNotNull()
    return (parsed.where(~bad).select(*schema.names),
            parsed.where(bad).select(F.col("_file").alias("file"), F.rtrim(F.col(CORRUPT), F.lit("\r\n")).alias("record")))


def read_pairs_csv(spark: SparkSession, path: str, schema: T.StructType = PAIR_SCHEMA,
                   key: str | None = None) -> DataFrame:
    """A CSV of name pairs with an explicit schema and a ``pair_id``.

    ``key`` names a column of the file that identifies a pair. Without one the
    pairs are numbered: a multi-line file is read by one task in row order, so
    file name and row number are stable whatever the split settings are.
    """
    if key is not None:
        fields = schema.fields if key in schema.names else [T.StructField(key, T.LongType()), *schema.fields]
        df = _read_csv(spark, path, T.StructType(fields))
        return df.withColumn("pair_id", F.col(key)) if key != "pair_id" else df
    df = _read_csv(spark, path, schema).withColumn("_file", F.input_file_name()).withColumn("_row", F.monotonically_increasing_id())
    df = settled(df, "numbered-csv")  # read once, so that all see the same numbers
    # a file's rows follow each other in its task, so they need no sort: a row's number is its distance from the first
    first = df.groupBy("_file").agg(F.min("_row").alias("_first"))
    below = F.regexp_extract("_file", f"{re.escape(path.rstrip('/'))}/(.+)$", 1)  # its path under the folder that was read
    name = F.when(below == "", F.element_at(F.split("_file", "/"), -1)).otherwise(below)
    numbered = df.join(first, "_file")
    return numbered.select(*schema.names, F.concat_ws("#", name, (F.col("_row") - F.col("_first")).cast("string")).alias("pair_id"))


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """Review table CSV."""
    return _read_csv(spark, path, REVIEW_SCHEMA)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header (one folder of part files)."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def write_layer_audit(frames: dict[int, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """S3: one CSV folder per layer, each with the rows that reached it."""
    for layer, frame in frames.items():
        write_csv(frame, f"{folder}/layer_{layer}", mode)


#: Columns of a batch cascade that a layer adds.
LAYER_COLUMNS = {2: ["Second_Layer_Score", "Second_Layer_Pass"], 3: ["Third_Layer_Pass"]}


def write_layer_audit_once(scored: DataFrame, folder: str, label: str = "labels", mode: str = "overwrite") -> DataFrame:
    """S3 + E7 in one pass over a batch cascade: CSV files parted by ``layer``, and the metrics of the layers.

    A row is written for each layer it reached, with ``Prediction`` as that
    layer decided and the columns of later layers empty. The counts of E7 are
    observed while the rows pass to the writer.
    """
    seen = Observation("layers")
    l1, l2 = F.col("First_Layer_Pass"), F.coalesce(F.col("Second_Layer_Pass"), F.lit(False))
    reached = F.when(l1, F.array(F.lit(1))).when(l2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    rows = scored.observe(seen, *E.layer_counts(label)).withColumn("layer", F.explode(reached))
    verdict = F.when(F.col("layer") == 1, l1).when(F.col("layer") == 2, F.col("Second_Layer_Pass")).otherwise(F.col("Third_Layer_Pass"))
    later = {c: F.when(F.col("layer") >= layer, F.col(c)) for layer, columns in LAYER_COLUMNS.items() for c in columns}
    rows = rows.withColumns({"Prediction": verdict, **later})
    rows.write.mode(mode).partitionBy("layer").option("header", True).option("escape", '"').option("emptyValue", '""').csv(folder)
    counts = seen.get
    spark = scored.sparkSession
    wide = spark.range(1).select(*(F.lit(n).alias(c) for c, n in counts.items()))
    return E.metrics_of_layers(wide)


def read_layer_audit(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of :func:`write_layer_audit_once`; ``schema`` is that of the scored frame."""
    own = T.StructType([*schema.fields, T.StructField("layer", T.IntegerType())])
    return _read_csv(spark, folder, own, line_breaks=True)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """Create-table-as-select, as a parquet folder."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_as_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """S6 with the session catalog."""
    df.write.mode(mode).saveAsTable(name)


def object_table(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """List files under a folder with metadata only.

    ``binaryFile`` returns ``path, modificationTime, length, content``; selecting
    without ``content`` prunes the file bodies from the scan.
    """
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(folder))
    return df.select(F.col("path").alias("uri"),
                     F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("content_type"),
                     F.col("length").alias("size"), F.col("modificationTime").alias("updated"))


def page_objects(pages: DataFrame) -> DataFrame:
    """S5 over a table of fetched pages: object metadata without the bodies."""
    return pages.select(F.col("url").alias("uri"), F.lit("text/html").alias("content_type"),
                        F.length("html").cast("long").alias("size"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """``head`` (a limit is the feature here)."""
    return df.limit(n)
