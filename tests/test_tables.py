"""Sources, sinks, review table, streaming and the entry module."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from simforge.operators import cascade as C, evaluate as E, review as R
from simforge.session import shared_folder
from simforge.sources import io as sio
from simforge.sources.tables import name_pairs, stream_pairs, table, table_stream
from simforge.streaming.scoring import score_stream, write_scores

from .conftest import SF

PAIRS = [('say "hi"', "two\nlines", 1), ("a,b", "", 0), ("plain", None, None), ("x", "y", 1)]


def test_pair_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "pairs")
    sio.write_csv(spark.createDataFrame(PAIRS, "name1 string, name2 string, labels int").coalesce(1), path)
    got = sio.read_pairs_csv(spark, path)
    rows = {r.name1: r for r in got.collect()}
    assert rows['say "hi"'].name2 == "two\nlines" and rows["a,b"].labels == 0 and rows["plain"].labels is None
    assert len({r.pair_id for r in rows.values()}) == 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        again = {r.name1: r.pair_id for r in sio.read_pairs_csv(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert again == {k: r.pair_id for k, r in rows.items()}


def test_pair_csv_with_a_key(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,name1,name2,labels\n7,"a ""b""",c,1\n')
    got = sio.read_pairs_csv(spark, str(tmp_path / "p.csv"), key="id").first()
    assert (got.pair_id, got.name1) == (7, 'a "b"')


def test_review_csv_tells_empty_from_missing(spark, tmp_path):
    head = "query_file_name,similar_file_name,merchant_id_x,merchant_id_y,labels,score\n"
    (tmp_path / "r.csv").write_text(head + 'a,b,1,2,"",0.5\nc,d,1,2,,0.5\n')
    got = {r.query_file_name: r.labels for r in sio.read_review_csv(spark, str(tmp_path / "r.csv")).collect()}
    assert got["c"] is None and got["a"] == ""


def test_csv_rejects(spark, tmp_path):
    body = 'name1,name2,labels\na,"",1\n"x, ""y""",z,two\nonly one\n"",b,\nc,d,3,more\n"line\nbreak",e,4\n'
    (tmp_path / "p.csv").write_text(body)
    good, bad = sio.read_csv_parted(spark, str(tmp_path / "p.csv"), sio.PAIR_SCHEMA)
    assert sorted(map(tuple, good.collect()), key=str) == sorted([("a", "", 1), ("", "b", None), ("line\nbreak", "e", 4)], key=str)
    rejects = bad.collect()
    assert sorted(r.record for r in rejects) == ['"x, ""y""",z,two', "c,d,3,more", "only one"]
    assert all(r.file.endswith("p.csv") for r in rejects)


def test_splittable_csv_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name1,name2,labels\n" + "".join(f"a{i},b,{i}\n" for i in range(5000)) + "z,b,x\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert sio._read_csv(spark, str(tmp_path / "p.csv"), sio.PAIR_SCHEMA, line_breaks=False).rdd.getNumPartitions() > 4
        good, bad = sio.read_csv_parted(spark, str(tmp_path / "p.csv"), sio.PAIR_SCHEMA, line_breaks=False)
        assert good.count() == 5000 and good.agg({"labels": "sum"}).first()[0] == sum(range(5000)) and [r.record for r in bad.collect()] == ["z,b,x"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_audit_in_one_pass(spark, tmp_path):
    scored = C.score_pairs(name_pairs(spark, SF), C.trigram_embedding, "batch")
    metrics = sio.write_layer_audit_once(scored, str(tmp_path / "audit"))
    back = sio.read_layer_audit(spark, str(tmp_path / "audit"), scored.schema)
    for layer, frame in C.layer_frames(scored).items():
        own = back.where(F.col("layer") == layer).select(*frame.columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, frame.collect()))
    assert sorted(map(tuple, metrics.collect())) == sorted(map(tuple, E.layer_metrics(scored).collect()))


def test_positions_of_skewed_and_empty_tables(spark):
    from simforge.operators import positions as P

    rows = spark.range(0, 3000, 1, 7).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 11).alias("k"), "id")
    got = P.numbered(rows, "k", "id").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 3001)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    own = P.numbered(rows).orderBy("position").collect()
    assert [r.id for r in own] == list(range(3000))
    assert P.numbered(rows.limit(0), "k").count() == 0
    both = P.concat_by_position(rows.select("id"), spark.range(5).select(F.col("id").alias("x")), ("id",), ("x",)).orderBy("position").collect()
    assert len(both) == 3000 and [(r.id, r.x) for r in both[:6]] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, None)]


def test_layer_audit_and_enriched_sinks(spark, tmp_path):
    scored = C.score_pairs(name_pairs(spark, SF), C.trigram_embedding, "batch").cache()
    frames = C.layer_frames(scored)
    sio.write_layer_audit(frames, str(tmp_path / "audit"))
    for layer, frame in frames.items():
        back = spark.read.option("header", True).csv(str(tmp_path / "audit" / f"layer_{layer}"))
        assert back.columns == frame.columns and back.count() == frame.count()
    scored.unpersist()
    enriched = C.enrich_pairs(name_pairs(spark, SF), C.trigram_embedding)
    sio.write_csv(enriched, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == enriched.columns


def test_create_table_as_select(spark, tmp_path):
    df = name_pairs(spark, SF)
    sio.write_parquet(df, str(tmp_path / "t"), partition_by=["labels"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == df.count()
    assert spark.read.parquet(str(tmp_path / "t")).filter("labels = 1").count() == df.filter("labels = 1").count()


def test_object_table_prunes_content(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"12345")
    (tmp_path / "y.txt").write_bytes(b"1")
    df = sio.object_table(spark, str(tmp_path), "*.jpg")
    assert [(r.content_type, r.size) for r in df.collect()] == [("jpg", 5)]


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


REVIEWS = [("a.jpg", "b.jpg", "m1", "m2", "old", 0.5), ("a.jpg", "c.jpg", "m1", None, None, None), (None, "d.jpg", "m1", "m4", "x", 1.0)]
SCHEMA = "query_file_name string, similar_file_name string, merchant_id_x string, merchant_id_y string, labels string, score double"


def test_review_operators(spark):
    reviews = spark.createDataFrame(REVIEWS, SCHEMA)
    urls = R.object_url_columns(R.object_url_columns(reviews, "https://h/f"), "https://h/f/")
    assert {r.query_image_url for r in urls.collect()} == {"https://h/f/a.jpg", None}
    assert R.with_default_column(reviews.drop("labels")).filter("labels = ''").count() == 3
    assert R.with_default_column(reviews).filter("labels = 'old'").count() == 1
    corrections = spark.createDataFrame(
        [("a.jpg", "b.jpg", 1, "first", "9"), ("a.jpg", "b.jpg", 2, "", None), ("a.jpg", "c.jpg", 1, None, ""), ("zz", "b.jpg", 1, "n", "n"), (None, "d.jpg", 1, "n", "n")],
        "query_file_name string, similar_file_name string, submitted int, labels string, score string")
    got = {(r.query_file_name, r.similar_file_name): (r.labels, r.score) for r in R.overlay_corrections(reviews, corrections).collect()}
    assert got == {("a.jpg", "b.jpg"): ("", "9"), ("a.jpg", "c.jpg"): (None, ""), (None, "d.jpg"): ("x", "1.0")}
    assert R.review_table(urls).columns == R.REVIEW_COLUMNS
    assert R.overlay_corrections(reviews.limit(0), corrections).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    part = table(spark, SF, "part")
    scored = score_stream(stream_pairs(table_stream(spark, SF, "part")), C.trigram_embedding)
    assert scored.isStreaming
    query = write_scores(scored, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    batch = C.score_pairs(stream_pairs(part), C.trigram_embedding, "api").select(scored.columns)
    got = spark.read.schema(scored.schema).parquet(str(tmp_path / "out"))
    assert got.count() == part.count() and got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and "v10_all_pairs_top10" in queries


@pytest.mark.parametrize("name", ["p1_p15_normalize_names", "k2_k4_pair_tests", "c6_api_cascade", "e1_e6_label_metrics", "r3_overlay_corrections", "v3_dedupe_embeddings"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "supplier", "nation", "part", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = __spark_entry__.queries()[name](spark, SF)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    order = [[d[0] for d in found.description].index(c) for c in df.columns]
    show = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    assert sorted([show(r[i]) for i in order] for r in found.fetchall()) == sorted([show(v) for v in r] for r in df.collect())


def test_object_files_by_metadata(spark):
    from simforge.plans.source_queries import s5_object_files

    got = {r.object: r.size for r in s5_object_files(spark, SF).collect()}
    assert got["part.parquet"] == os.path.getsize(f"{SF}/part.parquet")


def test_dedupe_takes_the_first_row_of_an_id(spark):
    from simforge.operators import vector_search as vs

    rows = [("a", None, 3), ("a", 2.0, 5), ("a", 2.0, 4), ("b", None, None), (None, 1.0, 1), (None, 0.5, 9)]
    got = vs.dedupe_by_uri(spark.createDataFrame(rows, "uri string, x double, y int"), "uri", ["x"])
    assert got.columns == ["uri", "x", "y"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 2.0, 4), ("b", None, None), (None, 0.5, 9)], key=str)


def test_pairs_of_one_row_group_go_to_all_cores(spark, tmp_path):
    """A file of one row group is read by one task; scoring its pairs must not stay there."""
    parts = [(i, f"name{i} of part") for i in range(1, 401)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pairs = name_pairs(spark, str(tmp_path))
    held = pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(held) == 399 and sum(n > 0 for n in held) >= spark.sparkContext.defaultParallelism
