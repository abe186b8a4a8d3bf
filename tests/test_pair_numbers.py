"""Numbers of the rows of pair CSVs without a key."""

from simforge.sources import io as sio


def test_rows_are_numbered_file_by_file_without_a_window(spark, tmp_path):
    for f in range(3):
        body = "".join(f'"{f} a\nb",{i},1\n' for i in range(50 + f))
        (tmp_path / f"p{f}.csv").write_text("name1,name2,labels\n" + body)
    got = sio.read_pairs_csv(spark, str(tmp_path))
    assert got.columns == ["name1", "name2", "labels", "pair_id"]
    rows = got.collect()
    assert len(rows) == 153 and all(r.pair_id == f"p{r.name1[0]}.csv#{r.name2}" for r in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
