"""Deep pages against sorted rows, and results written back to the buckets they touch."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from formulake.operators import paging, search
from formulake.sources import nodes as N
from formulake.sources import writers


@pytest.fixture(scope="module")
def paged(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, kind string, x double").repartition(5)
    path = str(tmp_path_factory.mktemp("pages"))
    paging.build_pages(df, path, F.asc_nulls_first("kind"), F.desc("x"), "id", range_rows=150)
    expected = [r["id"] for r in df.orderBy(F.asc_nulls_first("kind"), F.desc("x"), "id").collect()]
    return df, paging.Pages(spark, path), expected


def test_pages(paged):
    df, pages, expected = paged
    assert pages.total == 2000 and len(pages.first) > 10
    for number, size in ((1, 25), (3, 25), (80, 25), (81, 25), (0, 25), (-5, 7), (9999, 7), (1, 5000), (13, 150), (100, 20)):
        got, told = pages.page(number, size)
        want, info = search.page(df, number, size, F.asc_nulls_first("kind"), F.desc("x"), "id")
        assert told == info and [r["id"] for r in got.drop("rank").collect()] == [r["id"] for r in want.collect()]
        assert got.drop("rank").columns == df.columns and got.count() <= size
    assert [r["id"] for r in pages.ranks(140, 470).orderBy("rank").collect()] == expected[140:470]
    assert pages.ranks(5000, 6000).count() == 0


def test_a_page_reads_its_range(paged):
    _, pages, _ = paged
    middle = [k for k, a, n in pages.first if a <= 1000 < a + n]
    got, _ = pages.page(1001, 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(range" in plan and "PushedFilters: [" in plan and "GreaterThanOrEqual(place" in plan
    files = {r[0] for r in pages.ranks(1000, 1001).select(F.input_file_name()).collect()}
    assert len(files) == 1 and f"range={middle[0]}/" in files.pop()


def test_ranges_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "MOST_RANGES", 7, raising=False)
    paging.build_pages(spark.range(3000).withColumn("x", -F.col("id")), str(tmp_path), "x", range_rows=20)
    pages = paging.Pages(spark, str(tmp_path))
    assert pages.total == 3000 and len(pages.first) <= 7 and max(n for _, _, n in pages.first) > 300
    for number in (1, 40, 77, 120):
        got, told = pages.page(number, 25)
        assert [-r["x"] for r in got.collect()] == [*range(2999 - 25 * (number - 1), 2999 - 25 * number, -1)] and told["pages"] == 120


def test_no_rows_to_page(spark, tmp_path):
    paging.build_pages(spark.createDataFrame([], "id int"), str(tmp_path), "id")
    got, told = paging.Pages(spark, str(tmp_path)).page(3, 10)
    assert got.collect() == [] and told == {"page": 1, "pages": 1, "total": 0, "first": 0, "last": 0}


def files(path):
    return {p.relative_to(path).as_posix(): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"f{i}", None, i % 3) for i in range(500)], "node_id int, formula string, status string, other int")
    N.write_nodes(rows, f"{tmp_path}/nodes", buckets=16)
    return rows, f"{tmp_path}/nodes"


def test_only_touched_buckets_are_written(spark, stored):
    rows, path = stored
    before = files(path)
    results = spark.createDataFrame([(7, "good"), (7, "bad"), (31, "good"), (99999, "none"), (None, "none")], "node_id int, status string")
    expected = {r["node_id"]: r["status"] for r in writers.write_back(rows, results, ["status"]).collect()}
    touched = N.update_nodes(spark, path, results, ["status"], buckets=16)
    got = N.read_nodes(spark, path)
    assert {r["node_id"]: r["status"] for r in got.collect()} == expected and expected[7] == "bad" and expected[31] == "good"
    assert got.columns == rows.columns and got.select("node_id", "formula", "other").exceptAll(rows.select("node_id", "formula", "other")).count() == 0
    after = files(path)
    same = {k for k in before if after.get(k) == before[k]}
    assert 1 <= len(touched) <= 2 and {k.split("/")[0] for k in before if k not in same} == {f"bucket={b}" for b in touched} == {k.split("/")[0] for k in after if k not in before}
    one = N.read_nodes(spark, path, 7, 31, buckets=16)
    assert {r["status"] for r in one.collect()} == {"bad", "good"} and "PartitionFilters: [bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_write(spark, stored):
    _, path = stored
    before = files(path)
    assert N.update_nodes(spark, path, spark.createDataFrame([(99999, "x")], "node_id int, status string"), ["status"], buckets=16) == [] and files(path) == before
    with pytest.raises(ValueError, match="no columns"):
        N.update_nodes(spark, path, spark.createDataFrame([(1, "x")], "node_id int, nothing string"), ["nothing"], buckets=16)


def test_a_failed_write_leaves_the_old_state(spark, stored, monkeypatch):
    """A task of the write itself fails after others have written."""
    rows, path = stored
    before = files(path)

    @F.udf("string")
    def fails(x):
        if x == "f400":
            raise ValueError("broken")
        return x

    whole = writers.write_back
    monkeypatch.setattr(N, "write_back", lambda *a: whole(*a).withColumn("formula", fails("formula")))
    monkeypatch.setattr(N, "cut", lambda df: df)
    results = rows.select("node_id", F.lit("new").alias("status"))
    with pytest.raises(Exception, match="broken"):
        N.update_nodes(spark, path, results, ["status"], buckets=16)
    assert files(path) == before and N.read_nodes(spark, path).filter("status IS NOT NULL").count() == 0
    monkeypatch.undo()
    assert len(N.update_nodes(spark, path, results, ["status"], buckets=16)) == 16 and N.read_nodes(spark, path).filter("status = 'new'").count() == 500
