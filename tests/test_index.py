"""The written index against scans: substrings, fuzzy words, changes, broken-off steps, streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from formulake.operators import index, search
from formulake.streaming.index import follow_changes

LETTERS = "abAB é漢😀.*\\$^"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice(LETTERS.replace(" ", "")) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    made = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice([None, "", "Two Words", " ".join(rng.choices(words, k=4))]), i % 3) for i in range(300)]
    return [*made, (1000, None, None, 0), (1001, "x", None, 0), (1002, "ab" * 30_000 + "needle in it" + "ab" * 10, "", 0)]


@pytest.fixture(scope="module")
def rows(spark, texts):
    return spark.createDataFrame(texts, "id long, body string, note string, other int").repartition(3).cache()


@pytest.fixture(scope="module")
def own(rows, tmp_path_factory):
    found = index.Index(str(tmp_path_factory.mktemp("index")), ("body", "note"), ("body", "note"), buckets=16)
    index.apply_batch(found, rows)
    return found


def scan(texts, query):
    joined = {t[0]: " ".join(x for x in t[1:3] if x is not None).lower() for t in texts}
    return {k for k, x in joined.items() if query.lower() in x}


def ids(df):
    return {r["id"] for r in df.collect()}


def test_substrings(spark, own, texts):
    rng = random.Random(12)
    queries = ["ab", "é漢", "Two", "o words", "needle", "b" * 41, "😀a", ".*", "zz top", "a", "", "x"]
    for n in (2, 3, 4, 7, 12, 25, 40):
        text = rng.choice([t[1] for t in texts if t[1] and len(t[1]) > n + 1])
        at = rng.randint(0, len(text) - n)
        queries.append(text[at : at + n])
    found = 0
    for q in queries:
        expected = scan(texts, q) if len(q) > 1 else set()
        assert ids(index.substring_search(spark, own, q)) == expected, q
        found += bool(expected)
    assert found > 10


def test_only_the_folders_of_the_query_are_read(spark, own):
    df = index.substring_search(spark, own, "needle")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and re.search(r"PushedFilters: \[.*In\(gram", plan)
    hits = index._read(spark, own, index.segments(spark, own)[1], "grams")
    _, folders = index._keys(spark, own, index.grams(F.lit("needle")), lambda k: F.substring(k, 1, 2))
    read = hits.filter(F.col("bucket").isin(*folders)).select(F.input_file_name().alias("f")).distinct().count()
    assert read < hits.select(F.input_file_name().alias("f")).distinct().count() / 2
    assert index.candidates(spark, own, "needle").count() <= 2
    fuzzy = index.fuzzy_search(spark, own, "two words", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in fuzzy and re.search(r"PushedFilters: \[.*In\(word", fuzzy) and "/rows" not in fuzzy


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.7, 1.0])
def test_fuzzy(spark, own, rows, texts, threshold):
    for q in ("two words", texts[5][1], texts[77][1] + " two", "nothing of it", "", "TWO two Two"):
        got = {(r["id"], round(r["score"], 9)) for r in index.fuzzy_search(spark, own, q, threshold).collect()}
        want = {(r["id"], round(r["score"], 9)) for r in search.fuzzy_search(rows, q, ["body", "note"], threshold).collect() if r["score"] > 0}
        assert got == want, q
    with pytest.raises(ValueError, match="least similarity"):
        index.fuzzy_search(spark, own, "two", 0)


def test_grams(spark):
    got = spark.createDataFrame([("abcab",), ("a",), ("",), ("ab",)], "t string").select(index.grams(F.col("t")).alias("g")).collect()
    assert [sorted(r["g"]) for r in got] == [["ab\0", "abc", "bca", "cab"], [], [], ["ab\0"]]


def test_grams_in_one_pass(spark):
    """Every run of three characters, of whatever length in bytes, by one pattern and not by functions over arrays of characters."""
    given = ["a\nb\r\u2028c", "😀x😀😀é漢", "\0\0\0", "ab" * 6000 + "😀", "".join(random.Random(13).choices(LETTERS + "\n", k=3000)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "id int, t string").select("id", index.grams(F.col("t")).alias("g"))
    expected = {i: None if t is None else sorted({(t + "\0")[k : k + 3] for k in range(len(t) - 1)}) for i, t in enumerate(given)}
    assert {r["id"]: r["g"] and sorted(r["g"]) for r in df.collect()} == expected
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def fresh(tmp_path, name="own"):
    return index.Index(f"{tmp_path}/{name}", ("body", "note"), ("body",), buckets=4)


def state(spark, own):
    return {r["id"]: (r["body"], r["note"]) for r in index.live_rows(spark, own).collect()}


def equal_to_a_rebuild(spark, own, tmp_path):
    rebuilt = fresh(tmp_path, f"rebuilt-{random.random()}")
    index.apply_batch(rebuilt, index.live_rows(spark, own))
    for q in ("new", "ab", "old text", "back", "é漢"):
        assert ids(index.substring_search(spark, own, q)) == ids(index.substring_search(spark, rebuilt, q)), q
        assert sorted(index.fuzzy_search(spark, own, q, 0.2).collect()) == sorted(index.fuzzy_search(spark, rebuilt, q, 0.2).collect())


def test_changes(spark, rows, texts, tmp_path):
    own = fresh(tmp_path)
    index.apply_batch(own, rows)
    index.apply_batch(own, spark.createDataFrame([(3, "new text", "n"), (4, "old text", None), (5000, "new row", ""), (None, "no id", "")], "id long, body string, note string"))
    index.delete(own, spark.createDataFrame([(5,), (6,), (99999,)], "id long"))
    index.apply_batch(own, spark.createDataFrame([(5, "back again", None)], "id long, body string, note string"))
    expected = {t[0]: t[1:3] for t in texts} | {3: ("new text", "n"), 4: ("old text", None), 5000: ("new row", ""), 5: ("back again", None)}
    del expected[6]
    assert state(spark, own) == expected and len(index.segments(spark, own)[1]) == 4
    equal_to_a_rebuild(spark, own, tmp_path)
    index.compact(spark, own)
    index.compact(spark, own)
    assert state(spark, own) == expected and len(index.segments(spark, own)[1]) == 1
    equal_to_a_rebuild(spark, own, tmp_path)
    index.vacuum(spark, own)
    assert {p.name for p in (tmp_path / "own/segments").iterdir()} == {index.segments(spark, own)[1][0][0]} and len(list((tmp_path / "own/manifest").iterdir())) == 1
    index.delete(own, spark.createDataFrame([(3,)], "id long"))
    assert 3 not in state(spark, own) and not ids(index.substring_search(spark, own, "new text"))


def test_a_batch_counts_once(spark, rows, tmp_path):
    own, few = fresh(tmp_path), rows.filter("id < 10")
    index.apply_batch(own, few, batch=7)
    before = index.segments(spark, own)
    index.apply_batch(own, few.withColumn("body", F.lit("other")), batch=7)
    index.apply_batch(own, few.withColumn("body", F.lit("other")), batch=3)
    assert index.segments(spark, own) == before and "other" not in {b for b, _ in state(spark, own).values()}


@pytest.mark.parametrize("step", ["segment", "commit"])
def test_broken_off_steps(spark, rows, tmp_path, monkeypatch, step):
    """A batch or a compaction that breaks off leaves the old state; when repeated it is as if nothing had happened."""
    own, few = fresh(tmp_path), rows.filter("id < 20").select("id", "body", "note")
    index.apply_batch(own, few, batch=0)
    before, changed = state(spark, own), few.filter("id < 5").withColumn("body", F.lit("changed"))

    class BrokenOffError(Exception):
        pass

    def fail(*a):
        raise BrokenOffError

    def half(own, name, rows, heads):
        rows.limit(1).write.mode("overwrite").parquet(own.folder(name, "rows"))
        raise BrokenOffError

    for action in (lambda: index.apply_batch(own, changed, batch=1), lambda: index.compact(spark, own)):
        with monkeypatch.context() as m:
            m.setattr(index, *(("_commit", fail) if step == "commit" else ("_write_segment", half)))
            with pytest.raises(BrokenOffError):
                action()
        assert state(spark, own) == before
        action()
        before = state(spark, own)
        assert before[2][0] == "changed" and len(before) == 20
    equal_to_a_rebuild(spark, own, tmp_path)


def test_an_empty_index(spark, rows, tmp_path):
    own = fresh(tmp_path)
    assert index.segments(spark, own) == (-1, [])
    index.apply_batch(own, rows.limit(0))
    assert state(spark, own) == {} and ids(index.substring_search(spark, own, "ab")) == set() and index.fuzzy_search(spark, own, "ab", 0.5).collect() == []


def test_stream_of_changes(spark, tmp_path):
    schema, own = "id long, version long, op string, body string, note string", fresh(tmp_path)

    def add(name, *changes):
        spark.createDataFrame(changes, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
        query = follow_changes(own, stream, f"{tmp_path}/checkpoint")
        query.awaitTermination()
        assert query.exception() is None

    add("a", (1, 1, "set", "first", None), (2, 1, "set", "second", None), (2, 2, "set", "second, newer", None), (3, 1, None, "third", "n"))
    run()
    assert state(spark, own) == {1: ("first", None), 2: ("second, newer", None), 3: ("third", "n")}
    add("b", (1, 3, "delete", None, None), (3, 0, "set", "too old", None), (4, 5, "set", "fourth", None))
    run()
    index.compact(spark, own)
    add("c", (1, 2, "set", "older than its end", None), (2, 9, "delete", None, None), (4, 6, "set", "fourth again", None))
    run()
    run()
    assert state(spark, own) == {3: ("third", "n"), 4: ("fourth again", None)}
    assert ids(index.substring_search(spark, own, "fourth")) == {4} and not ids(index.substring_search(spark, own, "second"))
    equal_to_a_rebuild(spark, own, tmp_path)
