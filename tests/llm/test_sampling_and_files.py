"""Resampling, fill-in-the-middle and token files against plain versions, on real rows and on edge cases."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from formulake.llm import fim, resampling, tokenfiles, tokens

from . import brute

SCHEMA = "doc_id long, text string, rank string, `run` int, n int, score double, text_2 map<string,int>"
EXTRA = ("x", 1, 2, 3.0, {"a": 1})
LINES = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "a\n\n\nb\n", "é\n漢字\n\n😀 end", " <P> x\ny", "<S>\n", "x<M", "<\n<\nP>\n", "a\r\nb\x0bc\x85d e\n", "  lead and trail \t\n ", "w " * 400, "long\n" * 3000]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    edge = [(10**6 + i, t) for i, t in enumerate([*brute.EDGE, *LINES])]
    same = [(5, "the same words " * 10), (5, "the same words " * 10), (None, "no id but words " * 8), (None, "no id but words " * 8), (None, None)]
    return [*real, *edge, *same]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(7).cache()


def in_order(found):
    return sorted(found, key=str)


@pytest.mark.parametrize(("percent", "grams", "buckets", "min_words"), [(10, 1, 10_000, 20), (37, 3, 97, 0), (100, 2, 1000, 5), (0, 1, 50, 20)])
def test_resampling(spark, sf_dir, rows, table, monkeypatch, percent, grams, buckets, min_words):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 60)
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 500)
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").union(spark.createDataFrame([(None,), ("",)], "text string"))
    got = resampling.resample(table, target, percent, grams, buckets, min_words).collect()
    expected = brute.resampling(rows, [r["text"] for r in target.collect()], percent, grams, buckets, min_words)
    known = [(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got]
    assert in_order(known) == in_order([(key, *x[:3]) for (key, _), x in zip(rows, expected, strict=True)])
    # Rows equal in score and id may change places.
    ranks = {r["rank"]: (r["score"], r["doc_id"]) for r in got if r["rank"] is not None}
    assert ranks == {x[3]: (x[2], key) for (key, _), x in zip(rows, expected, strict=True) if x[3] is not None}
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_resampling_of_empty_tables(spark, table):
    none = table.limit(0)
    assert resampling.resample(none, table).count() == 0
    got = resampling.resample(table, none, percent=50).collect()
    assert len(got) == table.count() and any(r["rank"] for r in got)


def test_ties_fill_many_ranges(spark, monkeypatch):
    """One id and one text for all rows: ranges split them, and the draw is exact."""
    monkeypatch.setattr(resampling, "RANGE_ROWS", 50)
    many = spark.createDataFrame([(7, "one two three")] * 1000, "doc_id long, text string").repartition(6)
    got = resampling.resample(many, many, percent=55, min_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, 551)) and len(got) == 1000


def test_other_ids(spark, rows, sf_dir):
    """Ids that are strings are ordered as strings."""
    few = [(None if k is None else f"d{k}", t) for k, t in rows[:300]]
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = resampling.resample(spark.createDataFrame(few, "doc_id string, text string"), target, 30).collect()
    expected = brute.resampling(few, [r["text"] for r in target.collect()], 30)
    assert {(r["doc_id"], r["rank"]) for r in got} == {(k, x[3]) for (k, _), x in zip(few, expected, strict=True)}


def test_drawn_documents(spark, rows, table, sf_dir):
    own = table.filter("doc_id < 500 AND doc_id <> 5")
    ranks = resampling.resample(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)
    got = resampling.drawn_documents(own.drop("rank"), ranks)
    texts = dict(rows)
    assert {(r["doc_id"], r["rank"]) for r in got.collect()} == {(r["doc_id"], r["rank"]) for r in ranks.collect() if r["rank"]}
    assert all(texts[r["doc_id"]] == r["text"] for r in got.collect())


def test_tournament():
    rng = random.Random(3)
    for runs in (0, 1, 2, 3, 5, 8, 13):
        parts = [sorted((rng.randint(0, 9), i, j) for j in range(rng.randint(0, 6))) for i in range(runs)]
        assert list(resampling.Tournament([iter(x) for x in parts])) == sorted(itertools.chain(*parts))
    endless = [zip(itertools.count(), itertools.repeat(i)) for i in range(3)]
    assert list(itertools.islice(resampling.Tournament(endless), 10)) == sorted((k, i) for k in range(4) for i in range(3))[:10]


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("word", 60, 50), ("char", 100, 0), ("line", 100, 100), ("line", 0, 50)])
def test_fill_in_middle(rows, table, unit, rate, spm):
    made = fim.fill_in_middle(table, unit, rate, spm).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    expected = in_order((k, *brute.fill_in_middle(k, t, unit, rate, spm)) for k, t in rows)
    assert in_order(tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in made) == expected
    assert in_order((r["doc_id"], r["back"]) for r in made) == in_order((k, t or "") for k, t in rows)


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_every_cut(unit):
    """Every number of units, in texts of few characters in any order."""
    import re

    rng = random.Random(unit)
    texts = ["".join(rng.choice("ab \n\té漢😀") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for text in [t for t in [*LINES, *texts] if t is not None]:
        units, runs = re.findall(brute.UNITS[unit], text), fim.Runs(text.encode(), unit)
        assert runs.n == len(units)
        for k in range(len(units) + 1):
            assert runs.end_of(k) == len("".join(units[:k]).encode()), (text, k)


def test_fill_in_middle_of_an_empty_table(table):
    assert fim.fill_in_middle(table.limit(0)).collect() == []


def test_ranks_round_trip(monkeypatch):
    rng = np.random.default_rng(1)
    for size in (4, 64, 1 << 18):
        monkeypatch.setattr(tokenfiles, "SLICE", size)
        for n in (0, 1, 3, 4, 5, 63, 64, 65, 1000):
            own = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 33, n)).astype(np.uint32)
            own[: n // 10] = [0, 0xFF, 0x100, 0xFFFF, 0x10000, 0xFFFFFF, 0x1000000, 0xFFFFFFFF][n % 8]
            control, data = tokenfiles.encode_ranks(own)
            assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in own)
            got = list(tokenfiles.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n))
            assert np.array_equal(np.concatenate(got) if got else np.zeros(0), own)


def expected_files(rows, end=2):
    from tokenizers import Tokenizer

    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*x.ids, end] for x in Tokenizer.from_file(tokens.vocabulary()).encode_batch([t or "" for _, t in ordered], add_special_tokens=False)]
    return [(key, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), x) for (key, _), x in zip(ordered, ids, strict=True)]


@pytest.mark.parametrize("block", [1 << 20, 3000, 1])
def test_token_files(spark, rows, table, tmp_path, monkeypatch, block):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", block)
    monkeypatch.setattr(tokenfiles, "SLICE", 256)
    tokenfiles.write_token_files(table, f"{tmp_path}/files", tokens.vocabulary(), 2)
    assert len(list((tmp_path / "files/ids").glob("part-*"))) > 4
    got = sorted(tokenfiles.read_token_files(spark, f"{tmp_path}/files", with_ids=True).collect(), key=lambda r: r["start"])
    want = expected_files(rows)
    assert [r["doc_id"] for r in got] == [x[0] for x in want]
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    assert in_order((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got) == in_order(want)


def test_frequent_ids_take_one_byte(spark, table, tmp_path):
    tokenfiles.write_token_files(table, f"{tmp_path}/files", tokens.vocabulary(), 2)
    order = np.frombuffer(next((tmp_path / "files/ranks").glob("part-*")).read_bytes()[:-1], "<u4")
    counts = tokenfiles.read_token_files(spark, f"{tmp_path}/files", with_ids=True).select(F.explode("ids").alias("id")).groupBy("id").count().collect()
    assert order.tolist() == [r["id"] for r in sorted(counts, key=lambda r: (-r["count"], r["id"]))]


def test_token_files_of_an_empty_table(spark, table, tmp_path):
    tokenfiles.write_token_files(table.limit(0), f"{tmp_path}/files", tokens.vocabulary(), 2)
    assert tokenfiles.read_token_files(spark, f"{tmp_path}/files").collect() == []


def test_one_id_for_all_rows(spark, tmp_path):
    """A hot id spreads over files."""
    many = spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id string, text string").repartition(8)
    tokenfiles.write_token_files(many, f"{tmp_path}/files", tokens.vocabulary(), 2)
    sizes = [len(x.read_bytes()) for x in (tmp_path / "files/ids").glob("part-*")]
    assert len(sizes) == 8 and max(sizes) < sum(sizes) / 3
    got = tokenfiles.read_token_files(spark, f"{tmp_path}/files", id_type="string").collect()
    assert len(got) == 400 and all(r["doc_id"] is None for r in got) and sorted(r["start"] for r in got)[0] == 0


def test_a_file_that_is_none():
    with pytest.raises(ValueError, match="not a file"):
        list(tokenfiles.read_blocks(b"x" * 100))


def test_binary_survives_the_text_sink(spark, tmp_path):
    """Any bytes, line ends and invalid UTF-8 among them."""
    own = bytes(range(256)) * 3
    rows = spark.createDataFrame(pa.table({"b": pa.array([own, b"\n\r\n"], pa.binary())}).to_pandas(), "b binary").coalesce(1)
    rows.select(F.col("b").cast("string")).write.text(f"{tmp_path}/t")
    found = spark.read.format("binaryFile").load(f"{tmp_path}/t").first()["content"]
    assert bytes(found) == own + b"\n" + b"\n\r\n\n"
