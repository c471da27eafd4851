"""The pipeline: its stages' contracts, and all of it against a plain version."""

import pytest

import corpus_pipeline
from formulake.llm import tokens

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_whole_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps, kept = [], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf_dir)
        if k < 4:
            assert out.schema.names == docs.schema.names, name
        out.write.parquet(str(tmp_path / str(k)))
        steps.append((kept, spark.read.parquet(str(tmp_path / str(k)))))
        kept = steps[-1][1]
    # line dedup: rows stay; near-dedup, decontamination: against brute force on the stage's own input
    assert ids(steps[1][0]) == ids(steps[1][1])
    rows = [(r["doc_id"], r["text"]) for r in steps[1][0].collect()]
    expected = {k: t for (k, _), t in zip(rows, brute.line_dedup(rows), strict=True)}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in steps[1][1].collect()} == {k: (t, len(t)) for k, t in expected.items()}
    rows = sorted(steps[2][0].collect(), key=lambda r: r["doc_id"])
    groups = {}
    for r, c in zip(rows, brute.near_groups([r["text"] for r in rows]), strict=True):
        groups.setdefault(c, r["doc_id"])
    assert ids(steps[2][1]) == set(groups.values()) and steps[2][1].count() == len(groups)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = steps[3][0].collect()
    found = list(brute.decontam([r["text"] for r in rows], items))
    assert ids(steps[3][1]) == {r["doc_id"] for r, x in zip(rows, found, strict=True) if not x[4]}
    packed = steps[4][1].collect()
    assert {r["doc_id"] for r in packed} == ids(steps[4][0])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    total = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in steps[4][0].collect())
    assert sum(r["length"] for r in packed) == total
    whole = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed}


def test_quality_keeps_clean_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = ids(corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir))
    clean = {r["doc_id"] for r in labels.filter("quality = 1 AND toxic = 0").collect()}
    assert len(clean & kept) >= 0.95 * len(clean)


@pytest.mark.parametrize("n", range(5))
def test_stage_edges(spark, sf_dir, n):
    """Nulls, repeated rows, clashing names, empty tables."""
    stage = corpus_pipeline.STAGES[n][1]
    real = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).collect()]
    odd = [(None, "null id " * 30, None, None, None), (10**7, None, "en", "s", None), (10**7 + 1, "", "en", "s", 0), real[0], real[0]]
    docs = spark.createDataFrame(real + odd, SCHEMA)
    names = ["kept", "score", "n_words", "matches", "component_id", "fp", "starts", "key", "id", "t", "part", "length", "base_failed"]
    wide = docs.selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(names)))
    out = stage(spark, wide, sf_dir)
    rows = out.collect()
    if n < 4:
        assert out.columns == wide.columns and all(r[c] == i for r in rows for i, c in enumerate(names))
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if n == 2:
        assert sum(r["doc_id"] == real[0][0] for r in rows) == 1 and {r["doc_id"] for r in rows} >= {None, 10**7} and 10**7 + 1 not in {r["doc_id"] for r in rows}
    if n in (1, 3, 4):
        assert {r["doc_id"] for r in rows} >= {None, 10**7, 10**7 + 1}


def test_near_dedup_by_row(spark, sf_dir):
    """Rows of one id are documents of their own; rows without id take part, after the others."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    a, b, c = word, word.upper().replace("PI", "other"), "quite another text of some more words that nobody else has"
    rows = [(1, a), (5, a), (5, c), (None, a), (None, b + " x"), (None, b + " x"), (7, c), (9, None), (10, ""), (11, " "), (12, "short text"), (13, "Short  text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir).collect()), key=str)
    assert got == sorted([(1, a), (5, c), (None, b + " x"), (9, None), (12, "short text")], key=str)
