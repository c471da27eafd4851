"""Folders of LaTeX and PDF files: the data source, pages, errors a file, new files only."""

import pytest
from pyspark.sql import functions as F

from formulake.sources import documents as D
from formulake.sources import folders

SPLIT = "tests.test_folders:by_form_feed"


def by_form_feed(content):
    """Stands for a PDF library: pages are texts with form feeds between."""
    return iter(content.decode("utf-8").split("\x0c"))


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "in"
    (top / "deep").mkdir(parents=True)
    (top / "a.tex").write_text("% gone\nSome text with $x + 1$ in it, é漢.\n")
    (top / "deep" / "b.TXT").write_text("another text, longer")
    (top / "deep" / "c.txt").write_text("another text")
    (top / "d.PDF").write_bytes(b"the first page\x0ctiny\x0cthe third page $y$")
    (top / "bad.tex").write_bytes(b"\xff\xfe not UTF-8")
    (top / "bad.pdf").write_bytes(b"\xff\xfe")
    (top / "large.tex").write_text("x" * 5000)
    (top / "empty.tex").write_text("")
    (top / "other.bin").write_bytes(b"not read")
    return top


def rows(df):
    return {r["path"].rpartition("/")[2]: (r["kind"], r["length"], r["text"], r["pages"], None if r["error"] is None else r["error"].split(":")[0].split(" than")[0]) for r in df.collect()}


EXPECTED = {
    "a.tex": ("latex", 44, "% gone\nSome text with $x + 1$ in it, é漢.\n", None, None), "c.txt": ("latex", 12, "another text", None, None), "d.PDF": ("pdf", 38, "the first page\nthe third page $y$", 2, None),
    "bad.tex": ("latex", 12, None, None, "UnicodeDecodeError"), "bad.pdf": ("pdf", 2, None, None, "UnicodeDecodeError"), "large.tex": ("latex", 5000, None, None, "larger"), "empty.tex": ("latex", 0, "", None, None),
    "b.TXT": ("latex", 20, "another text, longer", None, None),
}
BY_SPARK = {k: v for k, v in EXPECTED.items() if v[1]}  # files of no bytes have no row


def test_format(spark, folder):
    folders.register(spark)
    read = lambda **o: spark.read.format("formula_files").options(backend=SPLIT, maxBytes=1000, **o).load(str(folder))
    assert rows(read()) == EXPECTED
    assert read(partitionBytes=30).rdd.getNumPartitions() > 3 and rows(read(partitionBytes=30)) == rows(read())
    assert rows(read(maxPages=1))["d.PDF"][2:4] == ("the first page", 1)
    assert rows(read(suffixes=".pdf")).keys() == {"d.PDF", "bad.pdf"}


def test_format_reads_what_is_asked_for(spark, folder):
    folders.register(spark)
    few = spark.read.format("formula_files").schema("path string, length long").load(str(folder))
    (folder / "a.tex").chmod(0)
    assert few.columns == ["path", "length"] and few.count() == 8
    pushed = spark.read.format("formula_files").option("backend", "no such").load(str(folder)).filter("kind = 'latex' AND length < 40")
    with pytest.raises(Exception, match="unknown backend"):
        pushed.count()
    pushed = spark.read.format("formula_files").options(backend=SPLIT).load(str(folder)).filter("kind = 'latex' AND length < 40 AND text LIKE '%longer%'")
    assert [r["length"] for r in pushed.collect()] == [20]
    reader = folders.FormulaFiles({"path": str(folder)}).reader(folders.StructType.fromDDL(folders.SCHEMA))
    left = list(reader.pushFilters([folders.EqualTo(("kind",), "pdf"), folders.LessThanOrEqual(("length",), 38), folders.EqualTo(("path",), "x")]))
    assert left == [folders.EqualTo(("path",), "x")] and [n for p in reader.partitions() for _, n in p.files] == [2, 38]
    for bad, error in (("path string, nothing int", "no such columns"), (None, "FileNotFound")):
        with pytest.raises(Exception, match=error):
            (spark.read.format("formula_files").schema(bad).load(str(folder)) if bad else spark.read.format("formula_files").load(f"{folder}/none")).collect()


def test_table_function(spark, folder):
    folders.register(spark)
    spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(str(folder)).createOrReplaceTempView("papers")
    got = spark.sql(f"SELECT right(path, 7) AS p, t.* FROM papers, LATERAL pdf_pages(content, '{SPLIT}') t").collect()
    assert {(r["p"][-5:], r["page"], r["text"], r["error"] is None) for r in got} == {("d.PDF", 0, "the first page", True), ("d.PDF", 2, "the third page $y$", True), ("d.pdf", None, None, False)}
    assert spark.sql(f"SELECT * FROM pdf_pages(NULL, '{SPLIT}')").count() == 0
    missing = spark.sql("SELECT t.error FROM papers, LATERAL pdf_pages(content) t").collect()
    assert len(missing) == 2 and all("no PDF library" in r["error"] for r in missing)


def test_folder(spark, folder):
    got = rows(folders.read_folder(spark, str(folder), backend=by_form_feed, max_bytes=1000))
    assert got == BY_SPARK
    clean = {r["path"].rpartition("/")[2]: r for r in folders.cleaned(folders.read_folder(spark, str(folder), backend=by_form_feed, max_bytes=1000)).collect()}
    assert clean["a.tex"]["text"].startswith("Some text") and clean["a.tex"]["blocks"] and clean["bad.tex"]["blocks"] is None
    texts = {r["path"].rpartition("/")[2]: (r["text"], r["error"] is None) for r in D.read_any(spark, str(folder), pages=by_form_feed).collect()}
    assert texts["d.PDF"][0].startswith("the first") and texts["a.tex"][0].startswith("Some text") and not texts["bad.pdf"][1] and not texts["bad.tex"][1]


def test_new_files_only(spark, folder, tmp_path):
    def run():
        query = folders.follow_folder(spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/checkpoint", backend=by_form_feed, max_bytes=1000)
        query.awaitTermination()
        assert query.exception() is None
        return rows(spark.read.parquet(f"{tmp_path}/out")), spark.read.parquet(f"{tmp_path}/out").count()

    assert run() == (BY_SPARK, 7)
    (folder / "new.tex").write_text("a new file")
    (folder / "new bad.tex").write_bytes(b"\xc3")
    got, n = run()
    assert n == 9 and got["new.tex"][2] == "a new file" and got["new bad.tex"][4] == "UnicodeDecodeError"
    batches = {r["batch"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("batch").count().collect()}
    assert batches == {0: 7, 1: 2} and run()[1] == 9


def test_extraction_of_a_folder(spark, folder):
    """From files to formulas."""
    from formulake.operators import extract

    read = folders.cleaned(folders.read_folder(spark, str(folder), backend=by_form_feed)).filter(F.col("error").isNull())
    found = extract.extract_formulas(read.select(F.col("path").alias("doc_id"), "text"))
    assert {r["expression"].strip() for r in found.collect()} >= {"x + 1"}
