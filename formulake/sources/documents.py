"""Readers: LaTeX and PDF files, processed JSON, theorems, formulas, graphs (survey S1-S13, S15)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex

PROCESSED = """source_document string, extraction_metadata struct<extraction_mode:string,pages_processed:int,extraction_date:string>, formulas array<string>,
detailed_formulas array<struct<expression:string,metadata:struct<topic:string,type:string,page:int>,known_identity:string,expected_value:string>>, cleaned_formulas map<string,array<string>>, _corrupt_record string"""
THEOREM = """id string, statement string, sympy_expression string, theorem_type string, assumptions array<string>,
source_lineage struct<original_formula:string,hypothesis_id:string,confidence:double,validation_score:double,generation_method:string,source_type:string,transformation_chain:array<string>>,
natural_language string, symbols array<string>, validation_evidence struct<validation_status:string,pass_rate:double,total_tests:int,symbols_tested:array<string>,validation_time:double>"""


def read_latex(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, blocks, n_formulas is left to the extraction): whole files without comments, and their paragraphs."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), latex.strip_comments(F.col("value")).alias("text"))
    return raw.withColumn("blocks", latex.text_blocks(F.col("text")))


#: How a PDF may be read: its text, its formulas, or both.
MODES = ("text", "formulas", "both")


def read_pdf(spark: SparkSession, path: str, pages: Callable[[bytes], Iterator[str]] | str | None = None, max_pages: int | None = None, mode: str = "both") -> DataFrame:
    """(path, page, text, error) of the pages with ten characters or more; a file that fails gives one row with its error.

    ``pages`` turns a file's bytes into texts, or names one of ``BACKENDS``; the
    first one that is installed is taken where it isn't given. In the mode
    "formulas" pages without a formula sign are left out.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    reader = pages if callable(pages) else (lambda content: _pdf_pages(content, pages))
    schema = "path string, page int, text string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, content in zip(f["path"], f["content"], strict=True):
                try:
                    for i, text in enumerate(reader(bytes(content))):
                        if max_pages is not None and i >= max_pages:
                            break
                        if len(text.strip()) >= 10:
                            out.append((p, i, text, None))
                except Exception as e:  # one file's failure is its own row
                    out.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(run, schema)
    return found if mode != "formulas" else found.filter(F.col("error").isNotNull() | F.col("text").rlike(r"\$|\\\(|\\\[|\\begin\{"))


def pdf_documents(pages: DataFrame, mode: str = "both") -> DataFrame:
    """(path, text, error, extraction_mode, pages_processed): the pages of each file in order, and how many were kept."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    return pages.groupBy("path").agg(ordered.alias("text"), F.max("error").alias("error"), F.lit(mode).alias("extraction_mode"), F.count("page").cast("int").alias("pages_processed"))


def _by_text(content: bytes) -> Iterator[str]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            yield page.get_text()


def _by_layout(content: bytes) -> Iterator[str]:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as doc:
        for page in doc.pages:
            yield page.extract_text() or ""


#: Readers of pages by name: by the text's order, by its layout. Neither library is needed unless PDF files are read.
BACKENDS: dict[str, Callable[[bytes], Iterator[str]]] = {"text": _by_text, "layout": _by_layout}


def _pdf_pages(content: bytes, backend: str | None = None) -> Iterator[str]:
    if backend is not None and backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}")
    for name in [backend] if backend else BACKENDS:
        try:
            return iter(list(BACKENDS[name](content)))
        except ImportError:
            continue
    raise RuntimeError("no PDF library is installed; pass a reader of pages")


def read_any(spark: SparkSession, path: str, kind: str = "auto", pages: Callable[[bytes], Iterator[str]] | None = None) -> DataFrame:
    """(path, text, error) of a file or a folder: of each file by its suffix, .pdf by the PDF reader, others as LaTeX without comments; a file that fails is a row with its error."""
    if kind not in ("auto", "pdf", "latex"):
        raise ValueError(f"unknown source type {kind}")
    if kind == "pdf":
        return pdf_documents(read_pdf(spark, path, pages)).select("path", "text", "error")
    if kind == "latex":
        return read_latex(spark, path).select("path", "text", F.lit(None).cast("string").alias("error"))
    from . import folders

    return folders.cleaned(folders.read_folder(spark, path, "*", backend=pages)).select("path", "text", "error")


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Processed files; unreadable ones keep their row, with _corrupt_record."""
    return spark.read.json(path, schema=PROCESSED, multiLine=True, mode="PERMISSIVE", pathGlobFilter="*.json").withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def flatten_formulas(processed: DataFrame) -> DataFrame:
    """(formula_id, formula, known_identity) of all plain, detailed and cleaned formulas."""
    name = lambda kind: F.concat(F.col("source"), F.lit("_"), kind, F.lit("_"), F.col("i").cast("string")).alias("formula_id")
    plain = processed.select("source", F.posexplode("formulas").alias("i", "f")).select(name(F.lit("formula")), F.col("f").alias("formula"), F.lit(None).cast("string").alias("known_identity"))
    detailed = processed.select("source", F.posexplode("detailed_formulas").alias("i", "d")).select(name(F.lit("detailed")), F.col("d.expression").alias("formula"), F.col("d.known_identity").alias("known_identity"))
    cleaned = processed.select("source", F.explode("cleaned_formulas").alias("variant", "own")).select("source", "variant", F.posexplode("own").alias("i", "f")).select(name(F.col("variant")), F.col("f").alias("formula"), F.lit(None).cast("string").alias("known_identity"))
    return plain.unionByName(detailed).unionByName(cleaned)


def read_theorems(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with their reasons): rows that break the schema's rules are split off, not fatal."""
    file = spark.read.json(path, schema=f"theorems array<struct<{_fields(THEOREM)}>>, _corrupt_record string", multiLine=True, mode="PERMISSIVE")
    rows = file.select(F.explode("theorems").alias("t")).select("t.*")
    return split_valid(rows)


def _fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def theorem_faults() -> Column:
    rate, conf = F.col("validation_evidence.pass_rate"), F.col("source_lineage.confidence")
    bad = {
        "id": ~F.coalesce(F.col("id"), F.lit("")).rlike("^THM_[A-F0-9]{8}$"), "statement": F.length(F.coalesce(F.col("statement"), F.lit(""))) < 1, "pass_rate": ~F.coalesce(rate.between(0, 1), F.lit(False)),
        "confidence": ~F.coalesce(conf.between(0, 1), F.lit(False)), "tests": F.coalesce(F.col("validation_evidence.total_tests"), F.lit(-1)) < 0,
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in bad.items())))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = rows.withColumn("reasons", theorem_faults())
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def read_formulas(spark: SparkSession, path: str, part_items: int | None = None) -> DataFrame:
    """(id, formula, source) from a list of strings, or an object that holds one. Of a document in parts of ``part_items`` the places go on from part to part."""
    text = spark.read.text(path, wholetext=True)
    before = F.col("part").cast("long") * part_items if part_items else F.lit(0)
    own = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.from_json("value", "struct<formulas:array<string>>")["formulas"])
    return text.select(before.alias("before"), F.posexplode(own).alias("i", "formula")).select(F.format_string("FORMULA_%04d", F.col("before") + F.col("i")).alias("id"), "formula", F.lit("processed_data").alias("source"))


def read_graph_json(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, formula): the first of four attributes of a node that isn't empty."""
    node = "id string, formula string, expression string, equation string, math_expression string"
    file = spark.read.json(path, schema=f"nodes array<struct<{_fields(node)}>>", multiLine=True, mode="PERMISSIVE")
    first = F.coalesce(*(F.nullif(F.col(f"n.{c}"), F.lit("")) for c in ("formula", "expression", "equation", "math_expression")))
    return file.select(F.explode("nodes").alias("n")).select(F.col("n.id").alias("node_id"), first.alias("formula")).filter("formula IS NOT NULL")


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, formula): the first data element of a node."""
    schema = "_id string, data array<struct<_VALUE:string,_key:string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(schema).load(path)
    return nodes.select(F.col("_id").alias("node_id"), F.try_element_at(F.filter("data", lambda d: d["_key"].isin("formula", "expression", "equation", "math_expression") & (d["_VALUE"] != "")), F.lit(1))["_VALUE"].alias("formula")).filter("formula IS NOT NULL")


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    h = "hypothesis_id string, hypothesis_type string, status string, formula string, description string, confidence_score double, source_formulas array<string>, transformation_lineage array<string>"
    file = spark.read.json(path, schema=f"hypotheses array<struct<{_fields(h)}>>", multiLine=True, mode="PERMISSIVE")
    return file.select(F.explode("hypotheses").alias("h")).select("h.*")


def read_report_summary(spark: SparkSession, path: str) -> DataFrame:
    """(path, summary, statistics, by_status): the summary, the statistics as JSON, and the number of formulas by status, of each report."""
    summary = "struct<total_formulas:int,validated_formulas:int,passed_formulas:int,failed_formulas:int,error_formulas:int,partial_formulas:int,overall_pass_rate:double,average_confidence:double,validation_time:double>"
    text = spark.read.text(path, wholetext=True)
    one = F.from_json("value", f"struct<summary:{summary},results_by_status:map<string,array<string>>>")
    return text.select(F.col("_metadata.file_path").alias("path"), one.alias("r"), F.get_json_object("value", "$.statistics").alias("statistics")).select("path", "r.summary", "statistics", F.transform_values("r.results_by_status", lambda _, ids: F.size(ids)).alias("by_status"))


def read_validation_report(spark: SparkSession, path: str) -> DataFrame:
    """(formula_id, status, confidence_score, pass_rate, total_tests) of the detailed results."""
    one = "struct<formula:string,status:string,confidence_score:double,pass_rate:double,total_tests:int,passed_tests:int,failed_tests:int,error_tests:int>"
    file = spark.read.json(path, schema=f"detailed_results map<string,{one}>", multiLine=True, mode="PERMISSIVE")
    return file.select(F.explode("detailed_results").alias("formula_id", "r")).select("formula_id", "r.*")
