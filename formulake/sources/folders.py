"""Folders of LaTeX and PDF files: a data source, a table function of pages, and a stream of new files (survey S1-S3, S6).

Each file is read for itself: one that is too large, no UTF-8, or that the PDF
library can't read is a row with its error, and the others are read all the
same. ``read_folder`` and ``follow_folder`` read through Spark, so they reach
any store that Spark does, and files of either kind may stand in one folder. The
format ``formula_files`` opens the files itself, so their folder has to be
mounted on all machines; it deals files to partitions by their sizes, and reads
no file whose kind, size or text isn't asked for.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from importlib import import_module

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import latex
from .documents import BACKENDS, _pdf_pages

#: Pages with fewer characters are left out, as documents have it.
LEAST_CHARS = 10
#: Larger files are rows with an error.
MOST_BYTES = 256 << 20
#: Bytes of the files of a partition, about, and files at most.
PARTITION_BYTES, PARTITION_FILES = 128 << 20, 10_000
SCHEMA = "path string, kind string, length long, text string, pages int, error string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Names of files that are read by default.
PATTERN = "*.{tex,TEX,txt,TXT,pdf,PDF}"

Pages = Callable[[bytes], Iterator[str]]


def pages_of(backend: str | Pages | None) -> Pages:
    """A reader of pages: itself, one of ``BACKENDS``, or a function by its name ``module:function``; otherwise the first that is installed."""
    if callable(backend):
        return backend
    if backend and ":" in backend:
        module, _, name = backend.partition(":")
        return getattr(import_module(module), name)
    if backend and backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}")
    return lambda content: _pdf_pages(content, backend)


def kept_pages(content: bytes, pages: Pages, max_pages: int | None = None) -> Iterator[tuple[int, str]]:
    """(number, text) of the pages with ``LEAST_CHARS`` characters or more, of the first ``max_pages``."""
    for i, text in enumerate(pages(content)):
        if max_pages is not None and i >= max_pages:
            return
        if len(text.strip()) >= LEAST_CHARS:
            yield i, text


def told(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


class PdfPages:
    """Table function ``pdf_pages(content, backend, max_pages)``: (page, text, error) of one PDF file's bytes; a failure is one row."""

    def eval(self, content: bytes, backend: str | None = None, max_pages: int | None = None) -> Iterator[tuple]:
        if content is None:
            return
        try:
            for page, text in kept_pages(bytes(content), pages_of(backend), max_pages):
                yield page, text, None
        except Exception as e:  # one file's failure is its own row
            yield None, None, told(e)


def register(spark: SparkSession) -> None:
    """Makes the format ``formula_files`` and the table function ``pdf_pages`` known to the session."""
    spark.dataSource.register(FormulaFiles)
    spark.udtf.register("pdf_pages", F.udtf(PdfPages, returnType="page int, text string, error string"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def kind_of(path: str) -> str:
    return "pdf" if path.lower().endswith(".pdf") else "latex"


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(files)
        self.files = files


class FormulaFiles(DataSource):
    """``spark.read.format("formula_files").load(folder)``; options: ``suffixes`` (``.tex,.txt,.pdf``), ``maxBytes``, ``partitionBytes``, ``backend``, ``maxPages``. A schema of some of the columns reads those only."""

    @classmethod
    def name(cls) -> str:
        return "formula_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FilesReader(schema, dict(self.options))


class _FilesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns = schema.names
        unknown = set(self.columns) - set(COLUMNS)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.folder = options["path"].removeprefix("file://")
        self.suffixes = tuple(options.get("suffixes", ".tex,.txt,.pdf").lower().split(","))
        self.most, self.bytes = int(options.get("maxbytes", MOST_BYTES)), int(options.get("partitionbytes", PARTITION_BYTES))
        self.backend, self.max_pages = options.get("backend"), int(options["maxpages"]) if "maxpages" in options else None
        self.kind, self.below = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality of ``kind`` and upper bounds of ``length``; the others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kind = f.value if self.kind in (None, f.value) else "none"
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("length",):
                bound = f.value + isinstance(f, LessThanOrEqual)
                self.below = bound if self.below is None else min(self.below, bound)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files in the order of their paths; a partition ends with the file that fills it."""
        if not os.path.exists(self.folder):
            raise FileNotFoundError(self.folder)
        found = [self.folder] if os.path.isfile(self.folder) else sorted(os.path.join(d, x) for d, _, names in os.walk(self.folder) for x in names if not x.startswith((".", "_")) and x.lower().endswith(self.suffixes))
        out, held, size = [], [], 0
        for path in found:
            n = os.path.getsize(path)
            if self.kind not in (None, kind_of(path)) or self.below is not None and n >= self.below:
                continue
            held.append((path, n))
            size += n
            if size >= self.bytes or len(held) >= PARTITION_FILES:
                out.append(_Files(held))
                held, size = [], 0
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:
        opened = bool({"text", "pages", "error"} & set(self.columns))
        pages = pages_of(self.backend)
        for path, n in partition.files:
            row = dict.fromkeys(("text", "pages", "error")) | {"path": path, "kind": kind_of(path), "length": n}
            try:
                if opened and n > self.most:
                    row["error"] = f"larger than {self.most} bytes"
                elif opened:
                    with open(path, "rb") as file:
                        content = file.read()
                    if row["kind"] == "pdf":
                        own = [text for _, text in kept_pages(content, pages, self.max_pages)]
                        row |= {"text": "\n".join(own), "pages": len(own)}
                    else:
                        row["text"] = content.decode("utf-8")
            except Exception as e:  # one file's failure is its own row
                row["error"] = told(e)
            yield tuple(row[c] for c in self.columns)


def read_files(files: DataFrame, backend: str | Pages | None = None, max_bytes: int = MOST_BYTES, max_pages: int | None = None) -> DataFrame:
    """The columns of ``SCHEMA`` for each row of ``files`` (path, length, content, as the format ``binaryFile`` gives them); LaTeX is decoded without Python, too large files aren't read."""
    pages, named = pages_of(backend), files.withColumn("kind", F.when(F.lower("path").endswith(".pdf"), "pdf").otherwise("latex"))
    none = lambda kind: F.lit(None).cast(kind)

    def pdf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for content in f["content"]:
                try:
                    own = [text for _, text in kept_pages(bytes(content), pages, max_pages)]
                    made.append(("\n".join(own), len(own), None))
                except Exception as e:  # noqa: BLE001  one file's failure is its own row
                    made.append((None, None, told(e)))
            yield f.drop(columns="content").assign(**{c: pd.Series([m[k] for m in made], index=f.index, dtype=kind) for k, (c, kind) in enumerate((("text", object), ("pages", "Int32"), ("error", object)))})

    fit = named.filter(F.col("length") <= max_bytes)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    tex = fit.filter("kind = 'latex'").select("path", "kind", "length", text.alias("text"), none("int").alias("pages"), F.when(text.isNull(), F.lit("UnicodeDecodeError: not UTF-8")).alias("error"))
    papers = fit.filter("kind = 'pdf'").select("path", "kind", "length", "content").mapInPandas(pdf, SCHEMA)
    large = named.filter(F.col("length") > max_bytes).select("path", "kind", "length", none("string").alias("text"), none("int").alias("pages"), F.lit(f"larger than {max_bytes} bytes").alias("error"))
    return tex.select(*COLUMNS).unionByName(papers).unionByName(large)


def read_folder(spark: SparkSession, path: str, pattern: str = PATTERN, **how: object) -> DataFrame:
    """One row (``SCHEMA``) for each file of a folder and the folders in it; ``how`` as in ``read_files``. Files of no bytes have no row."""
    return read_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path), **how)


def cleaned(read: DataFrame) -> DataFrame:
    """LaTeX without comments, and the paragraphs of all files; rows with an error have none."""
    text = F.when(F.col("kind") == "latex", latex.strip_comments(F.col("text"))).otherwise(F.col("text"))
    return read.withColumn("text", text).withColumn("blocks", latex.text_blocks(F.col("text")))


def follow_folder(spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = PATTERN, **how: object) -> StreamingQuery:
    """Reads the files of a folder that no run before has seen, and adds their rows to the table at ``out``.

    The stream's checkpoint remembers the files. A batch that is run again after
    a failure overwrites its own folder, so every file has one row.
    """

    def add(batch: DataFrame, number: int) -> None:
        read_files(batch, **how).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
