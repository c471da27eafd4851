"""What the operators of this subpackage share: the shared folder, cut lineage, table access."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a session on one machine names no folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/formulake"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local one on one machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{LOCAL_CHECKPOINTS}/{uuid.uuid4().hex}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder from whatever file system it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def text_keys(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with whole numbers among ``names`` as strings: pandas would turn a column of numbers with nulls to floats."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in names if kinds[c] in _WHOLE})


def keyed_schema(df: DataFrame, *names: str) -> str:
    """Columns of ``text_keys(df, *names)`` for a schema string."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {'string' if kinds[c] in _WHOLE else kinds[c]}" for c in names)


def number_keys(made: DataFrame, df: DataFrame, *names: str) -> DataFrame:
    """``made`` with the types that ``names`` have in ``df``."""
    kinds = dict(df.dtypes)
    return made.withColumns({c: F.col(f"`{c}`").cast(kinds[c]) for c in names if kinds[c] in _WHOLE})
