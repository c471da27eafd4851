"""Nodes of a graph in files by a hash of their id: results written back rewrite the buckets they touch (survey K9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from .writers import write_back

BUCKETS = 256


def _bucket(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(buckets)).cast("int")


def write_nodes(nodes: DataFrame, path: str, id_col: str = "node_id", buckets: int = BUCKETS) -> None:
    """Writes all nodes, in folders by a hash of their id."""
    dealt = nodes.withColumn("bucket", _bucket(id_col, buckets)).repartition("bucket").sortWithinPartitions("bucket", id_col)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_nodes(spark: SparkSession, path: str, *ids: object, id_col: str = "node_id", buckets: int = BUCKETS) -> DataFrame:
    """All nodes, or those with the given ids: then only their folders are read."""
    nodes = spark.read.parquet(path)
    if not ids:
        return nodes.drop("bucket")
    kind = nodes.schema[id_col].dataType
    wanted = spark.range(1).select(F.explode(F.array(*(F.lit(i).cast(kind) for i in ids))).alias(id_col)).select(_bucket(id_col, buckets).alias("b")).distinct()
    return nodes.filter(F.col("bucket").isin(*(r["b"] for r in wanted.collect())) & F.col(f"`{id_col}`").isin(*ids)).drop("bucket")


def update_nodes(spark: SparkSession, path: str, results: DataFrame, columns: list[str], id_col: str = "node_id", buckets: int = BUCKETS) -> list[int]:
    """Sets the results' ``columns`` on the nodes of equal id, as ``write_back`` does; the buckets that were written.

    Only buckets with a node that a result is for are read whole and written.
    Spark writes them beside the table and puts them in the place of the old
    ones when all tasks are done, so a job that fails leaves the old state. No
    new columns are added, and ids that no node has are ignored.
    """
    unknown = set(columns) - set(spark.read.parquet(path).columns)
    if unknown:
        raise ValueError(f"nodes have no columns {sorted(unknown)}")
    keyed = cut(results.filter(F.col(f"`{id_col}`").isNotNull()).withColumn("bucket", _bucket(id_col, buckets)))
    asked = sorted(r["bucket"] for r in keyed.select("bucket").distinct().collect())  # at most ``buckets``
    nodes = spark.read.parquet(path)
    same = ["bucket", id_col]
    found = nodes.filter(F.col("bucket").isin(*asked or [-1])).select(*same).join(keyed.select(*same).distinct(), same, "left_semi")
    touched = sorted(r["bucket"] for r in found.select("bucket").distinct().collect())
    if not touched:
        return []
    mine = F.col("bucket").isin(*touched)
    new = write_back(nodes.filter(mine), keyed.filter(mine).drop("bucket"), columns, id_col).select(*nodes.columns)
    new = cut(new.repartition("bucket").sortWithinPartitions("bucket", id_col))  # the folders that are read are those that are written
    new.sortWithinPartitions("bucket", id_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched
