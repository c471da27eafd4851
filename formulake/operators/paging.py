"""Pages of a total order by rank: rows lie in ranges of the order, each with its first rank (survey T5, T6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a range, about; more where there would be too many ranges.
RANGE_ROWS = 100_000
#: Ranges at most. Each is a task, a folder and a row of sizes, which the driver hears of.
MOST_RANGES = 1_000


def build_pages(rows: DataFrame, path: str, *order: Column | str, range_rows: int = RANGE_ROWS) -> None:
    """Writes ``rows`` in ranges of a total order, one folder a range, each row with its place there, and the ranges' sizes beside.

    A large table has ``MOST_RANGES`` of them and more rows in each; a range is
    in order, so the files' statistics lead to a place in it.
    """
    spark = rows.sparkSession
    ranges = min(max(1, -(-rows.count() // range_rows)), MOST_RANGES)
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = dealt.select("*", F.spark_partition_id().alias("range"), (F.monotonically_increasing_id() % (1 << 33)).alias("place"))
    placed.write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    schema = f"{_ddl(rows)}, place bigint, range int"
    sizes = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    spark.createDataFrame([(schema,)], "ddl string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


class Pages:
    """The pages of what ``build_pages`` wrote. The sizes of the ranges, one row each, are read once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.first, self.total = spark, path, [], 0
        self.schema = spark.read.parquet(f"{path}/schema").first()["ddl"]
        for r in sorted(spark.read.parquet(f"{path}/sizes").collect(), key=lambda r: r["range"]):
            self.first.append((r["range"], self.total, r["n"]))
            self.total += r["n"]

    def ranks(self, start: int, stop: int) -> DataFrame:
        """The rows from rank ``start`` (0 is the first) to before ``stop``, with their ``rank``; only ranges that hold some of them are read."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        mine = [(k, a, n) for k, a, n in self.first if a < stop and a + n > start]
        if not mine:
            return rows.limit(0).drop("range").withColumnRenamed("place", "rank")
        within, rank = F.lit(False), None
        for k, a, n in mine:
            within = within | (F.col("range") == k) & F.col("place").between(max(0, start - a), min(n, stop - a) - 1)
            rank = F.when(F.col("range") == k, F.col("place") + a) if rank is None else rank.when(F.col("range") == k, F.col("place") + a)
        places = F.col("range").isin(*(k for k, _, _ in mine)) & F.col("place").between(min(max(0, start - a) for _, a, _ in mine), max(min(n, stop - a) - 1 for _, a, n in mine))
        return rows.filter(places & within).withColumn("rank", rank.cast("long")).drop("range", "place")

    def page(self, number: int, size: int) -> tuple[DataFrame, dict]:
        """One page in order, its number clamped to the pages there are, and where it stands; as ``search.page`` tells it."""
        pages = max(1, -(-self.total // size))
        number = min(max(1, number), pages)
        start, stop = (number - 1) * size, min(number * size, self.total)
        return self.ranks(start, stop).orderBy("rank"), {"page": number, "pages": pages, "total": self.total, "first": start + 1 if self.total else 0, "last": stop}
