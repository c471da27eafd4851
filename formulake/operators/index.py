"""A written index for substrings and fuzzy words that follows changes (survey F10, X6, X10).

The index is a folder of segments. A batch of changes adds one: its rows, the
ids it sets or deletes, and postings in folders by a hash of their key, so a
search reads the folders of its own keys only. What a later segment sets or
deletes outdates all earlier postings of the id; nothing is rewritten until
``compact`` joins the segments into one. A batch counts once the manifest names
its segment, and a batch that the manifest knows is not applied again, so any
step can break off and be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a text that are taken apart at once.
CHUNK = 10_000
#: Columns of postings, besides id and folder.
POSTINGS = {"grams": "gram string", "words": "field string, n int, word string"}


@dataclass(frozen=True)
class Index:
    """``fields`` are searched for substrings, joined by spaces in this order, ``words`` for similar sets of words; other columns aren't kept."""

    path: str
    fields: tuple[str, ...]
    words: tuple[str, ...] = ()
    id_col: str = "id"
    buckets: int = 64

    def columns(self) -> list[str]:
        return list(dict.fromkeys((self.id_col, *self.fields, *self.words)))

    def text(self) -> Column:
        return F.lower(F.concat_ws(" ", *(F.col(f"`{c}`") for c in self.fields)))

    def folder(self, segment: str, what: str) -> str:
        return f"{self.path}/segments/{segment}/{what}"


def grams(text: Column) -> Column:
    """All runs of three characters, with an end mark after the last, so the last two begin one as well.

    One pass of a pattern that looks three characters ahead and moves on by one.
    """
    return F.array_distinct(F.regexp_extract_all(F.concat(text, F.lit("\0")), F.lit("(?s)(?=(...))."), F.lit(1)))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def _bucket(index: Index, key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(index.buckets)).cast("int")


def segments(spark: SparkSession, index: Index) -> tuple[int, list[tuple[str, int]]]:
    """The manifest's version, and (name, last batch) of its segments in order; -1 and none before the first batch."""
    try:
        last = spark.read.parquet(f"{index.path}/manifest").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, []
    return last["version"], [(s["name"], s["upto"]) for s in last["segments"]]


def _commit(spark: SparkSession, index: Index, version: int, own: list[tuple[str, int]]) -> None:
    spark.createDataFrame([(own,)], "segments array<struct<name:string,upto:long>>").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/manifest/version={version}")


def _read(spark: SparkSession, index: Index, own: list[tuple[str, int]], what: str) -> DataFrame:
    """One kind of table of all given segments, with the last batch of its segment as ``upto``."""
    reader = spark.read
    if what in POSTINGS:  # a segment without rows has no files of them
        kind = spark.read.parquet(index.folder(own[0][0], "heads")).schema["id"].dataType.simpleString()
        reader = reader.schema(f"id {kind}, {POSTINGS[what]}, bucket int")
    found = [reader.parquet(index.folder(name, what)).withColumn("upto", F.lit(upto)) for name, upto in own]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def _write_segment(index: Index, name: str, rows: DataFrame, heads: DataFrame) -> None:
    """``rows`` with the index's columns, ``heads`` (id, version) of all ids that the segment sets or deletes."""
    spark, key = rows.sparkSession, F.col(f"`{index.id_col}`").alias("id")
    rows.write.mode("overwrite").parquet(index.folder(name, "rows"))
    heads.write.mode("overwrite").parquet(index.folder(name, "heads"))
    own = spark.read.parquet(index.folder(name, "rows"))

    def put(postings: DataFrame, by: Column, order: str, what: str) -> None:
        dealt = postings.withColumn("bucket", _bucket(index, by)).hint("rebalance", "bucket")  # frequent keys are split
        dealt.sortWithinPartitions("bucket", order).write.mode("overwrite").partitionBy("bucket").parquet(index.folder(name, what))

    text = own.select(key, index.text().alias("t"))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("t") - 1, F.lit(0)) / CHUNK).cast("int"))
    parts = text.select("id", "t", F.explode(starts).alias("k")).select("id", F.substring("t", F.col("k") * CHUNK + 1, F.lit(CHUNK + 2)).alias("part"))
    put(parts.select("id", F.explode(grams(F.col("part"))).alias("gram")), F.substring("gram", 1, 2), "gram", "grams")
    if index.words:
        each = F.array(*(F.struct(F.lit(c).alias("field"), word_set(F.col(f"`{c}`")).alias("w")) for c in index.words))
        sets = own.select(key, F.explode(each).alias("f"))
        put(sets.select("id", "f.field", F.size("f.w").alias("n"), F.explode("f.w").alias("word")), F.col("word"), "word", "words")


def apply_batch(index: Index, rows: DataFrame, deleted: DataFrame | None = None, batch: int | None = None, version: str | None = None) -> None:
    """Sets the rows and removes the ids in ``deleted``, as one segment. Later batches win.

    ``batch`` numbers rise; one that was applied before changes nothing. With a
    ``version`` column (in both tables) a row that is older than what the index
    has of its id is ignored. Rows without an id are left out; of several rows
    with one id the greatest stays.
    """
    spark, key = rows.sparkSession, f"`{index.id_col}`"
    number, own = segments(spark, index)
    last = own[-1][1] if own else -1
    batch = last + 1 if batch is None else batch
    if batch <= last:
        return
    stamp = F.col(f"`{version}`").cast("long") if version else F.lit(batch).cast("long")
    named = lambda df, *more: df.filter(F.col(key).isNotNull()).select(*more, stamp.alias("__version"))
    new = named(rows, *(f"`{c}`" for c in index.columns()))
    new = new.groupBy(key).agg(F.max(F.struct("__version", *(f"`{c}`" for c in index.columns() if c != index.id_col))).alias("__r")).select(key, "__r.*")
    gone = named(deleted if deleted is not None else rows.limit(0), key).groupBy(key).agg(F.max("__version").alias("__version"))
    if version and own:
        known = _read(spark, index, own, "heads").groupBy(F.col("id").alias("__id")).agg(F.max("version").alias("__known"))

        def newer(df: DataFrame) -> DataFrame:
            both = df.join(known, F.col(key) == F.col("__id"), "left")
            return both.filter(F.col("__known").isNull() | (F.col("__known") <= F.col("__version"))).drop("__id", "__known")

        new, gone = newer(new), newer(gone)
    heads = new.select(F.col(key).alias("id"), F.col("__version").alias("version")).unionByName(gone.select(F.col(key).alias("id"), F.col("__version").alias("version")))
    name = f"batch-{batch}"
    _write_segment(index, name, new.join(gone.select(key), index.id_col, "left_anti").select(*(f"`{c}`" for c in index.columns())), heads.groupBy("id").agg(F.max("version").alias("version")))
    _commit(spark, index, number + 1, [*own, (name, batch)])


def delete(index: Index, ids: DataFrame, batch: int | None = None) -> None:
    """Removes the ids (column ``id_col``) from the index."""
    spark = ids.sparkSession
    _, own = segments(spark, index)
    if own:
        apply_batch(index, _read(spark, index, own[-1:], "rows").drop("upto").limit(0), ids.select(f"`{index.id_col}`"), batch)


def _live(spark: SparkSession, index: Index, own: list[tuple[str, int]], found: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of ``found`` (id, upto) that no later segment outdates; the first segment's ids needn't be read for this."""
    if len(own) < 2:
        return found
    later = _read(spark, index, own[1:], "heads").groupBy(F.col("id").alias("__id")).agg(F.max("upto").alias("__upto"))
    return found.join(later, F.col(f"`{id_col}`") == F.col("__id"), "left").filter(F.col("__upto").isNull() | (F.col("__upto") <= F.col("upto"))).drop("__id", "__upto")


def live_rows(spark: SparkSession, index: Index) -> DataFrame:
    """The rows that the index holds now."""
    _, own = segments(spark, index)
    return _live(spark, index, own, _read(spark, index, own, "rows"), index.id_col).drop("upto")


def compact(spark: SparkSession, index: Index) -> None:
    """Joins all segments into one that holds the live rows; outdated rows and tombstones go. Safe to repeat; readers keep the old segments until ``vacuum``."""
    number, own = segments(spark, index)
    if len(own) < 2:
        return
    name, last = f"compact-{number + 1}", own[-1][1]
    # The newest version of each id, deleted ones as well, so that late changes stay ignored.
    heads = _read(spark, index, own, "heads").groupBy("id").agg(F.max("version").alias("version"))
    _write_segment(index, name, live_rows(spark, index).select(*(f"`{c}`" for c in index.columns())), heads)
    _commit(spark, index, number + 1, [(name, last)])


def vacuum(spark: SparkSession, index: Index) -> None:
    """Removes the segments that the newest manifest doesn't name, and the older manifests. No reader of an older one may run."""
    number, own = segments(spark, index)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder, kept in (("segments", {name for name, _ in own}), ("manifest", {f"version={number}"})):
        top = path(f"{index.path}/{folder}")
        store = top.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in store.listStatus(top) if number >= 0 else []:
            if found.isDirectory() and found.getPath().getName() not in kept:
                store.delete(found.getPath(), True)


def _keys(spark: SparkSession, index: Index, keys: Column, of) -> tuple[list[str], list[int]]:
    """The query's keys, and the numbers of their folders."""
    found = spark.range(1).select(F.explode(keys).alias("k")).select("k", _bucket(index, of(F.col("k"))).alias("b")).collect()
    return sorted({r["k"] for r in found}), sorted({r["b"] for r in found})


def candidates(spark: SparkSession, index: Index, query: str) -> DataFrame | None:
    """(id, upto) of the postings that have all grams of ``query``; None where there can't be any."""
    _, own = segments(spark, index)
    if len(query) < 2 or not own:
        return None
    if len(query) == 2:
        keys, folders = _keys(spark, index, F.array(F.lower(F.lit(query))), lambda k: F.substring(k, 1, 2))
        mine = F.col("gram").startswith(keys[0])
        need = 1
    else:
        lowered = F.lower(F.lit(query))
        keys, folders = _keys(spark, index, F.filter(grams(lowered), lambda g: ~g.endswith("\0")), lambda k: F.substring(k, 1, 2))
        mine, need = F.col("gram").isin(*keys), len(keys)
    hits = _read(spark, index, own, "grams").filter(F.col("bucket").isin(*folders) & mine)
    both = hits.groupBy("id", "upto").agg(F.count_distinct("gram").alias("k"))
    return _live(spark, index, own, both.filter(F.col("k") >= need).select("id", "upto"))


def substring_search(spark: SparkSession, index: Index, query: str) -> DataFrame:
    """The live rows whose fields hold ``query``, in either case; queries of one character find nothing."""
    found = candidates(spark, index, query)
    _, own = segments(spark, index)
    if found is None:
        return _read(spark, index, own, "rows").drop("upto").limit(0)
    rows = _read(spark, index, own, "rows").withColumnRenamed("upto", "__own")
    both = rows.join(found.withColumnRenamed("id", "__id"), (F.col(f"`{index.id_col}`") == F.col("__id")) & (F.col("__own") == F.col("upto")), "left_semi").drop("__own")
    return both.filter(index.text().contains(F.lower(F.lit(query))))


def fuzzy_search(spark: SparkSession, index: Index, query: str, threshold: float = 0.7) -> DataFrame:
    """(id, score): Jaccard similarity of the query's words and those of a field, the best field, from ``threshold`` on.

    A set of n words can reach it against q only from q * threshold to q /
    threshold words; of such sets the shared words are counted, which gives the
    similarity itself, so no row is read.
    """
    if threshold <= 0:
        raise ValueError("without a least similarity every row is a result")
    _, own = segments(spark, index)
    words, folders = _keys(spark, index, word_set(F.lit(query)), lambda k: k)
    q = len(words)
    hits = _read(spark, index, own, "words").filter(F.col("bucket").isin(*folders or [-1]) & F.col("word").isin(*words) & F.col("n").between(q * threshold - 1e-9, q / threshold + 1e-9))
    shared = hits.groupBy("id", "upto", "field", "n").agg(F.count(F.lit(1)).alias("k"))
    score = F.col("k") / (F.col("n") + q - F.col("k"))
    near = shared.withColumn("score", score).filter(F.col("score") >= threshold)
    return _live(spark, index, own, near).groupBy("id").agg(F.max("score").alias("score"))
