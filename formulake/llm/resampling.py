"""Importance resampling towards a target distribution.

Texts are multisets of hashed n-grams. A bucket's gain is the log ratio of its
smoothed shares in the target and in all documents; a document's weight is the
sum of the gains of its features, taken from an array. Documents with the
largest weights plus Gumbel noise are a draw without replacement.

The draw needs no global sort. Scores that the draw can't reach stay behind (an
approximate quantile, confirmed by an exact count). The other rows are sorted
where they are: one run for each partition, written to the shared folder. The
runs are dealt into ranges of the final order, by all columns of that order, so
ties and repeated rows split as well as anything else. A range has a bounded
number of rows; its piece of every run goes through a tournament tree, which
stops after as many rows as the draw still wants, and emits ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of a range, about; a range is merged by one task.
RANGE_ROWS = 200_000
#: Bytes of a text whose words are held at once.
CHUNK_BYTES = 1 << 22
#: Words that a worker remembers the buckets of, and their longest.
CACHE_WORDS, CACHE_WORD_BYTES = 500_000, 64
#: The approximate quantile may be off by this share of the rows.
QUANTILE_ERROR = 1e-4

# Letters A-Z as lower case, digits, a-z and all bytes beyond ASCII as they are, everything else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """Bucket of a word; a bounded number of words is remembered."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word) % self.buckets
        if len(word) <= CACHE_WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=2)
def _buckets_for(buckets: int) -> _Buckets:
    return _Buckets(buckets)


def word_chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists of about ``CHUNK_BYTES``."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = at + CHUNK_BYTES
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def feature_buckets(text: bytes, grams: int, buckets: int) -> tuple[int, list[np.ndarray]]:
    """Number of words of ``text``, and the buckets of its features in pieces."""
    known, n, out, carry = _buckets_for(buckets), 0, [], []
    for words in word_chunks(text):
        n += len(words)
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if grams > 1:
            own = carry + words
            for k in range(2, grams + 1):
                first = max(0, len(carry) - k + 1)
                out.append(np.array([zlib.crc32(b" ".join(own[i : i + k])) % buckets for i in range(first, len(own) - k + 1)], np.int64))
            carry = own[len(own) - grams + 1 :] if len(own) >= grams else own
    return n, out


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column)


def histogram(docs: DataFrame, grams: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts. Tasks count for themselves; at most ``buckets`` numbers leave each, and reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                for found in feature_buckets(text, grams, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket, target over source."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def score_documents(docs: DataFrame, gains: np.ndarray, grams: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_words, n_features, weight, score) for each row of ``docs``; null texts have no words, a null id is hashed as an empty one."""
    buckets = len(gains)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(_texts(batch.column(1))):
                made[0, i], found = feature_buckets(text, grams, buckets)
                made[1, i] = sum(map(len, found))
                made[2, i] = sum(int(gains[x].sum()) for x in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made)], [id_col, "n_words", "n_features", "weight"])

    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("__text"))
    scored = rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return scored.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


class Tournament:
    """Merges sorted runs of keys: a tree of matches in which the lesser head wins, replayed along one path for each key taken."""

    LAST = (math.inf,)

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.size = runs, 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [next(r, self.LAST) for r in runs] + [self.LAST] * (self.size - len(runs))
        self.tree = [0] * self.size + list(range(self.size))
        for j in range(self.size - 1, 0, -1):
            self.tree[j] = self._winner(j)

    def _winner(self, j: int) -> int:
        a, b = self.tree[2 * j], self.tree[2 * j + 1]
        return a if self.heads[a] <= self.heads[b] else b

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[i := self.tree[1]]) is not self.LAST:
            yield head
            self.heads[i] = next(self.runs[i], self.LAST)
            j = (self.size + i) // 2
            while j:
                self.tree[j] = self._winner(j)
                j //= 2


def _merge(table: pa.Table, take: int, first: int, id_col: str) -> pa.Table:
    """The rows of one range: ranks from ``first`` for the ``take`` best, null for the others."""
    table = table.sort_by([("run", "ascending"), ("pos", "ascending")])  # rows of a run arrive in any order
    run, score, ids = table["run"].to_numpy(), table["score"].to_pylist(), table[id_col].to_pylist()
    ends = [*(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
    rows = [((-score[i], *((0, 0) if ids[i] is None else (1, ids[i])), i) for i in range(a, b)) for a, b in zip([0, *ends], ends, strict=False)]
    order = [key[-1] for key, _ in zip(Tournament(rows), range(take), strict=False)] if take else []
    left = np.setdiff1d(np.arange(len(run)), order)
    ranks = pa.array([*range(first, first + len(order)), *([None] * len(left))], pa.int64())
    return table.take(pa.array(np.concatenate([np.array(order, np.int64), left]))).append_column("rank", ranks)


def draw(scored: DataFrame, take: int, id_col: str = "doc_id", range_rows: int | None = None) -> DataFrame:
    """``scored`` (a written table with columns id, score, eligible) with the ``rank`` of the ``take`` best eligible rows: by falling score, ties to the smaller id, null ids first; rows equal in both come in any order."""
    columns = scored.columns
    none = F.lit(None).cast("long").alias("rank")
    if take <= 0:
        return scored.select(*columns, none)
    able = scored.filter("eligible")
    n = able.count()
    share = max(0.0, 1 - take / max(n, 1) - 2 * QUANTILE_ERROR)
    floor = able.agg(F.percentile_approx("score", F.lit(share), F.lit(int(1 / QUANTILE_ERROR))).alias("x")).first()["x"]
    reach = F.col("eligible") & (F.col("score") >= F.lit(floor))
    if able.filter(reach).count() < min(take, n):
        reach = F.col("eligible")
    order = [F.desc("score"), F.asc_nulls_first(f"`{id_col}`")]
    runs = cut(scored.filter(reach).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("pos")))
    ranges = max(1, -(-runs.count() // (range_rows or RANGE_ROWS)))
    dealt = cut(runs.repartitionByRange(ranges, *order, "run", "pos").withColumn("range", F.spark_partition_id()))
    # One row for each range.
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()
    places, before = {}, 0
    for r in sorted(sizes, key=lambda r: r["range"]):
        places[r["range"]] = (min(r["n"], max(0, take - before)), before + 1)
        before += r["n"]
    last = max((k for k, (x, _) in places.items() if x), default=-1)

    def merge(table: pa.Table) -> pa.Table:
        wanted, first = places[table["range"][0].as_py()]
        return _merge(table, wanted, first, id_col).select([*columns, "rank"])

    kinds = ", ".join(f"`{c}` {scored.schema[c].dataType.simpleString()}" for c in columns)
    drawn = dealt.filter(F.col("range") <= last).groupBy("range").applyInArrow(merge, f"{kinds}, rank long")
    beyond = dealt.filter(F.col("range") > last).select(*columns, none)
    return scored.filter(~reach).select(*columns, none).union(beyond).union(drawn)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, grams: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """One row (id, n_features, weight, score, rank) for each row of ``docs``; ``rank`` is null where the row isn't drawn.

    Of the documents with ``min_words`` words or more, ``percent`` in a hundred
    are drawn, rounded down. Features are all runs of 1 to ``grams`` words.
    Null and empty texts have no features, weight 0, and are never drawn
    (unless ``min_words`` is 0). Null ids and repeated rows are rows of their
    own. Empty documents give an empty table; an empty target gives gains that
    depend on the documents alone. Other columns are not read.
    """
    gains = bucket_gains(histogram(docs, grams, buckets, text_col), histogram(target, grams, buckets, target_text))
    scored = cut(score_documents(docs, gains, grams, seed, id_col, text_col).withColumn("eligible", F.col("n_words") >= min_words))
    take = scored.filter("eligible").count() * percent // 100
    return draw(scored, take, id_col).select(id_col, "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn rows of ``docs`` with their ``rank``. Ids must be unique; an id that isn't would bring all its rows."""
    own = ranks.filter("rank IS NOT NULL").select(F.col(id_col).alias("__id"), F.col("rank").alias("__rank"))
    found = docs.join(own, docs[id_col].eqNullSafe(F.col("__id")))
    return found.drop("__id").withColumnRenamed("__rank", "rank")
