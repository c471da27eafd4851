"""Links of vectors within a Euclidean radius (survey G7, G8): hashed shards, an exact lower bound, an exact check.

Of up to ``GRID_PLACES`` places, cells as wide as the radius meet their
neighbours, which loses no pair. Beyond that cells don't prune. Up to
``MOST_IN_BLOCKS`` different vectors are dealt to blocks, and a task holds one
block while it multiplies it with another's rows: a pair costs about a
nanosecond so, less than keys that would rule it out, and none is lost. Still
more vectors meet by p-stable hashing: a table's key is a run of projections on
random directions, each cut into intervals. There are as many tables as it takes for a pair at the
radius itself to miss all of them with a probability of ``miss``; nearer pairs
are surer. How many projections a key has follows from a sample of distances,
so that few far pairs meet; this changes the work, not the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut

#: Vectors with up to so many places meet in cells.
GRID_PLACES = 3
#: Different vectors that meet in blocks; more are hashed.
MOST_IN_BLOCKS = 4_000_000
#: Vectors of a block at most, and where they are few, in how many blocks of how many they are.
BLOCK, LEAST_BLOCK, SPREAD = 50_000, 500, 8
#: Rows and columns that are multiplied at once.
TILE = 1_024, 2_048
#: Tasks that blocks are dealt to, at most.
MOST_TASKS = 10_000
#: Width of an interval, in radii.
WIDTH = 4.0
#: Rows that the distances are estimated from.
SAMPLE_ROWS = 1_000
#: Share of all pairs that may meet, as expected, others that a vector may meet, and projections of a key at most.
SHARE, MEETINGS, MOST_PROJECTIONS = 0.04, 20_000, 40
#: Places of the sketch that travels with a key.
SKETCH = 16


@dataclass(frozen=True)
class Hashing:
    """``tables`` keys of ``projections`` intervals each, ``width`` wide, over vectors of ``places``."""

    places: int
    projections: int
    tables: int
    width: float
    seed: int = 7

    def draw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Directions, offsets, multipliers that join a table's intervals, and directions of the sketch; the same everywhere."""
        rng, n = np.random.default_rng(self.seed), self.projections * self.tables
        directions, offsets = rng.standard_normal((self.places, n)), rng.uniform(0, self.width, n)
        joins = rng.integers(-(1 << 62), 1 << 62, self.projections, dtype=np.int64) * 2 + 1
        sketch = np.eye(self.places) if self.places <= SKETCH else np.linalg.qr(rng.standard_normal((self.places, SKETCH)))[0]
        return directions, offsets, joins, sketch


def same_interval(distance: np.ndarray, width: float) -> np.ndarray:
    """Probability that two vectors so far apart fall into one interval of a random projection."""
    t = width / np.maximum(distance, 1e-12)
    below = np.array([math.erf(x / math.sqrt(2)) for x in np.ravel(t)]).reshape(t.shape)
    return below - 2 / (math.sqrt(2 * math.pi) * t) * -np.expm1(-t * t / 2)


def tables_for(projections: int, width: float, eps: float, miss: float) -> int:
    """Tables so that a pair at ``eps`` shares a key with a probability of 1 - ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-float(same_interval(np.array([eps]), width)[0]) ** projections))


def choose(sample: np.ndarray, eps: float, miss: float, share: float = SHARE) -> Hashing:
    """The least projections with which at most ``share`` of the sampled pairs are expected to meet; otherwise those with the fewest."""
    half = len(sample) // 2
    distances = np.linalg.norm(sample[:half] - sample[half : 2 * half], axis=1) if half else np.array([8 * eps])
    each, width, options = same_interval(distances, WIDTH * eps), WIDTH * eps, []
    for k in range(1, MOST_PROJECTIONS + 1):
        tables = tables_for(k, width, eps, miss)
        options.append((tables * float((each**k).mean()), k, tables))
        if options[-1][0] <= share:
            break
    _, k, tables = options[-1] if options[-1][0] <= share else min(options)
    return Hashing(sample.shape[1], k, tables, width)


def hashed(rows: DataFrame, hashing: Hashing) -> DataFrame:
    """(class, table, key, sketch): each vector under its key in every table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, offsets, joins, sketch = hashing.draw()
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                own = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, hashing.places)
                cells = np.floor((own @ directions + offsets) / hashing.width).astype(np.int64)
                keys = (cells.reshape(len(own), hashing.tables, hashing.projections) * joins).sum(axis=2)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(t)) for x, t in ((keys, pa.int64()), (own @ sketch, pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["class", "keys", "sketch"])

    kind = rows.schema["class"].dataType.simpleString()
    made = rows.select("class", "v").mapInArrow(run, f"class {kind}, keys array<long>, sketch array<double>")
    return made.select("class", "sketch", F.posexplode("keys").alias("table", "key"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def meeting(keyed: DataFrame) -> DataFrame:
    """All meetings (src, dst, x, y) of two vectors under a key; a pair may meet more than once.

    By a shuffle: a vector has a row for each table, which the planner's estimate leaves out, so it would broadcast them all.
    """
    other = keyed.select("table", "key", F.col("class").alias("dst"), F.col("sketch").alias("y")).hint("merge")
    return keyed.select("table", "key", F.col("class").alias("src"), F.col("sketch").alias("x")).join(other, ["table", "key"]).filter("src < dst").select("src", "dst", "x", "y")


def _near(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and y of the rows whose product is ``least`` or more."""
    for a in range(0, len(x), TILE[0]):
        for b in range(0, len(y), TILE[1]):
            p = x[a : a + TILE[0]] @ y[b : b + TILE[1]].T
            at = np.flatnonzero(p >= least)
            if len(at):
                yield at // p.shape[1] + a, at % p.shape[1] + b


def in_blocks(classes: DataFrame, places: int, eps: float, n: int, largest: float) -> DataFrame:
    """Pairs (src, dst) that may be within ``eps``, and all that are, of ``n`` vectors whose squared lengths are ``largest`` at most.

    Each two blocks meet in one task, which holds one of them; a row's halved
    squared length is taken along, so a product is minus the halved squared
    distance. Single precision does where its error is small against the radius.
    """
    blocks = max(-(-n // BLOCK), min(-(-n // LEAST_BLOCK), SPREAD), 1)
    single = largest * (places + 8) * 2.0**-22 <= eps * eps / 8
    kind, number = classes.schema["class"].dataType.simpleString(), np.dtype("f4" if single else "f8")
    least = -eps * eps / 2 * (1 + 1e-9) - 1e-12 - largest * (places + 8) * (2.0**-22 if single else 2.0**-51)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            ends = [*(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for a, b in zip([0, *ends], ends, strict=False):
                if a == b:
                    continue
                i, j, own = at[a].tolist()
                part = batch.slice(a, b - a)
                v = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(number, copy=False).reshape(-1, places)
                half, one = -(v.astype("f8") ** 2).sum(axis=1)[:, None] / 2, np.ones((len(v), 1), number)
                ids, mine, others = part.column(3), np.hstack([v, half.astype(number), one]), np.hstack([v, one, half.astype(number)])
                if now != (i, j):
                    now, held = (i, j), []
                if own == j:
                    for names, theirs in [*held, *([(ids, others)] if i == j else [])]:
                        for p, q in _near(mine, theirs, least):
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(p)), names.take(pa.array(q))], ["a", "b"])
                if own == i:
                    held.append((ids, others))

    v = F.col("v").cast("array<float>") if single else F.col("v")
    dealt = classes.select("class", v.alias("v"), F.pmod(F.xxhash64("class"), F.lit(blocks)).alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = dealt.select(F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), F.col("own").cast("long").alias("own"), "class", "v")
    met = met.repartition(min(blocks * (blocks + 1) // 2, MOST_TASKS), "i", "j").sortWithinPartitions("i", "j", "own")
    # Within a block a pair may be found from both ends.
    found = met.mapInArrow(search, f"a {kind}, b {kind}").filter("a <> b")
    return found.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def _grid(classes: DataFrame, places: int, eps: float) -> DataFrame:
    """Pairs (src, dst) in the same or neighbouring cells."""
    names = [f"c{k}" for k in range(places)]
    celled = classes.select("class", *(F.floor(F.col("v")[k] / F.lit(eps)).alias(c) for k, c in enumerate(names)))
    near = celled.withColumnRenamed("class", "dst")
    for c in names:
        near = near.withColumn(c, F.explode(F.array(*(F.col(c) + i for i in (-1, 0, 1)))))
    return celled.withColumnRenamed("class", "src").join(near.hint("merge"), names).filter("src < dst").select("src", "dst")


def vector_links(rows: DataFrame, vector: str, eps: float, id_col: str = "id", miss: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Pairs (src, dst, weight) of different vectors within the distance ``eps``, and the members (id, class, n) of equal ones.

    The weight is the distance. Vectors are to have equal numbers of places;
    rows without a vector are left out. Equal vectors are one class, so copies
    add no pairs. Of more than ``GRID_PLACES`` places and ``MOST_IN_BLOCKS``
    vectors a pair is lost with a probability of ``miss`` at most; what is found
    is exact.
    """
    named = rows.select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("v IS NOT NULL")
    classes = cut(named.groupBy("v").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")))
    members = named.join(classes.hint("merge"), "v").select("id", "class", "n")
    # Vectors with a null, an infinite element or none are near nothing.
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    finite = classes.withColumn("square", square).filter((F.col("square") < float("inf")) & (F.size("v") > 0))
    n, largest, places = finite.agg(F.count(F.lit(1)), F.max("square"), F.max(F.size("v"))).first()
    if not n or places <= GRID_PLACES:
        pairs = _grid(finite, places or 1, eps)
    elif n <= MOST_IN_BLOCKS:
        pairs = in_blocks(finite, places, eps, n, largest)
    else:
        sample = np.array([r["v"] for r in finite.select("class", "v").orderBy(F.xxhash64("class"), "class").limit(SAMPLE_ROWS).collect()], np.float64)
        near = squared_distance(F.col("x"), F.col("y")) <= eps * eps * (1 + 1e-9) + 1e-12  # projections are never farther apart than the vectors
        pairs = meeting(hashed(finite, choose(sample, eps, miss, min(SHARE, MEETINGS / n)))).filter(near).select("src", "dst").distinct()
    of = classes.select("class", "v").hint("merge")
    both = pairs.join(of.withColumnsRenamed({"class": "src", "v": "a"}), "src").join(of.withColumnsRenamed({"class": "dst", "v": "b"}), "dst")
    return both.select("src", "dst", F.sqrt(squared_distance(F.col("a"), F.col("b"))).alias("weight")).filter(F.col("weight") <= eps), members
