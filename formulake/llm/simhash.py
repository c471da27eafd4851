"""SimHash near-duplicates: fingerprints, BK-tree search, classes of linked documents.

A fingerprint within ``radius`` bits of another agrees with it in at least one
of ``radius + 1`` blocks of its bits, so fingerprints are dealt to one shard for
each block. A shard holds a BK-tree (children keyed by their Hamming distance to
the parent); a search follows only edges within the radius. Shards meet their
queries by a shuffle on the block, as trees over all fingerprints have no size
bound that would allow a broadcast. A shard with too many fingerprints is split
by blocks of its remaining bits, again and again; after five splits so few bits
are free that distinct fingerprints cannot exceed the bound. A shard emits a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import cut, keyed_schema, number_keys, text_keys

BITS = 64
#: Fingerprints of a shard; larger ones are split by further blocks.
SHARD_LIMIT = 512
_LINES = 1 << 16


def _count_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the lowest."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), _LINES):
        some = h[i : i + _LINES]
        total += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def shingle_fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """A text's fingerprint, as an unsigned number; 0 for a text without words."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    return int(np.packbits(2 * _count_bits(h) > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row: shingles of ``words`` words, XXH64, a bit set where over half of the hashes have it. ``fp`` is signed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([shingle_fingerprint(t, words) for t in f[text_col]], dtype=np.uint64)
            yield pd.DataFrame({id_col: f[id_col], "fp": fp.view(np.int64)})

    rows = docs.select(id_col, text_col)
    return number_keys(text_keys(rows, id_col).mapInPandas(run, f"{keyed_schema(rows, id_col)}, fp long"), rows, id_col)


class BKTree:
    """Fingerprints by Hamming distance to their parents."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> int:
        self.value.append(x)
        self.children.append({})
        new = len(self.value) - 1
        at = 0
        while new:
            d = (x ^ self.value[at]).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                break
            at = below
        return new

    def near(self, x: int, radius: int) -> list[int]:
        """Positions of the values within ``radius`` of ``x``."""
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (x ^ self.value[at]).bit_count()
            if d <= radius:
                found.append(at)
            for e, child in self.children[at].items():
                if d - radius <= e <= d + radius:
                    todo.append(child)
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(smallest of the class, other) for each class of more than one among distinct ``values``."""
    tree, root = BKTree(), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x in values:
        near = tree.near(x, radius)
        new = tree.add(x)
        root.append(new)
        for i in near:
            a, b = find(i), find(new)
            if a != b:
                root[b] = a
    least: dict[int, int] = {}
    for i, x in enumerate(values):
        r = find(i)
        least[r] = min(least.get(r, x), x)
    return [(least[find(i)], x) for i, x in enumerate(values) if least[find(i)] != x]


def _blocks(free: int, n: int) -> list[int]:
    """The set bits of ``free`` in ``n`` even blocks, as masks."""
    bits = [i for i in range(BITS) if free >> i & 1]
    cuts = [round(len(bits) * k / n) for k in range(n + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near_links(fps: DataFrame, radius: int = 2, limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (src, dst) that connect all distinct ``fp`` within ``radius`` of each other (a spanning forest of each shard)."""
    parts = radius + 1
    masks, rows, done = _blocks((1 << BITS) - 1, parts), None, None
    level = {0: masks}
    while True:
        if rows is None:
            rows = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
        else:
            split = F.create_map(*(x for m, below in level.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(b)) for b in below)))))
            rows = rows.select("fp", F.explode(split[F.col("mask")]).alias("mask"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = cut(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        kept = rows.join(sizes.filter(F.col("n") <= limit).drop("n"), ["mask", "key"], "left_semi")
        done = kept if done is None else done.unionByName(kept)
        hot = sizes.filter(F.col("n") > limit)
        if hot.isEmpty():
            break
        rows = cut(rows.join(hot.drop("n"), ["mask", "key"], "left_semi").drop("key"))
        at = masks if level == {0: masks} else [b for below in level.values() for b in below]
        level = {m: [m | b for b in _blocks(~m & ((1 << BITS) - 1), parts)] for m in dict.fromkeys(at)}

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(own: tuple, values: list[int]) -> None:
            if len(values) > 1:
                out.extend(shard_links([v & ((1 << BITS) - 1) for v in dict.fromkeys(values)], radius))

        now, values, out = None, [], []
        for f in frames:
            for mask, key, fp in zip(f["mask"].tolist(), f["key"].tolist(), f["fp"].tolist(), strict=True):
                if (mask, key) != now:
                    links(now, values)
                    now, values = (mask, key), []
                values.append(fp)
            if out:
                yield pd.DataFrame([(_signed(a), _signed(b)) for a, b in out], columns=["src", "dst"])
                out = []
        links(now, values)
        yield pd.DataFrame([(_signed(a), _signed(b)) for a, b in out], columns=["src", "dst"], dtype="int64")

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return done.repartition(n, "mask", "key").sortWithinPartitions("mask", "key").mapInPandas(search, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id of the class. Null and empty texts have
    fingerprint 0, which links as any other; null ids get a row but name no
    class (a class of null ids alone is null); repeated rows get a row each.
    """
    own = cut(fingerprints(docs, words, id_col, text_col))
    least = cut(own.groupBy("fp").agg(F.min(id_col).alias("least")))
    links = cut(near_links(least.select("fp"), radius))
    # Only fingerprints with links are in here.
    classes = connected_components(links, cut)
    of = least.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    roots = of.filter("component is not null").groupBy("component").agg(F.min("least").alias("root"))
    label = of.join(roots, "component", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    # As a table of its own it meets the documents in a join whose skewed partitions can be split: a group of copies is one fingerprint.
    return own.join(cut(label), "fp", "left")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
