"""Near-duplicate documents: sets of word shingles with a Jaccard similarity of 0.8 or more, found by SimHash.

At this similarity fingerprints differ in too many bits for shards by blocks of
bits to be small, so the shards of the BK-trees are min-hashes: two documents of
similarity s share one of eight with probability 1 - (1 - s)^8. Shards hold
fingerprints of 128 bits; each has a BK-tree, whose centers hold what is near
them, searched within the radius that the similarity leaves. What is linked so
becomes a group, and in the groups the exact similarity decides, over all words
of the documents. Documents of equal shingle sets are one entry from the start,
so copies cost nothing; shards and groups above a size are taken in blocks, so
no task holds an unbounded one. Documents and sets are known by hashes of their
columns and shingles (128 bits each).

What min-hashes and radius lose is found by an exact join: sets of the similarity
share one of their first shingles, in any order that all sets have in common.
Pairs that the groups don't hold are counted under these, and what the count
allows is compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from ..operators.components import connected_components
from .common import cut
from .simhash import _count_bits

BITS = 128
KEYS = 8
#: Bits in which fingerprints of the least similarity may differ: its mean of 19.4 and five deviations; unrelated ones differ in 64.
RADIUS = 40
#: Entries of a shard; larger ones are split by a second and a third min-hash, then taken in blocks. Also those of a group.
SHARD_LIMIT = 2_000
#: Bytes of the shingle sets of a group that are taken together; a larger group is taken in blocks, however few its texts are.
GROUP_BYTES = 64 << 20
#: Bits within which a tree's center holds prints.
REACH = 16
#: A shingle that seems to be in more sets than this, by a sample of so many, comes last in the order, so that other shingles lead; the most frequent, at most so many, do.
HOT, SAMPLE, MOST_HOT = 200, 20_000, 100_000
#: Most entries that are sent to all tasks.
BROADCAST_ROWS = 500_000

# An odd number whose powers tell the places of a run.
_PLACE = 0x9FB21C651E98DF25

# Odd multipliers of the min-hashes, from the golden ratio's bits.
_FACTORS = [(0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1) for k in range(1, KEYS + 1)]


def _mixed(h: np.ndarray, factor: int | np.ndarray) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * np.asarray(factor, np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A-Z lower-cased; a shorter text is one run, one without words has none.

    A run's hash is a sum of its words' XXH64, each times an odd number of its place, mixed.
    """
    from xxhash import xxh64_digest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    each = np.frombuffer(b"".join(map(xxh64_digest, w)), ">u8").astype("<u8")
    long = min(words, len(w))
    runs = np.full(len(w) - long + 1, long, "<u8")
    for i in range(long):
        runs += each[i : i + len(runs)] * np.uint64(pow(_PLACE, i + 1, 1 << 64))
    runs = np.sort(_mixed(runs, _PLACE))
    return runs[np.append(True, runs[1:] != runs[:-1])]


def sketch(own: np.ndarray) -> tuple[str, int, int, list[int]]:
    """(digest of the set, two halves of the fingerprint, min-hashes)."""
    import xxhash

    signed = lambda x: int(np.asarray(x, np.uint64).view(np.int64))
    if not len(own):
        return "", 0, 0, []
    second = _mixed(own, 0xD6E8FEB86659FD93)
    halves = [signed(np.packbits(2 * _count_bits(h) > len(h), bitorder="little").view("<u8")[0]) for h in (own, second)]
    least = _mixed(own, np.array(_FACTORS, np.uint64)[:, None]).min(axis=1)
    return xxhash.xxh3_128_hexdigest(own.tobytes()), *halves, least.view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the sorted sets have a Jaccard similarity of ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(both) - shared)


def leading(own: np.ndarray, least: float, last: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a sorted set, of which it shares one with every set of similarity ``least`` or more; those in ``last`` (sorted) come after all others."""
    if last is not None and len(last):
        late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own  # the set's size counts, not that of ``last``
        own = np.concatenate([own[~late], own[late]])
    return own[: len(own) - math.ceil(least * len(own) - 1e-9) + 1].view(np.int64)


def code(own: np.ndarray) -> int:
    """64 bits of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 1)).view(np.int64))


class BucketTree:
    """A BK-tree of centers, children keyed by their Hamming distance to the parent; a center holds the prints within ``REACH`` bits of it."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints, self.centers, self.children, self.buckets = prints, [], [], []

    def add(self, n: int) -> None:
        at = 0
        while self.centers:
            d = int(np.bitwise_count(self.prints[n] ^ self.prints[self.centers[at]]).sum())
            if d <= REACH:
                self.buckets[at].append(n)
                return
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.centers)
                break
            at = below
        self.centers.append(n)
        self.children.append({})
        self.buckets.append([n])

    def near(self, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places within ``radius`` of the print at ``n``, and their distances."""
        own, level, found = self.prints[n], [0] if self.centers else [], []
        while level:  # the nodes of a level at once
            d = np.bitwise_count(self.prints[[self.centers[at] for at in level]] ^ own).sum(axis=1).tolist()
            after = []
            for at, x in zip(level, d, strict=True):
                if x <= radius + REACH:
                    found += self.buckets[at]
                after += [child for e, child in self.children[at].items() if x - radius - REACH <= e <= x + radius + REACH]
            level = after
        places = np.array(found, np.int64)
        d = np.bitwise_count(self.prints[places] ^ own).sum(axis=1) if found else np.zeros(0, np.int64)
        return places[d <= radius], d[d <= radius]


def forest(prints: np.ndarray, radius: int, linked: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """(smallest place of its class, place) for the places connected by ``prints`` (two halves a row) within ``radius`` for which ``linked`` holds; the nearest are tried first, none within what is connected."""
    tree, label = BucketTree(prints), np.arange(len(prints))
    for n in range(len(prints)):
        places, d = tree.near(n, radius)
        while len(places):
            k = int(d.argmin())
            if linked is None or linked(int(places[k]), n):
                label[label == label[places[k]]] = label[n]
                rest = label[places] != label[n]
            else:
                rest = np.arange(len(places)) != k
            places, d = places[rest], d[rest]
        tree.add(n)
    least = np.full(len(label), len(label))
    np.minimum.at(least, label, np.arange(len(label)))
    return [(a, n) for n, a in enumerate(least[label].tolist()) if a != n]


def _in_blocks(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """``rows`` (with ``n``, the size of their key) once for each pair of blocks that holds theirs: columns ``i``, ``j``."""
    blocks = F.ceil(F.col("n") / limit).cast("int")
    own = F.pmod(F.xxhash64("same", F.lit(key)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "own", "other", "n")


def _connected(rows: DataFrame, key: str, radius: int, least: float | None) -> DataFrame:
    """Links (src, dst) of each (key, i, j) among ``rows`` (same, a, b, and with ``least`` the ``shingles``)."""
    kind = dict(rows.dtypes)[key]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links() -> None:
            if len(names) > 1:
                check = (lambda p, q: similar(sets[p], sets[q], least)) if least is not None else None
                out.extend((names[p], names[q]) for p, q in forest(np.array(prints, np.int64).view(np.uint64), radius, check))

        now, names, prints, sets, out = None, [], [], [], []
        for f in frames:
            shingles = f["shingles"] if least is not None else [None] * len(f)
            for *place, same, a, b, own in zip(f[key].tolist(), f["i"].tolist(), f["j"].tolist(), f["same"].tolist(), f["a"].tolist(), f["b"].tolist(), shingles, strict=True):
                if place != now:
                    links()
                    now, names, prints, sets = place, [], [], []
                names.append(same)
                prints.append((a, b))
                if own is not None:
                    sets.append(np.frombuffer(own, "<u8"))
            yield pd.DataFrame(out, columns=["src", "dst"], dtype=object)
            out = []
        links()
        yield pd.DataFrame(out, columns=["src", "dst"], dtype=object)

    assert kind in ("bigint", "string")
    ordered = rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "same")
    return ordered.mapInPandas(search, "src string, dst string").distinct()


def _shards(entries: DataFrame, radius: int, limit: int) -> DataFrame:
    """(key, n, same, a, b): entries by the min-hashes they share with others: by one, or by two or three where one is too frequent among different texts."""
    of = lambda: F.xxhash64("places", F.transform("places", lambda p: F.element_at("keys", p)))
    rows = entries.withColumn("places", F.explode(F.array(*(F.array(F.lit(p)) for p in range(1, KEYS + 1))))).withColumn("key", of())
    done = None
    for level in (1, 2, 3):
        sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("same", "a", "b")).alias("least")).filter("n > 1"))
        hot = sizes.filter(F.col("n") > limit)
        if level == 3 or hot.isEmpty():
            taken = sizes.drop("least")
        else:
            # A shard of mostly similar texts gets no smaller by more min-hashes; it is taken in blocks.
            far = F.bit_count(F.col("a").bitwiseXOR(F.col("least.a"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("least.b")))
            dense = rows.join(hot, "key").groupBy("key").agg(F.avg((far <= radius).cast("int")).alias("share")).filter("share >= 0.5").select("key")
            hot = cut(hot.join(dense, "key", "left_anti").select("key"))
            taken = sizes.drop("least").join(hot, "key", "left_anti")
        found = rows.join(taken, "key").select("key", "n", "same", "a", "b")
        done = found if done is None else done.unionByName(found)
        if level == 3 or hot.isEmpty():
            return done
        more = F.explode(F.filter(F.array(*map(F.lit, range(1, KEYS + 1))), lambda p: ~F.array_contains("places", p)))
        rows = rows.join(hot, "key", "left_semi").withColumn("more", more).withColumn("places", F.array_sort(F.array_append("places", F.col("more"))))
        rows = cut(rows.drop("more").dropDuplicates(["same", "places"]).withColumn("key", of()))
    return done


def row_key(docs: DataFrame) -> Column:
    """128 bits of all columns of a row: two chains of XXH64 that begin apart, over the values, which of them are null, and nested ones (maps among them) as JSON."""
    nested = (ArrayType, MapType, StructType, VariantType)
    each = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    nulls = F.concat(*(F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in docs.columns))
    return F.concat(F.hex(F.xxhash64(nulls, *each)), F.lit(":"), F.hex(F.xxhash64(F.lit("second"), nulls, *each)))


def _frequent(given: DataFrame, words: int) -> np.ndarray:
    """Shingles that very many sets seem to have, from a sample. They come last in the order of shingles, which any order may be; no result depends on them."""
    total = given.count()
    share = min(1.0, SAMPLE / max(total, 1))

    def shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f["text"]:
                yield pd.DataFrame({"token": shingle_set(t, words).view(np.int64)})

    some = given.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))).select("text").distinct()
    counts = some.mapInPandas(shingles, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(2.0, HOT * share))
    return np.sort(np.array([x["token"] for x in counts.orderBy(F.desc("n"), "token").limit(MOST_HOT).collect()], np.int64).view(np.uint64))


def _missed(given: DataFrame, entries: DataFrame, groups: DataFrame, words: int, least: float) -> DataFrame:
    """Links (src, dst) of all entries (row, same, size, code) of similarity ``least`` or more that are in different ``groups`` (same, group)."""
    last = _frequent(given, words)

    def firsts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [x for x in (shingle_set(t, words) for t in f["text"]) if len(x)]
            yield pd.DataFrame({"code": np.array([code(own) for own in found], np.int64), "first": [leading(own, least, last) for own in found]})

    each = given.select("text").mapInPandas(firsts, "code long, first array<long>").select("code", F.explode("first").alias("token"))
    under = Window.partitionBy("token")
    # One shuffle of them all: a shingle under which one set stands is gone before anything is joined.
    many = each.withColumns({"x": F.min("code").over(under), "y": F.max("code").over(under)}).filter("x <> y").select("token", "code")
    many = cut(many.distinct())
    ends = cut(entries.join(groups, "same", "left").select("row", "same", "size", "code", F.xxhash64(F.coalesce("group", "same")).alias("of")))
    each = many.join(ends.select("code", "of", "size"), "code")
    shared = each.groupBy("token").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x <> y")
    held = cut(each.join(shared.select("token"), "token"))
    other = held.withColumnsRenamed({"code": "code2", "of": "of2", "size": "size2"})
    both = held.join(other, "token").filter((F.col("of") != F.col("of2")) & (F.col("code") < F.col("code2")))
    both = both.filter(F.least("size", "size2") >= least * F.greatest("size", "size2") - 1e-9)
    # Of the common shingles at most those of one set that don't lead it are not counted.
    need = least / (1 + least) * (F.col("size") + F.col("size2")) - F.ceil(least * F.greatest("size", "size2") - 1e-9) + 1
    pairs = cut(both.groupBy("code", "code2", "size", "size2").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= need - 1e-6).select("code", "code2"))
    wanted = cut(pairs.select(F.explode(F.array("code", "code2")).alias("code")).distinct().join(ends.select("code", "same", "row"), "code"))

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.drop(columns="text").assign(shingles=[shingle_set(t, words).tobytes() for t in f["text"]])

    texts = given.select("row", "text").join(wanted, "row").select("code", "same", "text")
    whole = cut(texts.mapInPandas(sets, "code long, same string, shingles binary").dropDuplicates(["code"]))

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            near = [similar(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), least) for a, b in zip(f["a"], f["b"], strict=True)]
            yield f.loc[near, ["src", "dst"]]

    one, two = (whole.select(F.col("code").alias(c), F.col("same").alias(end), F.col("shingles").alias(v)).hint("merge") for c, end, v in (("code", "src", "a"), ("code2", "dst", "b")))
    return pairs.join(one, "code").join(two, "code2").select("src", "dst", "a", "b").mapInPandas(compared, "src string, dst string")


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, limit: int = SHARD_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): ``row`` (128 bits of all columns) and ``same`` (digest of the shingle set) for each row of ``docs``, with its id; and (same, group) of the linked ones.

    ``group`` is the smallest digest of the class. Documents without words are
    one class; a text of fewer than ``words`` words is one shingle; null texts
    have no words.
    """
    given = docs.select(row_key(docs).alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [(*sketch(own), len(own), code(own)) for own in (shingle_set(t, words) for t in f["text"])]
            yield f[["row", "id"]].assign(**{c: [m[k] for m in made] for k, c in enumerate(("same", "a", "b", "keys", "size", "code"))})

    rows = cut(given.mapInPandas(sketched, "row string, id string, same string, a long, b long, keys array<long>, size long, code long"))
    # All columns but the first follow from the set, so any row's will do; the least row stands for its copies.
    entries = rows.filter("same <> ''").groupBy("same").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("a", "b", "keys", "size", "code")))
    entries = cut(entries)
    near = cut(_connected(_in_blocks(_shards(entries.drop("row", "size", "code"), radius, limit), "shard", limit), "key", radius, None))
    groups = connected_components(near, cut).withColumnsRenamed({"node": "same", "component": "key"})
    linked = cut(entries.join(groups, "same").select("row", "same", "a", "b", "key", "size"))
    by_bytes = F.ceil(F.sum("size") * 8.0 * limit / GROUP_BYTES).cast("long")
    sizes = linked.groupBy("key").agg(F.greatest(F.count(F.lit(1)), by_bytes).alias("n"))
    members = cut(linked.join(sizes, "key").select("row", "same", "a", "b", "key", "n"))

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.drop(columns="text").assign(shingles=[shingle_set(t, words).tobytes() for t in f["text"]])

    few = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = given.select("row", "text").join(few, "row").select("same", "a", "b", "key", "n", "text")
    held = texts.mapInPandas(sets, "same string, a long, b long, key string, n long, shingles binary").dropDuplicates(["same"])
    exact = cut(_connected(_in_blocks(held, "group", limit), "key", radius, similarity))
    named = lambda links: connected_components(links, cut).withColumnsRenamed({"node": "same", "component": "group"})
    found = cut(named(exact))
    missed = cut(_missed(given, entries.select("row", "same", "size", "code"), found, words, similarity))
    return rows.select("row", "id", "same"), found if missed.isEmpty() else named(exact.unionByName(missed))


def _rank(kind: str) -> Column:
    """Order of documents in a group: by id, those without one last, then by row."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").cast(kind).alias("id"), F.col("row"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id.

    Documents are linked at a Jaccard similarity of ``similarity`` or more of
    their sets of shingles of ``words`` words; groups are connected. Rows without
    id take part and come after those with one; rows of one id with different
    texts are different documents; rows equal in all columns are one document.
    Null texts and texts without words are equal to each other.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows, groups = near_groups(docs, words, similarity, id_col, text_col, **how)
    placed = rows.join(cut(groups), "same", "left").select("id", "row", F.coalesce("group", "same").alias("group"))
    placed = cut(placed)
    # First rows combine before the shuffle; a group of copies is one row a task.
    first = placed.groupBy("group").agg(F.min(_rank(kind)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("group", F.col("first.row").alias("least"))
    grouped = cut(placed.join(cut(first), "group").groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("row") != F.col("least")).alias("gone")))
    sent = lambda found: F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    gone, repeated = grouped.filter("gone").select("row"), grouped.filter("NOT gone AND n > 1").select("row")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), row_key(docs).alias("row"))
    gone, repeated = sent(gone), sent(repeated)
    kept = held.join(gone, "row", "left_anti")
    # Equal rows become one, in each task first.
    once = kept.join(repeated, "row", "left_semi").groupBy("row").agg(F.first("doc").alias("doc"))
    both = kept.join(repeated, "row", "left_anti").select("doc").unionByName(once.select("doc"))
    return both.select(*(F.col("doc")[c].alias(c) for c in docs.columns))
