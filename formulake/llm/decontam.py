"""Benchmark decontamination with suffix arrays of the training text.

Each task turns its documents into one array of word numbers and sorts the
suffixes that could match: those that begin with words that some test suffix
begins with (all others differ from every test suffix within the first words).
Every test suffix is binary-searched in that array; its range holds all
verbatim matches. What a document's words are hit by and which items own the
hits are kept apart, so a passage that many items share costs its places once.
Locations, where asked for, are the longest matches: those that continue each
other are joined. The benchmark is a stated query set: it is taken in blocks of
bounded size, one pass over the documents for each block; only texts go through
Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: UTF-8 bytes of benchmark text in a block, which each task holds.
BLOCK_BYTES = 16 << 20
#: Words of the training text in one suffix array.
SHARD_WORDS = 1 << 20
#: Suffixes are sorted only if they begin with this many words of a test suffix (or all of a shorter one).
HEAD = 4

# Word bytes: all but those of [\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing; the others become spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass
class Windows:
    """The windows of a block of items, by their word numbers (from 1), and what finds them."""

    vocabulary: dict[bytes, int]
    keys: list  # for each length: (length, distinct windows as sorted bytes, first row of each in `owners`, owners (item, start))
    heads: dict[int, np.ndarray]  # sorted hashes of the first words, by how many
    names: list[str]


def _key(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def index_windows(items: list[tuple[str, str | None]], window: int) -> Windows:
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k, (_, text) in enumerate(items):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], ">u4")
        if len(ids):
            rows = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
            own = np.stack([np.full(len(rows), k, np.int32), np.arange(len(rows), dtype=np.int32)], axis=1)
            by_length.setdefault(rows.shape[1], []).append((rows, own))
    keys, heads = [], {}
    for n, own in sorted(by_length.items()):
        rows = np.concatenate([x for x, _ in own])
        key = _key(rows)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        keys.append((n, key[first], np.append(first, len(order)), np.concatenate([x for _, x in own])[order]))
        h = min(n, HEAD)
        heads[h] = np.unique(np.concatenate([heads.get(h, np.zeros(0, np.uint64)), _hash([rows[:, i] for i in range(h)])]))
    return Windows(vocabulary, keys, heads, [x[0] for x in items])


def _isin(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def suffix_matches(ids: np.ndarray, test: Windows, window: int) -> list[tuple[int, int, np.ndarray]]:
    """(place in ``test.keys``, window there, positions) of each window that occurs in ``ids``, which ends with ``window`` zeros."""
    real = len(ids) - window
    chosen = np.zeros(real, bool)
    for h, known in test.heads.items():
        at = np.flatnonzero(np.logical_and.reduce([ids[i : i + real] > 0 for i in range(h)]))
        if len(at):
            chosen[at[_isin(_hash([ids[at + i] for i in range(h)]), known)]] = True
    at = np.flatnonzero(chosen)
    if not len(at):
        return []
    key = _key(ids[at[:, None] + np.arange(window)])
    order = np.argsort(key, kind="stable")
    suffixes, key = at[order], key[order]  # the suffix array
    found = []
    for k, (n, distinct, _, _) in enumerate(test.keys):
        low = np.searchsorted(key, distinct, side="left")
        # words after the first n may be anything: the end of the range is below the same words followed by the largest bytes
        end = distinct if n == window else _padded(distinct, n, window)
        high = np.searchsorted(key, end, side="right")
        found += [(k, w, suffixes[low[w] : high[w]]) for w in np.flatnonzero(high > low).tolist()]
    return found


def _padded(distinct: np.ndarray, n: int, window: int) -> np.ndarray:
    rows = np.full((len(distinct), 4 * window), 255, np.uint8)
    rows[:, : 4 * n] = np.ascontiguousarray(distinct.astype(f"S{4 * n}")).view(np.uint8).reshape(len(distinct), 4 * n)
    return rows.view(f"S{4 * window}").ravel()


def longest(position: np.ndarray, item: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Matches with those that continue each other joined: (position, item, start, length), by position."""
    order = np.lexsort((position, position - start, item))
    p, k, s, n = position[order], item[order], start[order], length[order]
    new = np.ones(len(p), bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] - s[1:] != p[:-1] - s[:-1]) | (p[1:] > p[:-1] + n[:-1])
    at = np.flatnonzero(new)
    end = np.maximum.reduceat(p + n, at) if len(at) else p
    return sorted(zip(p[at].tolist(), k[at].tolist(), s[at].tolist(), (end - p[at]).tolist(), strict=True))


def _by_document(found: list[tuple[int, int, np.ndarray]], begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, position in it, place in ``test.keys``, window) of each match, by document and position."""
    if not found:
        return (np.zeros(0, np.int64),) * 4
    sizes = [len(x) for _, _, x in found]
    place = np.concatenate([x for _, _, x in found])
    k, w = (np.repeat(np.array([x[i] for x in found], np.int64), sizes) for i in (0, 1))
    order = np.argsort(place, kind="stable")
    doc = np.searchsorted(begin, place[order], side="right") - 1
    return doc, place[order] - begin[doc], k[order], w[order]


def _hits(lists: list[list[bytes]], test: Windows, window: int) -> Iterator[tuple]:
    """For each document with matches its number, starts and ends of its hit words, and its matches: place in ``test.keys``, window, position."""
    sizes = np.array([len(w) for w in lists], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + window)])  # `window` zeros after each document
    ids, get = np.zeros(begin[-1], np.int64), test.vocabulary.get
    for b, w in zip(begin, lists, strict=False):
        if w:
            ids[b : b + len(w)] = [get(x, 0) for x in w]
    doc, position, k, w = _by_document(suffix_matches(ids, test, window) if len(ids) else [], begin)
    length = np.array([x[0] for x in test.keys], np.int64)[k] if len(k) else k
    for d, own in zip(*_runs(doc), strict=True):
        p, end = position[own], np.maximum.accumulate(position[own] + length[own])
        new = np.flatnonzero(np.append(True, p[1:] > end[:-1]))
        yield int(d), p[new].tolist(), end[np.append(new[1:] - 1, len(p) - 1)].tolist(), k[own], w[own], p


def _runs(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of sorted ``x``, and the places of each."""
    which, at = np.unique(x, return_index=True)
    return which, np.split(np.arange(len(x)), at[1:]) if len(which) else []


def _owners(test: Windows, k: int, w: int) -> np.ndarray:
    """(item, start) of each place of a window in the benchmark."""
    _, _, first, owners = test.keys[k]
    return owners[first[w] : first[w + 1]]


def _items(test: Windows, k: np.ndarray, w: np.ndarray) -> list[str]:
    """The items that own any of the windows, each window looked at once."""
    distinct = set(zip(k.tolist(), w.tolist(), strict=True))
    numbers = np.unique(np.concatenate([_owners(test, a, b)[:, 0] for a, b in distinct]))
    return list(dict.fromkeys(test.names[i] for i in numbers))


def _locations(test: Windows, k: np.ndarray, w: np.ndarray, position: np.ndarray) -> list[dict]:
    """The longest matches, one for each place in the document and each of its places in the benchmark."""
    each = [_owners(test, a, b) for a, b in zip(k.tolist(), w.tolist(), strict=True)]
    n = np.array([test.keys[a][0] for a in k.tolist()], np.int64)
    sizes = [len(x) for x in each]
    both = np.concatenate(each)
    found = longest(np.repeat(position, sizes), both[:, 0], both[:, 1], np.repeat(n, sizes))
    return [{"item_id": test.names[i], "doc_start": p, "item_start": s, "n_words": x} for p, i, s, x in found]


_FOUND = "struct<n_words: long, starts: array<long>, ends: array<long>, items: array<string>, matches: array<struct<item_id: string, doc_start: long, item_start: long, n_words: long>>>"


def _searched(test: Windows, window: int, locations: bool):
    """A function of texts that gives ``_FOUND`` for each; locations stay empty unless asked for."""

    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows, lists, n = [], [], 0
            for i, text in enumerate(texts.tolist()):
                lists.append(words_of(text))
                n += len(lists[-1])
                if n >= SHARD_WORDS or i + 1 == len(texts):
                    made = [[len(w), [], [], [], []] for w in lists]
                    for d, starts, ends, k, w, position in _hits(lists, test, window):
                        made[d][1:] = [starts, ends, _items(test, k, w), _locations(test, k, w, position) if locations else []]
                    rows += made
                    lists, n = [], 0
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items", "matches"])

    return search


def _blocks(benchmark: DataFrame, window: int, item_col: str, item_text: str) -> tuple[int, Iterator[Windows]]:
    """The number of blocks of bounded size, and the benchmark's windows block by block; one block is held at a time."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("words"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("words"), F.lit(0))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size * 2 // BLOCK_BYTES))
    dealt = items if blocks == 1 else cut(items.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks))))
    each = (dealt if blocks == 1 else dealt.filter(F.col("block") == b) for b in range(blocks))
    return blocks, (index_windows([(r["item"], r["words"]) for r in own.collect()], window) for own in each)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text: str, locations: bool) -> DataFrame:
    """(doc, found): each row of ``docs`` as a struct, and what was found in its text."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    blocks, tests = _blocks(benchmark, window, item_col, item_text)
    if blocks == 1:
        return rows.withColumn("found", _searched(next(tests), window, locations)(F.col("doc")[text_col]))
    # What is found follows from the text: each block's pass keeps the texts with matches, and these are joined to the rows.
    key = [F.xxhash64(F.col("doc")[text_col]).alias("t"), F.octet_length(F.col("doc")[text_col]).alias("size")]
    parts = None
    for test in tests:
        own = cut(rows.select(*key, _searched(test, window, locations)(F.col("doc")[text_col]).alias("found")).filter(F.size("found.starts") > 0))
        parts = own if parts is None else parts.unionByName(own)
    once = parts.groupBy("t", "size", F.col("found.items").alias("items")).agg(F.first("found").alias("found"))  # copies are one
    lists = [F.flatten(F.collect_list(f"found.{c}")).alias(c) for c in ("starts", "ends", "items", "matches")]
    merged = cut(once.groupBy("t", "size").agg(F.first("found.n_words").alias("n_words"), *lists))
    nothing = _searched(index_windows([], window), window, False)(F.col("doc")[text_col])
    both = rows.withColumns({"t": key[0], "size": key[1]}).join(merged.withColumn("more", F.struct("n_words", "starts", "ends", "items", "matches")).select("t", "size", "more"), ["t", "size"], "left")
    return both.select("doc", F.coalesce("more", nothing).alias("found"))


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given), ``n_words``, and ``matches``: the longest verbatim matches of ``window`` words or more, with their places.

    An item with fewer words matches as a whole. Null texts have no words, null
    or repeated item ids are items of their own, repeated rows keep a row each;
    an empty benchmark matches nothing. Columns ``matches`` and ``n_words`` of
    ``docs`` are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("matches", "n_words")]
    found = _found(docs, benchmark, window, text_col, item_col, item_text, True)
    matches = F.array_sort("found.matches", lambda a, b: _compared(a, b, "doc_start", "item_id", "item_start"))
    return found.select(*(F.col("doc")[c].alias(c) for c in keep), "found.n_words", matches.alias("matches"))


def _compared(a: Column, b: Column, *names: str) -> Column:
    out = F.lit(0)
    for n in reversed(names):
        out = F.when(a[n] < b[n], -1).when(a[n] > b[n], 1).otherwise(out)
    return out


def _hit_words(found: Column) -> Column:
    """Words inside any of the hit places, in order of their starts."""
    zero = F.lit(0).cast("long")
    places = F.array_sort(F.arrays_zip(found["starts"].alias("a"), found["ends"].alias("b")))
    add = lambda acc, m: F.struct((acc["n"] + F.greatest(zero, m["b"] - F.greatest(m["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], m["b"]).alias("end"))
    return F.aggregate(places, F.struct(zero.alias("n"), zero.alias("end")), add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``; no locations are built. Edge cases are those of ``find_matches``."""
    found = _found(docs.select(id_col, text_col), benchmark, window, text_col, item_col, item_text, False)
    items = F.array_sort(F.array_distinct("found.items"))
    out = found.select(F.col("doc")[id_col].alias(id_col), F.col("found.n_words").alias("n_words"), _hit_words(F.col("found")).alias("n_hit"), items.alias("items"))
    return out.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def _contaminated(hit: Column, words: Column) -> Column:
    return (hit > 0) & (20 * hit >= words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that are not contaminated: fewer than 5 % of their words are in matches. Columns of any type pass through."""
    found = _found(docs, benchmark, window, text_col, "item_id", "text", False)
    kept = found.filter(~_contaminated(_hit_words(F.col("found")), F.col("found.n_words")))
    return kept.select(*(F.col("doc")[c].alias(c) for c in docs.columns))
