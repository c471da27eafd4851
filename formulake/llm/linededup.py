"""Line dedup: repeated windows of three consecutive lines lose their later occurrences.

A line ends at a line end. Lines of over 16 words are wrapped first, by their
content: a line ends after a word whose boundary ranks before those of the three
words on either side. The rank follows from the words beside the boundary, ends
of sentences first, so a passage is wrapped alike wherever it stands, but for
four words at its ends. Windows are hashed (96 bits). The first occurrence of a
hash, by document id and position, stays; lines inside any later one are removed.
Occurrences that another one in the same batch of texts precedes are known as
later at once; a task remembers the first places of such windows from batch to
batch, so a window that many documents share is about one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WINDOW = 3
#: Longer lines are wrapped; so are longer gaps between the boundaries found.
LONG_LINE, LONG_GAP = 16, 15
#: A boundary ranks before this many on either side.
REACH = 3
#: Characters of a text that are wrapped at once; longer texts are cut before a word about there.
SPAN_CHARS = 1 << 20
#: Characters of the texts whose windows are compared at once, and bytes of a window's digest.
BATCH_CHARS, DIGEST = 2 << 20, 12
#: Repeated windows that a task remembers; what it doesn't is found by the shuffle all the same.
REMEMBERED = 100_000

_LAST = np.uint64((1 << 64) - 1)


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _ranks(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rank of the boundary after each word but the last: from the lengths of the words beside it, two characters of each, and whether a sentence ends."""
    size = end - start
    last, first = chars[end[:-1] - 1], chars[start[1:]]
    h = _mix(np.zeros(len(last), np.uint64), last)
    for x in (chars[np.maximum(end[:-1] - 2, start[:-1])], size[:-1], first, chars[np.minimum(start[1:] + 1, end[1:] - 1)], size[1:]):
        h = _mix(h, x)
    ends = (last == 46) | (last == 33) | (last == 63)
    return (h >> np.uint64(2)) | (np.where(ends, 0, 1).astype(np.uint64) << np.uint64(62))


def _cuts(text: str) -> list[int]:
    """Where lines begin, after the first: behind line ends, and at words that begin a wrapped line."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    breaks = np.flatnonzero(chars == 10) + 1
    line = np.searchsorted(breaks, start, side="right")
    n = len(start)
    if not n or np.bincount(line).max() <= LONG_LINE:
        return breaks.tolist()
    rank = np.full(n + 2 * REACH, _LAST)  # the last word of a line has no boundary
    same = line[1:] == line[:-1]
    rank[REACH : REACH + n - 1][same] = _ranks(chars, start, end)[same]
    wide = np.concatenate([[-1] * REACH, line, [-1] * REACH])
    own, chosen = rank[REACH : REACH + n], np.bincount(line)[line] > LONG_LINE
    chosen &= own < _LAST
    for d in range(1, REACH + 1):
        before, after = slice(REACH - d, REACH - d + n), slice(REACH + d, REACH + d + n)
        chosen &= (wide[before] != line) | (own < rank[before])
        chosen &= (wide[after] != line) | (own <= rank[after])
    # Gaps without any boundary are cut at their least, over and over.
    stops = np.flatnonzero(chosen | np.append(line[1:] != line[:-1], True))
    heads = np.concatenate([[0], stops[:-1] + 1])
    todo = list(zip(heads[stops - heads >= LONG_GAP].tolist(), stops[stops - heads >= LONG_GAP].tolist(), strict=True))
    counts = np.bincount(line)
    while todo:
        a, b = todo.pop()
        if b - a + 1 <= (LONG_GAP if counts[line[a]] > LONG_LINE else LONG_LINE):
            continue
        at = a + REACH + int(own[a + REACH : b - REACH].argmin())
        chosen[at] = True
        todo += [(a, at), (at + 1, b)]
    return sorted({*breaks.tolist(), *start[np.flatnonzero(chosen) + 1].tolist()})


def wrapped_lines(text: str) -> list[str]:
    """The text's lines, long ones wrapped; joined they give the text."""
    out, at = [], 0
    while at < len(text):
        stop = at + SPAN_CHARS
        while stop < len(text) and not (text[stop - 1].isspace() and not text[stop].isspace()):
            stop += 1
        span = text if not at and stop >= len(text) else text[at:stop]
        cuts = [0, *_cuts(span), len(span)]
        out += [span[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        at = stop
    return out


def window_digests(lines: list[str], window: int = WINDOW) -> bytes:
    """Digests, 12 bytes each, of the runs of ``window`` lines that have words."""
    import xxhash

    one, all_of = xxhash.xxh3_64_digest, xxhash.xxh3_128_digest
    own = [one(s.encode("utf-8", "surrogatepass")) for x in lines if (s := x.strip())]
    return b"".join([all_of(b"".join(run))[:DIGEST] for run in zip(*(own[i:] for i in range(window)), strict=False)])


def _places(f: pd.DataFrame, known: pd.DataFrame | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(high, low, id, t, k, sure) of the windows of the texts of ``f``: the first place of each; other places are ``sure`` to be later, under a hash of their own.

    ``known`` has first places in earlier texts; with it come those that are known now.
    """
    own = [window_digests(wrapped_lines(text)) for text in f["text"]]
    n = np.array([len(x) // DIGEST for x in own], np.int64)
    digests = np.frombuffer(b"".join(own), [("high", "<i8"), ("low", "<i4")])
    of = np.repeat(np.arange(len(f)), n)
    k = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    order = np.argsort(digests["high"], kind="stable")
    ordered = digests["high"][order]
    equal = ordered[1:] == ordered[:-1]
    before = np.isin(digests["high"], known["high"].to_numpy()) if known is not None else np.zeros(len(k), bool)
    before[order] |= (np.append(equal, False) | np.append(False, equal)) if len(order) else False
    often = np.flatnonzero(before)
    sure = np.zeros(len(k), bool)
    again = pd.DataFrame({"at": often, "high": digests["high"][often], "low": digests["low"][often], "id": f["id"].to_numpy()[of[often]], "t": f["t"].to_numpy()[of[often]], "k": k[often], "times": 1})
    if known is not None:
        again = pd.concat([known.assign(at=-1), again], ignore_index=True)
    again = again.sort_values(["high", "low", "id", "t", "k"])
    new = ~again.duplicated(["high", "low"]).to_numpy()
    first = np.maximum.accumulate(np.where(new, np.arange(len(again)), 0))
    # Rows of equal id and text have the same places: all of them are the first.
    other = np.zeros(len(again), bool)
    for c in ("id", "t", "k"):
        values = again[c].to_numpy()
        other |= values != values[first]
    at = again["at"].to_numpy()
    sure[at[other & (at >= 0)]] = True
    # Remembered are the first places of what was repeated, and how often.
    starts = np.flatnonzero(new)
    repeated = again[new].assign(times=np.add.reduceat(again["times"].to_numpy(), starts) if len(starts) else 0)
    repeated = repeated[repeated["times"] > 1].drop(columns="at")
    high = digests["high"].copy()
    high[sure] = f["t"].to_numpy()[of[sure]] + k[sure]
    return pd.DataFrame({"high": high, "low": digests["low"], "id": f["id"].to_numpy()[of], "t": f["t"].to_numpy()[of], "k": k, "sure": sure}), repeated


def without(lines: list[str], starts: list[int], window: int = WINDOW) -> str:
    """The text without the lines that the windows at ``starts`` cover (counted over lines with words); a line's end goes with the whole line only."""
    worded = [i for i, x in enumerate(lines) if x.strip()]
    gone = {worded[k + j] for k in starts for j in range(window)}
    kept = []
    for i, x in enumerate(lines):
        if i not in gone:
            kept.append(x)
        elif x.endswith("\n") and kept and not kept[-1].endswith("\n"):
            kept.append("\n")  # the line's head stays, so its end does
    return "".join(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated windows removed from its texts; every row stays, an emptied text is empty.

    ``length_col``, where ``docs`` has it, is set to the new length in code
    points. Rows with equal id and text are one document and are treated alike.
    Null texts stay null; null ids come first in the order of occurrences. Texts
    of fewer than three lines have no window. Other columns pass through.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # Null whole numbers travel as the smallest one: pandas would turn the column to floats.
    no_id = F.lit({"int": -(2**31), "bigint": -(2**63)}.get(kind)).cast(kind)

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None
        for f in frames:
            size, start = f["text"].str.len().to_numpy().cumsum(), 0
            while start < len(f):
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + BATCH_CHARS)))
                found, known = _places(f.iloc[start:stop], known)
                known = known.nlargest(REMEMBERED, "times") if len(known) > REMEMBERED else known
                yield found
                start = stop

    texts = docs.select(F.coalesce(F.col(id_col), no_id).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t")).filter("text IS NOT NULL")
    found = texts.mapInPandas(windows, f"high long, low int, id {kind}, t long, k int, sure boolean")
    nth = F.rank().over(Window.partitionBy("high", "low", "sure").orderBy("id", "t", "k"))
    later = found.withColumn("nth", nth).filter("nth > 1 OR sure")
    covered = cut(later.groupBy("id", "t").agg(F.collect_set("k").alias("starts")))
    return _rebuilt(docs, covered, no_id, docs.columns, id_col, text_col, length_col)


def _rebuilt(docs: DataFrame, covered: DataFrame, no_id: Column, names: list[str], id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    @F.pandas_udf("string")
    def shortened(text: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without(wrapped_lines(t), [int(k) for k in s]) for t, s in zip(text, starts, strict=True)], dtype=object)

    # The row travels as one struct, so no name of its columns can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).withColumn("key", F.xxhash64(F.col("row")[text_col]))
    both = rows.join(covered, F.coalesce(rows["row"][id_col], no_id).eqNullSafe(covered["id"]) & (rows["key"] == covered["t"]), "left")
    text = F.col("row")[text_col]
    # Texts that change go through Python; the others are sent as nulls.
    changed = F.when(F.col("starts").isNotNull(), text)
    both = both.withColumn("new", F.when(F.col("starts").isNull(), text).otherwise(shortened(changed, "starts")))
    own = {text_col: F.col("new")}
    if length_col and length_col in names:
        own[length_col] = F.length("new").cast(docs.schema[length_col].dataType)
    return both.select(*(own.get(c, F.col("row")[c]).alias(c) for c in names))
