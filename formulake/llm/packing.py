"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Bins are filled by
minimum bin slack: seeded with the largest length left, a bit set subset-sum
over the lengths left finds the fullest feasible combination, which is removed.
Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver;
a combination is applied as often as the histogram allows at once, so there are
a few thousand combinations however many pieces there are. Pieces find their
place by their rank among the pieces of their length. Ranks come from a count
for each task and length, so no task ever holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keyed_schema, number_keys, text_keys
from .tokens import byte_batches, encoder_for, to_bytes


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces at the end, the rest as the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def tokenize_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, and the ids where asked for.

    Null texts count as empty: one piece that holds ``end_id`` alone. Columns
    ``part`` and ``rank`` number the pieces of equal length within a task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(path, to_bytes, b"".join)
        end, part, seen = to_bytes([end_id]), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for f, texts, _ in byte_batches(frames, text_col):
            out = []
            for key, encoded in zip(f[id_col].tolist(), encoder.encode(texts), strict=True):
                ids = memoryview(encoded + end)
                for k, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    out.append((key, k, start, length, zlib.crc32(own), part, seen[length], *([np.frombuffer(own, "<u4").tolist()] if with_ids else ())))
                    seen[length] += 1
            yield pd.DataFrame(out, columns=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])]
    rows = docs.select(id_col, text_col)
    made = text_keys(rows, id_col).mapInPandas(run, f"{keyed_schema(rows, id_col)}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<long>" * with_ids)
    return number_keys(made, rows, id_col)


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the lengths ``left`` (length: how many) that fills ``room`` best; large lengths first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in left if x <= room and left[x]), reverse=True):
        todo, times = min(left[length], room // length), 1
        while todo:  # binary split of the copies
            k = min(times, todo)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            todo, times = todo - k, times * 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            best -= length * k
            used[length] = used.get(length, 0) + k
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(number of bins, {length: copies in each})] that use up ``histogram`` ({length: count})."""
    left, out = {k: v for k, v in histogram.items() if v}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        used = fullest(left, capacity - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        bins = min(left[x] // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= bins * k
            if not left[x]:
                del left[x]
        out.append((bins, used))
    return out


def best_fit_pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (columns length, part, rank as from ``tokenize_pieces``) with ``sequence_id`` and ``offset``.

    Every piece gets one place; sequences are gapless from offset 0 and hold at
    most ``capacity`` tokens. An empty table gives an empty one.
    """
    # At most one row for each task and length.
    runs = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = cut(runs.withColumn("before", F.coalesce(before, F.lit(0))))
    # At most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    assert len(histogram) <= capacity
    segments, taken, first = [], {}, 0
    for bins, used in minimum_bin_slack(histogram, capacity):
        at = 0
        for length in sorted(used, reverse=True):
            segments.append((length, taken.get(length, 0), first, used[length], at))
            taken[length] = taken.get(length, 0) + bins * used[length]
            at += length * used[length]
        first += bins
    table = np.array(sorted(segments), dtype=np.int64).reshape(-1, 5)
    keys, span = table[:, 0] * (1 << 50) + table[:, 1], 1 << 50
    columns = [c for c in pieces.columns if c not in ("part", "rank")]
    kinds, keys_of = dict(pieces.dtypes), [c for c in columns if c not in ("piece", "start", "length", "ids_crc32", "ids")]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(), (f["rank"] + f["before"]).to_numpy()
            row = table[np.searchsorted(keys, length * span + rank, side="right") - 1] if len(f) else table[:0]
            nth = rank - row[:, 1]
            yield f[columns].assign(sequence_id=row[:, 2] + nth // row[:, 3], offset=row[:, 4] + nth % row[:, 3] * length)

    schema = ", ".join(keyed_schema(pieces, c) if c in keys_of else f"`{c}` {kinds[c]}" for c in columns)
    placed = text_keys(pieces, *keys_of).join(runs.drop("n"), ["part", "length"]).mapInPandas(place, f"{schema}, sequence_id long, offset long")
    return number_keys(placed, pieces, *keys_of)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenizes and packs all rows of ``docs``; see ``tokenize_pieces`` and ``best_fit_pack``.

    Null ids and repeated rows are packed as rows of their own.
    """
    return best_fit_pack(cut(tokenize_pieces(docs, path, capacity, end_id, id_col, text_col, with_ids)), capacity)
