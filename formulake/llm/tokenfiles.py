"""Token ids in binary files: frequency ranks in bytes of variable number, with the lengths apart.

The ids of a corpus are ranked by frequency, so the commonest 256 take one byte.
Of each rank only its one to four significant bytes are stored; the lengths of
four ranks share a control byte. A block holds whole documents: a header, the
documents' ids and counts, all control bytes, all data bytes. Decoding looks the
lengths up by control byte, and masks four bytes taken at each start, in numpy.

A file is a row of blocks, in ascending order of documents; the files ascend by
name. Spark's text sink writes them (a block's bytes are the line), so they
commit with their task and lie in any store that Spark reaches; its binary
source reads them back.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, remove
from .tokens import byte_batches, encoder_for, to_bytes

#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 20
#: Ids coded at once; a multiple of 4.
SLICE = 1 << 18
MAGIC = b"FRV1"
# Magic, documents, ids, bytes of the documents' ids, bytes of data.
_HEADER = struct.Struct("<4sQQQQ")
_LENGTHS = np.stack([(np.arange(256) >> 2 * k & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers; two bits a number give its bytes less one."""
    control, data = [], []
    for a in range(0, len(ranks), SLICE):
        own = np.ascontiguousarray(ranks[a : a + SLICE], "<u4")
        code = (own > 0xFF).view(np.uint8) + (own > 0xFFFF) + (own > 0xFFFFFF)
        data.append(own.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes())
        four = np.pad(code, (0, -len(code) % 4)).reshape(-1, 4)
        control.append((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes())
    return b"".join(control), b"".join(data)


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The ``n`` numbers, slice by slice."""
    data, at = np.concatenate([data, np.zeros(3, np.uint8)]), 0
    fours = np.ndarray(len(data) - 3, "<u4", buffer=data, strides=(1,))  # four bytes from each place
    for a in range(0, n, SLICE):
        lengths = _LENGTHS[control[a // 4 : (a + SLICE) // 4]].ravel()[: n - a]
        ends = np.cumsum(lengths, dtype=np.int64)
        yield fours[at + ends - lengths] & _MASKS[lengths]
        at += int(ends[-1])


def write_block(keys: list[bytes | None], counts: list[int], ranks: np.ndarray) -> bytes:
    """One block: documents' ids (as UTF-8, null: length -1), numbers of tokens, and the ranks of all of them."""
    names = b"".join(k or b"" for k in keys)
    control, data = encode_ranks(ranks)
    sizes = np.array([-1 if k is None else len(k) for k in keys], "<i4").tobytes()
    return b"".join([_HEADER.pack(MAGIC, len(keys), len(ranks), len(names), len(data)), sizes, np.array(counts, "<u8").tobytes(), names, control, data])


def read_blocks(content: bytes) -> Iterator[tuple[list[str | None], np.ndarray, Iterator[np.ndarray]]]:
    """(documents' ids, numbers of tokens, ranks in slices) of each block of a file."""
    at, whole = 0, np.frombuffer(content, np.uint8)
    while at < len(content):
        magic, docs, n, named, size = _HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at += _HEADER.size
        sizes, counts = np.frombuffer(content, "<i4", docs, at), np.frombuffer(content, "<u8", docs, at + 4 * docs).astype(np.int64)
        at += 12 * docs
        ends = at + np.cumsum(np.maximum(sizes, 0))
        keys = [None if k < 0 else content[e - k : e].decode() for k, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        at += named
        control = whole[at : at + (n + 3) // 4]
        at += len(control)
        yield keys, counts, decode_ranks(control, whole[at : at + size], n)
        at += size + 1  # the sink's line end


def _per_document(counts: np.ndarray, slices: Iterator[np.ndarray], id_of: np.ndarray) -> Iterator[Iterator[np.ndarray]]:
    """For each document its token ids, in pieces."""
    rest = np.zeros(0, np.uint32)

    def pieces(left: int) -> Iterator[np.ndarray]:
        nonlocal rest
        while left:
            if not len(rest):
                rest = id_of[next(slices)]
            own, rest = rest[:left], rest[left:]
            left -= len(own)
            yield own

    for n in counts.tolist():
        yield pieces(n)


def _packed(ids: bytes) -> bytes:
    """Ids of 32 bits for the way to their file: a byte for the width, and those of 16 or 32 bits compressed."""
    own = np.frombuffer(ids, "<u4")
    short = not len(own) or int(own.max()) < 1 << 16
    return (b"2" if short else b"4") + pa.Codec("zstd", compression_level=3).compress(own.astype("<u2") if short else own, asbytes=True)


def _unpacked(n: int, packed: pa.BinaryScalar) -> np.ndarray:
    """The ids that ``_packed`` took."""
    whole = packed.as_buffer()
    width = whole[0] - ord("0")
    return np.frombuffer(pa.decompress(whole.slice(1), width * n, "zstd"), f"<u{width}")


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n, ids) for each row of ``docs``: number of token ids with ``end_id`` at the end, and they themselves, packed. Null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_for(path, to_bytes, b"".join), to_bytes([end_id])
        for batch in batches:
            first = 0
            for _, texts, _ in byte_batches([batch.select([1]).to_pandas()], "__text"):
                found = [x + end for x in encoder.encode(texts)]
                packed = pa.array([_packed(x) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([len(x) // 4 for x in found], pa.int64()), packed], [id_col, "n", "ids"])
                first += len(texts)

    rows = docs.select(id_col, F.col(f"`{text_col}`").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n long, ids binary")


def frequency_order(tokenized: DataFrame) -> np.ndarray:
    """All token ids that occur, the most frequent first, ties to the smaller: at most as many as the vocabulary has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            held, size = [], 0
            for k, (n, packed) in enumerate(zip(*batch.columns, strict=True)):
                held.append(_unpacked(n.as_py(), packed))
                size += len(held[-1])
                if size >= BLOCK_IDS or k + 1 == batch.num_rows:
                    found = np.bincount(np.concatenate(held), minlength=len(total))
                    found[: len(total)] += total
                    total, held, size = found, [], 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = tokenized.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(counted, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of all rows of ``docs`` to ``folder``, in ascending order of ids, nulls first, rows with equal ids in any order.

    ``folder``/ids has the files, ``folder``/ranks the token ids by rank. There
    are as many files as ``docs`` has partitions, of about equal numbers of
    documents; rows with one id spread over files like any others. Every row
    has ``end_id`` at least. An empty table gives files without documents.
    """
    spark = docs.sparkSession
    staged = f"{checkpoint_dir(spark)}/tokens-{len(folder)}-{zlib.crc32(folder.encode()):08x}"
    tokenize(docs, path, end_id, id_col, text_col).withColumn("tie", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staged)
    tokenized = spark.read.parquet(staged)
    order = frequency_order(tokenized)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, ranks, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([write_block(keys, counts, np.concatenate(ranks))], pa.binary())], ["block"])

        for batch in batches:
            for key, n, packed in zip(*batch.columns, strict=True):
                own = _unpacked(n.as_py(), packed)
                keys.append(key.as_py().encode() if key.is_valid else None)
                counts.append(len(own))
                ranks.append(rank_of[own])
                held += len(own)
                if held >= BLOCK_IDS:
                    yield block()
                    keys, counts, ranks, held = [], [], [], 0
        if keys:
            yield block()

    by = [F.asc_nulls_first(f"`{id_col}`"), F.asc("tie")]
    files = max(1, docs.rdd.getNumPartitions())
    placed = tokenized.repartitionByRange(files, *by).sortWithinPartitions(*by).select(F.col(f"`{id_col}`").cast("string").alias("key"), "n", "ids")
    placed.mapInArrow(run, "block binary").select(F.col("block").cast("string")).write.mode("overwrite").text(f"{folder}/ids")
    ranks = spark.createDataFrame([(bytearray(order.astype("<u4").tobytes()),)], "ranks binary")
    ranks.select(F.col("ranks").cast("string")).coalesce(1).write.mode("overwrite").text(f"{folder}/ranks")
    remove(spark, staged)


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id", id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """One row (id, start, n_tokens, ids_crc32, and the ids where asked for) for each document in the files of ``folder``; ``start`` counts the token ids of all documents before it."""
    kept = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/ranks").select("content").collect()
    id_of = np.frombuffer(b"".join(bytes(r["content"])[:-1] for r in kept), "<u4")  # a table of the vocabulary's size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                name, at = path.as_py().rpartition("/")[2], 0
                for keys, counts, slices in read_blocks(content.as_buffer().to_pybytes()):
                    sums, lists = [], []
                    for pieces in _per_document(counts, slices, id_of):
                        crc, own = 0, []
                        for piece in pieces:
                            crc = zlib.crc32(piece.tobytes(), crc)
                            if with_ids:
                                own.append(piece)
                        sums.append(crc)
                        if with_ids:
                            lists.append(np.concatenate(own).astype(np.int64) if own else [])
                    starts = at + np.cumsum(counts) - counts
                    at += int(counts.sum())
                    columns = [pa.array([name] * len(keys)), pa.array(keys, pa.string()), pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(lists, pa.list_(pa.int64()))] * with_ids, names)

    names = ["file", "key", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/ids").select("path", "content")
    read = cut(files.mapInArrow(run, "file string, key string, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids))
    before, places = 0, []
    for r in sorted(read.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["file"]):  # one row for each file
        places.append((r["file"], before))
        before += r["n"]
    found = read.join(F.broadcast(spark.createDataFrame(places, "file string, before long")), "file")
    return found.select(F.col("key").cast(id_type).alias(id_col), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
