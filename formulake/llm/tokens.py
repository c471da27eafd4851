"""Token counts: exact lengths under a public tokenizer, without keeping any ids.

Texts are encoded by the tokenizer's library in batches balanced by bytes. A
text is cut at safe boundaries, where nothing of the tokenizer reaches across,
so the parts encode as the whole does: long texts into chunks, and under
byte-level BPE chunks into parts, which repeat. A batch's distinct parts that the
worker doesn't know yet are encoded in one call, and a bounded table remembers
them. Parts are the pre-tokens themselves in texts of Latin letters, digits and
ASCII marks; in other texts they end before white space. Texts with special
strings or other white space, and other kinds of tokenizers, have chunks only,
which end at a space between two ASCII letters or digits.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from .common import keyed_schema, number_keys, text_keys

#: Parts that a worker process remembers, over all its tasks; when full, the table stays as it is for 8 times as many misses.
CACHE_PARTS = 250_000
#: Parts longer than this are encoded but not remembered.
CACHE_PART_CHARS = 64
#: Bytes of text taken together.
BATCH_BYTES = 1 << 20
#: Characters after which a long text is cut at the next safe boundary.
CHUNK_CHARS = 1 << 18

_PART = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
# White space other than space, tab and line ends, and controls that only some tools call white space.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
# Anything but ASCII and Latin letters: classes of such characters differ between tools.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u017f]")
# The pre-tokens of byte-level BPE over texts without unusual characters.
_PRE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+| ?[0-9]+| ?[^\sA-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|\s+(?!\S)|\s+")

# Places for chunks to end: before white space in texts that have parts; at a space between two ASCII letters or digits, before it or in its stead.
_END, _BEFORE, _AT = re.compile(r"(?<=[^ \n\t\r])(?=[ \n\t\r])"), re.compile("(?<=[A-Za-z0-9])(?= [A-Za-z0-9])"), re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_PROBES = [a + " " + b for a in ("a", "Z", "7", "ab", "it's") for b in ("a", "Z", "7", "cd", "s x")]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable ones for themselves, the others from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """Results by part, of which a bounded number is remembered. ``make``, where given, encodes a part that is missing."""

    make = None
    missed = 0

    def remember(self, part: str, value) -> None:
        if len(part) > CACHE_PART_CHARS:
            return
        if len(self) < CACHE_PARTS:
            self[part] = value
            return
        self.missed += 1  # frequent parts came early; start anew only when the texts have changed for long
        if self.missed > 8 * CACHE_PARTS:
            self.clear()
            self.missed = 0

    def __missing__(self, part: str):
        value = self.make(part)
        self.remember(part, value)
        return value


class PartEncoder:
    """Encodes texts. ``keep`` turns the ids of a part into what is remembered for it; ``fold`` joins a text's values."""

    def __init__(self, path: str, keep: Callable, fold: Callable) -> None:
        self.keep, self.fold, self.known = keep, fold, _Known()
        self.by_part, self.special, self.chunk_end = False, (), None
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self._batch = lambda texts: pieces.encode(texts, num_threads=1)
            # Words are independent where no piece holds a word's start after other characters; a chunk gets its first space back as the model's own prefix.
            apart = not any("\u2581" in pieces.id_to_piece(i).lstrip("\u2581") for i in range(pieces.get_piece_size()))
            if apart and pieces.normalize("a") == "\u2581a" and all(pieces.normalize(x) == "".join(map(pieces.normalize, x.split(" ", 1))) for x in _PROBES):
                self.chunk_end = _AT
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        pre, model, letters = library.pre_tokenizer, library.model, byte_letters()
        if keep is len:  # the lengths of the results; no ids are built
            self._batch = lambda texts: library.encode_batch_fast(texts, add_special_tokens=False)
        else:
            self._batch = lambda texts: [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
            # For ids the model itself takes single pre-tokens in half the time.
            self.known.make = lambda p: keep([t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))])
        self.special = tuple(x.content for x in library.get_added_tokens_decoder().values())
        self.by_part = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and library.normalizer is None
        if any(" " in x for x in self.special):
            return
        if self.by_part:
            self.chunk_end = _BEFORE
        elif pre is not None:

            def pieces_of(text: str) -> list[str]:
                normal = library.normalizer.normalize_str(text) if library.normalizer else text
                return [x for x, _ in pre.pre_tokenize_str(normal)]

            for end, skip in ((_AT, 1), (_BEFORE, 0)):
                if all(pieces_of(x) == pieces_of(x[: x.index(" ")]) + pieces_of(x[x.index(" ") + skip :]) for x in _PROBES):
                    self.chunk_end = end
                    break

    def _chunks(self, text: str) -> Iterator[tuple[re.Pattern | None, str]]:
        """(pattern of its parts, chunk) of a text; without a pattern the chunk is encoded as it is."""
        parts, end = None, self.chunk_end
        if self.by_part and not any(x in text for x in self.special) and not _ODD_SPACE.search(text):
            parts, end = (_PART if _UNUSUAL.search(text) else _PRE), _END
        at = 0
        while end and len(text) - at > CHUNK_CHARS and (m := end.search(text, at + CHUNK_CHARS)):
            yield parts, text[at : m.start()]
            at = m.end()
        if at < len(text):
            yield parts, text[at:] if at else text

    def encode(self, texts: list[str]) -> list:
        """The folded result of each text."""
        out: list[list] = [[] for _ in texts]
        todo, size = [], 0
        for i, text in enumerate(texts):
            for parts, chunk in self._chunks(text):
                todo.append((i, parts, chunk))
                size += len(chunk)
                if size >= BATCH_BYTES:
                    self._flush(todo, out)
                    todo, size = [], 0
        self._flush(todo, out)
        return [x[0] if len(x) == 1 else self.fold(x) for x in out]

    def _flush(self, todo: list[tuple], out: list[list]) -> None:
        """Adds the folded result of each chunk to its text's list; what is unknown is encoded in one call."""
        get, open_, new, whole = self.known.get, [], {}, []
        for i, parts, chunk in todo:
            out[i].append(None)
            if parts is None:
                whole.append((out[i], len(out[i]) - 1, chunk))
                continue
            found = parts.findall(chunk)
            if parts is _PRE and self.known.make:
                out[i][-1] = self.fold(map(self.known.__getitem__, found))
                continue
            values = list(map(get, found))
            if None in values:
                open_.append((out[i], len(out[i]) - 1, found))
                new.update((p, None) for p, v in zip(found, values, strict=True) if v is None)
            else:
                out[i][-1] = self.fold(values)
        if new or whole:
            done = map(self.keep, self._batch([*new, *(x for *_, x in whole)]))
            for part in new:
                new[part] = next(done)
            for own, k, _ in whole:
                own[k] = next(done)
        for own, k, found in open_:
            own[k] = self.fold([v if (v := get(p)) is not None else new[p] for p in found])
        for part, value in new.items():
            self.known.remember(part, value)


def to_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder_for(path: str, keep: Callable, fold: Callable) -> PartEncoder:
    """The worker process's encoder; what it remembers serves later tasks, too."""
    return PartEncoder(path, keep, fold)


def utf8_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def byte_batches(frames: Iterable[pd.DataFrame], column: str, limit: int = 4 * BATCH_BYTES) -> Iterator[tuple[pd.DataFrame, list[str], list[int]]]:
    """The rows of ``frames`` in slices of about ``limit`` bytes of ``column`` (one row at least), with its texts (null: empty) and their bytes."""
    for frame in frames:
        texts = frame[column].fillna("").tolist()
        sizes = list(map(utf8_length, texts))
        start = total = 0
        for i, n in enumerate(sizes):
            total += n
            if total >= limit or i + 1 == len(sizes):
                yield frame.iloc[start : i + 1], texts[start : i + 1], sizes[start : i + 1]
                start, total = i + 1, 0


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows
    give a row each; an empty table gives none. Other columns are not read.
    Special strings inside texts are handled as the library does by default.
    Long texts are encoded chunk by chunk.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(path, len, sum)
        for f, texts, size in byte_batches(frames, text_col):
            n = encoder.encode(texts)
            yield pd.DataFrame({id_col: f[id_col], "n_bytes": size, "n_tokens": n, "over_limit": [x > limit for x in n]})

    rows = docs.select(id_col, text_col)
    made = text_keys(rows, id_col).mapInPandas(run, f"{keyed_schema(rows, id_col)}, n_bytes long, n_tokens long, over_limit boolean")
    return number_keys(made, rows, id_col)
