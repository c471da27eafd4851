"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit borders, and put in another order.

A text is never split into its units. It is held as maximal runs of bytes of
one class, each with the units that ended before it; the run that holds a cut
is found by binary search, and the cut's place in it by arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of output taken together.
BATCH_BYTES = 1 << 25

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# Bytes of the character that a lead byte begins.
_WIDTH = np.select([np.arange(256) < 192, np.arange(256) < 224, np.arange(256) < 240], [1, 2, 3], 4)


class Runs:
    """The runs of a UTF-8 text in which units end: where they begin, units that ended before, and bytes of each unit.

    ``line``: runs of line ends; each line end closes a unit, and so does what
    stands after the last one. ``word``: runs of white space, of which each
    closes the word before it; white space at the start is a unit. ``char``:
    runs of characters of equal length in bytes; each character is a unit.
    """

    def __init__(self, text: bytes, unit: str) -> None:
        data = np.frombuffer(text, np.uint8)
        if unit == "char":
            leads = np.flatnonzero((data & 0xC0) != 0x80)
            classes = _WIDTH[data[leads]]
            firsts = np.flatnonzero(np.diff(classes, prepend=0))
            self.begin, self.step = leads[firsts], classes[firsts]
            units = np.diff(firsts, append=len(leads))
        else:
            closing = data == 10 if unit == "line" else _SPACE[data]
            firsts = np.flatnonzero(np.diff(closing, prepend=not closing[0])) if len(data) else np.zeros(0, np.int64)
            lengths, closes = np.diff(firsts, append=len(data)), closing[firsts]
            if len(closes):
                closes[-1] = True  # what stands last is closed by the end
            self.begin, lengths = firsts[closes], lengths[closes]
            each = closing[self.begin] if unit == "line" else np.zeros(len(lengths), bool)
            self.step, units = np.where(each, 1, lengths), np.where(each, lengths, 1)
        self.before = np.cumsum(units) - units
        self.n = int(units.sum())

    def end_of(self, units: int) -> int:
        """Where the first ``units`` units end, in bytes."""
        if not units:
            return 0
        k = int(np.searchsorted(self.before, units)) - 1
        return int(self.begin[k] + (units - self.before[k]) * self.step[k])


def characters(data: bytes) -> int:
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def transform(key: str, text: bytes, unit: str, rate: int, spm_rate: int, seed: int, sentinels: tuple[str, str, str]) -> tuple:
    """(units, form, characters of the prefix, of the middle, output) of one text; see ``fill_in_middle``."""
    p, s, m = (x.encode() for x in sentinels)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    runs = Runs(text, unit)
    if not text or p in text or s in text or m in text or h[2] % 100 >= rate:
        return runs.n, "plain", None, None, text
    a, b = sorted(runs.end_of(x % (runs.n + 1)) for x in h[:2])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return runs.n, form, characters(prefix), characters(middle), b"".join(parts)


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    ``n`` is the number of units, ``rate`` the hundredths of texts to transform,
    ``spm_rate`` those of them with the suffix first. Cuts, rate and form follow
    from a hash of ``seed`` and id alone, so repeated rows come out alike; a
    null id is hashed as an empty one. Null texts are empty; empty texts and
    those that hold a sentinel stay ``plain``, as they are. Empty tables give
    empty ones. Other columns are not read. ``restore`` gives the text back.
    """
    assert unit in ("line", "word", "char")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.columns
            made, first, size = [], 0, 0
            for i in range(batch.num_rows):
                made.append(transform(keys[i].as_py(), texts[i].as_buffer().to_pybytes(), unit, rate, spm_rate, seed, sentinels))
                size += len(made[-1][-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    columns = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(made)), *columns], names)
                    made, first, size = [], i + 1, 0

    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    own = F.col(f"`{id_col}`")
    rows = docs.select(own, F.coalesce(own.cast("string"), F.lit("")).alias("__key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("__text"))
    made = rows.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text that ``output`` was made from. Transformed texts hold no sentinel, so each stands once."""
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in sentinels), -1)
    back = lambda *order: F.concat(*(F.get(parts, k) for k in order))
    return F.when(form == "psm", back(1, 3, 2)).when(form == "spm", back(2, 3, 1)).otherwise(output)
