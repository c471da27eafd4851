"""Secret scans: base patterns, and random strings that a token vocabulary can hardly compress."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from .common import keyed_schema, number_keys, text_keys

#: Order of kinds at equal starts.
KINDS = ("assign", "access", "hex", "random")
#: A string is random where it has fewer characters per token than this.
MAX_RATIO = 2.0
#: Shortest string that is judged.
MIN_RANDOM = 20

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
#: Known digests (MD5, SHA-1, SHA-2 in hexadecimal) and identifiers (UUID, plain numbers) are no secrets.
_KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+")
#: Identifiers fall into words at marks, digits and changes of case; words of so many letters on average, each well tokenised, make one.
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MEAN_PIECE = 3.5


def load_encoding(path: str):
    """The public vocabulary at ``path`` (ranks of byte strings) for tiktoken."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping within a kind."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    if max(map(len, text.split()), default=0) >= 32:
        found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def identifier(run: str, n_tokens) -> bool:
    """Whether ``run`` is made of words that the vocabulary knows, beside numbers and marks."""
    pieces = _PIECE.findall(run)
    letters = sum(map(len, pieces))
    return bool(pieces) and letters >= MEAN_PIECE * len(pieces) and all(len(x) >= MAX_RATIO * n_tokens(x) for x in pieces)


def random_spans(text: str, base: list[tuple[int, str, int]], n_tokens) -> list[tuple[int, str, int]]:
    """Strings of ``MIN_RANDOM`` characters or more outside the base spans, with few characters per token, but for known digests and identifiers."""
    if max(map(len, text.split()), default=0) < MIN_RANDOM:
        return []
    found, k = [], 0
    base = sorted((a, b) for a, _, b in base)
    ends = list(accumulate((b for _, b in base), max))
    for m in _RUN.finditer(text):
        run = m.group()
        while k < len(base) and ends[k] <= m.start():
            k += 1
        if k < len(base) and base[k][0] < m.end() or _KNOWN.fullmatch(run):
            continue
        if len(run) < MAX_RATIO * n_tokens(run) and not identifier(run, n_tokens):
            found.append((m.start(), "random", m.end()))
    return found


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan_secrets(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, counts by base kind, digest of the base spans, all spans.

    Offsets are code points, ends exclusive. Null texts count as empty; repeated
    rows and null ids give a row each; an empty table gives none. Texts of any
    length are scanned whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(path)
        count = lambda s: len(encoding.encode_ordinary(s))
        for f in frames:
            out = []
            for text in f[text_col].fillna(""):
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                spans = sorted(base + random_spans(text, base, count), key=lambda x: (x[0], KINDS.index(x[1])))
                out.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.concat([f[[id_col]].reset_index(drop=True), pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])], axis=1)

    rows = docs.select(id_col, text_col)
    made = text_keys(rows, id_col).mapInPandas(run, f"{keyed_schema(rows, id_col)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return number_keys(made, rows, id_col)
