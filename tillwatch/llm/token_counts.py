"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole. Byte-level tokens have fixed lengths, so the
running sum of lengths gives every token's span; sections are spans as well and
both lists are sorted, so one merge (``searchsorted``) joins the intervals. A
token inside one section counts there. A token over a boundary goes by an
explicit rule:

    first     the section that holds its first byte
    largest   the section that holds most of its bytes, the earlier one on a tie
    share     each section gets the fraction of its bytes
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tillwatch.llm.common import steps

RULES = ("first", "largest", "share")
#: A run of white space this long overflows the stack of the pattern's look-ahead.
_LONG_SPACE = re.compile(r"\s{2000,}")


class ByteTokens:
    """Encoder of a rank file; ``twin`` is the same vocabulary for the other library."""

    def __init__(self, ranks_path: str, pattern: str, twin_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                         special_tokens={}).encode_ordinary
        self._twin_path, self._twin = twin_path, None

    def encode(self, text: str) -> np.ndarray:
        if not _LONG_SPACE.search(text):
            return np.array(self._encode(text), np.int64)
        if self._twin is None:
            self._twin = Tokenizer.from_file(self._twin_path)
            self._twin.encode_special_tokens = True
        return np.array(self._twin.encode(text, add_special_tokens=False).ids, np.int64)


_LOADED: dict[str, ByteTokens] = {}


def _encoder(ranks_path: str, pattern: str, twin_path: str) -> ByteTokens:
    if ranks_path not in _LOADED:
        _LOADED[ranks_path] = ByteTokens(ranks_path, pattern, twin_path)
    return _LOADED[ranks_path]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Token counts per section, and how many tokens of it cross its end.

    ``ends``: end byte of each token (they tile the text). ``bounds``: ascending
    end byte of each section (they tile the text too; empty sections are fine).
    """
    n = len(bounds)
    starts = np.concatenate([[0], ends[:-1]])
    # Section of a byte: the first whose end lies beyond it.
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    crossing = np.bincount(first[first != last], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossing
    whole = first == last
    counts = np.bincount(first[whole], minlength=n).astype(float)
    for t in np.flatnonzero(~whole):
        part = np.arange(first[t], last[t] + 1)
        lo = np.maximum(starts[t], np.concatenate([[0], bounds])[part])
        held = np.maximum(np.minimum(ends[t], bounds[part]) - lo, 0)
        if rule == "share":
            counts[part] += held / (ends[t] - starts[t])
        else:
            counts[part[int(np.argmax(held))]] += 1
    return counts, crossing


def line_ends(text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """End of every line (its line feed included) in bytes and in code points."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    if len(raw) == len(text):
        return ends, ends
    points = np.cumsum((data & 0xC0) != 0x80)
    return ends, points[ends - 1]


def by_line(docs: DataFrame, ranks_path: str, pattern: str, twin_path: str, rule: str = "first") -> DataFrame:
    """One row per line of every text: (doc_id, section, start_char, end_char, n_tokens, n_crossing).

    ``n_tokens`` adds up to the tokens of the whole document, ``n_crossing``
    counts tokens that start in the line and end beyond it. An empty or null
    text is one section with no tokens. Null ids and repeated rows give their
    rows like any other; other columns are not read. Rows never meet, so the
    pass has no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in steps(batches):
            encoder = _encoder(ranks_path, pattern, twin_path)
            take, cols = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    one = np.zeros(1, np.int64)
                    take.append(np.array([i]))
                    cols.append((one, one, one, one.astype(float), one))
                    continue
                raw = text.encode("utf-8")
                bounds, chars = line_ends(text, raw)
                ends = np.cumsum(encoder.lengths[encoder.encode(text)])
                counts, crossing = attribute(ends, bounds, rule)
                n = len(bounds)
                take.append(np.full(n, i))
                cols.append((np.arange(n), np.concatenate([[0], chars[:-1]]), chars, counts, crossing))
            rows = pa.array(np.concatenate(take))
            section, start, end, counts, crossing = (np.concatenate(c) for c in zip(*cols))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(section, pa.int64()), pa.array(start, pa.int64()),
                 pa.array(end, pa.int64()), pa.array(counts, pa.float64()), pa.array(crossing, pa.int64())],
                ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    out = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, section bigint, start_char bigint, end_char bigint, n_tokens double, n_crossing bigint")
    return out if rule == "share" else out.withColumn("n_tokens", out["n_tokens"].cast("bigint"))
