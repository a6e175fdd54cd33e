"""Token ids as flat unsigned integer files with 64-bit document offsets.

A shard holds the documents of one range of ids, ascending:

    tokens    unsigned little-endian integers (2 or 4 bytes), documents back to
              back, each closed by the end id
    index     one record of three signed 64-bit integers per document:
              doc_id, 1 (0: the id is null), first token inside the shard
    footer    number of documents, number of tokens (two 64-bit integers)
    the end id once more, as it closes whatever Spark writes as a row

All of it can be memory-mapped. Global positions are shard bases plus positions
inside the shard; the bases are prefix sums over the shards.

Spark's text writer makes the files: a row is the bytes of a document, the row
separator is the end id. So any store Spark knows works, task retries and lost
executors are covered by its commit protocol, and no task holds more than one
slice of documents and its index.
"""

from __future__ import annotations

import re
import tempfile
import unicodedata
import zlib
from array import array
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from tillwatch.llm.bpe import _PATTERN, WordBpe, _byte_chars
from tillwatch.llm.common import even_parts, steps

#: Input bytes per shard beyond which more shards than shuffle partitions are made.
SHARD_BYTES = 64 << 20
#: Words a worker remembers with their ids.
WORDS = 600_000


#: The word pattern over ASCII text in lower case, for the standard library's faster matcher.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


class _Words(dict):
    """Ids of the words met, by word; forgets all but the special tokens when it holds ``WORDS``."""

    def __init__(self, make, special: dict[str, bytes]):
        super().__init__(special)
        self.make, self.special = make, special

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
            self.update(self.special)
        ids = self[word] = self.make(word)
        return ids


class LibraryBpe(WordBpe):
    """The tokenizers library's own model on each new word; texts are rows of remembered words.

    Ids are remembered and returned in ``width`` bytes each, as the file holds them.
    """

    def __init__(self, path: str, width: int = 4):
        super().__init__(path)
        self._model = Tokenizer.from_file(path).model
        self._chars = _byte_chars()
        self._code = {2: "H", 4: "I"}[width]
        self.words = _Words(self._ids, {t: array(self._code, [i]).tobytes() for t, i in self.special.items()})

    def _words(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own, which no pattern yields."""
        if self._special and "<" in text and (m := self._special.search(text)):
            return [*self._words(text[:m.start()]), m.group(), *self._words(text[m.end():])]
        if text.isascii():
            return _ASCII.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # The library lower-cases code point by code point; Python knows one rule with context.
        return _PATTERN.findall("".join(map(str.lower, text)) if "\u03a3" in text else text.lower())

    def _ids(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = "".join([self._chars[b] for b in word.encode("utf-8", "surrogatepass")])
        return array(self._code, [t.id for t in self._model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        get, words = self.words.__getitem__, self._words
        return [b"".join(map(get, words(t))) if t else b"" for t in texts]


_LOADED: dict[tuple[str, int], LibraryBpe] = {}


def _library(path: str, width: int) -> LibraryBpe:
    if (path, width) not in _LOADED:
        _LOADED[path, width] = LibraryBpe(path, width)
    return _LOADED[path, width]


def id_width(path: str) -> int:
    """Bytes per id: 2 where the vocabulary allows it, else 4."""
    return 2 if len(WordBpe(path).tokens) <= 1 << 16 else 4


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> None:
    """Encode every text and write the shards to ``folder``.

    Documents are dealt by id ranges, then sorted inside each: null ids first,
    repeated ids by text (nulls first). A null text is empty: just the end id.
    Other columns are not read. An empty table writes no shard.
    """
    width = id_width(vocabulary)
    kind = f"<u{width}"
    end = np.array([end_id], kind).tobytes()
    base = docs.select("doc_id", "text")
    shards = even_parts(base, SHARD_BYTES)

    def pack(batches):
        index, at = [], 0
        for batch in steps(batches):
            rows = _library(vocabulary, width).encode(batch.column(1).to_pylist())
            sizes = np.array([len(x) // width + 1 for x in rows], np.int64)
            known = np.asarray(batch.column(0).is_valid())
            keys = np.asarray(batch.column(0).fill_null(0), np.int64)
            index.append(np.stack([keys, known.astype(np.int64), at + np.cumsum(sizes) - sizes], 1))
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
        if index:
            table = np.concatenate(index).astype("<i8")
            foot = np.array([len(table), at], "<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes() + foot], pa.binary())], ["value"])

    (base.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(pack, "value binary").selectExpr("CAST(value AS STRING) AS value")
     .write.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(folder))


class Shard:
    """A memory-mapped shard: ``index`` (documents x 3), ``n_tokens``, ``ids(i)``."""

    def __init__(self, file, width: int):
        raw = np.memmap(file, np.uint8, "r")
        stop = len(raw) - width
        self.n_docs, self.n_tokens = (int(x) for x in raw[stop - 16:stop].view("<i8"))
        self.index = np.frombuffer(raw[stop - 16 - 24 * self.n_docs:stop - 16].tobytes(), "<i8").reshape(-1, 3)
        self.tokens = raw[:self.n_tokens * width].view(f"<u{width}")
        self.stops = np.append(self.index[1:, 2], self.n_tokens)

    def ids(self, i: int) -> np.ndarray:
        return self.tokens[self.index[i, 2]:self.stops[i]]


def _open(path: str, content: bytes | None, width: int) -> Shard:
    """Map a shared file in place; bytes from another store go through an unnamed file."""
    if content is None:
        return Shard(unquote(path[5:] if not path.startswith("file://") else path[7:]), width)
    with tempfile.TemporaryFile() as f:
        f.write(content)
        f.flush()
        return Shard(f, width)


def read(spark: SparkSession, folder: str, vocabulary: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards.

    ``start`` counts the ids of all documents before it over all shards;
    ``ids_crc32`` covers the ids as little-endian unsigned 32-bit integers.
    """
    width = id_width(vocabulary)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    local = folder.startswith(("file:", "/"))
    files = files.selectExpr("path", "CAST(NULL AS BINARY) AS content" if local else "content")

    def shards(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield path, _open(path, content, width)

    def totals(batches):
        for path, s in shards(batches):
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [s.n_tokens]})

    def documents(batches):
        for path, s in shards(batches):
            for at in range(0, s.n_docs, 10_000):
                part = s.index[at:at + 10_000]
                crc = [zlib.crc32(s.ids(at + i).astype("<u4").tobytes()) for i in range(len(part))]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(part)),
                    "doc_id": pa.array(part[:, 0], mask=part[:, 1] == 0), "at": pa.array(part[:, 2]),
                    "n_tokens": pa.array(s.stops[at:at + 10_000] - part[:, 2]), "ids_crc32": pa.array(crc, pa.int64())})

    # One row per shard; file names ascend with the id ranges.
    bases = files.mapInArrow(totals, "path string, n bigint").selectExpr(
        "path", "coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    rows = files.mapInArrow(documents, "path string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(bases, "path").selectExpr("doc_id", "base + at AS start", "n_tokens", "ids_crc32")
