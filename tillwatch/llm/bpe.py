"""Byte-pair encoding with a pair occurrence index, and decoding.

The vocabulary file fixes how a text is cut: white space separates, words are
lower-cased and split by a pattern, and the last symbol of a word carries a word
end. No rule reaches across white space, so a text is a row of white-space
separated chunks and each distinct chunk of a step is encoded once.

The new words of a step are laid out in one symbol array. An index maps every
mergeable pair to all its positions there; the active pairs are taken in
ascending rank, each is applied at all its live positions, and the neighbours'
pairs join the lists of their ranks. A pair that appears with a lower rank than
the current one is taken next, before the rest of the current list, as the
word-wise rule demands.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from hashlib import sha256

import numpy as np
import regex
from pyspark.sql import DataFrame

from tillwatch.llm.common import in_arrow

#: Fixed values of the format: byte-to-character table of byte-level BPE and the word pattern.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Separators Python's str.split knows beyond Unicode white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")
#: Remembered chunks and words of a worker; when full, they are forgotten and met anew.
CHUNKS, WORDS = 300_000, 300_000


def _byte_chars() -> list[str]:
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in _PRINTED:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class WordBpe:
    """One vocabulary: ``encode`` chunks to ids, ``tokens`` names ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        chars = _byte_chars()
        self.byte_ids = [vocab[c] for c in chars]
        self.end_ids = [vocab[c + end] for c in chars]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*vocab.values(), *self.special.values())
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """White-space separated chunks of a text."""
        return [c for c in _SPACE.split(text) if c] if _ODD_SPACE.search(text) else text.split()

    def _parts(self, chunk: str) -> list[str | int]:
        """Words (str) and special ids (int) of a chunk."""
        if self._special and "<" in chunk and self._special.search(chunk):
            out, at = [], 0
            for m in self._special.finditer(chunk):
                out += [*self._parts(chunk[at:m.start()]), self.special[m.group()]]
                at = m.end()
            return out + self._parts(chunk[at:])
        if not chunk.isascii():
            # The library lower-cases code point by code point, without word context.
            chunk = "".join(c.lower() for c in unicodedata.normalize("NFC", chunk))
            return _PATTERN.findall(chunk)
        return _PATTERN.findall(chunk.lower())

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks not met before."""
        new = chunks.difference(self.chunks)
        if not new:
            return
        if len(self.chunks) + len(new) > CHUNKS:
            self.chunks, new = {}, chunks
        if len(self.words) > WORDS:
            self.words = {}
        parts = {c: self._parts(c) for c in new}
        fresh = {w for ps in parts.values() for w in ps if w.__class__ is str}.difference(self.words)
        self.words.update(self.merge_all(list(fresh)))
        words = self.words
        for c, ps in parts.items():
            self.chunks[c] = b"".join([words[p] if p.__class__ is str else int(p).to_bytes(4, "little") for p in ps])

    def forget(self) -> None:
        """Drop the remembered words and chunks; the vocabulary stays."""
        self.words, self.chunks = {}, {}

    def merge_all(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian 32 bit) of each word, by the pair occurrence index."""
        sym: list[int] = []
        stops: list[int] = []
        byte_ids, end_ids, pairs = self.byte_ids, self.end_ids, self.pairs
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            sym += [byte_ids[b] for b in raw[:-1]]
            sym.append(end_ids[raw[-1]])
            sym.append(-1)  # no pair crosses it
            stops.append(len(sym) - 1)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        names: dict[int, tuple[int, int, int]] = {}
        get = pairs.get
        for p, pair in enumerate(zip(sym, sym[1:])):
            hit = get(pair)
            if hit:
                if (at := where.get(hit[0])) is None:
                    where[hit[0]] = [p]
                    names[hit[0]] = (*pair, hit[1])
                else:
                    at.append(p)
        heap = list(where)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = where.pop(rank, None)
            if places is None:
                continue
            left, right, made = names[rank]
            places.sort()
            for k, p in enumerate(places):
                q = nxt[p]
                if sym[p] != left or sym[q] != right:
                    continue  # one of the two was used by another merge
                sym[p], sym[q] = made, -2
                r = nxt[q]
                nxt[p] = r
                prv[r] = p
                lower = False
                o = prv[p]
                for at, pair in ((o, (sym[o], made)), (p, (made, sym[r]))):
                    hit = get(pair)
                    if hit:
                        new = hit[0]
                        if (spots := where.get(new)) is None:
                            where[new] = [at]
                            names[new] = (*pair, hit[1])
                            heapq.heappush(heap, new)
                        else:
                            spots.append(at)
                        lower |= new < rank
                if lower:
                    if rest := places[k + 1:]:
                        where[rank] = where.get(rank, []) + rest
                        heapq.heappush(heap, rank)
                    break
        flat = np.array(sym, np.int64)
        live = flat[flat >= 0].astype("<u4").tobytes()
        kept = np.concatenate([[0], np.cumsum(flat >= 0)]) * 4
        ends = kept[np.array(stops, np.int64)].tolist() if stops else []
        out, start = {}, 0
        for w, stop in zip(words, ends):
            out[w] = live[start:stop]
            start = stop
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null is the empty text."""
        rows = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*rows))
        get = self.chunks.__getitem__
        return [b"".join(map(get, row)) for row in rows]

    def decode(self, ids: bytes) -> str:
        """The library's decode for a vocabulary without a decoder: tokens joined by a space."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, WordBpe] = {}


def vocabulary(path: str) -> WordBpe:
    """The vocabulary at a path, loaded once in each Python worker; what it has learnt goes with the task."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): every text as little-endian 32-bit ids. Null and empty texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def make(batch):
        return {"key": batch.column(0), "ids": vocabulary(path).encode(batch.column(1).to_pylist())}

    return in_arrow(docs.selectExpr(f"`{key}`", f"`{text}` AS text"), make, f"`{key}` {kind}, ids binary",
                    done=lambda: vocabulary(path).forget())


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs``.

    Encodes and decodes whole texts in one narrow pass; no row meets another, so
    hot sources and copies cost nothing extra. Null texts count as empty, null
    ids and repeated rows stay as they are, other columns are not read.
    """
    def make(batch):
        bpe = vocabulary(path)
        ids = bpe.encode(batch.column(1).to_pylist())
        return {
            "doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), make,
                    f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                    done=lambda: vocabulary(path).forget())
