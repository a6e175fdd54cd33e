"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed runs of 1, 2 and 3 code points of the lower-cased text with
every run of non-letters as one space; the value of a feature is its relative
frequency times its inverse document frequency. Document frequencies cover all
training documents. The weights are learnt by follow-the-regularised-leader with
elastic-net penalties: each of a few shards of a bounded sample of labelled
documents runs it on its own, and the shards' weights are averaged. A
temperature fitted on sampled documents kept out of the learning calibrates the
probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import mix, steps
from tillwatch.session import Scratch

ORDERS = (1, 2, 3)
BITS = 16
UNKNOWN = "und"
#: Labelled documents per language that the classifier is fitted on, about.
SAMPLE_PER_LANGUAGE = 4_000
#: Sampled documents a shard learns from, about, and the fewest shards.
SHARD_ROWS, SHARDS = 4_000, 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
_SCALE = 8.0
_SEGMENT = 1 << 20
#: Share of the training documents that makes a feature common.
COMMON = 1e-3
#: Every fifth sampled document calibrates.
_HOLD = 5

_letter = np.zeros(1 << 16, bool)
for _c in range(1 << 16):
    _letter[_c] = chr(_c).isalpha()


def _letters(codes: np.ndarray, after_space: bool) -> np.ndarray:
    """Lower-cased letters with a single space for everything between them; none first if one came before."""
    small = codes < 1 << 16
    is_letter = _letter[np.where(small, codes, 0)]
    if not small.all():
        for c in np.unique(codes[~small]):
            if chr(int(c)).isalpha():
                is_letter[codes == c] = True
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:1] |= not after_space
    return np.where(is_letter, codes, 32)[keep].astype(np.uint64)


def features(text: str | None):
    """Arrays of feature numbers of a text, segment by segment; none without a letter.

    The runs of a text begin and end with a space. The last two code points of a
    segment are carried over, so segments give the runs of the whole text.
    """
    if not has_letter(text):
        return
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    tail, space = np.zeros(0, np.uint64), np.array([32], np.uint64)
    for at in range(0, len(codes), _SEGMENT):
        part = [tail] if len(tail) else [space]
        part.append(_letters(codes[at:at + _SEGMENT], part[0][-1] == 32))
        x = np.concatenate(part)
        if at + _SEGMENT >= len(codes) and x[-1] != 32:
            x = np.append(x, space)
        parts = []
        with np.errstate(over="ignore"):
            for n in ORDERS:
                run = x[max(len(tail) - n + 1, 0):]
                h = run[:max(len(run) - n + 1, 0)]
                for k in range(1, n):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + run[k:len(run) - n + 1 + k]
                parts.append(mix(h + np.uint64(n << 40)) >> np.uint64(64 - BITS))
        tail = x[-(max(ORDERS) - 1):]
        yield np.concatenate(parts).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def sparse(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and TF-IDF values of a text."""
    counts = np.zeros(1 << BITS)
    for f in features(text):
        counts += np.bincount(f, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    values = counts[at] / max(counts.sum(), 1) * idf[at] * _SCALE
    return at, values


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (features x classes) after ``EPOCHS`` passes of FTRL-proximal over the rows."""
    z = np.zeros((1 << BITS, classes))
    n = np.zeros((1 << BITS, classes))

    def weights(at):
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2)
        w[np.abs(za) <= L1] = 0
        return w, na

    for _ in range(EPOCHS):
        for at, values, label in rows:
            w, na = weights(at)
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p[None, :]
            n[at] = na + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(na)) / ALPHA * w
    return weights(np.arange(1 << BITS))[0]


@dataclass
class Model:
    """What prediction needs; its size depends on the languages, not on the corpus."""

    languages: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None  # features x languages, IDF included
    temperature: float = 1.0
    common: np.ndarray | None = None  # features in ``COMMON`` of the training documents or more

    def familiar(self, text: str | None) -> float:
        """Share of a text's character runs that are common in the training documents.

        Low for a script or language none of them has, whose best score says nothing.
        """
        met = n = 0
        for f in features(text):
            met += np.count_nonzero(self.common[f])
            n += len(f)
        return met / n if n else 0.0

    def logits(self, text: str | None) -> np.ndarray | None:
        total, n = np.zeros(len(self.languages)), 0
        for f in features(text):
            total += self.weights[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        return total / n * _SCALE if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        x = self.logits(text)
        if x is None:
            return UNKNOWN, 0.0
        x = x / self.temperature
        p = np.exp(x - x.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit a model to the rows with a label. Null texts teach nothing.

    Rows are sampled by a hash of key and text, at a rate that leaves about
    ``sample_per_language`` of each language, so the sample is bounded and does
    not depend on the layout. Document frequencies cover every row given.
    Without any labelled text the model knows no language.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).selectExpr(
        f"`{text}` AS text", f"`{lang}` AS lang", f"xxhash64(`{key}`, `{text}`) AS h")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model()
    languages = sorted(sizes)

    def frequencies(batches):
        seen_in, total = np.zeros(1 << BITS, np.int64), 0
        for batch in steps(batches):
            for t in batch.column(0).to_pylist():
                seen = np.zeros(1 << BITS, bool)
                for f in features(t):
                    seen[f] = True
                seen_in += seen
                total += 1
        at = np.flatnonzero(seen_in)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(at, -1), pa.int32()),
                                          "n": pa.array(np.append(seen_in[at], total), pa.int64())})

    df = rows.select("text").mapInArrow(frequencies, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    total = next((r["n"] for r in df if r["i"] < 0), 0)
    counts = np.zeros(1 << BITS)
    for r in df:
        if r["i"] >= 0:
            counts[r["i"]] = r["n"]
    idf = np.log((1 + total) / (1 + counts)) + 1
    idf = idf.astype(np.float32)

    rate = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample_per_language / sizes[k])))])
    sampled = rows.where(F.pmod("h", F.lit(1_000_003)) < F.element_at(rate, F.col("lang")) * 1_000_003)
    number = {k: i for i, k in enumerate(languages)}

    shards_n = max(SHARDS, round(sum(min(n, sample_per_language) for n in sizes.values()) / SHARD_ROWS))
    with Scratch(spark) as scratch:
        sampled = scratch.settle(sampled.withColumn("hold", F.pmod(F.shiftright("h", 20), F.lit(_HOLD)) == 0))

        def learn(batches):
            got = []
            for batch in steps(batches):
                for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at, values = sparse(t, idf)
                    if len(at):
                        got.append((at, values, number[k]))
            if got:
                w = ftrl(got, len(languages))
                i, c = np.nonzero(w)
                yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "c": pa.array(c, pa.int32()),
                                                  "w": pa.array(w[i, c]), "one": pa.array(np.zeros(len(i), np.int32))})
                yield pa.RecordBatch.from_pydict({"i": pa.array([-1], pa.int32()), "c": pa.array([0], pa.int32()),
                                                  "w": pa.array([1.0]), "one": pa.array([1], pa.int32())})

        parts = (sampled.where("NOT hold").repartition(shards_n, F.pmod(F.shiftright("h", 24), F.lit(shards_n)))
                 .sortWithinPartitions("h").select("text", "lang")
                 .mapInArrow(learn, "i int, c int, w double, one int").groupBy("i", "c").agg(F.sum("w").alias("w")).collect())
        shards = next((r["w"] for r in parts if r["i"] < 0), 1.0)
        weights = np.zeros((1 << BITS, len(languages)))
        for r in parts:
            if r["i"] >= 0:
                weights[r["i"], r["c"]] = r["w"] / shards
        model = Model(languages, (weights * idf[:, None]).astype(np.float32), common=counts >= max(COMMON * total, 1))

        def score(batches):
            for batch in steps(batches):
                got = [(model.logits(t), number[k]) for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                got = [(x.tolist(), k) for x, k in got if x is not None]
                yield pa.RecordBatch.from_pydict({"x": pa.array([g[0] for g in got], pa.list_(pa.float64())),
                                                  "k": pa.array([g[1] for g in got], pa.int32())})

        held = sampled.where("hold").select("text", "lang").mapInArrow(score, "x array<double>, k int").collect()
    if held:
        x = np.array([r["x"] for r in held])
        k = np.array([r["k"] for r in held])
        best = np.inf
        for t in np.geomspace(0.01, 10, 121):
            y = x / t
            y = y - y.max(1, keepdims=True)
            loss = float(np.mean(np.log(np.exp(y).sum(1)) - y[np.arange(len(k)), k]))
            if loss < best:
                best, model.temperature = loss, float(t)
    return model


def predicted(model: Model, text: str = "text"):
    """Column struct<lang, score> of a text column; ``und`` with score 0 for no letter or null."""
    @F.pandas_udf("lang string, score double")
    def guess(texts):
        import pandas as pd
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    return guess(F.col(text))


def held_out(key: str = "doc_id") -> str:
    """SQL: the documents no model learns from. A row without an id is not held out."""
    return f"coalesce(crc32(CAST(`{key}` AS STRING)) % 4 = 2, false)"


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row, learnt from the rows not held out.

    A null text or one without a letter is ``und`` with score 0. Rows without an
    id teach nothing and are predicted. Repeated rows are predicted each; other
    columns are not read. An empty table gives no rows.
    """
    model = train(docs.select("doc_id", "text", "lang").where(f"doc_id IS NOT NULL AND NOT {held_out()}"))
    return docs.select("doc_id", "text").withColumn("p", predicted(model)).selectExpr(
        "doc_id", f"{held_out()} AS held_out", "p.lang AS lang_pred", "p.score AS score")


def accepted(docs: DataFrame, least: float = 0.4, familiar: float = 0.5, wanted: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known, with a calibrated score of ``least`` or more.

    At least ``familiar`` of a text's character runs must be common in the training
    documents, else its language is none of theirs. ``wanted`` names the languages
    that stay (all, if None). Null texts, texts without a letter and, where nothing
    is labelled, all texts go; an empty table stays empty.
    """
    model = train(docs.select("doc_id", "text", "lang").where(f"doc_id IS NOT NULL AND NOT {held_out()}"))

    @F.pandas_udf("boolean")
    def stays(texts):
        import pandas as pd

        def one(text):
            lang, score = model.predict(text)
            return (lang != UNKNOWN and score >= least and (wanted is None or lang in wanted)
                    and model.familiar(text) >= familiar)

        return pd.Series([one(t) for t in texts], dtype=bool)

    return docs.where(stays(F.col("text")))
