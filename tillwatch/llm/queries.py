"""Registered queries of the corpus operators, with their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tillwatch.llm import (
    bpe, decontaminate, divergence, exact_dedup, hard_negatives, langid, line_dedup, simhash, sketch, substring_dedup, token_counts,
    token_files, warc)
from tillwatch.session import delete_folder, new_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS_TWIN = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of every document; crossing tokens count where they start."""
    return token_counts.by_line(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN, RANKS_TWIN)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded by the pair occurrence index and decoded again."""
    return bpe.round_trip(documents(spark, sf_dir), VOCABULARY)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts written as flat token files, then read from them."""
    folder = new_folder(spark, "tokens")
    token_files.write(documents(spark, sf_dir), folder, VOCABULARY, END_ID)
    return token_files.read(spark, folder, VOCABULARY)


def op8_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled sketches of each text, of its edit, and their likeness."""
    return sketch.compare_with_next(documents(spark, sf_dir))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from the documents not held out."""
    return langid.identify(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of whole texts: fingerprints linked at 4 or fewer differing bits."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document in a run of three lines, or of 50 words, that occurred before."""
    return line_dedup.report(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in every document."""
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat across documents, with their class and its first document."""
    return substring_dedup.repeats(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages archived as ARC (both versions), converted to WARC and read back."""
    arc, out = new_folder(spark, "arc"), new_folder(spark, "warc")
    warc.write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    warc.convert(spark, arc, out)
    delete_folder(spark, arc)
    return warc.page_report(spark, out)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ in the terms that ten of its documents hold."""
    return divergence.audit(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after moving the label of every seventh."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents equal but for white space, by the cuckoo index; the one that stays of each group."""
    return exact_dedup.duplicates(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_token_counts, op3_simhash, op4_warc, op5_langid, op6_bpe, op7_token_files, op8_sketch,
    op9_line_dedup, op10_decontaminate, op11_source_divergence, op12_hard_negatives, op13_exact_dedup)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = {
    "op9_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p,
    len(regexp_extract_all(x, '[^\x09-\x0D\x20]+')) AS n
  FROM l WHERE trim(translate(x, chr(9) || chr(13), '  ')) <> ''),
t AS (
  SELECT doc_id, p, n, lead(n) OVER d AS n2, x, lead(x, 1) OVER d AS x2, lead(x, 2) OVER d AS x3 FROM s
  WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
w AS (
  SELECT doc_id, p, 3 AS k, x || chr(10) || x2 || chr(10) || x3 AS t FROM t WHERE x3 IS NOT NULL
  UNION ALL SELECT doc_id, p, 2, x || chr(10) || x2 FROM t WHERE n < 50 AND n2 < 50 AND n + n2 >= 50
  UNION ALL SELECT doc_id, p, 1, x FROM t WHERE n >= 50),
r AS (
  SELECT doc_id, p, k, row_number() OVER (PARTITION BY k, t ORDER BY doc_id, p) AS nth FROM w),
gone AS (
  SELECT DISTINCT s.doc_id, s.i FROM s JOIN r ON s.doc_id = r.doc_id AND s.p BETWEEN r.p AND r.p + r.k - 1 AND r.nth > 1)
SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
  sha256(coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id""",
    "op10_decontaminate": """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
bg AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM bn)),
dg AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM dw, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, dg.n AS n FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m)
      GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN k ON dw.doc_id = k.doc_id""",
    "op11_source_divergence": """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
kept AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT lang, source, t, count(*) AS n FROM w GROUP BY ALL),
x AS (SELECT g.lang, g.source, kept.t, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept ON g.lang = kept.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
p AS (SELECT *, 1 + (1000000000 * (n + 2)) // (sum(n) OVER k + 2 * count(*) OVER k) AS p FROM x
      WINDOW k AS (PARTITION BY lang, source)),
l AS (SELECT lang, t, 1 + (1000000000 * (n + 2)) // (sum(n) OVER k + 2 * count(*) OVER k) AS q
      FROM (SELECT lang, t, sum(n) AS n FROM x GROUP BY lang, t) WINDOW k AS (PARTITION BY lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, source, 'term', p.t, (((p - q) * (p - q)) // (p + q))::BIGINT
  FROM p JOIN l ON p.lang = l.lang AND p.t = l.t WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM k WHERE part = 'pair' OR rank <= 10""",
    "op12_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same,
    list_inner_product(a.q, x.q)::BIGINT AS score
  FROM e a JOIN e x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5""",
    "op13_exact_dedup": """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents),
g AS (SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER w = 1 AS kept, t FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM g""",
}
