"""Line deduplication by winnowing, in DataFrame and SQL functions only.

A document is the sequence of its lines that are not blank. A line goes if it
lies in a window that already occurred earlier, where earlier means a smaller
(doc_id, text hash, line number). A window is ``RUN`` consecutive lines, or fewer
lines that hold ``WORDS`` words together and contain no smaller such window: a
long paragraph that many documents share is a repeat by itself.

1. Fingerprints: the hash of every ``GRAM`` lines; of those inside a window the
   smallest is selected (a window of fewer lines is its own gram). Neighbouring
   windows mostly select the same one, so a document keeps one row per selected
   position, with the first and last window that chose it. The choice depends on
   the window alone, so two equal runs select the same fingerprint: none is missed.
2. Fingerprints that occur at one position only are dropped (counted, combined
   before the shuffle); the positions of the others are joined and go back to
   their documents. Documents without any leave here.
3. Each joined position is extended both ways along its document's line hashes,
   as far as the windows that chose it reach; what lies further is reached from the
   next selected position, never more than a window away. A window that occurred
   before is a hit, and hits that overlap make up a repeated run of three lines or
   more in full length. Of a run of exactly two lines where one has ``WORDS`` words or
   more, only that line is a window; the other line stays. Positions meet the
   first one only, never each other, so a passage that many documents share
   costs one row per occurrence.

An empty table gives an empty result. Nulls, repeated rows and blank texts: see
``without_repeats``. A very long text is one row with an array entry per line; all
work on it grows with its number of lines. Extra columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.session import Scratch, settle

RUN = 3
GRAM = 2
WORDS = 50
_BLANK = "trim(translate(x, '\\t\\r', '  ')) = ''"
_WORD = "[^\\\\x09-\\\\x0D\\\\x20]+"


def _once(name: str, value: str, body: str) -> str:
    """SQL for ``body`` over ``name``, a value worked out once per row and not once per use."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _words(first: int, lines: int) -> str:
    """SQL over ``n`` and ``p``: words of some lines of a window that starts at line p (1-based)."""
    return " + ".join(f"n[p + {first + i - 1}]" for i in range(lines))


def selected(run: int = RUN, gram: int = GRAM, words: int = WORDS) -> str:
    """SQL over ``h`` and ``n``, hashes and word counts of the lines: one struct per selected position.

    ``mark`` is the fingerprint, ``m`` the line where it begins (1-based), ``r`` the
    lines of the windows that chose it, ``lo`` and ``hi`` the first and last of their starts.
    """
    kinds = []
    for r in range(1, run):
        k = min(gram, r)
        least = f"{_words(0, r)} >= {words}"
        if r > 1:
            least += f" AND {_words(0, r - 1)} < {words} AND {_words(1, r - 1)} < {words}"
        grams = ", ".join(f"xxhash64(slice(h, p + {j}, {k}))" for j in range(r - k + 1))
        found = _once("g", f"array({grams})", (
            "named_struct('mark', array_min(g), 'm', p - 1 + array_position(g, array_min(g)), "
            f"'r', {r}, 'lo', p, 'hi', p)"))
        kinds.append(f"IF(size(h) < {r}, array(), transform(filter(sequence(1, size(h) - {r - 1}), p -> {least}), "
                     f"p -> {found}))")
    part = f"slice(g, p, {run - gram + 1})"
    window = f"named_struct('mark', array_min({part}), 'm', p - 1 + array_position({part}, array_min({part})))"
    position = (f"named_struct('mark', w[p - 1].mark, 'm', w[p - 1].m, 'r', {run}, 'lo', p, "
                "'hi', coalesce(get(s, x + 1) - 1, size(w)))")
    chosen = _once("g", f"transform(sequence(1, size(h) - {gram - 1}), j -> xxhash64(slice(h, j, {gram})))", _once(
        "w", f"transform(sequence(1, size(g) - {run - gram}), p -> {window})", _once(
            "s", "filter(sequence(1, size(w)), p -> p = 1 OR w[p - 1].m <> get(w, p - 2).m)",
            f"transform(s, (p, x) -> {position})")))
    kinds.append(f"IF(size(h) < {run}, array(), {chosen})")
    return f"concat({', '.join(kinds)})"


def repeated_lines(docs: DataFrame, run: int = RUN, gram: int = GRAM, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, gone): numbers (0-based) of the lines to delete, per document with any; written."""
    # Two hashes of a line: windows agree only if both do.
    split = docs.where("text IS NOT NULL").selectExpr(
        "doc_id", "xxhash64(text) AS text_hash",
        "filter(transform(split(text, '\n', -1), (x, i) -> named_struct('i', i, 'h', xxhash64(x), 'k', xxhash64(x, 1), "
        f"'n', regexp_count(x, '{_WORD}'), 'blank', {_BLANK})), x -> NOT x.blank) AS l")
    place = "named_struct('d', doc_id, 't', text_hash, 'p', {})"
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.settle(split.selectExpr("doc_id", "text_hash", "l.i AS i", "l.h AS h", "l.k AS k", "l.n AS n"))
        positions = scratch.settle(lines.selectExpr("doc_id", "text_hash", f"inline({selected(run, gram, words)})"))
        # Small sides are written before they are joined: beside a plain table Spark
        # can split the other side's hot key, beside an aggregate it can not.
        shared = scratch.settle(positions.groupBy("mark").agg(
            F.expr(f"min({place.format('m')})").alias("a"), F.expr(f"max({place.format('m')})").alias("b")).where(
            "a <> b").select("mark"))
        met = scratch.settle(positions.join(shared, "mark").groupBy("doc_id", "text_hash").agg(
            F.collect_set(F.struct("r", "lo", "hi")).alias("met")))
        extended = scratch.settle(lines.alias("l").join(
            met.alias("m"), F.expr("l.doc_id <=> m.doc_id AND l.text_hash = m.text_hash")).selectExpr(
            "l.doc_id", "l.text_hash", "inline(flatten(transform(met, x -> transform(sequence(x.lo, x.hi), "
            "p -> named_struct('p', p, 'w1', xxhash64(slice(h, p, x.r)), 'w2', xxhash64(slice(k, p, x.r)), "
            "'numbers', slice(i, p, x.r))))))"))
        first = scratch.settle(extended.groupBy("w1", "w2").agg(
            F.expr(f"min({place.format('p')})").alias("first"), F.expr(f"max({place.format('p')})").alias("last")).where(
            "first <> last").drop("last"))
        later = extended.join(first, ["w1", "w2"]).where(f"{place.format('p')} <> first")
        return settle(later.select("doc_id", "text_hash", F.explode("numbers").alias("i")).groupBy(
            "doc_id", "text_hash").agg(F.sort_array(F.collect_set("i")).alias("gone")))


def without_repeats(docs: DataFrame, run: int = RUN, gram: int = GRAM, words: int = WORDS) -> DataFrame:
    """``docs`` and the columns ``_lines``, ``_gone`` (counts) and ``_kept`` (the text that stays).

    Null texts stay null with no lines; an empty text is one blank line. Rows
    with the same doc_id and text count as one document and lose the same lines;
    null ids come before all others. Blank lines are neither compared nor deleted.
    """
    gone = repeated_lines(docs, run, gram, words).selectExpr("doc_id AS _d", "text_hash AS _t", "gone AS _g")
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"),
                       F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"))
    # One plan at every size: what is deleted grows with the documents.
    met = rows.join(gone.hint("merge"), rows["_doc"].eqNullSafe(gone["_d"]) & (rows["_hash"] == gone["_t"]), "left")
    return met.selectExpr(
        "_row", "_text",
        "IF(_text IS NULL, 0, length(_text) - length(replace(_text, '\n', '')) + 1) AS _lines",
        "coalesce(size(_g), 0) AS _gone",
        "IF(_g IS NULL, _text, array_join(transform(array(split(_text, '\n', -1)), l -> transform("
        "array_except(sequence(0, size(l) - 1), _g), i -> l[i]))[0], '\n')) AS _kept")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) per row; a null text has a null digest."""
    return without_repeats(docs).selectExpr(
        "_row.doc_id AS doc_id", "CAST(_lines AS BIGINT) AS n_lines", "CAST(_gone AS BIGINT) AS n_removed",
        "sha2(_kept, 256) AS kept_sha256")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept text; ``n_chars`` follows it. Documents that lost every line go."""
    out = without_repeats(docs).where("_gone = 0 OR trim(translate(_kept, '\n\t\r', '   ')) <> ''")
    cols = [("_kept AS text" if c == "text" else "IF(_gone = 0, _row.n_chars, length(_kept)) AS n_chars"
             if c == "n_chars" else f"_row.`{c}`") for c in docs.columns]
    return out.selectExpr(*cols)
