"""Exact order statistics that never put one hot key into one task.

A plain ``Window.partitionBy(key).orderBy(value)`` sorts a whole key in one
task, and a window without keys sorts the whole table there. The helpers here
cut the value axis into pieces first, so the unit of work is (key, piece):

1. cut points come from one approximate-percentile pass, for every key on its
   own. They only balance the work; the results stay exact for any cut points;
2. rows are sorted inside (key, piece);
3. totals per (key, piece) give each piece its starting offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.session import broadcast_when_small, settle

_PIECE = "_piece"
#: Rows one piece should hold at most, and the pieces a key is cut into at most.
PIECE_ROWS = 1_000_000
MAX_PIECES = 1024
HOT_SHARE = 1000
BROADCAST_ROWS = 50_000
#: Relative error of the sketch that brackets a quantile, and the rows below which a key needs none.
SKETCH = 2_000
WHOLE_ROWS = 4 * SKETCH


def piece_count(df: DataFrame) -> int:
    """Pieces per key for a settled ``df``: grows with its rows, never below the session's parallelism."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_PIECES, max(parts, -(-df.count() // PIECE_ROWS))))


def _even(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def cut_points(df: DataFrame, value: str, pieces: int | None = None) -> list[float]:
    """Ascending distinct cut points that split ``value`` into even pieces."""
    n = pieces or piece_count(df)
    row = df.agg(F.percentile_approx(F.col(value), _even(n), 10 * n).alias("c")).first()
    return sorted({float(c) for c in (row["c"] or []) if c == c})


def with_piece(vc: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add the piece of each row. Every key has cut points of its own, so that a key
    whose values lie in a narrow range is split as evenly as any other."""
    n = piece_count(vc)
    if not keys:
        return vc.withColumn(_PIECE, piece_of(value, cut_points(vc, value, n)))
    cuts = vc.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.expr(
        f"percentile_approx(CAST(`{value}` AS DOUBLE), array({', '.join(map(repr, _even(n)))}), {10 * n})").alias("_cuts"))
    counts = vc.withColumnRenamed("n", "_rows") if "n" in vc.columns else vc
    out = join_per_value(counts, cuts, keys).withColumn(_PIECE, F.expr(_search(f"CAST(`{value}` AS DOUBLE)", "_cuts", n)))
    return out.drop("_cuts").withColumnRenamed("_rows", "n")


def _search(value: str, cuts: str, n: int) -> str:
    """SQL: how many entries of the ascending array ``cuts`` (under ``n``) lie below ``value``, by bisection."""
    steps = ", ".join(str(1 << k) for k in range(max(n, 1).bit_length() - 1, -1, -1))
    return f"aggregate(array({steps}), 0, (p, s) -> IF(get({cuts}, p + s - 1) < {value}, p + s, p))"


def piece_of(value: str, cuts: list[float]) -> Column:
    """Index of the piece a column's value falls in: a decision nest, or a search among very many cuts."""
    if len(cuts) > 128:
        return F.expr(_search(f"CAST(`{value}` AS DOUBLE)", f"array({', '.join(f'{c!r}D' for c in cuts)})", len(cuts)))

    def nest(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN `{value}` <= {cuts[mid]!r}D THEN {nest(lo, mid)} ELSE {nest(mid + 1, hi)} END"

    return F.expr(nest(0, len(cuts)))


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, str],
            piece: Column) -> DataFrame:
    """Add ``<name>`` = sum over rows of the key whose ``order`` is <= this row's.

    ``sums`` maps names to SQL expressions. Peers (equal ``order``) are included,
    as in a RANGE frame. ``piece`` must be non-decreasing in ``order``. Offsets
    have at most keys x pieces rows.
    """
    tagged = df.withColumn(_PIECE, piece).selectExpr(
        "*", *[f"{e} AS `_in_{n}`" for n, e in sums.items()])
    at = [*keys, _PIECE]
    part = ", ".join(f"`{k}`" for k in keys) or "0"
    offsets = tagged.groupBy(*at).agg(*[F.expr(f"sum(`_in_{n}`) AS `_t_{n}`") for n in sums]).selectExpr(
        *[f"`{c}`" for c in at],
        *[f"sum(`_t_{n}`) OVER (PARTITION BY {part} ORDER BY {_PIECE} "
          f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS `_b_{n}`" for n in sums])
    inside = f"PARTITION BY {', '.join(f'`{c}`' for c in at)} ORDER BY `{order}`"
    local = tagged.selectExpr(*[f"`{c}`" for c in [*df.columns, _PIECE]],
                              *[f"sum(`_in_{n}`) OVER ({inside}) AS `_l_{n}`" for n in sums])
    return local.join(offsets, at, "left").selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"`_l_{n}` + coalesce(`_b_{n}`, 0) AS `{n}`" for n in sums])


def value_counts(df: DataFrame, keys: list[str], value: str,
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, value): ``n`` and optional extra sums. Ties collapse map-side.

    The result is settled: cut points, piece sizes and the sort all read it, and
    the (possibly expensive) input runs once.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(k) for k, c in (extra or {}).items()]
    return settle(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs))


def ranked_values(df: DataFrame, keys: list[str], value: str,
                  extra: dict[str, Column] | None = None, descending: bool = False) -> DataFrame:
    """Distinct values with cumulative counts: ``n``, ``cum_n`` and ``cum_<extra>``.

    ``cum_*`` counts this value and everything ranked before it.
    """
    vc = with_piece(value_counts(df, keys, value, extra), keys, value)
    vc = vc.withColumn("_ord", -F.col(value) if descending else F.col(value)).withColumnRenamed(_PIECE, "_at")
    piece = -F.col("_at") if descending else F.col("_at")
    sums = {"cum_n": "n", **{f"cum_{k}": f"`{k}`" for k in (extra or {})}}
    return running(vc, keys, "_ord", sums, piece).drop("_ord", "_at")


def _bracketed(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Counts by (keys, piece, value), with the value kept only near a wanted rank.

    A sketch per key gives each probability a bracket a few sketch errors wide.
    Rows between the brackets collapse to one count per piece before the shuffle
    (their value is null), so only the few rows inside the brackets move. A key
    with few rows is one bracket. ``df`` is read twice; settle what is costly.
    """
    reach = 2.0 / SKETCH
    ends = [min(max(p + d, 0.0), 1.0) for d in (-reach, reach) for p in probs]
    rows = df.where(F.col(value).isNotNull()).selectExpr(*[f"`{k}`" for k in keys], f"CAST(`{value}` AS DOUBLE) AS _v")
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.expr(
        f"percentile_approx(_v, array({', '.join(f'{e!r}D' for e in ends)}), {SKETCH})").alias("_e"))
    m = len(probs)
    whole = f"n <= {WHOLE_ROWS}"
    found = found.selectExpr(
        *[f"`{k}`" for k in keys], "n",
        f"IF({whole}, array(double('-Infinity')), slice(_e, 1, {m})) AS _lo",
        f"IF({whole}, array(double('NaN')), slice(_e, {m + 1}, {m})) AS _hi")
    if keys:
        met = join_per_value(rows, found, keys).where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    else:
        one = found.first()  # two arrays of len(probs) numbers
        lo, hi = (", ".join(f"double('{x!r}')" for x in one[c] or []) for c in ("_lo", "_hi"))
        met = rows.withColumn("_lo", F.expr(f"array({lo})")).withColumn("_hi", F.expr(f"array({hi})"))
    # Brackets begun and brackets passed: both grow with the value, so their sum orders the pieces.
    tagged = met.selectExpr(*[f"`{k}`" for k in keys], "_v", "size(filter(_lo, x -> x <= _v)) AS _begun",
                            "size(filter(_hi, x -> x < _v)) AS _passed")
    return settle(tagged.selectExpr(*[f"`{k}`" for k in keys], f"_begun + _passed AS {_PIECE}",
                                    f"IF(_begun > _passed, _v, NULL) AS `{value}`").groupBy(
        *keys, _PIECE, value).agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per key, ``q`` = array in ``probs`` order.

    Only rows near a wanted rank are shuffled and sorted (``_bracketed``). Where the
    probabilities are so many that their brackets would hold most rows, or a
    bracket turns out to miss its rank, all values are counted instead; the
    result is the same. ``n`` is the number of non-null rows of the key.
    """
    if 4 * len(probs) < SKETCH // 4:
        out = _pick(_bracketed(df, keys, value, probs), keys, value, probs, bracketed=True)
        if out is not None:
            return out
    return _pick(with_piece(value_counts(df, keys, value), keys, value), keys, value, probs)


def _pick(vc: DataFrame, keys: list[str], value: str, probs: list[float], bracketed: bool = False) -> DataFrame | None:
    """Quantiles from counts by (keys, piece, value); only pieces that hold a wanted rank are sorted.

    None if a wanted rank lies among rows whose values a bracketed count dropped.
    """
    at = [*keys, _PIECE]
    part = ", ".join(f"`{k}`" for k in keys) or "0"
    sizes = vc.groupBy(*at).agg(F.sum("n").alias("piece_n"), F.bool_or(F.col(value).isNull()).alias("dropped")).selectExpr(
        *at, "piece_n", "dropped",
        f"coalesce(sum(piece_n) OVER (PARTITION BY {part} ORDER BY {_PIECE} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start",
        f"sum(piece_n) OVER (PARTITION BY {part}) AS total")
    # Ranks wanted per probability; one literal array, cut to those this piece holds.
    given = ", ".join(f"{float(p)!r}D" for p in probs)
    # A rank within rounding error of a whole number is that number: the value is
    # then a data point itself, not an interpolation a hair beside it.
    snapped = (f"transform(array({given}), p -> if(abs(p * (total - 1) - round(p * (total - 1))) "
               "< 1e-9D + 1e-12D * total, round(p * (total - 1)), p * (total - 1)))")
    wanted = (f"transform({snapped}, (r, i) -> named_struct('i', i, 'lo', floor(r), 'hi', ceil(r), "
              "'frac', r - floor(r)))")
    sizes = sizes.selectExpr(
        *at, "start", "total", "dropped",
        f"filter({wanted}, w -> (w.lo >= start AND w.lo < start + piece_n) "
        "OR (w.hi >= start AND w.hi < start + piece_n)) AS want").where("size(want) > 0")
    here = ", ".join(f"`{c}`" for c in at)
    if bracketed and not sizes.where("dropped").isEmpty():
        return None
    hit = vc.join(sizes.drop("dropped"), at).selectExpr(
        "*", f"start + sum(n) OVER (PARTITION BY {here} ORDER BY `{value}`) AS _stop")
    hit = hit.selectExpr(*keys, f"CAST(`{value}` AS DOUBLE) AS _v", "total", "_stop - n AS _first", "_stop",
                         "explode(want) AS w")
    hit = hit.selectExpr(
        *keys, "w.i AS i", "total", "w.frac AS frac",
        "CASE WHEN w.lo >= _first AND w.lo < _stop THEN _v END AS lo_v",
        "CASE WHEN w.hi >= _first AND w.hi < _stop THEN _v END AS hi_v")
    ends = hit.where("lo_v IS NOT NULL OR hi_v IS NOT NULL").groupBy(*keys, "i").agg(
        F.max("lo_v").alias("lo_v"), F.max("hi_v").alias("hi_v"), F.max("frac").alias("frac"),
        F.max("total").alias("n"))
    return ends.groupBy(*keys).agg(
        F.expr("transform(sort_array(collect_list(named_struct('i', i, 'v', lo_v + (hi_v - lo_v) * frac))), "
               "x -> x.v) AS q"), F.max("n").alias("n"))


def join_per_value(df: DataFrame, per_value: DataFrame, on: list[str],
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Attach one-row-per-key columns to ``df`` although some keys are very hot.

    ``per_value`` carries ``n``, the number of ``df`` rows with that key (dropped
    from the result). A table counted as small is broadcast whole. Otherwise
    keys holding over 1/1000 of all rows - fewer than 1000 by counting - are
    broadcast, and the remaining rows meet their key in one shuffle where the
    already served hot rows are spread by a row hash.

    Every row of ``df`` stays, at any size: a key that is null or unknown gets
    nulls. Rows with a null key are spread by hash too.
    """
    table = settle(per_value)
    cols = [c for c in table.columns if c not in on and c != "n"]
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return df.join(F.broadcast(table.drop("n")), on, "left")
    limit = table.agg(F.sum("n")).scalar() / F.lit(float(HOT_SHARE))
    hot = table.where(F.col("n") > limit).select(
        *on, *[F.col(c).alias(f"_hot_{c}") for c in cols], F.lit(True).alias("_hot"))
    cold = table.where(F.col("n") <= limit).drop("n").withColumn("_salt", F.lit(0).cast("long"))
    unkeyed = reduce(Column.__or__, [F.col(k).isNull() for k in on])
    tagged = df.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | unkeyed, F.pmod(F.xxhash64(*df.columns), F.lit(9973)) + 1)
                  .otherwise(F.lit(0)).cast("long"))
    out = tagged.join(cold, [*on, "_salt"], "left")
    rest = [c for c in df.columns if c not in on]
    return out.select(*on, *rest, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in cols])


def join_totals(df: DataFrame, totals: DataFrame, on: list[str]) -> DataFrame:
    """Attach one row per key where keys are usually few (features, runs) and so each huge.

    Few keys go by broadcast, after counting; very many keys mean no key is large.
    """
    return df.join(broadcast_when_small(settle(totals), BROADCAST_ROWS), on)


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``avg_rank`` (ties share their mean rank, 1-based) and ``group_n``."""
    ranks = ranked_values(df, keys, value)
    if keys:
        ranks = join_totals(ranks, ranks.groupBy(*keys).agg(F.sum("n").alias("group_n")), keys)
    else:
        ranks = ranks.withColumn("group_n", ranks.agg(F.sum("n")).scalar())
    ranks = ranks.select(
        *keys, value, "n", "group_n",
        (F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)).alias("avg_rank"))
    return join_per_value(df, ranks, [*keys, value])


def hash_rank(df: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """Add ``row_rank`` (0-based) by a hex digest column inside each key.

    Digests are uniform, so their first three characters are 4096 even pieces
    without any data pass.
    """
    piece = F.conv(F.substring(hash_col, 1, 3), 16, 10).cast("int")
    out = running(df, keys, hash_col, {"row_rank": "1"}, piece)
    return out.withColumn("row_rank", F.col("row_rank") - 1)
