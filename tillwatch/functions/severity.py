"""Severity bands and recommended actions. Three bandings exist on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwatch.functions.safe import pick
from tillwatch.model import RECOMMENDED_ACTION, SEVERITY_CUTS


def band_alert(score: Column, cuts=SEVERITY_CUTS) -> Column:
    """Alert form on 0-100: NULL below the lowest cut (no alert)."""
    return pick([(score >= cut, F.lit(name)) for cut, name in cuts])


def band_score(score: Column, cuts=SEVERITY_CUTS) -> Column:
    """Score form: NONE below the lowest cut."""
    return F.coalesce(band_alert(score, cuts), F.lit("NONE"))


def band_stream(score: Column, cuts=SEVERITY_CUTS) -> Column:
    """Stream form: everything under the MEDIUM cut is LOW, without a floor."""
    return F.coalesce(band_alert(score, cuts[:-1]), F.lit("LOW"))


def recommended_action(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RECOMMENDED_ACTION.items() for x in kv])
    return F.try_element_at(table, severity)


def percent(score: Column) -> Column:
    """[0, 1] to 0-100 with four decimals."""
    return F.round(score * F.lit(100.0), 4)
