"""Texts shown to people: sizes, scores, labels, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions.text import lookup_map


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def format_bytes(size: Column) -> Column:
    """B below 1 KiB, KB below 1 MiB, MB above; one decimal."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", size / F.lit(1024.0)))
        .otherwise(F.format_string("%.1f MB", size / F.lit(1024.0 * 1024.0)))
    )


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit("none"))
        .when(score >= 80, F.lit("green"))
        .when(score >= 60, F.lit("yellow"))
        .otherwise(F.lit("red"))
    )


def improvement_label(points: Column) -> Column:
    return (
        F.when(points > 0, F.concat(F.lit("+"), points.cast("string"), F.lit(" pts")))
        .when(points == 0, F.lit("No change"))
        .when(points < 0, F.concat(points.cast("string"), F.lit(" pts")))
    )


def confidence_pct(confidence: Column) -> Column:
    return half_up(confidence * 100)


def location(path: Column, line: Column) -> Column:
    """``path:line``; the line is left out if it is 0 or null."""
    return F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(path, F.lit(":"), line.cast("string"))).otherwise(path)


def category_label(category: Column) -> Column:
    return F.coalesce(F.try_element_at(lookup_map(K.CATEGORY_LABELS), category), category)


def iso_utc(ts: Column) -> Column:
    """ISO text; the fraction is left out if it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
