"""JSON kept in text columns, read without failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.text import strip


def parse_json(text: Column) -> Column:
    """The variant of a JSON text, null for anything else.

    ``try_parse_json`` stops after the first value and ignores what follows. Inside brackets nothing
    may follow: put into an array, the text must be its only element, and put into an object its
    value.
    """
    elements = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when((F.size(elements) == 1) & alone, F.get(elements, F.lit(0)))


def _last(text: Column, char: str) -> Column:
    """1-based place of the last occurrence, 0 if there is none."""
    back = F.instr(F.reverse(text), char)
    return F.when(back > 0, F.length(text) - back + 1).otherwise(F.lit(0))


def extract_last_json(text: Column, balanced: bool = False) -> Column:
    """The piece from the last ``{`` to the last ``}``, or ``{}`` if it is no JSON.

    With ``balanced`` the piece starts at the first ``{`` from which the rest up to the last ``}``
    parses, so a nested object keeps its outer braces.
    """
    end = _last(text, "}")
    if balanced:
        starts = F.filter(
            F.transform(F.split(text, r"\{"), lambda s: F.length(s)), lambda n: n.isNotNull()
        )
        tails = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(starts) - 1, F.lit(1))),
            lambda i: F.substring(
                text,
                F.aggregate(F.slice(starts, F.lit(1), i), F.lit(0), lambda a, n: a + n + 1),
                F.greatest(
                    end - F.aggregate(F.slice(starts, F.lit(1), i), F.lit(0), lambda a, n: a + n + 1) + 1,
                    F.lit(0),
                ),
            ),
        )
        good = F.filter(tails, lambda t: t.startswith("{") & parse_json(t).isNotNull())
        return F.coalesce(F.get(good, F.lit(0)), F.lit("{}"))
    start = _last(text, "{")
    piece = F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1))
    return F.when(parse_json(piece).isNotNull(), piece).otherwise(F.lit("{}"))


def safe_root_cause(text: Column) -> Column:
    """Root-cause JSON; other text is wrapped as ``{"root_cause": text}``; blank gives null."""
    parsed = parse_json(text)
    wrapped = F.to_json(F.struct(text.alias("root_cause")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string")).otherwise(
        F.coalesce(F.to_json(parsed), wrapped)
    )


def root_cause_text(text: Column) -> Column:
    """The ``root_cause`` field of the JSON, or the text itself if it is no JSON object."""
    parsed = parse_json(text)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(""))
        .when(is_object, F.coalesce(F.try_variant_get(parsed, "$.root_cause", "string"), F.lit("")))
        .otherwise(text)
    )


def plan_steps(text: Column) -> Column:
    """The ``steps`` of a fix plan, an empty list if there are none."""
    steps = F.when(strip(text).startswith("{"), F.try_variant_get(parse_json(text), "$.steps", "array<string>"))
    return F.coalesce(steps, F.array().cast("array<string>"))
