"""Path columns: parts, filters, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions.text import lookup_map


def posix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """From the last dot of the name; '' if that dot is first or last (``.env``, ``foo.``)."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    """The directory of a path; '' for the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def has_part(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(parts(path), F.array(*[F.lit(n) for n in names]))


def has_ext(path: Column, suffixes: list[str]) -> Column:
    return F.lower(suffix(path)).isin(suffixes)


def keep_for_analysis(path: Column) -> Column:
    return ~has_part(path, K.ANALYSIS_SKIP_PARTS)


def keep_for_profile(path: Column) -> Column:
    return ~has_part(path, K.PROFILE_SKIP_PARTS) & ~has_ext(path, K.PROFILE_SKIP_SUFFIXES)


def depth_ok(path: Column) -> Column:
    return F.size(parts(path)) <= K.TREE_DEPTH


def is_test_file(path: Column) -> Column:
    return F.contains(file_name(path), F.lit("test_")) | F.contains(path, F.lit("/tests/"))


def is_public(name: Column) -> Column:
    return ~name.startswith("_")


def language(path: Column) -> Column:
    """Language by lower-case suffix, null if unknown."""
    return F.try_element_at(lookup_map(K.LANGUAGES), F.lower(suffix(path)))


def exact_language(path: Column) -> Column:
    """Language by suffix as written (``.TSX`` is unknown)."""
    return F.try_element_at(lookup_map(K.LANGUAGES), suffix(path))
