"""Addresses and display names of repositories and archives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens import constants as K
from repolens.functions.text import strip


def normalize_repo_url(url: Column) -> Column:
    """``struct(url, error)``: the clone address, or ``empty`` / ``invalid``."""
    u = F.rtrim(strip(url), F.lit("/"))
    error = F.when(u == "", F.lit("empty")).when(~u.rlike(K.REPO_URL_PATTERN), F.lit("invalid"))
    clean = F.when(u.endswith(".git"), u).otherwise(F.concat(u, F.lit(".git")))
    return F.struct(F.when(error.isNull(), clean).alias("url"), error.alias("error"))


def repo_display_name(url: Column, exact_suffix: bool = False) -> Column:
    """``owner/name`` of a clone address.

    By default any of the characters ``. g i t`` is taken off the end, so ``a/digit.git`` gives
    ``a/d``; ``exact_suffix`` takes off the ending ``.git`` only.
    """
    bare = F.regexp_replace(url, r"\.git$", "") if exact_suffix else F.rtrim(url, F.lit(".git"))
    return F.substring_index(F.rtrim(bare, F.lit("/")), "/", -2)


def archive_name(file_name: Column) -> Column:
    """Name of an uploaded archive, null if it is not a ``.zip`` file."""
    return F.when(F.lower(file_name).endswith(".zip"), F.replace(file_name, F.lit(".zip"), F.lit("")))


def display_url(url: Column) -> Column:
    """The address without its first ``.git``."""
    at = F.instr(url, ".git")
    return F.when(at > 0, F.overlay(url, F.lit(""), at, F.lit(4))).otherwise(url)
