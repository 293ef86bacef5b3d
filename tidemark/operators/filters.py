"""Choosing files by shell patterns.

``compat`` is what the synchroniser does: folders are judged, too, from the root
('.') down, and nothing below a rejected folder is reached. ``contract`` is what
its documentation describes: files alone are judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import glob
from tidemark.functions.scalars import ancestors

Patterns = list[str] | tuple[str, ...]


def filter_files(files: DataFrame, include: Patterns = (), exclude: Patterns = ()) -> DataFrame:
    """Contract mode: files whose path passes."""
    return files.where(glob.passes(F.col("path"), include, exclude))


def filter_pruned(files: DataFrame, include: Patterns = (), exclude: Patterns = ()) -> DataFrame:
    """Compat mode: files that pass and all of whose folders do, with '.' for the root."""
    return files.where(F.forall(ancestors(F.col("path")), lambda a: glob.passes(a, include, exclude)))


def filter_by_data(files: DataFrame, include: str, exclude: str) -> DataFrame:
    """Patterns from columns of regexes (arrays); an empty include array lets all pass."""
    hit = lambda c: F.exists(c, lambda p: F.rlike("path", p))
    return files.where(~hit(exclude) & ((F.size(include) == 0) | hit(include)))
