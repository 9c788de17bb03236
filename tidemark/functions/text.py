"""String and tag helpers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F


def path_slug(col: Column) -> Column:
    """Keep letters, digits, dot, underscore and dash; the rest become underscores."""
    return F.regexp_replace(col, "[^A-Za-z0-9._-]", "_")


def index_name(prefix: str, subsector: Column | None = None) -> Column:
    """Whole-universe id, or `<prefix>_<SUBSECTOR>`."""
    if subsector is None:
        return F.lit(prefix)
    return F.concat(F.lit(prefix + "_"), F.upper(subsector))


def contains_any(tags: Column, terms: Iterable[str]) -> Column:
    """TRUE if any term occurs in the joined tags, ignoring case; no terms match all."""
    joined = F.lower(F.array_join(tags, " "))
    hits = [joined.contains(term.lower()) for term in terms]
    return F.coalesce(reduce(Column.__or__, hits), F.lit(False)) if hits else F.lit(True)
