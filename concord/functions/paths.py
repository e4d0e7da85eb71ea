"""Labels and extensions read from file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """Extension with its dot, or ``''``; leading dots of a name are not one."""
    return F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1)


def _segments(path: Column) -> Column:
    return F.split(F.translate(path, "\\", "/"), "/")


def parent_folder(path: Column, default: str = "Unknown") -> Column:
    """Name of the folder that holds the file; either kind of slash."""
    return F.coalesce(F.try_element_at(_segments(path), F.lit(-2)), F.lit(default))


def first_folder(path: Column, root: str = "") -> Column:
    """First folder below ``root``; null for a file directly in the root or outside it."""
    prefix = root.rstrip("/") + "/" if root else ""
    below = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))
    parts = _segments(below)
    return F.when(F.size(parts) > 1, parts[0])
