"""Path projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, or ``(no extension)``.

    Leading dots belong to the name and a trailing dot is no suffix.
    """
    found = F.regexp_extract(file_name(path), "^\\.*[^.].*(\\.[^.]+)$", 1)
    return F.when(found == "", F.lit("(no extension)")).otherwise(F.lower(found))


def parent(path: Column) -> Column:
    """All but the last component; ``.`` at the top."""
    found = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(found == "", F.lit(".")).otherwise(found)


def depth(path: Column) -> Column:
    return (F.size(F.split(path, "/")) - 1).cast("long")
