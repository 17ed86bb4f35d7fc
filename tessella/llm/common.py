"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """Column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(quoted(id_column).cast("string").cast("binary")) % modulus
