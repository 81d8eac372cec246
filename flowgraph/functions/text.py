"""Parsing of edge and node lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_edge(line: Column) -> Column:
    """A line with a comma is an edge, one without is a node."""
    return F.instr(line, ",") > 0


def followed(line: Column) -> Column:
    """The key that a line counts for: all after the first comma, as it stands; a line without a comma is the key itself."""
    return F.substring(line, F.instr(line, ",") + 1, F.length(line))


def field(line: Column, i: int) -> Column:
    """The i-th comma-separated field as a whole number; null if it is missing or not one."""
    return F.get(F.split(line, ","), F.lit(i)).try_cast("bigint")
