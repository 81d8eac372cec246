"""Coordinates of blocks in a partitioned matrix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_of(index: Column, size: int, parts: int) -> Column:
    """The block (int, from 0) that an index below `size` lies in, if parts are of equal, rounded-up extent."""
    return F.floor(index / F.lit(-(-size // parts))).cast("int")


def rolled(index: Column, by: Column, parts: int) -> Column:
    """The index shifted back by `by` blocks, around the edge."""
    return F.pmod(index - by, F.lit(parts))
