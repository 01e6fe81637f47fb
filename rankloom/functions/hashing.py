"""Reproducible hashes: the same value on every engine, executor and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 15  # 60 bits: fits a signed bigint, and the bias of a modulus stays negligible


def digest(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by '-'; plain strings and ints are literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("-", *cols))


def hash_number(*parts: Column | str | int) -> Column:
    return F.conv(F.substring(digest(*parts), 1, _HEX_DIGITS), 16, 10).cast("bigint")


def hash_share(*parts: Column | str | int) -> Column:
    """A number in [0, 1) with 32 bits."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def split_of(key: Column) -> Column:
    """train / valid / test in the proportion 8 : 1 : 1."""
    part = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 10
    return F.when(part < 8, "train").when(part == 8, "valid").otherwise("test")
