"""Deterministic randomness: draws are hashes of a seed, a purpose and keys, the same in any engine and any order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: Column | str | int) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def draw(*parts: Column | str | int) -> Column:
    """An integer below 2 ** 32: the first eight hex digits of the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *map(_text, parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def drawn(*parts: object) -> int:
    """The same of Python values."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def draw_sql(*parts: str | int) -> str:
    """The same in DuckDB; strings are SQL expressions."""
    joined = " || ':' || ".join(f"'{p}'" if isinstance(p, int) else f"({p})::varchar" for p in parts)
    return f"('0x' || substr(md5({joined}), 1, 8))::bigint"


def below(limit: Column, *parts: Column | str | int) -> Column:
    """A draw from 0 to limit - 1."""
    return draw(*parts) % limit
