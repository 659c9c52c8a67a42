"""Functions on arrays of numbers and on arrays of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounds, and makes negative zero zero."""
    return F.round(x, digits) + F.lit(0.0)


def normalise(x: Column, low: Column, high: Column) -> Column:
    """To [0, 1]; a range of 0 counts as 1; values outside are not clipped."""
    return (x - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def denormalise(x: Column, low: Column, high: Column) -> Column:
    return x * (high - low) + low


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def swap(rows: Column, a: Column, b: Column) -> Column:
    """The array with places a and b exchanged (0-based)."""
    return F.transform(rows, lambda x, i: F.when(i == a, F.get(rows, b)).when(i == b, F.get(rows, a)).otherwise(x))


def negate_places(row: Column, places: tuple[int, ...]) -> Column:
    """Negated at the given places; those outside the array are ignored."""
    return F.transform(row, lambda x, i: F.when(i.isin(*places), -x).otherwise(x))


def matrix(flat: Column, width: int) -> Column:
    """Rows of `width` from a flat array."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / width).cast("int") - 1), lambda i: F.slice(flat, i * width + 1, F.lit(width)))


def to_two_dimensions(depth: int, x: Column) -> Column:
    """An array of depth 1 is one row; leading dimensions of depth 3 and more are joined."""
    if depth == 1:
        return F.array(x)
    for _ in range(depth - 2):
        x = F.flatten(x)
    return x


def squeeze(x: Column) -> Column:
    """Without a leading dimension of size 1; fails on another size."""
    return F.when(F.size(x) == 1, F.get(x, F.lit(0))).when(x.isNotNull(), F.element_at(x, F.raise_error(F.concat(F.lit("leading size "), F.size(x).cast("string"))).cast("int")))


def pad(x: Column, size: Column | int, value: Column) -> Column:
    """Filled up at the right with a value, cut to the size."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.slice(F.concat(x, F.array_repeat(value, size)), F.lit(1), size)


def has_equal_neighbours(x: Column) -> Column:
    """Any two consecutive values are equal; false for arrays shorter than 2."""
    return F.coalesce(F.exists(F.arrays_zip(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))).alias("b"), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))).alias("a")), lambda p: p["a"] == p["b"]), F.lit(False))


def valid_only(values: Column, mask: Column) -> Column:
    """The values whose mask is true; null if the lengths differ."""
    return F.when(F.size(values) == F.size(mask), F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"]))


def within_bounds(rows: Column, limit: float) -> Column:
    """No absolute value is above the limit; NaN passes, as comparisons with it fail."""
    return ~F.exists(rows, lambda row: F.exists(row, lambda x: ~F.isnan(x) & (F.abs(x) > limit)))


def block(rows: Column, k: Column, size: int = 120) -> Column:
    """Rows k * size up to (k + 1) * size of a list of token rows; fails if it does not reach so far."""
    whole = F.slice(rows, (k * size + 1).cast("int"), F.lit(size))
    short = F.concat(F.lit("no token block "), k.cast("string"), F.lit(f" of {size} rows in "), F.size(rows).cast("string"))
    return F.when((k >= 0) & (F.size(whole) == size), whole).otherwise(F.raise_error(short).cast("array<double>"))


def to_single(x: Column) -> Column:
    """Half-precision numbers that are held as 16 bits (brain floats: the upper half of a single) as singles."""
    bits = F.shiftleft(x.cast("int").bitwiseAND(F.lit(0xFFFF)), 16)
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftrightunsigned(bits, 23).bitwiseAND(F.lit(0xFF))
    fraction = bits.bitwiseAND(F.lit(0x7FFFFF)) / F.lit(float(1 << 23))
    special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    value = F.when(exponent == 255, special).when(exponent == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-126))).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 127))
    return value.cast("float")
