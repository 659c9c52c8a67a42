"""Batches: padding, flags, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.vectors import pad


def collate(rows: DataFrame, batch: str, tokens: str, *keep: str) -> DataFrame:
    """tokens padded with 0 at the right to the longest of the batch, mask 1 where there is a token; null tokens are dropped.  The
    longest is a small table joined back, so that a batch's rows need not meet."""
    some = rows.where(F.col(tokens).isNotNull())
    longest = some.groupBy(batch).agg(F.max(F.size(tokens)).alias("longest"))
    wide = some.join(longest, batch)
    return wide.select(batch, *keep, pad(F.col(tokens), F.col("longest"), F.lit(0).cast("long")).alias("ids"), pad(F.transform(tokens, lambda _: F.lit(1)), F.col("longest"), F.lit(0)).alias("mask"))


def optional(rows: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """The columns stay only in batches all of whose rows have them; elsewhere they are null."""
    have = rows.groupBy(batch).agg(*(F.bool_and(F.col(c).isNotNull()).alias(f"__{c}") for c in columns))
    joined = rows.join(have, batch)
    return joined.withColumns({c: F.when(F.col(f"__{c}"), F.col(c)) for c in columns}).select(*rows.columns)


def without_null(rows: DataFrame, batch: str, sample: str) -> DataFrame:
    """Rows whose sample is there; a batch without any is one row of nulls."""
    some = rows.where(F.col(sample).isNotNull())
    empty = rows.groupBy(batch).agg(F.count(sample).alias("__n")).where(F.col("__n") == 0).select(batch, *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != batch))
    return some.unionByName(empty)


def required(rows: DataFrame, *columns: str) -> DataFrame:
    """Fails where one of the columns is null."""

    def held(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is missing")).cast(rows.schema[c].dataType))

    return rows.withColumns({c: held(c) for c in columns})


def collate_fields(rows: DataFrame, batch: str, tokens: str, mask: str, *stacked: str) -> DataFrame:
    """Stacked fields as they are; tokens (needed in every row) padded to the longest of the batch with `valid` saying where there is
    one; the mask padded along, in batches all of whose rows have it."""
    some = optional(required(rows, tokens), batch, [mask])
    longest = some.groupBy(batch).agg(F.max(F.size(tokens)).alias("longest"))
    zero = F.lit(0).cast(rows.schema[tokens].dataType.elementType)
    wide = some.join(longest, batch)
    padded = pad(F.col(tokens), F.col("longest"), zero)
    valid = pad(F.transform(tokens, lambda _: F.lit(True)), F.col("longest"), F.lit(False))
    return wide.select(batch, *stacked, padded.alias(tokens), valid.alias("valid"), F.when(F.col(mask).isNotNull(), pad(F.col(mask), F.col("longest"), F.lit(False))).alias(mask))


def first_sight(rows: DataFrame, group: str, name: str, order: list[str], fixed: tuple[str, ...] = ()) -> DataFrame:
    """group, keys: the fixed names, then all others of the group's rows in the order in which each is seen first."""
    seen = rows.groupBy(group, name).agg(F.min(F.struct(*order)).alias("at"))
    others = F.collect_list(F.when(~F.col(name).isin(*fixed) if fixed else F.lit(True), F.struct("at", name)))
    keys = F.transform(F.array_sort(others), lambda e: e[name])
    return seen.groupBy(group).agg(F.concat(F.array(*map(F.lit, fixed)).cast("array<string>"), keys).alias("keys"))


def flags(rows: DataFrame, batch: Column, **conditions: Column) -> DataFrame:
    """Of each batch: whether all rows, and any row, meet each condition."""
    out = [f(c).alias(f"{kind}_{name}") for name, c in conditions.items() for kind, f in (("all", F.bool_and), ("any", F.bool_or))]
    return rows.groupBy(batch.alias("batch_id")).agg(F.count("*").alias("n"), *out)


def strided(position: Column, shards: int) -> Column:
    return F.pmod(position, F.lit(shards)).cast("long")


def contiguous(position: Column, total: Column, shards: int) -> Column:
    """Shards of ceil(total / shards) rows: the last may be short, or missing."""
    return F.floor(position / F.ceil(total / shards)).cast("long")
