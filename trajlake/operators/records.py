"""Checked reads of records: strict, lenient, and with typed errors; shape checks; fields by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions.text import strip


def status(value: Column, problem: Column) -> list[Column]:
    """ok, value, err of a reading: problem is null where it went well."""
    return [problem.isNull().alias("ok"), F.when(problem.isNull(), value).alias("value"), problem.alias("err")]


def number_problem(text: Column) -> Column:
    """Why a text is no number: it is missing, blank, a list, or another word."""
    return F.when(text.isNull(), "missing").when(strip(text) == "", "empty").when(strip(text).startswith("["), "list").when(strip(text).try_cast("double").isNull(), "not a number")


def strictly(value: Column, problem: Column, name: Column, kind: str = "double") -> Column:
    """The value; fails with the name and the reason where there is a problem."""
    return F.when(problem.isNull(), value).otherwise(F.raise_error(F.concat(name.cast("string"), F.lit(": "), problem)).cast(kind))


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """scanned, succeeded, failed of rows with a column ok."""
    return rows.groupBy(*by).agg(F.count("*").alias("scanned"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def problems(**rules: Column) -> Column:
    """The names of the rules that a row breaks, in order; a rule that is null is broken."""
    return F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), None).otherwise(name) for name, rule in rules.items())), lambda x: x.isNotNull())


def frame_count(length: Column, views: list[tuple[Column, Column, Column]]) -> Column:
    """The length that metadata give; where they give none or 0, the least over the views, each by its own count or else by seconds
    times rate.  Null if a view has neither."""

    def of(frames: Column, seconds: Column, rate: Column) -> Column:
        guess = F.floor(seconds * rate).cast("long")
        return F.when(frames > 0, frames).when(guess > 0, guess)

    each = [of(*v) for v in views]
    least = F.array_min(F.array(*each))
    known = each[0].isNotNull()
    for c in each[1:]:
        known &= c.isNotNull()
    return F.when(length > 0, length).when(known, least)


def without_internal(rows: DataFrame, suffix: str = "_correct") -> DataFrame:
    """Without the fields that only the making of a record needs: those whose name ends so."""
    return rows.drop(*(c for c in rows.columns if c.endswith(suffix)))


def statistic(document: Column, name: Column, field: str) -> Column:
    """The array `field` of one entry of a JSON object of statistics; null without a document, an error for a name it lacks."""
    entries = F.from_json(document, f"map<string, struct<{field}: array<double>>>")
    held = F.map_contains_key(entries, name)
    lacking = F.raise_error(F.concat(F.lit("no statistics of "), name)).cast("array<double>")
    return F.when(document.isNull(), None).when(held, F.element_at(entries, name)[field]).otherwise(lacking)
