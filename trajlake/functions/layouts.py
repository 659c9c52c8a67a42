"""Choices made from a schema: which columns hold state, actions, language and views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trajlake.functions.text import strip

#: Names of columns in order of preference.
STATE = ("observation.state", "actions", "action")
ACTION = ("actions", "action")
LANGUAGE = ("language_instruction", "task")


def first_column(schema: StructType, names: tuple[str, ...]) -> Column:
    """The first of the columns that the schema has."""
    for name in names:
        if name in schema.names:
            return F.col(f"`{name}`")
    raise ValueError(f"none of {', '.join(names)} in {', '.join(schema.names)}")


def language(schema: StructType, default: str = "") -> Column:
    """The first text that is there and not blank, row by row."""
    held = [F.col(f"`{n}`") for n in LANGUAGE if n in schema.names]
    return F.coalesce(*(F.when(strip(c) != "", c) for c in held), F.lit(default))


def view_layout(names: list[str]) -> tuple[str, list[str]]:
    """How a data set's views are laid out: one that is joined already, three to be joined, or one; else the first by name."""
    views = sorted(n for n in names if n.startswith("observation.images."))
    short = {n.rsplit(".", 1)[1]: n for n in views}
    if "cam_concatenated" in short:
        return "joined", [short["cam_concatenated"]]
    three = [short[n] for n in ("cam_high", "cam_left_wrist", "cam_right_wrist") if n in short]
    if len(three) == 3:
        return "three", three
    if not views:
        raise ValueError("no view")
    return "single", views[:1]
