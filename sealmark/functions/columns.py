"""Column names and values that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has: `name`, with underscores added where it is taken."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held(df: DataFrame, name: str, kept: list[str], **values: Column) -> DataFrame:
    """The kept columns of df and a struct `name` of the values, a generated row: those that use them don't take their expressions along."""
    return df.select(*kept, F.explode(F.array(F.struct(*(c.alias(n) for n, c in values.items())))).alias(name))
