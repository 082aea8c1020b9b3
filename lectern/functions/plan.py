"""Plan-shaping helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once.

    The optimiser inlines any expression fed by a Python kernel into every later use of it, which repeats the work and
    blows up the plan. A one-element explode is a boundary it does not merge across; it adds no rows and no shuffle.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*[F.col(c) for c in others], F.explode(F.array(value)).alias(name))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


TEXT_PARTITIONS = "spark.lectern.textPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal a text table out to the number of partitions that the session asks for; unset, it is read as it lies.

    Only for inputs kept in fewer splits than there are cores, such as one small file. Such a file cannot be split below
    its row groups, so it needs a shuffle of its texts to keep all cores busy; tables of many files do not.
    """
    wanted = df.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df
