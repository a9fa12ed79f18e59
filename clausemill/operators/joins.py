"""Joins to sides that are small as a rule, but are measured before they are sent to every task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

MOST_SENT = 16 << 20


def fits(side: DataFrame, most: int = MOST_SENT) -> bool:
    """Whether the side's rows, as text, take at most so many bytes."""
    return (side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= most


def sized_join(left: DataFrame, side: DataFrame, on, how: str = "inner", most: int = MOST_SENT) -> DataFrame:
    """left joined to side: sent to every task if it fits, else both dealt by key."""
    return left.join(side.hint("broadcast" if fits(side, most) else "merge"), on, how)


def each_once(rows: DataFrame, cols: list[str], name: str) -> DataFrame:
    """The distinct values of cols, numbered (_unit) and written, in parts of even size: what follows may cost much for each."""
    spark = rows.sparkSession
    units = rows.select(*cols).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *cols)
    return written(units.withColumn("_unit", F.monotonically_increasing_id()), name)


def put_back(rows: DataFrame, told: DataFrame, cols: list[str], most: int = MOST_SENT) -> DataFrame:
    """rows with each of the told rows of equal cols (nulls equal nulls), in place of cols.

    told, worked out once, is sent to every task if it fits; else both are dealt by cols, and AQE splits values that fill much of a part.
    """
    told = written(told, "told")
    names = {c: f"_{c}_of" for c in cols}
    side = told.withColumnsRenamed(names).hint("broadcast" if fits(told, most) else "merge")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return rows.join(side, same).drop(*cols, *names.values())
