"""Tables laid out for the ways they are read: partitions in place of filters' indexes, buckets in place of keys'."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, written


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None, by: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """df as a table of the session in buckets of key, sorted by key and order; by: a column of few values, one folder for each.

    Rows are dealt to buckets once, one file for each bucket (and value of by); groupings, windows and joins by key read on without an exchange, and
    filters on by read its folders only. Tables that are joined by key need equal numbers of buckets.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"laid_{name}_{uuid.uuid4().hex[:8]}"
    put = df.repartition(buckets, key).write.format("parquet").option("path", f"{new_folder(spark, name)}/table").bucketBy(buckets, key).sortBy(key, *order)
    (put.partitionBy(by) if by else put).saveAsTable(table)
    return spark.table(table)


PART = "_part"


def by_parts(df: DataFrame, key: list[str], parts: int) -> DataFrame:
    """df with the part that a row's key belongs to."""
    return df.withColumn(PART, F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))


def write_parts(df: DataFrame, path: str, key: list[str], parts: int) -> None:
    """A table at path in folders by key, as upsert_parts() expects it."""
    by_parts(df, key, parts).repartition(parts, PART).write.mode("overwrite").partitionBy(PART).parquet(path)


def upsert_parts(spark: SparkSession, path: str, new: DataFrame, key: list[str], parts: int) -> list[int]:
    """Puts new rows into the table at path, in place of those of equal key; returns the parts that were written again.

    Only the parts that a new key belongs to are read and replaced; files of all others keep their names. What the parts will hold is written aside
    first, so that no part is read while it is replaced, and a run that is repeated after a loss gives the same table. Of several new rows of a key the
    largest is taken; a null in a key equals a null.
    """
    rest = [c for c in new.columns if c not in key]
    one = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else new.distinct()
    new = written(by_parts(one, key, parts), "upsert-new")
    touched = sorted(r[0] for r in new.select(PART).distinct().collect())  # as many as parts at most
    old = spark.read.schema(new.schema).parquet(path).where(F.col(PART).isin(touched))
    o, n = old.alias("o"), new.alias("n")
    stays = o.join(n.hint("merge"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in [PART, *key]], "left_anti")
    merged = written(stays.select(*new.columns).unionByName(new), "upsert-merged")
    if touched:
        merged.repartition(parts, PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return touched
