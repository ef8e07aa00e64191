"""Small column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import cut_lineage


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns of these names, whatever their case: an operator's own columns replace them."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key's text as a non-negative long; a null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def crc_of_id(key: str) -> Column:
    """crc32 of an id written as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def written(df: DataFrame, keep=cut_lineage) -> DataFrame:
    """Rows that are few for the number of shuffle partitions, written to the shared folder and read again.

    A few tasks per core write them, so that small tables do not become thousands of files.
    """
    return keep(df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism))


def released(df: DataFrame) -> DataFrame:
    """The frame itself, after asking the driver's JVM to collect garbage.

    Spark deletes the shuffle files of finished jobs when the driver's objects for them
    are collected, which a small heap may put off until long after. Called once a
    written table has replaced a large shuffle.
    """
    df.sparkSession.sparkContext._jvm.System.gc()
    return df
