"""Substring search by trigram posting lists.

For every three characters in a row (lower case) the index holds the ids of the rows
that have them, sorted, in blocks of BLOCK consecutive ids, so no list is unbounded.
A word's candidates have all its trigrams: for each block the lists are intersected.
The exact test follows, on the candidates alone. Words of fewer than three characters
have no trigram; then there is no index to use and all rows are candidates.

The index is a bucketed table by trigram: a search opens the buckets of its word's
trigrams and no others.

A few changed rows have trigrams in nearly every bucket, so they are not merged into
the lists at once. They wait in a second table with a row per changed id, bucketed
by id, whose word replaces whatever the lists say of that id. What a change writes
grows with the rows that wait; ``fold`` brings them into the lists now and then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.tables import BucketedTable

GRAM = 3
BLOCK = 1 << 16
SCHEMA = "gram string, block long, ids array<long>"
CHANGED = "id long, grams array<string>"


def table(spark: SparkSession, path: str, buckets: int = 256) -> BucketedTable:
    return BucketedTable(spark, path, SCHEMA, ("gram",), buckets)


def changed_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketedTable:
    """Rows that changed since the lists were written; no trigrams: the row has gone."""
    return BucketedTable(spark, path, CHANGED, ("id",), buckets)


def grams(text: Column) -> Column:
    """Distinct trigrams of a text, lower-cased; none for null and short ones."""
    return F.array_distinct(_pieces(text))


def _pieces(text: Column) -> Column:
    """Trigrams of a text in order; it is lower-cased once, not once for each of them."""

    def cut(low: Column) -> Column:
        starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM)))

    return let(F.lower(F.coalesce(text, F.lit(""))), cut)


def _every(texts: tuple[str, ...]) -> Column:
    return F.array_distinct(F.concat(*[_pieces(F.col(t)) for t in texts]))


def _lists(each: DataFrame) -> DataFrame:
    found = each.groupBy("gram", _block().alias("block")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return found.select("gram", "block", "ids")


def _block() -> Column:
    return F.floor(F.col("id") / BLOCK)


def lists(rows: DataFrame, key: str, *texts: str) -> DataFrame:
    """(gram, block, ids) of the texts of rows with a whole-number key."""
    return _lists(rows.select(F.col(key).cast("long").alias("id"), F.explode(_every(texts)).alias("gram")))


def build(index: BucketedTable, version: int, rows: DataFrame, key: str, *texts: str) -> None:
    index.write(lists(rows, key, *texts), version)


def change(changed: BucketedTable, version: int, rows: DataFrame, key: str, *texts: str, removed: DataFrame | None = None) -> None:
    """Note new and altered rows (one per key) and the keys of removed ones; a key in both is not removed.

    Reads and writes the buckets of these keys. A retry under the same version starts
    from the version before it, so nothing is noted twice.
    """
    new = rows.select(F.col(key).cast("long").alias("id"), _every(texts).alias("grams"))
    if removed is not None:
        gone = removed.select(F.col(key).cast("long").alias("id")).distinct().join(new.select("id"), "id", "left_anti")
        new = new.unionByName(gone.withColumn("grams", F.array().cast("array<string>")))
    touched = changed.touched(new)
    base = max((v for v in changed.versions() if v < version), default=None)
    if base is not None:
        new = new.unionByName(changed.read(base, touched).join(new.select("id"), "id", "left_anti"))
    changed.write(new, version, base, touched)


def fold(index: BucketedTable, changed: BucketedTable, version: int) -> None:
    """Bring the changed rows into the lists, as `version` of both tables.

    The lists are written first. If the job breaks off before the changes are cleared,
    they are still there and say the same as the lists do.
    """
    rows = changed.read()
    # A block has at most BLOCK ids, whatever the number of rows.
    out = rows.groupBy(_block().alias("block")).agg(F.collect_set("id").alias("out"))
    new = _lists(rows.select("id", F.explode("grams").alias("gram"))).withColumnRenamed("ids", "new")
    none = F.array().cast("array<long>")
    held = index.read().join(out, "block", "left").select("gram", "block", F.array_except("ids", F.coalesce("out", none)).alias("held"))
    both = held.join(new, ["gram", "block"], "full_outer")
    ids = F.sort_array(F.array_union(F.coalesce("held", none), F.coalesce("new", none)))
    index.write(both.select("gram", "block", ids.alias("ids")).where(F.size("ids") > 0), version)
    changed.write(changed.spark.createDataFrame([], CHANGED), version)


def word_grams(word: str) -> list[str]:
    low = word.lower()
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def candidates(index: BucketedTable, word: str, changed: BucketedTable | None = None) -> DataFrame | None:
    """Ids (column `id`) of rows that have all trigrams of the word; None if it has none."""
    asked = word_grams(word)
    if not asked:
        return None
    spark = index.spark
    wanted = spark.createDataFrame([(g,) for g in asked], "gram string")
    held = index.read(buckets=index.touched(wanted)).where(F.col("gram").isin(*asked))
    blocks = held.groupBy("block").agg(F.collect_list("ids").alias("l")).where(F.size("l") == len(asked))
    both = F.aggregate(F.slice("l", 2, max(len(asked) - 1, 1)), F.col("l")[0], F.array_intersect)
    found = blocks.select(F.explode(both).alias("id"))
    if changed is None or changed.current() is None:
        return found
    rows = changed.read()
    own = rows.where(F.forall(F.array(*map(F.lit, asked)), lambda g: F.array_contains("grams", g)))
    return found.join(rows.select("id"), "id", "left_anti").unionByName(own.select("id"))


def narrowed(rows: DataFrame, index: BucketedTable, key: str, word: str, changed: BucketedTable | None = None) -> DataFrame:
    """The rows that may hold the word in an indexed text; all rows for a word too short."""
    found = candidates(index, word, changed)
    return rows if found is None else rows.join(found.withColumnRenamed("id", key), key, "left_semi")
