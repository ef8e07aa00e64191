"""Sharding: a prime-sized lookup table filled in turns from each shard's own permutation.

Every shard has a preference order over the table's slots (an offset and a skip
taken from the hash of its name). Shards take turns; at its turn a shard claims
the free slot it prefers most. Shares differ by one slot at most, and when a
shard goes or comes, few other slots change hands. A row's place is then one
look-up: hash of its key, modulo the table's size, joined to the broadcast table.

Only DataFrame functions are used. The table has `size` rows whatever the data,
so its broadcast is bounded by that parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import key_hash, without

SHARDS = 16
TABLE_SIZE = 2039


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preferences(shards: DataFrame, size: int) -> DataFrame:
    """shard -> (offset, inverse of skip): slot s is its preference number (s - offset) * inverse mod size."""
    name = F.col("shard").cast("string")
    offset = key_hash(F.concat(F.lit("offset:"), name)) % size
    skip = key_hash(F.concat(F.lit("skip:"), name)) % (size - 1) + 1
    # skip ** (size - 2) is its inverse modulo the prime.
    inverse = F.aggregate(F.sequence(F.lit(1), F.lit(size - 2)), F.lit(1).cast("long"), lambda a, _: a * F.col("skip") % size)
    return shards.select("shard").distinct().select("shard", offset.alias("offset"), skip.alias("skip")).select("shard", "offset", inverse.alias("inverse"))


def lookup_table(shards: DataFrame, size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) for every slot, from a frame of shard numbers.

    Turn t belongs to shard t mod n, shards in ascending order. The fold's state
    is the list of free slots and the list of claims; both are as long as the table.
    """
    if not _is_prime(size):
        raise ValueError("the table's size must be prime")
    one = preferences(shards, size).agg(F.sort_array(F.collect_list(F.struct("shard", "offset", "inverse"))).alias("s"))

    def turn(state, t):
        s = F.col("s")[(t % F.size("s")).cast("int")]
        best = F.array_min(F.transform(state["free"], lambda f: F.pmod((f - s["offset"]) * s["inverse"], F.lit(size)) * size + f)) % size
        return F.struct(F.array_remove(state["free"], best).alias("free"), F.concat(state["claims"], F.array(best)).alias("claims"))

    start = F.struct(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")).alias("free"), F.array().cast("array<bigint>").alias("claims"))
    claims = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, turn)["claims"]
    return one.filter(F.size("s") > 0).select("s", F.posexplode(claims).alias("t", "slot")).select("slot", F.col("s")[(F.col("t") % F.size("s")).cast("int")]["shard"].alias("shard"))


def place(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """The rows with `slot` and `shard`; columns of these names in the input are replaced.

    Rows with equal keys go to one shard, repeated rows included. A null key counts
    as empty text. An empty table stays empty. Texts are not read.
    """
    if shards < 1 or shards > size:
        raise ValueError("need between one shard and as many as slots")
    spark: SparkSession = df.sparkSession
    table = lookup_table(spark.range(shards).select(F.col("id").cast("int").alias("shard")), size)
    keyed = without(df, "slot", "shard").withColumn("slot", key_hash(F.col(f"`{key}`")) % size)
    placed = keyed.join(F.broadcast(table), "slot")
    return placed.select(*[f"`{c}`" for c in keyed.columns], "shard")


SQL = f"""
WITH RECURSIVE pref AS (
  SELECT shard, CAST('0x' || substr(md5('offset:' || shard), 1, 15) AS BIGINT) % {TABLE_SIZE} AS o,
         CAST('0x' || substr(md5('skip:' || shard), 1, 15) AS BIGINT) % {TABLE_SIZE - 1} + 1 AS k
  FROM (SELECT unnest(range({SHARDS})) AS shard)),
ranks AS (
  SELECT shard, list(slot ORDER BY j) AS wants
  FROM (SELECT shard, j, (o + j * k) % {TABLE_SIZE} AS slot FROM pref, (SELECT unnest(range({TABLE_SIZE})) AS j)) GROUP BY shard),
place AS (SELECT shard, list(j ORDER BY slot) AS pos
  FROM (SELECT shard, unnest(wants) AS slot, unnest(range({TABLE_SIZE})) AS j FROM ranks) GROUP BY shard),
turns(t, free, slot) AS (
  SELECT CAST(-1 AS BIGINT), range({TABLE_SIZE}), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT t + 1, list_filter(free, lambda x: x <> best), best FROM (
    SELECT t, free, list_min(list_transform(free, lambda f: pos[f + 1] * {TABLE_SIZE} + f)) % {TABLE_SIZE} AS best
    FROM turns JOIN place ON place.shard = (t + 1) % {SHARDS} WHERE t < {TABLE_SIZE - 1}))
SELECT doc_id, h AS slot, CAST(t % {SHARDS} AS INTEGER) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS h FROM documents) d
JOIN turns ON turns.slot = d.h
"""
