"""Sign-in requests over a stream: sliding window counts, and a decision for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import address_bucket
from ..sources.files import drop_old_versions, read_version, versions, write_version

REQUEST = "event_id long, created_at timestamp, email string, ip string"
HOUR, DAY = 3600, 86400
#: Counting is split at whole slots, so a key with most requests is as many groups as there are slots.
SLOT = 300
#: How far behind the newest request one may come and still be decided.
DELAY = HOUR


def windowed_counts(requests: DataFrame, window: str = "1 hour", slide: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Requests per sliding window by address, by address and client, and by client.

    The same plan runs on a batch; on a stream the watermark bounds the state.
    """
    keyed = requests.withWatermark("created_at", delay).withColumn("client", address_bucket(F.col("ip")))
    kinds = (("email", F.col("email")), ("email_client", F.concat_ws(" ", "email", "client")), ("client", F.col("client")))
    rows = keyed.select(
        "created_at", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds]))
    )
    counted = rows.groupBy(F.window("created_at", window, slide), "kind", "key").agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("kind", "key", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests")


def over_limit(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Windows in which a key reached the limit of its kind."""
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    return counts.where(F.col("requests") >= limit[F.col("kind")])


# ---------------------------------------------------------------- decisions
def _kinds() -> list[tuple[str, Column, int]]:
    """What is counted for a request: by which key, over how many seconds."""
    return [("email", F.col("email"), HOUR), ("email_client", F.concat_ws(" ", "email", "client"), HOUR), ("client", F.col("client"), HOUR), ("day", F.lit("all"), DAY)]


def earlier_requests(requests: DataFrame) -> DataFrame:
    """(event_id, by_email, by_email_client, by_client, today): requests before each one (by time, then id) within its windows.

    A request counts all before it less all up to the beginning of its window. Both
    are looked up in the same order: within a slot by a running count, and over
    slots by the running sum of their totals.
    """
    at = F.unix_micros("created_at")
    asked = requests.withColumn("client", address_bucket(F.col("ip"))).withColumn("at", at)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key"), F.lit(s * 1_000_000).cast("long").alias("span")) for k, c, s in _kinds()])
    rows = asked.select("event_id", "at", F.inline(kinds))
    ends = F.array(F.struct(F.col("at").alias("t"), F.lit(0).alias("opens")), F.struct((F.col("at") - F.col("span")).alias("t"), F.lit(1).alias("opens")))
    marks = rows.select("event_id", "kind", "key", F.inline(ends)).withColumn("slot", F.floor(F.col("t") / (SLOT * 1_000_000)))
    here = 1 - F.col("opens")
    own = Window.partitionBy("kind", "key", "slot").orderBy("t", "opens", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("inside", F.coalesce(F.sum(here).over(own), F.lit(0)))
    # One row for a key and slot: at most a few hundred for a day.
    slots = marks.groupBy("kind", "key", "slot").agg(F.sum(here).alias("n"))
    up_to = Window.partitionBy("kind", "key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))).drop("n")
    place = F.col("before") + F.col("inside")
    counts = marks.join(slots, ["kind", "key", "slot"]).withColumn("sign", F.when(F.col("opens") == 0, place).otherwise(-place))
    one = lambda kind, name: F.sum(F.when(F.col("kind") == kind, F.col("sign"))).alias(name)
    return counts.groupBy("event_id").agg(one("email", "by_email"), one("email_client", "by_email_client"), one("client", "by_client"), one("day", "today"))


def decide(requests: DataFrame, limits: dict[str, int]) -> DataFrame:
    """One decision for each request from those before it; limits as in ``reports.request_decisions``."""
    counted = requests.join(earlier_requests(requests), "event_id")
    over = (F.col("by_email") >= limits["email"]) | (F.col("by_email_client") >= limits["email_client"]) | (F.col("by_client") >= limits["client"])
    return counted.withColumn("decision", F.when(F.col("today") >= limits["day"], "daily_cap").when(over, "dropped").otherwise("allowed"))


_COUNTS = ["by_email", "by_email_client", "by_client", "today"]
DECIDED = "event_id long, created_at timestamp, by_email long, by_email_client long, by_client long, today long, decision string"


def decide_batch(batch: DataFrame, batch_id: int, folder: str, limits: dict[str, int], keep_versions: int = 3) -> None:
    """Decide the requests of one micro-batch on top of the last day's.

    The last day (and DELAY) of requests is a versioned table, numbered by batch id: a
    retry replaces its own output. A request more than DELAY behind the newest one seen
    before is `late`: it is not counted. Decisions that were made stay as they are.
    """
    spark = batch.sparkSession
    table = lambda name: f"{folder.rstrip('/')}/{name}"
    known = [v for v in versions(spark, table("recent")) if v <= batch_id]
    recent = read_version(spark, table("recent"), REQUEST, known[-1]) if known else spark.createDataFrame([], REQUEST)
    newest = recent.agg(F.max("created_at").alias("newest"))
    news = batch.select(*recent.columns).dropDuplicates(["event_id"]).join(recent.select("event_id"), "event_id", "left_anti").crossJoin(F.broadcast(newest))
    late = F.coalesce(F.col("created_at") < F.col("newest") - F.make_dt_interval(secs=F.lit(float(DELAY))), F.lit(False))
    news = news.withColumn("late", late).drop("newest")
    timely = news.where("NOT late").drop("late")
    both = recent.unionByName(timely)
    made = decide(both, limits).join(timely.select("event_id"), "event_id", "left_semi").select("event_id", "created_at", *_COUNTS, "decision")
    behind = news.where("late").select("event_id", "created_at", *[F.lit(None).cast("long").alias(c) for c in _COUNTS], F.lit("late").alias("decision"))
    write_version(made.unionByName(behind), table("decisions"), batch_id + 1)
    last = both.agg(F.max("created_at").alias("last"))
    kept = both.crossJoin(F.broadcast(last)).where(F.col("created_at") > F.col("last") - F.make_dt_interval(secs=F.lit(float(DAY + DELAY)))).drop("last")
    # The requests go last: a batch counts once they are complete.
    write_version(kept, table("recent"), batch_id + 1)
    drop_old_versions(spark, table("recent"), keep_versions)


def start(spark: SparkSession, landing: str, folder: str, checkpoint: str, limits: dict[str, int], once: bool = False) -> StreamingQuery:
    """Follow a landing folder of request files (Parquet, schema REQUEST)."""
    stream = spark.readStream.schema(REQUEST).parquet(landing)
    writer = stream.writeStream.foreachBatch(lambda df, i: decide_batch(df, i, folder, limits)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """All decisions of all complete batches."""
    root = f"{folder.rstrip('/')}/decisions"
    if not versions(spark, root):
        return spark.createDataFrame([], DECIDED)
    return spark.read.schema(DECIDED).option("recursiveFileLookup", "true").parquet(root)
