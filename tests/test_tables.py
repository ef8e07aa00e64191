"""Versions that share files, and how much a change writes."""

import datetime as dt
import os

from pyspark.sql import functions as F

from checks import bindings
from postmill.operators import lifecycle
from postmill.schemas import RAW_JOB
from postmill.sources.tables import BucketedTable
from postmill.streaming import lifecycle_stream

SCHEMA = "id long, owner string, note string"


def rows(spark, n, note="x"):
    return spark.range(n).select("id", F.concat(F.lit("o"), F.col("id") % 500).alias("owner"), F.lit(note).alias("note"))


def data_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{folder}/data") for f in files if f.endswith(".parquet"))


def test_versions_share_untouched_buckets(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ("owner",), 32)
    assert t.current() is None and t.read().count() == 0
    t.write(rows(spark, 5000), 1)
    touched = t.touched(rows(spark, 2))
    changed = t.read(1, touched).withColumn("note", F.when(F.col("owner") == "o1", "new").otherwise(F.col("note")))
    t.write(changed, 2, 1, touched)
    one, two = t.folders(1), t.folders(2)
    assert len(touched) <= 2 and {b for b in one if one[b] != two[b]} == set(touched)
    assert t.read(1).where("note = 'new'").count() == 0 and t.read(1).count() == 5000
    assert t.read().where("note = 'new'").count() == 10 and t.read().count() == 5000


def test_a_bucket_may_become_empty_and_a_retry_replaces(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ("owner",), 8)
    t.write(rows(spark, 100), 1)
    touched = t.touched(rows(spark, 1))
    for _ in range(2):
        t.write(rows(spark, 0), 2, 1, touched)
    assert set(t.folders(1)) - set(t.folders(2)) == set(touched)
    assert t.read().count() == t.read(1).count() - t.read(1, touched).count()
    t.vacuum(1)
    assert t.versions() == [2] and t.read().count() == sum(t.read(2, [b]).count() for b in t.folders(2))
    live = {os.path.dirname(f) for f in t.folders(2).values()}
    assert {f"{tmp_path}/t/data/{d}" for d in os.listdir(tmp_path / "t/data")} == live


def test_a_version_that_broke_off_is_not_read(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ("owner",), 8)
    t.write(rows(spark, 100), 1)
    t.write(rows(spark, 50, "half"), 2)
    os.remove(tmp_path / "t/versions/v=000000000002/_SUCCESS")
    assert t.versions() == [1] and t.read().count() == 100


def test_a_hot_bucket_is_several_files(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ("owner",), 4)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        t.write(spark.range(200_000).select("id", F.lit("one").alias("owner"), F.sha2(F.col("id").cast("string"), 256).alias("note")).repartition(8), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    (folder,) = t.folders(1).values()
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > 3 and t.read().count() == 200_000


def landed(spark, scan, boards, per_board=40):
    at = dt.datetime(2026, 1, 1) + dt.timedelta(days=scan)
    heads = boards.select("name_key", F.lit("lever").alias("source"), F.lit(scan).cast("long").alias("scan_id"), F.lit(True).alias("ok"), F.lit(True).alias("complete"), F.lit(at).alias("scanned_at"))
    each = boards.select("name_key", F.explode(F.sequence(F.lit(1), F.lit(per_board))).alias("n"))
    text = F.concat(F.lit("We use Python. "), F.sha2(F.concat("name_key", F.col("n").cast("string"), F.lit(str(scan))), 512))
    raw = each.select("name_key", F.lit("lever").alias("source"), F.lit("s").alias("slug"), F.lit(scan).cast("long").alias("scan_id"), F.col("n").cast("long").alias("ordinal"),
                      F.col("n").cast("string").alias("external_id"), F.lit("Data Engineer").alias("title"), F.array(F.lit("London")).alias("locations"),
                      F.array().cast("array<string>").alias("country_codes"), F.lit("https://x.com/1").alias("apply_url"), F.lit(None).cast("timestamp").alias("posted_at"),
                      F.lit(None).cast("string").alias("department"), F.lit(None).cast("string").alias("employment_type_raw"), F.lit(None).cast("string").alias("work_mode"),
                      text.alias("description_text"), F.lit(None).cast("struct<min:double,max:double,currency:string,period:string>").alias("salary"))
    assert raw.schema.names == [c.strip().split(" ")[0] for c in RAW_JOB.split(", ")]
    return lifecycle_stream.to_landed(raw, heads)


def test_a_batch_of_few_boards_writes_few_bytes(spark, tmp_path):
    boards = spark.range(300).select(F.concat(F.lit("employer "), F.col("id")).alias("name_key"))
    folder = str(tmp_path / "tables")
    lifecycle_stream.apply_batch(landed(spark, 1, boards), 0, folder)
    whole = data_bytes(f"{folder}/postings")
    before = {r.name_key: r.n for r in lifecycle_stream.current_postings(spark, folder).groupBy("name_key").agg(F.count("*").alias("n")).collect()}
    assert len(before) == 300
    few = boards.where("name_key IN ('employer 1', 'employer 2', 'employer 3')")
    lifecycle_stream.apply_batch(landed(spark, 2, few), 1, folder)
    assert data_bytes(f"{folder}/postings") - whole < 0.04 * whole
    now = lifecycle_stream.current_postings(spark, folder)
    assert now.where("changed_at IS NOT NULL").select("name_key").distinct().count() == 3
    # The same rows as a merge of the whole state.
    assert now.count() == sum(before.values())


def test_late_snapshots_are_counted_and_their_texts_not_read(spark, tmp_path, monkeypatch):
    boards = spark.createDataFrame([("acme",), ("beta",)], "name_key string")
    folder, read = str(tmp_path / "tables"), []
    normalise = lifecycle_stream.postings.normalise

    def noted(raw):
        read.append(raw.count())
        return normalise(raw)

    monkeypatch.setattr(lifecycle_stream.postings, "normalise", noted)
    lifecycle_stream.apply_batch(landed(spark, 2, boards.where("name_key = 'acme'"), 3), 0, folder)
    lifecycle_stream.apply_batch(landed(spark, 1, boards, 3), 1, folder)
    # The older snapshot of one board is late; the other board's is its first.
    assert read == [3, 3]
    assert [(r.name_key, r.scan_id) for r in lifecycle_stream.late_snapshots(spark, folder).collect()] == [("acme", 1)]
    assert lifecycle_stream.current_postings(spark, folder).count() == 6


def test_reposts_are_found_on_another_board_of_the_employer(spark, tmp_path):
    boards = spark.createDataFrame([("acme",)], "name_key string")
    folder, other = str(tmp_path / "tables"), F.lit("ashby")
    lifecycle_stream.apply_batch(landed(spark, 1, boards, 1), 0, folder)
    nothing = lambda n: landed(spark, n, boards, 1).where("kind = 'scan'")
    lifecycle_stream.apply_batch(nothing(2), 1, folder)
    lifecycle_stream.apply_batch(nothing(3), 2, folder)
    assert [r.status for r in lifecycle_stream.current_postings(spark, folder).collect()] == ["expired"]
    lifecycle_stream.apply_batch(landed(spark, 4, boards, 1).withColumn("source", other), 3, folder)
    found = {r.source: r.repost_count for r in lifecycle_stream.current_postings(spark, folder).collect()}
    assert found == {"lever": 0, "ashby": 1}
    assert lifecycle.BOARD == ["name_key", "source"]


def test_a_table_of_one_row_group_is_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = bindings.spread(spark.read.parquet(str(tmp_path / "one")))
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)


def test_totals_by_bitmaps_equal_a_count(spark):
    from postmill.operators import totals

    def some(rows):
        return spark.createDataFrame(rows, "name_key string, source string, status string, last_seen_at timestamp")

    at = dt.datetime(2026, 1, 1)
    rows = [(f"e{i % 70}", ("lever", "ashby")[i % 2], "live" if i % 3 else "expired", at + dt.timedelta(hours=i)) for i in range(500)]
    numbers = totals.number_employers(None, some(rows))
    parts = totals.live_parts(some(rows), numbers, 16)
    live = [r for r in rows if r[2] == "live"]
    one = totals.live_summary(parts).first()
    assert (one.live, one.orgs, one.last_seen_at) == (len(live), len({r[0] for r in live}), max(r[3] for r in live))
    # Two boards change and a new employer comes; all other parts are as they were.
    later = [r if r[0] not in ("e1", "e2") else (r[0], r[1], "expired", r[3]) for r in rows] + [("new", "lever", "live", at + dt.timedelta(days=99))]
    boards = spark.createDataFrame([("e1", "ashby"), ("e1", "lever"), ("e2", "lever"), ("e2", "ashby"), ("new", "lever")], "name_key string, source string")
    more = totals.number_employers(numbers, some(later))
    assert {r.name_key: r.number for r in more.collect()}.items() >= {r.name_key: r.number for r in numbers.collect()}.items()
    now = totals.refreshed(parts, some(later), more, boards, 16)
    live = [r for r in later if r[2] == "live"]
    one = totals.live_summary(now).first()
    assert (one.live, one.orgs, one.last_seen_at) == (len(live), len({r[0] for r in live}), max(r[3] for r in live))
    empty = totals.live_summary(totals.live_parts(some([]), numbers)).first()
    assert (empty.live, empty.orgs, empty.last_seen_at) == (0, 0, None)
