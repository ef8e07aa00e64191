"""Sharding and mixing against plain folds."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.llm import mixing, sharding


def digest(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain_table(shards, size):
    wants = [[(digest(f"offset:{s}") + j * (digest(f"skip:{s}") % (size - 1) + 1)) % size for j in range(size)] for s in range(shards)]
    owner, at = {}, [0] * shards
    for t in range(size):
        s = t % shards
        while wants[s][at[s]] in owner:
            at[s] += 1
        owner[wants[s][at[s]]] = s
    return owner


def test_table_is_filled_in_turns(spark):
    got = {r.slot: r.shard for r in sharding.lookup_table(spark.range(5).select(F.col("id").cast("int").alias("shard")), 101).collect()}
    assert got == plain_table(5, 101)
    assert max(Counter(got.values()).values()) - min(Counter(got.values()).values()) <= 1


def test_few_slots_move_when_a_shard_goes():
    before, after = plain_table(8, 499), plain_table(7, 499)
    kept = sum(before[s] == after[s] for s in before if before[s] < 7) / sum(before[s] < 7 for s in before)
    assert kept > 0.8


def test_placing_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (None, "b", 8), (2, None, None)], "doc_id long, text string, SHARD int")
    rows = sharding.place(df, shards=3, size=31).collect()
    table = plain_table(3, 31)
    assert len(rows) == 4 and rows[0].asDict().keys() == {"doc_id", "text", "slot", "shard"}
    for r in rows:
        assert r.slot == digest("" if r.doc_id is None else str(r.doc_id)) % 31 and r.shard == table[r.slot]
    assert sharding.place(df.limit(0), shards=3, size=31).count() == 0
    with pytest.raises(ValueError):
        sharding.place(df, shards=3, size=30)


def plain_schedule(tickets):
    period, names, k, out = sum(tickets.values()), sorted(tickets), Counter(), []
    for t in range(period):
        ready = [(-(-(k[s] + 1) * period // tickets[s]), i, s) for i, s in enumerate(names) if k[s] * period // tickets[s] <= t]
        out.append((min(ready)[2], k[min(ready)[2]], t))
        k[min(ready)[2]] += 1
    return out


def test_schedule_is_less_than_a_block_off(spark):
    tickets = {"a": 1, "b": 2, "c": 7, "d": 33, "e": 57}
    w = spark.createDataFrame(list(tickets.items()), "source string, tickets int")
    got = sorted((r.slot, r.source, r.k) for r in mixing.schedule(w, 100).collect())
    assert got == sorted((t, s, k) for s, k, t in plain_schedule(tickets))
    seen = Counter()
    for t, s, _ in got:
        seen[s] += 1
        assert all(abs(seen[x] - (t + 1) * n / 100) < 1 for x, n in tickets.items())


def test_mix_keeps_every_row_and_its_shares(spark):
    rows = [(i, "big" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 5}") for i in range(900)] + [(5, "s0"), (5, "s0"), (None, "big")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("Position", F.lit("x"))
    out = mixing.mix(df, block=4, period=100).collect()
    assert Counter((r.doc_id, r.source) for r in out if r.epoch == 0) == Counter(rows)
    assert len({r.position for r in out}) == len(out)
    n = Counter(r.source for r in out)
    period = sum(t for _, t in {(r.source, r.tickets) for r in out})
    for r in {r.source: r for r in out}.values():
        assert abs(n[r.source] / len(out) - r.tickets / period) < 0.02
    once = mixing.mix(df, block=4, period=100, repeat=False).collect()
    assert Counter((r.doc_id, r.source) for r in once) == Counter(rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_to_given_weights(spark):
    df = spark.range(120).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "a").otherwise("b").alias("source"))
    out = mixing.mix(df, weights=spark.createDataFrame([("a", 5), ("b", 5)], "source string, tickets int"), block=2, period=10).collect()
    n = Counter(r.source for r in out)
    assert n["a"] == 100 and n["b"] == 100
    ordered = [r.source for r in sorted(out, key=lambda r: r.position)]
    for t in range(0, 200, 2):
        assert abs(ordered[:t].count("a") - t / 2) < 2


def plain_tickets(sizes, period=1000, exponent=0.8):
    """sizes: [(source, n)] -> {source: (tickets, part of the periods in which its one ticket is used)}."""
    order = sorted(sizes, key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    total = sum(n**exponent for _, n in order)
    share = {s: n**exponent / total for s, n in order}
    period = max(period, 4 * len(order), min(math.ceil(mixing.ENOUGH / min(share.values())), mixing.LONGEST))
    above = {s: max(0.0, x * period - 1) for s, x in share.items()}
    exact = {s: 1 + x * (period - len(order)) / sum(above.values()) for s, x in above.items()}
    got = {s: math.floor(x + 1e-9) for s, x in exact.items()}
    place = {s: i for i, (s, _) in enumerate(order)}
    for s in sorted(got, key=lambda s: (round(got[s] - exact[s], 9), place[s]))[: period - sum(got.values())]:
        got[s] += 1
    return {s: (t, min(1.0, share[s] * period) if t == 1 else 1.0) for s, t in got.items()}


@pytest.mark.parametrize("small, size", [(18, 500), (19, 500), (20, 500), (300, 10), (1200, 10)])
def test_one_rule_for_any_number_of_sources(spark, small, size):
    sizes = [("big", 15000 if size == 500 else small * 5)] + [(f"s{i:04}", size) for i in range(small)]
    got = {r.source: (r.tickets, r.thin) for r in mixing.tickets(spark.createDataFrame(sizes, "source string, n long")).collect()}
    assert got == plain_tickets(sizes)
    total, period = sum(n**0.8 for _, n in sizes), sum(t for t, _ in got.values())
    assert all(abs(got[s][0] / period - n**0.8 / total) < 0.06 * n**0.8 / total for s, n in sizes)


def test_a_source_of_almost_no_weight(spark):
    sizes = [("big", 10**9), ("mid", 10**6), ("one", 1)]
    got = {r.source: r for r in mixing.tickets(spark.createDataFrame(sizes, "source string, n long")).collect()}
    period, total = sum(r.tickets for r in got.values()), sum(n**0.8 for _, n in sizes)
    for s, n in sizes:
        assert abs(got[s].tickets * got[s].thin / period - n**0.8 / total) < 0.01 * n**0.8 / total
    # Its one ticket is used in few periods, about evenly: never more than a block off.
    rows = [(i, "big") for i in range(4000)] + [(9000 + i, "rare") for i in range(3)]
    old = mixing.LONGEST
    mixing.LONGEST = 20
    try:
        out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=1, period=20).collect()
    finally:
        mixing.LONGEST = old
    share = 3**0.8 / (4000**0.8 + 3**0.8)
    at = sorted(r.position for r in out if r.source == "rare")
    assert Counter((r.doc_id, r.source) for r in out if r.epoch == 0) == Counter(rows) and len({r.position for r in out}) == len(out)
    assert all(abs(k - share * p) < 1 and abs(k + 1 - share * (p + 1)) < 1.05 for k, p in enumerate(at))


def test_mix_of_many_sources(spark):
    rows = [(i, "big" if i % 3 == 0 else f"s{i % 60}") for i in range(1800)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=1, period=30).collect()
    assert Counter((r.doc_id, r.source) for r in out if r.epoch == 0) == Counter(rows) and len({r.position for r in out}) == len(out)
    tickets = {r.source: r.tickets for r in out}
    want = [(t, s, k) for s, k, t in plain_schedule(tickets)]
    period = sum(tickets.values())
    assert sorted((r.position, r.source) for r in out if r.position < period) == [x[:2] for x in want if x[:2] in {(r.position, r.source) for r in out}]


def test_a_mix_finds_its_places_again(spark):
    rows = [(i, "big" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 5}") for i in range(900)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=4)
    want = sorted((r.doc_id, r.position) for r in mixed.select("doc_id", "position").collect())
    again = mixing.ordered(mixed.drop("position").repartition(5, F.rand(3)), block=4)
    assert sorted((r.doc_id, r.position) for r in again.collect()) == want
    assert again.columns == ["doc_id", "source", "position"] and mixing.ordered(mixed.limit(0)).count() == 0
