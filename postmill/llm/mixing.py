"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks of equal size. With weight w (the weights sum
to one), its k-th block, from 1, is released at floor((k - 1) / w) and due at
ceil(k / w). In every slot the released block with the earliest deadline goes
next. Each source is then less than one block away from its share at every
moment.

Weights are whole tickets out of a period, which is as long as the number of sources
and the smallest weight ask for; the schedule repeats after that many slots, in which a
source gets exactly its tickets. So one table with a row per slot holds the whole
schedule, and a block's slot is found by arithmetic and one look-up. A source too
light for one ticket in the longest period has one and uses it in as many periods
as its exact weight gives; in the others that slot stays empty. One rule holds for any
number of sources. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import key_hash, without

BLOCK = 32
PERIOD = 1000
EXPONENT = 0.8
SALTS = 1024
#: Tickets that the smallest source shall have.
ENOUGH = 20
#: Longest period, the rows of the schedule's table, unless there are so many sources (4 slots a source).
LONGEST = 1 << 18


def tickets(sizes: DataFrame, period: int = PERIOD, exponent: float = EXPONENT) -> DataFrame:
    """(source, n) -> (source, n, tickets, thin): target weights in proportion to n ** exponent.

    An exponent below one lifts small sources. The sum of tickets is `period`, or more
    where the smallest source would have fewer than ENOUGH. Every source has one
    ticket at least, the others share what is left; tickets that rounding leaves go to
    the largest fractional parts (ties: the first by size, then name, null before all).
    `thin` is 1, or the part of the periods in which a source uses its one ticket.
    """
    # An order, so that sums of doubles come out alike whenever they are computed.
    every = Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), F.col("source").asc_nulls_first())
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    power = F.pow(F.col("n").cast("double"), F.lit(exponent))
    low = sizes.withColumn("sources", F.count("*").over(whole)).withColumn("rank", F.row_number().over(every)).withColumn("share", power / F.sum(power).over(whole))
    long = F.greatest(F.lit(period), 4 * F.col("sources"), F.least(F.ceil(ENOUGH / F.min("share").over(whole)), F.lit(LONGEST)))
    low = low.withColumn("period", long.cast("long")).withColumn("wish", F.col("share") * F.col("period"))
    above = F.greatest(F.lit(0.0), F.col("wish") - 1)
    # One ticket each; what is above one shrinks by the part that lifts smaller sources to it.
    low = low.withColumn("exact", 1 + above * (F.col("period") - F.col("sources")) / F.sum(above).over(whole)).withColumn("down", F.floor(F.col("exact") + 1e-9))
    turn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy((F.col("exact") - F.col("down")).desc(), "rank"))
    low = low.withColumn("tickets", (F.col("down") + F.when(turn <= F.col("period") - F.sum("down").over(whole), 1).otherwise(0)).cast("int"))
    return low.select("source", "n", "tickets", F.when(F.col("tickets") == 1, F.least(F.lit(1.0), F.col("wish"))).otherwise(F.lit(1.0)).alias("thin"))


def schedule(weights: DataFrame, period: int | None = None) -> DataFrame:
    """(source, tickets) -> (source, tickets, k, slot) for one period: block k of the source, from 0, takes `slot`.

    The fold runs over the period's slots (by default as many as there are tickets). An
    entry's deadline is ceil((k + 1) * period / tickets); ties go to the first source by
    name. Sources with equal tickets take their blocks in turns, so the state is one
    entry for each number of tickets (at most the root of twice the period). Slots are
    gathered in runs, which keeps the copying of what is done small.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct("source", "tickets"))).alias("s"))
    one = one.withColumn("period", F.lit(period).cast("long") if period else F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["tickets"]))
    numbers = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.struct(F.col("s")[i]["tickets"].cast("long").alias("w"), i.alias("i")))
    one = one.filter(F.size("s") > 0).withColumn("numbers", numbers)
    alike = F.transform(F.array_distinct(F.transform("numbers", lambda x: x["w"])), lambda w: F.struct(w.alias("w"), F.transform(F.filter("numbers", lambda x: x["w"] == w), lambda x: x["i"]).alias("of")))
    one = one.withColumn("groups", alike).withColumn("run", F.ceil(F.sqrt("period")).cast("long")).select("s", "period", "groups", "run")
    p = F.col("period")

    def entry(g: Column, k: Column, j: Column) -> Column:
        """Block k of the group's j-th source is its next."""
        w = F.col("groups")[g]["w"]
        return F.struct(F.floor(k * p / w).alias("release"), F.ceil((k + 1) * p / w).alias("due"), F.col("groups")[g]["of"][j].alias("i"), k.alias("k"), g.alias("g"), j.alias("j"))

    zero = F.lit(0).cast("long")
    first = F.transform(F.sequence(F.lit(0), F.size("groups") - 1), lambda g: entry(g, zero, F.lit(0)))
    none = F.array().cast("array<struct<i:int,k:bigint>>")

    def step(state, t):
        pick = F.array_min(F.transform(F.filter(state["next"], lambda b: b["release"] <= t), lambda b: F.struct(b["due"], b["i"], b["k"], b["g"], b["j"])))
        last = pick["j"] + 1 >= F.size(F.col("groups")[pick["g"]]["of"])
        then = entry(pick["g"], F.when(last, pick["k"] + 1).otherwise(pick["k"]), F.when(last, F.lit(0)).otherwise(pick["j"] + 1))
        after = F.transform(state["next"], lambda b: F.when(b["g"] == pick["g"], then).otherwise(b))
        return F.struct(after.alias("next"), F.concat(state["order"], F.array(F.struct(pick["i"].alias("i"), pick["k"].alias("k")))).alias("order"))

    def run(state, r):
        slots = F.sequence(r * F.col("run"), F.least(p, (r + 1) * F.col("run")) - 1)
        done = F.aggregate(slots, F.struct(state["next"].alias("next"), none.alias("order")), step)
        return F.transform(F.array(done), lambda d: F.struct(d["next"].alias("next"), F.concat(state["runs"], F.array(d["order"])).alias("runs")))[0]

    runs = F.aggregate(F.sequence(zero, F.ceil(p / F.col("run")) - 1), F.struct(first.alias("next"), F.array().cast("array<array<struct<i:int,k:bigint>>>").alias("runs")), run)["runs"]
    taken = one.select("s", F.posexplode(F.flatten(runs)).alias("slot", "b"))
    return taken.select(F.col("s")[F.col("b.i")]["source"].alias("source"), F.col("s")[F.col("b.i")]["tickets"].alias("tickets"), F.col("b.k").alias("k"), "slot")


def numbered(df: DataFrame, key: str, source: str) -> DataFrame:
    """The rows with `source_row`: 0, 1, .. within each source, in an order fixed by the keys.

    A source may hold a third of all rows, so it is numbered in SALTS streams by
    hash of the key; the streams' sizes, one row each, give every stream its offset.
    """
    salted = df.withColumn("salt", (key_hash(F.col(f"`{key}`")) % SALTS).cast("int"))
    sizes = salted.groupBy(F.col(f"`{source}`").alias("_source"), F.col("salt").alias("_salt")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_source", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(f"`{source}`", "salt").orderBy(key_hash(F.col(f"`{key}`")), f"`{key}`"))
    rows = salted.withColumn("source_row", inner - 1)
    met = rows.join(offsets, F.col(f"`{source}`").eqNullSafe(F.col("_source")) & (F.col("salt") == F.col("_salt")))
    return met.select(*[f"`{c}`" for c in df.columns], (F.col("source_row") + F.col("_before")).alias("source_row"))


OWN = ("source_row", "tickets", "_thin", "epoch", "block", "position", "salt", "_source", "_salt", "_before", "_n", "_period")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", weights: DataFrame | None = None, block: int = BLOCK,
        period: int = PERIOD, exponent: float = EXPONENT, repeat: bool = True) -> DataFrame:
    """The rows with their place in the mix: `epoch`, `block` (slot in the schedule) and `position` (order of rows).

    weights: (source, tickets) summing to `period`; without it, targets come from
    the sources' row counts (see `tickets`). With `repeat`, the mix is as long as it
    takes to use every row: sources that would run dry start again (`epoch` 1, 2, ..),
    so shares hold to the end and no row is left out; the longest-lasting source is
    used once. Without it every row comes once and a dry source's slots stay empty.

    Null sources are one source of their own. A null key is a row like any other;
    rows with equal keys are all kept. An empty table stays empty. A source missing
    from `weights` raises no error: its rows have no place and are an error of the
    caller, shown as null `block`. There may be any number of sources. Input
    columns named like the result's own are replaced. Texts are not read.
    """
    rows = numbered(without(df, *OWN), key, source)
    sizes = df.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("n"))
    plan = _plan(sizes, weights, period, exponent)
    met = rows.join(F.broadcast(_of_plan(plan)), F.col(f"`{source}`").eqNullSafe(F.col("_source")), "left")
    if repeat:
        wanted = F.greatest(F.floor(F.col("length") * F.col("tickets") * F.col("_thin") / F.col("_period")), F.col("_n"))
        times = F.ceil((wanted - F.col("source_row")) / F.col("_n"))
        met = met.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), times).cast("int") - 1)))
    else:
        met = met.withColumn("epoch", F.lit(0))
    out = _placed(met, plan, source, block, None if weights is None else period)
    return out.select(*[f"`{c}`" for c in rows.columns], "tickets", "epoch", "block", "position")


def _plan(sizes: DataFrame, weights: DataFrame | None, period: int, exponent: float) -> DataFrame:
    """(source, n) -> (source, n, tickets, thin, period, length): a row for each source."""
    given = None if weights is None else weights.select(F.col("source").alias("_w"), "tickets", F.lit(1.0).alias("thin"))
    plan = tickets(sizes, period, exponent) if weights is None else sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("_w")), "left").drop("_w")
    every = Window.partitionBy(F.lit(1))
    plan = plan.withColumn("period", F.sum("tickets").over(every) if weights is None else F.lit(period).cast("long"))
    # Rows of a mix in which the source that lasts longest comes once.
    return plan.withColumn("length", F.max(F.ceil(F.col("n") * F.col("period") / (F.col("tickets") * F.col("thin")))).over(every))


def _of_plan(plan: DataFrame) -> DataFrame:
    return plan.select(F.col("source").alias("_source"), F.col("n").alias("_n"), F.col("tickets"), F.col("thin").alias("_thin"), F.col("period").alias("_period"), "length")


def _placed(met: DataFrame, plan: DataFrame, source: str, block: int, period: int | None) -> DataFrame:
    """Rows with source_row, epoch and their source's plan -> with block and position."""
    place = F.col("source_row") + F.col("epoch") * F.col("_n")
    met = met.withColumn("_k", F.floor(place / block)).withColumn("_in", place % block)
    table = schedule(plan.select("source", "tickets"), period).select(F.col("source").alias("t_source"), F.col("k").alias("t_k"), "slot")
    slot = met.join(F.broadcast(table), F.col(f"`{source}`").eqNullSafe(F.col("t_source")) & (F.col("_k") % F.col("tickets") == F.col("t_k")), "left")
    # A thin source's k-th block comes when half a block more than k is due.
    turn = F.when(F.col("_thin") < 1, F.ceil((F.col("_k") + 0.5) / F.col("_thin")) - 1).otherwise(F.floor(F.col("_k") / F.col("tickets")))
    at = turn * F.col("_period") + F.col("slot")
    return slot.withColumn("block", at).withColumn("position", at * block + F.col("_in"))


def ordered(mixed: DataFrame, key: str = "doc_id", source: str = "source", block: int = BLOCK, period: int = PERIOD, exponent: float = EXPONENT) -> DataFrame:
    """The rows of a mix that lost their place, with `position` again.

    A row's copies stand for its epochs, and the distinct keys of a source for its rows, so
    the arithmetic of `mix` gives the places once more. Keys must be distinct before
    mixing; where rows share one (or have none), their copies count on, and positions
    may be shared or left open. Input columns named like the result's are replaced.
    """
    rows = without(mixed, *OWN)
    keyed = rows.withColumn("_hash", key_hash(F.col(f"`{key}`"))).withColumn("salt", (F.col("_hash") % SALTS).cast("int"))
    stream = Window.partitionBy(f"`{source}`", "salt").orderBy("_hash", f"`{key}`")
    copy = Window.partitionBy(f"`{source}`", "salt", "_hash", f"`{key}`").orderBy(F.lit(1))
    told = keyed.withColumn("source_row", F.dense_rank().over(stream) - 1).withColumn("epoch", F.row_number().over(copy) - 1)
    # Distinct keys of each stream, from ids alone.
    sizes = keyed.select(F.col(f"`{source}`").alias("_source"), F.col("salt").alias("_salt"), F.col(f"`{key}`").alias("_key")).distinct().groupBy("_source", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_source").alias("_of"), F.col("_salt"), F.coalesce(before, F.lit(0)).alias("_before"))
    met = told.join(offsets, F.col(f"`{source}`").eqNullSafe(F.col("_of")) & (F.col("salt") == F.col("_salt")))
    met = met.withColumn("source_row", F.col("source_row") + F.col("_before")).drop("_of", "_salt", "_before")
    plan = _plan(sizes.groupBy(F.col("_source").alias("source")).agg(F.sum("_n").alias("n")), None, period, exponent)
    met = met.join(F.broadcast(_of_plan(plan)), F.col(f"`{source}`").eqNullSafe(F.col("_source")), "left")
    return _placed(met, plan, source, block, None).select(*[f"`{c}`" for c in rows.columns], "position")


SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shares AS (
  SELECT source, n, pow(n, {EXPONENT}) / sum(pow(n, {EXPONENT})) OVER () AS share, count(*) OVER () AS sources,
         row_number() OVER (ORDER BY n DESC, source NULLS FIRST) AS rank, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM sizes),
long AS (SELECT *, CAST(greatest({PERIOD}, 4 * sources, least(ceil({ENOUGH} / min(share) OVER ()), {LONGEST})) AS BIGINT) AS period FROM shares),
above AS (SELECT *, share * period AS wish, greatest(0.0, share * period - 1) AS above FROM long),
exact AS (SELECT *, 1 + above * (period - sources) / sum(above) OVER () AS exact FROM above),
down AS (SELECT *, CAST(floor(exact + 1e-9) AS BIGINT) AS down FROM exact),
w AS (
  SELECT source, n, i, period, wish, down + CASE WHEN row_number() OVER (ORDER BY exact - down DESC, rank) <= period - sum(down) OVER () THEN 1 ELSE 0 END AS w FROM down),
weights AS (SELECT list(w ORDER BY i) AS ws, list(i ORDER BY i) AS ids, any_value(period) AS period FROM w),
run(t, ks, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ids, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS STRUCT(d BIGINT, i BIGINT, k BIGINT)) FROM weights
  UNION ALL
  SELECT t + 1, list_transform(ids, lambda x: CASE WHEN x = best.i THEN ks[x + 1] + 1 ELSE ks[x + 1] END), best
  FROM (SELECT t, ks, ids, period, list_sort(list_transform(list_filter(ids, lambda x: (ks[x + 1] * period) // ws[x + 1] <= t + 1),
               lambda x: struct_pack(d := CAST(((ks[x + 1] + 1) * period + ws[x + 1] - 1) // ws[x + 1] AS BIGINT), i := CAST(x AS BIGINT), k := CAST(ks[x + 1] AS BIGINT))))[1] AS best
        FROM run, weights WHERE t < period - 1)),
thinned AS (SELECT source, n, i, period, w, CASE WHEN w = 1 THEN least(1.0, wish) ELSE 1.0 END AS thin FROM w),
plan AS (SELECT *, max(CAST(ceil(n * period / (w * thin)) AS BIGINT)) OVER () AS length FROM thinned),
longest AS (SELECT *, greatest(CAST(floor(length * w * thin / period) AS BIGINT), n) AS wanted FROM plan),
docs AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h % {SALTS}, h, doc_id) - 1 AS r
  FROM (SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents)),
places AS (
  SELECT doc_id, d.source, w, thin, period, i, n, r, unnest(range(greatest(1, CAST(ceil((wanted - r) / n) AS BIGINT)))) AS epoch
  FROM docs d JOIN longest l ON d.source IS NOT DISTINCT FROM l.source),
slots AS (SELECT *, (r + epoch * n) // {BLOCK} AS k, (r + epoch * n) % {BLOCK} AS inside FROM places),
turns AS (SELECT *, CASE WHEN thin < 1 THEN CAST(ceil((k + 0.5) / thin) AS BIGINT) - 1 ELSE k // w END AS turn FROM slots)
SELECT doc_id, source, CAST(r AS BIGINT) AS source_row, CAST(w AS INTEGER) AS tickets, CAST(epoch AS INTEGER) AS epoch,
       CAST(turn * period + t AS BIGINT) AS block, CAST((turn * period + t) * {BLOCK} + inside AS BIGINT) AS position
FROM turns s JOIN run ON run.pick.i = s.i AND run.pick.k = s.k % s.w
"""
