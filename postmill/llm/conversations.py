"""Repair of conversations whose turns are out of order, missing, blank or repeated.

A repaired conversation's role initials are `(s?(ua)+)?`. Rows may be kept (K, free),
given another role (R, 3), deleted (D, 4), and empty turns inserted before any of
them or at the end (I, 3); keeping a cut-off text costs 3 more. The letters of all
edits, in order, are the audit. Of the cheapest audits the least one is taken.

Between two rows only one of four states matters: nothing yet, after the system
turn, after a user's, after an assistant's. So a run of rows is a 4 x 4 matrix of
least costs, and runs are multiplied by adding costs and taking minima. That lets
one conversation lie in many tasks:

1. Rows are sorted by range and cut into pieces of at most PIECE rows; a piece may
   hold many conversations, and a conversation may cross many pieces.
2. Each piece gives a cost matrix for each of its conversations. The cost of what
   follows a piece is found by doubling: in round k a piece's matrix is multiplied
   by the one 2 ** k pieces further on.
3. With the cost that follows, a piece knows which arcs lie on cheapest paths.
   Its nodes (row and state) are ranked by the least audits that start there, of 1,
   2, 4, .. letters: a node's rank for twice the length comes from its own rank and
   that of the node its pointer reaches, and pointers double along. Ranks choose
   each node's arc, and the doubled pointers list the nodes of the least path.
4. A piece that does not begin its conversation does this for all four states; the
   maps from first to last state are composed by doubling, too, and each piece's
   one true path is kept.

No step gathers a conversation. Only the SHA-256 of a repaired conversation is a fold
over its text by nature: rows stream through one task, which keeps none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from postmill.session import cut_lineage, scratch

from .columns import released, written

#: Rows of a piece, as a power of two.
PIECE_BITS = 13
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
#: Cost of no path; sums of two stay far from overflow.
NEVER = 1 << 56
#: Where an inserted turn or a turn of another role leads.
_THEN = np.array([USER, USER, ASSISTANT, USER])
#: Costs of inserting turns between two rows, from state to state.
_INSERTS = np.array([[0, NEVER, 3, 6], [NEVER, 0, 3, 6], [NEVER, NEVER, 0, 3], [NEVER, NEVER, 3, 0]])
#: Costs of what follows the last row: a conversation ends empty or after an assistant's turn.
_END = [0, 6, 3, 0]

#: By state of a kept row's initial: the states it may follow.
_KEEPS = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
#: Pairs of initials (4 * first + second) that may stand next to each other.
_LEGAL = [4 * SYSTEM + USER, 4 * USER + ASSISTANT, 4 * ASSISTANT + USER]
#: Letters of edits, least first.
LETTERS = b"DIKR"

_SPACE = " \t\n\v\f\r"


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with damage by crc32 of `conv_id:turn`; nulls count as one space there, and are one as role and text."""
    own = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(own.cast("binary")) % 20).alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with `at`, which grows in the order of (conv_id, turn), nulls first, and with what their role and text say.

    Rows of one turn go by role, the first 128 characters and the SHA-256 of their
    text; the last range key only deals out equal rows.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 128), digest]
    dealt = rows.withColumn("_deal", F.monotonically_increasing_id() % 4096)
    dealt = dealt.repartitionByRange(*keys, "_deal").sortWithinPartitions(*keys).drop("_deal")
    solid = F.rtrim("text", F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0).cast("int")
    return dealt.select(F.monotonically_increasing_id().alias("at"), "*", digest.alias("digest"), code.alias("code"),
                        (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("open"))


def _faults(rows: DataFrame) -> DataFrame:
    """(at, conv_id, turn, code, blank, duplicate, truncated): each row's first fault."""
    # The first of equal rows is known by its place, so equal rows never meet.
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    met = rows.select("at", "conv_id", "turn", "code", "blank", "open").join(firsts, "at", "left")
    duplicate = ~F.col("blank") & F.col("is_first").isNull()
    return met.select("at", "conv_id", "turn", "code", "blank", duplicate.alias("duplicate"), (~F.col("blank") & ~duplicate & F.col("open")).alias("truncated"))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of n x 4 x 4 cost matrices: sums along a path, the least of them."""
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), NEVER)


def _row_matrices(code: np.ndarray, gone: np.ndarray, late: np.ndarray) -> np.ndarray:
    """n x 4 x 4 costs from state to state over one row and what is inserted before it. `late`: what keeping the text costs."""
    n, stay = len(code), ~gone
    over = np.full((n, 4, 4), NEVER)
    over[:, range(4), range(4)] = DELETE
    for q in range(4):
        over[stay, q, _THEN[q]] = REROLE + late[stay]
    for c, states in _KEEPS.items():
        for q in states:
            may = stay & (code == c)
            over[may, q, c] = KEEP + late[may]
    return _times(np.broadcast_to(_INSERTS, (n, 4, 4)), over)


def _suffix_products(m: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each row the product of its own and all later matrices up to row `last`, by doubling."""
    until = np.arange(len(m)) + 1  # the first row that is not yet in the product
    while len(grow := np.flatnonzero(until <= last)):
        longer, further = m.copy(), until.copy()
        longer[grow], further[grow] = _times(m[grow], m[until[grow]]), until[until[grow]]
        m, until = longer, further
    return m


class _Piece:
    """A piece's rows by `at`, as numpy columns; a run is what the piece has of one conversation."""

    def __init__(self, t: pa.Table):
        self.table = t = t.sort_by("at")
        self.at, self.code, self.piece = (t.column(c).to_numpy() for c in ("at", "code", "piece"))
        flag = {c: t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("blank", "duplicate", "truncated")}
        self.gone, self.late = flag["blank"] | flag["duplicate"], np.where(flag["truncated"], CUT_OFF, 0)
        ids = t.column("conv_id").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        conv = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        self.first = np.flatnonzero(np.diff(conv, prepend=-1))
        self.size = np.diff(np.append(self.first, len(conv)))
        self.last = self.first + self.size - 1
        self.of = np.repeat(np.arange(len(self.first)), self.size)
        self.matrix = _row_matrices(self.code, self.gone, self.late)


def _costs(t: pa.Table) -> pa.Table:
    """A run a row: the cost matrix of all its rows, its illegal pairs, the codes at its ends, and where it lies."""
    p = _Piece(t)
    whole = _suffix_products(p.matrix, p.last[p.of])[p.first]
    bad = np.zeros(len(p.code), np.int64)
    bad[1:] = (np.diff(p.of) == 0) & ~np.isin(p.code[:-1] * 4 + p.code[1:], _LEGAL)
    return pa.table({
        "piece": p.piece[p.first], "run": np.arange(len(p.first)), "conv_id": p.table.column("conv_id").take(pa.array(p.first)),
        "matrix": pa.array(list(whole.reshape(-1, 16)), pa.list_(pa.int64())), "illegal": np.add.reduceat(bad, p.first),
        "code_first": p.code[p.first], "code_last": p.code[p.last],
    })


def _least_paths(p: _Piece, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node the letter and the target of its arc on the least audit among the cheapest.

    Node 4 * (row + run) + state stands before a row; the four nodes behind a run's
    last row are its end, have no letter (0) and lead to themselves. `follows`: the
    cost of what comes after each run, by state.
    """
    rows, runs = len(p.code), len(p.first)
    layer = np.arange(rows) + p.of
    cost = np.empty((rows + runs, 4), np.int64)
    cost[layer] = (_suffix_products(p.matrix, p.last[p.of]) + follows[p.of][:, None, :]).min(axis=2)
    cost[p.last + np.arange(runs) + 1] = follows
    cost, nodes = cost.ravel(), 4 * (rows + runs)

    state, row = np.tile(np.arange(4), rows), np.repeat(np.arange(rows), 4)
    here = 4 * layer[row] + state
    below, code, stay, late = here - state + 4, p.code[row], ~p.gone[row], p.late[row]
    may_keep = stay & np.isin(state * 4 + code, [q * 4 + c for c, states in _KEEPS.items() for q in states]) & (code > 0)
    every = np.ones(len(here), bool)
    moves = [  # by letter: where it may be, its cost, the node it leads to
        (every, DELETE, below + state),
        (every, INSERT, here - state + _THEN[state]),
        (may_keep, KEEP + late, below + code),
        (stay, REROLE + late, below + _THEN[state]),
    ]
    arcs = []
    for letter, (may, price, to) in enumerate(moves, 1):
        on = np.flatnonzero(may & (price + cost[to] == cost[here]))
        arcs.append((here[on], np.full(len(on), letter), to[on]))
    source, letter, to = (np.concatenate(x) for x in zip(*arcs))

    def chosen(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort((rank[to], letter, source))
        one = by[np.flatnonzero(np.diff(source[by], prepend=-1))]
        out, target = np.zeros(nodes, np.int64), np.arange(nodes)
        out[source[one]], target[source[one]] = letter[one], to[one]
        return out, target

    # Audits of length 1: the least letter (one letter leads from a node to one node only).
    rank, pointer = chosen(np.zeros(nodes, np.int64))
    while True:
        # Twice the length: own rank, then that of the node the pointer reaches.
        rank = np.unique(rank * (nodes + 5) + rank[pointer], return_inverse=True)[1]
        ahead = pointer[pointer]
        if np.array_equal(ahead, pointer):
            return chosen(rank)
        pointer = ahead


def _walk(target: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, node) of all nodes that have a letter, path by path in order, and each path's end; pointers double."""
    path, node, order = np.arange(len(begin)), begin, np.zeros(len(begin), np.int64)
    hop, step, end = target, 1, begin
    going = target[node] != node
    path, node, order = path[going], node[going], order[going]
    while True:
        # After a round, all nodes less than 2 * step letters from the beginning are there.
        ahead = hop[node]
        going = target[ahead] != ahead
        path, order, node = np.concatenate([path, path[going]]), np.concatenate([order, order[going] + step]), np.concatenate([node, ahead[going]])
        longer = hop[hop]
        if np.array_equal(longer, hop):
            break
        hop, step = longer, 2 * step
    by = np.lexsort((order, path))
    return path[by], node[by], hop[end]


def _edits(t: pa.Table, of_runs: pa.Table) -> pa.Table:
    """A piece's rows and its runs -> (piece, run, state, leaves, audit, turns), a row for each run and state it may begin in."""
    p, r = _Piece(t), of_runs.sort_by("run")
    follows = r.column("follows").combine_chunks().flatten().to_numpy().reshape(-1, 4)
    letter, target = _least_paths(p, follows)
    opens, closes = (r.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("opens", "closes"))
    run = np.repeat(np.arange(len(opens)), np.where(opens, 1, 4))
    state = np.arange(len(run)) - np.searchsorted(run, run)  # 0 where the run opens its conversation
    path, node, end = _walk(target, 4 * (p.first[run] + run) + state)
    leaves = end % 4
    kind = letter[node]
    layer_run = np.repeat(np.arange(len(opens)), p.size + 1)
    at = p.at[node // 4 - layer_run[node // 4]]
    to = target[node] % 4

    # What is inserted behind a conversation's last row.
    missing = np.where(closes[run], np.array([0, 2, 1, 0])[leaves], 0)
    more = np.repeat(np.arange(len(run)), missing)
    role = np.where(missing[more] - (np.arange(len(more)) - np.searchsorted(more, more)) == 2, USER, ASSISTANT)
    order = np.argsort(np.concatenate([path, more]), kind="stable")
    path = np.concatenate([path, more])[order]
    kind, to, at = (np.concatenate([x, y])[order] for x, y in ((kind, np.full(len(more), 2)), (to, role), (at, p.at[p.last[run[more]]] + 1)))

    cuts = np.searchsorted(path, np.arange(len(run) + 1))
    text = np.frombuffer(b"." + LETTERS, np.uint8)[kind].tobytes().decode()
    stays = kind > 1
    offsets = pa.array(np.searchsorted(path[stays], np.arange(len(run) + 1)), pa.int32())
    turn = pa.StructArray.from_arrays([pa.array(at[stays]), pa.array(kind[stays], pa.int32()), pa.array(to[stays], pa.int32())], names=["at", "edit", "to"])
    return pa.table({
        "piece": np.full(len(run), p.piece[0]), "run": run, "state": state, "leaves": leaves,
        "audit": pa.array([text[a:b] for a, b in zip(cuts, cuts[1:])], pa.string()), "turns": pa.ListArray.from_arrays(offsets, turn),
    })


def _product(a: str, b: str) -> Column:
    """The product of two 4 x 4 cost matrices, as arrays of 16."""
    def least(x):
        q = F.floor(x / 4).cast("int") * 4
        return F.array_min(F.array(*[F.col(a)[q + r] + F.col(b)[(x % 4 + 4 * r).cast("int")] for r in range(4)]))

    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.least(least(x), F.lit(NEVER)))


def _applied(matrix: str, costs: Column) -> Column:
    """Costs by state before a run, from its matrix and the costs by state after it."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.array_min(F.array(*[F.col(matrix)[q * 4 + r] + costs[r] for r in range(4)])))


_CHAIN = ["first_piece", "first_run"]


def _doubled(runs: DataFrame, value: str, step_to: int, longest: int, join: Column, keep) -> DataFrame:
    """`value` of each of a conversation's runs combined with all later (1) or earlier (-1) ones: log2(longest) rounds."""
    step = 1
    while step < longest:
        other = runs.select(*_CHAIN, (F.col("nth") - step_to * step).alias("nth"), F.col(value).alias("_other"))
        runs = written(runs.join(other, [*_CHAIN, "nth"], "left").withColumn(value, F.when(F.col("_other").isNull(), F.col(value)).otherwise(join)).drop("_other"), keep)
        step *= 2
    return runs


def _chained(runs: DataFrame, keep) -> tuple[DataFrame, int]:
    """Runs with their place in the conversation and `follows`, the cost by state of all that comes after; and the most runs of one."""
    own = Window.partitionBy("conv_id").orderBy("piece")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row a piece, so a conversation's window is 2 ** -PIECE_BITS of its rows.
    placed = written(runs.select("*", F.row_number().over(own).alias("nth"), F.count("*").over(whole).alias("of"), F.first("piece").over(whole).alias("first_piece"),
                                 F.first("run").over(whole).alias("first_run"), F.lead("code_first").over(own).alias("code_next")), keep)
    pair = F.col("code_last") * 4 + F.col("code_next")
    placed = placed.withColumn("illegal", F.col("illegal") + F.when(F.col("code_next").isNotNull() & ~pair.isin(*_LEGAL), 1).otherwise(0))
    longest = placed.agg(F.coalesce(F.max("of"), F.lit(0))).first()[0]
    end = F.array(*[F.lit(c).cast("bigint") for c in _END])
    crossing = _doubled(placed.filter("of > 1").select(*_CHAIN, "nth", "matrix"), "matrix", 1, longest, _product("matrix", "_other"), keep)
    later = crossing.select(*_CHAIN, (F.col("nth") - 1).alias("nth"), _applied("matrix", end).alias("_later"))
    found = placed.join(later, [*_CHAIN, "nth"], "left").withColumn("follows", F.coalesce("_later", end)).drop("_later")
    return written(found.withColumn("cost", _applied("matrix", F.col("follows"))[0]).withColumn("opens", F.col("nth") == 1).withColumn("closes", F.col("nth") == F.col("of")), keep), longest


def _true_paths(runs: DataFrame, paths: DataFrame, longest: int, keep) -> DataFrame:
    """Of each run's paths the one from the state in which the run before it ends."""
    place = ["piece", "run"]
    known = runs.select(*place, *_CHAIN, "nth", "of", "conv_id")
    if longest < 2:
        return known.join(paths, place)
    crossing = paths.join(known.filter("of > 1").drop("conv_id"), place)
    # A run that opens its conversation has one path; its map leads there from every state.
    maps = crossing.groupBy(*_CHAIN, "nth").agg(F.sort_array(F.collect_list(F.struct("state", "leaves"))).alias("m"))
    maps = maps.select(*_CHAIN, "nth", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.col("m")[F.least(q, F.size("m") - 1)]["leaves"]).alias("map"))
    through = _doubled(maps, "map", -1, longest, F.transform("_other", lambda q: F.col("map")[q]), keep)
    begins = through.select(*_CHAIN, (F.col("nth") + 1).alias("nth"), F.col("map")[0].alias("begins"))
    begun = known.join(begins, [*_CHAIN, "nth"], "left")
    return begun.join(paths, place).filter(F.col("state") == F.coalesce("begins", F.lit(START)))


class Repair:
    """The repair of a table of conversations, in tables of the shared folder that `keep` writes."""

    def __init__(self, damaged_rows: DataFrame, keep, piece_bits: int = PIECE_BITS):
        self.rows = rows = written(in_order(damaged_rows), keep)
        self.faults = faults = written(_faults(rows).withColumn("piece", F.shiftright("at", piece_bits)), keep)
        conv = rows.schema["conv_id"].dataType.simpleString()
        runs = faults.groupBy("piece").applyInArrow(_costs, f"piece bigint, run bigint, conv_id {conv}, matrix array<bigint>, illegal bigint, code_first int, code_last int")
        self.runs, longest = _chained(written(runs, keep), keep)
        paths = faults.groupBy("piece").cogroup(self.runs.select("piece", "run", "follows", "opens", "closes").groupBy("piece")).applyInArrow(
            _edits, "piece bigint, run bigint, state bigint, leaves bigint, audit string, turns array<struct<at:bigint,edit:int,to:int>>")
        self.paths = written(_true_paths(self.runs, written(paths, keep), longest, keep), keep)

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation that has rows."""
        turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        counts = self.faults.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        costs = self.runs.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.max(F.when(F.col("opens"), F.col("cost"))).alias("cost"))
        letters = F.transform(F.sort_array(F.collect_list(F.struct("nth", "audit"))), lambda x: x["audit"])
        audits = self.paths.groupBy("conv_id").agg(F.array_join(letters, "").alias("audit"))
        for part in (costs, audits):
            part = part.withColumnRenamed("conv_id", "_conv")
            counts = counts.join(part, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
        return counts

    def turns(self) -> DataFrame:
        """(conv_id, nth, place, role, text): the repaired turns, in order of (nth, place) within a conversation."""
        each = self.paths.select("conv_id", "nth", F.posexplode("turns").alias("place", "t")).select("conv_id", "nth", "place", "t.*")
        inserted, kept = F.col("edit") == 2, F.col("edit") == 3
        given = F.when(F.col("to") == USER, "user").otherwise("assistant")
        old = self.rows.select(F.col("at").alias("_at"), F.col("role").alias("_role"), F.col("text").alias("_text"))
        met = each.withColumn("_own", F.when(~inserted, F.col("at"))).join(old, F.col("_own") == F.col("_at"), "left")
        return met.select("conv_id", "nth", "place", F.when(kept, F.col("_role")).otherwise(given).alias("role"), F.when(inserted, "").otherwise(F.col("_text")).alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `role:text`, newline-joined. Rows of a conversation stream by, none are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if fold is None or conv != now:
                    done += [(now, fold.hexdigest())] if fold else []
                    now, fold = conv, hashlib.sha256(line.encode())
                else:
                    fold.update(b"\n" + line.encode())
            yield rows(done)
        yield rows([(now, fold.hexdigest())] if fold else [])

    kind = turns.schema["conv_id"].dataType
    lines = turns.repartition("conv_id").sortWithinPartitions("conv_id", "nth", "place").select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    arrow = to_arrow_type(kind)

    def rows(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], arrow), pa.array([d for _, d in found], pa.string())], names=["conv_id", "repaired_sha256"])

    return lines.mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(df: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """A row for each conv_id of `df`: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    `df` has conv_id, turn, role and text; other columns are not read. It is damaged
    first (see `damaged`), where null role and text become one space. A null conv_id
    is a conversation of its own. Null turns come first. Rows of one turn go by role,
    the first 128 characters and the SHA-256 of their text, so the result does not
    depend on the order of rows; repeated rows are duplicates. An empty role has no
    initial, so it cannot be kept as it is. A conversation of which all rows are
    dropped has zeros, an empty audit and the digest of nothing. An empty table gives
    no rows.
    """
    with scratch(df.sparkSession) as keep:
        done = Repair(damaged(df), keep, piece_bits)
        digest = written(digests(done.turns()), keep).withColumnRenamed("conv_id", "_conv")
        summary = done.summary().withColumnRenamed("conv_id", "_id")
        every = df.select("conv_id").distinct()
        met = every.join(summary, F.col("conv_id").eqNullSafe(F.col("_id")), "left").join(digest, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS]
        out = met.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
        return cut_lineage(released(out))


def _bytewise_crc32(text: str) -> str:
    """CRC-32 of an ASCII text in SQL, bit by bit."""
    fed = f"list_transform(range(8 * length({text})), lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii({text}[i // 8 + 1]) AS BIGINT) ELSE 0 END)"
    step = "CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, 3988292384) ELSE xor(c, b) // 2 END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {fed}), lambda c, b: CAST({step} AS BIGINT)), 4294967295)"


def _cheapest(*paths: str) -> str:
    return f"list_sort([{', '.join(paths)}])[1]"


def _longer(letter: str, price: str, rest: str) -> str:
    return f"struct_pack(c := CAST({price} + {rest}.c AS BIGINT), a := '{letter}' || {rest}.a)"


_NONE = "struct_pack(c := CAST(99999999 AS BIGINT), a := '~')"


def _over_row(state: int) -> str:
    """The cheapest, then least audit from a state over one row, without inserts before it."""
    then = int(_THEN[state])
    keep = " ".join(f"WHEN code = {c} THEN {_longer('K', 'late', f'v[{c + 1}]')}" for c, states in _KEEPS.items() if state in states)
    return _cheapest(_longer("D", "4", f"v[{state + 1}]"), f"CASE WHEN gone THEN {_NONE} {keep} ELSE {_NONE} END",
                     f"CASE WHEN gone THEN {_NONE} ELSE {_longer('R', '3 + late', f'v[{then + 1}]')} END")


#: A plain dynamic program that carries cost and audit of each state from the last row to the first.
SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS own
  FROM conversations),
kinds AS (SELECT *, {_bytewise_crc32("own")} % 20 AS kind FROM given),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[1:128], sha256(text), copy) AS r,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
         CASE role[1] WHEN 's' THEN {SYSTEM} WHEN 'u' THEN {USER} WHEN 'a' THEN {ASSISTANT} ELSE 0 END AS code FROM hurt),
told AS (SELECT *, solid = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again FROM placed),
rows AS (
  SELECT conv_id, turn, role, text, r, code, blank, again AND NOT blank AS duplicate,
         NOT blank AND NOT again AND solid[-1] NOT IN ('.', '!', '?') AS truncated, blank OR again AS gone,
         CASE WHEN solid[-1] IN ('.', '!', '?') THEN 0 ELSE {CUT_OFF} END AS late,
         lag(code) OVER (PARTITION BY conv_id ORDER BY r) * 4 + code AS pair, lag(r) OVER (PARTITION BY conv_id ORDER BY r) IS NOT NULL AS second
  FROM told),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (second AND pair NOT IN ({', '.join(map(str, _LEGAL))})) AS illegal, max(r) AS n
  FROM rows GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS i, [{', '.join(f"struct_pack(c := CAST({c} AS BIGINT), a := '{'I' * (c // 3)}')" for c in _END)}] AS v FROM counts
  UNION ALL
  SELECT conv_id, i, [{_cheapest('b[1]', _longer('I', '3', 'b[3]'), _longer('II', '6', 'b[4]'))}, {_cheapest('b[2]', _longer('I', '3', 'b[3]'), _longer('II', '6', 'b[4]'))},
                      {_cheapest('b[3]', _longer('I', '3', 'b[4]'))}, {_cheapest('b[4]', _longer('I', '3', 'b[3]'))}]
  FROM (SELECT w.conv_id AS conv_id, i - 1 AS i, [{', '.join(_over_row(q) for q in range(4))}] AS b
        FROM walk w JOIN rows x ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND w.i = x.r) y),
best AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM walk WHERE i = 0),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(length(audit))) AS o, length(replace(audit, 'D', '')) AS size FROM best WHERE audit <> ''),
edits AS (
  SELECT conv_id, e, o, size, count(*) FILTER (e <> 'I') OVER w AS r, count(*) FILTER (e <> 'D') OVER w AS m FROM letters
  WINDOW w AS (PARTITION BY conv_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
repaired AS (
  SELECT e.conv_id AS conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (m + size) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY o)) AS s
  FROM edits e LEFT JOIN rows x ON e.conv_id IS NOT DISTINCT FROM x.conv_id AND e.r = x.r WHERE e <> 'D' GROUP BY e.conv_id)
SELECT g.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(s, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON g.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN best b ON g.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired z ON g.conv_id IS NOT DISTINCT FROM z.conv_id
"""
