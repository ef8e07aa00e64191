"""MinHash near-duplicates with tensored banding.

Two collections of HALVES short keys each are made from few minhashes; every
pairing of a key of the first with a key of the second is a table. 2 * HALVES *
ROWS minhashes so give HALVES ** 2 tables of 2 * ROWS minhashes each. Two texts
of similarity s meet in a table unless one whole collection fails them, with
probability below 2 * (1 - s ** ROWS) ** HALVES: 7e-5 at 0.85, 6e-4 at 0.8, and
far less for closer texts.

Candidates are confirmed on full shingle sets:

1. Texts of one shingle set are one representative, known by the set's digest; rows that
   share an id but not a text so stay apart.
2. Keys that only one representative has are dropped before tables are formed.
3. In each table all members are compared with one hub, the member that meets
   most others. That is one pair per member, not one per pair of members.
4. What is still in different components although it shares a table is compared
   in blocks: a task gets two blocks of at most BLOCK members of one key and
   returns links that join components. Work there is quadratic in what the hubs
   left over, but no task and no row grows with a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import cut_lineage, scratch

from . import bytewords as bw
from .columns import without, written
from .graph import components

HALVES = 8
ROWS = 2
BLOCK = 256

_SEEDS = bw.mix64(np.arange(1, 2 * HALVES * ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]
_ODD = bw.mix64(_SEEDS + np.uint64(7)) | np.uint64(1)


def shingle_sets(w: bw.Words, size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes; a shorter text's whole run of words is its one shingle."""
    h = w.hashes()
    at = np.arange(len(h))
    grams = bw.range_hash(h, at[: len(h) - size + 1], at[: len(h) - size + 1] + size) if len(h) >= size else h[:0]
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if hi - lo >= size:
            yield np.unique(grams[lo : hi - size + 1])
        elif hi > lo:
            yield bw.range_hash(h, np.array([lo]), np.array([hi]))
        else:
            yield h[:0]


def _keys(s: np.ndarray) -> np.ndarray:
    """2 * HALVES keys of a set: the first collection's, then the second's."""
    least = ((s[None, :] ^ _SEEDS) * _ODD).min(axis=1).reshape(2 * HALVES, ROWS)
    key = np.arange(1, 2 * HALVES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = bw.mix64(key ^ least[:, r])
    return key


def _sketches(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n, sig, a, b): set size, digest of the set, and the two collections of keys (empty for an empty set)."""

    def run(batches):
        for batch in batches:
            for lo, hi, w in bw.words(batch.column(1), bw.NOT_SPACE):
                n, sig, rows = [], [], []
                for s in shingle_sets(w, size):
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                    rows.append(_keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
                both = [pa.array([r[:HALVES] for r in rows], pa.list_(pa.int64())), pa.array([r[HALVES:] for r in rows], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), *both], names=["id", "n", "sig", "a", "b"])

    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "id bigint, n bigint, sig binary, a array<bigint>, b array<bigint>")


def _full_sets(df: DataFrame, size: int) -> DataFrame:
    """(text) -> (sig, set)."""

    def run(batches):
        for batch in batches:
            for lo, hi, w in bw.words(batch.column(0), bw.NOT_SPACE):
                sets = list(shingle_sets(w, size))
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sig", "set"])

    return df.select("text").mapInArrow(run, "sig binary, set array<bigint>")


def _with_sig(df: DataFrame, text: str, size: int) -> DataFrame:
    """The rows with `_sig`, the digest of their set (null for an empty one)."""

    def run(batches):
        for batch in batches:
            sig = []
            for _, _, w in bw.words(batch.column(batch.schema.get_field_index(text)), bw.NOT_SPACE):
                sig += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in shingle_sets(w, size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig, pa.binary())], names=[*batch.schema.names, "_sig"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, _sig binary")


def _linked(inter, n1, n2, percent: int):
    return 100 * inter >= percent * (n1 + n2 - inter)


def _compare_block(t: pa.Table, percent: int) -> pa.Table:
    """Links between components among the members of two blocks that also share a key of the second collection."""
    ids, comp, n = (t.column(c).to_numpy() for c in ("id", "component", "n"))
    b = np.stack(t.column("b").combine_chunks().flatten().to_numpy().reshape(len(ids), HALVES))
    part = t.column("part").to_numpy()
    flat = t.column("set").combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(ids)), n)
    values, code = np.unique(flat, return_inverse=True)
    common = np.bincount(code, minlength=len(values)) > 1
    shared = np.bincount(owner[common[code]], minlength=len(ids))
    live = np.flatnonzero(100 * shared >= percent * n)  # the others share too little with all the rest together
    rank = np.full(len(ids), -1)
    rank[live] = np.arange(len(live))
    take = common[code] & (rank[owner] >= 0)
    rows, code = rank[owner[take]], (np.cumsum(common) - 1)[code[take]]
    m, width = len(live), int(common.sum())
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    inter = np.zeros((m, m), np.float32)
    for lo in range(0, width, 4096):
        x, y = np.searchsorted(code, [lo, lo + 4096])
        dense = np.zeros((m, min(4096, width - lo)), np.float32)
        dense[rows[x:y], code[x:y] - lo] = 1
        inter += dense @ dense.T
    n, comp, ids, b, part = n[live], comp[live], ids[live], b[live], part[live]
    u, v = [], []
    root = {c: c for c in set(comp.tolist())}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    two = len(set(part.tolist())) > 1
    for i in range(m):
        near = np.flatnonzero(_linked(inter[i, :i], n[i], n[:i], percent) & (comp[:i] != comp[i]) & (b[:i] == b[i]).any(axis=1) & ((part[:i] != part[i]) | (not two)))
        for j in near.tolist():
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                u.append(int(ids[i]))
                v.append(int(ids[j]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


OWN = ("n_shingles", "component_id", "kept")


def group(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of the input: (key, n_shingles, component_id, kept).

    Texts are linked when 100 * intersection >= percent * union of their sets of
    distinct shingles (`shingle` words in a row, A-Z lower-cased; a shorter text is
    one shingle). component_id is the smallest key that can be reached. Null and empty
    texts have no shingle and are linked with nothing. A row without a key is linked
    with nothing, has no component and is kept. Rows with equal keys are judged each
    by its own text: equal texts under one key share all values. An empty table stays
    empty. Keys are whole numbers. The result's columns are fixed; others of the input are
    not read.
    """
    with scratch(df.sparkSession) as keep:
        out = _judged(df, key, text, shingle, percent, keep)
        return cut_lineage(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept"))


def _judged(df: DataFrame, key: str, text: str, shingle: int, percent: int, keep) -> DataFrame:
    """(id, n, sig, component_id, kept) of each row. Within, a representative is known by a number of its own."""
    sketches = keep(_sketches(df, key, text, shingle))
    usable = sketches.filter("n > 0 AND id IS NOT NULL")
    reps = usable.groupBy("sig").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    reps = keep(reps.withColumn("id", F.monotonically_increasing_id()))

    def common(side: str) -> DataFrame:
        each = reps.select("id", F.explode(side).alias(side))
        return each.join(each.groupBy(side).agg(F.count("*").alias("c")).filter("c > 1").select(side), side)

    cells = written(common("a").join(common("b"), "id").select("id", "a", F.xxhash64("a", "b").alias("cell")), keep)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("c")).filter("c > 1")
    met = written(cells.join(sizes, "cell"), keep)
    weight = met.groupBy("id").agg(F.sum("c").alias("weight"))
    ranked = met.join(weight, "id")
    hubs = ranked.groupBy("cell").agg((-F.max(F.struct("weight", -F.col("id")))["col2"]).alias("hub"))
    spokes = met.join(hubs, "cell")
    pairs = spokes.filter("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()

    wanted = met.select("id").distinct()
    wanted = reps.join(wanted, "id", "left_semi").select("sig", "id", "n", "b", "least")
    # A representative's set: of the rows with its least key, the one whose digest is its own.
    texts = df.select(F.col(f"`{key}`").cast("long").alias("least"), F.col(f"`{text}`").alias("text")).join(wanted.select("least").distinct(), "least", "left_semi")
    sets = keep(_full_sets(texts, shingle).dropDuplicates(["sig"]).join(wanted.drop("least"), "sig").select("id", "n", "b", "set"))
    one, two = sets.select(F.col("id").alias("u"), F.col("n").alias("n1"), F.col("set").alias("s1")), sets.select(F.col("id").alias("v"), F.col("n").alias("n2"), F.col("set").alias("s2"))
    sized = sets.select("id", "n")
    pairs = pairs.join(sized.select(F.col("id").alias("u"), F.col("n").alias("m1")), "u").join(sized.select(F.col("id").alias("v"), F.col("n").alias("m2")), "v")
    pairs = pairs.filter(100 * F.least("m1", "m2") >= percent * F.greatest("m1", "m2")).select("u", "v")
    inter = F.size(F.array_intersect("s1", "s2"))
    # Members' own sets come first: a hub's set then goes to its members' tasks, not with each member.
    links = written(pairs.join(two, "v").join(one, "u").withColumn("inter", inter).filter(_linked(F.col("inter"), F.col("n1"), F.col("n2"), percent)).select("u", "v"), keep)

    first = written(components(links, keep), keep)
    labelled = spokes.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_cells = labelled.filter("id <> hub").groupBy("cell").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("cell")
    rest = written(labelled.join(open_cells, "cell", "left_semi").select("a", "id", "component").distinct(), keep)
    blocks = rest.join(rest.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "a")
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("a", "id", "component", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    more = blocks.join(sets, "id").groupBy("a", "p", "q").applyInArrow(lambda t: _compare_block(t, percent), "u bigint, v bigint")
    linked = links.union(more)
    found = components(linked, keep)

    classes = reps.select("sig", "least", F.col("id").alias("rep")).join(found, F.col("rep") == F.col("id"), "left").select("sig", "least", F.coalesce("component", "rep").alias("component"))
    first_ids = written(classes.groupBy("component").agg(F.min("least").alias("component_id")), keep)
    classes = classes.join(first_ids, "component").select("sig", "component_id")
    out = sketches.select("id", "n", "sig").join(classes, "sig", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select("id", "n", "sig", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group stays, with the smallest key; rows without a shingle or a key all stay.

    Rows that share a key are judged by their texts: of equal texts under the group's key
    one stays, and a text of another group is not lost with its namesake.
    """
    rows = without(df, "_gone", "_sig")
    id_ = F.col(f"`{key}`").cast("long")
    with scratch(df.sparkSession) as keep:
        judged = keep(_judged(rows, key, text, shingle, percent, keep).filter("id IS NOT NULL"))
        # Keys of several rows, as a rule none: their rows are told apart by digest. These small tables outlive the block.
        repeated = written(judged.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("id").alias("_gone")))
        gone = written(judged.filter("NOT kept").select(F.col("id").alias("_gone"), F.col("sig").alias("_lost")).distinct())
    single = rows.join(gone.select("_gone").union(repeated), id_ == F.col("_gone"), "left_anti")
    several = _with_sig(rows.join(repeated, id_ == F.col("_gone"), "left_semi"), text, shingle)
    several = several.join(gone, (id_ == F.col("_gone")) & (F.col("_sig") == F.col("_lost")), "left_anti")
    texts = several.filter("_sig IS NOT NULL").dropDuplicates([key, "_sig"])
    return single.unionByName(texts.drop("_sig")).unionByName(several.filter("_sig IS NULL").drop("_sig"))


def sql(shingle: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {shingle - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {shingle - 1}) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= {percent} * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT y, c FROM reach JOIN both_ways ON x = doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id
"""
