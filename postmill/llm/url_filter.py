"""URL rules looked up in a sorted array of 64-bit digests.

Every entry (a host and the beginning of a path, like `example.net/en/`) is kept
as its xxhash64 in a sorted array and as its full string. The two lie in files in
the shared checkpoint folder, which Spark hands to the executors; tasks map the
digests into memory, look up all candidates of a batch with one binary search,
and compare the stored string, so a collision never counts as a hit.

A URL's candidates are its host and parent domains, each with the beginnings of
its path in the lengths that occur among the entries.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.session import checkpoint_folder

from .columns import without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of one list; the files are written by the driver.
MOST = 10_000_000

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def write(spark: SparkSession, entries: dict[str, str]) -> str:
    """Put digests and strings into the shared folder and hand them out; returns the files' common name."""
    if len(entries) > MOST:
        raise ValueError(f"more than {MOST} entries")
    pairs = sorted((xxhash.xxh64_intdigest(e.encode()), e.encode(), v.encode()) for e, v in entries.items())
    name = f"urls-{uuid.uuid4().hex}"
    ends = np.cumsum([0] + [len(x) for _, e, v in pairs for x in (e, v)]).astype(np.int64)
    parts = {"digests": np.array([d for d, _, _ in pairs], np.uint64).tobytes(), "ends": ends.tobytes(), "strings": b"".join(e + v for _, e, v in pairs)}
    jvm = spark.sparkContext._jvm
    for part, data in parts.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark).rstrip('/')}/{name}.{part}")
        stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        for lo in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[lo : lo + (1 << 20)]))
        stream.close()
        spark.sparkContext.addFile(str(path.toString()))
    return name


def _map(path: str, kind) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


class DigestArray:
    def __init__(self, name: str):
        self.digests, self.ends, self.strings = (_map(SparkFiles.get(f"{name}.{p}"), k) for p, k in (("digests", np.uint64), ("ends", np.int64), ("strings", np.uint8)))

    def entry(self, i: int) -> tuple[bytes, str]:
        a, b, c = self.ends[2 * i : 2 * i + 3].tolist()
        return self.strings[a:b].tobytes(), self.strings[b:c].tobytes().decode()

    def probe(self, candidates: list[bytes]) -> list[str | None]:
        """The value stored with each candidate, None where it is no entry."""
        if not candidates or not len(self.digests):
            return [None] * len(candidates)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.digests, keys)
        out: list[str | None] = [None] * len(candidates)
        for c in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == keys).tolist():
            i = int(at[c])
            while i < len(self.digests) and self.digests[i] == keys[c]:
                stored, value = self.entry(i)
                if stored == candidates[c]:
                    out[c] = value
                    break
                i += 1
        return out


@cache
def _opened(name: str) -> DigestArray:
    return DigestArray(name)


def host_and_path(df: DataFrame, url: str) -> DataFrame:
    """The frame with `host` and `path`; both empty for a null URL or one without `://`."""
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return df.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def judge(df: DataFrame, url: str = "url", rules: dict[str, str] | None = None, otherwise: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """The rows with host, path, rule and verdict.

    A rule `host/path` fits its host and all subdomains where the URL's path starts
    with the rule's; the longest fitting rule wins (as long: the longer host). URLs
    that no entry fits get `otherwise`. Null and malformed URLs have empty host and
    path and no rule. Rows that repeat are judged alike; an empty table stays empty.
    Input columns named host, path, rule or verdict are replaced.
    """
    rules = RULES if rules is None else rules
    base = without(df, "host", "path", "rule", "verdict")
    back = keep or base.columns
    name = write(df.sparkSession, rules)
    lengths = sorted({len(r) - r.index("/") for r in rules})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _opened(name)
        for batch in batches:
            hosts, paths = batch.column(len(back)).to_pylist(), batch.column(len(back) + 1).to_pylist()
            candidates, owner = [], []
            for i, (host, path) in enumerate(zip(hosts, paths)):
                labels = host.split(".") if host else []
                starts = [path[:n] for n in lengths if len(path) >= n]
                for j in range(len(labels)):
                    tail = ".".join(labels[j:])
                    for s in starts:
                        candidates.append((tail + s).encode())
                        owner.append((i, len(tail)))
            rule: list[str | None] = [None] * len(hosts)
            verdict = [otherwise] * len(hosts)
            best = [(0, 0)] * len(hosts)
            for (i, tail), text, value in zip(owner, candidates, found.probe(candidates)):
                if value is not None and (len(text), tail) > best[i]:
                    best[i], rule[i], verdict[i] = (len(text), tail), text.decode(), value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    kinds = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in back)
    return host_and_path(base, url).select(*[f"`{c}`" for c in back], "host", "path").mapInArrow(run, f"{kinds}, host string, path string, rule string, verdict string")


SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule, rhost, rpath, verdict) AS (VALUES {", ".join(f"('{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{v}')" for r, v in RULES.items())}),
m AS (SELECT p.*, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(rhost) DESC) AS n
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
