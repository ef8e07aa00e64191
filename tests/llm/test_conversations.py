"""Conversation repair against a plain dynamic program over whole conversations."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from postmill.llm import conversations

SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = {}
    for conv, turn, role, text in rows:
        out = by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        if kind:
            out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {conv: judged(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:128], hashlib.sha256(r[2].encode()).hexdigest()))) for conv, rows in by.items()}


def judged(rows):
    seen, blank, again, cut, flags = set(), 0, 0, 0, []
    for _, role, text in rows:
        solid = text.rstrip(SPACE)
        gone, late = not solid or (role, text) in seen, 0
        if not solid:
            blank += 1
        elif (role, text) in seen:
            again += 1
        elif solid[-1] not in ".!?":
            cut, late = cut + 1, 3
        seen.add((role, text))
        flags.append((gone, late))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    then = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserted=0):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            gone, late = flags[i]
            cost, audit, turns = best(i + 1, state)
            ways.append((cost + 4, "D" + audit, turns))
            if not gone:
                own = initials[i]
                if (own == "s" and state == "") or (own == "u" and state != "u") or (own == "a" and state == "u"):
                    cost, audit, turns = best(i + 1, own)
                    ways.append((cost + late, "K" + audit, ((rows[i][1], rows[i][2]), turns)))
                cost, audit, turns = best(i + 1, then[state])
                ways.append((cost + 3 + late, "R" + audit, (({"u": "user", "a": "assistant"}[then[state]], rows[i][2]), turns)))
        if inserted < 2:
            cost, audit, turns = best(i, then[state], inserted + 1)
            ways.append((cost + 3, "I" + audit, (({"u": "user", "a": "assistant"}[then[state]], ""), turns)))
        return min(ways, key=lambda w: w[:2]) if ways else (1 << 40, "~", ())

    cost, audit, turns = best(0, "")
    lines = []
    while turns:
        (role, text), turns = turns
        lines.append(f"{role}:{text}")
    return gaps, blank, again, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def repaired(df, **options):
    rows = conversations.repair(df, **options).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def some_rows(seed):
    pick = random.Random(seed)
    texts = ["Yes.", "no", "What? ", "  ", "", "A longer answer, with an end.\n", "cut off", "Näher! \t", "Yes.", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "us"]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(pick.choice([1, 2, 5, 9, 30])):
            rows.append((conv, pick.choice([None, *range(12)]), pick.choice(roles), pick.choice(texts) if pick.random() < 0.6 else f"{pick.random()}."))
    return rows + [(700, t, ("user", "assistant")[t % 2 if t % 13 else 0], f"{t}" + ". "[t % 7 == 0]) for t in range(150)]


@pytest.mark.parametrize("bits", [1, 3, 13])
def test_equals_a_plain_program_whatever_the_pieces(spark, bits):
    rows = some_rows(bits)
    got = repaired(spark.createDataFrame(rows, SCHEMA).repartition(3), piece_bits=bits)
    assert got == plain(rows)


def test_odd_rows(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    whole = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in range(3)))
    long_text = "a" * 3_000_000 + "."
    rows = [(dropped, 0, "user", "x."), (whole, 0, "user", long_text), (whole, 1, "assistant", long_text), (whole, 2, "assistant", None), (None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", AUDIT int, cost string")
    got = repaired(df)
    assert got == plain(rows) | {dropped: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert got[whole][6] == "KKD" and got[whole][1] == 1
    assert repaired(df.limit(0)) == {}


def test_ties_take_the_least_letters(spark):
    # A turn may be inserted first and the last one given another role, or the other way round.
    assert judged([(t, "user", f"{t}.") for t in range(3)])[5:7] == (6, "KIKR")
    # One assistant: a user before it costs less than to delete it.
    assert judged([(0, "assistant", "a.")])[5:7] == (3, "IK")
    quiet = next(i for i in range(10**6) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in range(3)))
    assert repaired(spark.createDataFrame([(quiet, t, "user", f"{t}.") for t in range(3)], SCHEMA))[quiet][5:7] == (6, "KIKR")


def test_matrix_products_are_associative():
    import numpy as np

    rng = np.random.default_rng(1)
    m = conversations._row_matrices(rng.integers(-1, 4, 50), rng.random(50) < 0.3, rng.choice([0, 3], 50))
    fold = [m[-1]]
    for x in m[-2::-1]:
        fold.append(conversations._times(x[None], fold[-1][None])[0])
    assert (conversations._suffix_products(m, np.full(50, 49)) == np.array(fold[::-1])).all()
