"""Edits of conversations against an enumeration of all edits, blocks against whole searches, and odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tesselar.llm import conversation_repair as repair
from tesselar.llm import queries as llm

EMPTY = hashlib.sha256().hexdigest()


def test_sql(same):
    same(llm.queries()["op12_conversation_repair"], llm.oracle_sql()["op12_conversation_repair"])


def enumerated(kinds):
    """The least (cost, audit) over all edits of (initial, kind) turns, with at most two insertions in a gap, by regular expression."""
    best = None

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(kinds) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = cost, audit
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if inserted < 2:
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I", inserted + 1)
        if i < len(kinds):
            initial, kind = kinds[i]
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if kind != "gone":
                more = 3 * (kind == "cut")
                go(i + 1, roles + initial, cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def code(initial, kind):
    return chr(65 + 4 * ("sound", "gone", "cut").index(kind) + "suax".index(initial))


def test_search_and_blocks():
    rng = random.Random(3)
    for _ in range(250):
        kinds = [(rng.choice("suuaax"), rng.choice(["sound", "sound", "gone", "cut"])) for _ in range(rng.randrange(1, 6))]
        codes = "".join(code(*k) for k in kinds)
        want = enumerated(kinds)
        assert repair.whole(codes) == want
        for most in (1, 2, 3):
            assert repair.folded([repair.block(codes[i : i + most]) for i in range(0, len(codes), most)]) == want


def by_hand(rows):
    """Counts, edits and hash of one conversation's rows (turn, role, text) in order."""
    seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "x", {"blank": "gone", "duplicate": "gone", "truncated": "cut"}.get(fault, "sound")))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = repair.whole("".join(code(*k) for k in kinds)) if rows else (0, "")
    lines, left, state = [], iter(rows), 0
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        state = 1 if letter == "K" and row[1][:1] == "s" else 3 if state == 2 else 2
        role = row[1] if letter == "K" else ["", "", "user", "assistant"][state]
        lines.append(f"{role}:{row[2] if row else ''}")
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def planted():
    rng = random.Random(8)
    say = lambda: rng.choice(["One.", "Two!", "no end", "One.", " ", "", "Why?\n", "x" * 70 + rng.choice("ab.") + ".", "Ünï. "])
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice([None, say(), say(), say()])) for c in [*range(30), None] for _ in range(rng.randrange(1, 9))]
    rows += [(500, t, ["user", "assistant"][t % 2], f"Turn {t % 40}.") for t in range(700)]
    rows += [(501, 3, "user", "Same.")] * 400 + [(502, None, None, None)]
    return rows


def ordered(rows):
    plain = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))


@pytest.mark.parametrize("most", [2, 64, 256])
def test_odd_rows(spark, most):
    rows = planted()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("x")).repartition(6)
    out = repair.repair(df, most=most).collect()
    of = {}
    for c, *r in rows:
        of.setdefault(c, []).append(r)
    assert len(out) == len(of)
    for r in out:
        assert tuple(r)[1:] == by_hand(ordered(of[r.conv_id])), r.conv_id


def test_repaired_turns_match_the_hash(spark):
    df = spark.createDataFrame(planted(), "conv_id long, turn long, role string, text string")
    lines = {}
    for r in repair.repaired_turns(df).orderBy("turn").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.turn == len(lines[r.conv_id]) - 1
    for r in repair.repair(df).collect():
        turns = lines.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(turns).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t[:1] for t in turns))


def test_damage(spark):
    rows = [(c, t, r, x) for c in [*range(40), None] for t in [None, 0, 1, 2] for r, x in [("assistant", "A. b! c?"), (None, None)]]
    out = {}
    for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        out.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for key in {r[:2] for r in rows}:
        rest = zlib.crc32(":".join(" " if k is None else str(k) for k in key).encode()) % 20
        want = [("assistant", "A. b! c?"), (" ", " ")]
        want = {0: [], 1: [(r, "") for r, _ in want], 2: [(r, x.translate({ord(c): None for c in ".!?"})) for r, x in want], 3: want * 2, 4: [("user", x) for _, x in want]}.get(rest, want)
        assert sorted(out.get(key, [])) == sorted(want)


def test_conversations_without_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    (row,) = repair.repair(df.where("false"), df).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", EMPTY)
    assert repair.repair(df.where("false")).count() == 0 and repair.repaired_turns(df.where("false")).count() == 0
