"""Persons by identities, against one event after the other."""

import random

import pytest

from tesselar.operators import resolve

SCHEMA = "source string, arrival long, type string, value string"


def one_by_one(rows):
    """The plain fold, over normal values."""
    owner, out, events = {}, {}, {}
    for source, arrival, kind, value in rows:
        strong = kind in ("email", "phone")
        events.setdefault(arrival, set()).add(((kind, value) if strong else (source, kind, value), strong))
    first = {}
    for at in sorted(events):
        strong = {owner[k] for k, s in events[at] if s and k in owner}
        if len(strong) > 1:
            out[at] = (None, True)
            continue
        weak = sorted((first[k], owner[k]) for k, s in events[at] if k in owner)
        person = next(iter(strong), None) if strong else weak[0][1] if weak else at
        out[at] = (person, False)
        for k, _ in events[at]:
            if k not in owner:
                owner[k], first[k] = person, at
    return out


def resolved(spark, rows):
    return {r.arrival: (r.person, r.conflict) for r in resolve.persons(spark.createDataFrame(rows, SCHEMA)).collect()}


E, P = ("email", "a@b.co"), ("phone", "+5511988887777")


def test_order_matters(spark):
    assert resolved(spark, [("s", 1, *E), ("s", 2, *P), ("s", 3, *E), ("s", 3, *P), ("s", 4, "email", "bad"), ("t", 5, "email", " A@b.co ")]) == {1: (1, False), 2: (2, False), 3: (None, True), 5: (1, False)}
    assert resolved(spark, [("s", 1, *E), ("s", 1, *P), ("s", 2, *E), ("s", 3, *P)]) == {1: (1, False), 2: (1, False), 3: (1, False)}
    assert resolved(spark, [("s", 1, "visitor", "v"), ("t", 2, "visitor", "v"), ("s", 3, "visitor", "v")]) == {1: (1, False), 2: (2, False), 3: (1, False)}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_fold(spark, seed):
    r = random.Random(seed)
    rows = []
    for at in range(160):
        for _ in range(r.randint(1, 3)):
            kind, source = r.choice(["email", "visitor", "email"]), r.choice("st")
            rows.append(("s" if at % 2 else "t", at, kind, f"{r.randint(0, 70)}@x.co" if kind == "email" else f"v{r.randint(0, 30)}"))
    got, want = resolved(spark, rows), one_by_one(rows)
    assert got == want and any(c for _, c in want.values()) and len({p for p, _ in want.values()}) > 5


@pytest.mark.parametrize("seed", [4])
def test_batches_equal_one_run(spark, seed):
    """Owners that earlier batches attached are the state of the next; rows of other keys are not read."""
    r = random.Random(seed)
    rows = []
    for at in range(150):
        for _ in range(r.randint(1, 3)):
            kind = r.choice(["email", "visitor", "email"])
            rows.append(("s" if at % 2 else "t", at, kind, f"{r.randint(0, 60)}@x.co" if kind == "email" else f"v{r.randint(0, 20)}"))
    want, got = one_by_one(rows), {}
    owners = spark.createDataFrame([], "key string, first long, person long")
    for a, b in ((0, 50), (50, 60), (60, 150)):
        df = spark.createDataFrame([x for x in rows if a <= x[1] < b], SCHEMA)
        ids = resolve.identity_keys(df)
        found = resolve.persons(df, owners)
        got |= {x.arrival: (x.person, x.conflict) for x in found.collect()}
        owners = spark.createDataFrame(owners.unionByName(resolve.attached(ids, found, owners)).collect(), owners.schema)
        assert owners.groupBy("key").count().where("count > 1").isEmpty()
    assert got == want and any(c for _, c in want.values())
    few = resolve.identity_keys(spark.createDataFrame([("s", 999, "email", "3@x.co")], SCHEMA))
    assert resolve.touched_owners(owners, few).count() <= 1


def test_rounds_see_each_set_of_identities_once(spark, monkeypatch):
    # 300 events of two people, of whom later ones show both; then one more pair of people in conflict
    rows = [("s", i, "email", f"{u}@x.co") for i in range(300) for u in ({i % 2, 1 - i % 2} if i > 150 and i % 3 == 0 else {i % 2})]
    seen, plain = [], resolve._roots
    monkeypatch.setattr(resolve, "_roots", lambda parents: (seen.append(parents.count()), plain(parents))[1])
    got = {r["arrival"]: (r["person"], r["conflict"]) for r in resolve.persons(spark.createDataFrame(rows, "source string, arrival long, type string, value string")).collect()}
    assert got == {i: (None, True) if i > 150 and i % 3 == 0 else (i % 2, False) for i in range(300)}
    assert max(seen) <= 3
