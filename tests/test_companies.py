"""Companies against a fold written out, and blocks against brute force; odd rows of merges and replays."""

import random

import pytest
from pyspark.sql import functions as F

from tesselar.functions import keys as K
from tesselar.operators import companies, ingest, merge
from tesselar.operators.settle import groups_of

SCHEMA = "arrival long, cnpj string, domain string, name string"


def folded(rows):
    """The rules one event after the other, over a plain list of companies."""
    known, out = [], {}
    for arrival, cnpj, domain, name in sorted(rows):
        hit = [c for c in known if cnpj and c["cnpj"] == cnpj]
        safe = [c for c in known if domain and c["domain"] == domain and not (cnpj and c["cnpj"] and c["cnpj"] != cnpj)]
        same = [c for c in known if name and c["name"] == name]
        if hit:
            out[arrival] = (hit[0]["id"], "resolved")
        elif len(safe) == 1 or (not safe and len(same) == 1):
            c = (safe or same)[0]
            c["cnpj"] = c["cnpj"] or cnpj
            if not safe:
                c["domain"] = c["domain"] or domain
            out[arrival] = (c["id"], "resolved")
        elif safe or same:
            out[arrival] = (None, "ambiguous")
        else:
            known.append({"id": arrival, "cnpj": cnpj, "domain": domain, "name": name})
            out[arrival] = (arrival, "created")
    return out


def test_companies_equal_a_fold(spark):
    rng = random.Random(3)
    some = lambda n, f: f(rng.randrange(n)) if rng.random() < 0.6 else None
    rows = [(i, some(12, lambda k: f"{k:014d}"), some(9, lambda k: f"d{k}.com"), some(9, lambda k: f"firm {k}")) for i in range(300)]
    rows = [r for r in rows if any(r[1:])]
    got = companies.companies(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    want = folded(rows)
    assert {r.arrival: (r.company, r.decision) for r in got} == want
    assert {d for _, d in want.values()} == {"created", "resolved", "ambiguous"}


def adversarial(n):
    """Each event's fate hangs on the one before: a chain of domains and names that are learnt one by one."""
    rows = []
    for i in range(n):
        rows.append((3 * i, None, None, f"firm {i}"))
        rows.append((3 * i + 1, f"{i:014d}" if i % 3 else None, f"d{i}.com", f"firm {i}"))
        rows.append((3 * i + 2, f"{i + 500:014d}" if i % 2 else None, f"d{i}.com", f"firm {i + 1}" if i % 4 else None))
    return [r for r in rows if any(r[1:])]


@pytest.mark.parametrize("rows", ["random", "one domain", "chain"])
def test_rounds_equal_the_fold(spark, rows):
    rng = random.Random(9)
    some = lambda p, n, f: f(rng.randrange(n)) if rng.random() < p else None
    if rows == "random":
        made = [(i, some(0.5, 14, lambda k: f"{k:014d}"), some(0.6, 9, lambda k: f"d{k}.com"), some(0.6, 9, lambda k: f"firm {k}")) for i in range(250)]
    elif rows == "one domain":
        made = [(i, some(0.4, 30, lambda k: f"{k:014d}"), "hot.com" if rng.random() < 0.7 else None, some(0.5, 20, lambda k: f"firm {k}")) for i in range(250)]
    else:
        made = adversarial(12)
    made = [r for r in made if any(r[1:])]
    want = folded(made)
    df = spark.createDataFrame(made, SCHEMA).repartition(5)
    got = companies.resolved_companies(df, large=0)
    told = {r.arrival: r for r in got[0].collect()}
    assert {a: (r.company, r.decision) for a, r in told.items()} == want
    # what tasks fold and what rounds find is the same, candidates and companies included
    fold = companies.resolved_companies(df)
    assert {a: sorted(r.candidate_ids) for a, r in told.items()} == {r.arrival: sorted(r.candidate_ids) for r in fold[0].collect()}
    assert sorted(map(str, got[1].collect())) == sorted(map(str, fold[1].collect()))


def test_rounds_go_on_from_stored_companies(spark):
    rng = random.Random(11)
    some = lambda p, n, f: f(rng.randrange(n)) if rng.random() < p else None
    rows = [r for r in [(i, some(0.4, 12, lambda k: f"{k:014d}"), some(0.6, 5, lambda k: f"d{k}.com"), some(0.6, 6, lambda k: f"firm {k}")) for i in range(160)] if any(r[1:])]
    want, first = folded(rows), companies.resolved_companies(spark.createDataFrame([r for r in rows if r[0] < 80], SCHEMA))
    stored = spark.createDataFrame(first[1].collect(), first[1].schema)
    second = companies.resolved_companies(spark.createDataFrame([r for r in rows if r[0] >= 80], SCHEMA), stored, large=0)
    assert {r.arrival: (r.company, r.decision) for r in second[0].collect()} == {a: w for a, w in want.items() if a >= 80}


def test_company_cases(spark):
    rows = [
        (1, "12.345.678/0001-99", None, "ABC Ltda"), (2, "12345678000199", None, "ABC Industria"), (3, "11111111000111", "grupo.com.br", "Unidade A"), (4, "22222222000122", "https://www.Grupo.com.br/x", "Unidade B"),
        (5, None, "grupo.com.br", None), (6, None, None, "abc"), (7, None, None, None), (8, "bad", "", " "),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.arrival: (r.company, r.decision, r.matched_on) for r in companies.companies(df).collect()}
    assert got == {1: (1, "created", None), 2: (1, "resolved", "cnpj"), 3: (3, "created", None), 4: (4, "created", None), 5: (None, "ambiguous", "domain"), 6: (1, "resolved", "name"), 8: (8, "created", None)}
    assert [(r.arrival, r.case_type) for r in companies.ambiguity_cases(companies.companies(df)).collect()] == [(5, "possible_duplicate_company")]
    assert companies.companies(df.where("false")).count() == 0


def test_blocks(spark):
    # two chains of a hundred and a star
    pairs = [(i, f"a{j}") for i in range(0, 200, 2) for j in (i, i + 2)] + [(i, f"b{j}") for i in range(1, 200, 2) for j in (i, i + 2)] + [(300 + i, "star") for i in range(50)] + [(400, "own")]
    got = {r.item: r.block for r in groups_of(spark.createDataFrame(pairs, "item long, key string"), "item", "key").collect()}
    assert got == {i: 400 if i == 400 else 300 if i >= 300 else i % 2 for i, _ in pairs}


def test_identities_of_known_persons(spark):
    captured = [(1, 7, "A@x.co"), (1, 7, " a@x.co "), (2, 7, "new@x.co"), (3, 8, "a@x.co"), (4, 8, "new@x.co"), (4, 8, "more@x.co"), (5, 9, "more@x.co"), (6, 9, "no")]
    df = spark.createDataFrame([(n, p, "s", "email", v) for n, p, v in captured], "arrival long, person long, source string, type string, value string")
    owners = spark.createDataFrame([(8, "email", "a@x.co")], "person long, type string, value string").select("person", K.identity(F.col("type"), F.col("value"))["hash"].alias("key"))
    new, told = companies.linked_identities(df, owners)
    # a@x.co is 8's; new@x.co was 7's before 8 showed it, so 4 adds nothing and 9 gets more@x.co
    assert {r.arrival: r.conflict for r in told.collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert sorted((r.arrival, r.person) for r in new.collect()) == [(2, 7), (5, 9)]


def test_batches_of_companies_equal_one_run(spark):
    rng = random.Random(5)
    some = lambda n, f: f(rng.randrange(n)) if rng.random() < 0.6 else None
    rows = [(i, some(9, lambda k: f"{k:014d}"), some(6, lambda k: f"d{k}.com"), some(6, lambda k: f"firm {k}")) for i in range(120)]
    rows = [r for r in rows if any(r[1:])]
    want, got, stored = folded(rows), {}, spark.createDataFrame([], "company long, cnpj string, domain string, name string")
    for a, b in ((0, 40), (40, 90), (90, 120)):
        found, changed = companies.resolved_companies(spark.createDataFrame([r for r in rows if a <= r[0] < b], SCHEMA), stored)
        got |= {r.arrival: (r.company, r.decision) for r in found.collect()}
        now = {r.company: tuple(r) for r in stored.collect()} | {r.company: tuple(r) for r in changed.collect()}
        stored = spark.createDataFrame(list(now.values()), stored.schema)
    assert got == want


def test_upsert_of_null_and_repeated_keys(spark):
    stored = spark.createDataFrame([(1, "a", 5), (None, None, 1)], "k int, name string, n int")
    new = spark.createDataFrame([(1, "b", 9, 1), (1, "c", 3, 2), (None, "x", None, 3), (2, None, 1, 4), (2, "y", 2, 5)], "k int, name string, n int, at int")
    got = {r.k: (r.name, r.n) for r in merge.upsert(stored, new, ["k"], {"name": "keep", "n": "max"}, [F.col("at")]).collect()}
    assert got == {1: ("a", 9), None: ("x", 1), 2: ("y", 2)}


def test_replay(spark):
    log = spark.createDataFrame([("s", "1", "failed", 0), ("s", "2", "conflict", 2), ("s", "3", "processed", 0), ("s", "4", "failed", 1), ("s", "5", "pending", 0)], "source string, event_id string, status string, retry_count int")
    handled = spark.createDataFrame([("s", "1", "processed"), ("s", "2", "conflict"), ("s", "3", "failed"), ("s", "5", "failed")], "source string, event_id string, status string")
    after = ingest.replay(log, handled)
    assert sorted((r.event_id, r.status, r.retry_count) for r in after.collect()) == [("1", "processed", 0), ("2", "conflict", 3), ("3", "processed", 0), ("4", "failed", 1), ("5", "failed", 1)]
    cases = spark.createDataFrame([("s", "1", "open", None), ("s", "2", "open", None), ("s", "6", "open", None), ("s", "1", "dismissed", None)], "source string, event_id string, status string, resolution string")
    got = sorted((r.event_id, r.status, r.resolution) for r in ingest.closed_cases(cases, handled).collect())
    # 6 was not run again, so its case stays open whatever the log says of it
    assert got == [("1", "dismissed", None), ("1", "resolved", "reprocessed"), ("2", "open", None), ("6", "open", None)]


def test_events_that_name_the_same_are_placed_once(spark, monkeypatch):
    # a domain of one company, which two more share from 100 and 150 on, and a name of which a second company has it from 200 on
    rows = [(i, None, "a.com" if i % 2 else None, "same" if i % 2 == 0 else None) for i in range(300) if i not in (100, 150, 200)]
    rows += [(100, "1" * 14, "a.com", None), (150, "2" * 14, "a.com", None), (200, "3" * 14, "b.com", "same")]
    plain, want = companies.Registry(), {}
    for r in sorted(rows, key=lambda r: r[0]):
        want[r[0]] = plain.place(*r)
    seen, grouped = [], companies.groups_of
    monkeypatch.setattr(companies, "groups_of", lambda pairs, *a: (seen.append(pairs.select("arrival").distinct().count()), grouped(pairs, *a))[1])
    df = spark.createDataFrame(rows, "arrival long, cnpj string, domain string, name string")
    told = companies.resolved_companies(df)[0].collect()
    assert {r["arrival"]: (r["company"], r["decision"], r["matched_on"], r["candidate_ids"]) for r in told} == want
    assert seen == [5]
    # companies of a key that are too many to be listed
    monkeypatch.setattr(companies, "LISTED", 0)
    told = companies.resolved_companies(df)[0].collect()
    assert {r["arrival"]: (r["company"], r["decision"], r["matched_on"], r["candidate_ids"]) for r in told} == want
