"""Companies of large blocks in parallel: the rules of ``companies.Registry`` as rounds over all events at once.

What becomes of an event rests on earlier events only. So from any guess of all outcomes, outcomes that are worked out from what the guess says of
earlier times are right for at least one more event of each chain, and the state that a round leaves as it is, is the one that the rules give
one after the other. A round finds when each company came to know its CNPJ and domain (sums by company), and then for each event how many companies with
its domain or name there were before it: running sums over the key's changes and events. These are summed by slices of
time first, so that no key's rows meet in one task. Rounds follow the length of chains of changed minds, not the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesselar.operators.settle import settled

NUMBER = "decimal(38,0)"


def running(rows: DataFrame, key: str, width: int, sums: list[str]) -> DataFrame:
    """Rows (key, at, kind, ...) with the sums of a key's rows up to each, in order of at and kind."""
    placed = rows.withColumn("_slice", F.floor(F.col("at") / width))
    totals = placed.groupBy(key, "_slice").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(key, "_slice", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = W.partitionBy(key, "_slice").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.join(before, [key, "_slice"]).withColumns({c: (F.sum(c).over(inside) + F.col(f"_{c}")).cast(NUMBER) for c in sums}).drop("_slice", *[f"_{c}" for c in sums])


def _known(made: DataFrame, learnt: DataFrame) -> DataFrame:
    """(company, own_cnpj, cnpj_at, own_domain, domain_at, name): what a company has known of itself, and since when."""
    both = made.join(learnt.withColumnRenamed("company", "_c"), F.col("company") == F.col("_c"), "left")
    told = lambda c: F.coalesce(c, f"learnt_{c}")
    since = lambda c: F.when(F.col(c).isNotNull(), F.col("company")).otherwise(F.col(f"learnt_{c}_at"))
    return both.select("company", told("cnpj").alias("own_cnpj"), since("cnpj").alias("cnpj_at"), told("domain").alias("own_domain"), since("domain").alias("domain_at"), "name")


def facts(events: DataFrame, stored: DataFrame, guess: DataFrame) -> DataFrame:
    """What companies know if the guess (arrival, company, decision, matched_on) is right."""
    rows = events.join(guess, "arrival")
    made = stored.select("company", "cnpj", "domain", "name").unionByName(rows.where("decision = 'created'").select("company", "cnpj", "domain", "name"))
    found = rows.where("decision = 'resolved' AND matched_on <> 'cnpj'")
    first = lambda c, when: F.when(when & F.col(c).isNotNull(), F.col("arrival"))
    by_any, by_name = first("cnpj", F.lit(True)), first("domain", F.col("matched_on") == "name")
    learnt = found.groupBy("company").agg(F.min_by("cnpj", by_any).alias("learnt_cnpj"), F.min(by_any).alias("learnt_cnpj_at"), F.min_by("domain", by_name).alias("learnt_domain"), F.min(by_name).alias("learnt_domain_at"))
    return _known(made, learnt)


def _counted(asked: DataFrame, key: str, changes: DataFrame, sums: list[str], width: int) -> DataFrame:
    """(arrival, sums): of events (arrival, key) what the changes (key, at, sums) before them add up to."""
    zero = [F.lit(0).cast(NUMBER).alias(c) for c in sums]
    queries = asked.select(F.col(key).alias("key"), F.col("arrival").alias("at"), F.lit(0).alias("kind"), "arrival", *zero)
    rows = changes.select("key", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("arrival"), *[F.col(c).cast(NUMBER).alias(c) for c in sums]).unionByName(queries)
    return running(rows, "key", width, sums).where("arrival IS NOT NULL").select("arrival", *sums)


def next_guess(events: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """(arrival, company, decision, matched_on): what becomes of each event if companies know what they are said to."""
    held = known.where("own_cnpj IS NOT NULL").groupBy(F.col("own_cnpj").alias("cnpj")).agg(F.min("cnpj_at").alias("held_at"), F.min_by("company", "cnpj_at").alias("holder"))
    rows = events.join(held, "cnpj", "left").withColumn("by_cnpj", F.when(F.col("held_at") < F.col("arrival"), F.col("holder")))
    rows = rows.select("arrival", "cnpj", "domain", "name", "by_cnpj")
    # companies of another CNPJ may share a domain, so an event with a CNPJ counts those without one
    free = F.col("cnpj_at").isNull() | (F.col("cnpj_at") > F.col("domain_at"))
    one = lambda when, c: F.when(when, F.col(c).cast(NUMBER)).otherwise(F.lit(0).cast(NUMBER))
    has = known.where("own_domain IS NOT NULL").withColumn("n", F.lit(1))
    comes = has.select(F.col("own_domain").alias("key"), F.col("domain_at").alias("at"), one(F.lit(True), "n").alias("many"), one(F.lit(True), "company").alias("ids"), one(free, "n").alias("free"), one(free, "company").alias("free_ids"))
    zero = F.lit(0).cast(NUMBER)
    goes = has.where(free & F.col("cnpj_at").isNotNull()).select(F.col("own_domain").alias("key"), F.col("cnpj_at").alias("at"), zero.alias("many"), zero.alias("ids"), F.lit(-1).cast(NUMBER).alias("free"), (-F.col("company")).cast(NUMBER).alias("free_ids"))
    domains = _counted(rows.where("by_cnpj IS NULL AND domain IS NOT NULL"), "domain", comes.unionByName(goes), ["many", "ids", "free", "free_ids"], width)
    rows = rows.join(domains, "arrival", "left")
    safe, only = F.when(F.col("cnpj").isNull(), F.col("many")).otherwise(F.col("free")), F.when(F.col("cnpj").isNull(), F.col("ids")).otherwise(F.col("free_ids"))
    rows = settled(rows.select("arrival", "name", "by_cnpj", F.coalesce(safe, zero).alias("safe"), only.cast("long").alias("by_domain")))
    names = known.where("name IS NOT NULL").select(F.col("name").alias("key"), F.col("company").alias("at"), F.lit(1).alias("same"), F.col("company").alias("same_ids"))
    counted = _counted(rows.where("by_cnpj IS NULL AND safe = 0 AND name IS NOT NULL"), "name", names, ["same", "same_ids"], width)
    rows = rows.join(counted, "arrival", "left").withColumn("same", F.coalesce("same", zero))

    def pick(cnpj: Column, domain: Column, several: Column, name: Column, same: Column, new: Column) -> Column:
        return F.when(F.col("by_cnpj").isNotNull(), cnpj).when(F.col("safe") == 1, domain).when(F.col("safe") > 1, several).when(F.col("same") == 1, name).when(F.col("same") > 1, same).otherwise(new)

    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    company = pick(F.col("by_cnpj"), F.col("by_domain"), none, F.col("same_ids").cast("long"), none, F.col("arrival"))
    decision = pick(F.lit("resolved"), F.lit("resolved"), F.lit("ambiguous"), F.lit("resolved"), F.lit("ambiguous"), F.lit("created"))
    return rows.select("arrival", company.alias("company"), decision.alias("decision"), pick(F.lit("cnpj"), F.lit("domain"), F.lit("domain"), F.lit("name"), F.lit("name"), text).alias("matched_on"))


def width_of(events: DataFrame, slices: int = 64) -> int:
    """Of a slice of the time from the first event to the last."""
    ends = events.agg(F.min("arrival"), F.max("arrival")).first()
    return max(1, ((ends[1] or 0) - (ends[0] or 0)) // slices + 1)


def resolved(events: DataFrame, stored: DataFrame, most_rounds: int = 60, slices: int = 64) -> tuple[DataFrame, DataFrame, bool]:
    """((arrival, company, decision, matched_on, candidate_ids), (company, cnpj, domain, name), whether it settled): as ``companies.resolved_companies`` of events (arrival,
    cnpj, domain, name in normal form), before which companies are ``stored``."""
    events, stored = settled(events), settled(stored)
    width = width_of(events, slices)
    guess = settled(events.select("arrival", F.col("arrival").alias("company"), F.lit("created").alias("decision"), F.lit(None).cast("string").alias("matched_on")))
    done = False
    for _ in range(most_rounds):
        known = settled(facts(events, stored, guess))
        now = settled(next_guess(events, known, width))
        g, n = guess.alias("g"), now.alias("n")
        done = g.join(n, F.col("g.arrival") == F.col("n.arrival")).where(~F.col("g.company").eqNullSafe(F.col("n.company")) | (F.col("g.decision") != F.col("n.decision")) | ~F.col("g.matched_on").eqNullSafe(F.col("n.matched_on"))).isEmpty()
        guess = now
        if done:
            break
    return candidates(events, known, guess), changed(known, stored), done


def candidates(events: DataFrame, known: DataFrame, guess: DataFrame) -> DataFrame:
    """Outcomes with the companies that an event may be of."""
    several = guess.where("decision = 'ambiguous'").join(events, "arrival")
    by_domain = several.where("matched_on = 'domain'").join(known, F.col("domain") == F.col("own_domain")).where((F.col("domain_at") < F.col("arrival")) & (F.col("cnpj").isNull() | F.col("cnpj_at").isNull() | (F.col("cnpj_at") >= F.col("arrival"))))
    k = known.select(F.col("company").alias("k_company"), F.col("name").alias("k_name"))
    by_name = several.where("matched_on = 'name'").join(k, (F.col("name") == F.col("k_name")) & (F.col("k_company") < F.col("arrival")))
    may = by_domain.select("arrival", known["company"].alias("may")).unionByName(by_name.select("arrival", F.col("k_company").alias("may")))
    lists = may.groupBy("arrival").agg(F.array_sort(F.collect_list("may")).alias("_may"))
    one = F.when((F.col("decision") == "resolved"), F.array("company")).otherwise(F.coalesce("_may", F.array().cast("array<long>")))
    return guess.join(lists, "arrival", "left").select("arrival", "company", "decision", "matched_on", one.alias("candidate_ids"))


def changed(known: DataFrame, stored: DataFrame) -> DataFrame:
    """Companies that are new or have learnt something."""
    now = known.select("company", F.col("own_cnpj").alias("cnpj"), F.col("own_domain").alias("domain"), "name")
    s = stored.select(F.col("company").alias("_company"), F.col("cnpj").alias("_cnpj"), F.col("domain").alias("_domain"))
    both = now.join(s, F.col("company") == F.col("_company"), "left")
    same = F.col("_company").isNotNull() & F.col("cnpj").eqNullSafe(F.col("_cnpj")) & F.col("domain").eqNullSafe(F.col("_domain"))
    return both.where(~same).select("company", "cnpj", "domain", "name")
