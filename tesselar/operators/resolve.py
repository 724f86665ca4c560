"""Who an event belongs to: persons by their identities in order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions import keys as K
from tesselar.operators.settle import settled


def identity_keys(events: DataFrame) -> DataFrame:
    """events (source, arrival, type, value) to distinct (arrival, key, strong); the key of a weak identity holds its source. Invalid ones go."""
    i = F.col("identity")
    key = F.when(i.strong, i.hash).otherwise(F.concat_ws("|", F.coalesce("source", F.lit("")), i.hash))
    rows = events.withColumn("identity", K.identity(F.col("type"), F.col("value"))).where("identity IS NOT NULL")
    return rows.select("arrival", key.alias("key"), i.strong.alias("strong")).distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """(arrival, root) of (arrival, up): every round doubles the distance that a pointer spans."""
    now = settled(parents)
    while True:
        far = now.select(F.col("arrival").alias("up"), F.col("up").alias("further"))
        step = settled(now.join(far, "up").select("arrival", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")))
        now = step.select("arrival", "up")
        if step.where("moved").isEmpty():
            return now.withColumnRenamed("up", "root")


def touched_owners(owners: DataFrame, ids: DataFrame) -> DataFrame:
    """Of the stored owners (key, first, person) those of keys that ``ids`` show."""
    return owners.join(ids.select("key").distinct(), "key", "left_semi").select("key", "first", "person")


def outcomes(ids: DataFrame, owners: DataFrame | None = None, once: DataFrame | None = None, most_rounds: int = 50) -> DataFrame:
    """(arrival, person, conflict, repeated) for each event of ``ids`` (arrival, key, strong, and perhaps links) or ``once``.

    What one event after the other would give: an identity belongs to the first event without conflict that shows it; an event
    belongs to the owner of a strong identity, else to the earliest owner of a weak one, else it makes a person; strong identities of
    two owners are a conflict, which attaches nothing and has no person. An event with a key that ``links`` (that of a run whose
    person is known) adds its identities to that person, so that there any identity of another owner is a conflict.

    owners: key, first, person: identities that earlier batches gave away; first is the arrival that did, before all of ``ids``. Only those
    of keys in ``ids`` are read. once: arrival, once, and null arrivals for stored ones: an event fails as ``repeated`` whose ``once`` an earlier event that did not fail has.

    An owner never changes, so an event depends on
    the first sightings of its identities alone. These are found for all events at once by grouping, owners by pointer
    doubling, and failures by repeating both until they stay: an event's outcome rests on earlier events only, so
    there is one such state. Rounds follow the depth of conflicts on conflicts, not the number of events, and only see the first event of each
    set of identities; see ``_heads``.
    """
    ids = ids if "links" in ids.columns else ids.withColumn("links", F.lit(False))
    once = settled(once) if once is not None else None
    heads = settled(_heads(ids, once))
    ids = settled(heads.where("arrival = head").select("arrival", F.inline("keys")))
    found = _outcomes_of_heads(ids, owners, None if once is None else _contested(once), most_rounds)
    told = heads.select("arrival", "head").join(found.withColumnRenamed("arrival", "head"), "head").drop("head")
    if once is None:
        return told
    # those without an identity, of which only contested ones can fail
    none = once.where("arrival IS NOT NULL").select("arrival").distinct().join(heads.select("arrival"), "arrival", "left_anti")
    alone = none.join(found, "arrival", "left").select("arrival", "person", F.coalesce("conflict", F.lit(False)).alias("conflict"), F.coalesce("repeated", F.lit(False)).alias("repeated"))
    return told.unionByName(alone)


def _contested(once: DataFrame) -> DataFrame:
    """Claims of values that several rows have; no other one can fail as repeated."""
    several = once.groupBy("once").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("once")
    return once.join(several, "once", "left_semi")


def _heads(ids: DataFrame, once: DataFrame | None) -> DataFrame:
    """(arrival, keys, head): of each event its set of keys, and the event whose outcome it has, which is the first one of its set.

    After an event that does not fail all its identities have an owner, its strong ones the same; an event in conflict shows two owners, who stay. So
    an event with the same identities has the same outcome, and gives nothing away. Events that may fail as repeated are their own heads, as a failure
    leaves the next one of its set as if it were the first, and those that link and show weak identities, as the first makes the run's link that the next one is bound to."""
    sets = ids.groupBy("arrival").agg(F.sort_array(F.collect_set(F.struct("key", "strong", "links"))).alias("keys"))
    own = F.exists("keys", lambda k: k["links"]) & F.exists("keys", lambda k: ~k["strong"])
    if once is not None:
        contested = _contested(once).where("arrival IS NOT NULL").select("arrival", F.lit(True).alias("_contested")).distinct()
        sets, own = sets.join(contested, "arrival", "left"), own | F.coalesce("_contested", F.lit(False))
    sets = sets.select("arrival", "keys", F.when(own, F.col("arrival")).alias("own"))
    first = sets.groupBy("keys", "own").agg(F.min("arrival").alias("head"))
    s, f = sets.alias("s"), first.alias("f")
    return s.join(f, (F.col("s.keys") == F.col("f.keys")) & F.col("s.own").eqNullSafe(F.col("f.own"))).select("s.arrival", "s.keys", "f.head")


def _outcomes_of_heads(ids: DataFrame, owners: DataFrame | None, once: DataFrame | None, most_rounds: int) -> DataFrame:
    """The rounds of ``outcomes`` over settled ids, for all their events and those of ``once``."""
    old = settled(touched_owners(owners, ids)) if owners is not None else None
    once = settled(once) if once is not None else None
    events = ids.select("arrival").distinct()
    failed = events.where("false").withColumn("conflict", F.lit(True))
    for _ in range(most_rounds):
        first = ids.join(failed, "arrival", "left_anti").select("key", "arrival")
        if old is not None:
            first = first.unionByName(old.select("key", F.col("first").alias("arrival")))
        first = first.groupBy("key").agg(F.min("arrival").alias("first"))
        earlier = settled(ids.join(first, "key").where("first < arrival").select("arrival", "first", "strong", "links"))
        up = earlier.groupBy("arrival").agg(F.min(F.struct((~F.col("links")).alias("other"), (~F.col("strong")).alias("weak"), "first"))["first"].alias("up"))
        parents = events.join(up, "arrival", "left").select("arrival", F.coalesce("up", "arrival").alias("up"))
        if old is not None:
            parents = parents.unionByName(old.select(F.explode(F.array("first", "person")).alias("arrival"), F.col("person").alias("up")).distinct())
        roots = _roots(parents)
        linking = earlier.where("links").select("arrival").distinct().withColumn("linking", F.lit(True))
        owned = earlier.join(linking, "arrival", "left").where("strong OR linking").join(roots.select(F.col("arrival").alias("first"), "root"), "first")
        found = owned.groupBy("arrival").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("arrival", F.lit(True).alias("conflict"))
        if once is not None:
            # only events without conflict claim a value; a stored one has no arrival and comes first
            claims = once.join(failed.unionByName(found).distinct(), "arrival", "left_anti").groupBy("once").agg(F.min(F.struct("arrival")).alias("claim"))
            late = once.where("arrival IS NOT NULL").join(claims, "once").where("claim.arrival IS NULL OR claim.arrival < arrival").select("arrival").distinct()
            found = found.unionByName(late.join(found, "arrival", "left_anti").withColumn("conflict", F.lit(False)))
        found = settled(found)
        same = found.exceptAll(failed).isEmpty() and failed.exceptAll(found).isEmpty()
        failed = found
        if same:
            known = events.withColumn("known", F.lit(True))
            rows = events if once is None else events.unionByName(once.where("arrival IS NOT NULL").select("arrival")).distinct()
            marked = rows.join(known, "arrival", "left").join(roots, "arrival", "left").join(failed, "arrival", "left")
            person = F.when(F.col("known") & F.col("conflict").isNull(), F.col("root"))
            return marked.select("arrival", person.alias("person"), F.coalesce("conflict", F.lit(False)).alias("conflict"), F.coalesce(~F.col("conflict"), F.lit(False)).alias("repeated"))
    raise RuntimeError(f"conflicts did not settle in {most_rounds} rounds")


def attached(ids: DataFrame, found: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(key, first, person): identities that events of these ``outcomes`` give to their person, those with an owner left out. Appended to
    ``owners`` they make the state that the next batch starts from."""
    shown = ids.select("arrival", "key").distinct().join(found.where("person IS NOT NULL").select("arrival", "person"), "arrival")
    new = shown.groupBy("key").agg(F.min("arrival").alias("first"), F.min_by("person", "arrival").alias("person"))
    return new if owners is None else new.join(touched_owners(owners, ids), "key", "left_anti")


def persons(events: DataFrame, owners: DataFrame | None = None, most_rounds: int = 50) -> DataFrame:
    """(arrival, person, conflict) for each event with a valid identity; events: source, arrival, type, value. A person is named by the event that created it.
    With ``owners`` it goes on from what earlier batches attached. See ``outcomes``."""
    return outcomes(identity_keys(events), owners, most_rounds=most_rounds).select("arrival", "person", "conflict")
