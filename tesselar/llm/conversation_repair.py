"""Conversation structure repair: the cheapest edits that give a conversation turns in a legal order.

A conversation's rows are read by turn. A row is blank (only white space), a duplicate (its role and text were seen before in the
conversation), or truncated (no sentence end), whichever holds first. Edits: Keep (K, 0), Rerole to user or assistant (R, 3), Delete
(D, 4; the only one for blank and duplicate rows), Insert an empty turn of user or assistant (I, 3); a truncated row that is not deleted
adds 3. The roles' initials that result must match ``(s?(ua)+)?``. Of equally cheap edits those whose initials are least in ASCII count.

Method: Dijkstra on the implicit lattice of (turn index, grammar state); a node's key is (cost, audit), an edge adds its cost
and its letter, and the search stops at the first accepting end node that it takes from the heap. The state says which role an
insertion or a new role has, so the audit alone names the edits.

Scale. Equal rows of a turn are one counted row after a map-side sum, and first sightings are sums too, so that neither many repeats
nor a conversation that holds a third of all rows meet in one task there. Rows are sorted by ranges of (conversation, turn) and
become one code a turn. A conversation that two ranges share, or of more than BLOCK turns, is searched in blocks, from each state
to each state, where the rows are; the blocks' (cost, audit) tables are then folded in pairs, which gives the same least audit: paths
between the same nodes that cost the same can't be prefixes of one another. What a task holds of a conversation is a few bytes a turn.
The texts of a repaired conversation stream past its audit in one task, as its hash is defined over them in order.

Defined results: null role or text counts as one space (so a null text is blank); rows of a null conv_id are one conversation; null turns
come first; rows of equal turn go by role and text (the first 64 characters, then the hash of all); an empty role has no legal
initial; a conversation without rows gives zeros, an empty audit and the hash of nothing; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import shared_checkpoint, table

#: White space that does not count as text.
SPACE = " \t\n\x0b\x0c\r"
#: Turns that one search covers; longer conversations are cut into as many.
BLOCK = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Of each state the role that may be inserted or given, as the state that it leads to.
GIVES = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTING = (START, ASSISTANT)
#: A turn's code is 4 * kind + initial as a letter from "A": kinds are sound, to be deleted, truncated; initials s, u, a and others.
SOUND, GONE, CUT = range(3)
LEGAL = {"su", "ua", "au"}
#: (cost, audit) of the cheapest way from each state to each state.
Table = list[list[tuple[int, str] | None]]


def keeps(state: int, initial: int) -> int | None:
    """The state after a kept turn, or none if its role can't follow."""
    if initial == 0:
        return SYSTEM if state == START else None
    return initial + 1 if initial < 3 and GIVES[state] == initial + 1 else None


def search(codes: str, entry: int, closing: bool) -> dict[int, tuple[int, str]]:
    """Dijkstra from (0, entry). With ``closing`` turns may also be inserted behind the last row, and the search stops at the first
    accepting end node; else it gives the cheapest way to each state right behind the last row."""
    n, found, done = len(codes), {}, set()
    heap = [(0, "", 0, entry)]
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if not closing:
                found[state] = cost, audit
                continue
            if state in ACCEPTING:
                return {state: (cost, audit)}
        given = GIVES[state]
        heappush(heap, (cost + INSERT, audit + "I", i, given))
        if i < n:
            kind, initial = divmod(ord(codes[i]) - 65, 4)
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if kind != GONE:
                more = TRUNCATED if kind == CUT else 0
                heappush(heap, (cost + REROLE + more, audit + "R", i + 1, given))
                kept = keeps(state, initial)
                if kept is not None:
                    heappush(heap, (cost + more, audit + "K", i + 1, kept))
    return found


@lru_cache(maxsize=20_000)
def whole(codes: str) -> tuple[int, str]:
    return next(iter(search(codes, START, True).values()))


@lru_cache(maxsize=5_000)
def block(codes: str) -> Table:
    ways = [search(codes, x, False) for x in range(4)]
    return [[w.get(y) for y in range(4)] for w in ways]


def joined(left: Table, right: Table) -> Table:
    """The cheapest ways over two neighbouring blocks."""

    def best(x: int, z: int) -> tuple[int, str] | None:
        ways = [(a[0] + b[0], a[1], b[1]) for y in range(4) if (a := left[x][y]) and (b := right[y][z])]
        least = min((c for c, _, _ in ways), default=None)
        return min(((c, p + q) for c, p, q in ways if c == least), default=None)

    return [[best(x, z) for z in range(4)] for x in range(4)]


def folded(tables: list[Table]) -> tuple[int, str]:
    """Blocks in order, from the start to the cheapest accepting end."""
    while len(tables) > 1:
        tables = [reduce(joined, tables[i : i + 2]) for i in range(0, len(tables), 2)]
    ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
    return min((w[0] + INSERT * len(ends[y]), w[1] + ends[y]) for y, w in enumerate(tables[0][START]) if w)


def illegal_pairs(codes: str) -> int:
    initials = "".join("suax"[(ord(c) - 65) % 4] for c in codes)
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def _order(*first: str) -> list[Column]:
    return [*[F.col(c).asc_nulls_first() for c in first], F.col("turn").asc_nulls_first(), F.col("role"), F.col("begins"), F.col("digest")]


def _rows(rows: DataFrame) -> DataFrame:
    """Conversation rows without nulls in role and text, and what orders rows of a turn."""
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return plain.withColumn("begins", F.substring("text", 1, 64)).withColumn("digest", F.sha2("text", 256))


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, begins, digest, blank, duplicate, truncated, codes): a row for equal rows of a turn, with the counts of
    their faults and a code for each."""
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    marked = _rows(rows).withColumn("is_blank", said == "").withColumn("is_cut", ~F.substring(said, -1, 1).isin(".", "!", "?"))
    equal = marked.groupBy("conv_id", "turn", "role", "begins", "digest", "is_blank", "is_cut").agg(F.count(F.lit(1)).alias("n"))
    firsts = equal.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), F.col("first.turn").alias("first"))
    both = equal.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest")))
    new = F.when(~F.col("is_blank") & F.col("turn").eqNullSafe(F.col("first")), 1).otherwise(0)
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    letter = lambda kind: F.char(65 + 4 * kind + initial)
    first_code = F.when(new == 1, letter(F.when(F.col("is_cut"), CUT).otherwise(SOUND))).otherwise("")
    return both.select(
        "conv_id", "turn", "role", "begins", "digest",
        F.when(F.col("is_blank"), F.col("n")).otherwise(0).alias("blank"),
        F.when(F.col("is_blank"), 0).otherwise(F.col("n") - new).alias("duplicate"),
        F.when(F.col("is_cut") & (new == 1), 1).otherwise(0).alias("truncated"),
        F.concat(first_code, F.repeat(letter(F.lit(GONE)), (F.col("n") - new).cast("int"))).alias("codes"),
    )


def _blocks(most: int):
    """Codes of consecutive rows of a conversation, in blocks; of conversations that may go on in another task, or have several
    blocks, also their tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, kind = TaskContext.get().partitionId(), None
        out: list[tuple] = []

        def emitted(conv: object, codes: str, place: int, alone: bool) -> None:
            t = None if alone else block(codes)
            flat = [] if t is None else [w for row in t for w in row]
            out.append((conv, part << 32 | place, codes, [None if w is None else w[0] for w in flat], [None if w is None else w[1] for w in flat]))

        def batch_of() -> pa.RecordBatch:
            conv, place, codes, costs, audits = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(place, pa.int64()), pa.array(codes, pa.string()), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], ["conv_id", "place", "codes", "costs", "audits"])

        held: list[str] = []
        length, place, now, first = 0, 0, None, True
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, codes in zip(batch.column("conv_id").to_pylist(), batch.column("codes").to_pylist()):
                if held and conv != now:
                    emitted(now, "".join(held), place, not first and place == 0)
                    held, length, place, first = [], 0, 0, False
                now = conv
                held.append(codes)
                length += len(codes)
                while length > most:
                    text = "".join(held)
                    emitted(now, text[:most], place, False)
                    place, held, length = place + 1, [text[most:]], length - most
                if len(out) >= 2_000:
                    yield batch_of()
        if held:
            emitted(now, "".join(held), place, False)
        if out:
            yield batch_of()

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, illegal, cost, audit) of each conversation, whose blocks come in order."""

    def solve(blocks: list[tuple[str, list, list]]) -> tuple[int, int, str]:
        text = "".join(b[0] for b in blocks)
        if len(blocks) == 1:
            return illegal_pairs(text), *whole(text)
        tables = [[[None if c[4 * x + y] is None else (c[4 * x + y], a[4 * x + y]) for y in range(4)] for x in range(4)] for _, c, a in blocks]
        return illegal_pairs(text), *folded(tables)

    held: list[tuple[str, list, list]] = []
    now, kind = None, None
    out: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        conv, illegal, cost, audit = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["conv_id", "illegal", "cost", "audit"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, codes, costs, audits in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "codes", "costs", "audits")]):
            if held and conv != now:
                out.append((now, *solve(held)))
                held = []
                if len(out) >= 2_000:
                    yield batch_of()
            now = conv
            held.append((codes, costs, audits))
    if held:
        out.append((now, *solve(held)))
    if out:
        yield batch_of()


def edits(turns: DataFrame, most: int = BLOCK) -> DataFrame:
    """(conv_id, illegal, cost, audit) of each conversation of ``judged`` rows."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    ranges = turns.select("conv_id", "turn", "role", "begins", "digest", "codes").repartitionByRange(*_order("conv_id")).sortWithinPartitions(*_order("conv_id"))
    blocks = ranges.select("conv_id", "codes").mapInArrow(_blocks(most), f"conv_id {kind}, place long, codes string, costs array<long>, audits array<string>")
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_solved, f"conv_id {kind}, illegal long, cost long, audit string")


def applied(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired turns: a role and a text for each letter but D. Takes the rows as it needs them."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = keeps(state, "sua".find(role[:1]) if role else 3)
        else:
            state = GIVES[state]
            role = ROLES[state]
        yield role, text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.DataType, str, Iterator[tuple[str, str]]]]:
    """Streams (conv_id, audit, rows) from rows that come after their conversation's audit."""
    rows = ((conv, audit, role, text, b.schema.field("conv_id").type) for b in batches for conv, audit, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")]))
    ahead = next(rows, None)

    def own() -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while ahead is not None and ahead[1] is None:
            row, ahead = ahead, next(rows, None)
            yield row[2], row[3]

    while ahead is not None:
        conv, audit, _, _, kind = ahead
        ahead = next(rows, None)
        texts = own()
        yield conv, kind, audit, texts
        for _ in texts:
            pass


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, kind, audit, rows in _conversations(batches):
        digest, n = hashlib.sha256(), 0
        for role, text in applied(audit, rows):
            digest.update(b"\n" * bool(n) + f"{role}:{text}".encode())
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, kind, audit, rows in _conversations(batches):
        turns = enumerate(applied(audit, rows))
        while some := [x for _, x in zip(range(1_000), turns)]:
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(some), kind), pa.array([i for i, _ in some], pa.int64()), pa.array([r for _, (r, _) in some]), pa.array([t for _, (_, t) in some])], ["conv_id", "turn", "role", "text"])


def _streamed(rows: DataFrame, solved: DataFrame, run, schema: str) -> DataFrame:
    """Each conversation's audit, then its rows in order, past ``run``."""
    texts = _rows(rows).withColumn("audit", F.lit(None).cast("string"))
    nothing = {c: F.lit(None).cast(texts.schema[c].dataType) for c in ("turn", "role", "text", "begins", "digest")}
    first = solved.select("conv_id", "audit").withColumns(nothing)
    both = first.unionByName(texts).withColumn("is_row", F.col("audit").isNull())
    ordered = both.repartition("conv_id").sortWithinPartitions(*_order("conv_id", "is_row"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(run, f"conv_id {kind}, {schema}")


def repaired_turns(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, text): the repaired conversations, turns counted from 0."""
    return _streamed(rows, edits(judged(rows), most), _written, "turn long, role string, text string")


def repair(rows: DataFrame, conversations: DataFrame | None = None, most: int = BLOCK) -> DataFrame:
    """A row for each conversation (of ``conversations``, if these are given): gaps in its turns, counts of faults and of neighbours
    whose initials may not follow one another, the cost and initials of the cheapest edits, and the repaired turns' hash."""
    turns = shared_checkpoint(judged(rows))
    solved = shared_checkpoint(edits(turns, most))
    faults = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("width"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    distinct = turns.where(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.count("one").alias("turns"))
    hashes = _streamed(rows, solved, _hashed, "repaired_sha256 string")
    out = (conversations if conversations is not None else rows).select("conv_id").distinct()
    for more in (faults, distinct, solved, hashes):
        more = more.withColumnRenamed("conv_id", "own_conv")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("own_conv")), "left").drop("own_conv")
    out = out.fillna(0, ["width", "turns", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
    return out.withColumn("gaps", (F.col("width") - F.col("turns")).cast("long")).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """Faults planted by a hash of conversation and turn: of twenty remainders 0 drops a row, 1 empties its text, 2 takes its sentence ends,
    3 repeats it, 4 makes it the user's."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rest = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    plain = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]).withColumn("rest", rest).where("rest <> 0")
    changed = plain.withColumn("text", F.when(F.col("rest") == 1, "").when(F.col("rest") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    changed = changed.withColumn("role", F.when(F.col("rest") == 4, "user").otherwise(F.col("role")))
    return changed.withColumn("copy", F.explode(F.when(F.col("rest") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("rest", "copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)


#: A turn at a time for all conversations: the cheapest (cost, audit) of each of the four states as one text, the cost in nine digits.
SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), summed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS rest FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN rest = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN rest = 1 THEN '' WHEN rest = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN rest = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM summed WHERE rest <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    rtrim(text, E' \t\n\x0b\x0c\r') AS said FROM damaged
), faults AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before FROM numbered
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM faults
  UNION ALL
  SELECT conv_id, i, s0d AS s0, least(s1d, CASE WHEN keep AND initial = 's' THEN lpad((left(s0, 9)::INT + more)::VARCHAR, 9, '0') || substr(s0, 10) || 'K' END) AS s1,
    least(s2d, CASE WHEN keep AND initial = 'u' THEN lpad((left(tou, 9)::INT + more)::VARCHAR, 9, '0') || substr(tou, 10) || 'K' END,
      CASE WHEN keep THEN lpad((left(tou, 9)::INT + more + 3)::VARCHAR, 9, '0') || substr(tou, 10) || 'R' END) AS s2,
    least(s3d, CASE WHEN keep AND initial = 'a' THEN lpad((left(t2, 9)::INT + more)::VARCHAR, 9, '0') || substr(t2, 10) || 'K' END,
      CASE WHEN keep THEN lpad((left(t2, 9)::INT + more + 3)::VARCHAR, 9, '0') || substr(t2, 10) || 'R' END) AS s3
  FROM (
    SELECT *, least(s0, s1, t3) AS tou, lpad((left(s0, 9)::INT + 4)::VARCHAR, 9, '0') || substr(s0, 10) || 'D' AS s0d,
      lpad((left(s1, 9)::INT + 4)::VARCHAR, 9, '0') || substr(s1, 10) || 'D' AS s1d,
      lpad((left(t2, 9)::INT + 4)::VARCHAR, 9, '0') || substr(t2, 10) || 'D' AS s2d, lpad((left(t3, 9)::INT + 4)::VARCHAR, 9, '0') || substr(t3, 10) || 'D' AS s3d
    FROM (
      SELECT *, least(s3, lpad((left(t2, 9)::INT + 3)::VARCHAR, 9, '0') || substr(t2, 10) || 'I') AS t3 FROM (
        SELECT f.conv_id, f.i, f.initial, f.fault NOT IN ('blank', 'duplicate') AS keep, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS more, s0, s1, s3,
          least(s2, lpad((left(least(s0, s1, s3), 9)::INT + 3)::VARCHAR, 9, '0') || substr(least(s0, s1, s3), 10) || 'I') AS t2
        FROM walk JOIN faults f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.i = walk.i + 1
      )
    )
  )
), ends AS (
  SELECT conv_id, least(s0, s3, lpad((left(s2, 9)::INT + 3)::VARCHAR, 9, '0') || substr(s2, 10) || 'I', lpad((left(s1, 9)::INT + 6)::VARCHAR, 9, '0') || substr(s1, 10) || 'II') AS best
  FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id)
), letters AS (
  SELECT conv_id, j, substr(best, 9 + j, 1) AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS j FROM ends)
), placed AS (
  SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS at FROM letters
), kept AS (
  SELECT p.conv_id, p.j, p.letter, CASE WHEN p.letter <> 'I' THEN f.role END AS role, CASE WHEN p.letter = 'I' THEN '' ELSE f.text END AS text,
    row_number() OVER (PARTITION BY p.conv_id ORDER BY p.j) AS m
  FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.at WHERE p.letter <> 'D'
), shifted AS (
  SELECT *, max(CASE WHEN m = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has_system FROM kept
), hashes AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS sha
  FROM shifted GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost,
  coalesce(substr(best, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""
