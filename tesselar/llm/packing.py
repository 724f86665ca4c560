"""Best-fit packing: bin completion over the histogram of piece lengths.

Method. Texts are tokenised in tasks; longer ones are cut into full sequences and one remainder. Only the
number of remainders of each length, at most ``capacity`` - 1 numbers, reaches the driver. There bin
completion fills sequence after sequence: around the largest length left it enumerates fillings, prunes those that must waste more than
the best one so far, and takes an undominated one. The best-fit descent is the incumbent; further descents take first the
lengths that met with waste (sequential value correction), until a lower bound is reached or none is better.
A filling is applied as often as the numbers of its lengths permit, so the plan has at most
a few rows for each length at any corpus size. Spark ranks the pieces of a length (ranks are
counted by salted groups, so one frequent length is ranked by many tasks) and a piece finds its sequence
by its rank among the plan's ranges.

Defined results: null and empty texts are the separator alone; rows that repeat a doc_id are packed each by
itself; a null doc_id is packed as any; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import sys
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesselar.llm.common import fresh, shared_checkpoint, slices, table

CAPACITY = 2048
SEPARATOR = 0
#: Branches looked at for one sequence, descents tried for one sequence less, and descents in all; see ``plan_bins`` for how to lift them.
NODES, PATIENCE, DESCENTS = 300, 6, 16
#: Weight of the waste that pieces met with in the order of the next descent.
CORRECTION = 3.0
SALT_ROWS = 100_000
#: Longer runs without a space are left to the tokenizers library, which merges them in less than quadratic time to the same ids.
LONG_PIECE = 2_000

_ENCODERS: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(vocabulary: str):
    """ids of a text as ``Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False)`` gives them. Texts without special
    strings are read by the tiktoken library, from a file of ranks beside the vocabulary: equal ids in a fifth of the time."""
    if vocabulary not in _ENCODERS:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(vocabulary)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        try:
            import public_tokenizers
            import tiktoken

            with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, FileNotFoundError):
            fast = None

        def ids(text: str) -> np.ndarray:
            # tiktoken merges a long run without spaces in quadratic time
            runs = len(text) > LONG_PIECE and max(map(len, text.split()), default=len(text)) > LONG_PIECE
            if fast is None or runs or any(x in text for x in special):
                return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array(fast.encode_ordinary(text), np.uint32)

        _ENCODERS[vocabulary] = ids
    return _ENCODERS[vocabulary]


def _pieces(vocabulary: str, capacity: int, separator: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                rows, kept = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(ids_of(text or ""), np.uint32(separator)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append((i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                        if keep_ids:
                            kept.append(ids[a:b].astype(np.int32))
                i, n, a, size, crc = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 5
                columns = [part.column("doc_id").take(pa.array(i)), pa.array(n.astype(np.int32)), pa.array(a), pa.array(size), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of the token ids of every text with its separator."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity, separator, keep_ids), schema)


# ---- the plan

def fillings(lengths: list[int], counts: dict[int, int], room: int, allowed: int, width: int, nodes: int = 4_000) -> list[tuple[int, list[int]]]:
    """Undominated fillings of ``room``, as (waste, lengths descending), least waste first.

    Largest lengths first, so the first filling reached is the best-fit one, which is never dominated, and is the incumbent. A filling is
    dominated if a piece that it leaves out fits its waste, or fits in place of a shorter piece of it.
    Branches that cannot waste less than the worst kept, or than ``allowed``, are cut.
    """
    found: list[tuple[int, list[int]]] = []
    left = nodes
    usable = [x for x in lengths if x <= room and counts[x]]
    if not usable:
        return [(room, [])]
    smallest, rising = usable[-1], usable[::-1]
    # what all pieces not longer than usable[i] hold together
    held = [0] * (len(usable) + 1)
    for i in range(len(usable) - 1, -1, -1):
        held[i] = held[i + 1] + usable[i] * counts[usable[i]]

    def dominated(waste: int, used: list[int]) -> bool:
        times = Counter(used)
        for y in (0, *times):
            for z in rising[bisect_right(rising, y) : bisect_right(rising, y + waste)]:
                if counts[z] > times[z]:
                    return True
        return False

    def bound() -> int:
        return min(allowed, found[-1][0] - 1) if len(found) >= width else allowed

    def search(i: int, room: int, used: list[int]) -> bool:
        """Whether the search may go on."""
        nonlocal left
        left -= 1
        while i < len(usable) and usable[i] > room:
            i += 1
        if i == len(usable) or room < smallest:
            if not found or (room <= bound() and not dominated(room, used)):
                found.append((room, used))
                found.sort(key=lambda f: f[0])
                del found[width:]
            return not (found[0][0] == 0 and len(found) >= width) and left > 0
        if found and room - held[i] > bound():
            return left > 0
        x = usable[i]
        most = min(counts[x], room // x)
        for n in range(most, -1, -1):
            # what is left when a piece that fits stays out must be filled up by shorter ones to less than its length
            if n < most and room - n * x - held[i + 1] >= x:
                break
            if not search(i + 1, room - n * x, used + [x] * n):
                return False
        return left > 0

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
    search(0, room, [])
    return found


def best_filling(order: list[int], counts: dict[int, int], room: int, nodes: int | None = NODES) -> list[int]:
    """The filling of ``room`` with the least waste, lengths tried in ``order``, the first of equals. Branches that can't waste less than the
    incumbent are cut. After ``nodes`` branches the incumbent counts (None: there is no such end), once it is undominated."""
    usable = [x for x in order if x <= room and counts[x]]
    m = len(usable)
    best, chosen, left = room + 1, [], nodes if nodes is not None else math.inf
    # what the lengths from i on hold together, and the least of them
    held, least = [0] * (m + 1), [room + 1] * (m + 1)
    for i in range(m - 1, -1, -1):
        held[i] = held[i + 1] + usable[i] * counts[usable[i]]
        least[i] = min(least[i + 1], usable[i])

    def search(i: int, room: int, used: list[int]) -> bool:
        """Whether the search may go on."""
        nonlocal best, chosen, left
        left -= 1
        while i < m and usable[i] > room:
            i += 1
        if i == m or room < least[i]:
            if room < best:
                best, chosen = room, used
            return best > 0 and left > 0
        if room - held[i] >= best:
            return left > 0
        x = usable[i]
        for n in range(min(counts[x], room // x), -1, -1):
            if not search(i + 1, room - n * x, used + [x] * n):
                return False
        return left > 0

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
    search(0, room, [])
    return undominated(chosen, counts, room)


def undominated(used: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The filling, with pieces that it leaves out put in, or in place of a shorter one, as long as one fits."""
    times, waste = Counter(used), room - sum(used)
    rising = sorted(x for x, n in counts.items() if n)
    while waste:
        moves = []
        for y in (0, *(y for y, n in times.items() if n)):
            i = bisect_right(rising, y + waste) - 1
            while i >= 0 and rising[i] > y and counts[rising[i]] <= times[rising[i]]:
                i -= 1
            if i >= 0 and rising[i] > y:
                moves.append((rising[i] - y, y, rising[i]))
        if not moves:
            break
        gain, y, z = max(moves)
        times[z] += 1
        times[y] -= 1
        waste -= gain
    return [x for x, n in sorted(times.items(), reverse=True) if x for _ in range(n)]


def descent(histogram: dict[int, int], order: list[int], capacity: int, nodes: int | None = NODES) -> list[tuple[int, list[int]]]:
    """One descent of the completion tree by best fillings, around the first length of ``order`` that is left. A filling is taken as often
    as the numbers of its lengths permit."""
    counts, plan = dict(histogram), []
    for x in order:
        while counts[x]:
            counts[x] -= 1
            rest = best_filling(order, counts, capacity - x, nodes)
            counts[x] += 1
            need = Counter([x, *rest])
            times = min(counts[y] // n for y, n in need.items())
            for y, n in need.items():
                counts[y] -= n * times
            plan.append((times, [x, *rest]))
    return plan


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: the largest sum of a dual feasible function over all pieces. Such a function gives the pieces of any sequence
    at most 1 together: a piece's share of the capacity; with pieces below a threshold counted as nothing and those that leave less
    than it as 1; or the share rounded to k-ths as floor((k + 1) * share) / k, a whole (k + 1)-th being kept."""
    best = -(-sum(x * n for x, n in histogram.items()) // capacity)
    for k in range(1, 21):
        # in units of 1 / (k * capacity)
        total = sum(n * (k * x if (k + 1) * x % capacity == 0 else (k + 1) * x // capacity * capacity) for x, n in histogram.items())
        best = max(best, -(-total // (k * capacity)))
    for least in sorted(x for x in histogram if 2 * x <= capacity):
        total = sum(n * (capacity if x > capacity - least else x) for x, n in histogram.items() if x >= least)
        best = max(best, -(-total // capacity))
    return best


def optimal_bins(histogram: dict[int, int], capacity: int, incumbent: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Bin completion without any limit: all undominated fillings around the largest piece left, best fit first, each followed by the
    completion of what is left; cut where that can't need fewer sequences than the incumbent. Exponential in the worst case."""
    best = [incumbent, sum(t for t, _ in incumbent)]
    lengths, least = sorted(histogram, reverse=True), lower_bound(histogram, capacity)

    def complete(counts: dict[int, int], done: list[list[int]]) -> None:
        x = next((y for y in lengths if counts[y]), None)
        if x is None:
            best[:] = [(1, p) for p in done], len(done)
            return
        counts[x] -= 1
        options = fillings(lengths, counts, capacity - x, capacity, width=1 << 60, nodes=1 << 60)
        for _, rest in options:
            left = Counter(counts)
            left.subtract(rest)
            if len(done) + 1 + lower_bound({y: n for y, n in left.items() if n}, capacity) < best[1]:
                complete(left, [*done, [x, *rest]])
            if best[1] == least:
                break
        counts[x] += 1

    if best[1] > least:
        complete(dict(histogram), [])
    return best[0]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, patience: int | None = PATIENCE, nodes: int | None = NODES) -> list[tuple[int, list[int]]]:
    """(times, lengths) of sequences that hold all pieces of the histogram, in few sequences.

    The first descent takes the largest length first, so it is the best-fit one, and the incumbent. While the incumbent needs more sequences
    than ``lower_bound``, further descents take first the lengths that the ones before left to wasteful sequences: a length's value is itself and
    the waste that its pieces met with so far, and the order is by value. So pieces that are awkward at the end, like those of just over a third of the
    capacity, meet the others while these are there. After ``patience`` descents without a better one, or DESCENTS in all, the incumbent stays. With None
    for patience the exact search follows, which has no such end, and with None for nodes no filling's search ends early.
    """
    histogram = {int(x): int(n) for x, n in histogram.items() if n}
    least, idle = lower_bound(histogram, capacity), PATIENCE if patience is None else patience
    value, best, fewest, since = {x: float(x) for x in histogram}, [], sum(histogram.values()) + 1, 0
    for _ in range(DESCENTS):
        if fewest <= least or since > idle:
            break
        plan = descent(histogram, sorted(value, key=lambda x: (-value[x], -x)), capacity, nodes)
        bins = sum(t for t, _ in plan)
        since += 1
        if bins < fewest:
            best, fewest, since = plan, bins, 0
        lost: dict[int, float] = dict.fromkeys(histogram, 0.0)
        for times, pattern in plan:
            waste = times * (capacity - sum(pattern)) / len(pattern)
            for x in pattern:
                lost[x] += waste
        for x, n in histogram.items():
            value[x] += CORRECTION * lost[x] / n
    return best if patience is not None else optimal_bins(histogram, capacity, best)


def plan_ranges(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """The plan as ranges: pieces of a length with ranks from ``lo`` go, ``per`` to a sequence, to sequences from ``base`` at ``offset``."""
    next_rank: dict[int, int] = {}
    rows, base = [], 0
    for times, pattern in plan:
        at, i = 0, 0
        while i < len(pattern):
            x, n = pattern[i], 1
            while i + n < len(pattern) and pattern[i + n] == x:
                n += 1
            rows.append((x, next_rank.get(x, 0), n, base, at))
            next_rank[x] = next_rank.get(x, 0) + n * times
            at, i = at + n * x, i + n
        base += times
    rows.sort()
    names = ("length", "lo", "per", "base", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T)) | {"sequences": np.array([base])}


def _placed(ranges: dict[str, np.ndarray], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key for length and rank
        keys = ranges["length"] << 48 | ranges["lo"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            full = length == capacity
            i = np.clip(np.searchsorted(keys, length << 48 | rank, side="right") - 1, 0, None)
            if len(keys):
                past = rank - ranges["lo"][i]
                sequence = np.where(full, ranges["sequences"][0] + rank, ranges["base"][i] + past // ranges["per"][i])
                offset = np.where(full, 0, ranges["offset"][i] + past % ranges["per"][i] * length)
            else:
                sequence, offset = rank, np.zeros(len(rank), np.int64)
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(sequence), pa.array(offset)], [n for n, _ in rest] + ["sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``cut`` (doc_id, piece, start, length, ...) with sequence_id and offset."""
    counts = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    ranges = plan_ranges(plan_bins({x: n for x, n in histogram.items() if x < capacity}, capacity))
    salts = max(1, -(-max(histogram.values(), default=1) // SALT_ROWS)) * 8
    salt, mine, earlier, n = fresh(cut.columns, "salt", "rank_in_salt", "before", "n")
    salted = cut.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias(n))
    # a row for each length and salt: a window over salts, not over pieces
    before = before.select("length", salt, (F.sum(n).over(W.partitionBy("length").orderBy(salt)) - F.col(n)).alias(earlier))
    ranked = salted.withColumn(mine, F.row_number().over(W.partitionBy("length", salt).orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", salt]).withColumn("rank", F.col(mine) + F.col(earlier)).drop(salt, mine, earlier)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placed(ranges, capacity), schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """All ``docs`` cut and packed. The pieces are checkpointed, so texts are tokenised once."""
    return pack(shared_checkpoint(pieces(docs, vocabulary, capacity, separator, keep_ids)), capacity)


def op6_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
