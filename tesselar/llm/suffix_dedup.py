"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else in the corpus are removed.

Method. Equal strings of ``window`` bytes have equal content, so they can be brought together by it: each window is named by its smallest
hashed gram (its anchor), and by the block of ``span`` neighbouring places that the anchor has in it. The windows of a block share a
core of all but span - 1 bytes. A run of windows with one anchor and block is a unit: its core with a few bytes on either side. Spark deals
units by the hash of their core. A unit that occurs twice is repeated throughout. Different units of one core are compared by a suffix
array: the core is one symbol, a unit's suffixes are sorted together with those of its core's other units by linear grouping
(suffix_array.py), and a window is repeated if its neighbour in the order agrees in all symbols of a window. So the array
is built over the ends of matches alone, a symbol a byte, and no text is sorted that has no equal in the corpus.

Scale. A unit is a row of five numbers; their bytes don't depend on the number of partitions. Copies within a chunk of text
count at once and send one row, so a passage in a third of all documents costs a row a chunk. Units are judged from sorted rows that
stream; only a row's neighbours matter. Cores that more than GROUP different units share (the ends of a passage that very many documents hold)
are halved, by longer cores, until they are small or a core is the whole window. Texts are exchanged once, compressed, with the spans to remove.

Cores and units are named by 64-bit hashes; a wrong removal would need both to agree.

Defined results: null counts as an empty text; rows are told apart by doc_id and text, so rows that repeat both are copies and are cleaned alike; null
doc_ids are documents like others; texts shorter than a window keep all; an empty table gives no rows; other columns pass
unchanged, but those of the names that the operator adds are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import BASE, chunks, distinct, fresh, give_back, mix, shared_checkpoint, table
from tesselar.llm.suffix_array import suffix_array

WINDOW, GRAM, SPAN = 400, 32, 64
#: Bytes of a long text that are hashed at a time; pieces overlap by a window.
PIECE = 4 << 20
#: Units of one core that meet in one suffix array, and symbols of one array.
GROUP, SYMBOLS = 5_000, 200_000
UNITS = "core long, unit long, doc long, tag long, at long, n int, lead int, span int, times int"
MARKS = "core long, doc long, tag long, at long, n int, lead int, span int, alone boolean"


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, inverse))


def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive keys, from the running minima of blocks of that width."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def units(text: np.ndarray, lengths: np.ndarray, window: int, gram: int, span: int) -> dict[str, np.ndarray]:
    """Units of concatenated texts: first window, number of windows, bytes before the core, size of the block, and the hashes of
    core and unit."""
    n, none = len(text), np.empty(0, np.int64)
    if n < window:
        return {"at": none, "n": none, "lead": none, "span": none, "core": none.astype(np.uint64), "unit": none.astype(np.uint64)}
    power, inverse = (p[: n + 1] for p in _powers(1 << max(16, n - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters()[text] * power[:n])])
    bits = np.uint64(n.bit_length())
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    grams = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width = window - gram + 1
    anchor = (window_minima(grams, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    del grams
    ends = np.cumsum(lengths)
    at = np.flatnonzero(np.repeat(ends, lengths)[: len(anchor)] - np.arange(len(anchor)) >= window)
    anchor = anchor[at]
    place = (anchor - at) // span
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else none
    times = np.diff(np.append(new, len(at)))
    at, anchor, place = at[new], anchor[new], place[new]
    size = np.minimum(span, width - place * span)
    lead = anchor - at - place * span
    start = at + lead
    end = start + window - size + 1

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sums[b] - sums[a]) * inverse[a]

    core = mix(of(start, end) + place.astype(np.uint64) * BASE)
    unit = mix(of(at, at + window - 1 + times) ^ mix((lead << 20 | times).astype(np.uint64)))
    return {"at": at, "n": times, "lead": lead, "span": size, "core": core, "unit": unit}


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, lengths, doc, tag, start) of about a chunk of whole texts, or of one piece of a long text."""
    for part in chunks(batches):
        docs, tags = part["doc"].to_numpy().astype(np.int64), part["tag"].to_numpy().astype(np.int64)
        texts = [x or b"" for x in part["text"].cast(pa.binary()).to_pylist()]
        short = [i for i, x in enumerate(texts) if len(x) <= PIECE]
        if short:
            lengths = np.array([len(texts[i]) for i in short], np.int64)
            yield np.frombuffer(b"".join([texts[i] for i in short]), np.uint8), lengths, docs[short], tags[short], np.zeros(len(short), np.int64)
        for i, x in enumerate(texts):
            for start in range(0, len(x) - window + 1, PIECE) if len(x) > PIECE else ():
                piece = np.frombuffer(x, np.uint8)[start : start + PIECE + window - 1]
                yield piece, np.array([len(piece)]), docs[i : i + 1], tags[i : i + 1], np.array([start])


def _units(window: int, gram: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, lengths, docs, tags, starts in _texts(batches, window):
            u = units(text, lengths, window, gram, span)
            if not len(u["at"]):
                continue
            begins = np.cumsum(lengths) - lengths
            own = np.searchsorted(begins, u["at"], "right") - 1
            order = np.lexsort((u["unit"], u["core"]))
            core, unit = u["core"][order], u["unit"][order]
            first = np.concatenate([[True], (core[1:] != core[:-1]) | (unit[1:] != unit[:-1])])
            count = np.diff(np.append(np.flatnonzero(first), len(first)))
            repeated = np.repeat(count > 1, count)
            # of units that the chunk holds twice all are known; one goes on, to tell other chunks
            known = np.sort(order[repeated])
            if len(known):
                cut = np.flatnonzero(np.concatenate([[True], (own[known][1:] != own[known][:-1]) | (u["at"][known][1:] != (u["at"] + u["n"])[known][:-1])]))
                last = np.append(cut[1:], len(known)) - 1
                a, e, o = u["at"][known[cut]], (u["at"] + u["n"])[known[last]], own[known[cut]]
                spread = mix(docs[o].view(np.uint64) ^ tags[o].view(np.uint64) ^ a.astype(np.uint64)).view(np.int64)
                yield _unit_rows(spread, np.zeros(len(a), np.int64), docs[o], tags[o], a - begins[o] + starts[o], e - a, np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a)))
            sent, o = order[first], own[order[first]]
            yield _unit_rows(core[first].view(np.int64), unit[first].view(np.int64), docs[o], tags[o], u["at"][sent] - begins[o] + starts[o], u["n"][sent], u["lead"][sent], u["span"][sent], np.minimum(count, 2))

    return run


def _unit_rows(core, unit, doc, tag, at, n, lead, span, times) -> pa.RecordBatch:
    small = [pa.array(np.asarray(x).astype(np.int32)) for x in (n, lead, span, times)]
    return pa.RecordBatch.from_arrays([pa.array(core), pa.array(unit), pa.array(doc), pa.array(tag), pa.array(at), *small], ["core", "unit", "doc", "tag", "at", "n", "lead", "span", "times"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From units sorted by core and unit: spans known to be repeated (core null), and units that must be compared with others of their
    core (``alone`` if they occur once). A row's neighbours decide, so that one row is held back."""
    columns = ["core", "unit", "doc", "tag", "at", "n", "lead", "span", "times"]
    held: list[np.ndarray] | None = None
    before: tuple[int, int] | None = None

    def decided(rows: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
        """The first n rows; the others are only looked at."""
        core, unit, times = rows[0], rows[1], rows[8]
        same_core = np.concatenate([[before is not None and before[0] == core[0]], core[1:] == core[:-1], [False]])
        same_unit = np.concatenate([[same_core[0] and before[1] == unit[0]], same_core[1:-1] & (unit[1:] == unit[:-1]), [False]])
        others = (same_core & ~same_unit)[:-1] | (same_core & ~same_unit)[1:]
        repeated = (times > 1) | same_unit[:-1] | same_unit[1:]
        repeated, others = repeated[:n], others[:n]
        _, _, doc, tag, at, num, lead, span, _ = (x[:n] for x in rows)
        for chosen, is_hit in ((np.flatnonzero(repeated), True), (np.flatnonzero(others), False)):
            if len(chosen):
                yield _marks(None if is_hit else core[chosen], doc[chosen], tag[chosen], at[chosen], num[chosen], lead[chosen], span[chosen], ~repeated[chosen])

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        known = rows[8] == 0
        if known.any():
            _, _, doc, tag, at, n, lead, span, _ = (x[known] for x in rows)
            yield _marks(None, doc, tag, at, n, lead, span, np.zeros(len(doc), bool))
            rows = [x[~known] for x in rows]
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
        n = len(rows[0])
        if n > 1:
            yield from decided(rows, n - 1)
            before = int(rows[0][-2]), int(rows[1][-2])
        held = [x[-1:].copy() for x in rows] if n else None
    if held is not None:
        yield from decided(held, 1)


def _marks(core, doc, tag, at, n, lead, span, alone) -> pa.RecordBatch:
    core = pa.nulls(len(doc), pa.int64()) if core is None else pa.array(core)
    small = [pa.array(x.astype(np.int32)) for x in (n, lead, span)]
    return pa.RecordBatch.from_arrays([core, pa.array(doc), pa.array(tag), pa.array(at), *small, pa.array(alone)], ["core", "doc", "tag", "at", "n", "lead", "span", "alone"])


STRINGS = "core long, doc long, tag long, at long, n int, span int, alone boolean, before binary, after binary"


def _strings(window: int):
    """The bytes of units before and after their cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, found, doc, tag in zip(batch.column("packed"), batch.column("units").to_pylist(), batch.column("doc").to_pylist(), batch.column("tag").to_pylist()):
                text = z.decompress(packed.as_py())
                for u in found:
                    start = u["at"] + u["lead"]
                    end = start + window - u["span"] + 1
                    out.append((u["core"], doc, tag, u["at"], u["n"], u["span"], u["alone"], text[u["at"] : start], text[end : u["at"] + u["n"] + window - 1]))
            if out:
                core, docs, tags, at, n, span, alone, before, after = zip(*out)
                longs, ints = [pa.array(x, pa.int64()) for x in (core, docs, tags, at)], [pa.array(x, pa.int32()) for x in (n, span)]
                yield pa.RecordBatch.from_arrays([*longs, *ints, pa.array(alone), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["core", "doc", "tag", "at", "n", "span", "alone", "before", "after"])

    return run


def repeated_windows(strings: list[tuple[int, bytes, bytes, int, int]]) -> list[np.ndarray]:
    """For each string (core, bytes before, bytes after, windows, size of its block) which of its windows another string, or another
    window, has too: by the suffix array of all strings, a core being one symbol."""
    cores = {c: 258 + k for k, c in enumerate(dict.fromkeys(s[0] for s in strings))}
    symbols: list[int] = []
    starts, counts, spans = [], [], []
    for core, before, after, n, span in strings:
        starts.append(len(symbols))
        counts.append(n)
        spans.append(span)
        symbols.extend([b + 1 for b in before])
        symbols.append(cores[core])
        symbols.extend([b + 1 for b in after])
        symbols.append(0)
    size = np.zeros(len(symbols), np.int64)
    for a, n, span in zip(starts, counts, spans):
        size[a : a + n] = span
    order = np.array(suffix_array(symbols), np.int64)
    order = order[size[order] > 0]
    found, text = np.zeros(len(symbols), bool), np.array(symbols, np.int32)
    a, b = order[:-1], order[1:]
    for span in distinct(size[order]).tolist():
        pairs = np.flatnonzero((size[a] == span) & (size[b] == span))
        views = np.lib.stride_tricks.sliding_window_view(text, span)
        for k in range(0, len(pairs), 50_000):
            p = pairs[k : k + 50_000]
            same = p[(views[a[p]] == views[b[p]]).all(axis=1)]
            found[a[same]] = found[b[same]] = True
    return [found[a : a + n] for a, n in zip(starts, counts)]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of lone units, from strings that come core by core."""
    rows: list[tuple] = []
    last_start = symbols = 0

    def solved(some: list[tuple]) -> pa.RecordBatch:
        out = []
        for row, found in zip(some, repeated_windows([(core, before, after, n, span) for core, _, _, _, n, span, _, before, after in some])):
            if row[6] and found.any():
                turns = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))).reshape(-1, 2)
                out.extend((row[1], row[2], row[3] + a, b - a) for a, b in turns.tolist())
        doc, tag, at, n = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int32())], ["doc", "tag", "at", "n"])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("core", "doc", "tag", "at", "n", "span", "alone", "before", "after")]):
            if rows and row[0] != rows[-1][0]:
                if symbols >= SYMBOLS:
                    yield solved(rows)
                    rows, symbols = [], 0
            rows.append(row)
            symbols += len(row[7]) + len(row[8]) + 2
    if rows:
        yield solved(rows)
    give_back()


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of a block as strings of its two halves, whose windows share longer cores."""
    import xxhash

    for batch in batches:
        out = []
        for core, doc, tag, at, n, span, alone, before, after in zip(*[c.to_pylist() for c in batch.columns]):
            lead, half = len(before), span // 2
            name = core.to_bytes(8, "little", signed=True)
            # windows that begin at least ``half`` bytes before the core, then the others
            far = max(0, min(n, lead - half + 1))
            if far:
                own = xxhash.xxh3_64_intdigest(name + b"<" + bytes([half]) + before[lead - half :])
                out.append((own, doc, tag, at, far, span - half, alone, before[: lead - half], after[: span - half + far - 2 - (lead - half)]))
            if n > far:
                first = min(lead, half - 1)
                rest = after[: span - half]
                own = xxhash.xxh3_64_intdigest(name + b">" + bytes([half]) + rest)
                out.append((own, doc, tag, at + far, n - far, half, alone, before[lead - first :], after[span - half :]))
        core, doc, tag, at, n, span, alone, before, after = zip(*out)
        names = pa.array(np.array(core, np.uint64).view(np.int64))
        longs, ints = [pa.array(x, pa.int64()) for x in (doc, tag, at)], [pa.array(x, pa.int32()) for x in (n, span)]
        yield pa.RecordBatch.from_arrays([names, *longs, *ints, pa.array(alone), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["core", "doc", "tag", "at", "n", "span", "alone", "before", "after"])


def _compare(strings: DataFrame, most: int) -> DataFrame:
    """(doc, tag, at, n) of repeated windows of lone units. Cores that more than ``most`` units share are halved first, as often as
    needed; of units that become equal each is repeated and one goes on."""
    strings, found = shared_checkpoint(strings), []
    span = SPAN
    while True:
        sizes = strings.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > most).withColumnRenamed("core", "large")
        if span <= 1 or not sizes.limit(1).count():
            break
        small = strings.join(sizes, strings.core == sizes.large, "left_anti")
        halved = strings.join(sizes, strings.core == sizes.large, "left_semi").mapInArrow(_halves, STRINGS)
        kinds = halved.groupBy("core", "n", "span", "before", "after").agg(F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("doc", "tag", "at", "alone"), F.struct("alone", "doc", "tag", "at")).alias("one"))
        kinds = shared_checkpoint(kinds)
        same = [F.col(f"h.{c}") == F.col(f"k.{c}") for c in ("core", "n", "span", "before", "after")]
        equal = halved.alias("h").join(kinds.where("copies > 1").alias("k"), same).where("h.alone").select("h.doc", "h.tag", "h.at", "h.n")
        found.append(shared_checkpoint(equal))
        # equal units are settled: one of them stays as a partner for others
        rest = kinds.select("core", "one.doc", "one.tag", "one.at", "n", "span", (F.col("one.alone") & (F.col("copies") == 1)).alias("alone"), "before", "after")
        several = rest.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").withColumnRenamed("core", "shared")
        strings = shared_checkpoint(small.unionByName(rest.join(several, rest.core == several["shared"], "left_semi")))
        span = -(-span // 2)
    hits = strings.repartition("core").sortWithinPartitions("core").mapInArrow(_compared, "doc long, tag long, at long, n int")
    for more in found:
        hits = hits.unionByName(more)
    return hits


ADDED = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}


def _cleaned(window: int, packed: str, hits: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for blob, found in zip(batch.column(packed), batch.column(hits)):
                text, spans = z.decompress(blob.as_py()), []
                if found.is_valid:
                    at = found.values.field("at").to_numpy()
                    end = at + found.values.field("n").to_numpy() + window - 1
                    order = np.argsort(at, kind="stable")
                    at, end = at[order], np.maximum.accumulate(end[order])
                    first = np.append(True, at[1:] > end[:-1])
                    spans = list(zip(at[first].tolist(), end[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)].tolist()))
                kept, done = [], 0
                for a, b in spans:
                    kept.append(text[done:a])
                    done = b
                kept = b"".join([*kept, text[done:]])
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in spans]))
            rest = [c for c in batch.schema.names if c not in (packed, hits)]
            columns = zip(*out) if out else [[]] * len(ADDED)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(x, kind) for x, kind in zip(columns, ADDED.values())], [*rest, *ADDED])

    return run


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, span: int = SPAN, group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` without ``text``, and n_bytes, n_removed, n_spans, kept_sha256, the kept bytes ``kept`` (a cut may
    fall inside a character) and the removed spans ``removed``."""
    base = docs.drop(*ADDED)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), F.xxhash64(text)]
    keyed = docs.select(text.alias("text"), key[0].alias("doc"), key[1].alias("tag"))
    found = keyed.mapInArrow(_units(window, gram, span), UNITS).repartition("core").sortWithinPartitions("core", "unit").mapInArrow(_judged, MARKS)
    marks = shared_checkpoint(found)
    open_units = marks.where("core is not null").groupBy("doc", "tag").agg(F.collect_set(F.struct("core", "at", "n", "lead", "span", "alone")).alias("units"))
    doc, tag, packed, hits, own_doc, own_tag = fresh([*base.columns, *ADDED], "doc", "tag", "packed", "hits", "own_doc", "own_tag")
    rows = base.withColumn(doc, key[0]).withColumn(tag, key[1]).withColumn(packed, text.cast("binary")).drop("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = _packed(rows, packed, kinds)
    texts = rows.select(F.col(doc).alias("doc"), F.col(tag).alias("tag"), F.col(packed).alias("packed"))
    named = open_units.withColumnsRenamed({"doc": "u_doc", "tag": "u_tag"})
    strings = texts.join(named, (texts.doc == named.u_doc) & (texts.tag == named.u_tag)).select("doc", "tag", "packed", "units").mapInArrow(_strings(window), STRINGS)
    compared = _compare(strings, group)
    spans = marks.where("core is null").select("doc", "tag", "at", "n").unionByName(compared)
    per_doc = spans.groupBy(F.col("doc").alias(own_doc), F.col("tag").alias(own_tag)).agg(F.collect_list(F.struct("at", "n")).alias(hits))
    joined = rows.join(per_doc, (rows[doc] == per_doc[own_doc]) & (rows[tag] == per_doc[own_tag]), "left").drop(doc, tag, own_doc, own_tag)
    rest = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema if f.name != "text")
    schema = rest + "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start: long, end: long>>"
    return joined.mapInArrow(_cleaned(window, packed, hits), schema)


def _packed(rows: DataFrame, packed: str, kinds: str) -> DataFrame:
    """Rows with their text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.schema.get_field_index(packed)
            yield batch.set_column(at, pa.field(packed, pa.binary()), pa.array([z.compress(x) for x in batch.column(at).to_pylist()], pa.binary()))

    return rows.mapInArrow(run, kinds)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
