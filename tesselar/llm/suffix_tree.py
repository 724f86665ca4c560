"""LM scoring by a probabilistic suffix tree.

Method. A text is the byte string of its lower-cased words, each word but the last followed by a space
and the last by an end symbol; a gram is a symbol with the DEPTH symbols before it, the latest first, so that the grams
of one context are together in sorted order. Scan tasks cut the documents into slices of about SLICE_BYTES, which are
exchanged compressed. A slice asks for its distinct grams, with their counts in
training texts; requests go to buckets by the gram's head, the shortest of its contexts that is not broadcast, so a bucket has
all grams of its heads and of the longer contexts that end in them. There the counts are summed and each context
seen MIN_COUNT times at least is a candidate, whose next-symbol distribution is smoothed with that of the
context one symbol shorter as a prior of strength PRIOR. It is retained when this saves GAIN bits at least over
the shorter context on all its training symbols. Both bounds are absolute, so the tree grows with the
text. It stays in the buckets: the probabilities of a slice's grams, each by its longest retained context, are sent back to it in
the order of its requests.

Broadcast are the counts of contexts shorter than HEAD (at most 256 ** HEAD) and of longer ones that a sample of SAMPLE_BYTES
shows to have more than a share of all requests (at most 1 / share of each length). The share follows the corpus down to
LEAST_SHARE, so a bucket has no head much larger than BUCKET requests. The sample decides only where counts are summed, not what they are.

As for the base, a text is a sequence of words of the training vocabulary or of one class of
unknown words, ended at each place with the share that ends have of all tokens. The class has the Good-Turing share of words seen once. The rest goes to known words,
whose probability is half the tree's and half their unigram's; so the probabilities of all texts sum to at most 1.

The base score is an add-one unigram over words. Counts of words that make up FREQUENT of the corpus (a
bounded set) are sent to all tasks; occurrences of the others are dealt by word hash into buckets,
which count them and return each document's sum. Word hashes have 64 bits and are not compared.

Defined results: null and empty texts are the end symbol alone; training rows are those whose
crc32(doc_id) mod 7 is not 2, with a null doc_id taken as the empty string; rows that repeat a
doc_id and text score alike; an empty table gives no rows; without training rows the
model is uniform over bytes. doc_id is an integer or null. The rows must come from a source that gives each partition the same rows in the
same order when it is read again (a table), as a lost slice is cut anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import bucket_bits, chunks, distinct, mix, pack_planes, packed_tables, parts_for, repeated, table, text_bytes, unpack_planes, unpacked_table, word_hashes

DEPTH, HEAD = 6, 3
#: Training symbols after a candidate, and bits that a retained context saves on them.
MIN_COUNT, GAIN = 2, 8.0
PRIOR = 8.0
FREQUENT = 2e-6
#: Symbols beside the bytes of words.
SPACE, END = 0x20, 0x0A
#: Text that is held as grams at once, and parts whose counts are merged.
PART_BYTES, MERGE_EVERY = 2 << 20, 12
SLICE_BYTES = 12 << 20
#: Distinct grams of a text byte, requests of a bucket or head, and bounds of the share from which a head is split.
GRAMS_PER_BYTE, BUCKET, LEAST_SHARE, MOST_SHARE = 1 / 8, 2_000_000, 2e-5, 5e-4
SAMPLE_BYTES = 16 << 20


def held_out(remainders: int = 7, held: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % remainders == held


def symbols(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, starts, ends): each text after ``depth`` end symbols as lead-in; [start, end) are its own symbols."""
    lead = bytes([END]) * depth
    parts = [lead + b" ".join(t.lower().split()) + lead[:1] for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(parts), np.uint8), ends - sizes + depth, ends


class Counts:
    """Counts of 64-bit keys, merged every few parts so that a task holds few of them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, values: np.ndarray) -> None:
        self.parts.append(np.unique(values, return_counts=True))

    def merged(self, parts: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sorted keys, counts) of what is held, if that is at least so many parts."""
        if len(self.parts) >= parts:
            keys = distinct(np.concatenate([k for k, _ in self.parts]))
            total = np.zeros(len(keys), np.int64)
            for k, c in self.parts:
                total[np.searchsorted(keys, k)] += c
            self.parts = []
            yield keys, total


def grams(stream: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each own symbol its gram, (context << 8 | symbol) with the latest symbol of the context in the highest byte; and the symbol."""
    room = np.concatenate([stream, np.zeros(15, np.uint8)])
    n = len(stream) - depth
    v = np.empty(n + 7, np.uint64)
    for j in range(8):
        # little-endian words put later symbols higher
        v[j::8] = np.frombuffer(room, "<u8", len(v[j::8]), j)
    edge = np.zeros(len(stream) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    own = np.cumsum(edge[:-1], dtype=np.int8)[depth:] > 0
    kind = stream[depth:][own]
    return (v[:n][own] & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | kind, kind


def shorter(g: np.ndarray, depth: int, d: int) -> np.ndarray:
    """Grams of ``depth`` symbols of context cut to the latest ``d`` of them."""
    return g >> np.uint64(8 * (depth - d + 1)) << np.uint64(8) | g & np.uint64(255)


def per_word(each: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the symbols of each word with its stop, and whether that is an end."""
    stops = np.flatnonzero((kind == SPACE) | (kind == END))
    return np.add.reduceat(each, np.concatenate([[0], stops[:-1] + 1])), kind[stops] == END


def _found(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The value of each key, 0 where it is not among the sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(keys), values.dtype)
    i = np.searchsorted(sorted_keys, keys)
    i[i == len(sorted_keys)] = 0
    return np.where(sorted_keys[i] == keys, values[i], 0)


class Level:
    """The contexts of one length: counts of their grams (sorted, of that length) and symbols, and which contexts are retained."""

    def __init__(self, key: np.ndarray, counts: np.ndarray, up: np.ndarray | None, least: int, gain: float):
        seen = counts > 0
        key, counts = key[seen], counts[seen]
        self.key = distinct(key)
        at = np.searchsorted(self.key, key)
        self.c = np.bincount(at, counts, len(self.key))
        own = self.key >> np.uint64(8)
        first = np.append(True, own[1:] != own[:-1])[: len(own)]
        starts = np.flatnonzero(first)
        self.context, place = own[starts], np.cumsum(first) - 1
        self.n = np.bincount(place, self.c, len(starts))
        self.root = up is None
        if self.root:
            self.kept = np.ones(len(starts), bool)
            return
        shorter_p = np.empty(len(self.key))
        shorter_p[at] = up[seen]
        p = (self.c + PRIOR * shorter_p) / (self.n[place] + PRIOR)
        # symbols not seen after the context share the rest
        free = PRIOR / (self.n + PRIOR)
        rest = np.clip(1 - np.bincount(place, shorter_p, len(starts)), 0, None)
        self.saved = self.n * (np.bincount(place, p * np.log2(p / shorter_p), len(starts)) + free * rest * np.log2(free))
        self.kept = (self.n >= least) & (self.saved >= gain)

    def apply(self, key: np.ndarray, up: np.ndarray | None, best: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Of each gram of this length the probability by its context, and by the longest retained one so far."""
        c = _found(self.key, self.c, key)
        if self.root:
            p = (c + 1) / (self.n.sum() + 256)
            return p, p
        context = key >> np.uint64(8)
        p = (c + PRIOR * up) / (_found(self.context, self.n, context) + PRIOR)
        return p, np.where(_found(self.context, self.kept, context), p, best)


class Heads:
    """What every task knows: the levels of contexts shorter than HEAD, and of the split contexts of each length from HEAD on."""

    def __init__(self, depth: int, split: dict[int, np.ndarray], least: int = MIN_COUNT, gain: float = GAIN):
        self.depth, self.split, self.least, self.gain, self.levels = depth, split, least, gain, []
        self.first = np.zeros(1 << 8 * HEAD, bool)
        self.first[split.get(HEAD, np.empty(0, np.int64)).astype(np.int64)] = True

    def lengths(self, g: np.ndarray) -> np.ndarray:
        """Length of each gram's head: of its shortest context that is not broadcast."""
        out = np.full(len(g), HEAD)
        at = np.flatnonzero(self.first[(g >> np.uint64(8 * (self.depth - HEAD + 1))).astype(np.int64)])
        for d in range(HEAD + 1, self.depth + 1):
            out[at] = d
            if not len(self.split.get(d, ())) or not len(at):
                break
            at = at[_among(g[at] >> np.uint64(8 * (self.depth - d + 1)), self.split[d])]
        return out

    def counted(self, g: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(d, grams of length d): those whose counts are broadcast. The shortest also give the counts of all contexts before."""
        yield HEAD - 1, shorter(g, self.depth, HEAD - 1)
        length = self.lengths(g)
        for d in range(HEAD, int(length.max(initial=0))):
            yield d, shorter(g[length > d], self.depth, d)

    def fill(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Heads:
        """The levels from the counts of ``counted``."""
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        for top in range(HEAD - 1, self.depth):
            g, c = counts.get(top, none)
            p, best = None, None
            for d in range(top + 1):
                if len(self.levels) == d:
                    self.levels.append(Level(shorter(g, top, d), c, p, self.least, self.gain))
                p, best = self.levels[d].apply(shorter(g, top, d), p, best)
        return self

    def scores(self, g: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each of the distinct sorted grams, which must be all of their heads."""
        p, best, length = None, None, self.lengths(g)
        for d in range(self.depth + 1):
            key = shorter(g, self.depth, d)
            if d < HEAD:
                p, best = self.levels[d].apply(key, p, best)
                continue
            here = length <= d
            own = Level(key[here], counts[here], p[here], self.least, self.gain).apply(key[here], p[here], best[here])
            if here.all():
                p, best = own
                continue
            known = self.levels[d].apply(key[~here], p[~here], best[~here])
            p, best = p.copy(), best.copy()
            for to, mine, sent in ((p, own[0], known[0]), (best, own[1], known[1])):
                to[here], to[~here] = mine, sent
        return np.log10(best).astype(np.float32)


def slice_grams(rows: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a slice, sorted, with their counts in its training texts."""
    counts = Counts()
    for part in chunks(rows.to_batches(), PART_BYTES):
        stream, starts, ends = symbols(text_bytes(part["text"].combine_chunks()), depth)
        train = part["train"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint64)
        counts.add(grams(stream, starts, ends, depth)[0] << np.uint64(1) | np.repeat(train, ends - starts))
    key, c = next(counts.merged())
    g = key >> np.uint64(1)
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return g[starts], np.add.reduceat(np.where(key & np.uint64(1), c, 0), starts)


def distinct_grams(rows: pa.Table, depth: int) -> np.ndarray:
    """The distinct grams of a slice, sorted."""
    return distinct(np.concatenate([distinct(grams(*symbols(text_bytes(part["text"].combine_chunks()), depth), depth)[0]) for part in chunks(rows.to_batches(), PART_BYTES)]))


def _dealt(heads: Heads, g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the sorted grams, their order by bucket)."""
    length = heads.lengths(g)
    bucket = mix((g >> (np.uint64(8) * (np.uint64(heads.depth + 1) - length.astype(np.uint64)))) + (length.astype(np.uint64) << np.uint64(56))) >> np.uint64(64 - bits)
    # small integers are sorted by radix
    return bucket, np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")


def _deltas(g: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.diff(g, prepend=np.uint64(0)).tobytes())


def _requests(heads, bits: int):
    """Of each slice: (bucket, slice, n, grams, their counts in training texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("rows")):
                g, c = slice_grams(unpacked_table(blob), heads.value.depth)
                bucket, order = _dealt(heads.value, g, bits)
                g, c, bucket = g[order], c[order].astype(np.uint32), bucket[order]
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                edges = list(zip(cut.tolist(), [*cut[1:].tolist(), len(g)]))
                columns = [pa.array(bucket[cut].astype(np.int64)), pa.array([number] * len(edges), pa.int64()), pa.array([b - a for a, b in edges], pa.int32())]
                columns += [pa.array([_deltas(g[a:b]) for a, b in edges], pa.binary()), pa.array([pack_planes(c[a:b]) for a, b in edges], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "slice", "n", "grams", "counts"])

    return run


def _bucket_scores(heads):
    """One bucket: (slice, bucket, n, log10 probabilities in the order of its grams) for each slice that asked."""

    def run(rows: pa.Table) -> pa.Table:
        import zstandard

        z = zstandard.ZstdDecompressor()
        sizes = rows["n"].to_pylist()
        asked = [np.cumsum(np.frombuffer(z.decompress(x.as_py()), np.uint64)) for x in rows["grams"]]
        g = distinct(np.concatenate(asked))
        places = [np.searchsorted(g, x).astype(np.int32) for x in asked]
        del asked
        counts = np.zeros(len(g), np.int64)
        for n, place, x in zip(sizes, places, rows["counts"]):
            counts[place] += unpack_planes(x.as_py(), n, np.uint32)[0]
        logp = heads.value.scores(g, counts)
        return pa.table({"slice": rows["slice"], "bucket": rows["bucket"], "n": rows["n"], "logp": pa.array([pack_planes(logp[x]) for x in places], pa.binary())})

    return run


class GramTable:
    """log10 probability of the last symbol of each gram of a slice, found by hash."""

    def __init__(self, depth: int, g: np.ndarray, logp: np.ndarray):
        self.depth, self.grams, self.logp = depth, g, logp
        self.bits = max(4, int(len(g) * 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(g), dtype=np.int32), self._slot(g)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            rest = self.slots[slot] != left
            left, slot = left[rest], slot[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, g: np.ndarray) -> np.ndarray:
        """Of grams that all are in the table."""
        slot = self._slot(g)
        out = self.slots[slot]
        wrong = np.flatnonzero(self.grams[out] != g)
        while len(wrong):
            slot[wrong] = slot[wrong] + 1 & (1 << self.bits) - 1
            out[wrong] = self.slots[slot[wrong]]
            wrong = wrong[self.grams[out[wrong]] != g[wrong]]
        return out

    def score_words(self, stream: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, kind = grams(stream, starts, ends, self.depth)
        return per_word(self.logp[self.places(g)].astype(np.float64), kind)


def mixture(model: GramTable, told: tuple[np.ndarray, np.ndarray, np.ndarray], lengths: np.ndarray, end_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the log10 probability of its number of words, and of each word log10 of its tree probability over that
    of its stop."""
    each, stop = model.score_words(*told)
    stops = np.where(stop, math.log10(end_share), math.log10(1 - end_share))
    has = np.repeat(lengths > 0, np.maximum(lengths, 1))
    return lengths * math.log10(1 - end_share) + math.log10(end_share), (each - stops)[has]


def _hot_heads(depth: int, share: float):
    """Of a task's sample: (d, context, grams, all grams) of contexts from HEAD to ``depth`` - 1 long that have a share of its distinct grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, PART_BYTES):
            g = distinct(grams(*symbols(text_bytes(part["text"].combine_chunks()), depth), depth)[0])
            for d in range(HEAD, depth):
                context, n = np.unique(g >> np.uint64(8 * (depth - d + 1)), return_counts=True)
                hot = n > share / 4 * len(g)
                columns = [pa.array(np.full(int(hot.sum()), d)), pa.array(context[hot].view(np.int64)), pa.array(n[hot])]
                yield pa.RecordBatch.from_arrays(columns, ["d", "context", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([len(g)])], ["d", "context", "n"])

    return run


def choose_heads(docs: DataFrame, depth: int, nbytes: int) -> dict[int, np.ndarray]:
    """Contexts to broadcast, by length: those, and so their suffixes, that have more than the share of a sample's distinct grams."""
    share = min(MOST_SHARE, max(LEAST_SHARE, BUCKET / max(1.0, nbytes * GRAMS_PER_BYTE)))
    sample = docs.select("text").sample(min(1.0, SAMPLE_BYTES / max(1, nbytes)), 5)
    found = sample.mapInArrow(_hot_heads(depth, share), "d long, context long, n long").groupBy("d", "context").agg(F.sum("n").alias("n")).toPandas()
    total = int(found["n"][found["d"] == 0].sum())
    out: dict[int, np.ndarray] = {}
    for d in range(HEAD, depth):
        of = found[(found["d"] == d) & (found["n"] > share * total)]
        context = np.sort(of["context"].to_numpy().astype(np.uint64))
        out[d] = context if d == HEAD else context[_among(context >> np.uint64(8), out[d - 1])]
    return out


def _counts(heads):
    """(kind, h, c): counts of word hashes (-1), and of the grams that are broadcast, by length of context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, counts = heads.value.depth, {-1: Counts()}

        def ready(parts: int) -> Iterator[pa.RecordBatch]:
            for kind, held in counts.items():
                for key, c in held.merged(parts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(c)], ["kind", "h", "c"])

        for part in chunks(batches, PART_BYTES):
            texts = text_bytes(part["text"].combine_chunks())
            counts[-1].add(word_hashes(texts, lower=True)[0])
            for d, g in heads.value.counted(grams(*symbols(texts, depth), depth)[0]):
                counts.setdefault(d, Counts()).add(g)
            yield from ready(MERGE_EVERY)
        yield from ready(1)

    return run


def _scored(heads, often: np.ndarray, counts: np.ndarray, bits: int, ends: int, size: float, end_share: float, unseen: float):
    """One slice and the probabilities of its grams. Occurrences of words that are not frequent: (bucket, rows, entries of hash, row,
    ratio); and of each row its tokens, the model's score as far as known here, and of frequent words and the end symbol the
    sum of log10(c + 1) and those known, in any bucket."""

    def run(blob: pa.Table, found: pa.Table) -> pa.Table:
        rows, depth = unpacked_table(blob["rows"][0]), heads.value.depth
        g = distinct_grams(rows, depth)
        _, order = _dealt(heads.value, g, bits)
        found = found.sort_by("bucket")
        logp = np.empty(len(g), np.float32)
        logp[order] = np.concatenate([unpack_planes(x.as_py(), n, np.float32)[0] for n, x in zip(found["n"].to_pylist(), found["logp"])])
        model = GramTable(depth, g, logp)
        logs, out = np.append(np.log10(counts + 1.0), 0.0), []
        for turn, part in enumerate(chunks(rows.to_batches(), PART_BYTES)):
            texts = text_bytes(part["text"].combine_chunks())
            h, lengths = word_hashes(texts, lower=True)
            alone, ratio = mixture(model, symbols(texts, depth), lengths, end_share)
            hit = _among(h, often)
            at = np.full(len(h), len(often))
            at[hit] = np.searchsorted(often, h[hit])
            gain = np.zeros(len(h))
            gain[hit] = word_scores(counts[at[hit]], ratio[hit], size, unseen)
            edge = np.concatenate([[0], np.cumsum(lengths)])

            def per_text(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(values)])
                return sums[edge[1:]] - sums[edge[:-1]]

            keys, train = (part[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("row_key", "train"))
            ids = part["doc_id"].combine_chunks()
            known = np.asarray(ids.is_valid())
            own = [keys, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known.astype(np.uint8), train.astype(np.uint8)]
            own += [lengths + 1, per_text(logs[at]) + math.log10(ends + 1), per_text(hit.astype(np.int64)) + (ends > 0), alone + per_text(gain)]
            out.append((int(mix(keys[:1].view(np.uint64))[0] >> np.uint64(64 - bits)), 0, len(keys), pack_planes(*own), None))
            d = np.repeat(np.arange(len(lengths)), lengths)[~hit]
            h, r = h[~hit], ratio[~hit].astype(np.float32)
            order = np.argsort(h)
            h, d, r = h[order], d[order], r[order]
            bucket = h >> np.uint64(64 - bits)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.empty(0, np.int64)
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(h)]):
                # a bucket's row names only the documents that its words are in
                used, place = np.unique(d[i:j], return_inverse=True)
                out.append((int(bucket[i]), j - i, len(used), pack_planes(keys[used], train[used].astype(np.uint8)), pack_planes(h[i:j], place.astype(np.uint16), r[i:j])))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["bucket", "n", "m", "docs", "entries"])

    return run


def _among(h: np.ndarray, sorted_hashes: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(h), bool)
    i = np.searchsorted(sorted_hashes, h)
    i[i == len(sorted_hashes)] = 0
    return sorted_hashes[i] == h


def word_scores(c: np.ndarray, ratio: np.ndarray, size: float, unseen: float) -> np.ndarray:
    """log10 probability of words: of a known one half its unigram's and half the tree's share of 1 - unseen; of an unknown one ``unseen``."""
    log = math.log(10)
    known = np.logaddexp(np.log((c + 1) / size), ratio * log) / log + math.log10(0.5 * (1 - unseen))
    return np.where(c > 0, known, math.log10(unseen))


SUMS = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("part", pa.float64()), ("known", pa.int64()), ("score", pa.float64()), ("times", pa.int64())])


def _sums(size: float, unseen: float):
    def run(rows: pa.Table) -> pa.Table:
        """One bucket: each row's own sums, and its sum of log10(c + 1), known words and what these add to its score."""
        made = [SUMS.empty_table()]
        hs, ks, ts, rs = [], [], [], []
        for n, m, docs, entries in zip(rows["n"].to_pylist(), rows["m"].to_pylist(), rows["docs"], rows["entries"].to_pylist()):
            if entries is None:
                keys, ids, known, train, *sums = unpack_planes(docs.as_py(), m, np.int64, np.int64, np.uint8, np.uint8, np.int64, np.float64, np.int64, np.float64)
                made.append(pa.table([pa.array(keys), pa.array(ids, mask=known == 0), pa.array(train == 1), *map(pa.array, sums), pa.array(np.ones(m, np.int64))], schema=SUMS))
                continue
            keys, train = unpack_planes(docs.as_py(), m, np.int64, np.uint8)
            h, d, r = unpack_planes(entries, n, np.uint64, np.uint16, np.float32)
            hs.append(h)
            ks.append(keys[d])
            ts.append(train[d])
            rs.append(r)
        if hs:
            h, k, t, r = np.concatenate(hs), np.concatenate(ks), np.concatenate(ts), np.concatenate(rs)
            del hs, ks, ts, rs
            order = np.argsort(h)
            h, k, t, r = h[order], k[order], t[order], r[order].astype(np.float64)
            first = np.append(True, h[1:] != h[:-1])
            c = np.add.reduceat(t.astype(np.int64), np.flatnonzero(first))[np.cumsum(first) - 1]
            gain = word_scores(c, r, size, unseen)
            order = np.argsort(k)
            k, c, gain = k[order], c[order], gain[order]
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            zero, n = np.zeros(len(starts), np.int64), len(starts)
            made.append(pa.table([pa.array(k[starts]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(zero), pa.array(np.add.reduceat(np.log10(c + 1.0), starts)), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(gain, starts)), pa.array(zero)], schema=SUMS))
        return pa.concat_tables(made)

    return run


def score_documents(docs: DataFrame, held: Column | None = None, depth: int = DEPTH, least: int = MIN_COUNT, gain: float = GAIN, bits: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    spark = docs.sparkSession
    held = held_out() if held is None else held
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (~held).alias("train"))
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"), "train")
    length = F.octet_length("text").cast("long")
    sizes = docs.agg(F.coalesce(F.sum(length), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("train"), length)), F.lit(0)).alias("train"), F.count_if("train").alias("ends")).first()
    nbytes, ends = sizes["train"], sizes["ends"]
    bits = bits or bucket_bits(int(sizes["all"] * GRAMS_PER_BYTE), spark, BUCKET)
    slices = parts_for(sizes["all"], SLICE_BYTES, 12)
    heads = Heads(depth, choose_heads(docs, depth, sizes["all"]), least, gain)
    frequent = max(2.0, FREQUENT * nbytes / 6)
    found = docs.where("train").select("text").mapInArrow(_counts(spark.sparkContext.broadcast(heads)), "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c"))
    # frequent words and grams one by one, all other words as one row
    found = found.groupBy("kind", F.when((F.col("kind") >= 0) | (F.col("c") >= frequent), F.col("h")).alias("h")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("c") == 1).alias("once")).select("kind", F.col("h").cast("string").alias("h"), "c", "types", "once").toPandas()
    words = found[found["kind"] < 0]
    of = {d: found[found["kind"] == d] for d in range(depth)}
    heads = spark.sparkContext.broadcast(heads.fill({d: (x["h"].to_numpy().astype(np.uint64), x["c"].to_numpy().astype(np.int64)) for d, x in of.items() if len(x)}))
    tokens, types = int(words["c"].sum()) + ends, int(words["types"].sum()) + (ends > 0)
    size, end_share = tokens + types + 1.0, (ends + 1) / (tokens + 2.0)
    # Good-Turing: new words come as often as words seen once
    unseen = (int(words["once"].sum()) + 1) / (tokens + 2.0)
    often = words[words["h"].notna()]
    hashes = np.array([int(x) for x in often["h"]], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], often["c"].to_numpy().astype(np.int64)[order]
    # both uses of the slices are by one exchange
    dealt = docs.mapInArrow(packed_tables(SLICE_BYTES), "slice long, rows binary").repartition(slices, "slice")
    asked = dealt.mapInArrow(_requests(heads, bits), "bucket long, slice long, n int, grams binary, counts binary")
    tree = asked.groupBy("bucket").applyInArrow(_bucket_scores(heads), "slice long, bucket long, n int, logp binary")
    scored = dealt.groupBy("slice").cogroup(tree.groupBy("slice")).applyInArrow(_scored(heads, hashes, counts, bits, ends, size, end_share, unseen), "bucket long, n int, m int, docs binary, entries binary")
    sums = scored.groupBy("bucket").applyInArrow(_sums(size, unseen), "row_key long, doc_id long, train boolean, n_tokens long, part double, known long, score double, times long")
    sums = sums.groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), *[F.sum(c).alias(c) for c in ("n_tokens", "part", "known", "score", "times")])
    # a row that is repeated shares the sums of its key
    share = {c: F.col(c) / F.col("times") for c in ("n_tokens", "part", "known", "score")}
    out = sums.select(
        "doc_id", (~F.col("train")).alias("held_out"), F.round(share["n_tokens"]).cast("long").alias("n_tokens"), F.round(share["known"]).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (share["part"] - share["n_tokens"] * math.log10(size)).alias("base_score"), share["score"].alias("score"), "times",
    )
    return repeated(out, "times").drop("times")


def op1_lm_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
