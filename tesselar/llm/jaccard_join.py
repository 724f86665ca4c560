"""N-gram Jaccard join by T-occurrence search over word shingles.

Method. Scan tasks cut the documents into slices, which are exchanged compressed. A slice's sets of shingle hashes are made in numpy
and named by a 64-bit digest, so equal sets are one set from the start. A slice sends its distinct shingles, with the number of its sets that
hold them, to buckets by hash range; these sum the numbers and send them back in the order in which they came, so neither way
names a set, and bytes follow the distinct shingles at any number of buckets. The names of sets go the same way, and
the first slice of each keeps it. A set of n shingles of which fewer than ceil(t*n) are held twice can reach no overlap and is
finished. For the rest, the n - ceil(t*n) + 1 rarest shingles are its short lists: two linked
sets share one of them. The set with most shared shingles in a list is its centre, and all sets of a centre's
lists are its cluster, so two linked sets are in one cluster. First each centre is searched in
its cluster; then, in clusters that are not one component yet, every set outside the largest component is.
So components are exact, though members of one component need not all be compared.

A search is T-occurrence by DivideSkip over a block of a cluster, which is indexed once: the query's short inverted
lists are heap-merged, its long ones probed by binary search for the candidates that the short ones
leave, and a set stays with an overlap of T = ceil(t * (n_x + n_y) / (1 + t)).

A frequent shingle is one entry of each slice that has it, and comes last in the order of rarity. Large clusters are cut by set size and dealt in
blocks of fixed size, so a large group of near copies is searched by many tasks.

Defined results: texts that are null, empty or without words have an empty set and link to
nothing; rows with a null doc_id get their n_shingles, no links and a null component; rows that
repeat a doc_id with one text count as one document (with several texts, each row gets the component
of its own set, named by its smallest doc_id); an empty table gives no rows. The rows must come from a source that gives each
partition the same rows in the same order when it is read again (a table), as a lost slice is cut anew.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import BASE, CHUNK_BYTES, bucket_bits, corpus_size, counted, distinct, fresh, mix, pack_planes, packed_tables, parts_for, rolling, shared_checkpoint, table, text_bytes, trimmed, unpack_planes, unpacked_table, word_hashes
from tesselar.llm.components import connected_components

SHINGLE = 5
#: Sets that one search holds in its index.
BLOCK = 1024
#: Width of the classes of set sizes (as a logarithm) that a cluster of more sets is cut into.
SIZE_CLASS = 0.06


def needed(n, percent: int):
    """Least overlap that a set of n shingles needs with any partner."""
    return -(-percent * n // 100)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document) of distinct shingles sorted by hash, and each document's size and the digest of its set."""
    flat, lengths = word_hashes(texts, lower=True)
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths) - np.arange(len(flat))
    at = np.flatnonzero(room >= k)
    h = rolling(flat, k)[at] if len(at) else np.empty(0, np.uint64)
    d = np.repeat(np.arange(len(texts)), lengths)[at].astype(np.int32)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, doc in enumerate(short):
            for w in flat[ends[doc] - lengths[doc] : ends[doc]]:
                whole[i : i + 1] = whole[i : i + 1] * BASE + w
        h = np.append(h, mix(whole ^ mix(lengths[short].astype(np.uint64))))
        d = np.append(d, short.astype(np.int32))
    order = np.argsort(h)
    h, d = h[order], d[order]
    # documents of one hash in order, then distinct
    same = np.append(False, h[1:] == h[:-1]) if len(h) else np.empty(0, bool)
    if same.any():
        runs = np.flatnonzero(same | np.append(same[1:], False))
        fix = runs[np.lexsort((d[runs], h[runs]))]
        h[runs], d[runs] = h[fix], d[fix]
        keep = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
        h, d = h[keep], d[keep]
    size = np.bincount(d, minlength=len(texts))
    by_doc = np.argsort(d, kind="stable")
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(texts) else np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(mix(h[by_doc] ^ BASE))]).astype(np.uint64)
    digest = mix(total[starts + size] - total[starts] + size.astype(np.uint64)) if len(texts) else np.empty(0, np.uint64)
    return h, d, size, digest


def _cuts(sorted_buckets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal buckets."""
    cut = np.flatnonzero(np.append(True, sorted_buckets[1:] != sorted_buckets[:-1])) if len(sorted_buckets) else np.empty(0, np.int64)
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(sorted_buckets)]))


class Chunk:
    """The sets of one slice: (hash, place) of distinct shingles sorted by hash, and each set's name, size and number of documents with an id."""

    def __init__(self, rows: pa.Table, k: int):
        h, d, size, digest = shingle_sets(text_bytes(rows["text"].combine_chunks()), k)
        known = np.asarray(rows["doc_id"].combine_chunks().is_valid())
        self.doc_sizes, self.doc_sets = size, digest
        # one document with an id for each set
        named = np.flatnonzero(known & (size > 0))
        self.names, first = np.unique(digest[named], return_index=True)
        self.sizes = size[named[first]]
        stands = np.zeros(len(size), bool)
        stands[named[first]] = True
        keep = stands[d]
        self.h, self.place = h[keep], np.searchsorted(self.names, digest)[d[keep]]
        self.first = np.append(True, self.h[1:] != self.h[:-1])[: len(self.h)]

    def asked(self, bits: int) -> list[tuple[int, int, bytes, bytes]]:
        """(bucket, n, hashes, counts): the shingles with the number of sets that hold them, and in buckets of their own the names of the sets."""
        starts = np.flatnonzero(self.first)
        h, c = self.h[starts], np.diff(np.append(starts, len(self.h))).astype(np.uint16)
        out = []
        for base, keys, counts in ((0, h, c), (1 << bits, self.names, np.zeros(len(self.names), np.uint16))):
            bucket = keys >> np.uint64(64 - bits)
            out += [(base + int(bucket[a]), b - a, pack_planes(keys[a:b]), pack_planes(counts[a:b])) for a, b in _cuts(bucket)]
        return out


def _asked(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("rows")):
                bucket, n, hashes, counts = zip(*Chunk(unpacked_table(blob), k).asked(bits) or [(-1, 0, b"", b"")])
                columns = [pa.array(bucket, pa.int64()), pa.array([number] * len(bucket), pa.int64()), pa.array(n, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "slice", "n", "hashes", "counts"])

    return run


def _counted(bits: int):
    def run(rows: pa.Table) -> pa.Table:
        """One bucket: for each slice, in the order of its hashes, the number of sets that hold a shingle; of a set's name whether the slice is the first with it."""
        bucket, sizes = rows["bucket"][0].as_py(), rows["n"].to_pylist()
        if bucket < 0:
            return pa.table({"slice": rows["slice"], "bucket": rows["bucket"], "n": rows["n"], "told": rows["counts"]})
        keys = [unpack_planes(x.as_py(), n, np.uint64)[0] for n, x in zip(sizes, rows["hashes"])]
        u = distinct(np.concatenate(keys))
        places = [np.searchsorted(u, x).astype(np.int32) for x in keys]
        del keys
        if bucket >> bits:
            slices = np.array(rows["slice"].to_pylist(), np.int64)
            owner = np.full(len(u), np.iinfo(np.int64).max)
            for number, place in zip(slices, places):
                owner[place] = np.minimum(owner[place], number)
            told = [(owner[place] == number).astype(np.uint32) for number, place in zip(slices, places)]
        else:
            total = np.zeros(len(u), np.int64)
            for n, place, x in zip(sizes, places, rows["counts"]):
                total[place] += unpack_planes(x.as_py(), n, np.uint16)[0]
            total = np.minimum(total, 2**32 - 1).astype(np.uint32)
            told = [total[place] for place in places]
        return pa.table({"slice": rows["slice"], "bucket": rows["bucket"], "n": rows["n"], "told": pa.array([pack_planes(x) for x in told], pa.binary())})

    return run


SET = pa.schema([("set_id", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("members", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _prefixes(k: int, percent: int, bits: int):
    def run(blob: pa.Table, told: pa.Table) -> pa.Table:
        """One slice: each document's set and size; and of each set that the slice has first, if enough of its shingles are shared, these, sorted
        (``members``), and as ``keys`` the rarest of them that are its short lists."""
        rows = unpacked_table(blob["rows"][0])
        chunk = Chunk(rows, k)
        n = rows.num_rows
        columns = [pa.array(chunk.doc_sets.view(np.int64)), pa.array(chunk.doc_sizes, pa.int64()), rows["doc_id"], pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))]
        out = [pa.table(columns, schema=SET)]
        told = told.sort_by("bucket")
        answers = [unpack_planes(x.as_py(), m, np.uint32)[0] for b, m, x in zip(told["bucket"].to_pylist(), told["n"].to_pylist(), told["told"]) if b >= 0]
        if answers:
            answers = np.concatenate(answers)
            once = int(chunk.first.sum())
            freq, mine = answers[:once][np.cumsum(chunk.first) - 1], answers[once:] == 1
            keep = (freq > 1) & mine[chunk.place]
            s, h, f = chunk.place[keep], chunk.h[keep].view(np.int64), freq[keep]
            shared = np.bincount(s, minlength=len(chunk.names))
            short = shared - needed(chunk.sizes, percent) + 1
            able = np.flatnonzero((short > 0) & (shared > 0))
            keep = np.isin(s, able)
            s, h, f = s[keep], h[keep], f[keep]
            starts = np.concatenate([[0], np.cumsum(shared[able])])
            order = np.lexsort((h, f, s))
            rank = np.arange(len(s)) - np.repeat(starts[:-1], shared[able])
            keys = h[order][rank < np.repeat(short[able], shared[able])]
            order = np.lexsort((h, s))
            held = pa.Array.from_buffers(pa.binary(), len(able), [None, pa.py_buffer((starts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h[order]))])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(short[able])]), pa.int32()), pa.array(keys))
            out.append(pa.table([pa.array(chunk.names[able].view(np.int64)), pa.array(chunk.sizes[able], pa.int64()), pa.nulls(len(able), pa.int64()), held, lists], schema=SET))
        return pa.concat_tables(out)

    return run


class Block:
    """An index of up to BLOCK sets: for each shingle the sorted places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sizes = np.array(sizes, np.int64)
        shingle = np.concatenate(sets) if sets else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(shingle, kind="stable")
        shingle, self.owner = shingle[order], owner[order]
        self.start = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.empty(0, np.int64)
        self.key = shingle[self.start]
        self.start = np.append(self.start, len(shingle))

    def search(self, query: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Places of the sets whose overlap with the query of n shingles reaches T: DivideSkip."""
        if not len(self.key):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.key, query)
        at[at == len(self.key)] = 0
        at = at[self.key[at] == query]
        lengths = self.start[at + 1] - self.start[at]
        order = np.argsort(lengths, kind="stable")
        lists = [self.owner[self.start[i] : self.start[i + 1]] for i in at[order]]
        wanted = -(-percent * (n + self.sizes) // (100 + percent))
        able = wanted <= np.minimum(n, self.sizes)
        if not lists or not able.any():
            return np.empty(0, np.int64)
        least = int(wanted[able].min())
        # so many long lists are set aside: T / (mu * log M + 1), with mu = 0.01
        aside = min(len(lists), max(0, least - 1), int(least / (0.01 * math.log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        places, have = [], []
        last, count = -1, 0
        for place in heapq.merge(*[x.tolist() for x in short]):
            if place == last:
                count += 1
            else:
                if last >= 0:
                    places.append(last)
                    have.append(count)
                last, count = place, 1
        if last >= 0:
            places.append(last)
            have.append(count)
        places, have = np.array(places, np.int64), np.array(have, np.int64)
        if len(places):
            stay = able[places] & (have >= wanted[places] - aside)
            places, have = places[stay], have[stay]
        # the longest last: candidates that cannot reach T any more leave
        for left, ids in zip(range(len(long), 0, -1), long):
            if not len(places):
                break
            i = np.searchsorted(ids, places)
            i[i == len(ids)] = 0
            have += ids[i] == places
            if left % 16 == 0:
                stay = have + left - 1 >= wanted[places]
                places, have = places[stay], have[stay]
        return places[have >= wanted[places]] if len(places) else places


def _searched(percent: int):
    """Rows of one block come together, its sets before its queries; yields linked pairs of different components,
    one for each query and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, sets, sizes, names, parts, a, b = None, None, [], [], [], [], [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("centre", "block", "query", "set_id", "n", "part"))
            for centre, number, query, name, n, part, members in zip(*columns, batch.column("members")):
                if (centre, number) != key:
                    key, block, sets, sizes, names, parts = (centre, number), None, [], [], [], []
                values = np.frombuffer(members.as_buffer(), np.int64)
                if not query:
                    sets.append(values.copy())
                    sizes.append(n)
                    names.append(name)
                    parts.append(part)
                    continue
                block = block or Block(sets, sizes)
                seen = {part}
                for i in block.search(values, n, percent).tolist():
                    if parts[i] not in seen and names[i] != name:
                        seen.add(parts[i])
                        a.append(name)
                        b.append(names[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []

    return run


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / SIZE_CLASS).cast("int")


def _links(clusters: DataFrame, queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of queries (centre, set_id, n, shared, part) with other sets of their clusters, which have the same columns.

    A cluster of more than BLOCK sets is cut into classes of like size and these into blocks; a query goes to the blocks whose
    sizes it can link with: from t * n to n / t, and, as no overlap exceeds its shared shingles, to shared * (1 + t) / t - n.
    """
    clusters = clusters.withColumn("class", _size_class(F.col("n")))
    counts = clusters.groupBy("centre", "class").agg(F.count(F.lit(1)).alias("c"))
    large, _ = counted(counts.groupBy("centre").agg(F.sum("c").alias("all")).where(F.col("all") > BLOCK).select("centre", F.lit(True).alias("large")))
    per, _ = counted(counts.join(large, "centre").select("centre", "class", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    low, high = F.ceil(F.col("n") * percent / 100), F.least(F.floor(F.col("n") * 100 / percent), F.floor(F.col("shared") * (100 + percent) / percent) - F.col("n"))
    classes = F.when(F.col("large") & (high >= low), F.sequence(_size_class(low), _size_class(high))).when(F.col("large").isNull(), F.array(F.lit(-1)))
    asked = queries.join(large, "centre", "left").select("centre", "set_id", "part", F.explode(classes).alias("class")).join(per, ["centre", "class"], "left")
    asked = asked.where("class = -1 OR blocks IS NOT NULL").withColumn("number", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    held = clusters.join(per, ["centre", "class"], "left").withColumn("class", F.when(F.col("blocks").isNull(), -1).otherwise(F.col("class")))
    held = held.withColumn("number", F.pmod(F.xxhash64("set_id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    block = F.shiftleft(F.col("class").cast("long"), 32).bitwiseOR(F.col("number").cast("long")).alias("block")
    rows = held.select("centre", block, F.lit(False).alias("query"), "set_id", "part").unionByName(asked.select("centre", block, F.lit(True).alias("query"), "set_id", "part"))
    rows = rows.join(sets.select("set_id", "n", "members"), "set_id")
    together = rows.repartition("centre", "block").sortWithinPartitions("centre", "block", "query")
    return together.select("centre", "block", "query", "set_id", "n", "part", "members").mapInArrow(trimmed(_searched(percent)), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = 80, bits: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``."""
    nbytes = corpus_size(docs)[1]
    bits = bits or bucket_bits(nbytes // 6, docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # both uses of the slices are by one exchange
    slices = docs.mapInArrow(packed_tables(CHUNK_BYTES), "slice long, rows binary").repartition(parts_for(nbytes, 2 * CHUNK_BYTES, 12), "slice")
    asked = slices.mapInArrow(trimmed(_asked(k, bits)), "bucket long, slice long, n int, hashes binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(trimmed(_counted(bits)), "slice long, bucket long, n int, told binary")
    both = slices.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(trimmed(_prefixes(k, percent, bits)), "set_id long, n long, doc_id long, members binary, keys array<long>")
    both = shared_checkpoint(both)
    sizes, sets = both.where("members IS NULL").select("doc_id", "n", "set_id"), both.where("members IS NOT NULL")
    reps = sizes.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"))

    shared = (F.length("members") / 8).cast("long")
    lists_of = sets.select("set_id", "n", shared.alias("shared"), (shared / F.col("n")).alias("weight"), F.explode("keys").alias("key"))
    centres = lists_of.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.max(F.struct("weight", "set_id")).alias("top")).where("held > 1").select("key", F.col("top.set_id").alias("centre"))
    clusters = shared_checkpoint(lists_of.join(centres, "key").select("centre", "set_id", "n", "shared").distinct())
    alone = clusters.withColumn("part", F.col("set_id"))
    first = shared_checkpoint(_links(alone, alone.where("set_id = centre"), sets, percent))
    groups = connected_components(first)

    placed = clusters.join(groups, clusters.set_id == groups.node, "left").select("centre", "set_id", "n", "shared", F.coalesce("component", "set_id").alias("part"))
    parted = placed.groupBy("centre", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("centre").agg(F.max(F.struct("c", "part")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("centre", F.col("top.part").alias("largest"))
    mixed = placed.join(counted(parted)[0], "centre")
    second = shared_checkpoint(_links(mixed.drop("largest"), mixed.where("part <> largest").drop("largest"), sets, percent))
    linked = connected_components(first.unionByName(second))
    named = linked.join(reps, linked.node == reps.set_id).select("node", "component", "rep")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    by_set = reps.join(named.join(least, "component").select(F.col("node").alias("set_id"), "least"), "set_id", "left").select("set_id", F.coalesce("least", "rep").alias("component_id"))
    out = sizes.join(by_set, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` but for those linked to a smaller doc_id. Of rows that repeat a kept doc_id and its text one stays;
    rows without a doc_id, which nothing names, all stay."""
    name, = fresh(docs.columns, "kept")
    of = jaccard_components(docs, percent=percent).where("doc_id = component_id").groupBy(F.col("doc_id").alias(name)).agg(F.count(F.lit(1)).alias("rows"))
    of = shared_checkpoint(of)
    here = F.col("doc_id").cast("long") == F.col(name)
    once = docs.join(of.where("rows = 1").select(name), here, "left_semi")
    # usually none, so their texts cost no exchange of all texts
    again = docs.join(of.where("rows > 1").select(name), here, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL"))


#: All sets and their overlaps; then the smallest document that links reach.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reached.doc_id, edges.b FROM reached JOIN edges ON edges.a = reached.other
)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS least_id FROM reached GROUP BY doc_id) USING (doc_id)
"""
