"""Substring dedup: word windows that already start in an earlier document are removed.

Method. Rabin-Karp hashes of every window of ``window`` words are made in numpy, a chunk
of documents at a time. A chunk keeps one entry per hash, that of its smallest document;
its other documents with that hash are known hits at once, so a passage in a third of all
documents costs one entry a chunk. Spark deals the entries by hash range into buckets whose
number follows the corpus (a packed row names only the documents that its entries use, so bytes follow the
entries); a bucket's task counts the entries of each hash and finds its smallest
document. Hits go back to their documents, whose covered words merge into maximal intervals.

Hashes have 64 bits and are not compared word by word.

Defined results: a null text has no words; a document of fewer words than a window keeps
all; a row with a null doc_id comes after all documents (it never counts as the earlier one,
and its words covered by any other document's windows go; such rows are told apart by their text); rows that repeat a doc_id are
one document for the comparison and are cleaned alike; an empty table gives no rows;
further columns pass unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import CHUNK_BYTES, bucket_bits, chunks, corpus_size, fresh, inside, lists, mix, pack_planes, parts_for, rolling, table, text_bytes, trimmed, unpack_planes, word_hashes

WINDOW = 13
#: Stands for a null doc_id: after all documents.
LAST = np.iinfo(np.int64).max
#: Bits of buckets that a chunk's entries are cut into directly; beyond these it is COARSE bits first, then STEP more at a time from MERGED chunks together.
DIRECT, COARSE, STEP, MERGED = 13, 9, 8, 256
ENTRY = "bucket long, n int, m int, docs binary, entries binary, doc_id long, tag long, hashes array<long>"
HITS = "doc_id long, tag long, hashes array<long>"


def _keys(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its doc_id, and a tag that tells rows without one apart: a hash of their text; else 0."""
    import xxhash

    ids = part["doc_id"].combine_chunks()
    known = np.asarray(ids.is_valid())
    tags = np.zeros(len(known), np.int64)
    for i in np.flatnonzero(~known).tolist():
        tags[i] = xxhash.xxh3_64_intdigest(part["text"][i].as_py() or "") >> 1 | 1
    return ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64), tags


def _entry_schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("docs", pa.binary()), ("entries", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def _hits(docs: np.ndarray, tags: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct hits as one row per document: (doc ids, tags, list of hashes)."""
    order = np.lexsort((hashes, tags, docs))
    docs, tags, hashes = docs[order], tags[order], hashes[order]
    if len(docs):
        other = (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])
        keep = np.append(True, other | (hashes[1:] != hashes[:-1]))
        starts = np.flatnonzero(np.append(True, other)[keep])
        docs, tags, hashes = docs[keep], tags[keep], hashes[keep]
    else:
        starts = np.empty(0, np.int64)
    return docs[starts], tags[starts], lists(starts, hashes.view(np.int64), pa.int64())


def _dealt(h: np.ndarray, ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows for entries of hash and document (a place in ids and tags, which are sorted): one entry for each hash, that of its smallest document, packed by
    bucket; and the hits of the other documents, which are known."""
    schema = _entry_schema()
    order = np.argsort(h)
    h, d = h[order], doc[order]
    first = np.append(True, h[1:] != h[:-1])
    starts = np.flatnonzero(first)
    least = np.minimum.reduceat(d, starts)
    group = np.cumsum(first) - 1
    known = ids[d] > ids[least[group]]
    if known.any():
        docs, tag, found = _hits(ids[d[known]], tags[d[known]], h[known])
        n = len(docs)
        none = pa.nulls(n, pa.int32())
        target = mix(docs.view(np.uint64) ^ tag.view(np.uint64)) >> np.uint64(60 - bits)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - target.astype(np.int64)), none, none, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(docs), pa.array(tag), found], schema=schema)
    # rows without a doc_id are later than all others but not than each other, so each sends its own
    last = ids[least] == LAST
    sent = first | last[group]
    h, d = h[sent], np.where(last[group], d, least[group])[sent]
    bucket = h >> np.uint64(64 - bits)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rows = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(h)]):
        # a row names only the documents that its entries use
        used, place = np.unique(d[a:b], return_inverse=True)
        rows.append((b - a, len(used), pack_planes(ids[used], tags[used]), pack_planes(h[a:b], place.astype(_place_kind(len(used))))))
    n, m, names, packed = zip(*rows)
    none = pa.nulls(len(rows), pa.int64())
    columns = [pa.array(bucket[cut].astype(np.int64)), pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array(names, pa.binary()), pa.array(packed, pa.binary()), none, none, pa.nulls(len(rows), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _place_kind(named: int) -> type:
    return np.uint16 if named <= 1 << 16 else np.uint32


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc_id, tag) of the entries of packed rows."""
    hs, ds, ts = [], [], []
    for n, m, docs, entries in zip(rows["n"].to_pylist(), rows["m"].to_pylist(), rows["docs"], rows["entries"]):
        names, tags = unpack_planes(docs.as_py(), m, np.int64, np.int64)
        h, d = unpack_planes(entries.as_py(), n, np.uint64, _place_kind(m))
        hs.append(h)
        ds.append(names[d])
        ts.append(tags[d])
    return np.concatenate(hs), np.concatenate(ds), np.concatenate(ts)


def _entries(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            ids, tags = _keys(part)
            texts = text_bytes(part["text"])
            by_id = np.lexsort((tags, ids))
            flat, lengths = word_hashes([texts[i] for i in by_id])
            ids, tags = ids[by_id], tags[by_id]
            own = np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))
            doc, uniq, tags = np.cumsum(own) - 1, ids[own], tags[own]
            at = inside(lengths, window)
            if not len(at):
                continue
            h = rolling(flat, window)[at]
            d = np.repeat(doc, lengths)[at].astype(np.int32)
            del texts, flat
            yield from _dealt(h, uniq, tags, d, bits)

    return run


def _finer(bits: int):
    """Rows of one coarse bucket from several chunks as rows of finer buckets."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        if rows["bucket"][0].as_py() < 0:
            return rows.select(_entry_schema().names)
        h, docs, tags = _unpacked(rows)
        order = np.lexsort((tags, docs))
        h, docs, tags = h[order], docs[order], tags[order]
        own = np.append(True, (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]))
        return pa.Table.from_batches(_dealt(h, docs[own], tags[own], (np.cumsum(own) - 1).astype(np.int32), bits), _entry_schema())

    return run


def _count(rows: pa.Table) -> pa.Table:
    """One bucket: hits of the documents that are not the smallest of their hash. Hits known before have buckets of their own,
    where each counts once."""
    rows = rows.combine_chunks()
    if rows["bucket"][0].as_py() < 0:
        times, hashes = pa.compute.list_value_length(rows["hashes"]).to_numpy(), pa.compute.list_flatten(rows["hashes"]).to_numpy()
        docs, tags, found = _hits(np.repeat(rows["doc_id"].to_numpy(), times), np.repeat(rows["tag"].to_numpy(), times), hashes.view(np.uint64))
        return pa.table({"doc_id": pa.array(docs), "tag": pa.array(tags), "hashes": found})
    h, d, t = _unpacked(rows)
    order = np.argsort(h)
    h, d, t = h[order], d[order], t[order]
    first = np.append(True, h[1:] != h[:-1])
    least = np.minimum.reduceat(d, np.flatnonzero(first))[np.cumsum(first) - 1]
    hit = d > least
    docs, tags, found = _hits(d[hit], t[hit], h[hit])
    return pa.table({"doc_id": pa.array(docs), "tag": pa.array(tags), "hashes": found})


def repeated_windows(docs: DataFrame, window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """(doc_id, tag, hits): hashes of the document's windows that also start in a smaller doc_id; see ``_keys``.

    A chunk's entries are cut into DIRECT bits of buckets at most, so that a row has many entries. A corpus that needs more buckets has its rows of one coarse bucket, of
    some MERGED chunks at a time, cut again, STEP bits finer, as often as needed; what these chunks share is one entry from there on."""
    if bits is None:
        bits = bucket_bits(corpus_size(docs)[1] // 6, docs.sparkSession)
    cut = bits if bits <= DIRECT else COARSE
    entries = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_entries(window, cut), ENTRY)
    chunk_count = parts_for(corpus_size(docs)[1], CHUNK_BYTES) if cut < bits else 1
    while cut < bits:
        finer = min(bits, cut + STEP)
        groups = max(1, -(-chunk_count // MERGED))
        # a row's group is told by its own bytes, so that it is the same when the row is made again
        salted = entries.withColumn("salt", F.when(F.col("bucket") >= 0, F.pmod(F.xxhash64("entries"), F.lit(groups))).otherwise(F.pmod(F.xxhash64("doc_id", "tag"), F.lit(groups))))
        entries = salted.groupBy("bucket", "salt").applyInArrow(trimmed(_finer(finer)), ENTRY)
        cut, chunk_count = finer, groups
    hits = entries.groupBy("bucket").applyInArrow(trimmed(_count), HITS)
    # at most one row a bucket for a document, each hash in at most two
    return hits.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("hashes")).alias("hits"))


def _squeezed(names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            packed = [None if x is None else z.compress(x) for x in batch.column(at).cast(pa.binary()).to_pylist()]
            key = pa.table([pa.compute.cast(batch.column("doc_id"), pa.int64()), batch.column(at)], ["doc_id", "text"])
            ids, tags = _keys(key)
            batch = batch.set_column(at, pa.field("text", pa.binary()), pa.array(packed, pa.binary()))
            yield batch.append_column(names[0], pa.array(ids)).append_column(names[1], pa.array(tags))

    return run


def _cleaned(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            hits_at = batch.schema.get_field_index("hits")
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits")):
                text = None if text is None else z.decompress(text)
                words = (text or b"").split()
                covered, spans = np.zeros(len(words), bool), []
                if hits.is_valid and len(words) >= window:
                    starts = np.isin(rolling(word_hashes([text])[0], window), hits.values.to_numpy().view(np.uint64))
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.flatnonzero(starts)
                    edge[at] += 1
                    edge[at + window] -= 1
                    covered = np.cumsum(edge)[:-1] > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    spans = turns.reshape(-1, 2).tolist()
                kept = b" ".join(w for w, c in zip(words, covered) if not c) if spans else b" ".join(words)
                out.append((len(words), int(covered.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], None if text is None else (kept if spans else text).decode()))
            n, gone, sha, spans, text = zip(*out) if out else ([], [], [], [], [])
            more = {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "text": pa.array(text, pa.string())}
            rest = [(f, batch.column(f)) for i, f in enumerate(batch.schema.names) if f not in more and i != hits_at]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + list(more.values()), [f for f, _ in rest] + list(more))

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """All rows of ``docs`` with ``text`` cleaned, and n_words, n_removed, kept_sha256 and the removed
    word intervals ``removed`` (start, end). A text that loses nothing stays as it is; else the kept
    words are joined by one space. Columns of those names are replaced."""
    own = ["n_words", "n_removed", "kept_sha256", "removed", "hits"]
    base = docs.drop(*own).withColumn("text", F.col("text").cast("string"))
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    key, tag, key_hit, tag_hit = fresh([*base.columns, *own, "doc_id", "tag"], "key", "tag", "key_hit", "tag_hit")
    squeezed = ", ".join(f"`{k}` {'binary' if k == 'text' else v}" for k, v in kinds.items()) + f", `{key}` long, `{tag}` long"
    hits = repeated_windows(docs, window, bits).withColumnsRenamed({"doc_id": key_hit, "tag": tag_hit})
    rows = base.mapInArrow(trimmed(_squeezed((key, tag))), squeezed)
    joined = rows.join(hits, (rows[key] == hits[key_hit]) & (rows[tag] == hits[tag_hit]), "left").drop(key, tag, key_hit, tag_hit)
    rest = ", ".join(f"`{k}` {v}" for k, v in kinds.items() if k != "text")
    schema = f"{rest}, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: long, end: long>>, text string"
    return joined.mapInArrow(trimmed(_cleaned(window)), schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Windows of 13 words numbered in each document; the smallest document of each word sequence
#: is taken, and a word goes if any window over it has a smaller one.
SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words WHERE len(w) >= 13
), keyed AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY array_to_string(w[p:p+12], ' ')) AS least FROM windows
), covered AS (
  SELECT DISTINCT doc_id, p + j AS spot FROM keyed, (SELECT unnest(range(0, 13)) AS j) WHERE least < doc_id
), gone AS (
  SELECT doc_id, count(*) AS n, list(spot) AS spots FROM covered GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(spots, []), i)), ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""
