"""Shared pieces of the training-data operators."""

from __future__ import annotations

import inspect
import math
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one task holds in numpy arrays at a time.
CHUNK_BYTES = 4 << 20
CHUNK_DOCS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where it is unset one is made, on a single machine only: a folder of
    the driver would be lost to the executors of a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


#: Rows up to which a counted table is broadcast; beyond, joins are left to Spark.
BROADCAST_ROWS = 100_000


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpointed table, marked for broadcast if it has few rows, and their number."""
    df = shared_checkpoint(df)
    n = df.count()
    return (F.broadcast(df) if n <= BROADCAST_ROWS else df), n


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(rows, UTF-8 bytes of all texts)."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def parts_for(nbytes: int, per: int, least: int = 1) -> int:
    return max(least, math.ceil(nbytes / per))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, name: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about ``most`` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = np.fromiter((x or 0 for x in pa.compute.binary_length(batch.column(name)).to_pylist()), np.int64, batch.num_rows)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: Python workers outlive their tasks, and share an executor's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(task):
    """A function of a task's batches, or of a group's tables, that returns freed memory when it is done."""

    def over_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    # Spark looks at the number of arguments
    def over_group(rows: pa.Table) -> pa.Table:
        made = task(rows)
        give_back()
        return made

    def over_cogroup(rows: pa.Table, others: pa.Table) -> pa.Table:
        made = task(rows, others)
        give_back()
        return made

    if inspect.isgeneratorfunction(task):
        return over_batches
    return over_group if len(inspect.signature(task).parameters) == 1 else over_cogroup


def chunks(batches: Iterable[pa.RecordBatch], most: int = CHUNK_BYTES, name: str = "text") -> Iterator[pa.Table]:
    """Regroup a task's batches into tables of about ``most`` bytes of text and at most CHUNK_DOCS rows."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        for part in slices(batch, name, most):
            n = pa.compute.sum(pa.compute.binary_length(part.column(name))).as_py() or 0
            if held and (size + n > most or rows + part.num_rows > CHUNK_DOCS):
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
            held.append(part)
            size, rows = size + n, rows + part.num_rows
    if held:
        yield pa.Table.from_batches(held)
    del held
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd base of the Rabin-Karp polynomials modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


#: Bytes that are hashed at a time; a task keeps two tables of as many numbers.
HASHED = 1 << 20
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, inverse))


def letters(lower: bool = False) -> np.ndarray:
    """A 64-bit number for each byte; with ``lower`` A-Z have those of a-z."""
    made = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
    if lower:
        made[65:91] = made[97:123]
    return made


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words of each text), words being runs without ASCII white space. Rabin-Karp sums of the bytes' numbers, taken from one
    running sum, moved to a common place and mixed; no word becomes a Python object. Long runs of texts are hashed in pieces that end at white space."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    number, hashes, starts, at = letters(lower), [], [], 0
    while at < len(joined):
        end = min(len(joined), at + HASHED)
        stops = np.flatnonzero(_SPACES[joined[at:end]])
        # the last white space in reach, else the next one: a word is never cut
        while not len(stops):
            stops, end = np.flatnonzero(_SPACES[joined[end : end + HASHED]]) + end - at, min(len(joined), end + HASHED)
            stops = stops[:1]
        end = at + int(stops[-1]) + 1
        piece = joined[at:end]
        power, inverse = powers(1 << max(16, (len(piece) - 1).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(number[piece] * power[: len(piece)])])
        space = _SPACES[piece]
        a = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        b = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        hashes.append(mix((sums[b] - sums[a]) * inverse[a]))
        starts.append(a + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), edges), prepend=0)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of each k consecutive word hashes: sum of w[i+j] * BASE**(k-1-j) modulo 2**64, mixed."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= BASE
        h += words[j : j + n]
    return mix(h)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort: numpy's own hashes them first, which takes longer for many."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def inside(lengths: np.ndarray, k: int) -> np.ndarray:
    """Positions of the concatenated documents at which k words of one document start."""
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths) - np.arange(ends[-1] if len(ends) else 0)
    return np.flatnonzero(room >= k)


def lists(groups_starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column over ``values`` cut at the given starts."""
    offsets = np.append(groups_starts, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def pack_planes(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as compressed byte planes; the sorted high bytes shrink to almost nothing."""
    import zstandard

    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_planes(blob: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def bucket_bits(entries: int, spark: SparkSession | None = None, per: int = 2_000_000, least: int = 6) -> int:
    """Bits of the hash that name a bucket, so that a bucket has ``per`` entries at most on average; with a session also so
    that there are several buckets to a shuffle partition, which even out."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions")) if spark else 1
    return max(least, math.ceil(math.log2(max(1, entries) / per)), math.ceil(math.log2(2 * partitions)))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores appended as keep it apart from the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def repeated(df: DataFrame, times: str, number: str | None = None, most: int = 10_000) -> DataFrame:
    """Each row so many times, numbered from 1 if asked; in two steps, so that arrays have ``most`` numbers, or one for so many rows."""
    block, own = fresh(df.columns, "block", "own")
    many = df.where(F.col(times) > 0).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / most))))
    left = F.least(F.lit(most).cast("long"), F.col(times) - F.col(block) * most)
    many = many.withColumn(own, F.explode(F.sequence(F.lit(1).cast("long"), left)))
    if number:
        many = many.withColumn(number, (F.col(block) * most + F.col(own)).cast("int"))
    return many.drop(block, own)


def packed_tables(most: int):
    """Consecutive rows of a partition as compressed tables of about so many bytes of text: (slice, rows). A slice's number is that
    of its partition and its place there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        for place, part in enumerate(chunks(batches, most)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_table(part)
            blob = zstandard.ZstdCompressor(level=1).compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId() << 32 | place]), pa.array([blob], pa.binary())], ["slice", "rows"])

    return run


def unpacked_table(blob: pa.Scalar) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob.as_buffer())).read_all()
