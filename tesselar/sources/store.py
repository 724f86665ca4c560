"""Tables whose changes are committed together: Parquet folders and a manifest that names those in force.

A batch writes to folders of its own number, and then one manifest, which appears whole or not at all. Readers take the newest manifest, so
they see all tables of a batch or none. Keyed tables lie in buckets by a hash of their key; a merge reads and writes the
buckets that a batch touches, and the manifest goes on naming the old folders of the others. A batch that is run again writes its
folders anew, and does nothing if its manifest is there.

All files go through Spark and its file systems, so the folder can be anywhere that driver and executors share.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Null keys have a bucket, too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{folder}/manifests"))

    def _manifests(self) -> list[int]:
        found = self._files.listStatus(self._path(f"{self.folder}/manifests"))
        return sorted(int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit())

    def manifest(self) -> dict:
        """{"batch": number, "tables": {table: {bucket or batch: folder}}} of the newest commit."""
        numbers = self._manifests()
        if not numbers:
            return {"batch": None, "tables": {}}
        text = self.spark.read.text(f"{self.folder}/manifests/{numbers[-1]:012d}", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, schema: str, parts: list[str] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets (or batches, where it is appended to)."""
        held = self.manifest()["tables"].get(table, {})
        return self._read([f for k, f in held.items() if parts is None or k in parts], schema)

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in sorted(folders)])

    def batch(self, number: int) -> Batch | None:
        """What batch ``number`` writes to; none if it is committed."""
        held = self.manifest()
        return None if held["batch"] is not None and held["batch"] >= number else Batch(self, number, held)

    def drop_old(self) -> int:
        """Remove folders that the newest manifest does not name, and older manifests; gives their number. Not while readers of an
        older one or a writer are at work."""
        named = {f for parts in self.manifest()["tables"].values() for f in parts.values()}
        gone = 0
        for n in self._manifests()[:-1]:
            gone += self._files.delete(self._path(f"{self.folder}/manifests/{n:012d}"), False)
        for t in self._files.listStatus(self._path(self.folder)):
            table = t.getPath().getName()
            if table == "manifests":
                continue
            for b in self._files.listStatus(t.getPath()):
                own = f"{table}/{b.getPath().getName()}"
                for s in self._files.listStatus(b.getPath()):
                    name = s.getPath().getName()
                    if name.startswith("bucket=") and f"{own}/{name}" not in named:
                        gone += self._files.delete(s.getPath(), True)
                if not any(f == own or f.startswith(f"{own}/") for f in named):
                    gone += self._files.delete(b.getPath(), True)
        return gone


class Batch:
    """The tables that one batch changes. Nothing shows before ``commit``."""

    def __init__(self, store: Store, number: int, before: dict):
        self.store, self.number = store, number
        self.tables = {t: dict(parts) for t, parts in before["tables"].items()}

    def _write(self, df: DataFrame, table: str, by: str | None = None) -> str:
        place = f"{table}/{self.number:012d}"
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(f"{self.store.folder}/{place}")
        return place

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows in a folder of the batch. Spark writes no row files for no rows, but a folder with the schema."""
        self.tables.setdefault(table, {})[str(self.number)] = self._write(rows, table)

    def touched(self, keys: DataFrame, names: list[str]) -> list[str]:
        """Buckets of the keys; at most as many numbers as there are buckets come back."""
        return sorted(str(r[0]) for r in keys.select(bucket_of(names, self.store.buckets)).distinct().collect())

    def stored(self, table: str, schema: str, keys: DataFrame, names: list[str]) -> DataFrame:
        """Rows of the buckets that the keys touch."""
        held = self.tables.get(table, {})
        return self.store._read([held[b] for b in self.touched(keys, names) if b in held], schema)

    def merge(self, table: str, schema: str, rows: DataFrame, keys: list[str], rule: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[str]:
        """Rewrite the buckets that ``rows`` touch, by ``rule`` of stored and incoming rows; without one, incoming rows replace those of their key. Gives the buckets."""
        columns = [c.split()[0] for c in schema.split(", ")]
        rows = rows.select(*columns)
        touched, held = self.touched(rows, keys), self.tables.setdefault(table, {})
        old = self.store._read([held[b] for b in touched if b in held], schema)
        if rule is None:
            o, n = old.alias("o"), rows.select(*keys).distinct().alias("n")
            new = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "left_anti").unionByName(rows)
        else:
            new = rule(old, rows)
        bucket = bucket_of(keys, self.store.buckets)
        place = self._write(new.select(*columns, bucket.alias("bucket")).repartition("bucket"), table, "bucket")
        held.update({b: f"{place}/bucket={b}" for b in touched})
        return touched

    def commit(self) -> None:
        """Write the manifest beside its place and rename it, which no reader sees halfway."""
        s = self.store
        text = json.dumps({"batch": self.number, "tables": self.tables}, sort_keys=True)
        made = s._path(f"{s.folder}/manifests/_{self.number:012d}")
        out = s._files.create(made, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not s._files.rename(made, s._path(f"{s.folder}/manifests/{self.number:012d}")):
            raise RuntimeError(f"batch {self.number} was committed by another writer")
