"""State of streams as versioned tables in shared storage: larger than memory, idempotent by batch number.

A table is dealt into a fixed number of buckets by a hash of its keys. A batch rewrites (:meth:`StateTable.upsert`) or adds to
(:meth:`StateTable.append`) the buckets it touches, in a folder of its own number; a small manifest per batch names
the folders that make up each bucket. A repeated batch starts from the manifest before it and writes the same again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
PARTS = 8  # parts a bucket is made of before it is written anew
PROBES = 5  # places of a key in a Bloom filter
BITS_PER_KEY = 16


class StateTable:
    """Rows of ``schema`` in ``buckets`` buckets by a hash of ``keys``; null is a key like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests -----------------------------------------------------------------------------------

    def _numbers(self, folder: str) -> list[int]:
        at = self._fs_path(f"{self.path}/{folder}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n.split("=")[-1]) for n in names if n.split("=")[-1].isdigit())

    def parts(self, before: int | None = None) -> dict[int, list[int]]:
        """The batches whose folders make up each bucket, as of the end (or of the last batch ``before`` a number)."""
        known = [n for n in self._numbers("manifest") if before is None or n < before]
        if not known:
            return {}
        source = self._fs.open(self._fs_path(f"{self.path}/manifest/{known[-1]}"))
        text = bytes(source.readAllBytes()).decode()
        source.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def _commit(self, number: int, parts: dict[int, list[int]]) -> None:
        """Name the table's folders; those that neither this manifest nor the one before it needs are removed."""
        for old in self._numbers("manifest"):
            if old >= number:  # left by a run of this batch that didn't end
                self._fs.delete(self._fs_path(f"{self.path}/manifest/{old}"), False)
        draft, final = self._fs_path(f"{self.path}/manifest/.{number}"), self._fs_path(f"{self.path}/manifest/{number}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        self._fs.rename(draft, final)
        kept = self._numbers("manifest")[-2:]
        needed = {n for m in kept for v in self.parts(m + 1).values() for n in v}
        for old in self._numbers("manifest"):
            if old not in kept:
                self._fs.delete(self._fs_path(f"{self.path}/manifest/{old}"), False)
        for n in self._numbers("rows"):
            if n not in needed and n != number:
                self._fs.delete(self._fs_path(f"{self.path}/rows/batch={n}"), True)

    # rows ----------------------------------------------------------------------------------------

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def folders(self, only: Iterable[int] | None = None, before: int | None = None) -> list[str]:
        chosen = None if only is None else set(only)
        return [f"{self.path}/rows/batch={n}/_bucket={b}" for b, v in sorted(self.parts(before).items()) if chosen is None or b in chosen for n in v]

    def read(self, only: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """The table's rows, or those of some buckets."""
        found = self.folders(only, before)
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, number: int) -> None:
        """One file per bucket, under the number of the batch."""
        dealt = self.bucketed(rows.select(*self.schema.names)).repartition(self.buckets, "_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/rows/batch={number}")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in self.bucketed(rows).select("_bucket").distinct().collect()]  # one row per bucket at most

    def upsert(self, delta: DataFrame, number: int, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Buckets of ``delta`` with its rows merged in; ``combine`` makes one row per key of old and new ones."""
        touched = self._touched(delta)
        names = self.schema.names
        self._write(combine(self.read(touched, number).unionByName(delta.select(*names))), number)
        self._commit(number, self.parts(number) | {b: [number] for b in touched})

    def append(self, rows: DataFrame, number: int) -> None:
        """``rows`` added to their buckets; a bucket of PARTS parts is written anew as one, so that reads stay cheap."""
        touched, parts = self._touched(rows), self.parts(number)
        full = [b for b in touched if len(parts.get(b, [])) >= PARTS]
        self._write(rows.select(*self.schema.names).unionByName(self.read(full, number)) if full else rows, number)
        self._commit(number, parts | {b: ([] if b in full else parts.get(b, [])) + [number] for b in touched})


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Places of 64-bit hashes in a filter of ``bits`` (a power of two)."""
    u = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        step = (u >> np.uint64(32)) | np.uint64(1)
        return ((u[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


class SeenKeys:
    """Keys met so far, exactly and for ever: the keys are a :class:`StateTable`, beside it is a Bloom filter per bucket.

    A key its filter doesn't know is new without a look at the stored keys; only the others are compared with them, in
    their buckets alone. A filter doubles with the number of keys of its bucket, so its rate of false alarms stays small.
    """

    FILTER = "bucket int, keys long, bits binary"

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        names = spark.createDataFrame([], schema).schema.names
        self.keys = names
        self.table = StateTable(spark, f"{path}/keys", schema, names, buckets)
        self.filters = StateTable(spark, f"{path}/filters", self.FILTER, ["bucket"], buckets)

    def _hashed(self, df: DataFrame) -> DataFrame:
        return self.table.bucketed(df).withColumn("_h", F.xxhash64(F.lit(7), *self.keys))

    def _doubtful(self, rows: DataFrame, number: int) -> DataFrame:
        """``rows`` (hashed) that their filters know."""
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return left.slice(0, 0)
            bits = np.unpackbits(np.frombuffer(right["bits"][0].as_py(), dtype=np.uint8))
            return left.filter(pa.array(bits[_places(left["_h"].to_numpy(), len(bits))].all(axis=1)))

        known = self.filters.read(before=number)
        return rows.groupBy("_bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, rows.schema)

    def _grown(self, fresh: DataFrame, number: int) -> DataFrame:
        """Filters of the buckets of ``fresh`` (hashed) with its keys; one that gets too full is made of all keys of its bucket."""
        known = dict(self.filters.read(before=number).select("bucket", "keys").collect())
        more = dict(fresh.groupBy("_bucket").count().collect())  # one row per bucket, both

        def size(keys: int) -> int:
            return 1 << max(13, (BITS_PER_KEY * keys - 1).bit_length())

        anew = [b for b, n in more.items() if b in known and size(known[b] + n) > size(known[b])]
        if anew:
            fresh = fresh.unionByName(self._hashed(self.table.read(anew, number)).select(*fresh.columns))
        total = {b: known.get(b, 0) + n for b, n in more.items()}
        fixed = {b: size(n) for b, n in total.items()}

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            b = int(key[0].as_py())
            if not left.num_rows:
                return pa.table({"bucket": pa.array([], pa.int32()), "keys": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})
            bits = np.zeros(fixed[b], dtype=np.uint8)
            if right.num_rows and b not in anew:
                bits |= np.unpackbits(np.frombuffer(right["bits"][0].as_py(), dtype=np.uint8))
            bits[_places(left["_h"].to_numpy(), len(bits)).ravel()] = 1
            return pa.table({"bucket": pa.array([b], pa.int32()), "keys": pa.array([total[b]], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        old = self.filters.read(before=number)
        return fresh.select("_bucket", "_h").groupBy("_bucket").cogroup(old.groupBy("bucket")).applyInArrow(run, self.FILTER)

    def unseen(self, batch: DataFrame, number: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Keys of ``batch`` that no earlier batch had, once each; they count as seen from the next batch on.

        ``cut`` materialises a DataFrame. Repeating a batch gives the same keys.
        """
        rows = cut(self._hashed(batch.select(*self.keys).distinct()))
        doubtful = cut(self._doubtful(rows, number).select(*self.keys))
        buckets = self.table._touched(doubtful)
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        old = doubtful.alias("a").join(self.table.read(buckets, number).alias("b"), same, "left_semi").select(*self.keys)
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        fresh = cut(rows.alias("a").join(old.alias("b"), same, "left_anti"))
        filters = cut(self._grown(fresh, number))
        self.filters.upsert(filters, number, lambda both: both.groupBy("bucket").agg(F.max_by(F.struct("keys", "bits"), "keys").alias("f")).select("bucket", "f.*"))
        self.table.append(fresh, number)
        return fresh.select(*self.keys)
