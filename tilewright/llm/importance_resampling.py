"""Importance resampling towards a target distribution.

Hashed n-gram counts of the documents and of the target give every hash bucket a gain; a document's weight is the mean
gain of its features, looked up in one array of gains. Documents are drawn by weight plus keyed Gumbel noise without
replacement, that is, in descending order of the sum. The order comes from a distributed radix sort, least significant
digit first: each pass counts the digits of every block of rows, turns the counts into the first destination of every
(digit, block) by prefix sums, and each block moves its rows there, in the order they had.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import _common as c

# fixed values: bytes of a word are digits, letters (A-Z lower-cased) and all beyond ASCII; others separate
WORD_BYTES = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))

DIGIT = 11  # bits of a digit
BLOCK_BITS = (10, 20)  # a block of the sort has up to two to the power of these rows


def feature_hashes(text: str, longest: int) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the CRC-32 of every run of 1 to ``longest`` words."""
    words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    runs = [words]
    for n in range(2, longest + 1):
        runs.append([b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)])
    return len(words), np.concatenate([np.fromiter(map(zlib.crc32, r), np.int64, len(r)) for r in runs])


def bucket_counts(rows: DataFrame, buckets: int, longest: int = 1, text_col: str = "text") -> np.ndarray:
    """Features of all texts per hash bucket. Each task adds up its own; the sums of the tasks are ``buckets`` rows at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                total += np.bincount(feature_hashes(text.as_py(), longest)[1] % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    sums = rows.select(c.text_of(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in sums.collect():  # one row per bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of the smoothed shares of every bucket, rounded down."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [float(t + 1) * (s_all + b) / (float(s + 1) * (t_all + b)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def noise(h: int) -> int:
    """Gumbel noise of a 32-bit hash in thousandths, rounded down."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("h"), c.text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, text in zip(b.column("h").to_pylist(), b.column("text"), strict=True):
                words, hashes = feature_hashes(text.as_py(), longest)
                weight = int(gain[hashes % len(gain)].sum()) // max(1, len(hashes))
                out.append((words, len(hashes), weight, weight + noise(h)))
            numbers = np.array(out, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(numbers[:, k]) for k in range(4)]], names=["id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def _digit(key: str, shift: int) -> Column:
    return F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))


def _place(rows: pa.Table, starts: pa.Table) -> pa.Table:
    """Rows of one block with their destinations: a stable counting sort of the block's digits."""
    rows = rows.sort_by("_at")
    digit = rows["_digit"].to_numpy().astype(np.uint16)
    base = np.zeros(1 << DIGIT, dtype=np.int64)
    base[starts["_of"].to_numpy()] = starts["_start"].to_numpy()
    order = np.argsort(digit, kind="stable")
    counts = np.bincount(digit, minlength=1 << DIGIT)
    to = np.empty(len(digit), dtype=np.int64)
    to[order] = np.arange(len(digit)) + np.repeat(base - (np.cumsum(counts) - counts), counts)
    return rows.drop_columns(["_block", "_digit", "_at"]).append_column("_at", pa.array(to))


def radix_sorted(rows: DataFrame, keys: list[tuple[str, int]], n: int) -> DataFrame:
    """The ``n`` rows with ``_at``: 0, 1, ... in the order of ``keys`` (column of non-negative longs, its number of bits),
    the first key counting most.

    A pass shuffles the rows once, by block. Rows per block follow n and the session's number of shuffle partitions, a
    block has at most one count per digit, and prefix sums run per digit over the blocks; the digits' own totals are
    one row per digit. Each pass is written to the checkpoint folder. Rows equal in all keys keep some order.
    """
    low, high = BLOCK_BITS
    bits = min(high, max(low, math.ceil(math.log2(max(1, n / c.buckets(rows.sparkSession, 4))))))
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    for key, width in reversed(keys):
        for shift in range(0, width, DIGIT):
            dealt = rows.withColumns({"_block": F.shiftright("_at", bits), "_digit": _digit(key, shift)})
            counts = dealt.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n"))
            totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_n"))
            earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
            first = totals.select("_digit", F.coalesce(F.sum("_n").over(earlier.orderBy("_digit")), F.lit(0)).alias("_first"))
            before = F.coalesce(F.sum("_n").over(earlier.partitionBy("_digit").orderBy("_block")), F.lit(0))
            starts = counts.withColumn("_before", before).join(F.broadcast(first), "_digit")
            starts = starts.select(F.col("_block").alias("_to"), F.col("_digit").alias("_of"), (F.col("_first") + F.col("_before")).alias("_start"))
            rows = c.save(dealt.groupBy("_block").cogroup(starts.groupBy("_to")).applyInArrow(_place, schema), "radix")
    return rows if keys else rows.limit(0)


def draw(rows: DataFrame, take: int) -> DataFrame:
    """``rows`` (id, score and others; saved, all may be drawn) with ``rank``: 1 to ``take`` for the highest scores, null for
    the others. Ties go to the smaller id, a null id counts as the largest."""
    n, low, high, least, most, nulls = rows.agg(F.count(F.lit(1)), F.min("score"), F.max("score"), F.min("id"), F.max("id"), F.count_if(F.col("id").isNull())).first()
    none = F.lit(None).cast("long")
    if not min(take, n):
        return rows.withColumn("rank", none)
    keyed = rows.withColumn("_score", F.lit(high) - F.col("score"))
    keys = [("_score", (high - low).bit_length())]
    # Rows whose leading digit comes after that of the last row to be drawn need no order.
    top = max(0, keys[0][1] - DIGIT)
    leading, seen, last = F.shiftrightunsigned("_score", top), 0, None
    for digit, count in sorted(keyed.groupBy(leading.alias("d")).agg(F.count(F.lit(1))).collect()):  # one row per digit
        last, seen = digit, seen + count
        if seen >= take:
            break
    rest = keyed.where(leading > last).select(*rows.columns, none.alias("rank"))
    keyed = keyed.where(leading <= last)
    if nulls:
        keyed = keyed.withColumn("_null", F.col("id").isNull().cast("long"))
        keys.append(("_null", 1))
    if least is not None:
        wide = most - least >= 1 << 63  # their difference is no long; the flipped sign gives the same order
        key = F.col("id").cast("long").bitwiseXOR(F.lit(-(1 << 63))) if wide else F.col("id").cast("long") - F.lit(least)
        keyed = keyed.withColumn("_id", F.coalesce(key, F.lit(0).cast("long")))
        keys.append(("_id", 64 if wide else (most - least).bit_length()))
    ranked = radix_sorted(keyed, [(k, max(1, w)) for k, w in keys], seen)
    rank = F.when(F.col("_at") < take, F.col("_at") + 1)
    return ranked.select(*rows.columns, rank.alias("rank")).unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank.

    Of the rows with at least ``least`` words, ``percent`` in a hundred (rounded down) are drawn towards the n-grams of
    ``target`` and have a rank; for all others it is null. Ids must be of an integral type. Null texts are empty: no
    features, weight 0; a null id is hashed like an empty one and ranks last among equal scores. Repeated rows take part
    one by one; those equal in score and id share their ranks in any order. An empty ``docs`` gives no rows; with an
    empty target the weights follow the documents' own counts alone.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integral type")
    gain = gains(bucket_counts(docs, buckets, longest, text_col), bucket_counts(target, buckets, longest, target_col))
    rows = c.save(scored(docs, gain, longest, seed, id_col, text_col), "scored")
    may = F.col("n_words") >= least
    n = rows.where(may).count()
    out = draw(rows.where(may), percent * n // 100).unionByName(rows.where(~may).withColumn("rank", F.lit(None).cast("long")))
    return out.select("id", "n_features", "weight", "score", "rank")
