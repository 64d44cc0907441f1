"""Exact Jaccard self-join of shingle sets in a metric space: pivots, Voronoi regions, triangle-inequality windows.

Two sets are linked when their Jaccard distance is at most EPS = 1 - 3/4.

1. Pivots of the outer level are single shingles, in one order for all sets (rarest first). The distance of a set
   A to {s} is 1 - 1/|A| if it holds s, else 1, so the nearest pivots of A are its own shingles and the order breaks
   the tie. Sets within EPS of A lack at most |A|/4 of its shingles; so that such a pair meets in the
   region of the first shingle they share, A is replicated to its first |A|/4 + 1 pivots. Shingles of a single set
   make no region, and a set of which more than a quarter are such has no partner at all; few sets are left.
2. A pair whose first shared shingle is s shares no more than what either has from s on, so in the region of s a set has a
   window: the largest size a partner within EPS can have. Two members face each other if each one's size
   lies in the other's window. Unlike sets around a common passage don't face each other, however many they are,
   as the shingles that few others have come first in the order.
3. Of every region, one set is a pivot and compared with the members that it faces; those within EPS are linked to it.
   Pairs in one component are settled. In regions of up to CLOSE sets that face another component, the pairs that
   face each other across components are compared, each once for all regions.
4. Members of larger regions are dealt into blocks by their first region. A block is compared with itself, components
   are joined, and what still faces another component is compared with the blocks that share a region with its own, but for
   blocks of one and the same component. A set travels once per pair of blocks, however many regions and sets they share.

Sets that are equal are one point. Document frequencies come from all sets: shingles are dealt out by hash and
counted there, packed by the thousand; shingles of very many sets (bounded in number) are counted by sums of local
counts and aren't dealt out, so no bucket fills up with them.

Nothing is sampled and no region is cut. Links that aren't compared are those inside one component of the
links found; hence components are exact, and the links returned join all of each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.groups import components

from . import _common as c

WORDS = 5
NEED = 75  # linked when 100 * intersection >= NEED * union
CHUNK = 600_000  # shingles that a task packs together
CHUNK_TEXTS = 60_000
FREQUENT = 1 << 17  # a shingle is frequent when it makes up more than 1 / FREQUENT of all (twice that for certain)
CLOSE = 256  # regions of up to so many sets that face another component are compared in one go, larger ones in blocks of so many
COLUMNS = 8192  # shingles of a cell of blocks that are looked at together
TEAM = 256  # members that are compared with a pivot together

_U = np.uint64
_LOW = _U((1 << 48) - 1)
_state: dict = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    if "powers" not in _state or len(_state["powers"][0]) < n:
        base, size = 0x9E3779B97F4A7C15, max(1 << 20, n)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=_U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        _state["powers"] = both[0], both[1]
    return _state["powers"]


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: owner and hash, sorted by both.

    A to Z are lower-cased; words end at ASCII white space. A text of fewer words is one shingle; without words it
    has none. Hashes have 64 bits.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    begins = np.cumsum([1] + [len(r) + 1 for r in raw])
    with np.errstate(over="ignore"):
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        power, inverse = _powers(len(data) + 1)
        table = _mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))
        sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(table[data] * power[: len(data)], dtype=_U)])
        word = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U))
        owner = np.searchsorted(begins, start, side="right") - 1
        factors = _mix(np.arange(11, 11 + words, dtype=_U)) | _U(1)
        n = len(word)
        m = max(0, n - words + 1)
        h = np.zeros(m, dtype=_U)
        for k in range(words):
            h += word[k : k + m] * factors[k]
        whole = owner[:m] == owner[words - 1 : words - 1 + m]
        h, of = _mix(h[whole]), owner[:m][whole]
        counts = np.bincount(owner, minlength=len(texts))
        short = np.flatnonzero((counts > 0) & (counts < words))
        if len(short):
            first = np.searchsorted(owner, short)
            extra = _mix(counts[short].astype(_U) * _U(0xA0761D6478BD642F))
            for k in range(words - 1):
                has = counts[short] > k
                extra[has] += word[first[has] + k] * factors[k]
            h, of = np.concatenate([h, _mix(extra)]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


def _identities(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit sums of each set; zero for empty ones."""
    size = np.bincount(owner, minlength=n)
    out = []
    with np.errstate(over="ignore"):
        for seed in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
            total = np.zeros(n, dtype=_U)
            at = np.flatnonzero(size)
            if len(at):
                total[at] = np.add.reduceat(_mix(h ^ _U(seed)), np.concatenate([[0], np.cumsum(size[at])[:-1]]))
            out.append(total.view(np.int64))
    return size, out[0], out[1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of up to 128 rows and about 1 MB of text, or of one longer text."""
    for whole in batches:
        for k in range(0, whole.num_rows, 128):
            b = whole.slice(k, 128)
            texts = b.column("_text").to_pylist()
            at, size = 0, 0
            for i, t in enumerate(texts):
                if size + len(t) > 1_000_000 and i > at:
                    yield b.slice(at, i - at), texts[at:i]
                    at, size = i, 0
                size += len(t)
            yield b.slice(at), texts[at:]


def _chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Shingles of about CHUNK at a time: owner (from 0), hash, number of texts."""
    owners, hashes, n, size = [], [], 0, 0
    for _, texts in _texts(batches):
        for at in range(0, len(texts), CHUNK_TEXTS // 2):
            part = texts[at : at + CHUNK_TEXTS // 2]
            owner, h = shingles(part, words)
            if n and (size + len(h) > CHUNK or n + len(part) > CHUNK_TEXTS):
                yield np.concatenate(owners), np.concatenate(hashes), n
                owners, hashes, n, size = [], [], 0, 0
            owners.append(owner + n)
            hashes.append(h)
            n, size = n + len(part), size + len(h)
    if n:
        yield np.concatenate(owners), np.concatenate(hashes), n


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """Of rows with ``_text``: their other columns, n_shingles, f1, f2 (the set's identity); and, as rows with a
    ``shingle``, counts of shingles that make up more than 1 / FREQUENT of some part of the rows."""
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "n_shingles long, f1 long, f2 long, shingle long, times long"])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        seen: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate(seen), return_counts=True)
            often = times > max(1, times.sum() // FREQUENT)
            value, times = value[often], times[often]
            none = [pa.nulls(len(value), k) for k in kinds]
            return pa.RecordBatch.from_arrays([*none, *[pa.nulls(len(value), pa.int64())] * 3, pa.array(value.view(np.int64)), pa.array(times)], names=[*names, "n_shingles", "f1", "f2", "shingle", "times"])

        for b, texts in _texts(batches):
            kinds = [b.column(k).type for k in names]
            owner, h = shingles(texts, words)
            size, f1, f2 = _identities(owner, h, len(texts))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], pa.array(size, pa.int64()), pa.array(f1), pa.array(f2), *[pa.nulls(len(texts), pa.int64())] * 2], names=[*names, "n_shingles", "f1", "f2", "shingle", "times"])
            seen.append(h)
            if sum(map(len, seen)) > CHUNK:
                yield counted()
                seen = []
        if seen:
            yield counted()

    return rows.mapInArrow(run, schema)


_PARTS = "bucket int, chunk long, kind int, payload binary"


def _packed(rows: DataFrame, words: int, n_buckets: int, frequent: np.ndarray, times: np.ndarray) -> DataFrame:
    """Per chunk of texts and bucket: the shingles in it (kind 0); per chunk: its sets and their frequent shingles (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (owner, h, n) in enumerate(_chunks(batches, words)):
            chunk = (task << 18) + k
            size, f1, f2 = _identities(owner, h, n)
            bucket = ((h >> _U(32)) * _U(n_buckets) >> _U(32)).astype(np.int64)
            key = (h & _LOW) | (bucket.astype(_U) & _U(0xFFFF)) << _U(48)
            at = np.searchsorted(frequent, h)
            often = frequent[np.minimum(at, len(frequent) - 1)] == h if len(frequent) else np.zeros(len(h), dtype=bool)
            head = np.array([n, often.sum()], dtype="<u4").tobytes()
            body = [size.astype("<u4"), f1, f2, owner[often].astype("<u2"), key[often], times[at[often]].astype("<u4")]
            out = [(-1 - chunk % n_buckets, 1, head + b"".join(x.tobytes() for x in body))]
            owner, key, bucket = owner[~often], key[~often], bucket[~often]
            order = np.argsort(bucket, kind="stable")
            owner, key, bucket = owner[order].astype("<u2"), key[order], bucket[order]
            ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
            for a, z in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                low = np.ascontiguousarray(key[a:z]).view(np.uint8).reshape(-1, 8)[:, :6]
                out.append((int(bucket[a]), 0, owner[a:z].tobytes() + np.ascontiguousarray(low).tobytes()))
            for a in range(0, len(out), 4096):
                part = out[a : a + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], pa.int32()), pa.array([chunk] * len(part), pa.int64()), pa.array([x[1] for x in part], pa.int32()), pa.array([x[2] for x in part], pa.binary())],
                    names=["bucket", "chunk", "kind", "payload"],
                )

    return rows.select("_text").mapInArrow(run, _PARTS)


def _unpacked(payload: bytes, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) // 8
    full = np.zeros((n, 8), dtype=np.uint8)
    full[:, :6] = np.frombuffer(payload, dtype=np.uint8, offset=2 * n).reshape(n, 6)
    return np.frombuffer(payload, dtype="<u2", count=n), full.reshape(-1).view("<u8") | _U(bucket & 0xFFFF) << _U(48)


def _counted(group: pa.Table) -> pa.Table:
    """Of the parts of one bucket: per chunk, the shingles that other texts have as well, and in how many they are."""
    bucket = group.column("bucket")[0].as_py()
    if bucket < 0:
        return group.select(["chunk", "kind", "payload"])
    chunks = group.column("chunk").to_pylist()
    parts = [_unpacked(p, bucket) for p in group.column("payload").to_pylist()]
    which = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    owner, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    run = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] + _U(1)))
    length = np.diff(run, append=len(key))
    times = np.empty(len(key), dtype="<u4")
    times[order] = np.repeat(length, length)
    shared = np.flatnonzero(times > 1)
    which, owner, key, times = which[shared], owner[shared], key[shared], times[shared]
    ends = np.searchsorted(which, np.arange(len(parts)), side="right")
    out = [(chunks[i], owner[a:z].tobytes() + key[a:z].tobytes() + times[a:z].tobytes()) for i, (a, z) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)) if z > a]
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([0] * len(out), pa.int32()), "payload": pa.array([x[1] for x in out], pa.binary())})


def _candidates(need: int):
    """Of the parts of one chunk: the sets that may have a partner, with their shared shingles and their pivots."""

    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        owners, keys, counts = [], [], []
        size = f1 = f2 = None
        for kind, p in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist(), strict=True):
            at = 0
            if kind:
                n, m = np.frombuffer(p, dtype="<u4", count=2)
                size, f1, f2 = np.frombuffer(p, "<u4", n, 8), np.frombuffer(p, "<i8", n, 8 + 4 * n), np.frombuffer(p, "<i8", n, 8 + 12 * n)
                at = 8 + 20 * int(n)
            else:
                m = len(p) // 14
            m = int(m)
            owners.append(np.frombuffer(p, "<u2", m, at))
            keys.append(np.frombuffer(p, "<u8", m, at + 2 * m))
            counts.append(np.frombuffer(p, "<u4", m, at + 10 * m))
        owner, key, times = np.concatenate(owners), np.concatenate(keys), np.concatenate(counts)
        n = len(size)
        shared = np.bincount(owner, minlength=n)
        fits = (shared > 0) & (100 * shared >= need * size.astype(np.int64))
        mine = fits[owner]
        owner, key, times = owner[mine], key[mine], times[mine]
        order = np.lexsort((key, times, owner))
        ranked = key[order]
        order = np.lexsort((key, owner))
        sorted_ = key[order]
        at = np.flatnonzero(fits)
        ends = np.cumsum(shared[at])
        # The first pivots of a set are its own shingles that no other has; those need no region.
        reach = size[at] - -(-need * size[at].astype(np.int64) // 100) + 1 - (size[at] - shared[at])
        rows = [(sorted_[e - s : e].tobytes(), ranked[e - s : e - s + r].tobytes()) for e, s, r in zip(ends, shared[at], reach, strict=True)]
        return pa.table({
            "alone": pa.array((size - shared)[at].astype(np.int64)), "node": pa.array((chunk << 16) + at.astype(np.int64), pa.int64()), "n": pa.array(size[at].astype(np.int64)), "f1": pa.array(f1[at]), "f2": pa.array(f2[at]),
            "keys": pa.array([x[0] for x in rows], pa.binary()), "pivots": pa.array([x[1] for x in rows], pa.binary()),
        })

    return run


def _regions(need: int):
    """Rows of the outer regions; ``room`` is the largest size of a partner whose first shared shingle is the region's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(p, "<i8") for p in b.column("pivots").to_pylist()]
            if parts:
                lengths = np.array([len(p) for p in parts])
                node, n, alone = (np.repeat(b.column(k).to_numpy(zero_copy_only=False), lengths) for k in ("node", "n", "alone"))
                at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                room = (100 + need) * (n - alone - at) // need - n
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(node), pa.array(n), pa.array(room)], names=["region", "node", "n", "room"])

    return run


def _facing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by region, at most CLOSE each: the pairs that face each other and are of different components."""
    rest: list[np.ndarray] | None = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            new = [b.column(k).to_numpy(zero_copy_only=False) for k in ("region", "node", "n", "room", "comp")]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
        if rest is None or not len(rest[0]):
            continue
        # The last region of a batch may go on in the next one.
        end = int(np.flatnonzero(rest[0] != rest[0][-1])[-1] + 1) if b is not None and rest[0][0] != rest[0][-1] else 0 if b is not None else len(rest[0])
        region, node, n, room, comp = (x[:end] for x in rest)
        rest = [x[end:] for x in rest]
        cuts = np.flatnonzero(np.diff(region)) + 1
        low, high, size = [], [], 0
        for a, z in zip([0, *cuts], [*cuts, end], strict=True):
            meets = (n[a:z, None] <= room[a:z]) & (n[a:z] <= room[a:z, None]) & (comp[a:z, None] != comp[a:z])
            x, y = np.nonzero(np.triu(meets))
            low.append(np.minimum(node[a:z][x], node[a:z][y]))
            high.append(np.maximum(node[a:z][x], node[a:z][y]))
            size += len(x)
            if size > 100_000 or z == end:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(high)), pa.array(np.concatenate(low))], names=["node", "pivot"])
                low, high, size = [], [], 0


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pivot, team), the pivot itself first: intersections of its team with it."""
    pivot, own, n_own = None, None, 0
    for b in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for p, q, n, keys in zip(*[b.column(k).to_pylist() for k in ("pivot", "node", "n", "keys")], strict=True):
            keys = np.frombuffer(keys, "<u8")
            if q is None:
                pivot, own, n_own = p, keys, n
                continue
            if p != pivot:
                raise RuntimeError("a pivot's set is missing")
            at = np.searchsorted(own, keys)
            both = int((own[np.minimum(at, len(own) - 1)] == keys).sum())
            for column, v in zip(out, (q, p, both, n + n_own - both), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "pivot", "both", "either"])


def _distances(pairs: DataFrame, total: int, sets: DataFrame, need: int) -> DataFrame:
    """node, pivot, both, either, distance, linked of distinct pairs (node, pivot), at most ``total`` of them."""
    found = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("_n"))
    found = found.withColumn("_teams", F.ceil(F.col("_n") / F.lit(TEAM)))
    pairs = c.routed(pairs, found, ["pivot"], total, nulls=False).withColumn("team", F.pmod(F.xxhash64("node"), F.col("_teams")))
    members = pairs.select("pivot", "team", "node").join(sets, "node").select("pivot", "team", "node", "n", "keys")
    heads = found.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_teams") - 1)).alias("team"))
    heads = heads.join(sets.withColumnRenamed("node", "pivot"), "pivot").select("pivot", "team", F.lit(None).cast("long").alias("node"), "n", "keys")
    rows = members.unionByName(heads).repartition("pivot", "team").sortWithinPartitions("pivot", "team", F.col("node").asc_nulls_first())
    out = rows.mapInArrow(_compared, "node long, pivot long, both long, either long")
    linked = 100 * F.col("both") >= need * F.col("either")
    return c.save(out.withColumn("distance", 1 - F.col("both") / F.col("either")).withColumn("linked", linked), "distances")


def _crossed(need: int):
    """Of the members of a cell, one block (side 0) or two: the linked pairs of different components, each block against itself
    or the other one. Intersections are products of the sets' incidence, COLUMNS shingles at a time."""

    def run(cell: pa.Table) -> pa.Table:
        side, node, n, comp = (cell.column(k).to_numpy() for k in ("side", "node", "n", "comp"))
        keys = [np.frombuffer(k.as_py(), "<u8") for c in cell.column("keys").chunks for k in c]
        value, column = np.unique(np.concatenate(keys), return_inverse=True)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        one = bool((side == 0).all())
        x = np.flatnonzero(side == 0)
        y = x if one else np.flatnonzero(side == 1)
        both = np.zeros((len(x), len(y)), dtype=np.int64)
        for at in range(0, len(value), COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            has = np.zeros((len(keys), min(COLUMNS, len(value) - at)), dtype=np.float32)
            has[owner[lo:hi], column[lo:hi] - at] = 1
            both += np.rint(has[x] @ has[y].T).astype(np.int64)
        either = n[x][:, None] + n[y] - both
        linked = (100 * both >= need * either) & (comp[x][:, None] != comp[y])
        i, j = np.nonzero(np.triu(linked) if one else linked)
        out = [np.maximum(node[x][i], node[y][j]), np.minimum(node[x][i], node[y][j]), both[i, j], either[i, j]]
        return pa.table([pa.array(v.astype(np.int64)) for v in out], names=["node", "pivot", "both", "either"])

    return run


def _crossing(rows: DataFrame, sets: DataFrame, need: int, across: bool) -> DataFrame:
    """Links between the members of regions (region, node, n, room, comp), found block by block.

    Members are dealt into blocks of about CLOSE by their first region and, where many have the same, their component. A block is
    compared with itself or, if ``across``, with all blocks that share a region with it, but for blocks of one and the same
    component. A set travels once per pair of blocks, not per pair of sets or region.
    """
    total = rows.count()
    homes = rows.groupBy("node").agg(F.min("region").alias("home"), F.min("comp").alias("comp"), F.min("n").alias("n"))
    homes = c.save(homes, "homes")
    if across:
        found = homes.groupBy("home", "comp").agg(F.count(F.lit(1)).alias("_n"))
        found = found.withColumn("part", F.when(F.col("_n") >= CLOSE, F.col("comp")).otherwise(F.lit(-1)))
        homes = c.routed(homes, found, ["home", "comp"], total, nulls=False)
    else:
        homes = homes.withColumn("part", F.lit(-1).cast("long"))
    found = homes.groupBy("home", "part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / F.lit(CLOSE)))
    homes = c.routed(homes, found, ["home", "part"], total, nulls=False).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("_blocks")))
    homes = c.save(homes.select("node", "n", "comp", "home", "part", "block"), "homes")
    blocks = homes.select("home", "part", "block").distinct().withColumn("a", F.monotonically_increasing_id())
    blocks = c.save(blocks, "blocks")
    homes = c.save(homes.join(blocks, ["home", "part", "block"]).select("node", "n", "comp", "part", "a"), "homes")
    cells = blocks.where("part < 0").select("a", F.col("a").alias("b"))
    if across:
        there = rows.select("region", "node", "room").join(homes, "node").groupBy("region", "a", "part")
        there = c.save(there.agg(F.min("n").alias("least"), F.max("room").alias("most")), "there")
        other = there.select("region", F.col("a").alias("b"), F.col("part").alias("other"), F.col("least").alias("other_least"), F.col("most").alias("other_most"))
        faces = "a <= b and (part < 0 or part <> other) and least <= other_most and other_least <= most"
        cells = there.join(other, "region").where(faces).select("a", "b").distinct()
    cells = c.save(cells, "cells")
    sides = cells.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("at"))
    sides = sides.unionByName(cells.where("a <> b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("at")))
    members = c.save(sets.select("node", "keys").join(homes.select("node", "n", "comp", F.col("a").alias("at")), "node"), "members")
    both = sides.join(members, "at").select("a", "b", "side", "node", "n", "comp", "keys")
    return c.save(both.groupBy("a", "b").applyInArrow(_crossed(need), "node long, pivot long, both long, either long"), "links")


def _first_links(rows: DataFrame, sets: DataFrame, need: int) -> tuple[DataFrame, DataFrame]:
    """The rows that may face another one of their region, and the links of the members of each region to its pivot."""
    draw = F.struct(F.xxhash64("node").alias("h"), "node", F.col("n").alias("own"), F.col("room").alias("own_room"))
    ends = [F.min("n").alias("_least"), F.max("room").alias("_most"), F.sum("n").alias("_ns"), F.sum("room").alias("_rooms")]
    found = rows.groupBy("region").agg(F.count(F.lit(1)).alias("_n"), F.min(draw).alias("_p"), *ends).where("_n > 1")
    found = found.withColumn("_two", F.col("_n") == 2)
    # Of two members each sees the other one exactly, of more their bounds.
    other_n = F.when(F.col("_two"), F.col("_ns") - F.col("n")).otherwise(F.col("_least"))
    other_room = F.when(F.col("_two"), F.col("_rooms") - F.col("room")).otherwise(F.col("_most"))
    rows = c.routed(rows, found, ["region"], rows.count(), nulls=False)
    rows = rows.where((other_n <= F.col("room")) & (F.col("n") <= other_room))
    rows = c.save(rows.select("region", "node", "n", "room", F.col("_p.node").alias("pivot"), "_p.own", "_p.own_room"), "regions")
    met = rows.where("node <> pivot and n <= own_room and own <= room").select("node", "pivot").distinct()
    return rows.select("region", "node", "n", "room"), _links(met, sets, need)


def _links(pairs: DataFrame, sets: DataFrame, need: int) -> DataFrame:
    """node, pivot, both, either of the distinct pairs (node, pivot) that are linked."""
    pairs = c.save(pairs, "pairs")
    return _distances(pairs, pairs.count(), sets, need).where("linked").select("node", "pivot", "both", "either")


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows that may face another component, with the components of ``roots`` and ``_n``, their number in the region."""
    rows = rows.drop("comp").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    rows = c.save(rows, "regions")
    ends = rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("_n"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min("n").alias("_least"), F.max("room").alias("_most"),
    )
    rows = c.routed(rows, ends.where("_lo < _hi"), ["region"], rows.count(), nulls=False)
    rows = rows.where("_least <= room and n <= _most").select("region", "node", "n", "room", "comp")
    rows = c.save(rows, "regions")
    total = rows.count()
    ends = rows.groupBy("region").agg(F.count(F.lit(1)).alias("_n"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
    return c.save(c.routed(rows, ends.select("region", "_n", F.col("_n").alias("size")), ["region"], total, nulls=False), "regions")


def _roots(links: DataFrame) -> DataFrame:
    """node, root of every node on a link."""
    found = components(links.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    return c.save(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "roots")


@dataclass
class Join:
    """members: the kept columns, n_shingles, f1, f2 and component_id of every row. links: pairs of sets, as
    (f1, f2, other_f1, other_f2, both, either), that join each component."""

    members: DataFrame
    links: DataFrame


def jaccard_join(docs: DataFrame, words: int = WORDS, need: int = NEED, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> Join:
    """Components of documents linked by 100 * |A and B| >= need * |A or B|, A and B their sets of shingles.

    ``component_id`` is the smallest id that links lead to, the own one included; ids that are null are left out
    of that (null if there is no other). Equal sets are linked. Null, empty and blank texts have no set and stand
    alone. Rows that repeat an id are rows of their own. The table must come in the same order when it
    is read again (as files do). An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("_text"), docs[id_col].alias("id"), *[v.alias(k) for k, v in (keep or {}).items()])
    signed = c.save(signatures(rows, words), "signatures")
    sig = signed.where("n_shingles is not null").drop("shingle", "times")
    total, mass = sig.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    often = signed.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    often = often.where(F.col("times") * FREQUENT > (mass or 0)).collect()  # fewer than FREQUENT
    often.sort(key=lambda r: r["shingle"] % 2**64)
    frequent = np.array([r["shingle"] for r in often], dtype=np.int64).view(_U)
    times = np.array([r["times"] for r in often], dtype=np.int64)

    parts = _packed(rows, words, c.buckets(spark, 2), frequent, times)
    parts = parts.groupBy("bucket").applyInArrow(_counted, "chunk long, kind int, payload binary")
    found = parts.groupBy("chunk").applyInArrow(_candidates(need), "alone long, node long, n long, f1 long, f2 long, keys binary, pivots binary")
    found = c.save(found, "sets")
    points = c.save(found.groupBy("f1", "f2").agg(F.min("node").alias("node")), "points")
    inside = found.select("node", "n", "alone", "pivots").join(points.select("node"), "node", "left_semi")
    state = c.save(inside.mapInArrow(_regions(need), "region long, node long, n long, room long"), "regions")
    sets = found.select("node", "n", "keys")
    state, linked = _first_links(state, sets, need)
    # Blocks of large regions are first compared with themselves, which joins most near copies, then with each other.
    for across in (False, True):
        state = _open(state, _roots(linked))
        small = state.where(F.col("size") <= CLOSE).repartition("region").sortWithinPartitions("region")
        linked = linked.unionByName(_links(small.mapInArrow(_facing, "node long, pivot long").distinct(), sets, need))
        state = state.where(F.col("size") > CLOSE).drop("size")
        if state.isEmpty():
            break
        linked = linked.unionByName(_crossing(state, sets, need, across))
    by_set = sig.where("n_shingles > 0").groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("component_id"))
    roots = _roots(linked)
    placed = points.join(roots, "node").select("f1", "f2", "root")
    lowest = by_set.join(placed, ["f1", "f2"]).groupBy("root").agg(F.min("component_id").alias("_low"))
    placed = c.save(placed.join(lowest, "root").select("f1", "f2", "_low"), "roots")
    named = by_set.join(placed, ["f1", "f2"], "left").select("f1", "f2", "_n", F.coalesce("_low", "component_id").alias("component_id"))
    ends = points.select("node", "f1", "f2")
    out = linked.join(ends, "node").drop("node")
    out = out.join(ends.select(F.col("node").alias("pivot"), F.col("f1").alias("other_f1"), F.col("f2").alias("other_f2")), "pivot").drop("pivot")
    members = c.routed(sig.where("n_shingles > 0"), named, ["f1", "f2"], total, nulls=False)
    alone = sig.where("n_shingles = 0").withColumn("component_id", F.col("id"))
    return Join(members.unionByName(alone), out)


def representatives(docs: DataFrame, words: int = WORDS, need: int = NEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component (all rows without words, and without an id
    those alone in theirs), with all their columns. Of rows that repeat id and text all or none stay."""
    found = jaccard_join(docs, words, need, id_col, text_col, {"_md5": F.md5(docs[text_col])}).members
    stays = found.where(F.col("component_id").eqNullSafe(F.col("id"))).select(F.col("id").alias("_id"), "_md5").distinct()
    rows = docs.select(F.struct(*[docs[k] for k in docs.columns]).alias("_row"), docs[id_col].alias("_id"), F.md5(docs[text_col]).alias("_md5"))
    return c.join(rows, stays, ["_id", "_md5"], "left_semi").select("_row.*")
