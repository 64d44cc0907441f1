"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound as the product of its letters' vectors, the first
rotated by two places, the second by one. A text is the bundle (sum) of its trigrams, a language the bundle of its
texts; a text is given the language whose prototype has the largest cosine with it. Letters are lower-cased, all
else is a word border; letters of any script have vectors, which follow from their code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 2048
CHUNK = 512  # texts that are counted together
SHARPNESS = 12.0
NONE = "und"

_state: dict = {}


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if "letters" not in _state:
        _state["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _state["letters"]


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Rows of +1 and -1; the border (0) has one as well."""
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.unpackbits(x.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of texts: code points of its distinct trigrams (n, 3), and for every letter its trigram and its text."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    letter = _letters()[points]
    before = np.empty_like(letter)
    before[0], before[1:] = True, letter[:-1]
    kept = np.flatnonzero(letter | before)  # one border for each run of others
    codes = np.where(letter[kept], points[kept], 0)
    present = np.zeros(0x110000, dtype=bool)
    present[codes] = True
    present[0] = True
    alphabet = np.flatnonzero(present)
    place = np.zeros(0x110000, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    ids, n = place[codes], len(alphabet)
    middle = np.flatnonzero(codes)
    tri = (ids[middle - 1] * n + ids[middle]) * n + ids[middle + 1]
    if n**3 <= 1 << 23:
        flag = np.zeros(n**3, dtype=bool)
        flag[tri] = True
        distinct = np.flatnonzero(flag)
        where = np.zeros(n**3, dtype=np.int32)
        where[distinct] = np.arange(len(distinct))
        which = where[tri]
    else:
        distinct, which = np.unique(tri, return_inverse=True)
    parts = np.stack([distinct // (n * n), distinct // n % n, distinct % n], axis=1)
    # owner starts at the border before the first text
    return alphabet[parts], which, owner[kept[middle] - 1]


def bound(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Vectors of trigrams given by code points (n, 3)."""
    alphabet, at = np.unique(points, return_inverse=True)
    at, v = at.reshape(points.shape), letter_vectors(alphabet, dim)
    return np.roll(v, 2, axis=1)[at[:, 0]] * np.roll(v, 1, axis=1)[at[:, 1]] * v[at[:, 2]]


@dataclass
class Model:
    languages: list[str]
    prototypes: np.ndarray  # (dim, languages), centred, of length 1

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        points, which, owner = trigrams(texts)
        counts = np.bincount(owner, minlength=len(texts))
        if not len(which) or not self.languages:
            return [NONE] * len(texts), [0.0] * len(texts)
        similar = np.concatenate([bound(points[i : i + 2048]).astype(np.float32) @ self.prototypes for i in range(0, len(points), 2048)])
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        sums = np.add.reduceat(similar[which].astype(np.float64), starts, axis=0)
        # Length of the bundle: trigram vectors are all but orthogonal, so it is the root of dim * sum of squared counts.
        pair, n = np.unique(owner.astype(np.int64) * len(points) + which, return_counts=True)
        squares = np.bincount(pair // len(points), weights=n.astype(np.float64) ** 2, minlength=len(texts))
        cosine = np.zeros((len(texts), len(self.languages)))
        cosine[owner[starts]] = sums
        cosine /= np.sqrt(np.maximum(squares, 1) * DIM)[:, None]
        best = cosine.argmax(axis=1)
        share = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
        score = share.max(axis=1) / share.sum(axis=1)
        return (
            [self.languages[b] if n else NONE for b, n in zip(best, counts, strict=True)],
            [round(float(s), 6) if n else 0.0 for s, n in zip(score, counts, strict=True)],
        )


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Prototypes of all languages in ``lang_col`` from all rows that have one and a text.

    Each partition bundles its texts; per language and dimension the sums are added up by Spark, so the driver
    gets one vector per language. Counts are whole numbers, so the model doesn't depend on their order.
    """
    rows = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[lang_col].alias("lang"), docs[text_col].alias("text"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
                points, which, owner = trigrams(texts)
                if not len(which):
                    continue
                names = sorted(set(langs))
                of = np.array([names.index(x) for x in langs])
                counts = np.bincount(of[owner] * len(points) + which, minlength=len(names) * len(points)).reshape(len(names), -1)
                total = np.zeros((len(names), DIM))
                for i in range(0, len(points), 2048):
                    total += counts[:, i : i + 2048].astype(np.float64) @ bound(points[i : i + 2048]).astype(np.float64)
                for k, v in zip(names, total, strict=True):
                    sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.round().astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"]
        )

    parts = rows.mapInArrow(bundle, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("d", "x"))
    found = parts.groupBy("lang", "d").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).collect()
    found.sort(key=lambda r: r["lang"])
    if not found:
        return Model([], np.zeros((DIM, 0), dtype=np.float32))
    p = np.array([[e["x"] for e in r["v"]] for r in found], dtype=np.float64)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1)
    if len(p) > 1:
        p -= p.mean(axis=0)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    return Model([r["lang"] for r in found], p.T.astype(np.float32))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` (name: column) of ``docs``, and lang_pred and score (0 to 1: its share of all languages).

    Text that is null or has no letter: ``und``, score 0; likewise all of it if the model knows no language.
    Ties go to the language first in order.
    """
    keep = keep or {}
    rows = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("_text"), *[v.alias(k) for k, v in keep.items()])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]], "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                lang, score = model.predict(b.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[1:], "lang_pred", "score"]
                )

    return rows.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """Documents kept out of the fit: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``, with all their columns."""
    whole = F.struct(*[docs[k] for k in docs.columns])
    return identify(docs, model, text_col, {"_row": whole}).where((F.col("lang_pred") != NONE) & (F.col("score") >= least)).select("_row.*")
