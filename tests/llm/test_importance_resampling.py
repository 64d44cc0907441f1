"""Importance resampling against plain counting and sorting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import TEXTS
from tilewright.llm import importance_resampling as ir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def brute(rows, target, percent, longest, buckets, least, seed=2024):
    """Rows (id, n_features, weight, score, rank)."""
    all_of = [features(t, longest) for _, t in rows]
    s = Counter(x % buckets for _, f in all_of for x in f)
    t = Counter(x % buckets for text in target for x in features(text, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for (key, _), (words, f) in zip(rows, all_of, strict=True):
        gain = [math.floor(1000 * math.log((t[x % buckets] + 1) * (s_all + buckets) / ((s[x % buckets] + 1) * (t_all + buckets)))) for x in f]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return out


def outlined(rows):
    """Rows as a multiset; those equal in score and id may swap ranks, so ranks are listed apart."""
    return Counter(tuple(r[:4]) for r in rows), sorted((r[4], r[0] is None, r[0], r[3]) for r in rows if r[4] is not None)


@pytest.mark.parametrize("longest, percent, least", [(1, 50, 2), (2, 100, 0), (3, 10, 3), (1, 100, 10**6)])
def test_messy_rows(spark, messy, longest, percent, least):
    target = spark.createDataFrame([("The lazy dog SLEEPS near the stove",), (None,), ("",)], "text string")
    got = ir.resample(messy, target, percent, longest, 97, least).collect()
    want = brute([(i, t) for i, t, *_ in TEXTS], ["The lazy dog SLEEPS near the stove", None, ""], percent, longest, 97, least)
    assert outlined([list(r) for r in got]) == outlined(want)


def test_empty_tables(spark, messy, empty):
    assert ir.resample(empty, messy).count() == 0
    got = ir.resample(messy, empty, 50, least=1).collect()
    assert outlined([list(r) for r in got]) == outlined(brute([(i, t) for i, t, *_ in TEXTS], [], 50, 1, 10_000, 1))


@pytest.mark.parametrize("low, high", [(0, 5), (-3000, 70_000), (-(1 << 63), (1 << 63) - 1)])
def test_sorted_by_digits(spark, low, high, monkeypatch):
    monkeypatch.setattr(ir, "BLOCK_BITS", (5, 20))
    rng = np.random.default_rng(3)
    scores = rng.integers(-300, 3000, 3000)
    ids = [None if k % 97 == 0 else int(rng.integers(low, high, endpoint=True)) for k in range(3000)]
    rows = [(k, i, int(s)) for k, (i, s) in enumerate(zip(ids, scores, strict=True))]
    df = ir.c.save(spark.createDataFrame(rows, "k int, id long, score long").repartition(7), "test")
    got = {r.k: r["rank"] for r in ir.draw(df, 1000).collect()}
    want = sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or 0))[:1000]
    at = {r: k for k, r in got.items() if r}
    assert len(got) == 3000 and sorted(at) == list(range(1, 1001))
    assert [rows[at[k + 1]][1:] for k in range(1000)] == [w[1:] for w in want]


def test_a_third_of_equal_rows(spark):
    rows = [(7, "same words " * 15)] * 400 + [(k, f"word{k % 50} other " * 12) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("word1 word2 word3",)], "text string")
    got = ir.resample(docs, target, 30).collect()
    assert outlined([list(r) for r in got]) == outlined(brute(rows, ["word1 word2 word3"], 30, 1, 10_000, 20))


def test_ids_must_be_integers(spark):
    docs = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    with pytest.raises(TypeError):
        ir.resample(docs, docs)


def test_very_long_text(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "repeat('Long text ', 400000) AS text")
    got = ir.resample(docs, docs, 100).collect()
    assert [r.n_features for r in got] == [800_000] * 3 and sorted(r["rank"] for r in got) == [1, 2, 3]
