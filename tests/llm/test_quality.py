import math
import random

import numpy as np

from tests.llm.conftest import TEXTS
from tilewright.llm import quality


def words_of(text):
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]


def brute(text):
    w = words_of(text)
    text = text or ""
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    twice = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    lines, seen, dup = [x for x in text.split("\n") if words_of(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(w)
    failed = n < 50 or 100 * len(twice) > 50 * n
    return n, sum(map(len, w)), sum(text.count(ch) for ch in "#*$%&|<>"), dup, len(twice), failed


def test_statistics(spark, messy):
    extra = ["a b c a b c a b c", "a a a a a", "x\ny\nx\n\nx \nx", "|a| #b *** <c> %&$", "a b c d a b c", "\x0ba\x0cb\x1cc d", "p q r " * 40, "é😀 x\t\ny"]
    docs = messy.select("doc_id", "text", "lang", "source", "id", "g", "kept").unionByName(
        spark.createDataFrame([(100 + i, t, None, "z", 1, "g", True) for i, t in enumerate(extra)], "doc_id long, text string, lang string, source string, id long, g string, kept boolean")
    )
    got = quality.quality(docs).collect()
    rows = [r[:2] for r in TEXTS] + [(100 + i, t) for i, t in enumerate(extra)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=key) == sorted([(i, *brute(t)) for i, t in rows], key=key)
    assert not any(r.kept and r.base_failed for r in got)


def test_outliers_of_their_group_go(spark):
    rnd = random.Random(4)
    prose = lambda n, k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, k))) for _ in range(n))
    rows = [(i, prose(rnd.randrange(60, 400), 9), "en", "s0" if i % 3 else "s1") for i in range(400)]
    bad = [(1000 + i, prose(200, 9).replace(" ", "*** "), "en", "s0") for i in range(40)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string").repartition(4).cache()
    got = {r.id: r for r in quality.quality(docs).collect()}
    assert not any(r.kept for i, r in got.items() if i >= 1000)
    assert all(r.kept for i, r in got.items() if i < 1000)
    # The distance is that to the mean and root of the group's estimate.
    vectors = docs.where("source = 's1'")
    stat = quality.statistics(vectors).withColumn("g", quality.F.lit("x"))
    for i, v in enumerate(quality.vector()):
        stat = stat.withColumn(f"x{i}", v)
    e = quality.estimates(stat).first()
    root = np.array([[e[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    mean = np.array([e[f"m{i}"] for i in range(5)])
    x = {r.id: np.array([r[f"x{i}"] for i in range(5)]) for r in stat.collect()}
    d2 = {i: float(np.sum(np.linalg.solve(root, v - mean) ** 2)) for i, v in x.items()}
    assert all(math.isclose(got[i].distance2, d, rel_tol=1e-6, abs_tol=1e-9) for i, d in d2.items())
    # It is a covariance of the closest three quarters, floors included.
    near = np.array([x[i] for i in sorted(d2, key=d2.get)[: int(0.75 * len(d2))]])
    cov = np.cov(near.T, bias=True) * quality.CONSISTENT + np.diag(np.square(quality.FLOORS))
    assert np.allclose(root @ root.T, cov, rtol=0.1, atol=0.02)


def test_copies_of_one_outlier_do_not_hide_it(spark):
    rnd = random.Random(5)
    prose = lambda n, k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, k))) for _ in range(n))
    rows = [(i, prose(rnd.randrange(60, 400), 9), "en", "s") for i in range(200)]
    junk = prose(200, 9).replace(" ", "*** ")
    bad = [(1000 + i, junk, "en", "s") for i in range(100)] + [(2000 + i, prose(200, 9).replace(" ", "#*** "), "en", "s") for i in range(5)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.id: r.kept for r in quality.quality(docs).collect()}
    assert len(got) == 305 and got == {i: i < 1000 for i in got}


def test_empty(empty):
    assert quality.quality(empty).count() == 0
