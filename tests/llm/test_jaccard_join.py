import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import TEXTS
from tilewright.llm import jaccard_join as jj


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(rows):
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return Counter((i, len(sets[k]), low.get(find(k))) for k, (i, _) in enumerate(rows))


def result(docs):
    return Counter(tuple(r) for r in jj.jaccard_join(docs).members.select("id", "n_shingles", "component_id").collect())


def test_messy(messy):
    assert result(messy) == brute([r[:2] for r in TEXTS])


def corpus(n, seed):
    """Clusters of copies with more and more edits, chains at the threshold, and passages many texts share."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    passage = [word() for _ in range(60)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rnd.randrange(8, 120))]
        if rnd.random() < 0.3:
            base += passage
        for _ in range(rnd.choice([1, 1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(copy) // 25)):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy))
            if rnd.random() < 0.5:
                base = copy  # a chain: each like the one before
    return list(enumerate(out[:n]))


@pytest.mark.parametrize("frequent, close", [(1 << 17, 256), (50, 4)])
def test_equals_brute_force(spark, monkeypatch, frequent, close):
    rows = corpus(700, frequent)
    monkeypatch.setattr(jj, "FREQUENT", frequent)
    monkeypatch.setattr(jj, "CLOSE", close)  # larger regions go on by pivots and distances
    monkeypatch.setattr(jj, "CHUNK", 5000)
    monkeypatch.setattr(jj, "TEAM", 8)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()) == brute(rows)


@pytest.mark.parametrize("close", [256, 2])
def test_a_chain_whose_ends_are_pivots(spark, monkeypatch, close):
    """Only the middle pair joins two balls: neither of its ends is within reach of the other ball's pivot."""
    monkeypatch.setattr(jj, "CLOSE", close)
    rnd = random.Random(1)
    rows = []
    for _ in range(25):
        words = [f"c{rnd.randrange(10**6)}" for _ in range(60)]
        chain = []
        for k in range(6):
            chain.append(" ".join(words))
            words = words[:10 * k] + [f"d{rnd.randrange(10**6)}"] + words[10 * k + 1 :]
        rnd.shuffle(chain)
        rows += chain
    rows = list(enumerate(rows))
    want = brute(rows)
    assert 20 < len({k[2] for k in want}) < 60
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()) == want


def test_unlike_sets_around_one_passage_are_not_compared(spark, monkeypatch):
    """A passage takes up to 85 of 100 words of 2000 texts: all are candidates by their size alone, few are near."""
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(10**7)}"
    passage = [word() for _ in range(120)]
    rows = list(enumerate(" ".join([word() for _ in range(a)] + passage + [word() for _ in range(b)]) for a, b in ((rnd.randrange(12, 18), rnd.randrange(8, 18)) for _ in range(2000))))
    seen = []
    monkeypatch.setattr(jj, "_distances", lambda pairs, total, sets, need, real=jj._distances: seen.append(pairs.count()) or real(pairs, total, sets, need))
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()) == brute(rows)
    assert sum(seen) < 2 * len(rows)


def test_a_large_group_of_near_copies_travels_by_blocks(spark, monkeypatch):
    """Copies around the threshold in many components: their sets go to a few cells of blocks, not to every pair."""
    monkeypatch.setattr(jj, "CLOSE", 32)
    rnd = random.Random(3)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(300):
        copy = list(base)
        for at in rnd.sample(range(100), rnd.choice([0, 1, 2, 3, 4, 5])):
            copy[at] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    pairs, cells = [], []
    monkeypatch.setattr(jj, "_distances", lambda p, total, sets, need, real=jj._distances: pairs.append(p.count()) or real(p, total, sets, need))
    real = jj.c.save
    monkeypatch.setattr(jj.c, "save", lambda df, name: cells.append(df.count()) or real(df, name) if name == "cells" else real(df, name))
    want = brute(rows)
    assert len({k[2] for k in want}) > 5
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()) == want
    assert sum(pairs) < 4 * len(rows) and 0 < sum(cells) < len(rows)  # more than 60 pairs a set before


def test_links_hold_and_join_the_components(spark):
    rows = corpus(200, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).cache()
    join = jj.jaccard_join(docs)
    members = join.members.collect()
    sets = dict(zip([i for i, _ in rows], sets_of([t for _, t in rows]), strict=True))
    of = {(r.f1, r.f2): r for r in members}
    links = join.links.collect()
    assert links
    for r in links:
        a, b = of[r.f1, r.f2], of[r.other_f1, r.other_f2]
        assert len(sets[a.id] & sets[b.id]) == r.both and len(sets[a.id] | sets[b.id]) == r.either
        assert 100 * r.both >= 75 * r.either and a.component_id == b.component_id


def test_one_row_of_each_component(messy, empty):
    got = jj.representatives(messy)
    assert got.columns == messy.columns
    ids = Counter(r.doc_id for r in got.collect())
    # The null row of text "x y" has no id to stand for it, so both rows stay; repeated rows stay together.
    assert ids[9] == ids[2] == ids[10] == ids[7] == ids[8] == ids[12] == 0
    assert ids[6] == ids[11] == ids[13] == ids[14] == ids[3] == ids[4] == ids[5] == 1 and ids[1] == 3
    assert jj.representatives(empty).count() == 0


def test_shingle_hashes_follow_the_definition():
    texts = [t or "" for _, t, *_ in TEXTS] + ["\x0b\x0ca\x0bb", "ÄB c", "äb c", "a b c d e a b c d e", "é"]
    owner, h = jj.shingles(texts)
    sizes = np.bincount(owner, minlength=len(texts))
    want = sets_of(texts)
    assert [len(s) for s in want] == sizes.tolist()
    seen = {}
    for k, s in enumerate(want):
        seen.setdefault(frozenset(h[owner == k].tolist()), set()).add(s)
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len(set(want))
