"""Cost-balanced packing: exact round trip, no padding, the stated choice of sequences."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import TEXTS
from tilewright.llm import balanced_packing as bp

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def check(out, library, texts, tokens):
    """Every document is whole, sequences are gapless and padded nowhere."""
    found = defaultdict(Counter)  # pieces of equal ids may come from any of the rows with that id
    for r in out:
        ids = np.frombuffer(r.ids, dtype="<u2").tolist()
        assert len(ids) == r.length <= tokens and r.length & (r.length - 1) == 0
        at = 0
        for p in r.pieces:
            assert p.offset == at and p.length > 0
            found[p.id, p.doc_tokens][p.start, tuple(ids[at : at + p.length])] += 1
            at += p.length
        assert at == r.length
    assert len({r.sequence_id for r in out}) == len(out)
    want = defaultdict(list)
    for i, text in texts:
        ids = ids_of(library, text)
        want[i, len(ids)].append(ids)
    assert set(found) == set(want)
    for key, copies in want.items():
        covered = Counter()
        for (start, ids), n in found[key].items():
            assert any(tuple(c[start : start + len(ids)]) == ids for c in copies)
            covered.update({k: n for k in range(start, start + len(ids))})
        assert covered == Counter({k: len(copies) for k in range(key[1])})
    lengths = [r.length for r in out if r.length < tokens]
    assert len(lengths) == len(set(lengths))  # at most one short sequence of each power of two


def test_messy_rows(messy, empty, library):
    out = bp.pack(messy, PATH, 64).collect()
    check(out, library, [(i, t) for i, t, *_ in TEXTS], 64)
    assert bp.pack(empty, PATH).count() == 0 and bp.digests(bp.pack(empty, PATH), PATH).count() == 0


def test_several_steps(spark, library, monkeypatch):
    monkeypatch.setattr(bp, "GROUP", 12)
    rng = random.Random(5)
    texts = [(k % 40 or None, " ".join(rng.choices(["ab", "ünd", "12", "x.y", "long"], k=rng.randrange(90)))) for k in range(400)] + [(3, "same text")] * 200
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    out = bp.pack(docs, PATH, 128).collect()
    check(out, library, texts, 128)
    rows = bp.digests(bp.pack(docs, PATH, 128), PATH)
    assert rows.columns == ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_the_lowest_cost_with_room():
    cost = bp.Cost(1.0, 1.0)
    # 6 and 5 open two sequences; 4 goes to the cheaper one that has room; 3 fits into one only; the rest is cut
    assert bp.assign([5, 6, 3, 4], np.array([10, 8]), cost) == [(1, 0, 6, 0), (0, 0, 5, 1), (3, 0, 4, 0), (2, 0, 3, 1)]
    assert bp.assign([4, 4, 4], np.array([6, 6]), cost) == [(0, 0, 4, 0), (1, 0, 4, 1), (2, 0, 2, 0), (2, 2, 2, 1)]
    rng = random.Random(2)
    for _ in range(50):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 40))]
        full, left = divmod(sum(lengths), 40)
        room = np.array([40] * full + [left] * (left > 0))
        got = bp.assign(lengths, room, cost)
        filled = Counter()
        for _, _, n, s in got:
            filled[s] += n
        assert [filled[s] for s in range(len(room))] == room.tolist()
        # replay: each piece went to the cheapest sequence with room
        load, free = [0.0] * len(room), room.tolist()
        for k, at, n, s in got:
            fit = [x for x in range(len(room)) if free[x] >= lengths[k] - at] or [x for x in range(len(room)) if free[x]]
            assert s == min(fit, key=lambda x: (load[x], x))
            free[s] -= n
            load[s] += cost.of(n)


def test_balance(spark):
    """Sequences of several pieces cost nearly the same."""
    rng = random.Random(8)
    texts = [(k, "word " * rng.randrange(1, 400)) for k in range(900)]
    out = bp.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH, 512).collect()
    costs = [sum(bp.Cost(0, 1).of(p.length) for p in r.pieces) for r in out if r.length == 512 and len(r.pieces) > 1]
    assert len(costs) > 100 and np.std(costs) < 0.2 * np.mean(costs)


def test_ids_are_the_librarys(library):
    own = bp.ByteTokenizer(PATH)
    rng = random.Random(1)
    texts = ["a <|endoftext|> b<|endoftext|>", "it's I'LL can't!!!", "ΑΣ ςİ é  x y\x1c\x85", "   \n\n  \t x  ", "中文。 日本!", "\x00\x01", "x" * 3000, " " * 3000, "𝒳​　a"]
    texts += ["".join(rng.choices("aab cdeinrst'-., \n0159éß中", k=rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        assert own.encode(text).tolist() == ids_of(library, text)


def test_very_long_text(spark, library):
    text = "some words and 12345 numbers, \n" * 40_000
    docs = spark.createDataFrame([(1, text), (2, "z" * 300_000)], "doc_id long, text string")
    out = bp.digests(bp.pack(docs, PATH), PATH).groupBy("id").sum("length").collect()
    assert {r[0]: r[1] for r in out} == {1: len(ids_of(library, text)), 2: len(ids_of(library, "z" * 300_000))}
