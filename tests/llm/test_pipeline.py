"""The pipeline against a brute-force version of each stage, on what the stage before has kept."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.test_jaccard_join import brute as near
from tests.llm.test_others import laid_out
from tilewright.llm import _common, language_id, mixing, packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def stages(spark):
    docs = _common.table(spark, SF_DIR, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(_common.save(stage(spark, out[-1], SF_DIR), f"test-{name}"))
    return out


def rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_stage(stages):
    model = language_id.fit(stages[0])
    all_rows = stages[0].collect()
    lang, score = model.predict([r.text or "" for r in all_rows])
    kept = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r, p, s in zip(all_rows, lang, score, strict=True) if p != "und" and s >= 0.3)
    assert rows(stages[1]) == kept


def test_exact_stage(stages):
    first = {}
    for r in sorted(rows(stages[1])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    assert rows(stages[2]) == Counter(first.values())


def test_near_stage(stages):
    before = rows(stages[2])
    stays = {i for i, _, component in near([r[:2] for r in before]) if i == component}
    assert rows(stages[3]) == Counter({r: n for r, n in before.items() if r[0] in stays})


def test_mixing_stage(stages):
    assert rows(stages[4]) == rows(stages[3])


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for (i, text, *_), times in rows(stages[4]).items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, n, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += times
    got = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = laid_out(got)
    assert len(bins) <= 1.01 * sum(r.length for r in got) / 4096 + 1


def test_mixed_files_keep_the_order(spark, stages):
    # Documents of one source keep their order, and sources alternate, when the files are read in name order.
    seen = defaultdict(int)
    for r in stages[4].select("source").collect():
        seen[r.source] += 1
    assert sum(seen.values()) == stages[3].count()


def test_mixed_order_reaches_the_sequences(spark, stages, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    mix = mixing.mix(stages[3], seed=17).orderBy("slot", "place").collect()
    at = {r.id: n for n, r in enumerate(mix)}
    assert len(at) == len(mix) > 100

    def bins(docs):
        out = defaultdict(list)
        for r in corpus_pipeline.pack_sequences(spark, docs, SF_DIR).collect():
            out[r.sequence_id].append((r.offset, at[r.doc_id], r.piece))
        return [[x[1:] for x in sorted(out[k])] for k in sorted(out)]

    got = bins(stages[4])
    # Sequences, and the pieces inside them, stand in mixed order ...
    assert [b[0] for b in got] == sorted(b[0] for b in got) and all(b == sorted(b) for b in got)
    # ... many are made of neighbours only, and without the mixing stage all this is lost.
    span = lambda b: max(b)[0] - min(b)[0]
    near = lambda all_bins: sum(span(b) < 20 for b in all_bins if len(b) > 1) / sum(len(b) > 1 for b in all_bins)
    skipped = bins(stages[3])
    assert near(got) > near(skipped)
    assert [b[0] for b in skipped] != sorted(b[0] for b in skipped)
    assert set(map(tuple, got)) != set(map(tuple, skipped))
