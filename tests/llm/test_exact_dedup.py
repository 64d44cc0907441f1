import hashlib
import re
from collections import Counter, defaultdict

from tests.llm.conftest import TEXTS
from tilewright.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out[i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_equals_brute_force_at_any_block_size(messy):
    want = brute([r[:2] for r in TEXTS])
    for size in (4096, 7, 64):
        got = exact_dedup.exact_duplicates(messy, block_chars=size)
        assert Counter(tuple(r) for r in got.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want


def test_kept_rows_with_all_columns(messy):
    got = exact_dedup.without_duplicates(messy)
    assert got.columns == messy.columns
    kept = Counter(k[4] for k, n in brute([r[:2] for r in TEXTS]).items() if k[3] for _ in range(n))
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert Counter(sha(r.text) for r in got.collect()) == kept
    assert {r._row for r in got.collect()} == {"r"}


def test_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, repeat('same ', 2000), concat(repeat('other ', 1500), id)) AS text")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert Counter(r.group_size for r in got) == {1000: 1000, 1: 2000}
    assert sum(r.kept for r in got) == 2001


def test_empty(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.without_duplicates(empty).count() == 0
