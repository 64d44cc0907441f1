"""Fill-in-the-middle against a plain loop over units."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import TEXTS
from tilewright.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, rate=50, spm=80, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return key, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_messy_rows(messy, empty):
    out = fim.fill_in_middle(messy, rate=90, spm=40)
    assert Counter(tuple(r) for r in out.collect()) == Counter(brute(i, t, 90, 40) for i, t, *_ in TEXTS)
    assert fim.fill_in_middle(empty).count() == 0


def test_every_form_can_be_undone(spark):
    odd = ["<", "<S", "a <P b> <M", " \t\n", "\x1c x \x85 y\xa0z", "héé  wörld ", "日本 語", "x", "  lead", "trail \n", "<S> is a mark", "a<P>b", "𝒳 𝒴\r\n𝒵"]
    rows = [(k, odd[k % len(odd)]) for k in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.fill_in_middle(docs, rate=95, spm=50).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = {r.id: r for r in out.collect()}
    assert all(got[k].back == t and tuple(got[k])[:-1] == brute(k, t, 95, 50) for k, t in rows)
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}
    assert all(r.form == "plain" for r in got.values() if "mark" in r.back or "a<P>b" in r.back)


@pytest.mark.parametrize("text", ["ab  c\n" * 5000, " " * 3000, "x" * 3000, "ab " * 999 + " " * 500 + "y", ""])
@pytest.mark.parametrize("window", [1, 7, 1000, 10**9])
def test_windows_end_where_units_end(text, window):
    if window == 1 and len(text) > 5000:
        text = text[:5000]
    at, want = 0, []
    for u in UNIT.findall(text):
        at += len(u)
        want.append(at)
    assert fim.unit_ends(text, window) == want


def test_very_long_texts(spark):
    docs = spark.range(2).selectExpr("id AS doc_id", "repeat(IF(id = 0, 'ab  ', 'x'), 3000000) AS text")
    out = fim.fill_in_middle(docs, rate=100)
    rows = {r.id: r for r in out.select("id", "n", F.length("output").alias("size")).collect()}
    assert rows[0].n == 3_000_001 and rows[0].size == 12_000_000 + 9 and rows[1].n == 1 and rows[1].size == 3_000_000 + 9
