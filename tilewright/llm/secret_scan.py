"""Secrets by an incremental ledger of content-addressed blobs.

Every version of a file is a blob named by the SHA-256 of its text. The ledger has one row per (blob, rule, rule
version) that has been scanned, with the spans found. A scan reads only blobs that lack a row for a rule in its
present version, one copy of each; findings are then joined back to every path that holds the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

LEDGER = "blob string, rule string, version int, spans array<struct<start: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; matches that fail it are passed over."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in _compiled(self.pattern).finditer(text) if len(m[self.group]) >= self.least]


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16),  # a run that is too short hides no longer one
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
)
BASE = ("assign", "access", "hex")


def blobs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path and blob of every version; a null text is the empty blob."""
    return docs.select(F.col(id_col).alias("path"), F.sha2(c.text_of(text_col), 256).alias("blob"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob, path (one that holds it) and the places in ``rules`` still to be run on it."""
    todo = versions.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*[F.lit(i) for i in range(len(rules))])
    if ledger is None:
        return todo.withColumn("rules", every)
    known = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        known = F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), F.lit(i)).otherwise(known)
    done = ledger.withColumn("_k", known).where("_k is not null").groupBy("blob").agg(F.collect_set("_k").alias("_done"))
    todo = todo.join(done, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("_done", F.array().cast("array<int>"))))
    return todo.where(F.size("rules") > 0).drop("_done")


def scan(docs: DataFrame, todo: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows for the blobs in ``todo``, each read once."""
    rows = docs.select(F.col(id_col).alias("path"), F.sha2(c.text_of(text_col), 256).alias("blob"), c.text_of(text_col).alias("text"))
    rows = c.join(rows, todo, ["path", "blob"])
    rules = tuple(rules)
    kind = pa.list_(pa.struct([("k", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = [
                    [{"k": i, "spans": [{"start": s, "end": e} for s, e in rules[i].spans(text)]} for i in todo_]
                    for text, todo_ in zip(b.column("text").to_pylist(), b.column("rules").to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(found, kind)], names=["blob", "found"])

    found = rows.select("blob", "text", "rules").mapInArrow(run, "blob string, found array<struct<k: int, spans: array<struct<start: int, end: int>>>>")
    found = found.dropDuplicates(["blob"])  # rows that repeat both path and text were all read
    named = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    found = found.select("blob", F.explode("found").alias("f")).withColumn("r", F.get(named, F.col("f.k")))
    return found.select("blob", "r.rule", "r.version", "f.spans")


def update(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger after ``docs``: the old rows and one for each new (blob, rule, version)."""
    versions = c.save(blobs_of(docs, id_col, text_col), "versions")
    new = c.save(scan(docs, unseen(versions, ledger, rules), rules, id_col, text_col), "ledger")
    return new if ledger is None else ledger.select(*new.columns).unionByName(new)


def findings(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: path, blob, found (structs start, place of the rule in ``rules``, kind, end; sorted).

    A row whose blob the ledger lacks has null ``found``; without findings it is empty. Paths may be null or
    repeat; each row is reported. Spans are code points of the whole text, end exclusive.
    """
    place = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        place = F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), F.lit(i)).otherwise(place)
    rows = ledger.withColumn("place", place).where("place is not null")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place"), F.col("rule").alias("kind"), s["end"].alias("end")))
    by_blob = rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("found"))  # one row per rule
    versions = c.save(blobs_of(docs, id_col, text_col), "versions")
    counts = versions.groupBy("blob").agg(F.count(F.lit(1)).alias("_n")).join(by_blob, "blob", "left")
    return c.routed(versions, counts, ["blob"], versions.count())
