"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. The distinct blocks are sorted and numbered, so that every block has
an integer name; then adjacent names are paired and the distinct pairs are named in the same way, until every
document has one name. Two documents with the same number of blocks have the same last name exactly when all
their blocks are equal: names come from comparing texts, not from hashing them, so no collision is possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

BLOCK_CHARS = 4096
NOTHING = -(2**63)  # stands beside a last name without a neighbour; no name is as low
_RUNS = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"  # runs of white space other than one space


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per distinct (id, text): id, text_sha256, copies, n_blocks, name.

    (n_blocks, name) identifies the normalised text; ``copies`` counts repeated rows. A null text is the empty
    text, which is one empty block. A null id is an id like any other. Other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("_t"))
    n = F.greatest(F.lit(1), F.ceil(F.length("_t") / F.lit(block_chars))).cast("int")
    # White space only ever shrinks, so this is no less than the number of blocks.
    bound = F.greatest(F.lit(1), F.ceil(F.length(c.text_of(text_col)) / F.lit(block_chars)))
    total = docs.agg(F.sum(bound)).first()[0] or 0
    blocks = texts.select(
        "id", F.sha2("_t", 256).alias("text_sha256"), n.alias("n_blocks"),
        F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("_t", i * block_chars + 1, F.lit(block_chars)))).alias("pos", "block"),
    )
    row = ["id", "text_sha256", "n_blocks"]
    rows = c.named(blocks, ["block"], total, "name").groupBy(*row, "pos", "name").agg(F.count(F.lit(1)).alias("copies"))
    rows = c.save(rows, "blocks")
    longest = rows.agg(F.max("n_blocks")).first()[0] or 1
    left, done = 1, []
    while True:
        # After this many halvings one name is left of each document with at most ``left`` blocks.
        ended = (F.col("n_blocks") <= left) & (F.col("n_blocks") > left // 2)
        done.append(rows.where(ended).select(*row, "copies", "name"))
        if left >= longest:
            break
        rows = _halved(rows.where(F.col("n_blocks") > left), row)
        left *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _halved(rows: DataFrame, row: list[str]) -> DataFrame:
    """Names of adjacent pairs of names; a last name without a neighbour is paired with nothing."""
    even = F.col("pos") % 2 == 0
    pairs = rows.groupBy(*row, "copies", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NOTHING)).alias("b"),
    )
    pairs = c.save(pairs, "pairs")
    return c.save(c.named(pairs, ["a", "b"], pairs.count(), "name").drop("a", "b"), "names")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after white space is normalised. ``keep_id`` is the smallest id of the
    group (null only if all its ids are null), ``group_size`` its number of rows. One row of each group is kept:
    the one with that id, and of rows that repeat both id and text, one. An empty table gives no rows.
    """
    found = c.save(identities(docs, id_col, text_col, block_chars), "identities")
    out = c.attach(found, ["n_blocks", "name"], found.count(), keep_id=F.min("id"), group_size=F.sum("copies"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return out.select("id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns."""
    kept = exact_duplicates(docs, id_col, text_col, block_chars).where("kept").select(
        F.col("id").alias("_id"), F.col("text_sha256").alias("_sha")
    )
    rows = docs.select(F.struct(*[docs[k] for k in docs.columns]).alias("_row"), docs[id_col].alias("_id"), F.sha2(normalised(docs[text_col]), 256).alias("_sha"))
    rows = c.join(rows, kept, ["_id", "_sha"])
    # Repeated rows (same id, same text) all found the row that stays; one of them goes on.
    first = F.row_number().over(Window.partitionBy("_id", "_sha").orderBy(F.lit(0)))
    return rows.withColumn("_first", first).where("_first = 1").select("_row.*")
