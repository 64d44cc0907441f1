"""The registered queries of the corpus operators, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balanced_packing, exact_dedup, fill_in_middle, importance_resampling, jaccard_join, language_id, line_dedup, mixing, packing, pii, quality, secret_scan, sharding
from ._common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


@query("op1_exact_dedup", r"""
    with t as (
        select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
    select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
        doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256 from t""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in one of 24 shards; law `rows`."""
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=24, seed=17)
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position",
    )


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the slot of its block in the mixed sequence."""
    return mixing.mix(table(spark, sf_dir, "documents"), seed=17).withColumnRenamed("id", "doc_id")


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without its host's boilerplate lines."""
    return line_dedup.line_dedup(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens, read off the whole sequences."""
    import public_tokenizers

    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), coded=True)
    return packing.digests(packing.sequences(packing.pack(parts))).withColumnRenamed("id", "doc_id")


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by a ledger that starts empty."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.findings(docs, secret_scan.update(docs))
    listed = "transform({}, s -> concat_ws(':', s.kind, s.start, s.end))"
    base = f"filter(found, s -> s.kind IN {secret_scan.BASE})"
    return found.select(
        F.col("path").alias("doc_id"), *[F.expr(f"bigint(size(filter(found, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(F.array_join(F.expr(listed.format(base)), ","), 256).alias("base_sha256"), F.array_join(F.expr(listed.format("found")), ",").alias("spans"), "blob",
    )


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of them is kept out of the fit."""
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~out))
    return language_id.identify(docs, model, keep={"doc_id": docs["doc_id"], "held_out": out})


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced."""
    out = pii.pseudonymize(table(spark, sf_dir, "documents"), key="tilewright")
    return out.select(F.col("id").alias("doc_id"), "text", "n_entities", F.to_json("kinds").alias("kinds"))


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component that near-duplicate links lead to."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).members.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op11_fill_in_middle", r"""
    with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
    u as (
        select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
            ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
    v as (
        select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
            case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
                when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
    w as (
        select doc_id, n, form, text, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m,
            array_to_string(units[b + 1:n], '') as s from v)
    select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
        sha256(text) as restored_sha256 from w""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cuts, and checksums of its output and of the text made of that again."""
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


@query("op12_importance_resampling", r"""
    with bits as (
        select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as crc
        from (select range as i from range(256)) q),
    d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
    b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
    dw as (select doc_id, unnest(words) as word from d),
    dc as (select doc_id, word, count(*) as n from dw group by all),
    bc as (select word, count(*) as n from (select unnest(words) as word from b) q group by all),
    hashed as (
        select word, xor(list_reduce(list_prepend(4294967295, [('0x' || hex(encode(word))[2 * k - 1:2 * k])::bigint for k in range(1, octet_length(encode(word)) + 1)]),
            lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
        from (select word from dc union select word from bc) q, bits),
    s as (select bucket, sum(n) as s from dc join hashed using (word) group by all),
    t as (select bucket, sum(n) as t from bc join hashed using (word) group by all),
    g as (
        select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + 10000)::double
            / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double)))::bigint as gain
        from s full join t using (bucket)),
    w as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight from dc join hashed using (word) join g using (bucket) group by all),
    x as (
        select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || sha256('2024:' || doc_id)[1:8])::bigint as h
        from documents left join w using (doc_id)),
    y as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296)))::bigint as score from x),
    z as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) filter (n_features >= 20) over () as n from y)
    select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from z""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark texts and its rank among those drawn."""
    out = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


@query("op13_balanced_packing")
def op13_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens, read off the whole sequences."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return balanced_packing.digests(balanced_packing.pack(table(spark, sf_dir, "documents"), path), path).withColumnRenamed("id", "doc_id")
