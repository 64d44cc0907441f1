"""Quality by robust multivariate outliers.

Each text is a vector of transformed statistics. Per language and source, the minimum-covariance-determinant estimate
(the mean and covariance of the three quarters of the rows that lie closest together) describes ordinary texts, of
which equal ones count once, so that copies can't make up the estimate they are judged by;
texts far from it by Mahalanobis distance are rejected, as are those that fail fixed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

MIN_WORDS = 50
SHARE = 0.75  # part of the rows whose covariance has the least determinant
CONSISTENT = 1.41  # fixed value: makes the covariance of that part that of all, for five normal statistics
CUTOFF = 60.0  # squared distance; normal statistics exceed it once in 10^11
STEPS = 3
MIN_GROUP = 60  # smaller groups are pooled by language
FLOORS = (0.5, 0.1, 0.25, 0.08, 0.08)  # least standard deviation of each statistic

_N = len(FLOORS)
_MEAN = [f"m{i}" for i in range(_N)]
_ROOT = [f"l{i}{j}" for i in range(_N) for j in range(i + 1)]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row, and ``keep``."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("_t"), *[v.alias(k) for k, v in (keep or {}).items()])
    rows = rows.withColumn("_w", F.filter(F.split("_t", c.SPACE), lambda x: x != ""))
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("n_words", F.size("_w").cast("long"))
    # Hashes of all windows of three words; most texts have no window twice and end here.
    rows = rows.withColumn("_h", F.expr("IF(n_words < 3, array(), transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"))
    rows = rows.withColumn("_again", F.expr("IF(size(array_distinct(_h)) = size(_h), cast(array() AS array<bigint>), _h)"))
    rows = rows.withColumn("_z", F.expr("array_sort(transform(_again, (x, i) -> struct(x, i)))"))
    # Windows that equal a neighbour in this order; each covers three words, less those that the next one begins with.
    rows = rows.withColumn("_p", F.expr(
        "array_sort(transform(filter(_z, (e, k) -> e.x = get(_z, k - 1).x OR e.x = get(_z, k + 1).x), e -> e.i))"
    ))
    repeated = F.expr("aggregate(_p, named_struct('n', 0L, 'to', -1), (s, i) -> named_struct('n', s.n + i + 3 - greatest(i, s.to), 'to', i + 3)).n")
    marks = F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))
    return rows.select(
        "id", *(keep or {}), "n_words", F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        marks.cast("long").alias("n_symbols"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), repeated.cast("long").alias("n_repeat_words"),
    )


def vector() -> list[Column]:
    """The statistics as they are compared: length, word length, symbols in a hundred, repeated lines and words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log1p("n_words"), F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / words,
    ]


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean, lower Cholesky root of the covariance (times ``factor``, with floors) and log determinant per key."""
    sums = [F.avg(f"x{i}").alias(_MEAN[i]) for i in range(_N)]
    products = [F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(_N) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*sums, *products)
    return _rooted(out, lambda i, j: (F.col(f"p{i}{j}") - F.col(_MEAN[i]) * F.col(_MEAN[j])) * factor, keys)


def _rooted(out: DataFrame, covariance, keys: list[str]) -> DataFrame:
    for i in range(_N):
        for j in range(i + 1):
            v = covariance(i, j)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            if i == j:
                # The floor is added to the variance; rounding can't make the rest negative by more than a trifle.
                out = out.withColumn(f"l{i}{i}", F.sqrt(F.greatest(v, F.lit(0.0)) + FLOORS[i] ** 2))
            else:
                out = out.withColumn(f"l{i}{j}", v / F.col(f"l{j}{j}"))
    det = sum((F.log(f"l{i}{i}") for i in range(_N)), F.lit(0.0))
    return out.select(*keys, *_MEAN, *_ROOT, det.alias("det"))


def _distance(rows: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance to the estimate beside them."""
    for i in range(_N):
        v = F.col(f"x{i}") - F.col(_MEAN[i])
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", v / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(_N)), F.lit(0.0))
    return rows.withColumn("d2", d2).drop(*_MEAN, *_ROOT, "det", *[f"y{i}" for i in range(_N)])


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimate per ``g`` of rows (g, id, x0 ..): g, mean, root, det.

    Two starts (medians and their deviations; all rows) are concentrated ``steps`` times: the rows closest
    by the last estimate give the next, which never has a larger determinant. The better end counts.
    """
    x = [f"x{i}" for i in range(_N)]
    middle = rows.groupBy("g").agg(*[F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(v) for v in x])
    middle = middle.select("g", *[F.element_at(v, 2).alias(m) for v, m in zip(x, _MEAN, strict=True)], *[((F.element_at(v, 3) - F.element_at(v, 1)) / 1.35).alias(f"s{i}") for i, v in enumerate(x)])
    spread = _rooted(middle, lambda i, j: F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0), ["g"])
    now = spread.withColumn("start", F.lit(0)).unionByName(_moments(rows, ["g"], 1.0).withColumn("start", F.lit(1)))
    both = rows.select("g", "id", *x).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    key = ["g", "start"]
    for _ in range(steps):
        near = _distance(c.lookup(both, c.save(now, "estimate"), key, ["id", "x0"]))
        limit = c.save(near.groupBy(*key).agg(F.percentile_approx("d2", SHARE, 2000).alias("limit")), "limit")
        near = c.lookup(near, limit, key, ["id", "x0"]).where(F.col("d2") <= F.col("limit"))
        now = _moments(near, key, CONSISTENT)
    best = now.groupBy("g").agg(F.min_by(F.struct(*_MEAN, *_ROOT, "det"), F.struct("det", "start")).alias("_e"))
    return best.select("g", "_e.*")


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF,
) -> DataFrame:
    """One row per row of ``docs``: id, the statistics, base_failed, distance2, kept.

    base_failed: under 50 words, or over half of the words in repeated windows of three. The others are kept
    unless their distance exceeds ``cutoff``. Groups of under MIN_GROUP rows are pooled by language; a null
    language or source is one of its own. A null or blank text has no words and fails. Estimates are made
    from rows that don't fail, equal texts of a group once; every row is judged. ``distance2`` is null where there is none. An empty table gives no rows.
    """
    rows = statistics(docs, id_col, text_col, {"lang": docs[lang_col].cast("string"), "source": docs[source_col].cast("string"), "h": F.xxhash64(docs[text_col])})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = c.save(rows.withColumn("base_failed", failed).withColumn("g", F.to_json(F.struct("lang", "source"))), "statistics")
    sizes = c.save(rows.where("not base_failed").groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_GROUP), "groups")
    rows = c.lookup(rows, sizes, ["g"], ["id", "word_chars"])
    rows = rows.withColumn("g", F.when(F.col("_n").isNotNull(), F.col("g")).otherwise(F.to_json(F.struct(F.lit(True).alias("pooled"), "lang")))).drop("_n")
    vectors = rows
    for i, v in enumerate(vector()):
        vectors = vectors.withColumn(f"x{i}", v)
    once = vectors.where("not base_failed").dropDuplicates(["g", "h", "n_words", "word_chars"]).select("g", "id", *[f"x{i}" for i in range(_N)])
    found = c.save(estimates(c.save(once, "once")), "estimates")
    out = _distance(c.lookup(vectors, found, ["g"], ["id", "word_chars"]))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("d2") > cutoff, F.lit(False))
    return out.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d2").alias("distance2"), kept.alias("kept"),
    )
