"""Quality rules with risk-controlled thresholds, built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_SPACE, let, read_table, shared_table, text_of, words_of

WINDOW = 8

#: Rule -> cutoffs from lenient to strict; a document fails where its score is above the cutoff.
#: The grid is a parameter fixed beforehand, never taken from the labelled rows.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_rate": (4.0, 2.0, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15),
    "bang_rate": (4.0, 2.0, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15),
    "dup_line_rate": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeat_rate": (0.29, 0.27, 0.25, 0.23, 0.21, 0.19, 0.17, 0.15),
    "word_length": (60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0),
}
#: Values of the stratum column that may have cutoffs of their own, the largest ones; rows of all
#: other values, null included, are pooled in one more stratum.
MOST_STRATA = 1000
POOL = "other"


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in one text.

    Window hashes stay in the row: no shuffle.  Only texts that do have a
    repeated window sort their windows."""
    def covered(sorted_windows: Column) -> Column:
        def repeated(w, i):
            same = lambda j: F.coalesce(F.get(sorted_windows, j)["h"] == w["h"], F.lit(False))
            return same(i - 1) | same(i + 1)
        starts = F.sort_array(F.transform(F.filter(sorted_windows, repeated), lambda w: w["i"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    def of_windows(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(F.size(hashes) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, of_windows))


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang") -> DataFrame:
    """doc_id, value (of the stratum column), the counts of the contract, and the rules' scores."""
    raw = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"),
                      F.col(stratum_col).cast("string").alias("value"))
    raw = raw.withColumn("_w", words_of(F.col("_t")))
    raw = raw.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(NON_SPACE)))
    out = raw.select(
        "doc_id", "value", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_bangs"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        let(F.transform("_w", lambda w: F.xxhash64(w)), _repeat_words).alias("n_repeat_words"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    return out.select(
        "*", ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "n_words").alias("symbol_rate"), rate("n_bangs", "n_words").alias("bang_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("word_chars", "n_words").alias("word_length"))


def _binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), term by term in logarithms."""
    first = n * F.log1p(F.lit(-p))
    state = F.struct(first.alias("t"), F.exp(first).alias("s"))

    def step(a, i):
        t = a["t"] + F.log((n - i + 1).cast("double") / i) + F.log(F.lit(p / (1 - p)))
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, state, step, lambda a: a["s"])


def least_rows(strata: int, alpha: float, delta: float) -> int:
    """Good rows that a stratum needs for any cutoff, when no row of them is above it."""
    return math.ceil(math.log(delta / (len(RULES) * strata)) / math.log1p(-alpha / len(RULES)))


def own_strata(good: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(value): the values that are strata of their own, MOST_STRATA at most.  A
    value with too few labelled rows to admit any cutoff, were there as many strata as
    values, is pooled with the others instead; only counts decide, never scores."""
    counts = good.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    values = counts.count()
    enough = counts.where(F.col("n") >= least_rows(values + 1, alpha, delta))
    return enough.orderBy(F.desc("n"), "value").limit(MOST_STRATA).select("value")


def cutoffs(good: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(value, rule, level, cutoff, n, k) of the strictest admitted cutoffs; a
    null value is the pool of all rows that are in no stratum of their own.

    ``good`` holds the scores of labelled good documents that pass the base
    rules.  A cutoff is admitted if the exact binomial test rejects "its false
    rejection rate is above alpha / rules" at delta / (strata x rules)
    (Bonferroni over the strata that there are, the pool included); within a rule
    the levels are tested in the fixed order from lenient to strict and testing stops
    at the first failure, which needs no further correction.  So with probability
    1 - delta no stratum loses more than ``alpha`` of its good documents to the
    rules.  A stratum with fewer than ``least_rows`` good rows gets no cutoff (459
    for the pool alone, 619 beside four others); no labelled rows: no cutoffs."""
    own = own_strata(good, alpha, delta).collect()
    strata = len(own) + 1
    risk, level_delta = alpha / len(RULES), delta / (len(RULES) * strata)
    placed = good.withColumn("value", F.when(F.col("value").isin([r["value"] for r in own]), F.col("value")))
    counts = placed.groupBy("value").agg(F.count("*").alias("n"), *[
        F.count(F.when(F.col(r) > c, 1)).alias(f"{r}_{i}") for r, cs in RULES.items() for i, c in enumerate(cs)])
    known = good.sparkSession.createDataFrame([*own, (None,)], "value string")  # strata without a cutoff have a row too
    tests = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("level"), F.lit(c).alias("cutoff"),
                 F.col(f"{r}_{i}").alias("k")) for r, cs in RULES.items() for i, c in enumerate(cs)]))
    tested = counts.select("value", "n", tests.alias("x")).select("value", "n", "x.*")
    # above the mean the probability is far over delta: no need to sum it
    tested = tested.withColumn("ok", F.when(F.col("k") >= F.col("n") * risk, F.lit(False)).otherwise(
        _binomial_cdf(F.col("k"), F.col("n"), risk) <= level_delta))
    best = tested.groupBy("value", "rule").agg(
        F.min(F.when(~F.col("ok"), F.col("level"))).alias("stop"),
        F.collect_list(F.struct("level", "cutoff", "n", "k")).alias("xs"))  # as many as the grid has levels
    stop = F.coalesce("stop", F.lit(1 << 20))
    best = best.withColumn("x", F.array_max(F.filter("xs", lambda x: x["level"] < stop)))
    best = best.where("x is not null").select(F.col("value").alias("_v"), "rule", "x.*")
    return known.join(best, F.col("value").eqNullSafe(F.col("_v")), "left").drop("_v")


def judge(features: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``stratum`` and ``kept``.  ``limits`` has a row per stratum and rule,
    (MOST_STRATA + 1) x rules at most, and goes to every task as one row per stratum."""
    wide = limits.groupBy("value").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES])
    own = wide.where("value is not null").withColumnRenamed("value", "_own")
    pool = wide.where("value is null").select(F.struct(*[f"max_{r}" for r in RULES])).first()[0]
    out = features.join(F.broadcast(own), F.col("value") == F.col("_own"), "left")
    failed = F.col("base_failed")
    for r in RULES:
        limit = F.when(F.col("_own").isNotNull(), F.col(f"max_{r}")).otherwise(F.lit(pool[f"max_{r}"]).cast("double"))
        failed = failed | F.coalesce(F.col(r) > limit, F.lit(False))
    return (out.withColumn("stratum", F.coalesce("_own", F.lit(POOL))).withColumn("kept", ~failed)
            .drop("_own", *[f"max_{r}" for r in RULES]))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, stratum, kept.

    ``labels`` (doc_id, quality) marks held-out good documents by quality 1; no
    weight is fitted, so all of them calibrate.  Labels with null or several
    values for an id count once per (id, quality 1).  Null text has no words and
    fails the base rules; a null stratum is in the pool; an empty table gives
    an empty result.  Texts are never shuffled."""
    features = shared_table(base_features(docs, id_col, text_col, stratum_col), "quality")
    return judge(features, cutoffs(_labelled_good(features, labels), alpha, delta))


def _labelled_good(features: DataFrame, labels: DataFrame) -> DataFrame:
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    return features.where("not base_failed").join(good, F.col("doc_id") == F.col("_id"), "left_semi")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged.  The verdict is
    computed beside the row, so texts are not shuffled."""
    features = shared_table(base_features(docs, id_col, text_col, stratum_col), "quality")
    limits = cutoffs(_labelled_good(features, labels), alpha, delta)
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), F.col(stratum_col).alias("_stratum"))
    # a column that changes per row keeps the filter above the features; pushed
    # below, it would work them out again for every mention in the verdict
    scored = base_features(rows, "_row", "_text", "_stratum").withColumn("_fence", F.monotonically_increasing_id())
    return judge(scored, limits).where("kept and _fence >= 0").select("doc_id.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "stratum", "n_bangs", "n_lines")


def _oracle(documents: str = "documents", alpha: float = 0.05, delta: float = 0.05) -> str:
    risk = alpha / len(RULES)
    grid = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, cs in RULES.items() for i, c in enumerate(cs))
    scores = " UNION ALL ".join(f"SELECT doc_id, stratum, pooled, '{r}' AS rule, {r} AS score FROM g" for r in RULES)
    return rf"""
d AS (SELECT doc_id, lang AS value, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) > {WINDOW})),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM rep)
        GROUP BY doc_id),
b AS (SELECT w.doc_id, value, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!'))::BIGINT AS n_bangs,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
e AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_rate,
             CASE WHEN n_words > 0 THEN n_bangs::DOUBLE / n_words ELSE 0 END AS bang_rate,
             CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_rate,
             CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_rate,
             CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS word_length FROM b),
h AS (SELECT * FROM e WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
v AS (SELECT value, count(*) AS n FROM h WHERE value IS NOT NULL GROUP BY value),
own AS (SELECT value FROM v WHERE n >= ceil(ln({delta!r} / ({len(RULES)} * ((SELECT count(*) FROM v) + 1))) / ln(1 - {risk!r}))
        ORDER BY n DESC, value LIMIT {MOST_STRATA}),
f AS (SELECT e.*, coalesce(own.value, '{POOL}') AS stratum, own.value IS NULL AS pooled FROM e LEFT JOIN own ON e.value = own.value),
g AS (SELECT f.* FROM f JOIN h USING (doc_id)),
grid(rule, level, cutoff) AS (VALUES {grid}),
k AS (SELECT s.stratum, s.pooled, q.rule, q.level, q.cutoff, count(*) AS n, count(*) FILTER (WHERE s.score > q.cutoff) AS k
      FROM ({scores}) s JOIN grid q USING (rule) GROUP BY ALL),
ok AS (SELECT *, k < n * {risk!r} AND list_sum(list_transform(range(0, k + 1), lambda i:
         exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r}))))
         <= {delta!r} / ({len(RULES)} * ((SELECT count(*) FROM own) + 1)) AS ok FROM k),
lim AS (SELECT stratum, pooled, rule, min(cutoff) AS cutoff FROM (SELECT *, bool_and(ok) OVER (
          PARTITION BY stratum, pooled, rule ORDER BY level) AS admitted FROM ok) WHERE admitted GROUP BY ALL),
bad AS (SELECT DISTINCT f.doc_id FROM f JOIN lim ON f.stratum = lim.stratum AND f.pooled = lim.pooled AND
          CASE lim.rule {" ".join(f"WHEN '{r}' THEN {r}" for r in RULES)} END > lim.cutoff),
judged AS (SELECT f.*, NOT base_failed AND bad.doc_id IS NULL AS kept FROM f LEFT JOIN bad ON f.doc_id = bad.doc_id)
"""


#: CTEs of the pipeline's first stage: ``judged`` over ``documents``.
JUDGED_SQL = _oracle()

ORACLE = {
    "op6_quality_rules": f"""WITH {JUDGED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, n_bangs, n_lines
FROM judged"""}
