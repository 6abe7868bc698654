"""Importance resampling towards a target's distribution of hashed n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import numbered
from .common import read_table, shared_table, text_of

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Halvings of the threshold's interval in one count job.
HALVINGS = 6

# Words are runs of ASCII letters (lower-cased), digits and bytes of other characters.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                    for b in range(256))


def word_list(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


def feature_buckets(words: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Buckets of all runs of 1 to ``longest`` words: a run's checksum goes on from
    the one of the run that is a word shorter."""
    found = last = list(map(zlib.crc32, words))
    later = [b" " + w for w in words]
    for n in range(1, min(longest, len(words))):
        last = list(map(zlib.crc32, later[n:], last))
        found = found + last
    return np.array(found, np.uint32) % np.uint32(buckets)


def _counts(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                total += np.bincount(feature_buckets(word_list(text.as_py()), buckets, longest), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])
    return run


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) over all texts: each task adds up its own rows, so at most
    ``buckets`` rows a task are shuffled."""
    tasks = docs.select(text_of(text_col).alias("text")).mapInArrow(_counts(buckets, longest), "bucket int, n bigint")
    return tasks.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    ratio = [((b + 1.0) * (s + k)) / ((a + 1.0) * (t + k)) for a, b in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _weigh(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = [], [], []
            for text in b.column(1):
                words = word_list(text.as_py())
                at = feature_buckets(words, len(gain), longest)
                n_words.append(len(words))
                n_features.append(len(at))
                weight.append(int(gain[at].sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]],
                ["doc_id", "n_words", "n_features", "weight"])
    return run


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the array of the buckets' gains is
    of fixed size and goes to every task."""
    def array(df: DataFrame, col: str) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, col, buckets, longest).collect():  # one row per bucket at most
            out[r["bucket"]] = r["n"]
        return out

    gain = gains(array(docs, text_col), array(target, target_text))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_weigh(gain, longest), f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint")


def gumbel_score(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """Weight plus a Gumbel draw made from the id, so that the highest scores are
    a draw without replacement in proportion to the weights' exponents."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def threshold(rows: DataFrame, value: str, wanted: int) -> tuple[int, int] | None:
    """The greatest v of an integer column with ``wanted`` rows or more at v or
    above, and the number of rows above v; None if there are fewer rows.

    Bisection by exact counts: a job counts the rows in the 2^HALVINGS equal parts
    of the interval that is left, which decides that many halvings at once, and
    the next job reads only rows of the part that holds the threshold."""
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < max(wanted, 1):
        return None
    above = 0
    while low < high:
        width = -(-(high - low + 1) // (1 << HALVINGS))
        part = F.expr(f"cast(cast({value} as decimal(20,0)) - ({low}) as decimal(20,0)) div cast({width} as decimal(20,0))")
        parts = rows.where(F.col(value).between(low, high)).groupBy(part.alias("part")).count()
        for r in sorted(parts.collect(), key=lambda r: -r["part"]):  # 2^HALVINGS rows
            if above + r["count"] >= wanted:
                low, high = low + r["part"] * width, min(high, low + (r["part"] + 1) * width - 1)
                break
            above += r["count"]
    return low, above


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of
    ``docs``; ``rank`` numbers the drawn ones, floor(percent * N / 100) of the N rows
    with at least ``min_words`` words, by falling score and rising id.

    1. Bucket counts of both tables; 2. weights through the array of gains, and
    scores, written once; 3. the score of the last drawn row by bisection over
    the written column, and, of the rows tied at it, the id in the same way;
    4. only the rows up to there are dealt into ranges and numbered.

    Null texts have no features (weight 0).  A null id draws as the empty id
    and comes after the others of its score; ids that are no integers are
    compared only among the tied rows, when those are numbered.  Of rows equal in
    score and id any may be the drawn ones, their number is exact.  An empty target
    gives every bucket a count of 0; an empty table gives an empty result.  Other
    columns are not read."""
    scored = weights(docs, target, id_col, text_col, target_text)
    scored = shared_table(scored.withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), seed)), "importance")
    able = scored.where(F.col("n_words") >= min_words)
    quota = percent * able.count() // 100
    found = threshold(able.select("score"), "score", quota) if quota else None
    if found is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    score, above = found
    drawn = F.col("score") > score
    tied = F.col("score") == score
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        # ~id falls where the id rises
        last = threshold(able.where(tied).select(F.bitwise_not(F.col("doc_id").cast("bigint")).alias("key")), "key", quota - above)
        tied = tied & (F.bitwise_not(F.col("doc_id").cast("bigint")) >= last[0]) if last else tied
    drawn = F.coalesce((F.col("n_words") >= min_words) & (drawn | tied), F.lit(False))
    ranked = numbered(scored.where(drawn), F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return ranked.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("bigint")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = {"op11_importance": r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), coalesce(text, '') FROM benchmark
), split AS (
  SELECT side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), grams AS (
  SELECT side, doc_id, unnest(w) AS f FROM split
  UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split
), per AS (
  SELECT side, doc_id, f, count(*) AS n FROM grams GROUP BY ALL
), remainders AS (
  SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)),
         lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc
), bytes AS (
  SELECT f, list_transform(range(0, strlen(f)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM per))
), buckets AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, b),
         lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) % 10000 AS bucket FROM bytes, remainders
), counted AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM per JOIN buckets USING (f) GROUP BY bucket
), totals AS (
  SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM counted
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000)
         / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM counted, totals
), weights AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * g) AS weight
  FROM per JOIN buckets USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
         CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
              / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (doc_id) WHERE side = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank
FROM placed
"""}
