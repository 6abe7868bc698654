"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, flag_sketched, key_sketch, read_table, shared_table, text_of


def normalised(column) -> F.Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(text_of(column), SPACE_RUN, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_chars: int = 128, digest_all: bool = False) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs``.

    1. lengths that occur twice, 2. among those (length, prefix hash) pairs that
    occur twice, 3. among those the SHA-256 of the whole text.  The outcome of
    steps 1 and 2 travels as a sketch of fixed size, so texts are never shuffled
    and only rows that may have a copy are hashed in full; a false positive of a
    sketch costs one more hash and cannot change the result.  Groups are
    pre-aggregated per (hash, id) before the shuffle; the join back to a hot
    group's rows is split by adaptive execution.

    The smallest id stays; null ids sort last (a group of null ids keeps one
    row).  Rows that repeat id and text count in ``group_size`` and all but one
    are dropped.  Null texts are empty texts; empty texts equal each other.
    ``text_sha256`` is null for rows found unique before the full hash, unless
    ``digest_all`` asks for it.  An empty table gives an empty result; other
    columns are not read."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("_t"))
    texts = texts.withColumn("_n", F.xxhash64(F.length("_t")))
    texts = texts.withColumn("_p", F.xxhash64("_n", F.substring("_t", 1, prefix_chars)))
    keys = shared_table(texts.select("_n", "_p"), "exact-keys")
    lengths = keys.groupBy("_n").agg(F.count("*").alias("c")).where("c > 1")
    pairs = (flag_sketched(keys, "_n", key_sketch(lengths, "_n"), "_len").where("_len")
             .groupBy("_p").agg(F.count("*").alias("c")).where("c > 1"))
    digest = F.sha2("_t", 256)
    if not digest_all:
        digest = F.when(F.col("_may"), digest)
    hashed = shared_table(flag_sketched(texts, "_p", key_sketch(pairs, "_p"), "_may")
                          .select("doc_id", "_may", digest.alias("text_sha256")), "exact-hashes")
    single = hashed.where(~F.col("_may")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    members = hashed.where("_may").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("_rows"))
    # written, so that adaptive execution can split the join of a hot group
    groups = shared_table(members.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.sum("_rows").alias("group_size")), "exact-groups")
    grouped = (shared_table(members, "exact-members").join(groups, "text_sha256")
               .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
               .select("doc_id", "keep_id", "group_size",
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
                       "text_sha256"))
    return single.unionByName(grouped)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    Rows are matched to the decisions by id and text hash; a row that repeats
    id and text is kept once.  Only rows that a fixed-size sketch of the
    decisions flags are shuffled."""
    def key(id_, sha):
        return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), sha)

    gone = (exact_groups(docs, id_col, text_col).where("not kept")
            .select(key(F.col("doc_id"), F.col("text_sha256")).alias("_key"),
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("_once")).distinct())
    gone = shared_table(gone, "exact-dropped")
    rows = docs.select(F.struct("*").alias("_row"),
                       key(F.col(id_col), F.sha2(normalised(text_col), 256)).alias("_key"))
    rows = rows.withColumn("_h", F.xxhash64("_key"))
    rows = flag_sketched(rows, "_h", key_sketch(gone.select(F.xxhash64("_key").alias("_h")), "_h"), "_may")
    matched = rows.where("_may").join(gone, "_key", "left")
    once = matched.where("_once").dropDuplicates(["_key"])
    return (rows.where("not _may").select("_row.*")
            .unionByName(matched.where("_once is null").select("_row.*"))
            .unionByName(once.select("_row.*")))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"), digest_all=True)


ORACLE = {
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""}
