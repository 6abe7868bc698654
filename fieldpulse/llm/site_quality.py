"""Quality classifier by hierarchical empirical Bayes over host and path, built
from grouped aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_table, text_of, words_of

#: Score bins of a document's features: upper ends; a bin's weight is learnt, the ends are fixed.
BINS: dict[str, tuple[float, ...]] = {
    "n_words": (5, 20, 50, 200, 1000),
    "symbol_rate": (0.01, 0.05, 0.2, 0.5, 1.0),
    "bang_rate": (0.01, 0.05, 0.2, 0.5, 1.0),
    "upper_rate": (0.02, 0.05, 0.15, 0.4, 0.8),
    "echo_rate": (0.02, 0.04, 0.1, 0.3, 0.6),
    "variety": (0.1, 0.3, 0.5, 0.65, 0.8),
    "word_length": (2, 3.5, 5, 7, 10),
}
#: Pseudo-counts of a bin, and limits of a prior's strength (in documents).
SMOOTH, WEAKEST, STRONGEST = 1.0, 1.0, 1000.0
#: Naive Bayes counts dependent features several times; this tempers the sum.
TEMPER = 0.7


def document_bins(docs: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    """doc_id, the other columns, and the bin number of every feature."""
    raw = docs.select(F.col(id_col).alias("doc_id"), *others, text_of(text_col).alias("_t"))
    raw = raw.withColumn("_w", words_of(F.col("_t")))
    n = F.greatest(F.size("_w"), F.lit(1)).cast("double")
    value = {
        "n_words": F.size("_w").cast("double"),
        "symbol_rate": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")) / n,
        "bang_rate": F.regexp_count("_t", F.lit("!")) / n,
        "upper_rate": F.regexp_count("_t", F.lit(r"(?<!\S)\p{Lu}{2,}")) / n,
        "echo_rate": F.regexp_count("_t", F.lit(r"(?<!\S)(\S+)\s+(?=\1(?!\S))")) / n,
        "variety": F.size(F.array_distinct("_w")) / n,
        "word_length": F.length(F.array_join("_w", "")) / n,
    }
    def bin_of(x: Column, ends: tuple[float, ...]) -> Column:
        out = F.lit(len(ends))
        for i in reversed(range(len(ends))):
            out = F.when(x <= F.lit(float(ends[i])), F.lit(i)).otherwise(out)
        return out
    keep = [c for c in raw.columns if c not in ("_t", "_w")]
    return raw.select(*keep, *[bin_of(value[f], ends).alias(f) for f, ends in BINS.items()])


def sites(docs: DataFrame, pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, host, path) of documents that have a page: the page's url ends in
    the document's id.  Of several pages the one with the smallest id counts."""
    url = F.col("url")
    at = pages.select(
        F.expr(r"try_cast(regexp_extract(url, '^[a-z]+://[^/?#]+/[^/?#]+/([0-9]+)', 1) as bigint)").alias("_id"),
        F.struct(F.col("page_id"), F.regexp_extract(url, r"^[a-z]+://(?:www\.)?([^/?#]+)", 1).alias("host"),
                 F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]+)/", 1).alias("part")).alias("p"))
    first = at.where("_id is not null").groupBy("_id").agg(F.min("p").alias("p"))
    return first.select("_id", F.col("p.host").alias("_host"), F.concat_ws("/", "p.host", "p.part").alias("_path"))


def _strength(groups: DataFrame, prior: Column) -> float:
    """Prior strength (in documents) of sites whose good share scatters around
    ``prior``, by the method of moments of the beta-binomial: the variance
    between sites beyond that of drawing n documents.  One row."""
    p = prior
    row = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - p, 2)).alias("between"),
        F.sum(p * (1 - p)).alias("drawn"), F.sum((F.col("n") - 1) * p * (1 - p)).alias("room")).first()
    if not row.room or row.room <= 0:
        return STRONGEST  # no site has two labelled documents
    rho = (row.between - row.drawn) / row.room
    return STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, 1 / rho - 1))


def classify(docs: DataFrame, labels: DataFrame, pages: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source", part_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, host, path, evidence, host_prior,
    path_prior, score, predicted.

    Evidence is a tempered naive Bayes log-likelihood ratio over binned text
    features.  A host's good share is shrunk towards the global share, a path's
    towards its host's, by strengths estimated from the scatter between sites.
    score = sigmoid(logit(path posterior) + evidence).  A labelled document's
    own label is taken out of its host's and path's counts before.

    Documents without a page take ``host_col`` and ``part_col`` as host and path;
    null parts are the site "" of their kind.  Labels: 1 good, 0 bad; null is no
    label, disagreeing labels count as bad.  Without labels every prior is 1/2
    and the evidence 0, so all documents are kept.  Null and empty texts have no
    words; repeated rows score alike and each counts; an empty table gives an
    empty result.  Counts per site are pre-aggregated; texts are not shuffled."""
    own = [F.concat(F.lit(f"{host_col}:"), F.coalesce(F.col(host_col).cast("string"), F.lit(""))).alias("_own_host"),
           F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_own_part")]
    bins = document_bins(docs, id_col, text_col, *own)
    label = (labels.where("quality is not null").groupBy(F.col("doc_id").alias("_lid"))
             .agg(F.min("quality").cast("long").alias("y")))
    rows = bins.join(label, F.col("doc_id") == F.col("_lid"), "left").join(
        sites(docs, pages, id_col), F.col("doc_id") == F.col("_id"), "left")
    rows = rows.select("doc_id", "y", F.coalesce("_host", "_own_host").alias("host"),
                       F.coalesce("_path", F.concat_ws("/", "_own_host", "_own_part")).alias("path"), *BINS)
    rows = shared_table(rows, "site-quality")
    known = rows.where("y is not null")

    # document evidence: one grouped count per feature bin, at most len(BINS) x 6 rows
    cells = known.select("y", F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in BINS])).alias("c"))
    counts = {(r.f, r.b): (r.good, r.n) for r in cells.groupBy("c.f", "c.b").agg(
        F.sum("y").alias("good"), F.count("*").alias("n")).collect()}
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good")).first()
    good, bad = total.good, total.n - total.good
    evidence = F.lit(0.0)
    for f, ends in BINS.items():
        k = len(ends) + 1
        ratio = F.lit(0.0)
        for b in range(k):
            g, n = counts.get((f, b), (0, 0))
            if n and good and bad:
                w = math.log((g + SMOOTH) / (good + SMOOTH * k)) - math.log((n - g + SMOOTH) / (bad + SMOOTH * k))
                ratio = F.when(F.col(f) == b, F.lit(TEMPER * w)).otherwise(ratio)
        evidence = evidence + ratio
    p0 = (good + 1) / (total.n + 2)

    hosts = shared_table(known.groupBy("host").agg(F.sum("y").alias("good"), F.count("*").alias("n")), "site-hosts")
    m0 = _strength(hosts, F.lit(p0))
    paths = shared_table(known.groupBy("host", "path").agg(F.sum("y").alias("good"), F.count("*").alias("n")), "site-paths")
    host_share = (F.col("h_good") + m0 * p0) / (F.col("h_n") + m0)
    within = paths.join(hosts.select("host", F.col("good").alias("h_good"), F.col("n").alias("h_n")), "host")
    m1 = _strength(within.select("good", "n", host_share.alias("p")), F.col("p"))
    site = within.select(F.col("path").alias("_p"), F.col("host").alias("_h"), "good", "n")
    top = hosts.select(F.col("host").alias("_hh"), F.col("good").alias("h_good"), F.col("n").alias("h_n"))
    out = rows.join(top, F.col("host") == F.col("_hh"), "left").join(
        site, (F.col("path") == F.col("_p")) & (F.col("host") == F.col("_h")), "left")
    mine = F.when(F.col("y").isNotNull(), 1).otherwise(0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    y = F.coalesce("y", F.lit(0))
    host_prior = (zero("h_good") - y + m0 * p0) / (zero("h_n") - mine + m0)
    out = out.select("doc_id", "host", "path", evidence.alias("evidence"), host_prior.alias("host_prior"),
                     (zero("good") - y).alias("_g"), (zero("n") - mine).alias("_n"))
    out = out.withColumn("path_prior", (F.col("_g") + m1 * F.col("host_prior")) / (F.col("_n") + m1))
    logit = F.log(F.col("path_prior") / (1 - F.col("path_prior"))) + F.col("evidence")
    out = out.withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "host", "path", "evidence", "host_prior", "path_prior", "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                    read_table(spark, sf_dir, "pages"))
