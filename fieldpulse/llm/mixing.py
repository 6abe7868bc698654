"""Mixing sources to target weights by hierarchical budgeting, built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NON_SPACE, read_table, shared_table, text_of

LEVELS = ("domain", "lang", "source")
#: Production weights: shares among siblings, whole numbers up to 1000; a node not named here weighs 1.
WEIGHTS: dict[tuple[str, str], int] = {
    ("domain", "web"): 2, ("domain", "news"): 3, ("domain", "reference"): 3,
    ("lang", "en"): 4, ("lang", "de"): 2, ("lang", "fr"): 2, ("lang", "es"): 2,
}
#: Hash digits that cut a leaf into 16^digits buckets for its prefix sum.
BUCKET_DIGITS = 3
SEED = "mix-1"

DOMAIN_SQL = ("CASE WHEN source = 'src0' THEN 'web' WHEN source IS NULL THEN 'unknown'"
              " WHEN length(source) % 2 = 0 THEN 'news' ELSE 'reference' END")


def _weight(level: str, weights: Mapping[tuple[str, str], int]) -> Column:
    out = F.lit(1).cast("long")
    for (of, name), w in weights.items():
        if of == level:
            out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def _share(nodes: DataFrame, parents: Sequence[str], level: str) -> DataFrame:
    """Split each parent's ``budget`` among its children by weight, none above
    its capacity ``cap``.  Children whose capacity lies under their share are
    filled; what they leave goes to their siblings in proportion.  Exact in
    whole numbers: children are taken by cap / weight, and a child is filled if
    the level at which it fills costs no more than the budget."""
    by = Window.partitionBy(*[F.coalesce(F.col(p), F.lit("")) for p in parents], *[F.col(p).isNull() for p in parents])
    order = by.orderBy(F.col("cap").cast("double") / F.col("w"), F.col(level).asc_nulls_first())
    nodes = (nodes.withColumn("_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("_rest", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    # filled children come first in this order, so their capacities add up to _before
    nodes = nodes.withColumn("_full", F.col("cap") * F.col("_rest") <= (F.col("budget") - F.col("_before")) * F.col("w"))
    nodes = nodes.withColumn("_spent", F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(by), F.lit(0)))
    nodes = nodes.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("w"))).over(by))
    part = F.expr("(budget - _spent) * w div _open")
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.least("cap", part)))


def leaf_budgets(leaves: DataFrame, budget: Column, levels: Sequence[str] = LEVELS,
                 weights: Mapping[tuple[str, str], int] = WEIGHTS) -> DataFrame:
    """Leaf table (levels..., tokens, cap) -> the same with ``budget``.  A node's
    capacity is the sum of its leaves', so a shortage is made up by siblings
    first and reaches an ancestor only when the whole subtree is full."""
    total = leaves.agg(budget.cast("long").alias("budget"))
    above = None
    for i, level in enumerate(levels):
        path = list(levels[:i + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").cast("long").alias("cap"))
        nodes = nodes.withColumn("w", _weight(level, weights))
        if above is None:  # the one total row; a scalar, no join of tables
            nodes = nodes.withColumn("budget", F.lit(total.first()[0] or 0).cast("long"))
        else:
            up = above.select(*[F.col(p).alias(f"_{p}") for p in path[:-1]], "budget")
            on = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in path[:-1]]
            cond = on[0]
            for c in on[1:]:
                cond = cond & c
            nodes = nodes.join(up, cond).drop(*[f"_{p}" for p in path[:-1]])
        above = _share(nodes, path[:-1], level).select(*path, F.col("budget").cast("long").alias("budget"))
    return above


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NON_SPACE + "+")).cast("long")


def mix(docs: DataFrame, levels: Mapping[str, Column], id_col: str = "doc_id", text_col: str = "text",
        weights: Mapping[tuple[str, str], int] = WEIGHTS, numerator: int = 9, denominator: int = 10,
        max_epochs: int = 2, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, the levels, n_tokens, leaf_tokens,
    leaf_budget, n_copies.

    The budget is numerator/denominator of all tokens (words); a leaf can give
    ``max_epochs`` times its tokens.  A leaf that gets e whole epochs and r more
    tokens gives every document e times, and once more those in the prefix of
    epoch e + 1: documents in the order of md5(seed:epoch:id), as long as
    the tokens up to and including the document are at most r.  The prefix sum
    of a hot leaf is split: sums per hash bucket first, single documents only in
    the one bucket that holds the cut.

    Null level values are nodes of their own (weight 1).  Null and empty texts
    have 0 tokens and follow their place in the order; null ids hash as "null".
    Rows that repeat an id share a place, taken in order of tokens; rows
    that repeat both are taken together.  An
    empty table gives an empty result."""
    names = list(levels)
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.cast("string").alias(n) for n, c in levels.items()],
                       token_count(text_of(text_col)).alias("n_tokens"))
    rows = shared_table(rows, "mix")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("leaf_tokens"))
    leaves = shared_table(leaves.withColumn("cap", F.col("leaf_tokens") * max_epochs), "mix-leaves")
    wanted = F.expr(f"sum(leaf_tokens) * {numerator} div {denominator}")
    given = leaf_budgets(leaves, wanted, names, weights).select(
        *[F.col(n).alias(f"_{n}") for n in names], F.col("budget").alias("leaf_budget"))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    leaves = leaves.join(given, same).drop(*[f"_{n}" for n in names])
    leaf_key = F.xxhash64(*[F.coalesce(F.col(n), F.lit("")) for n in names], *[F.col(n).isNull() for n in names])
    leaves = leaves.select(
        leaf_key.alias("_leaf"), "leaf_tokens", "leaf_budget",
        F.expr("CASE WHEN leaf_tokens > 0 THEN leaf_budget div leaf_tokens ELSE 0 END").alias("_epochs"),
        F.expr("CASE WHEN leaf_tokens > 0 THEN leaf_budget % leaf_tokens ELSE 0 END").alias("_rest"))
    leaves = shared_table(leaves, "mix-budgets")
    rows = rows.withColumn("_leaf", leaf_key).join(leaves, "_leaf")
    rows = rows.withColumn("_place", F.md5(F.concat_ws(":", F.lit(seed), F.col("_epochs").cast("string"),
                                                       F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = rows.withColumn("_bucket", F.substring("_place", 1, BUCKET_DIGITS))
    sums = rows.groupBy("_leaf", "_bucket").agg(F.sum("n_tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy("_leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_upto", F.sum("_sum").over(upto))
    # the first bucket that passes the rest holds the cut
    cuts = (sums.where(F.col("_upto") > F.col("_rest")).groupBy("_leaf")
            .agg(F.min_by(F.struct(F.col("_bucket").alias("b"), (F.col("_upto") - F.col("_sum")).alias("s")), "_bucket").alias("_cut")))
    # written: one row per leaf, broadcast if small, else joined with hot leaves split
    cuts = shared_table(cuts.select("_leaf", F.col("_cut.b").alias("_cut"), F.col("_cut.s").alias("_before")), "mix-cuts")
    rows = rows.join(cuts, "_leaf", "left")
    inside = F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut"))
    out = [F.col("doc_id"), *names, F.col("n_tokens"), F.col("leaf_tokens"), F.col("leaf_budget")]
    copies = F.col("_epochs") + F.when(inside & (F.col("_rest") > 0), 1).otherwise(0)
    plain = rows.where(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut"))).select(*out, copies.alias("n_copies"))
    near = rows.where(F.col("_bucket") == F.col("_cut"))
    run = Window.partitionBy("_leaf").orderBy("_place", "n_tokens")  # a range: equal rows come together
    near = near.withColumn("_in", (F.col("_before") + F.sum("n_tokens").over(run) <= F.col("_rest")) & (F.col("_rest") > 0))
    return plain.unionByName(near.select(*out, (F.col("_epochs") + F.col("_in").cast("long")).alias("n_copies")))


def corpus_levels(docs: DataFrame) -> dict[str, Column]:
    """The production tree over ``documents``: domain (from the source), language, source."""
    return {"domain": F.expr(DOMAIN_SQL), "lang": docs["lang"], "source": docs["source"]}


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns unchanged."""
    levels = corpus_levels(docs)
    chosen = mix(docs, levels, id_col, text_col, **options)
    # rows of a leaf that repeat id and tokens share a place, so all of them have the same count
    chosen = chosen.where("n_copies > 0").groupBy("doc_id", "n_tokens", *levels).agg(F.min("n_copies").alias("_copies"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"),
                       token_count(text_of(text_col)).alias("_tokens"),
                       *[c.cast("string").alias(f"_{n}") for n, c in levels.items()])
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tokens") == F.col("n_tokens"))
    for n in levels:
        same = same & F.col(f"_{n}").eqNullSafe(F.col(n))
    rows = rows.join(chosen, same)
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs, corpus_levels(docs))


def _oracle(documents: str = "documents", numerator: int = 9, denominator: int = 10, max_epochs: int = 2) -> str:
    """CTEs up to ``mixed``; the water level is found by trying every set of filled children."""
    def weight(level):
        return "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {w}" for (of, n), w in WEIGHTS.items() if of == level) + " ELSE 1 END" \
            if any(of == level for of, _ in WEIGHTS) else "1"

    ctes = [rf"""
m AS (SELECT doc_id, {DOMAIN_SQL} AS domain, lang, source,
             len(regexp_extract_all(coalesce(text, ''), '{NON_SPACE}+'))::BIGINT AS n_tokens FROM {documents}),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {max_epochs} AS cap FROM m GROUP BY ALL),
given0 AS (SELECT (sum(tokens) * {numerator} // {denominator})::BIGINT AS budget FROM leaf)"""]
    for i, level in enumerate(LEVELS):
        path, up = ", ".join(LEVELS[:i + 1]), LEVELS[:i]
        on = " AND ".join(f"c.{p} IS NOT DISTINCT FROM g.{p}" for p in up) or "true"
        peer = " AND ".join(f"a.{p} IS NOT DISTINCT FROM b.{p}" for p in up) or "true"
        over = f"PARTITION BY {', '.join(up)}" if up else ""
        mine = ", ".join(f"a.{p}" for p in LEVELS[:i + 1])
        ctes.append(f"""
c{i} AS (SELECT c.*, g.budget FROM (SELECT {path}, sum(cap)::BIGINT AS cap, {weight(level)} AS w FROM leaf GROUP BY {path}) c
         JOIN given{i} g ON {on}),
f{i} AS (SELECT {mine}, a.cap, a.w, a.budget, a.cap::HUGEINT * sum(CASE WHEN b.cap * a.w < a.cap * b.w THEN 0 ELSE b.w END)
           <= (a.budget - sum(CASE WHEN b.cap * a.w < a.cap * b.w THEN b.cap ELSE 0 END))::HUGEINT * a.w AS filled
         FROM c{i} a JOIN c{i} b ON {peer} GROUP BY {mine}, a.cap, a.w, a.budget),
given{i + 1} AS (SELECT {path}, (CASE WHEN filled THEN cap ELSE least(cap,
           (budget - coalesce(sum(cap) FILTER (WHERE filled) OVER ({over}), 0))::HUGEINT * w
           // sum(w) FILTER (WHERE NOT filled) OVER ({over})) END)::BIGINT AS budget FROM f{i})""")
    ctes.append(f"""
leaves AS (SELECT l.domain, l.lang, l.source, l.tokens, g.budget FROM leaf l JOIN given{len(LEVELS)} g
           ON l.domain IS NOT DISTINCT FROM g.domain AND l.lang IS NOT DISTINCT FROM g.lang AND l.source IS NOT DISTINCT FROM g.source),
placed AS (SELECT m.*, l.tokens AS leaf_tokens, l.budget AS leaf_budget,
             CASE WHEN l.tokens > 0 THEN l.budget // l.tokens ELSE 0 END AS epochs,
             CASE WHEN l.tokens > 0 THEN l.budget % l.tokens ELSE 0 END AS rest,
             md5('{SEED}:' || (CASE WHEN l.tokens > 0 THEN l.budget // l.tokens ELSE 0 END)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, 'null')) AS place
           FROM m JOIN leaves l ON m.domain IS NOT DISTINCT FROM l.domain AND m.lang IS NOT DISTINCT FROM l.lang
           AND m.source IS NOT DISTINCT FROM l.source),
mixed AS (SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget,
             (epochs + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, n_tokens) <= rest THEN 1 ELSE 0 END)::BIGINT AS n_copies FROM placed)""")
    return ",".join(ctes)


MIXED_SQL = _oracle()
ORACLE = {"op7_mixing": f"WITH {MIXED_SQL}\nSELECT * FROM mixed"}
