from collections import Counter

import brute
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpus_rows import EDGES, SF
from fieldpulse.llm import mixing as M


def frame(df):
    return df.toPandas().sort_values("doc_id").reset_index(drop=True)


def test_given_table_and_edges(spark, small, edges):
    cols = ["doc_id", "n_tokens", "leaf_budget", "n_copies"]
    for df, pdf in ((small, pd.read_parquet(f"{SF}/documents.parquet")),
                    (edges, pd.DataFrame([r[:5] for r in EDGES], columns=["doc_id", "text", "lang", "source", "n_chars"]))):
        want = brute.sql(M.ORACLE["op7_mixing"], documents=pdf).sort_values("doc_id").reset_index(drop=True)
        got = frame(M.mix(df, M.corpus_levels(df)))
        assert got[cols].astype("int64").equals(want[cols].astype("int64"))


def leaf_table(spark, caps):
    return spark.createDataFrame([(*k.split("/"), c) for k, c in caps.items()], "domain string, lang string, source string, cap long")


def budgets(spark, caps, total, weights):
    out = M.leaf_budgets(leaf_table(spark, caps), F.lit(total), M.LEVELS, weights).collect()
    return {f"{r.domain}/{r.lang}/{r.source}": r.budget for r in out}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    caps = {"a/en/1": 10, "a/en/2": 1000, "a/de/3": 1000, "b/en/4": 1000}
    # a and b get 200 each, a's en and de 100 each; source 1 lacks 40, its sibling 2 makes it up
    assert budgets(spark, caps, 400, {}) == {"a/en/1": 10, "a/en/2": 90, "a/de/3": 100, "b/en/4": 200}
    # en of a is full at 20: de takes the rest; b is untouched
    caps |= {"a/en/2": 10}
    assert budgets(spark, caps, 400, {}) == {"a/en/1": 10, "a/en/2": 10, "a/de/3": 180, "b/en/4": 200}
    # all of a is full: only now b gets more
    caps |= {"a/de/3": 30}
    assert budgets(spark, caps, 400, {}) == {"a/en/1": 10, "a/en/2": 10, "a/de/3": 30, "b/en/4": 350}


def test_weights_and_too_large_a_budget(spark):
    caps = {"a/en/1": 1000, "b/en/2": 1000, "c/en/3": 50}
    assert budgets(spark, caps, 600, {("domain", "a"): 3}) == {"a/en/1": 412, "b/en/2": 137, "c/en/3": 50}  # whole tokens, rounded down
    assert budgets(spark, caps, 10_000, {}) == caps


@pytest.mark.parametrize("numerator", [0, 1, 3, 9])
def test_prefix_never_passes_the_budget(small, numerator):
    got = frame(M.mix(small, M.corpus_levels(small), numerator=numerator, denominator=4))
    by = got.assign(t=got.n_tokens * got.n_copies).groupby(["domain", "lang", "source"])
    assert (by.t.sum() <= by.leaf_budget.first()).all()
    slack = by.leaf_budget.first() - by.t.sum()
    assert (slack <= by.n_tokens.max()).all()


def test_rows_and_odd_ids(edges, odd_ids, no_docs):
    got = M.take_mix(edges, numerator=2, denominator=1, max_epochs=2)
    assert got.columns == edges.columns
    assert got.count() == 2 * len(EDGES)  # two whole epochs of every leaf
    assert M.take_mix(odd_ids, numerator=1, denominator=1).where("doc_id = 5").count() == 2
    assert M.mix(odd_ids, M.corpus_levels(odd_ids)).count() == 6
    assert M.mix(no_docs, M.corpus_levels(no_docs)).count() == 0 and M.take_mix(no_docs).count() == 0


def test_equal_ids_and_tokens_in_different_leaves(spark):
    """Each leaf's rows are taken as often as the mix says for that leaf."""
    rows = [(i, "a b c", lang, "src0") for lang, n in (("en", 2), ("de", 7)) for i in [None] * n + [5]] + [(None, "x y z", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for numerator in (1, 2, 3, 5):
        want, got = Counter(), Counter()
        for r in M.mix(docs, M.corpus_levels(docs), numerator=numerator, denominator=4).collect():
            want[r.doc_id, r.lang, r.source] += r.n_copies
        for r in M.take_mix(docs, numerator=numerator, denominator=4).collect():
            got[r.doc_id, r.lang, r.source] += 1
        assert got == +want
