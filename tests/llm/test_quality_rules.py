import math

import brute
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpus_rows import SF
from fieldpulse.llm import quality_rules as Q

SCORES = "value string, " + ", ".join(f"{r} double" for r in Q.RULES)
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def found(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_base_counts(edges, edge_pairs, small, small_pairs):
    assert found(Q.base_features(edges)) == brute.quality(edge_pairs)
    assert found(Q.base_features(small)) == brute.quality(small_pairs)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.05), (12, 900, 0.0125), (40, 5000, 0.01), (0, 200_000, 0.01)])
def test_binomial(spark, k, n, p):
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                        + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    df = spark.createDataFrame([(k, n)], "k long, n long")
    assert df.select(Q._binomial_cdf(F.col("k"), F.col("n"), p)).first()[0] == pytest.approx(want, rel=1e-9)


def test_cutoffs_are_admitted_in_order(spark):
    """English: 2000 clean documents, none above any cutoff but 60 with symbols above 0.5; German: too few to tell."""
    rows = [("en", 0.6 if i < 60 else 0.0, 0.0, 0.0, 0.0, 5.0) for i in range(2000)] + [("de", 0.0, 0.0, 0.0, 0.0, 5.0)] * 50
    good = spark.createDataFrame(rows, SCORES)
    got = {(r.value, r.rule): r.cutoff for r in Q.cutoffs(good).collect()}
    assert got[("en", "symbol_rate")] == 0.75 and got[("en", "bang_rate")] == Q.RULES["bang_rate"][-1]
    assert all(v == "en" for v, rule in got if rule) and got[(None, None)] is None


def test_small_strata_are_pooled_with_a_test_of_their_own(spark):
    """Twelve languages of 60 rows have no cutoff each, together they have; nulls are with them."""
    clean = (0.0, 0.0, 0.0, 0.0, 5.0)
    rows = [(f"l{i % 12}" if i % 13 else None, *clean) for i in range(720)] + [("en", 9.0, *clean[1:])] * 900
    good = spark.createDataFrame(rows, SCORES)
    assert [r.value for r in Q.own_strata(good).collect()] == ["en"]
    got = {(r.value, r.rule): r.cutoff for r in Q.cutoffs(good).collect()}
    assert got[(None, "symbol_rate")] == 0.15 and ("en", "symbol_rate") not in got and got[("en", "word_length")] == 13.0
    docs = spark.createDataFrame([(v, 1.0, 0.0, 0.0, 0.0, 5.0, False) for v in ("l1", "new", None, "en")], SCORES + ", base_failed boolean")
    judged = {r.value: (r.stratum, r.kept) for r in Q.judge(docs, Q.cutoffs(good)).collect()}
    assert judged == {"l1": ("other", False), "new": ("other", False), None: ("other", False), "en": ("en", True)}


def test_as_many_strata_as_the_labels_have(spark):
    """Thirty languages with rows enough: each has its own limits, corrected for 31 strata."""
    clean = (0.0, 0.0, 0.0, 0.0, 5.0)
    least = Q.least_rows(31, 0.05, 0.05)
    rows = [(f"l{i % 30}", *clean) for i in range(30 * least)] + [(f"l{i}", 1.5, *clean[1:]) for i in range(1, 30, 2) for _ in range(9)]
    got = {(r.value, r.rule): r.cutoff for r in Q.cutoffs(spark.createDataFrame(rows, SCORES)).collect()}
    assert {v for v, r in got if r == "bang_rate"} == {f"l{i}" for i in range(30)}
    assert got[("l0", "symbol_rate")] == 0.15 and got[("l1", "symbol_rate")] == 2.0
    assert Q.least_rows(1, 0.05, 0.05) == 459 and Q.least_rows(5, 0.05, 0.05) == 619


def test_same_as_sql_with_cutoffs(spark):
    """Enough labelled rows for cutoffs in every language."""
    text = lambda i: " ".join(f"w{i}{k}" for k in range(25)) + (" ###" * 30 if i % 60 == 59 else "")
    docs = pd.DataFrame([(i, text(i), ("en", "de", None)[i % 3]) for i in range(4500)], columns=["doc_id", "text", "lang"])
    labels = pd.DataFrame([(i, 0 if i % 60 == 59 else 1) for i in range(4400)], columns=["doc_id", "quality"])
    got = Q.quality_rules(spark.createDataFrame(docs), spark.createDataFrame(labels)).toPandas()
    want = brute.sql(Q.ORACLE["op6_quality_rules"], documents=docs, labels=labels)
    a, b = (x.sort_values("doc_id")[["doc_id", "kept", "stratum"]].reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
    assert not got[got.doc_id == 59].kept.any() and got[got.doc_id % 60 != 59].kept.all()


def test_same_as_sql_with_strata_of_all_sizes(spark):
    """Own strata with different limits, a pool that has limits, small and unknown languages, one named as the pool is."""
    def text(i, lang):
        words = " ".join(f"w{i}{k}" for k in range(25))
        return words + (" ###" * (3 * (i % 9)) if lang in ("en", "other") and i % 400 < 3 else " !!!!" * 30 if i % 70 == 69 else "")
    names = ["en", "de", "other", "xx", "yy", None]
    langs = [names[0 if k < 4 else 1 if k < 8 else 2 if k < 12 else 3 + k % 3] for k in (i % 14 for i in range(14_000))]
    docs = pd.DataFrame([(i, text(i, lang), lang) for i, lang in enumerate(langs)], columns=["doc_id", "text", "lang"])
    labels = pd.DataFrame([(i, 0 if i % 70 == 69 else 1) for i in range(10_500)], columns=["doc_id", "quality"])
    got = Q.quality_rules(spark.createDataFrame(docs), spark.createDataFrame(labels)).toPandas()
    want = brute.sql(Q.ORACLE["op6_quality_rules"], documents=docs, labels=labels)
    a, b = (x.sort_values("doc_id")[["doc_id", "kept", "stratum"]].reset_index(drop=True) for x in (got, want))
    assert a.equals(b) and 0 < (~got.kept).sum() < len(got)
    rows = Q.keep_good(spark.createDataFrame(docs), spark.createDataFrame(labels))
    assert sorted(r.doc_id for r in rows.collect()) == sorted(got[got.kept].doc_id)


def test_rows_that_stay(edges, edge_pairs, odd_ids, no_docs, labels, spark):
    """No stratum of these labels is large enough for a cutoff, so the base rule alone decides."""
    good = sorted(i for i, counts in brute.quality(edge_pairs).items() if not counts[-1])
    kept = Q.keep_good(edges, labels)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == good
    assert Q.keep_good(odd_ids, labels).count() == 0 and Q.keep_good(no_docs, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert Q.quality_rules(edges, none).where("kept").count() == len(good)


def test_given_table(spark, small, labels):
    want = brute.sql(Q.ORACLE["op6_quality_rules"], documents=pd.read_parquet(f"{SF}/documents.parquet"),
                     labels=pd.read_parquet(f"{SF}/labels.parquet"))
    got = Q.quality_rules(small, labels).toPandas()
    assert dict(zip(got.doc_id, got.kept, strict=True)) == dict(zip(want.doc_id, want.kept, strict=True))
