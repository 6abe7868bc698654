import hashlib
import math
import re
import zlib
from collections import Counter

import brute
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpus_rows import SF
from fieldpulse.llm import importance as I


def features(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target, percent=5, least=20):
    """(id, text) pairs, all by hand: id -> (n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000))))
    rows = []
    for i, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {id(r): k for k, r in enumerate(able[:percent * len(able) // 100], 1)}
    return sorted(((r[0], *r[2:], drawn.get(id(r))) for r in rows), key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def target(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="module")
def target_texts():
    return pd.read_parquet(f"{SF}/benchmark.parquet").text.tolist()


def test_given_table(spark, small, small_pairs, target, target_texts):
    got = found(I.resample(small, target))
    assert got == resampled(small_pairs, target_texts)
    want = brute.sql(I.ORACLE["op11_importance"], documents=pd.read_parquet(f"{SF}/documents.parquet"),
                     benchmark=pd.read_parquet(f"{SF}/benchmark.parquet"))
    assert got == sorted(((int(r.doc_id), int(r.n_features), int(r.weight), int(r.score), None if pd.isna(r.rank) else int(r.rank))
                          for r in want[["doc_id", "n_features", "weight", "score", "rank"]].rename(columns={"rank": "rank"})
                          .itertuples(index=False)), key=str)


def test_edges(edges, edge_pairs, target, target_texts, no_docs):
    assert found(I.resample(edges, target, percent=50)) == resampled(edge_pairs, target_texts, 50)
    assert I.resample(no_docs, target).count() == 0
    nothing = target.where("false")
    assert found(I.resample(edges, nothing, percent=50)) == resampled(edge_pairs, [], 50)


def test_repeated_rows_and_null_ids(odd_ids, target, target_texts):
    """All rows have few words; with no least number of words half of the six are drawn."""
    got = found(I.resample(odd_ids, target, percent=50, min_words=0))
    pairs = [(r.doc_id, r.text) for r in odd_ids.collect()]
    assert got == resampled(pairs, target_texts, 50, 0)
    assert [r[4] for r in found(I.resample(odd_ids, target))] == [None] * 6


def test_text_ids_are_compared_among_tied_rows(spark, target, target_texts, small_pairs):
    docs = spark.createDataFrame([(f"k{i:04}", t) for i, t in small_pairs], "doc_id string, text string")
    assert found(I.resample(docs, target, percent=20)) == resampled([(f"k{i:04}", t) for i, t in small_pairs], target_texts, 20)


@pytest.mark.parametrize("values,wanted", [([5] * 100, 7), (list(range(1000)), 50), ([-2 ** 63, 0, 2 ** 63 - 1], 2), ([3], 1),
                                           ([1, 1, 2, 2, 2, 9], 4), (list(range(-300, 300)) * 3, 1799)])
def test_threshold(spark, values, wanted):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    at = sorted(values, reverse=True)[wanted - 1]
    assert I.threshold(df, "v", wanted) == (at, sum(v > at for v in values))
    assert I.threshold(df, "v", len(values) + 1) is None


def test_ties_at_the_cutoff_go_to_smaller_ids(spark, monkeypatch, target):
    """Equal scores for all rows: the draw is decided by the id alone."""
    monkeypatch.setattr(I, "gumbel_score", lambda weight, doc_id, seed: F.lit(7).cast("bigint"))
    docs = spark.createDataFrame([(i, "one two three") for i in range(200, 0, -1)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r["rank"] for r in I.resample(docs, target, percent=10, min_words=1).collect()}
    assert got == {i: i if i <= 20 else None for i in range(1, 201)}
