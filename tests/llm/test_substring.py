import brute
from corpus_rows import PASSAGE

from fieldpulse.llm import substring
from fieldpulse.llm.substring import remove_repeats


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.text)) for r in df.collect()}


def test_edges_and_whole_small_table(edges, edge_pairs, small, small_pairs):
    assert found(remove_repeats(edges)) == brute.substring(edge_pairs)
    assert found(remove_repeats(small)) == brute.substring(small_pairs)


def test_many_short_batches(spark, small_pairs):
    """A prefix group that spans batches gives the same result."""
    docs = [(i, f"{PASSAGE} {i} " + PASSAGE) for i in range(300)] + [(1000 + i, t) for i, t in small_pairs[:50]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert found(remove_repeats(df)) == brute.substring(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hot_groups_give_the_same(spark, small, small_pairs, edges, edge_pairs):
    docs = [(i, f"{PASSAGE} {i} " + PASSAGE) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for hot in (0, 3, 100):
        assert found(remove_repeats(df, hot=hot)) == brute.substring(docs)
    assert found(remove_repeats(small, hot=2)) == brute.substring(small_pairs)
    assert found(remove_repeats(edges, hot=0)) == brute.substring(edge_pairs)


def test_removed_passage_joins_its_neighbours(spark):
    df = spark.createDataFrame([(2, "x " + PASSAGE + " y"), (1, PASSAGE)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in remove_repeats(df).collect()} == {1: PASSAGE, 2: "x y"}


def test_null_and_repeated_ids(spark, no_docs, odd_ids):
    assert remove_repeats(no_docs).count() == 0 and remove_repeats(odd_ids).count() == 6
    rows = [(None, PASSAGE), (3, PASSAGE), (3, PASSAGE), (3, "z " + PASSAGE)]
    got = [(r.doc_id, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 14), (3, 0), (3, 0), (3, 0)], key=str)


def test_prefix_is_shorter_than_the_window():
    assert 1 < substring.PREFIX < substring.LENGTH == 13
