import brute

from fieldpulse.llm.exact_dedup import exact_dedup, exact_groups


def found(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_edges_and_whole_small_table(edges, edge_pairs, small, small_pairs):
    assert found(exact_groups(edges, digest_all=True)) == brute.exact(edge_pairs)
    assert found(exact_groups(small, digest_all=True)) == brute.exact(small_pairs)


def test_full_hash_only_where_length_and_prefix_repeat(edges):
    hashed = {r.doc_id for r in exact_groups(edges).where("text_sha256 is not null").collect()}
    assert {8, 10} <= hashed and not hashed & {4, 11, 12, 13}


def test_equal_prefix_different_tail(spark):
    a = "z" * 500
    df = spark.createDataFrame([(1, a + "x"), (2, a + "y"), (3, a + "x")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_groups(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_rows_that_stay(edges, edge_pairs, odd_ids, no_docs):
    kept = exact_dedup(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in brute.exact(edge_pairs).items() if x[2])
    rows = sorted((r.doc_id or 0, r.text or "") for r in exact_dedup(odd_ids).collect())
    assert rows == [(0, ""), (5, "p q r"), (7, "only here")]
    assert exact_dedup(no_docs).count() == 0 and exact_groups(no_docs).count() == 0


def test_null_and_repeated_ids(odd_ids):
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(odd_ids).collect()]
    assert sorted(rows, key=str) == sorted([(None, 5, 4, False), (None, 5, 4, False), (5, 5, 4, True), (5, 5, 4, False),
                                            (7, 7, 1, True), (None, None, 1, True)], key=str)
