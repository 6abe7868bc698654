import random

import brute

from fieldpulse.llm.components import connected_components
from fieldpulse.llm.simhash import fingerprint, links, near_dedup, simhash_groups


def found(df):
    return {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()}


def test_edges_and_whole_small_table(edges, edge_pairs, small, small_pairs):
    assert found(simhash_groups(edges)) == brute.simhash(edge_pairs)
    assert found(simhash_groups(small)) == brute.simhash(small_pairs)


def test_no_link_is_lost(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for d in (1, 2, 3, 4, 5, 6):
            g = f
            for b in rng.sample(range(64), d):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    want = {(min(s(a), s(b)), max(s(a), s(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4}
    df = spark.createDataFrame([(s(f),) for f in fps], "fp long")
    assert {tuple(r) for r in links(df).collect()} == want
    assert {tuple(r) for r in links(df, segments=((34, 2), (30, 1))).collect()} == want


def s(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_of_long_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    root = {r.node: r.root for r in connected_components(df, "a", "b").collect()}
    assert root == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1060), 1000)}


def test_empty_and_odd_ids(no_docs, odd_ids):
    assert simhash_groups(no_docs).count() == 0 and near_dedup(no_docs).count() == 0
    got = sorted(((r.doc_id, r.component_id) for r in simhash_groups(odd_ids).collect()), key=str)
    assert got == sorted([(None, 5), (None, 5), (5, 5), (5, 5), (7, 7), (None, None)], key=str)


def test_rows_that_stay(edges, edge_pairs):
    kept = near_dedup(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in brute.simhash(edge_pairs).items() if x[1] == i)


def test_rows_with_repeated_and_null_ids(spark):
    """A dropped row takes no other row of its id along; rows without an id are dropped like others."""
    a, b, c, d = (" ".join(f"{x}{i * 7 % 41}" for i in range(60)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (None, a), (None, b), (None, c), (None, c), (None, d), (8, "x y z"), (8, "x y z")]
    kept = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(3, a), (5, b), (None, c), (None, d), (8, "x y z"), (8, "x y z")]))


def test_fingerprint_of_very_long_text():
    text = " ".join(f"w{i % 977}" for i in range(40_000))
    assert fingerprint(text) & (1 << 64) - 1 == brute.fingerprint(text)
