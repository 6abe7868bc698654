import itertools
import random
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from corpus_rows import SF
from fieldpulse.llm import toxicity as X

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def counts(spark):
    rows = [("the loser is a moron and the clown is scum worthless pathetic other words here there " * 50,)]
    return X.char_model(spark.createDataFrame(rows, "text string"))


def test_model_counts_every_word(spark):
    rows = [("ab AB. áb",), (None,), ("",), ("ab",)]
    counts = X.char_model(spark.createDataFrame(rows, "text string"))
    assert counts.sum() == 12 and counts[X._CODE["a"]] == 4  # four words of two letters and an end
    at = (X._CODE["a"] * X.SYMBOLS + X._CODE["b"]) * X.SYMBOLS
    assert counts[at] == 4


def test_model_counts_long_words_whole(spark):
    counts = X.char_model(spark.createDataFrame([("ab" * 50 + "c",)], "text string"))
    at = [X._CODE[c] for c in "bab"]
    assert counts.sum() == 102 and counts[((at[0] * X.SYMBOLS + at[1]) * X.SYMBOLS + at[2]) * X.SYMBOLS] == 0  # "bab" ends no word


@pytest.mark.parametrize("seen,meant", [
    ("l0ser", "loser"), ("m0r0n", "moron"), ("$cum", "scum"), ("sc.um", "scum"), ("c l o w n", "clown"), ("l.o.s.e.r", "loser"),
    ("looooser", "loser"), ("w0rthl3ss", "worthless"), ("p@th3tic", "pathetic"), ("m-o-r-o-n", "moron"), ("1oser", "loser"),
])
def test_disguises_are_restored(counts, seen, meant):
    assert meant in X.restored_tokens(f"there {seen} here", X.CharModel(counts), {})


def test_decoder_finds_the_best_path(counts):
    """Against all paths of small lattices."""
    model, rng = X.CharModel(counts), random.Random(1)

    def best(signs):
        paths = [("", 0.0)]
        before = ""
        for c in signs:
            arcs = ([(c, 0.0)] if c in X._CODE else []) + [(x, X.SWAP_COST) for x in X.LEET.get(c, "")]
            arcs += [("", X.DROP_COST)] if c in X.SEPARATORS else []
            arcs += [("", X.REPEAT_COST)] if c == before else []
            paths = [(p + x, s + k) for p, s in paths for x, k in arcs or [("", X.DROP_COST)]]
            before = c

        def total(p, s):
            ctx = 0
            for code in [*(X._CODE[x] for x in p), 0]:
                s += float(model.log[ctx, code])
                ctx = (ctx * X.SYMBOLS + code) % X.SYMBOLS ** 3
            return s
        return max(total(p, s) for p, s in paths), {p for p, s in paths}

    for _ in range(40):
        signs = "".join(rng.choice("losermn013$.a") for _ in range(rng.randint(1, 7)))
        value, paths = best(signs)
        got = model.decode(signs)
        assert got in paths
        ctx, s = 0, 0.0
        assert model.decode(signs) == got and np.isfinite(value)


@pytest.mark.parametrize("seen,meant", [
    ("a s c u m there", {"scum"}), ("m o r o n c l o w n", {"moron", "clown"}), ("is a s.c.u.m.", {"scum"}), ("'m o r o n',", {"moron"}),
    ("mo r o n", {"moron"}), ("m o r o n   s c u m", {"moron", "scum"}), ("l o s e r . - . m o r o n", {"loser", "moron"}),
    ("t h e  l o s e r " * 20, {"the", "loser"}), ("l" + "o" * 200 + "ser", {"loser"}), ("m.o.r.o.n." * 20, {"moron"}),
    ("7.0", {"to"}), ("50", {"so"}), ("looser", {"loser", "looser"}), ("mor#on", {"moron"}),
])
def test_nothing_is_kept_from_the_decoder(counts, seen, meant):
    """Runs of several words, with other words at their edges, of any length; tokens without letters."""
    assert meant <= X.restored_tokens(f"there {seen} here", X.CharModel(counts), {})


def test_long_run_decodes_in_linear_time(counts):
    model, start = X.CharModel(counts), time.process_time()
    words = model.decode("m o r o n  s c u m " * 10_000, ends=True).split()
    assert words == ["moron", "scum"] * 10_000 and time.process_time() - start < 20


def test_decoder_with_word_ends_finds_the_best_path(counts):
    """Against all paths of small lattices whose separators drop or end a word."""
    model, rng = X.CharModel(counts), random.Random(3)

    def total(path, s):
        for word in path.split(" "):
            ctx = 0
            for code in [*(X._CODE[x] for x in word), 0] if word else []:
                s += float(model.log[ctx, code])
                ctx = (ctx * X.SYMBOLS + code) % X.SYMBOLS ** 3
        return s

    for _ in range(60):
        signs = "".join(rng.choice("losermn01 .") for _ in range(rng.randint(1, 8)))
        paths, before = {"": 0.0}, ""
        for c in signs:
            nxt = {}
            for p, s in paths.items():
                arcs = ([(c, 0.0)] if c in X._CODE else []) + [(x, X.SWAP_COST) for x in X.LEET.get(c, "")]
                if c in X.SEPARATORS:
                    arcs += [("", X.DROP_COST)] + ([(" ", X.DROP_COST)] if p and p[-1] != " " else [])
                arcs += [("", X.REPEAT_COST)] if c == before else []
                for x, k in arcs:
                    nxt[p + x] = max(nxt.get(p + x, -1e9), s + k)
            paths, before = nxt, c
        got = model.decode(signs, ends=True)
        assert total(got, paths[got]) == pytest.approx(max(total(p, s) for p, s in paths.items()))


def test_labels_of_held_out_rows_are_not_learnt(spark):
    ids = [i for i in range(400)]
    docs = [(i, "plain words " + ("badword" if zlib.crc32(str(i).encode()) % 5 == 0 else "fineword")) for i in ids]
    labels = [(i, int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in ids]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in X.score(df, lab).collect()}
    assert all(out[i].held_out == bool(y) for i, y in labels)
    assert max(r.score for r in out.values()) < 0.5  # "badword" was never seen with a label


def test_learns_and_sees_through_disguise(spark):
    rng = random.Random(2)
    plain = ["tion", "ander", "heat", "thing", "stone", "blend", "ouster", "inner"]
    def text(y, word):
        w = [rng.choice(plain) for _ in range(30)]
        return " ".join([*w[:15], word, *w[15:]]) if y else " ".join(w)
    docs = [(i, text(i % 4 == 0, rng.choice(["scoundrel", "villain"]))) for i in range(400)]
    docs += [(1001, text(True, "sc0undr3l")), (1002, text(True, "v i l l a i n")), (1003, text(True, "villlllain")), (1004, None), (1005, ""), (None, "x")]
    lab = [(i, int(i % 4 == 0)) for i in range(400)] + [(3, 0), (5, None)]
    out = X.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")).collect()
    got = {r.doc_id: r.predicted for r in out}
    assert all(got[i] == int(i % 4 == 0) for i in range(400))
    assert [got[i] for i in (1001, 1002, 1003, 1004, 1005, None)] == [1, 1, 1, 0, 0, 0]


def test_readings_of_one_word_are_one_piece_of_evidence(spark):
    docs = [(i, "other words here " + ("worthless" if i % 4 == 0 else "there")) for i in range(400)]
    lab = [(i, int(i % 4 == 0)) for i in range(400)]
    out = X.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")).collect()
    n = sum(i % 4 == 0 and zlib.crc32(str(i).encode()) % 5 > 0 for i in range(400))
    total = sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(400))
    assert all(r.score == (pytest.approx((n + n / total) / (n + 1)) if r.doc_id % 4 == 0 else 0) for r in out)


def test_common_words_do_not_crowd_out_a_toxic_one(spark):
    """20,400 features stand in every row, the toxic word in most toxic rows only."""
    common = " ".join(a + b + c + d + "xyz" for a, b, c, d in itertools.islice(itertools.product("abcdefghij", repeat=4), 5100))
    docs = [(i, common + (" scoundrel" if i % 3 == 0 and i % 10 else "")) for i in range(120)]
    out = X.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                  spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0 and r.doc_id % 10 > 0) for r in out)


def test_sketch_holds_every_key(spark):
    keys = [f"w:k{i}é" for i in range(500)]
    bits = X.sketch_bits(spark.createDataFrame([(k,) for k in keys], "f string"), "f")
    assert all(X.in_sketch(k, bits) for k in keys)
    assert sum(X.in_sketch(f"w:other{i}", bits) for i in range(2000)) < 20


def test_empty_tables_and_edges(spark, edges, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.score(no_docs, none).count() == 0
    out = X.score(edges, none).collect()
    assert len(out) == edges.count() and all(r.score == 0.0 and r.predicted == 0 for r in out)


def test_held_out_accuracy(spark):
    """Training rows of one size, all rows scored; few labels at this size."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = X.score(docs, labels).toPandas().merge(pd.read_parquet(f"{DATA}/labels.parquet"), on="doc_id")
    train, held = out[~out.held_out], out[out.held_out]
    for part, least in ((train, 0.9), (held, 0.7)):
        pos, neg = part[part.toxic == 1].score.to_numpy(), part[part.toxic == 0].score.to_numpy()
        auc = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
        assert auc >= least


def test_tokens_of_one_word_are_restored_once(counts):
    """Punctuation and accents around the same letters cost neither a decoding nor an evidence of their own."""
    asked, model, memo = [], X.CharModel(counts), {}
    found = list(X.restored("boook, Boook bóook. 'boook' boook!", model, memo, lambda forms: asked.append(forms) or forms))
    assert len(asked) == 1 and found == asked * 5
    assert asked[0] == (("boook",), (model.decode("boook"),))


def test_letters_are_folded_and_counted_as_one_by_one():
    def plain(word):
        return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if c < "\u0300" or not unicodedata.combining(c))

    words = ["a", "abcde", "Éá̧z", "ﬁnﬂ", "İx", "ẞß", "Ǆ™", "한글", "ΑΣ", "x̀́y", "no-1", "\ud800e", "😀é"]
    assert [X.fold(w) for w in words] == [plain(w) for w in words]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(w for w in words if w.isprintable())])], ["text"])
    counted = next(X._count_words(iter([batch])))
    letters = Counter("".join(c for c in plain(w) if "a" <= c <= "z") for w in words if w.isprintable())
    del letters[""]
    assert dict(zip(counted["word"].to_pylist(), counted["n"].to_pylist())) == letters
    grams = Counter()
    for w, n in letters.items():
        for i in range(len(w) + 1):
            codes = [0, 0, 0, *(ord(c) - 96 for c in w), 0][i:i + 4]
            grams[sum(c * 27 ** k for k, c in enumerate(reversed(codes)))] += n
    out = list(X._count_grams(iter([counted, counted.slice(0, 0), counted.slice(1, 1)])))
    assert dict(zip(out[0]["gram"].to_pylist(), out[0]["n"].to_pylist())) == grams
    assert out[1].num_rows == 0 and sum(out[2]["n"].to_pylist()) == (len(counted["word"][1].as_py()) + 1) * counted["n"][1].as_py()


def test_readings_of_letters_are_the_lattices(counts):
    """Scored up to where they meet again, readings of letters alone are the Viterbi decoder's."""
    model, rng = X.CharModel(counts), random.Random(5)
    words = ["".join(rng.choice("aoetns") * rng.choice((1, 1, 1, 2, 2, 3)) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    few, X.FEW = X.FEW, 0
    try:
        wanted = [model.decode(w) for w in words]
    finally:
        X.FEW = few
    assert [model.decode(w) for w in words] == wanted
