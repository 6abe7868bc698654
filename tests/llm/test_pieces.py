import hashlib
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from corpus_rows import SF
from fieldpulse.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(packed):
    return np.frombuffer(packed, P.pieces(PATH).dtype).tolist()


def wanted(library, pairs):
    return sorted(((i, library.encode(t or "", add_eos=True)) for i, t in pairs), key=str)


def found(df):
    return sorted(((r.doc_id, ids(r.ids)) for r in df.collect()), key=str)


TEXTS = ["", " ", "  ", "a ", " a", "a  b", "a\nb", "\n", "\na", " \n", "\n \n  x", "a \nb", "a  \n", "\r\n x;\r\n y", "\t\ta",
         "▁a", "a▁b", "▁▁ ▁b", "\x00a", "<s> x</s> <unk> <0x0A>", "é̀", "ﬁ ① z", "😀 日本 ▁", "x" * 5000,
         " " * 50 + "q", "\n" * 20, "q" + " " * 40]


def test_marked_words_have_the_ids_of_the_whole_text(library):
    own = P.pieces(PATH)
    known = own.segment({w for t in TEXTS for w in P.marked_words(t)})
    for t in TEXTS:
        assert ids(b"".join(known[w] for w in P.marked_words(t))) == library.encode(t)


def test_same_as_library(spark, library, edges, edge_pairs, odd_ids, no_docs):
    assert found(P.encode(edges, PATH)) == wanted(library, edge_pairs)
    assert found(P.encode(odd_ids, PATH)) == wanted(library, [(r.doc_id, r.text) for r in odd_ids.collect()])
    assert P.encode(no_docs, PATH).count() == 0
    back = {r.doc_id: r.text for r in P.decode(P.encode(edges, PATH), PATH).collect()}
    assert back == {i: library.decode(library.encode(t or "")) for i, t in edge_pairs}


def test_words_outside_the_head_are_joined(spark, library, monkeypatch, small_pairs):
    """A head of a few words and small blocks: most words come from the table by the join."""
    monkeypatch.setattr(P, "HEAD_BYTES", 2000)
    docs = spark.createDataFrame([(f"t{i}", t) for i, t in small_pairs[:60]], "key string, body string")
    assert found(P.encode(docs, PATH, "key", "body")) == wanted(library, [(f"t{i}", t) for i, t in small_pairs[:60]])


def test_each_shared_word_is_in_the_table_once(spark):
    docs = spark.createDataFrame([(1, "a b a\nb c"), (2, "c d b"), (3, None)], "doc_id long, text string")
    rows = P.word_table(docs, PATH).collect()
    assert sorted((r.word, r.n) for r in rows) == [("a", 2), ("b", 2), ("c", 2)]  # "\nb" has no marker: another word, once


def head_of(words, monkeypatch):
    """A worker's head of the words, each with its own text as ids."""
    monkeypatch.setattr(P, "_heads", {})
    table = pa.table({"word": pa.array(words, pa.string()), "ids": pa.array([w.encode() for w in words], pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return P.Head("k", SimpleNamespace(value=sink.getvalue().to_pybytes()))


def test_a_worker_holds_the_head_in_a_few_bytes_a_word(monkeypatch):
    """A dict of these words took 125 bytes a word in every worker, besides the stream."""
    n = 200_000
    head = head_of([f"w{i}" for i in range(n)], monkeypatch)
    tracemalloc.start()
    before, arrow = tracemalloc.get_traced_memory()[0], pa.total_allocated_bytes()
    words = head.words()
    taken = tracemalloc.get_traced_memory()[0] - before + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert taken < 40 * n
    assert head.words() is words


def test_words_of_one_hash_and_empty_heads(monkeypatch):
    monkeypatch.setattr(P, "hash", len, raising=False)
    words = head_of(["a", "bb", "", "cc", "é"], monkeypatch).words()
    asked = ["bb", "cc", "a", "é", "zzz", "", "x"]
    held = words.ids(asked)
    assert all(held[w] == w.encode() for w in held) and held.keys() <= {"a", "bb", "", "cc", "é"}
    assert "" in held and len(held.keys() & {"bb", "cc"}) == 1 and len(held.keys() & {"a", "é"}) == 1
    assert words.find(asked)[0].tolist() == [w in held for w in asked]
    assert words.ids([]) == {} == head_of([], monkeypatch).words().ids(["a"])


def test_byte_strings_of_slices():
    for kind in (pa.binary(), pa.large_binary()):
        a = pa.array([b"ab", b"", b"c", b"def"], kind)
        assert [P._byte_strings(a.slice(i)) for i in range(5)] == [a.slice(i).to_pylist() for i in range(5)]
        assert P._byte_strings(a.slice(1, 1)) == [b""] and P._byte_strings(pa.array([], kind)) == []


def test_a_task_holds_one_worker(spark, library, edges, edge_pairs):
    """Two steps of one stage are two workers for every running task, each with its own model and head."""
    row = P.encode(edges, PATH, then=P.digests(PATH), columns=P.DIGESTS)
    want = [(i, len(k := library.encode(t or "", add_eos=True)), hashlib.sha256(" ".join(map(str, k)).encode()).hexdigest(),
             hashlib.sha256(library.decode(k).encode()).hexdigest()) for i, t in edge_pairs]
    assert sorted((tuple(r) for r in row.collect()), key=str) == sorted(want, key=str)
    for df in (row, P.op13_pieces(spark, SF)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        steps = [line.lstrip(" :+-") for line in plan.splitlines()]
        steps = [s.split("(")[0].split(" ")[0] for s in steps if not s.startswith("Project")]
        assert "MapInArrow" in steps
        assert ("MapInArrow", "MapInArrow") not in zip(steps, steps[1:])
