import brute
import pandas as pd

from corpus_rows import SF
from fieldpulse.llm.chat import ORACLE, chat_format

SCHEMA = "conv_id long, turn int, role string, text string, conv string, n int, last int"


def found(df):
    return {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in df.collect()}


def rows(pairs):
    return [(*p, "c", 1, 2) for p in pairs]


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "done")]
    pairs = [(c, t, *turns[t]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for t in range(n)]
    pairs += [(6, 0, "user", "hi"), (6, 1, "assistant", "hello!"), (7, 0, "user", None), (8, 0, None, "hi"), (9, None, "user", "")]
    pairs += [(10, 3, "user", "tie"), (10, 3, "user", "tie"), (None, 0, "user", "lost"), (11, 0, "user", "x" * 100_000)]
    got = found(chat_format(spark.createDataFrame(rows(pairs), SCHEMA)))
    assert got == brute.chat(pairs)
    assert set(got) >= {3, 6, 8, 10, 11, None} and not set(got) & {1, 2, 4, 5}


def test_given_table(spark):
    frame = pd.read_parquet(f"{SF}/conversations.parquet")
    got = found(chat_format(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert got == brute.chat(frame[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    assert set(brute.sql(ORACLE["op5_chat"], conversations=frame).conv_id) == set(got)


def test_empty(spark):
    assert chat_format(spark.createDataFrame([], SCHEMA)).count() == 0
