"""Chat formatting with cumulative-snapshot collapse, built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, shared_table

# The chat template.
TURN = ("<|", "|>\n", "<|end|>\n")


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with the order inside a conversation and two content hashes."""
    turns = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    return turns.select("*", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies): conversations that no longer one starts with;
    of equal ones the smallest id.

    A turn's hash is tagged with its position, and the running XOR of the
    tagged hashes is the hash of the prefix (two independent 64-bit ones).  A
    conversation's last prefix hash is its own; it is collapsed if some other
    conversation has it before its last turn.  Prefixes shared by many
    conversations are folded before the anti-join.  Only ids, positions and
    hashes are shuffled."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "h1", "h2")
    t = _turns(conversations).select("conv", "turn", "role", "h1", "h2").withColumn("n", F.row_number().over(order))
    t = t.withColumn("last", F.lead("n").over(order).isNull())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for h in ("h1", "h2"):
        t = t.withColumn(f"p{h[1]}", F.bit_xor(F.xxhash64(F.lit(int(h[1])), "n", h)).over(upto))
    whole = t.where("last").groupBy("n", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    parts = t.where("not last").groupBy("n", "p1", "p2").agg(F.lit(1).alias("_one"))
    kept = whole.join(parts, ["n", "p1", "p2"], "left_anti")
    return kept.select("conv", F.col("n").cast("long").alias("n_turns"), "n_copies")


def chat_format(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies (logged
    conversations equal to it, itself included), rendered.

    Turns are ordered by (turn, role, hash of the text), nulls first; null role
    or text is empty.  Rows with null conv_id form one conversation.  Repeated
    rows are turns of their own.  Only turns of maximal conversations are gathered.  A rendered conversation is one value, so a
    conversation has to fit one row (2 GB).  Empty input: empty result."""
    kept = shared_table(maximal_conversations(conversations), "chat")
    turns = _turns(conversations).withColumnRenamed("conv", "conv_id")
    turns = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("conv"))).withColumn("line", F.concat(
        F.lit(TURN[0]), F.col("role"), F.lit(TURN[1]), F.col("text"), F.lit(TURN[2])))
    lines = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "h1", "h2", "line")))
    return turns.groupBy("conv_id", "n_turns", "n_copies").agg(lines.alias("lines")).select(
        "conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(read_table(spark, sf_dir, "conversations"))


ORACLE = {"op5_chat": """
WITH c AS (SELECT conv_id, count(*) AS n, list('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10)
             ORDER BY turn NULLS FIRST, role) AS lines FROM conversations GROUP BY conv_id),
p AS (SELECT DISTINCT list_slice(lines, 1, i) AS lines FROM (SELECT lines, unnest(range(1, n)) AS i FROM c))
SELECT min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_copies, array_to_string(lines, '') AS rendered
FROM c ANTI JOIN p USING (lines) GROUP BY lines
"""}
