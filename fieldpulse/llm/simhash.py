"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flag_sketched, key_sketch, read_table, shared_table, text_of
from .components import connected_components

#: (bits, radius) of each segment of the 64-bit fingerprint, low bits first.  Two
#: fingerprints at distance d or less agree within the radius on some segment if
#: the sum of (radius + 1) is over d.  Wider segments make smaller buckets and
#: more probes: ((34, 2), (30, 1)) suits some 10^10 distinct fingerprints.
SEGMENTS = ((23, 1), (23, 1), (18, 0))


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text (A-Z lower-cased)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist(), strict=True)
    hashes = np.array([digest(line[s:e], 42) for s, e in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def links(fps: DataFrame, max_distance: int = 4, segments=SEGMENTS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints at ``max_distance`` bits
    or fewer.  Each fingerprint looks up the Hamming ball of each of its
    segments in the table of segment values; the distance check is part of the
    join, so unverified candidates never leave it."""
    if sum(w for w, _ in segments) != 64 or sum(r + 1 for _, r in segments) <= max_distance:
        raise ValueError("segments must cover 64 bits and their radii the distance")
    entries, probes, low = [], [], 0
    for i, (width, radius) in enumerate(segments):
        part = f"(shiftrightunsigned(fp, {low}) & {(1 << width) - 1 if width < 64 else -1}L)"
        masks = [0]
        if radius >= 1:
            masks += [1 << j for j in range(width)]
        if radius >= 2:
            masks += [1 << j | 1 << k for j in range(width) for k in range(j)]
        if radius > 2:
            raise ValueError("radius 2 is the largest")
        entries.append(f"named_struct('seg', {i}, 'val', {part})")
        ball = "array(" + ", ".join(f"{m}L" for m in masks) + ")"
        probes.append(f"transform({ball}, m -> named_struct('seg', {i}, 'val', {part} ^ m))")
        low += width
    table = fps.select(F.col("fp").alias("b"), F.explode(F.expr(f"array({', '.join(entries)})")).alias("k"))
    probe = fps.select(F.col("fp").alias("a"), F.explode(F.expr(f"concat({', '.join(probes)})")).alias("k"))
    table, probe = table.select("b", "k.*"), probe.select("a", "k.*")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    found = probe.join(table, (probe.seg == table.seg) & (probe.val == table.val) & (F.col("a") < F.col("b")) & near)
    return found.select("a", "b").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """One row (doc_id, fp, component_id) per row of ``docs``.

    Rows with equal fingerprints are folded into one before the search, so a
    group of copies costs one fingerprint.  ``component_id`` is the smallest id
    reachable over links (null if the component has null ids only).  Null and
    empty texts have fingerprint zero and link like any other; repeated rows
    share a component; an empty table gives an empty result.  Other columns are
    not read."""
    return _groups(docs, id_col, text_col, shingle, max_distance).select("doc_id", "fp", "component_id")


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_distance: int) -> DataFrame:
    """``simhash_groups`` with the fingerprint that stands for the component."""
    members = shared_table(fingerprints(docs, id_col, text_col, shingle), "simhash")
    fps = shared_table(members.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(shared_table(links(fps, max_distance), "simhash-links"), "a", "b")
    linked = fps.join(roots, F.col("fp") == F.col("node"))
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    # fingerprints without a link keep their own first id
    # written, so that adaptive execution can split the join of a hot fingerprint
    known = fps.join(linked, F.col("fp") == F.col("_fp"), "left").select(
        F.col("fp").alias("_fp"), F.when(F.col("_fp").isNull(), F.col("first"))
        .otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    known = shared_table(known, "simhash-known")
    return members.join(known, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id", "root")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of each component
    the rows with the smallest id; of a component without any id one row.  Rows
    are told apart by id and fingerprint, as an id may repeat."""
    groups = _groups(docs, id_col, text_col, shingle, max_distance)
    stays = F.when(F.col("component_id").isNull(), F.col("fp") == F.col("root")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = shared_table(groups.where(~stays).select(F.col("doc_id").alias("_gone"), F.col("fp").alias("_gone_fp")).distinct(), "simhash-dropped")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_h", F.xxhash64("_id"))
    rows = flag_sketched(rows, "_h", key_sketch(gone.select(F.xxhash64("_gone").alias("_h")), "_h"), "_may")

    @F.pandas_udf(T.LongType())
    def fingerprint_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, shingle)).astype("int64")

    known = F.col("_id").isNotNull()
    checked = rows.where(~known | F.col("_may")).withColumn("_fp", fingerprint_of("_text"))
    checked = checked.join(gone, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_fp") == F.col("_gone_fp")), "left_anti")
    # rows without an id that are left have one fingerprint in each component
    nameless = checked.where(~known).groupBy("_fp").agg(F.min_by("_row", "_text").alias("_row"))
    return (rows.where(known & ~F.col("_may")).select("_row.*").unionByName(checked.where(known).select("_row.*"))
            .unionByName(nameless.select("_row.*")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
