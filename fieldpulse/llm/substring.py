"""Substring dedup over prefix-partitioned, sparse suffix trees.

A window is LENGTH consecutive words.  Of a document's suffixes only those are
kept that start at the smallest PREFIX-word hash of some window (its anchor), so
that equal windows have equal anchors at the same place.  The suffixes are dealt
by their PREFIX-word prefix; a prefix found in one document only has no repeat
and is left.  The rest carry the ids of their nodes at depth LENGTH: the hashes
of the windows anchored there.  A node reached from two documents is a deep
internal node, a repeat; its smallest document keeps it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flag_sketched, key_sketch, read_table, shared_table, text_of

LENGTH = 13
PREFIX = 5
#: Suffixes that one task streams as a group; larger groups are aggregated and joined back instead.
HOT = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_NULL_ID = (1 << 63) - 1


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes, well mixed."""
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * _M + h[j:len(h) - k + 1 + j]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix hashes, anchor place of each window)."""
    g = _grams(h, PREFIX)
    span = LENGTH - PREFIX + 1
    anchor = np.empty(len(h) - LENGTH + 1, np.int64)
    for a in range(0, len(anchor), 1 << 16):  # blocks bound the memory of a very long text
        b = min(a + (1 << 16), len(anchor))
        view = np.lib.stride_tricks.sliding_window_view(g[a:b + span - 1], span)
        anchor[a:b] = view.argmin(axis=1) + np.arange(a, b)
    return g, anchor


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gs, docs, locs = [], [], []
        for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            words = text.as_py().encode().split()
            if len(words) >= LENGTH:
                g, anchor = _anchors(_hashes(words))
                at = np.unique(anchor)
                gs.append(g[at])
                docs.append(np.full(len(at), doc, np.int64))
                locs.append(at | (th << 32))
        if gs:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(gs).view(np.int64)), pa.array(np.concatenate(docs)),
                 pa.array(np.concatenate(locs))], ["g", "doc", "loc"])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, text, anchors) -> a row per anchor: prefix, doc, th, first window, window hashes."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, th, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            h = _hashes(text.as_py().encode().split())
            g, anchor = _anchors(h)
            raw = _grams(h, LENGTH).tobytes()
            at = np.unique(np.array(places.as_py(), np.int64))
            first, last = np.searchsorted(anchor, at), np.searchsorted(anchor, at, "right")
            out[0].append(g[at].view(np.int64))
            out[1].append(np.full(len(at), doc, np.int64))
            out[2].append(np.full(len(at), th, np.int64))
            out[3].append(first)
            out[4].extend(raw[8 * a:8 * z] for a, z in zip(first.tolist(), last.tolist(), strict=True))
        if out[0]:
            arrays = [pa.array(np.concatenate(x)) for x in out[:4]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out[4], pa.binary())], ["g", "doc", "th", "first", "nodes"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node of each anchor: prefix, node, doc, th, window."""
    for b in batches:
        if b.num_rows:
            g, doc, th, first = (b.column(i).to_numpy() for i in range(4))
            row, node, start = _expand(b.column(4), first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (g[row], node.view(np.int64), doc[row], th[row], start)], ["g", "node", "doc", "th", "a"])


def _expand(nodes: pa.BinaryArray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, window) of every packed node."""
    offsets = np.frombuffer(nodes.buffers()[1], np.int32, len(nodes) + 1, 4 * nodes.offset)
    counts = np.diff(offsets) // 8
    node = np.frombuffer(nodes.buffers()[2], np.uint64, int(counts.sum()), int(offsets[0]))
    row = np.repeat(np.arange(len(nodes)), counts)
    return row, node, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors in the order of (prefix, document): stretches of words under
    windows whose node a smaller document has.  Between batches only the nodes of
    the last prefix are kept, with their first document."""
    last: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for b in batches:
        if not b.num_rows:
            continue
        g, doc, th, first = (b.column(i).to_numpy() for i in range(4))
        row, node, start = _expand(b.column(4), first)
        gs = np.concatenate([last[0], g[row]])
        nodes = np.concatenate([last[1], node])
        docs = np.concatenate([last[2], doc[row]])
        order = np.lexsort((docs, nodes, gs))
        gs, nodes, docs = gs[order], nodes[order], docs[order]
        new = np.concatenate([[True], (gs[1:] != gs[:-1]) | (nodes[1:] != nodes[:-1])])
        least = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        tail = new & (gs == g[-1])
        gone = np.zeros(len(gs), bool)
        gone[order] = docs > least
        gone = gone[len(last[0]):]
        last = (gs[tail], nodes[tail], docs[tail])
        at, row = start[gone], row[gone]
        if len(at):
            cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
            ends = at[np.append(cut[1:], len(at)) - 1] + LENGTH
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[row[cut]]), pa.array(th[row[cut]]), pa.array(at[cut]), pa.array(ends)], ["doc", "th", "a", "b"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, stretches) -> doc_id, n_words, n_removed, kept words joined by a space."""
    for b in batches:
        total, removed, kept = [], [], []
        for text, spans in zip(b.column(1), b.column(2), strict=True):
            words = text.as_py().encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans.as_py() or ():
                gone[s["a"]] += 1
                gone[s["b"]] -= 1
            stay = np.cumsum(gone)[:-1] == 0
            n = int(stay.sum())
            total.append(len(words))
            removed.append(len(words) - n)
            if n < len(words):
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.large_string())],
            ["doc_id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row (doc_id, n_words, n_removed, text) per row of ``docs``; ``text`` is
    the words that stay, joined by one space.

    A word goes if a window over it also starts in a document with a smaller
    id; windows are judged on the input.  A prefix of up to ``hot`` suffixes is one
    group, streamed in sorted order by one task.  Larger groups are not held
    together: their nodes' smallest documents are pre-aggregated and joined back
    on written tables, whose hot keys adaptive execution splits.  Texts are
    shuffled only for rows that a fixed-size sketch flags as having a shared
    prefix, and again for those that lose words.

    Null ids count as the largest id, so they keep nothing that another row has
    and give nothing away; among rows of one id nothing is removed.  Null and
    empty texts have no words; texts of fewer than LENGTH words lose none.
    Repeated rows give repeated rows; an empty table an empty result; other
    columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"),
                       F.expr("xxhash64(text) & 2147483647L").alias("th"), "text")  # tells rows of one id apart
    suffixes = rows.select("doc", "th", "text").mapInArrow(_suffixes, "g bigint, doc bigint, loc bigint")
    shared = (suffixes.groupBy("g").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("z"))
              .where("a < z").select("g", (F.col("n") > hot).alias("hot")))
    shared = shared_table(shared, "substring-prefixes")
    places = (suffixes.join(shared, "g").groupBy("doc", F.shiftright("loc", 32).alias("th"), "hot")
              .agg(F.collect_list(F.expr("loc & 4294967295L")).alias("places")))  # at most a document's words
    places = shared_table(places, "substring-anchors")

    def flagged(keys: DataFrame) -> DataFrame:
        sketch = key_sketch(keys.select(F.xxhash64("doc", "th").alias("_h")), "_h")
        return flag_sketched(rows.withColumn("_h", F.xxhash64("doc", "th")), "_h", sketch, "_may")

    def anchors(keys: DataFrame) -> DataFrame:
        return (flagged(keys).where("_may").dropDuplicates(["doc", "th"]).join(keys, ["doc", "th"])
                .select("doc", "th", "text", "places")
                .mapInArrow(_nodes, "g bigint, doc bigint, th bigint, first bigint, nodes binary"))

    found = (anchors(places.where("not hot")).repartition("g").sortWithinPartitions("g", "doc")
             .mapInArrow(_repeats, "doc bigint, th bigint, a bigint, b bigint"))
    nodes = shared_table(anchors(places.where("hot")).mapInArrow(
        _unpack, "g bigint, node bigint, doc bigint, th bigint, a bigint"), "substring-hot")
    least = shared_table(nodes.groupBy("g", "node").agg(F.min("doc").alias("least"), F.max("doc").alias("z"))
                         .where("least < z").drop("z"), "substring-hot-nodes")
    spread = (nodes.join(least, ["g", "node"]).where("doc > least")
              .select("doc", "th", "a", (F.col("a") + LENGTH).alias("b")))
    spans = found.unionByName(spread).groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = shared_table(spans, "substring-spans")
    split = flagged(spans)
    whole = split.where("not _may").select("doc_id", "text", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("spans"))
    cut = split.where("_may").join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, text string"
    return whole.mapInArrow(_keep, schema).unionByName(cut.mapInArrow(_keep, schema))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = {"op4_substring": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM rep)),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""}
