"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flag_sketched, key_sketch, read_table, shared_table, text_of
from .vocab import byte_bpe

#: A cut where the low bits of the rolling hash are zero: chunks of some 2^BITS bytes.
BITS = 10
MIN_CHUNK = 64
#: The rolling hash covers this many bytes.
REACH = 16
_GEAR = np.random.default_rng(20240118).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_cuts(raw: bytes) -> list[int]:
    """Starts of the content-defined chunks of a text, and its length at the end.

    Chunks start at UTF-8 characters; the first hash that counts has all its
    REACH bytes inside the text, so equal passages cut alike in any document."""
    n = len(raw)
    if n <= 2 * MIN_CHUNK:
        return [0, n] if n else [0]
    data = np.frombuffer(raw, np.uint8)
    h = _GEAR[data]
    span = 1
    while span < REACH:  # h[i] over bytes i - 2 * span + 1 .. i, each byte shifted by its age
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    at = np.flatnonzero((h[REACH - 1:-1] & np.uint32((1 << BITS) - 1)) == 0) + REACH
    at = at[(data[at] & 0xC0) != 0x80]
    cuts = [0]
    for c in at.tolist():
        if c - cuts[-1] >= MIN_CHUNK:
            cuts.append(c)
    return [*cuts, n]


def safe_span(chunk: bytes) -> tuple[int, int] | None:
    """First and last place of a chunk where a letter, digit or sign is followed
    by white space.  The pre-tokenizer always splits there whatever stands
    around, and so a text's ids are those of its parts between such places."""
    data = np.frombuffer(chunk, np.uint8)
    here, before = data[1:], data[:-1]
    space = (here == 0x20) | (here == 0x0A) | (here == 0x09) | (here == 0x0D)
    shown = (before > 0x20) & (before < 0x7F)
    # two-byte characters from U+00C0 on are no white space
    shown[1:] |= (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & (before[1:] >= 0x80) & (before[1:] < 0xC0)
    places = np.flatnonzero(space & shown) + 1
    return (int(places[0]), int(places[-1])) if len(places) > 1 else None


def _keys(raw: bytes) -> list[bytes]:
    cuts = chunk_cuts(raw)
    return [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = pa.array([_keys(t.as_py().encode()) for t in b.column(1)], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([b.column(0), keys], ["th", "keys"])


def _encode_owned(path: str):
    """(text, positions of the chunks it owns) -> (key, ids between the chunk's safe places)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in batches:
            keys, ids = [], []
            for text, owned in zip(b.column(0), b.column(1), strict=True):
                raw = text.as_py().encode()
                cuts = chunk_cuts(raw)
                for i in owned.as_py():
                    chunk = raw[cuts[i]:cuts[i + 1]]
                    span = safe_span(chunk)
                    if span:
                        keys.append(xxhash.xxh3_128_digest(chunk))
                        ids.append(bpe.encode(chunk[span[0]:span[1]].decode()).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], ["key", "ids"])
    return run


def join_chunks(raw: bytes, known: dict[int, bytes], bpe) -> bytes:
    """Ids of a text from the ids known for some of its chunks.

    What lies between two known stretches (the chunks without known ids and the
    ends of the known ones) is encoded again as one text.  A stretch begins and
    ends at safe places, where both sides split alike, so the pieces agree
    exactly; a chunk without two safe places has no stretch, and the repaired
    part grows over it to the next one."""
    cuts, parts, done = chunk_cuts(raw), [], 0
    for i in sorted(known):
        first, last = safe_span(raw[cuts[i]:cuts[i + 1]])
        parts.append(bpe.encode(raw[done:cuts[i] + first].decode()).tobytes())
        parts.append(known[i])
        done = cuts[i] + last
    parts.append(bpe.encode(raw[done:].decode()).tobytes())
    return b"".join(parts)


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in batches:
            ids = [join_chunks(t.as_py().encode(), {r["i"]: r["ids"] for r in (k.as_py() or [])}, bpe)
                   for t, k in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.large_binary())], ["th", "ids"])
    return run


def _encode_whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in batches:
            ids = pa.array([bpe.encode(t.as_py()).tobytes() for t in b.column(1)], pa.large_binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])
    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, ids) per row of ``docs``: the ids of the whole text as
    the ``tokenizers`` library gives them for the byte-level file at ``path``
    (on every node), packed little-endian in ``vocab.ByteBPE.dtype``.

    1. Texts are cut into content-defined chunks; a narrow table keeps, per
    text hash, the chunks' 128-bit hashes.  2. A text that occurs once and shares
    no chunk is encoded where it is read.  3. Of the other texts, found by a
    fixed-size sketch, one row each is kept; a shared chunk is encoded once, in
    the text that has it first; 4. texts are joined from those ids and the
    repaired parts between them, and given to their copies.  A text the sketch
    flags wrongly only takes the longer way.  Hot chunks and copies are folded
    before shuffles, and joins back to them are on written tables, which
    adaptive execution splits.

    Null is the empty text (no ids).  Repeated rows give repeated rows, null ids
    stay null, an empty table gives an empty result; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("th", F.md5("text"))
    chunks = shared_table(rows.select("th", "text").mapInArrow(_chunk_keys, "th string, keys array<binary>"), "bpe-chunks")
    texts = chunks.groupBy("th").agg(F.count("*").alias("n"), F.first("keys").alias("keys"))
    texts = shared_table(texts, "bpe-texts")
    places = texts.select("th", F.posexplode("keys").alias("i", "key"))
    owners = places.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("th", "i")).alias("own")).where("n > 1")
    owners = shared_table(owners.select("key", "own.th", "own.i"), "bpe-owners")
    shared = shared_table(places.join(owners.select("key"), "key"), "bpe-shared")
    some = shared.select("th").unionByName(texts.where("n > 1").select("th")).select(F.xxhash64("th").alias("_h"))
    flagged = flag_sketched(rows.withColumn("_h", F.xxhash64("th")), "_h", key_sketch(some, "_h"), "_may")

    id_type = docs.schema[id_col].dataType.simpleString()
    whole = flagged.where("not _may").select("doc_id", "text").mapInArrow(
        _encode_whole(path), f"doc_id {id_type}, ids binary")
    kept = shared_table(flagged.where("_may").groupBy("th").agg(F.first("text").alias("text")), "bpe-kept")
    work = owners.groupBy("th").agg(F.collect_list("i").alias("owned"))  # at most a text's chunks
    known = shared_table(kept.join(work, "th").select("text", "owned").mapInArrow(
        _encode_owned(path), "key binary, ids binary"), "bpe-known")
    parts = shared.join(known, "key").groupBy("th").agg(F.collect_list(F.struct("i", "ids")).alias("known"))
    joined = shared_table(kept.join(parts, "th", "left").select("th", "text", "known").mapInArrow(
        _assemble(path), "th string, ids binary"), "bpe-joined")
    copies = flagged.where("_may").select("doc_id", "th").join(joined, "th").select("doc_id", "ids")
    return whole.unionByName(copies)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text), special tokens kept; bytes that are no
    UTF-8 become the replacement character."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in batches:
            out = pa.array([bpe.decode(np.frombuffer(x.as_py(), bpe.dtype)) for x in b.column(1)], pa.large_string())
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["doc_id", "text"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1):
                ids = np.frombuffer(x.as_py(), bpe.dtype)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(encode(read_table(spark, sf_dir, "documents"), path), path)
