"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_table, text_of

MARK = "▁"
#: Bytes of the table's most frequent words (with their ids) that every task gets.
HEAD_BYTES = 24_000_000
#: Bytes a word of the head is counted with besides its own and its ids.
ENTRY = 16
#: Texts are joined with their ids in blocks of consecutive rows of some so many bytes.
BLOCK = 1 << 20
#: A task passes on its word counts when it holds so many words.
HELD = 400_000
#: Words of the head that are Python objects at a time while it is indexed.
SLICE = 1 << 15

#: A step of a task over its batches.
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_SPLIT = re.compile(r"\n[^ \n]*| +[^ \n]*")


def marked_words(text: str) -> list[str]:
    """The text cut before every line break and before every run of white-space
    markers (a blank is a marker, and the library puts one before the text).

    A word is given without its first marker, so ``""`` is a marker alone; one
    that starts with a line break has no marker."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if text[0] != " " and "  " not in text:
        return text.replace("\n", " \n").split(" ")
    return [w if w[0] == "\n" else w[1:] for w in _SPLIT.findall(" " + text)]


class Pieces:
    """A SentencePiece model whose pieces cannot cross the cuts of ``marked_words``."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p) or "\n" in p and len(p) > 1]
        if crossing or self.model.normalize(" a\u00a0\ufb01  ") != f"{MARK * 2}a\u00a0\ufb01{MARK * 2}":
            raise ValueError("not a model with an initial marker, unchanged white space and pieces inside marked words")
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self.end = np.array([self.model.eos_id()], self.dtype).tobytes()
        self.numerals = [str(i) for i in range(len(pieces))]

    def segment(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of each word.  The library marks a word's start; before a
        line break, that marker stands alone and is dropped again."""
        words = list(words)
        found = self.model.encode([w or "\n" for w in words], num_threads=1)
        cut = [ids[:1] if not w else ids[1:] if w[0] == "\n" else ids for w, ids in zip(words, found, strict=True)]
        flat = np.array([i for ids in cut for i in ids], self.dtype).tobytes()
        ends = np.cumsum([0, *map(len, cut)]) * self.dtype.itemsize
        return {w: flat[a:b] for w, a, b in zip(words, ends[:-1], ends[1:], strict=True)}

    def decode(self, packed: bytes) -> str:
        return self.model.decode(np.frombuffer(packed, self.dtype).tolist())


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _byte_strings(a: pa.Array) -> list[bytes]:
    """``to_pylist`` of a binary array without nulls, without a scalar each."""
    if not len(a):
        return []
    ends = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_binary(a.type) else np.int32)[a.offset:a.offset + len(a) + 1]
    flat, first = a.buffers()[2], int(ends[0])
    flat = flat.slice(first, int(ends[-1]) - first).to_pybytes() if flat is not None else b""
    ends = (ends - first).tolist()
    return [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _distinct(texts: list[list[str]]) -> list[str]:
    """Their words once each, in their order (so neighbours in memory)."""
    return list(dict.fromkeys(chain.from_iterable(texts)))


class HeadIds:
    """Ids of the head's words, in about the bytes of its Arrow table: a dict of
    its words would take five times that, in every worker.

    Rows are found by Python's hash of the word (fixed within a worker) in a
    sorted array, and the words compared.  Of two words with one hash one isn't
    found; the block that holds it segments it, as any word that it isn't given."""

    def __init__(self, table: pa.Table):
        self.words, self.packed = (c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() for c in table.columns)
        hashes = np.empty(len(self.words), np.int64)
        for start in range(0, len(hashes), SLICE):
            part = self.words.slice(start, SLICE).to_pylist()
            hashes[start:start + len(part)] = [hash(w) for w in part]
        self.rows = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.rows]

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words the head holds, and the rows of those."""
        held = np.zeros(len(words), bool)
        if not words or not len(self.hashes):
            return held, np.empty(0, np.int32)
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        order = np.argsort(hashes)  # neighbours are looked up together
        at = np.empty(len(words), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
        alike = self.hashes[at] == hashes
        like, rows = np.flatnonzero(alike), self.rows[at[alike]]
        asked = pa.array(list(compress(words, alike.tolist())), self.words.type)
        same = pc.equal(self.words.take(pa.array(rows)), asked).to_numpy(zero_copy_only=False)
        held[like[same]] = True
        return held, rows[same]

    def ids(self, words: list[str]) -> dict[str, bytes]:
        """word -> ids of those of the words that the head holds."""
        held, rows = self.find(words)
        return dict(zip(compress(words, held.tolist()), _byte_strings(self.packed.take(pa.array(rows))), strict=True))


@dataclass(frozen=True)
class Head:
    """The table's most frequent words as a broadcast Arrow stream."""
    key: str
    stream: Broadcast

    def words(self) -> HeadIds:
        """Its words and ids, made once per worker."""
        if self.key not in _heads:
            _heads.clear()
            _heads[self.key] = HeadIds(pa.ipc.open_stream(self.stream.value).read_all())
        return _heads[self.key]


_heads: dict[str, HeadIds] = {}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())],
                                          ["word", "n"])
    n: Counter[str] = Counter()
    for b in batches:
        for text in b.column(0):
            n.update(marked_words(text.as_py()))
            if len(n) >= HELD:
                yield out()
                n.clear()
    yield out()


def _segment_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            ids = pieces(path).segment(words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([ids[w] for w in words], pa.binary())],
                                             ["word", "n", "ids"])
    return run


def word_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n, ids): every marked word that occurs twice or more, segmented once.

    Counts are summed per task before the shuffle.  A word that occurs once has
    nothing to share: the text that holds it is the one place that segments it."""
    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(_count_words, "word string, n bigint")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return shared_table(words.mapInArrow(_segment_words(path), "word string, n bigint, ids binary"), "piece-words")


def _head(table: DataFrame) -> tuple[Head, int | None]:
    """The most frequent words of the table, HEAD_BYTES at most, and the least
    level of frequency among them."""
    table = table.withColumn("_level", F.floor(F.log2("n") * 16).cast("int"))
    size = F.sum(F.octet_length("word") + F.octet_length("ids") + ENTRY).alias("size")
    least, room = None, HEAD_BYTES
    for r in table.groupBy("_level").agg(size).orderBy(F.desc("_level")).collect():  # 64 * 16 levels at most
        if r["size"] > room:
            break
        least, room = r["_level"], room - r["size"]
    head = table.where(F.col("_level") >= least) if least is not None else table.limit(0)
    found = head.select("word", "ids").toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as w:
        w.write_table(found)
    return Head(uuid.uuid4().hex, table.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())), least


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    """Stretches (start, end, texts) of a batch of (doc_id, text)."""
    texts, start, size = [], 0, 0
    for i, text in enumerate(b.column(1)):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= BLOCK:
            yield start, i + 1, texts
            texts, start, size = [], i + 1, 0
    if texts:
        yield start, start + len(texts), texts


def _block_id(raw: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64))


def _words_to_ask(shared: Head):
    """(doc_id, text) -> (block, word): the words of each block that the head doesn't hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.words()
        for b in batches:
            for _, _, texts in _blocks(b):
                block = _block_id("".join(texts).encode())
                words = _distinct([marked_words(t) for t in texts])
                rest = list(compress(words, (~head.find(words)[0]).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rest), pa.int64()), pa.array(rest, pa.string())],
                                                 ["block", "word"])
    return run


def _packed_blocks(id_type: pa.DataType):
    """(doc_id, text) -> (block, ids of its rows, byte lengths of its texts, the texts compressed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for start, end, texts in _blocks(b):
                raw = "".join(texts).encode()
                sizes = [len(t.encode()) for t in texts]
                rows = pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), b.column(0)[start:end].cast(id_type))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_block_id(raw)], pa.int64()), rows, pa.array([sizes], pa.list_(pa.int64())),
                     pa.array([squeeze.compress(raw)], pa.binary())], ["block", "rows", "sizes", "texts"])
    return run


def _ids_by_position(path: str, shared: Head, then: Step | None = None):
    """Blocks with the (word, ids) pairs they asked for -> (doc_id, ids), or what ``then`` makes of these batches."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, expand = shared.words(), pieces(path), zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                raw, given = expand.decompress(b.column(2)[i].as_py()), b.column(3)[i].values
                known = {} if given is None else dict(zip(given.field(0).to_pylist(), _byte_strings(given.field(1)), strict=True))
                ends = np.cumsum([0, *b.column(1)[i].as_py()]).tolist()
                texts = [marked_words(raw[x:y].decode()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                known |= head.ids(words := _distinct(texts))
                known |= own.segment([w for w in words if w not in known])
                ids = [b"".join([known[w] for w in t]) + own.end for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(ids, pa.large_binary())], ["doc_id", "ids"])
    return (lambda batches: then(found(batches))) if then else found


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", then: Step | None = None,
           columns: str = "ids binary") -> DataFrame:
    """One row (doc_id, ids) per row of ``docs``: the ids of the whole text and
    the end id, as the ``sentencepiece`` library gives them for the model at
    ``path`` (on every node), packed little-endian in ``Pieces.dtype``.

    1. ``word_table``: each distinct marked word, segmented once.  2. Its most
    frequent words go to every task, in HEAD_BYTES at most.  3. Blocks of texts ask
    the table for their other words, each once, by a join on the word (no such
    word is frequent).  4. Blocks meet the ids they asked for, and each text's
    ids are put together by the position of its words.  Ids are looked up by
    word, so it does no harm if two blocks have the same key or a block is cut
    anew after a lost executor.

    ``then`` is a step over the batches of (doc_id, ids) that gives batches of doc_id and
    ``columns`` instead.  It runs in the worker that makes them: by ``mapInArrow``
    on the result, every task would hold two workers at once and pass the ids between them.

    Null is the empty text (the end id only).  Repeated rows give repeated rows,
    null ids stay null, an empty table gives an empty result; other columns are
    not read.  A block must fit a task: some BLOCK bytes or one text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    table = word_table(docs, path, text_col)
    head, least = _head(table)
    rest = table.where(F.floor(F.log2("n") * 16).cast("int") < least) if least is not None else table
    asked = rows.mapInArrow(_words_to_ask(head), "block bigint, word string")
    found = asked.join(rest.select("word", "ids"), "word").groupBy("block").agg(F.collect_list(F.struct("word", "ids")).alias("known"))
    blocks = rows.mapInArrow(_packed_blocks(_arrow_type(docs, id_col)),
                             f"block bigint, rows array<{id_type}>, sizes array<bigint>, texts binary")
    return blocks.join(found, "block", "left").select("rows", "sizes", "texts", "known").mapInArrow(
        _ids_by_position(path, head, then), f"doc_id {id_type}, {columns}")


def _arrow_type(docs: DataFrame, id_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(docs.schema[id_col].dataType)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text) by the library's ``decode``: the first
    marker and the end id have no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            texts = pa.array([own.decode(x.as_py()) for x in b.column(1)], pa.large_string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], ["doc_id", "text"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(path: str) -> Step:
    """(doc_id, ids) -> doc_id and DIGESTS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        numeral = own.numerals.__getitem__
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1):
                ids = np.frombuffer(x.as_py(), own.dtype).tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(numeral, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode(read_table(spark, sf_dir, "documents"), path, then=digests(path), columns=DIGESTS)
