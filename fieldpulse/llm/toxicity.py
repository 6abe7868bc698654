"""Toxicity by noisy-channel deobfuscation: a Viterbi decoder restores disguised
words under a character language model, and the restored text is scored."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import count as count_from

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SKETCH_BITS, flag_sketched, key_sketch, read_table, shared_table, ship_package, text_of

# What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = " .-_*~·"
#: Log costs of the channel: a sign for a letter, a dropped separator, a dropped repetition.
SWAP_COST, DROP_COST, REPEAT_COST = -1.0, -0.5, -1.5

#: Up to so many readings of a token of letters are scored one by one.
FEW = 16
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ORDER = 4
#: Size of the language model whatever the corpus: 27^4 numbers.
SYMBOLS = len(LETTERS) + 1
MIN_EVIDENCE = 0.5
#: A round of covering takes candidates in this part of the widest one's rows, and in SUPPORT rows at least.
COVER, SUPPORT = 0.2, 3
#: Of these it takes the ones this close to the most precise: a word before a prefix that other words share.
SLACK = 0.02
PREFIXES = (4, 5, 6)
Z = 2.0
#: Rounds of covering after which the rows that are left are written.
WRITTEN = 4
#: Words are hashed into so many buckets for the evidence of rows without a rule.
BUCKETS = 1 << 20
#: Rows a bucket's share of toxic rows is shrunk by, the least evidence (a log odds ratio) that counts,
#: how many words count, and the evidence at which the score is 63 % of what such rows can reach.
SHRINK, LEAST, WORDS, SCALE = 2.0, 0.5, 3, 4.0
#: Tokens, and the words of letters in them, that a task remembers at a time; this only saves time.
KEPT = 700_000
#: Rows without a rule score below a half.
GRADED = 0.49

_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_END = chr(ord(LETTERS[0]) - 1)
_NO_LETTERS = {i: None for i in range(128) if chr(i) not in _CODE}
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+(€£])(?:[ .\-_*~·]+(?:[^\W_]|[@$!|+(€£])){2,}(?![^\W_])")
# every spaced run has its second and third sign, which few texts have
_PAIR = re.compile(r"[ .\-_*~·](?:[^\W_]|[@$!|+(€£])[ .\-_*~·]+(?:[^\W_]|[@$!|+(€£])(?![^\W_])")
_DOUBLE = re.compile(r"([a-z])\1")
_DOUBLES = re.compile(r"([a-z])\1+")
_PLAIN = re.compile(r"[a-z]+")
_GAP = re.compile(r"[ .\-_*~·]{2,}")
_SINGLE = re.compile(r"(?:([a-z])(?!\1))+")
_EDGE = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$|+(€£]+$")


class _Folded(dict):
    """Character -> its parts without accents (with ``only``, those of them it has), found when first asked for."""

    def __init__(self, only: Iterable[str] | None = None):
        self.only = only

    def __missing__(self, c: int) -> str:
        parts = [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]
        self[c] = "".join(x for x in parts if self.only is None or x in self.only)
        return self[c]


_FOLDED, _FOLDED_LETTERS = _Folded(), _Folded(_CODE)


def fold(word: str) -> str:
    """Lower case without accents."""
    word = word.lower()
    return word if word.isascii() else word.translate(_FOLDED)


class CharModel:
    """Log probabilities of a letter after the three before it, and a decoder."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(-1, SYMBOLS).astype(np.float64)
        lower = counts.reshape(SYMBOLS, -1, SYMBOLS).sum(axis=0).astype(np.float64)
        backoff = (lower + 0.1) / (lower + 0.1).sum(axis=1, keepdims=True)
        prior = np.tile(backoff, (SYMBOLS, 1))
        self.log = np.log((table + 2.0 * prior) / (table.sum(axis=1, keepdims=True) + 2.0)).astype(np.float32)
        self.flat = self.log.ravel().tolist()

    def decode(self, signs: str, ends: bool = False) -> str:
        """Likeliest letters for a lattice of signs: exact Viterbi over contexts, in
        time linear in the signs.  With ``ends`` a separator may also end a word,
        which is a space in the result."""
        signs = fold(signs)
        if signs.isalpha() and _PLAIN.fullmatch(signs):
            runs = [(m.start(), m.end()) for m in _DOUBLES.finditer(signs)]
            if math.prod([b - a for a, b in runs]) <= FEW:
                return self._among(signs, runs)
        log, size = self.flat, SYMBOLS ** (ORDER - 1)
        states = {0: (0.0, None)}  # context -> score, (path before, letter)
        before = ""
        for c in signs:
            nxt: dict[int, tuple[float, tuple | None]] = {}
            for x, code, cost in arcs_of(c, c == before, ends):
                for ctx, (score, path) in states.items():
                    if code:
                        at = ctx * SYMBOLS + code
                        s, to = score + cost + log[at], at % size
                    elif not x:
                        s, to = score + cost, ctx
                    elif ctx:
                        s, to = score + cost + log[ctx * SYMBOLS], 0
                    else:
                        continue  # no word to end
                    if to not in nxt or s > nxt[to][0]:
                        nxt[to] = (s, (path, x) if x else path)
            states, before = nxt, c
        path = max(((s + log[ctx * SYMBOLS] if ctx else s, path) for ctx, (s, path) in states.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))


    def _among(self, signs: str, runs: list[tuple[int, int]]) -> str:
        """``decode`` of letters alone: readings only differ in how often the letter of
        a run is repeated, so the few there are get scored one by one, up to where
        they have the same context again."""
        log, size = self.flat, SYMBOLS ** (ORDER - 1)
        paths, done = [(0.0, 0, "")], 0
        for start, end in [*runs, (len(signs), len(signs))]:
            between = signs[done:start]
            if len(paths) > 1:
                codes, longer = [_CODE[c] for c in between[:ORDER - 1]], []
                for score, ctx, word in paths:
                    for code in codes:
                        at = ctx * SYMBOLS + code
                        score, ctx = score + log[at], at % size
                    longer.append((score, ctx, word))
                paths = longer if len(between) < ORDER - 1 else [max(longer)]
            if len(paths) == 1:  # what comes before a choice has no part in it
                _, ctx, word = paths[0]
                for c in between[1 - ORDER:]:
                    ctx = (ctx * SYMBOLS + _CODE[c]) % size
                paths = [(0.0, ctx, word)]
            if start == end:
                return max([(score + log[ctx * SYMBOLS], ctx, word) for score, ctx, word in paths])[2] + between
            longer, code = [], _CODE[signs[start]]
            for score, ctx, word in paths:
                word += between
                for left in range(end - start - 1, -1, -1):
                    at = ctx * SYMBOLS + code
                    score, ctx, word = score + log[at], at % size, word + signs[start]
                    longer.append((score + left * REPEAT_COST, ctx, word))
            paths, done = longer, end
        raise AssertionError("the last stretch ends the word")


@lru_cache(maxsize=4096)
def arcs_of(c: str, repeated: bool, ends: bool) -> list[tuple[str, int, float]]:
    """Readings of a sign: (letter, space or nothing, its code, cost)."""
    arcs = [(c, _CODE[c], 0.0)] if c in _CODE else []
    arcs += [(x, _CODE[x], SWAP_COST) for x in LEET.get(c, "")]
    if c in SEPARATORS:
        arcs += [("", 0, DROP_COST)] + ([(" ", 0, DROP_COST)] if ends else [])
    if repeated:
        arcs.append(("", 0, REPEAT_COST))
    return arcs or [("", 0, DROP_COST)]  # a sign without a reading


def disguised(signs: str) -> bool:
    """Whether a folded token's lattice has any path but its own letters."""
    return signs != "" and _SINGLE.fullmatch(signs) is None


def readings(signs: str, model: CharModel) -> tuple[tuple[str, ...], ...]:
    """Restored words: separators all dropped, ending words where the model says so, and only where several stand together."""
    out = [(model.decode(signs),)]
    if any(c in SEPARATORS for c in signs):
        out.append(tuple(model.decode(signs, ends=True).split()))
    if len(parts := _GAP.split(signs)) > 1:
        out.append(tuple(map(model.decode, parts)))
    return tuple(out)


def widened(text: str, start: int, end: int) -> str:
    """A spaced run with the tokens beside it: its first and last sign may belong to them."""
    while start and text[start - 1] in SEPARATORS:
        start -= 1
    while start and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and text[end] in SEPARATORS:
        end += 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return text[start:end]


def restored(text: str, model: CharModel, memo: dict[str, tuple], keep: Callable[[tuple], tuple] = tuple) -> Iterator[tuple]:
    """For each different token and each spaced run of the text: what ``keep``
    makes of its readings, folded, the token as it stands first.  A reading is a
    tuple of words."""
    for token in set(text.lower().split()):
        kept = memo.get(token)
        if kept is None:
            if token.isalnum():
                core = token
            elif token[-1] in ".,;:" and token[:-1].isalnum():
                core = token[:-1]
            else:
                core = _EDGE.sub("", token)
            signs = fold(core)
            if len(memo) > KEPT:
                memo.clear()
            if _PLAIN.fullmatch(signs):
                kept = memo.get(signs)  # as the token that has no other signs
                if kept is None:
                    kept = memo[signs] = keep(((signs,),) if _DOUBLE.search(signs) is None else ((signs,), (model.decode(signs),)))
            else:
                forms = ((fold(core.strip("!")) if "!" in core else signs,),)
                if disguised(signs):
                    forms += readings(signs, model)
                kept = keep(forms)
            memo[token] = kept
        if kept:
            yield kept
    for m in _SPACED.finditer(text) if _PAIR.search(text) else ():
        wide = widened(text, *m.span())
        yield keep(readings(m[0], model) + (readings(wide, model) if wide != m[0] else ()))


def restored_tokens(text: str, model: CharModel, memo: dict[str, tuple]) -> set[str]:
    """The words of every reading."""
    return all_words(form for forms in restored(text, model, memo) for form in forms)


def all_words(forms: Iterable[tuple[str, ...]]) -> set[str]:
    return {word for words in forms for word in words if word}


def features(tokens: set[str]) -> set[str]:
    out = {"w:" + t for t in tokens}
    for n in PREFIXES:
        out.update("p:" + t[:n] for t in tokens if len(t) > n)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words: Counter = Counter()
        for t in b.column(0):
            words.update(t.as_py().lower().split())
        plain: Counter = Counter()
        for w, n in words.items():
            plain[w.translate(_FOLDED_LETTERS) if not w.isascii() else w if w.isalpha() else w.translate(_NO_LETTERS)] += n
        plain.pop("", None)
        yield pa.RecordBatch.from_arrays([pa.array(list(plain), pa.string()), pa.array(plain.values(), pa.int64())], ["word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = SYMBOLS ** ORDER
    for b in batches:
        words = b.column(0).to_pylist()
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1  # with the word's end, 0
        codes = np.frombuffer("".join([w + _END for w in words]).encode(), np.uint8).astype(np.int64) - ord(_END)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grams = codes.copy()
        for back in range(1, ORDER):
            grams[back:] += np.where(place[back:] >= back, codes[:-back], 0) * SYMBOLS ** back
        counts = np.bincount(grams, np.repeat(b.column(1).to_numpy(), sizes), size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at].astype(np.int64))], ["gram", "n"])


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter ORDER-grams over every word of every text.  Word counts
    are gathered over the whole corpus first; the result has 27^4 numbers at
    most and is read to the driver."""
    ship_package(docs.sparkSession)
    words = (docs.select(text_of(text_col).alias("text")).mapInArrow(_count_words, "word string, n bigint")
             .groupBy("word").agg(F.sum("n").alias("n")))
    grams = words.mapInArrow(_count_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS ** ORDER, np.int64)
    rows = grams.toArrow()
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return counts


def is_held_out(id_col: str = "doc_id"):
    """Fixed split of the contract; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sketch_bits(keys: DataFrame, column: str) -> bytes:
    """``key_sketch`` of a column of strings as one bitmap: 1 MB whatever the input."""
    rows = key_sketch(keys.select(F.xxhash64(column).alias("_h")), "_h").toArrow()
    bits = np.zeros(SKETCH_BITS // 64, "<i8")
    bits[rows["_word"].to_numpy()] = rows["_mask"].to_numpy()
    return bits.tobytes()


def hash_of(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 42)


def in_sketch(key: str, bits: bytes) -> bool:
    """False only if the key is certainly not in the sketch."""
    return has_bit(hash_of(key), bits)


def has_bit(h: int, bits: bytes) -> bool:
    i = h % SKETCH_BITS
    return bits[i >> 3] >> (i & 7) & 1 == 1


def bucket_of(feature: str) -> int:
    return hash_of(feature) % BUCKETS


def by_bucket(rows: DataFrame, bucket: Column) -> np.ndarray:
    """Sum of ``n`` per bucket: BUCKETS numbers whatever the input."""
    out, sums = np.zeros(BUCKETS), rows.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).toArrow()
    out[sums["b"].to_numpy()] = sums["n"].to_numpy()
    return out


def word_evidence(toxic: np.ndarray, clean: np.ndarray, base: float) -> np.ndarray:
    """Log odds ratio of a row with a bucket's words, shrunk towards the base rate; 0 below LEAST."""
    p = (toxic + SHRINK * base) / (toxic + clean + SHRINK)
    found = np.log(p / (1 - p)) - math.log(base / (1 - base))
    return np.where(found >= LEAST, found, 0.0).astype(np.float32)


def sketched_features(bits: bytes, seen: bytes | None = None) -> Callable[[tuple], tuple]:
    """What a token's readings have in the sketch, and "#bucket" for their words in
    buckets that are ``seen``.  Beginnings are shared by many words, so what the
    sketch says of them is remembered."""
    known: dict[str, tuple[str, ...]] = {}
    least, most = min(PREFIXES), max(PREFIXES)

    def beginnings(start: str) -> tuple[str, ...]:
        """Of words that go on after ``start``, or are longer than any beginning."""
        shorter = known.get(start[:-1])
        if shorter is None:
            shorter = beginnings(start[:-1]) if len(start) > least else ()
        own = ("p:" + start,) if len(start) in PREFIXES and in_sketch("p:" + start, bits) else ()
        if len(known) > 500_000:  # only saves time
            known.clear()
        known[start] = shorter + own
        return known[start]

    def keep(forms: tuple) -> tuple:
        out = []
        for words in forms:
            for word in words:
                if not word:
                    continue
                h = hash_of(name := "w:" + word)
                if has_bit(h, bits):
                    out.append(name)
                if seen is not None and seen[at := h % BUCKETS]:
                    out.append(f"#{at}")
                if len(word) > least:
                    found = known.get(start := word[:min(most, len(word) - 1)])
                    out += beginnings(start) if found is None else found
        return tuple(out)
    return keep


def passes(k: Column, clean: Column, base: float, level: float) -> Column:
    """Whether k toxic and some clean rows are too many toxic ones for chance and precise enough."""
    n = k + clean
    p = k / n
    rest = F.when(clean > 0, clean * F.log((1 - p) / (1 - base))).otherwise(0.0)
    bound = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    return (p > base) & (k * F.log(p / base) + rest >= level) & (bound >= MIN_EVIDENCE)


def learn(docs: DataFrame, labels: DataFrame, counts: np.ndarray, id_col: str = "doc_id",
          text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """Rules, feature -> P(toxic | the feature occurs), and the evidence of each
    bucket of words, from the labelled rows that are not held out.  Labels that
    disagree on an id count as toxic.

    A candidate must be too frequent among toxic rows for chance: by the Chernoff
    bound, less than one of the toxic rows' features would pass at the base rate;
    and its lower Wilson bound must reach MIN_EVIDENCE.  Rare words that merely stand in
    copies of a toxic text pass this too, so rules are taken by sequential
    covering: the most precise of the widest candidates first, then again over
    the toxic rows that have none of them, until nothing frequent is left.  Every
    feature is tested, in Spark; only the rules reach the driver.

    Words too rare for a rule still tell rows without one apart: their shares of
    toxic rows, by bucket, give ``word_evidence``."""
    known = (labels.where(F.col("toxic").isNotNull() & ~is_held_out("doc_id"))
             .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic")))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    rows = flag_sketched(rows.withColumn("_h", F.xxhash64("_id")), "_h",
                         key_sketch(known.select(F.xxhash64("_id").alias("_h")), "_h"), "_may")
    # labels have no size bound: joined by sorting at every size, never broadcast
    train = rows.where("_may").join(known.hint("merge"), "_id").select("text", F.col("toxic").cast("long").alias("toxic"))
    train = shared_table(train, "toxicity-train")
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(counts)

    def count(only):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, memo = CharModel(shared.value), {}
            keep = only and sketched_features(only.value)
            for b in batches:
                n: Counter = Counter()
                for t in b.column(0):
                    n.update(set().union(*restored(t.as_py(), model, memo, keep)) if keep else features(restored_tokens(t.as_py(), model, memo)))
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(n.values(), pa.int64())], ["feature", "n"])
        return run

    def count_clean(able, seen):
        """As ``count``, and "#bucket" for the words of buckets that toxic rows have."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, memo, keep = CharModel(shared.value), {}, sketched_features(able.value, seen.value)
            for b in batches:
                n: Counter = Counter()
                for t in b.column(0):
                    n.update(set().union(*restored(t.as_py(), model, memo, keep)))
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(n.values(), pa.int64())], ["feature", "n"])
        return run

    def counted(rows: DataFrame, only=None) -> DataFrame:
        return (rows.select("text").mapInArrow(count(only), "feature string, n bigint")
                .groupBy("feature").agg(F.sum("n").alias("n")))

    size = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    if not 0 < size.k < size.n:
        return {}, np.zeros(BUCKETS, np.float32)
    # only features of toxic rows can be rules, so the others are never shuffled
    toxic = shared_table(counted(train.where("toxic > 0")), "toxicity-features")
    base, level = size.k / size.n, math.log(max(2, toxic.count()))
    # both tests are hardest to fail without clean rows: what fails so fails with any number of them
    able = toxic.where((F.col("n") >= SUPPORT) & passes(F.col("n"), F.lit(0), base, level)).withColumnRenamed("n", "k")
    words = by_bucket(toxic.where("feature like 'w:%'"), F.pmod(F.xxhash64("feature"), F.lit(BUCKETS)))
    clean = train.where("toxic = 0").select("text").mapInArrow(
        count_clean(sc.broadcast(sketch_bits(able, "feature")), sc.broadcast((words > 0).tobytes())), "feature string, n bigint")
    clean = shared_table(clean.groupBy("feature").agg(F.sum("n").alias("n")), "toxicity-clean")
    evidence = word_evidence(words, by_bucket(clean.where("feature like '#%'"), F.expr("cast(substring(feature, 2) as int)")), base)
    tested = able.join(clean, "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    weight = (F.col("k") + base) / (F.col("k") + F.col("n") + 1)
    passed = shared_table(tested.where(passes(F.col("k"), F.col("n"), base, level)).select(F.col("feature").alias("f"), weight.alias("weight")),
                          "toxicity-passed")
    maybe = sc.broadcast(sketch_bits(passed, "f"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo, keep = CharModel(shared.value), {}, sketched_features(maybe.value)
        for b in batches:
            found = [sorted(set().union(*restored(t.as_py(), model, memo, keep))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["row", "found"])

    left = (train.where("toxic > 0").select(F.monotonically_increasing_id().alias("row"), "text")
            .mapInArrow(match, "row bigint, found array<string>").select("row", F.explode("found").alias("f"))
            .join(passed, "f").groupBy("row").agg(F.collect_list(F.struct("f", "weight")).alias("found")))
    left = shared_table(left.select("found"), "toxicity-rows")
    rules: dict[str, float] = {}
    for turn in count_from(1):
        wide = left.select(F.explode("found").alias("x")).groupBy("x.f").agg(F.count("*").alias("n"), F.max("x.weight").alias("weight"))
        most = wide.agg(F.max("n")).first()[0] or 0
        if most < SUPPORT:
            return rules, evidence
        wide = wide.where(F.col("n") >= max(SUPPORT, COVER * most))
        best = wide.agg(F.max("weight")).first()[0]
        taken = {r.f: r.weight for r in wide.where(F.col("weight") >= best - SLACK).collect()}
        rules.update(taken)
        mine = sc.broadcast(set(taken))

        def rest(batches, mine=mine):
            for b in batches:
                keep = [mine.value.isdisjoint(x["f"] for x in row) for row in b.column(0).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        left = left.mapInArrow(rest, left.schema)
        if turn % WRITTEN == 0:  # the chain of filters stays short
            left = shared_table(left, "toxicity-rows")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, held_out, score, predicted) per row of ``docs``.

    score = 1 - (1 - q1)(1 - q2 / 2) with the two strongest rules that different
    words of the restored text meet (of a token's readings the strongest one
    counts).  Without any it is below GRADED and grows with the evidence of its
    WORDS strongest words, 0 if there is none.  Empty and null texts have no
    features and score 0; without labels every score is 0.
    Repeated rows score alike, null ids are not held out and not learnt from;
    an empty table gives an empty result.  Only the text is read for a score."""
    counts = char_model(docs, text_col)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((counts, learn(docs, labels, counts, id_col, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (weight, graded), memo = CharModel(shared.value[0]), shared.value[1], {}
        starts = {f[2:2 + min(PREFIXES)] for f in weight}  # of every word that can meet a rule

        seen, least = (graded > 0).tobytes(), min(PREFIXES)

        def evidence(word: str) -> float:
            return max(weight.get("w:" + word, 0.0), *[weight.get("p:" + word[:n], 0.0) for n in PREFIXES if len(word) > n], 0.0)

        def keep(forms):
            """Evidence and word of the reading with the strongest two, and the token's strongest bucket."""
            rules, bucket, most = [], None, 0.0
            for words in forms:
                found = set()
                for w in words:
                    if w and seen[at := bucket_of("w:" + w)] and graded[at] > most:
                        bucket, most = at, float(graded[at])
                    if w[:least] in starts and (q := evidence(w)):
                        found.add((q, w))
                if found:
                    found = sorted(found, reverse=True)
                    if [q for q, _ in found[:2]] > [q for q, _ in rules[:2]]:
                        rules = found
            return tuple(rules) if bucket is None else (*rules, (most, bucket))

        for b in batches:
            out = []
            for t in b.column(2):
                found = set().union(*restored(t.as_py(), model, memo, keep))
                best = sorted((q for q, w in found if isinstance(w, str)), reverse=True)[:2]
                if best:
                    q1, q2 = (*best, 0.0)[:2]
                    out.append(1.0 - (1.0 - q1) * (1.0 - q2 / 2))
                else:
                    some = sum(sorted((e for e, _ in found), reverse=True)[:WORDS])
                    out.append(GRADED * (1.0 - math.exp(-some / SCALE)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
