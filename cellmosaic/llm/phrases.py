"""Phrase collocations by dynamic itemset counting.

Texts are turned once into word codes, dealt into shards, and the shards are scanned in a cycle. A step counts one
shard for phrases of all lengths at once. A phrase of several words becomes active as soon
as both phrases of one word less, its first and its last part, have reached the threshold in
the shards counted so far; the next step is the first that counts it, and after one full cycle it has been
counted everywhere and is counted no more. Words are active from the first step on. Scans end
when the last active phrase has completed its cycle: a few cycles in all, where a
level-wise search needs one complete scan a length before the next length starts.

Steps work on hashes: words by 32 bits, phrases by 64. A step knows the active phrases from a table of fixed
size: per slot of a phrase's hash the step after a phrase of that slot reached the threshold. Shared hashes and slots only
make counts too high or phrases active too early; the first step stays a
function of the phrase's hash, the same in every task and every repeated one. So the cycles find every
phrase that reaches the threshold and perhaps some that do not. A last scan looks those up by two slots of their hash, counts
them by numbers that tell all words of a chunk apart and merges by text, which makes the counts exact, and drops
the others. Counts are merged in the shared folder after each step, what is complete
below the threshold is dropped there.

Nulls: a null text has no words, a null ``lang`` counts as ``und``. Texts are read whole,
very long ones in slices. Repeated rows count as often as they occur. An empty table has no phrases.
Other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.llm.common import U64, mix64, utf8_values, work_path
from cellmosaic.operators.joins import join_dim
from cellmosaic.session import durable

LEAST = 30  # occurrences of a phrase
LONGEST = 4  # words of a phrase
SHARDS = 3
SLOTS = 1 << 24  # bytes of the table of active phrases
SECOND = 40  # bits below a hash's second slot
TOP = 2000  # phrases reported per lang
INSIDE, WHOLE = 80, 100  # a phrase goes if a longer one has such a share of its occurrences
UNKNOWN = "und"
NEVER = 255
CHUNK = 2_000_000  # words counted at once in a task
NAMED_CHUNK = 1_000_000
CACHE_WORDS = 300_000
SLICE = 1 << 20  # bytes of a text split at once
_BREAK = b"\xff"  # never a byte of UTF-8
_FIXED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], U64)
_COUNTS = "words int, key long, first int, n long"
_NAMED = "lang string, phrase string, words int, n long"


def _slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with ``_BREAK`` between pieces."""
    text = raw.translate(_FIXED).replace(_BREAK, b" \xff ")
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            ends = [e for e in (text.find(b" ", at + SLICE), text.find(b"\t", at + SLICE)) if e >= 0]
            end = min(ends, default=end)
        yield text[at:end].split()  # of the white space only blanks and tabs are left
        at = end


class _Codes(dict):
    """Word -> 32-bit code of a lang, never 0; 0 ends a piece. Started anew when it is full."""

    def __init__(self, lang: bytes):
        super().__init__({_BREAK: 0})
        self.seed = xxhash.xxh64_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        self[word] = code = (xxhash.xxh64_intdigest(word, self.seed) & 0xFFFFFFFE) | 1
        return code


def _windows(codes, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, reach) of consecutive parts of one text.

    A part begins with the last words of the one before; ``reach`` is how many words a phrase from a position
    must have so that it has not been inside the part before.
    """
    tail = np.empty(0, np.uint32)
    for new in codes:
        whole = np.concatenate([tail, new])
        reach = np.ones(len(whole), np.int8)
        reach[:len(tail)] = np.arange(len(tail) + 1, 1, -1)
        yield whole, reach
        tail = whole[-(longest - 1):] if longest > 1 else tail


class _Numbers(dict):
    """Word -> its number among the words seen, without any clash; 0 ends a piece. Keeps the words' codes."""

    def __init__(self, lang: bytes):
        super().__init__({_BREAK: 0})
        self.of = _Codes(lang).__missing__
        self.codes = array("I", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.codes)
        self.codes.append(self.of(word))
        return number


def _distinct(numbers: np.ndarray, at: np.ndarray, length: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``at`` of the first, count) of each different row of ``length`` numbers below ``limit`` from ``at`` on."""
    bits = max(1, int(limit - 1).bit_length())
    packed, used = numbers[at].astype(U64), bits
    for i in range(1, length):
        if used + bits > 64:
            packed = np.unique(packed, return_inverse=True)[1].astype(U64)
            used = max(1, len(at).bit_length())
        packed, used = (packed << U64(bits)) | numbers[at + i].astype(U64), used + bits
    _, where, n = np.unique(packed, return_index=True, return_counts=True)
    return where, n


class _Chunk:
    """Codes of texts in a row, 0 behind each."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.reach: list[np.ndarray] = []
        self.size = 0

    def add(self, codes: np.ndarray, reach: np.ndarray) -> None:
        self.parts += [codes, np.zeros(1, np.uint32)]
        self.reach += [reach, np.ones(1, np.int8)]
        self.size += len(codes) + 1

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, keys, whether a phrase starts there) for each length."""
        codes = np.concatenate(self.parts)
        reach = np.concatenate(self.reach)
        h = mix64(codes.astype(U64) + U64(1))
        key, good = h, codes > 0
        yield 1, key, good & (reach == 1)
        for length in range(2, longest + 1):
            if len(key) < 2:
                return
            good = good[:-1] & good[1:]
            with np.errstate(over="ignore"):
                key = mix64(key[:-1] * _STEPS[0] + h[length - 1:] * _STEPS[1] + U64(length))
            yield length, key, good & (reach[:len(good)] <= length)


def _encode(longest: int):
    """Texts as arrays of codes, windows of long ones a row each."""

    def run(batches):
        langs: dict[bytes, _Codes] = {}
        for batch in batches:
            rows, needs, shards = [], [], []
            for lang, raw, shard in zip(utf8_values(batch.column("lang")), utf8_values(batch.column("text")), batch.column("shard").to_pylist()):
                if not raw:
                    continue
                ids = langs.get(lang)
                if ids is None or len(ids) > CACHE_WORDS:
                    ids = langs[lang] = _Codes(lang)
                if len(langs) > 64:
                    langs = {lang: ids}
                codes = (np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)) for words in _slices(raw))
                for whole, reach in _windows(codes, longest):
                    rows.append(whole)
                    needs.append(int((reach > 1).sum()))
                    shards.append(shard)
            if rows:
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view(np.int32))),
                     pa.array(needs, pa.int32()), pa.array(shards, pa.int32())], ["codes", "tail", "shard"])

    return run


def _count(step: int, shards: int, longest: int, usable):
    """Counts of the phrases that are active in this step, per chunk of texts."""

    def rows(chunk: _Chunk, table: np.ndarray) -> pa.RecordBatch:
        mask = U64(len(table) - 1)
        found, since = [], None
        for length, key, starts in chunk.phrases(longest):
            if length == 1:  # all words are active for the first cycle
                at = np.flatnonzero(starts) if step < shards else np.empty(0, np.int64)
                first = np.zeros(len(at), np.int32)
            else:
                both = np.maximum(since[:-1], since[1:]).astype(np.int32)
                at = np.flatnonzero(starts & (both <= step) & (step < both + shards))
                first = both[at]
            since = table[(key & mask).astype(np.int64)] if length < longest else None
            unique, where, n = np.unique(key[at], return_index=True, return_counts=True)
            found.append((np.full(len(unique), length, np.int32), unique.view(np.int64), first[where], n.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["words", "key", "first", "n"])

    def run(batches):
        table, chunk = np.frombuffer(zlib.decompress(usable.value), np.uint8), _Chunk()
        for batch in batches:
            codes, ends = _lists(batch.column("codes"))
            for lo, hi, tail in zip(ends[:-1], ends[1:], batch.column("tail").to_pylist()):
                reach = np.ones(hi - lo, np.int8)
                reach[:tail] = np.arange(tail + 1, 1, -1)
                chunk.add(codes[lo:hi], reach)
                if chunk.size >= CHUNK:
                    yield rows(chunk, table)
                    chunk = _Chunk()
        if chunk.size:
            yield rows(chunk, table)

    return run


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy().view(np.uint32), column.offsets.to_numpy()


def _name(longest: int, wanted):
    """Texts and counts of the phrases whose slots are wanted, per chunk of texts; words of a lang as a phrase of none."""

    def rows(lang: bytes, ids: _Numbers, chunk: _Chunk, tables: np.ndarray) -> pa.RecordBatch:
        mask, numbers, names = U64(tables.shape[1] - 1), np.concatenate(chunk.parts), list(ids)
        chunk.parts = [np.frombuffer(ids.codes, np.uint32)[numbers]]
        phrases, lengths, counts = [b""], [np.zeros(1, np.int32)], []
        for length, key, starts in chunk.phrases(longest):
            if length == 1:
                counts.append(np.array([starts.sum()], np.int64))
            at = np.flatnonzero(starts)
            at = at[tables[0, (key[at] & mask).astype(np.int64)] > 0]
            at = at[tables[1, ((key[at] >> U64(SECOND)) & mask).astype(np.int64)] > 0]
            where, n = _distinct(numbers, at, length, len(names))
            found = numbers[at[where][:, None] + np.arange(length)].tolist()
            phrases += [b" ".join([names[i] for i in row]) for row in found]
            lengths.append(np.full(len(found), length, np.int32))
            counts.append(n.astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(phrases), pa.binary()).cast(pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
             pa.array(np.concatenate(lengths)), pa.array(np.concatenate(counts))], ["lang", "phrase", "words", "n"])

    def run(batches):
        tables = np.frombuffer(zlib.decompress(wanted.value), np.uint8).reshape(2, -1)
        held: dict[bytes, tuple[_Numbers, _Chunk]] = {}
        for batch in batches:
            for lang, raw in zip(utf8_values(batch.column("lang")), utf8_values(batch.column("text"))):
                if not raw:
                    continue
                if len(held) > 64 and lang not in held:
                    for key, (ids, chunk) in held.items():
                        yield rows(key, ids, chunk, tables)
                    held = {}
                ids, chunk = held.setdefault(lang, (_Numbers(lang), _Chunk()))
                numbers = (np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)) for words in _slices(raw))
                for part, reach in _windows(numbers, longest):
                    chunk.add(part, reach)
                if chunk.size >= NAMED_CHUNK:
                    yield rows(lang, ids, chunk, tables)
                    del held[lang]
        for lang, (ids, chunk) in held.items():
            yield rows(lang, ids, chunk, tables)

    return run


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """(lang, phrase, words, n): the exact counts of all phrases that occur ``least`` times.

    The row of no words holds the number of words of the lang. ``slots``, a power of two, and
    ``shards`` decide the work alone, never the counts. The result is a written table.
    """
    if longest * shards >= NEVER:
        raise ValueError(f"{longest} lengths times {shards} shards are more steps than {NEVER}")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    path = work_path(spark, "codes")
    texts.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int")).mapInArrow(
        _encode(longest), "codes array<int>, tail int, shard int").write.partitionBy("shard").parquet(path)
    coded = spark.read.schema("codes array<int>, tail int, shard int").parquet(path)
    usable = np.full(slots, NEVER, np.uint8)
    wanted = np.zeros((2, slots), np.uint8)
    state: DataFrame | None = None
    step = latest = 0  # the last step in which a phrase may become active
    while step < latest + shards:
        table = spark.sparkContext.broadcast(zlib.compress(usable.tobytes(), 1))
        counted = coded.filter(F.col("shard") == step % shards).select("codes", "tail").mapInArrow(
            _count(step, shards, longest, table), _COUNTS).withColumn("old", F.lit(0).cast("bigint"))
        if state is not None:
            counted = counted.unionByName(state.withColumn("old", F.col("n")))
        merged = counted.groupBy("words", "key", "first").agg(F.sum("n").alias("n"), F.sum("old").alias("old"))
        open_rows = F.col("first") + shards > step + 1
        after = durable(merged.filter(open_rows | (F.col("n") >= least)))
        state = after.filter(open_rows).drop("old")
        step += 1
        slot = F.col("key").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")
        second = F.shiftrightunsigned("key", SECOND).bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")
        fresh = after.filter((F.col("n") >= least) & (F.col("old") < least))
        # no more rows than the table has slots, for each length
        found = fresh.select(slot, (F.col("words") < longest).alias("part")).distinct().toArrow()
        at, part = found.column("slot").to_numpy(), found.column("part").to_numpy()
        wanted[0, at] = 1
        wanted[1, fresh.select(second).distinct().toArrow().column("slot").to_numpy()] = 1
        new = at[part & (usable[at] == NEVER)]
        usable[new] = step
        if len(new):
            latest = step
        table.destroy()  # the step is written
    table = spark.sparkContext.broadcast(zlib.compress(wanted.tobytes(), 1))
    named = texts.mapInArrow(_name(longest, table), _NAMED).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    out = durable(named.filter((F.col("n") >= least) | ((F.col("words") == 0) & (F.col("n") > 0))))
    table.destroy()
    return out


def _parts(phrase: Column, words: Column, shortest: int) -> Column:
    """The phrases of ``shortest`` or more words inside a phrase, itself left out."""
    w = F.split(phrase, " ")
    starts = lambda k: F.transform(F.sequence(F.lit(1), words - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
    lengths = F.when(words > shortest, F.sequence(F.lit(shortest), words - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(lengths, starts))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """Per lang the ``top`` phrases by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A phrase counted ``a`` times that is cut into parts counted ``l`` and ``r`` times scores ``floor(2000000 a / (l + r))``,
    in decimals of 38 digits; the lowest score counts, on ties that of the first cut. A phrase inside a longer one
    with 80 % of its occurrences or more is left out. Order: score and a downwards, then the phrase's bytes.
    """
    known = frequent_phrases(docs, least, longest, shards, slots)
    phrases = known.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    held = phrases.filter("words > 2").select(
        "lang", F.explode(F.array_distinct(_parts(F.col("phrase"), F.col("words"), 2))).alias("phrase"), F.col("a").alias("b")
    ).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    inside = F.coalesce(wide("b") * WHOLE >= wide("a") * INSIDE, F.lit(False))
    kept = durable(phrases.join(held, ["lang", "phrase"], "left").filter(~inside).drop("b"))
    w = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")
    cuts = kept.select("lang", "phrase", "words", "a", cut)
    sides = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.array_join(F.slice(w, F.lit(1), F.col("cut")), " ").alias("part")),
        F.struct(F.lit(1).alias("side"), F.array_join(F.slice(w, F.col("cut") + 1, F.col("words")), " ").alias("part")),
    )).alias("s")).select("lang", "phrase", "a", "cut", "s.*")
    sizes = known.filter("words > 0").select("lang", F.col("phrase").alias("part"), "n")
    counted = join_dim(sides, sizes, ["lang", "part"], ["phrase"])
    both = counted.groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    scored = both.withColumn("score", F.expr("CAST((CAST(a AS DECIMAL(38,0)) * 2000000) div (CAST(l AS DECIMAL(38,0)) + r) AS BIGINT)"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = weakest.select("lang", "phrase", "a", "m.l", "m.r", "m.score").withColumn("rank", F.row_number().over(order))
    totals = known.filter("words = 0").select("lang", "n")
    return join_dim(best.filter(F.col("rank") <= top), totals, ["lang"], ["phrase"]).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
