"""N-gram Jaccard join with token-combination prefixes.

Tokens are the distinct k-word shingles of a document, as 64-bit hashes. Two documents
link when ``den * |x & y| >= num * |x | y|``. Equal sets are folded into one set first.

Candidates. Tokens have one order: untracked ones by hash, then tracked ones (met again)
by count. Sets that link share at least l tokens in their first ``n - ceil(t n) + l``.
Tokens counted ``COMBINED`` times or more are frequent; they are dealt into m classes,
and l is m + 1: either a shared token is rare, or two shared ones fall into one class. So
a rare token of the extended prefix is a key alone, frequent ones are keys in pairs of
one class. m follows the size
level of a set, which keeps the pairs linear in the prefix; a set is listed under its
own level and the next, and linked sets are at most one level apart.
Whether a token is tracked and where it stands decides the speed, never the result.

Keys that list the same sets are kept once. Sets under a key meet in blocks of bounded
size: the bits in which two folded parity maps differ bound the symmetric difference from
below, which is an exact filter. A first round verifies a spanning forest of the pairs
that pass in a block. The next ones do so again among the sets of these forests, for passing pairs
that were not verified yet and whose ends are still in different components; the last round verifies all
such pairs. Blocks that are left with the same sets are kept once. So a group of g near copies costs
about g verified pairs, and no link between components is lost.

Null texts and texts without a word have no set and link with nothing. Rows repeated
with one id are each returned; a null id takes part and never names a component unless
all ids of it are null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.llm.common import U64, connected_components, mix64, utf8_values, work_path
from cellmosaic.operators.joins import join_dim
from cellmosaic.session import durable

WORDS = 3
NUM, DEN = 90, 100
TRACKED_TOKENS = 1_000_000  # bound of the broadcast table: the tokens counted most often
TRACKED_COUNTS = 4096  # counts from here on are told apart by the bound alone
COMBINED = 32  # tokens counted as often are keys in pairs only
FORESTS = 3  # rounds of spanning forests before all pairs are verified
COUNT_CHUNK = 4_000_000  # tokens counted at once in a task
BLOCK = 1024  # sets of a key that meet in one block
CACHE_WORDS = 200_000
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U64)


class _Words(dict):
    """Word -> index into a table of hashes; started anew when it is full."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return i


def token_sets(array: pa.Array, words: _Words, k: int) -> Iterator[np.ndarray | None]:
    """The sorted distinct shingle hashes of each text; None without a word."""
    table, known = np.empty(0, U64), 0
    for raw in utf8_values(array):
        found = raw.lower().split() if raw else []  # bytes: A-Z and ASCII white space alone
        if not found:
            yield None
            continue
        if len(words) > CACHE_WORDS:
            words.clear()
            words.hashes.clear()
            known = 0
        at = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        if len(words.hashes) > known:
            table = np.concatenate([table[:known], np.array(words.hashes[known:], U64)])
            known = len(table)
        yield shingle_hashes(table[at], k)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    width = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, U64)
        for i in range(width):
            out = mix64(out * _STEPS[0] + h[i:len(h) - width + 1 + i] * _STEPS[1])
    return np.unique(out)


def set_id(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(mix64(tokens ^ _STEPS[2]).sum(dtype=U64) + U64(len(tokens))).view(np.int64))


def _profile(k: int):
    """Documents as (kind 0: id, text hash, set id, size, parity map); counts as (kind 1: token, count)."""

    def flush(chunks: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(chunks), return_counts=True)
        tokens, counts = tokens[counts > 1], counts[counts > 1]
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(tokens), np.int32)), pa.array(tokens.view(np.int64)), none, none,
             pa.array(counts.astype(np.int64)), pa.nulls(len(tokens), pa.binary())],
            ["kind", "a", "th", "rid", "n", "bits"])

    def run(batches):
        words, chunks, held = _Words(), [], 0
        for batch in batches:
            rids, sizes, bits = [], [], []
            for tokens in token_sets(batch.column("text"), words, k):
                rids.append(None if tokens is None else set_id(tokens))
                sizes.append(0 if tokens is None else len(tokens))
                bits.append(None if tokens is None else parity_map(tokens).tobytes())
                if tokens is not None:
                    chunks.append(tokens)
                    held += len(tokens)
                if held >= COUNT_CHUNK:
                    yield flush(chunks)
                    chunks, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(rids), np.int32)), batch.column("doc_id"), batch.column("th"),
                 pa.array(rids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())],
                ["kind", "a", "th", "rid", "n", "bits"])
        if chunks:
            yield flush(chunks)

    return run


def level_of(n: int, num: int, den: int) -> int:
    """Linked sets are at most one level apart: a level is a little wider than den / num."""
    return int(math.log(n) / math.log(1.008 * den / num))


def classes_of(level: int, num: int, den: int) -> int:
    size = (1.008 * den / num) ** level
    return max(1, round(size * (den - num) / den / 5))


def prefix_keys(tokens: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of a set. ``rank`` is 0 for an untracked token, else its count."""
    n = len(tokens)
    if n * (den - num) < num:  # no other set can link with one so small
        return np.empty(0, U64)
    order = np.lexsort((tokens, rank))
    tokens, rank = tokens[order], rank[order]
    rare = int(np.searchsorted(rank, COMBINED))
    plain = n + num * -n // den + 1  # n - ceil(t n) + 1
    level = level_of(n, num, den)
    keys, longest = [], 0
    with np.errstate(over="ignore"):
        for at in (level, level + 1):
            m = classes_of(at, num, den)
            longest = max(longest, plain + m)
            often = tokens[rare:plain + m]
            if len(often) < 2:
                continue
            kind = mix64(often) % U64(m)
            by = np.argsort(kind, kind="stable")
            often, kind = often[by], kind[by]
            for step in range(1, len(often)):
                same = kind[step:] == kind[:-step]
                if not same.any():
                    break
                keys.append(mix64(
                    mix64(often[:-step][same] * _STEPS[0] + often[step:][same] * _STEPS[1]) + U64(at)
                ))
        keys.append(mix64(tokens[:min(rare, longest)] ^ _STEPS[2]))
    return np.unique(np.concatenate(keys))


def _postings(k: int, num: int, den: int, tracked):
    def run(batches):
        words = _Words()
        known, rank = tracked.value
        likely = np.zeros(1 << 22, bool)  # by low bits: most tokens are not tracked
        likely[known & U64(len(likely) - 1)] = True
        for batch in batches:
            keys, rids = [], []
            for tokens in token_sets(batch.column("text"), words, k):
                if tokens is None:
                    continue
                ranks = np.zeros(len(tokens), np.int64)
                some = np.flatnonzero(likely[tokens & U64(len(likely) - 1)])
                if len(some):
                    at = np.minimum(np.searchsorted(known, tokens[some]), len(known) - 1)
                    ranks[some] = np.where(known[at] == tokens[some], rank[at], 0)
                found = prefix_keys(tokens, ranks, num, den)
                keys.append(found)
                rids.append(np.full(len(found), set_id(tokens), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(rids))],
                    ["key", "rid"])

    return run


def _shared_runs(batches):
    """Distinct rows of the keys that more than one set has; rows come sorted by key and set."""
    key = rid = None  # of the last row
    pending = False  # that row is its key's first and has not been given out
    for batch in batches:
        k, r = batch.column("key").to_numpy(), batch.column("rid").to_numpy()
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        if len(k) and key is not None:
            new[0] = k[0] != key or r[0] != rid
        k, r = k[new], r[new]
        if not len(k):
            continue
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        sizes = np.diff(np.concatenate([[0], cuts, [len(k)]]))
        shared = sizes > 1
        goes_on = key is not None and k[0] == key
        shared[0] |= goes_on
        keep = np.repeat(shared, sizes)
        out_k, out_r = k[keep], r[keep]
        if goes_on and pending:
            out_k, out_r = np.append(out_k, key), np.append(out_r, rid)
        pending = not shared[-1]
        key, rid = k[-1], r[-1]
        yield pa.RecordBatch.from_arrays([pa.array(out_k), pa.array(out_r)], ["key", "rid"])


def parity_map(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens per bit; half a bit a token or more, a power of two, 512 at least."""
    width = max(512, 1 << (len(tokens) // 2).bit_length())
    odd = np.bincount((mix64(tokens) % U64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(U64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _token_lists(k: int):
    def run(batches):
        words = _Words()
        for batch in batches:
            sets = [s for s in token_sets(batch.column("text"), words, k) if s is not None]
            if not sets:
                continue
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))],
                ["rid", "n", "tokens"])

    return run


def passing_pairs(rid, n, label, bits, num: int, den: int, forest: bool, tried=None):
    """Index pairs of one block whose parity maps allow a link and whose labels differ.

    ``forest``: only as many as join the sets that such pairs connect. ``tried``: per set None or
    the ids that it was verified with.
    """
    order = np.argsort(n, kind="stable")
    n, own, rid = n[order], label[order].copy(), rid[order]
    maps = [bits[i] for i in order]
    widths = np.array([len(b) for b in maps])
    folded = {int(w): np.stack([fold(b, int(w)) for b in maps if len(b) >= w]) for w in np.unique(widths)}
    first = {w: len(maps) - len(rows) for w, rows in folded.items()}
    out = []
    for i in range(len(maps) - 1):
        end = int(np.searchsorted(n, n[i] * den // num, "right"))
        others = np.arange(i + 1, end)
        others = others[own[others] != own[i]]
        if tried is not None and tried[order[i]] is not None:
            others = others[~np.isin(rid[others], tried[order[i]])]
        if not len(others):
            continue
        w = int(widths[i])
        rows = folded[w]
        apart = np.bitwise_count(rows[others - first[w]] ^ rows[i - first[w]]).sum(axis=1, dtype=np.int64)
        fits = apart * (den + num) <= (n[i] + n[others]) * (den - num)
        others, apart = others[fits], apart[fits]
        if not forest:
            out.extend((i, int(j)) for j in others)
            continue
        for j in others[np.argsort(apart, kind="stable")]:
            if own[j] != own[i]:
                out.append((i, int(j)))
                own[own == own[j]] = own[i]
    return [(rid[i], rid[j]) for i, j in out]


def _block_pairs(num: int, den: int, forest: bool):
    """Rows come sorted by block; a block may go on in the next batch."""

    def pairs(rows: pa.Table):
        maps = [np.frombuffer(b, U64) for b in rows.column("bits").to_pylist()]
        tried = rows.column("tried").to_pylist()
        at = {c: rows.column(c).to_numpy() for c in ("block", "rid", "n", "label")}
        cuts = np.flatnonzero(np.diff(at["block"])) + 1
        found = []
        for lo, hi in zip([0, *cuts], [*cuts, len(maps)]):
            if hi - lo > 1:
                found += [(at["block"][lo], *p) for p in passing_pairs(
                    at["rid"][lo:hi], at["n"][lo:hi], at["label"][lo:hi], maps[lo:hi], num, den, forest, tried[lo:hi])]
        return found

    def as_batch(found):
        block = np.array([p[0] for p in found], np.int64)
        a = np.array([min(p[1:]) for p in found], np.int64)
        b = np.array([max(p[1:]) for p in found], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(a), pa.array(b)], ["block", "a", "b"])

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            blocks = table.column("block").to_numpy()
            cut = int(np.flatnonzero(blocks != blocks[-1])[-1]) + 1 if blocks[0] != blocks[-1] else 0
            if not cut and held and held[-1].column("block")[0].as_py() != blocks[0]:
                yield as_batch(pairs(pa.concat_tables(held)))
                held = []
            elif cut:
                yield as_batch(pairs(pa.concat_tables([*held, table.slice(0, cut)])))
                held = []
            held.append(table.slice(cut))
        if held:
            yield as_batch(pairs(pa.concat_tables(held)))

    return run


def _met(rows: DataFrame, sets: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """(block, a, b) from rows (block, rid, label, tried)."""
    rows = rows.join(sets.select("rid", "n", "bits"), "rid").select("block", "rid", "n", "label", "bits", "tried")
    rows = rows.repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(_block_pairs(num, den, forest), "block long, a long, b long")


def _first_pairs(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """A spanning forest of the pairs that may link, for each block of all keys."""
    blocks = F.ceil(F.col("members") / BLOCK)
    mine = F.pmod(F.xxhash64("rid"), blocks)
    rows = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).select(
        "rid", F.col("rid").alias("label"), F.lit(None).cast("array<bigint>").alias("tried"),
        F.xxhash64("key", F.least(mine, "other"), F.greatest(mine, "other")).alias("block"))
    return _met(rows, sets, num, den, True)


def _lists(members: DataFrame, by: str, *more) -> DataFrame:
    """Per key how many sets it lists, and two sums that tell which."""
    return members.groupBy(by).agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("s"),
        F.sum(F.xxhash64("rid", F.lit(1)).cast("decimal(38,0)")).alias("s2"), *more)


def _more_pairs(near: DataFrame, labels: DataFrame, failed: DataFrame, sets: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Distinct pairs that may link, join components and have not failed; ``near``: (block, rid) of the first forests."""
    named = labels.select(F.col("node").alias("rid"), "component")
    rows = near.join(named, "rid", "left").withColumn("label", F.coalesce("component", "rid")).drop("component")
    mixed = _lists(rows, "block", F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    once = mixed.groupBy("members", "s", "s2").agg(F.min("block").alias("block")).select("block")
    both = failed.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    tried = both.groupBy(F.col("x.a").alias("rid")).agg(F.collect_set("x.b").alias("tried"))
    rows = rows.join(once, "block").join(tried, "rid", "left")
    return _met(rows, sets, num, den, forest).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs, a written table, with linked, from the shingles of the texts that stand for the sets."""
    ends = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    places = sets.join(ends, "rid").select("th", "doc").distinct()
    read = join_dim(texts, places, ["th", "doc"], ["text"]).select("text").mapInArrow(
        _token_lists(k), "rid long, n long, tokens array<long>")
    side = durable(read)
    both = pairs.join(side.toDF("a", "na", "ta"), "a").join(side.toDF("b", "nb", "tb"), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    linked = den * shared >= num * (F.col("na") + F.col("nb") - shared)
    # a repeated row may have listed its set twice
    return durable(both.select("a", "b", linked.alias("linked")).distinct())


def _least_tracked(counts: DataFrame, total: int) -> int:
    """The least count for which no more than TRACKED_TOKENS tokens are tracked."""
    by_count = counts.groupBy(F.least("n", F.lit(TRACKED_COUNTS)).alias("n")).count().orderBy(F.desc("n")).collect()
    held, least = 0, max(TRACKED_COUNTS, -(-total // TRACKED_TOKENS))  # counts sum to total at most
    for r in by_count:
        held += r["count"]
        if held > TRACKED_TOKENS:
            break
        least = r["n"]
    return least


def jaccard_components(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    return _classes(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, th (hash of the text), n_shingles, component_id and component (null without a set)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").withColumn("th", F.xxhash64("text"))
    path = work_path(spark, "sets")
    texts.mapInArrow(
        _profile(k), "kind int, a long, th long, rid long, n long, bits binary"
    ).write.partitionBy("kind").parquet(path)
    profile = spark.read.schema("a long, th long, rid long, n long, bits binary, kind int").parquet(path)
    rows = profile.filter("kind = 0").select(F.col("a").alias("doc_id"), "th", "rid", "n", "bits")
    texts = texts.withColumn("doc", F.coalesce("doc_id", F.lit(-1))).select("th", "doc", "text")
    place = F.struct("th", F.coalesce("doc_id", F.lit(-1)).alias("doc"), "n", "bits")
    # one row per set: where its text is, and the least id that has it
    sets = rows.filter("rid IS NOT NULL").groupBy("rid").agg(F.min(place).alias("at"), F.min("doc_id").alias("least"))
    sets = durable(sets.select("rid", "least", "at.*"))
    counts = durable(profile.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") >= _least_tracked(counts, total))
    often = often.toArrow()  # TRACKED_TOKENS rows at most
    known = often.column("a").to_numpy().view(U64)
    by = np.argsort(known)
    tracked = spark.sparkContext.broadcast((known[by], often.column("n").to_numpy()[by]))

    postings = texts.select("text").mapInArrow(_postings(k, num, den, tracked), "key long, rid long")
    postings = postings.repartition("key").sortWithinPartitions("key", "rid")
    members = durable(postings.mapInArrow(_shared_runs, "key long, rid long"))
    once = _lists(members, "key").groupBy("members", "s", "s2").agg(F.min("key").alias("key")).select("key", "members")
    members = durable(members.join(once, "key"))
    pairs = durable(_first_pairs(members, sets, num, den))
    near = durable(pairs.select("block", F.explode(F.array("a", "b")).alias("rid")).distinct())
    done = _verified(durable(pairs.select("a", "b").distinct()), sets, texts, k, num, den)
    labels = durable(connected_components(done.filter("linked").select("a", "b")))
    failed = done.filter("NOT linked").select("a", "b")
    for forest in [True] * (FORESTS - 1) + [False]:
        pairs = durable(_more_pairs(near, labels, failed, sets, num, den, forest))
        if pairs.isEmpty():
            break
        done = _verified(pairs, sets, texts, k, num, den)
        # the stars of the components stand for the links so far
        stars = labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = durable(connected_components(stars.unionByName(done.filter("linked").select("a", "b"))))
        failed = failed.unionByName(done.filter("NOT linked").select("a", "b"))

    groups = durable(sets.select("rid", "least").join(
        labels.select(F.col("node").alias("rid"), "component"), "rid", "left"
    ).withColumn("component", F.coalesce("component", "rid")))
    names = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(names, "component").select("rid", "component", "component_id")
    return rows.join(named, "rid", "left").select(
        "doc_id", "th", "component", F.col("n").alias("n_shingles"),
        F.when(F.col("rid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each component: that of the smallest id, of the smallest text hash among its texts.

    Rows are told by id and text, so rows that repeat an id with another text are judged on their own. Of rows with
    equal id and text one stays, the first by a hash of all columns. Rows without a word are linked with
    nothing, so each id of them stays; rows with a null id stay.
    """
    parts = _classes(docs.filter("doc_id IS NOT NULL"), k, num, den)
    place = F.struct("doc_id", "th")
    alone = parts.filter("component IS NULL").select("doc_id", "th")
    first = parts.filter("component IS NOT NULL").groupBy("component").agg(F.min(place).alias("at")).select("at.*")
    copies = parts.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("_copies"))
    kept = alone.unionByName(first).distinct().join(copies, ["doc_id", "th"]).toDF("_id", "_th", "_copies")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"),
        F.xxhash64("text").alias("_th"))
    named = join_dim(rows.filter("_id IS NOT NULL"), kept, ["_id", "_th"], ["_id"])
    once = named.filter("_copies = 1")
    order = Window.partitionBy("_id", "_th").orderBy(F.xxhash64("_row"))
    repeated = named.filter("_copies > 1").withColumn("_no", F.row_number().over(order)).filter("_no = 1")
    return once.select("_row.*").unionByName(repeated.select("_row.*")).unionByName(docs.filter("doc_id IS NULL"))
