"""Near duplicates by MinHash with sequential Bayesian verification.

A document's set are its distinct k-word shingles, as 64-bit hashes; two documents link when
``den * |x & y| >= num * |x | y|``. Equal sets are folded into one set first. A set has
``HASHES`` minimum hashes; ``BAND_ROWS`` of them form the key of a band, and sets that share the key of one of ``BANDS``
bands are candidates. A pair at the threshold of 0.8 shares none with probability
``(1 - 0.8 ** 5) ** 32``, 3e-6.

Candidates are compared on one byte of each minimum, a batch of them at a time, those outside
the bands first. After each batch the posterior of the similarity, uniform before, is known; a pair is given up
when it reaches the threshold with probability ``MISS`` at most. What survives all batches
is verified on the full sets, so no wrong link is made.

Large groups cost no more than their size: first each set is compared with the smallest set of its keys
alone, verified with the most alike, and what is linked becomes one component. Then only
keys that still hold several components are taken up, in blocks of bounded size, and pairs
of one component are left out; a component that fills blocks of its own is not compared with
itself. The sets that pass with a set of another component meet once more with their tokens, block by
block, and are verified there. No pair leaves a block but a forest of its links.

Null texts and texts without a word have no set and link with nothing. Rows repeated with one
id are each returned; a null id takes part and never names a component unless all ids of it are null.
An empty table gives an empty result. Very long texts count whole. Other columns are ignored
whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.common import U64, connected_components, mix64
from cellmosaic.llm.jaccard_join import _Words, set_id, token_sets
from cellmosaic.operators.joins import join_dim
from cellmosaic.session import durable

WORDS = 2
NUM, DEN = 80, 100
BANDS, BAND_ROWS = 32, 5
HASHES = 256
BATCH = 32
MISS = 1e-6
BLOCK = 1024  # sets of a block
BLOCK_TOKENS = 2_000_000  # and their tokens
BITS_AT_ONCE = 1 << 16
TOKENS_AT_ONCE = 512
U32 = np.uint32
_RANDOM = np.random.default_rng(20240607)
_XOR = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint64).astype(U32)
_MUL = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint64).astype(U32) | U32(1)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], U64)


def minima(tokens: np.ndarray) -> np.ndarray:
    """The minimum of each of ``HASHES`` hash functions over a set of tokens."""
    x = (tokens >> U64(32)).astype(U32)
    out = np.full(HASHES, 2**32 - 1, U32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), TOKENS_AT_ONCE):
            v = x[at:at + TOKENS_AT_ONCE, None] ^ _XOR
            v *= _MUL
            v ^= v >> U32(15)
            v *= U32(0x2C1B3C6D)
            v ^= v >> U32(13)
            np.minimum(out, v.min(axis=0), out=out)
    return out


def band_keys(minimum: np.ndarray) -> np.ndarray:
    rows = minimum[HASHES - BANDS * BAND_ROWS:].reshape(BANDS, BAND_ROWS).astype(U64)
    keys = np.arange(BANDS, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(BAND_ROWS):
            keys = mix64(keys * _STEPS[0] + rows[:, i] * _STEPS[1])
    return keys.view(np.int64)


@functools.cache
def least_matches(num: int, den: int, miss: float = MISS) -> tuple[int, ...]:
    """Per number of batches, the least equal bytes with which a pair goes on.

    With fewer, the posterior probability of a similarity of ``num / den`` or more is
    ``miss`` or less. Bytes of different minima are equal once in 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    equal = s + (1 - s) / 256
    high = s >= num / den
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(equal) + (n - m) * np.log1p(-equal)
            weight = np.exp(log - log.max())
            if weight[high].sum() > miss * weight.sum():
                break
        out.append(m)
    return tuple(out)


def equal_bytes(one: np.ndarray, others: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the rows of ``others`` that pass all batches against ``one``, and their equal bytes."""
    at = np.arange(len(others))
    total = np.zeros(len(others), np.int64)
    for batch, least in enumerate(limits):
        part = slice(batch * BATCH, (batch + 1) * BATCH)
        total = total + (others[at, part] == (one[at, part] if one.ndim == 2 else one[part])).sum(axis=1)
        go_on = total >= least
        at, total = at[go_on], total[go_on]
        if not len(at):
            break
    return at, total


def _profile(k: int):
    def run(batches):
        words = _Words()
        for batch in batches:
            rids, sizes, sigs, keys = [], [], [], []
            for tokens in token_sets(batch.column("text"), words, k):
                if tokens is None:
                    rids.append(None), sizes.append(0), sigs.append(None), keys.append(None)
                    continue
                m = minima(tokens)
                rids.append(set_id(tokens))
                sizes.append(len(tokens))
                sigs.append((m & U32(255)).astype(np.uint8).tobytes())
                keys.append(band_keys(m))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(rids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "th", "rid", "n", "sig", "keys"])

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _compare(num: int, den: int):
    """Pairs that pass all batches, with their equal bytes."""

    def run(batches):
        limits = least_matches(num, den)
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            some = np.flatnonzero(np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
            a, b = _matrix(batch.column("sa"))[some], _matrix(batch.column("sb"))[some]
            at, equal = equal_bytes(a, b, limits)
            kept = pa.array(some[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(kept), batch.column("b").take(kept), pa.array(equal)], ["a", "b", "equal"])

    return run


def in_window(n: np.ndarray, i: int, num: int, den: int) -> np.ndarray:
    """Index of the later sets, in order of size, that are small enough to link with set ``i``."""
    return np.arange(i + 1, int(np.searchsorted(n, n[i] * den // num, "right")))


def involved(n: np.ndarray, label: np.ndarray, sig: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index of the sets of one block that pass all batches with a set of another label."""
    limits = least_matches(num, den)
    order = np.argsort(n, kind="stable")
    n, label, sig = n[order], label[order], sig[order]
    hit = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        others = in_window(n, i, num, den)
        others = others[label[others] != label[i]]
        if len(others):
            at, _ = equal_bytes(sig[i], sig[others], limits)
            hit[others[at]] = True
            hit[i] |= len(at) > 0
    return order[hit]


def linked_forest(label: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links of one block that join its labels, by the exact intersections of the sets."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, own = n[order], label[order].copy()
    rows = np.repeat(np.arange(len(n)), n)
    _, ids, counts = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    shared = counts > 1  # the others are in no intersection
    rows, ids = rows[shared[ids]], (np.cumsum(shared) - 1)[ids[shared[ids]]]
    common = np.zeros((len(n), len(n)), np.int32)
    for first in range(0, int(shared.sum()), BITS_AT_ONCE):
        some = (ids >= first) & (ids < first + BITS_AT_ONCE)
        width = min(BITS_AT_ONCE, int(shared.sum()) - first)
        flags = np.zeros((len(n), -(-width // 64) * 64), np.uint8)
        flags[rows[some], ids[some] - first] = 1
        bits = np.packbits(flags, axis=1).view(U64)
        for i in range(len(n) - 1):
            others = in_window(n, i, num, den)
            common[i, others] += np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int32)
    out = []
    for i in range(len(n) - 1):
        others = in_window(n, i, num, den)
        inter = common[i, others].astype(np.int64)
        for j in others[den * inter >= num * (n[i] + n[others] - inter)]:
            if own[j] != own[i]:
                out.append((int(order[i]), int(order[j])))
                own[own == own[j]] = own[i]
    return out


def _per_block(work):
    """``work`` on the rows of each block; rows come sorted by block, which may go on in the next batch."""

    def run(batches):
        held: list[pa.RecordBatch] = []  # the rows so far of the last block
        open_block = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            before = np.flatnonzero(block != block[-1])
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut or (held and open_block != block[-1]):
                yield _each(pa.Table.from_batches([*held, batch.slice(0, cut)]), work)
                held = []
            held.append(batch.slice(cut))
            open_block = block[-1]
        if held:
            yield _each(pa.Table.from_batches(held), work)

    return run


def _each(rows: pa.Table, work) -> pa.RecordBatch:
    block = rows.column("block").to_numpy()
    cuts = np.flatnonzero(np.diff(block)) + 1
    found = [work(rows.slice(lo, hi - lo)) for lo, hi in zip([0, *cuts], [*cuts, len(block)]) if hi - lo > 1]
    ends = np.concatenate(found or [np.empty((0, 2), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _involved(num: int, den: int):
    def work(rows: pa.Table) -> np.ndarray:
        n, label = rows.column("n").to_numpy(), rows.column("label").to_numpy()
        at = involved(n, label, _matrix(rows.column("sig")), num, den)
        return np.stack([rows.column("block").to_numpy()[at], rows.column("rid").to_numpy()[at]], axis=1)

    return _per_block(work)


def _links(num: int, den: int):
    def work(rows: pa.Table) -> np.ndarray:
        sets = [s.values.to_numpy() for s in rows.column("tokens")]
        found = linked_forest(rows.column("label").to_numpy(), sets, num, den)
        ends = rows.column("rid").to_numpy()[np.array(found, np.int64).reshape(-1, 2)]
        return np.stack([ends.min(axis=1), ends.max(axis=1)], axis=1)

    return _per_block(work)


def _token_lists(k: int):
    def run(batches):
        words = _Words()
        for batch in batches:
            for tokens in token_sets(batch.column("text"), words, k):
                if tokens is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([set_id(tokens)], pa.int64()), pa.array([len(tokens)], pa.int64()),
                         pa.array([tokens.view(np.int64)], pa.list_(pa.int64()))], ["rid", "n", "tokens"])

    return run


def _token_table(ends: DataFrame, sets: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(rid, n, tokens) of the sets in ``ends``, from one text each."""
    places = sets.join(ends, "rid", "left_semi").select("th", "doc").distinct()
    read = join_dim(texts, places, ["th", "doc"], ["text"]).select("text").mapInArrow(
        _token_lists(k), "rid long, n long, tokens array<long>")
    return durable(read.dropDuplicates(["rid"]))  # a repeated row may have listed its set twice


def _confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The ``pairs`` that link by their full sets."""
    ends = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    side = _token_table(ends, sets, texts, k)
    # the smaller end is the hub of a star: its tokens meet the others' there
    both = pairs.join(side.toDF("b", "nb", "tb"), "b").join(side.toDF("a", "na", "ta"), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    return durable(both.filter(den * shared >= num * (F.col("na") + F.col("nb") - shared)).select("a", "b"))


def _blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(block, rid, label): the sets of keys that hold several components.

    Keys that list the same sets are taken once. A key of more than a block is cut: a component with
    as many members there has blocks of its own, the others share blocks; each two blocks meet
    unless they are of one component.
    """
    named = labels.select(F.col("node").alias("rid"), "component")
    labelled = members.join(named, "rid", "left").withColumn("label", F.coalesce("component", "rid")).drop("component")
    lists = labelled.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("s"),
        F.sum(F.xxhash64("rid", F.lit(1)).cast("decimal(38,0)")).alias("s2"))
    # the load of a key or a part of it, in blocks
    load = lambda size, tokens: F.ceil(F.greatest(size / BLOCK, tokens / BLOCK_TOKENS))
    once = lists.filter("lo <> hi").groupBy("size", "tokens", "s", "s2").agg(F.min("key").alias("key")).select(
        "key", load(F.col("size"), F.col("tokens")).alias("load"))
    mixed = durable(labelled.join(once, "key").select("key", "rid", "n", "label", "load"))
    short = mixed.filter("load <= 1").select(F.col("key").alias("block"), "rid", "label")
    long = mixed.filter("load > 1")
    counts = long.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    whole = load(F.col("c"), F.col("t")) > 1
    counts = counts.withColumn("unit", F.when(whole, F.col("label")))  # null: the shared blocks
    sizes = counts.groupBy("key", "unit").agg(load(F.sum("c"), F.sum("t")).alias("q"))
    units = durable(counts.join(sizes.withColumnRenamed("unit", "u"), "key").filter(F.col("unit").eqNullSafe(F.col("u")))
                    .select("key", "label", "unit", "q"))
    parts = units.select("key", "unit", "q").distinct().select("key", "unit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q") - 1)).alias("i"))
    x, y = parts.toDF("key", "xu", "xi"), parts.toDF("key", "yu", "yi")
    in_order = F.struct(F.col("xu").isNotNull(), "xu", "xi") <= F.struct(F.col("yu").isNotNull(), "yu", "yi")
    one = F.col("xu").eqNullSafe(F.col("yu")) & F.col("xu").isNotNull()
    meet = x.join(y, "key").filter(in_order & ~one).withColumn("block", F.xxhash64("key", "xu", "xi", "yu", "yi"))
    sides = F.array(F.struct(F.col("xu").alias("unit"), F.col("xi").alias("i")), F.struct(F.col("yu").alias("unit"), F.col("yi").alias("i")))
    sides = meet.select("key", "block", F.explode(F.array_distinct(sides)).alias("s")).select("key", "block", F.col("s.unit").alias("u"), "s.i")
    placed = long.join(units, ["key", "label"]).withColumn("i", F.pmod(F.xxhash64("rid"), F.col("q")))
    cut = placed.join(sides, ["key", "i"]).filter(F.col("unit").eqNullSafe(F.col("u"))).select("block", "rid", "label")
    return short.unionByName(cut)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block")


def _block_links(members: DataFrame, labels: DataFrame, sets: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links that join components, from the blocks of all keys that hold several."""
    blocks = durable(_blocks(members, labels))
    rows = blocks.join(sets.select("rid", "n", "sig"), "rid").select("block", "rid", "n", "label", "sig")
    hits = durable(_by_block(rows).mapInArrow(_involved(num, den), "a long, b long").toDF("block", "rid"))
    tokens = _token_table(hits.select("rid").distinct(), sets, texts, k)
    rows = blocks.join(hits, ["block", "rid"]).join(tokens, "rid").select("block", "rid", "label", "tokens")
    return durable(_by_block(rows).mapInArrow(_links(num, den), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach) and kept."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    profile = durable(texts.mapInArrow(_profile(k), "doc_id long, th long, rid long, n long, sig binary, keys array<long>"))
    doc: Column = F.coalesce("doc_id", F.lit(-1).cast("bigint"))
    texts = texts.select("th", doc.alias("doc"), "text")
    # one row per set: where its text is, and the least id that has it
    sets = durable(profile.filter("rid IS NOT NULL").groupBy("rid").agg(
        F.min(F.struct("th", doc.alias("doc"))).alias("at"), F.min("doc_id").alias("least"),
        F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys"),
    ).select("rid", "least", "at.*", "n", "sig", "keys"))
    postings = sets.select(F.explode("keys").alias("key"), "rid", "n")
    heads = postings.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rid").alias("head")).filter("size > 1")
    members = durable(postings.join(heads.select("key", "head"), "key"))

    pairs = members.filter("rid <> head").select(F.col("head").alias("a"), F.col("rid").alias("b")).distinct()
    side = sets.select("rid", "n", "sig")
    compared = pairs.join(side.toDF("b", "nb", "sb"), "b").join(side.toDF("a", "na", "sa"), "a").mapInArrow(
        _compare(num, den), "a long, b long, equal long")
    best = compared.groupBy("b").agg(F.max_by("a", F.struct("equal", "a")).alias("a")).select("a", "b")
    links = _confirmed(durable(best), sets, texts, k, num, den)
    labels = durable(connected_components(links))
    more = _block_links(members.drop("head"), labels, sets, texts, k, num, den)
    # the stars of the first components stand for their links
    stars = labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = durable(connected_components(stars.unionByName(more)))

    grouped = sets.select("rid", "least").join(labels.select(F.col("node").alias("rid"), "component"), "rid", "left")
    grouped = durable(grouped.withColumn("component", F.coalesce("component", "rid")))
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "component").select("rid", "component_id")
    rows = join_dim(profile.select("doc_id", "rid", "n"), named, ["rid"], ["doc_id"], how="left")
    component = F.when(F.col("rid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
