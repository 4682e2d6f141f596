"""Merkle manifest, phrase mining and MinHash against plain Python on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellmosaic.llm import merkle, minhash, phrases
from cellmosaic.llm.common import lower_ascii

CLASH = "leaf string, tree string, n long, rank long, words int, key string, keys string, part int, kept string, a string, sig string"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with the operators' own."""
    data = [(i, t, lang, s, None if t is None else len(t), "l", "t", 1, 2, 3, "k", "ks", 4, "kept", "a", "s") for i, t, lang, s in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def low(text):
    return "".join(chr(ord(c) + 32) if c in UPPER else c for c in text or "")


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_levels(level):
    levels = [level]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i:i + 8]) for i in range(0, len(below), 8)])
    return levels


def plain_proof(levels, at):
    steps = []
    for level in levels[:-1]:
        run = at // 8 * 8
        steps.append((level[run:at], level[at + 1:run + 8]))
        at //= 8
    return steps


def plain_manifest(rows):
    trees = defaultdict(list)
    for i, t, lang, s in rows:
        trees[lang].append((i is not None, i or 0, plain_leaf(i, s, lang, None if t is None else len(t), t), (i, t, lang, s)))
    order = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    built = {lang: plain_levels([leaf for _, _, leaf, _ in sorted(trees[lang])]) for lang in order}
    top = plain_levels([built[lang][-1][0] for lang in order])
    out = []
    for place, lang in enumerate(order):
        for at, (_, _, leaf, (i, t, _, s)) in enumerate(sorted(trees[lang])):
            steps = plain_proof(built[lang], at) + plain_proof(top, place)
            now = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                now = plain_leaf(i, s, lang, None if t is None else len(t), None if t is None else low(t))
            for left, right in steps:
                now = h(*left, now, *right)
            proof = h(*[d for left, right in steps for d in left + right])
            out.append((i, leaf, built[lang][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


def spark_manifest(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(docs, F.when(tampered, merkle.leaf_digest(text=lower_ascii(F.col("text")))))
    rebuilt = merkle.folded(F.coalesce("seen_leaf", "leaf"), F.col("proof"))
    rows = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), rebuilt, rebuilt == F.col("root"))
    return sorted(map(tuple, rows.collect()), key=repr)


ODD_LANGS = [None, "", "-", "=", "de", "é", "en"]


@pytest.mark.parametrize("sizes", [[1], [8], [9], [513, 1, 0, 7], [600, 3, 1, 1, 20, 65, 64]])
def test_manifest_is_the_plain_tree(spark, sizes):
    rng = np.random.default_rng(len(sizes))
    rows = []
    for lang, n in zip(ODD_LANGS[-len(sizes):] if len(sizes) < 7 else ODD_LANGS, sizes):
        rows += [(int(rng.integers(0, 3 * n)) if i else None, [None, "", "Some Text é", "lower", "X" * 5000][i % 5], lang, [None, "src"][i % 2]) for i in range(n)]
    rows += rows[:2]  # repeated rows
    assert spark_manifest(table(spark, rows)) == plain_manifest(rows)


def test_manifest_of_many_trees_and_of_nothing(spark):
    rows = [(i, f"Text {i}", f"l{i % 150}", "s") for i in range(300)]
    assert spark_manifest(table(spark, rows)) == plain_manifest(rows)
    assert spark_manifest(table(spark, rows).filter("false")) == []


def test_queue_holds_open_runs_only():
    leaves = [h(str(i)).encode() for i in range(merkle.BLOCK)]
    top, inner = merkle.sweep_up(leaves, merkle.BLOCK_LEVELS)
    assert top.decode() == plain_levels([d.decode() for d in leaves])[-1][0]
    assert len(inner) == (merkle.BLOCK - 1) // 7
    steps = dict(merkle.sweep_down(len(leaves), merkle.BLOCK_LEVELS, inner, [(1, "ab")]))
    assert sorted(steps) == list(range(merkle.BLOCK)) and all(s[-1] == (1, "ab") for s in steps.values())


# phrases


def plain_counts(rows, longest=4):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low(text)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    return counts, total


def plain_collocations(rows, least, top):
    counts, total = plain_counts(rows)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if " " in p and a >= least}
        gone = set()
        for p, b in found.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                gone |= {q for i in range(len(w) - k + 1) if 100 * b >= 80 * found[q := " ".join(w[i:i + k])]}
        scored = []
        for p, a in found.items():
            if p in gone:
                continue
            w = p.split(" ")
            cuts = [(2000000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, l, r = min(cuts)  # noqa: E741
            scored.append((-score, -a, p.encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def corpus(n=400, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["Alpha", "beta", "Ärger", "ÄRGER", "gamma\xa0x", "delta", "the", "of", "epsilon", "zeta"] + [f"w{i}" for i in range(60)]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(0, 60)), p=weight / weight.sum()))
        if i % 5 == 0:
            words += "New York Stock Exchange opens late".split()
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ". ", ", ", "\n", "\r\n"], p=[0.7, 0.05, 0.05, 0.1, 0.05, 0.03, 0.02])) for w in words)
        rows.append((i, text, [None, "en", "de", "en"][i % 4], "s"))
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, " .,\n", "fr", "s"), (1003, "a b " * 9000, "en", "s"), (0, rows[0][1], None, "s")]
    return rows + [(None, rows[5][1], "en", "s")] * 9


@pytest.mark.parametrize("shards, slots", [(4, 1 << 16), (3, 4), (1, 64)])
def test_phrases_match_plain_counts(spark, monkeypatch, shards, slots):
    monkeypatch.setattr(phrases, "SLICE", 1000)  # long texts are split in slices
    rows = corpus()
    got = phrases.frequent_phrases(table(spark, rows), least=12, shards=shards, slots=slots).collect()
    assert len({(r.lang, r.phrase) for r in got}) == len(got)
    counts, total = plain_counts(rows)
    want = {(lang, p): n for lang, f in counts.items() for p, n in f.items() if n >= 12}
    assert {(r.lang, r.phrase): r.n for r in got if r.words} == want
    assert {r.lang: r.n for r in got if not r.words} == {k: v for k, v in total.items() if v}


def test_collocations_match_plain_python(spark):
    rows = corpus()
    got = phrases.collocations(table(spark, rows), least=8, top=40, slots=1 << 12)
    want = plain_collocations(rows, 8, 40)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.select(*columns).collect())) == want and len(want) > 60
    assert phrases.collocations(table(spark, rows).filter("false")).collect() == []


def test_scans_end_with_the_last_cycle(spark, monkeypatch):
    """A phrase of four words becomes active while words are still counted."""
    seen = []
    count = phrases._count
    monkeypatch.setattr(phrases, "_count", lambda step, *rest: (seen.append(step), count(step, *rest))[1])
    rows = [(i, "one two three four", "en", "s") for i in range(400)]
    got = {r.phrase: r.n for r in phrases.frequent_phrases(table(spark, rows), least=30).collect()}
    assert got["one two three four"] == 400
    assert len(seen) == 6  # the words' cycle and one step more a length; 12 level by level


def clash(lang):
    """Two words whose 32-bit codes are equal in a lang."""
    codes, seen = phrases._Codes(lang.encode()), {}
    for i in range(10**6):
        word = f"x{i}"
        other = seen.setdefault(codes.__missing__(word.encode()), word)
        if other != word:
            return other, word


def test_words_with_one_code_are_counted_apart(spark):
    one, two = clash("en")
    rows = [(i, f"big {one} end" if i % 3 else f"big {two} end", "en", "s") for i in range(99)]
    got = {r.phrase: r.n for r in phrases.frequent_phrases(table(spark, rows).coalesce(1), least=30).collect()}
    assert got == {"": 297, "big": 99, "end": 99} | {
        p.format(w): n for w, n in ((one, 66), (two, 33)) for p in ("{}", "big {}", "{} end", "big {} end")}


@pytest.mark.parametrize("limit", [5, 1 << 17, 1 << 30])
def test_phrases_of_a_chunk_are_told_apart(limit):
    rng = np.random.default_rng(1)
    numbers = rng.choice(np.array([1, 2, 3, limit - 1], np.int32), 500)
    at = np.arange(0, 496)
    for length in (1, 2, 3, 4):
        where, n = phrases._distinct(numbers, at, length, limit)
        want = Counter(tuple(numbers[i:i + length].tolist()) for i in at)
        assert {tuple(numbers[i:i + length].tolist()): c for i, c in zip(at[where], n)} == want


def test_scores_beyond_64_bits(spark):
    row = spark.sql("SELECT CAST((CAST(9000000000000000 AS DECIMAL(38,0)) * 2000000) div (CAST(9000000000000000 AS DECIMAL(38,0)) + 9000000000000001) AS BIGINT) AS s").first()
    assert row.s == 999999


# minhash


def plain_shingles(text, k):
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", low(text))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def plain_components(rows, k, num, den):
    """(doc_id, size, component, kept) per row by comparing all pairs."""
    sets = [plain_shingles(t, k) for _, t, *_ in rows]
    own = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
                a, b = own[i], own[j]
                own = [min(a, b) if c in (a, b) else c for c in own]
    names = {}
    for (i, *_), c in zip(rows, own):
        if i is not None:
            names[c] = min(i, names.get(c, i))
    return sorted(((r[0], len(s), names.get(c), r[0] == names.get(c)) for r, s, c in zip(rows, sets, own)), key=repr)


def edited(rng, words, share):
    out = list(words)
    for at in rng.choice(len(out), max(1, int(len(out) * share)), replace=False):
        out[at] = f"x{rng.integers(0, 10**9)}"
    return out


def near_corpus(seed, groups=12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"v{v}" for v in rng.integers(0, 3000, int(rng.integers(3, 220)))]
        for _ in range(int(rng.integers(1, 12))):
            rows.append(" ".join(edited(rng, base, float(rng.uniform(0.0, 0.12)))))
        rows += [" ".join(base), "  ".join(base).upper()]
    long = " ".join(f"w{i % 997}y{i}" for i in range(20_000))
    rows += [None, "", " \n\t", "word", "Word", "é à", long, long + " end", "b a b a b a"]
    texts = [(i * 7 % 100_003, t, "en", "s") for i, t in enumerate(rows)]
    return texts + [texts[0], (None, rows[1], "en", "s"), (None, "no id", "en", "s"), (texts[3][0], "another text with the id of one before", "en", "s")]


@pytest.mark.parametrize("k, num, den", [(2, 80, 100), (5, 80, 100), (3, 90, 100)])
def test_minhash_components_match_all_pairs(spark, k, num, den):
    rows = near_corpus(k)
    got = minhash.near_duplicates(table(spark, rows), k, num, den)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_components(rows, k, num, den)


def test_minhash_of_a_large_group_and_of_nothing(spark, monkeypatch):
    """A group of near copies larger than a block, stars whose rays do not link, and equal rows."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"v{v}" for v in rng.integers(0, 3000, 120)]
    rows = [(i, " ".join(edited(rng, base, 0.03)), "en", "s") for i in range(120)]
    rows += [(500 + i, " ".join(edited(rng, base, 0.07)), "en", "s") for i in range(80)]
    rows += [(900 + i, " ".join(base), "en", "s") for i in range(60)]
    got = minhash.near_duplicates(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_components(rows, 2, 80, 100)
    assert minhash.near_duplicates(table(spark, rows).filter("false")).collect() == []


def test_bayes_gives_up_few_pairs_at_the_threshold():
    """The chance that a pair at the threshold fails any batch, by exact convolution."""
    limits = minhash.least_matches(80, 100)
    equal = 0.8 + 0.2 / 256
    alive = np.array([1.0])
    lost = 0.0
    from math import comb
    step = np.array([comb(minhash.BATCH, m) * equal**m * (1 - equal) ** (minhash.BATCH - m) for m in range(minhash.BATCH + 1)])
    for least in limits:
        alive = np.convolve(alive, step)
        lost += alive[:least].sum()
        alive[:least] = 0
    assert lost < 1e-4
    banded = (1 - 0.8**minhash.BAND_ROWS) ** minhash.BANDS
    assert banded < 1e-5
    assert limits == tuple(sorted(limits)) and limits[-1] > 0.6 * minhash.HASHES


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    diffs = []
    for _ in range(40):
        a, b = pool[:900].copy(), np.concatenate([pool[100:900], rng.integers(0, 2**63, 100, dtype=np.int64).astype(np.uint64)])
        rng.shuffle(pool)
        diffs.append((minhash.minima(a) == minhash.minima(b)).mean() - 0.8)
    assert abs(np.mean(diffs)) < 0.01 and np.std(diffs) < 0.04


def test_blocks_go_on_over_batches():
    rng = np.random.default_rng(2)
    same = rng.integers(0, 2**63, 50, dtype=np.int64)
    other = rng.integers(0, 2**63, 50, dtype=np.int64)
    close = np.concatenate([same[:46], other[:4]])
    sets = [same, close, other, same, close, other]
    rows = pa.RecordBatch.from_pydict({"block": [1, 1, 1, 2, 2, 3], "rid": [5, 6, 7, 8, 9, 4], "label": [5, 6, 7, 8, 8, 4], "tokens": [s.tolist() for s in sets]})
    for cuts in ([0, 6], [0, 1, 2, 6], [0, 3, 5, 6], [0, 2, 4, 6]):
        parts = iter([rows.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])])
        assert [p for b in minhash._links(80, 100)(parts) for p in zip(*b.to_pydict().values())] == [(5, 6)]


def test_exact_links_of_a_block(monkeypatch):
    monkeypatch.setattr(minhash, "BITS_AT_ONCE", 64)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.int64)
    sets = [np.unique(np.concatenate([rng.choice(base, 290 - 3 * (i % 20), replace=False), rng.integers(0, 2**63, i % 25, dtype=np.int64)])) for i in range(60)]
    found = minhash.linked_forest(np.arange(60), sets, 80, 100)
    own = list(range(60))
    for i in range(60):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                own = [min(own[i], own[j]) if c in (own[i], own[j]) else c for c in own]
    got = list(range(60))
    for i, j in found:
        inter = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter)
        got = [min(got[i], got[j]) if c in (got[i], got[j]) else c for c in got]
    assert got == own and len(found) == 60 - len(set(own))
