"""Quality scores: Naive Bayes support vectors over word n-grams.

A text's tokens are its words in lower case, numbers, runs of signs, line ends; the stream
also has marks for a token that repeats the one before and for a word that has signs at
its end. Features are indicators of its distinct token unigrams and bigrams, hashed to
``BUCKETS``. Each is scaled by the log ratio of its smoothed class frequencies and the
vector is normed. A linear model with hinge loss is fitted by dual coordinate descent in
one task, and a logistic curve over the margins of further rows turns margins into
probabilities.

The classifier learns from labelled rows that are not held out, chosen by a hash of the
id: about ``COUNT_ROWS`` at most for the log ratios, ``FIT_ROWS`` of them for the linear
model and ``CALIBRATION`` for the curve. So the chosen labels can always be broadcast, and
texts are never shuffled.

Null and empty texts have no feature and get the score of the bias alone. Rows repeated
are each scored. Null labels are not used. With no labels of both classes every score is
the share of the class that there is, or 0.5 without any. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.common import crc_bucket
from cellmosaic.session import durable

BUCKETS = 1 << 18
COUNT_ROWS = 100_000
FIT_ROWS = 12_000
CALIBRATION = 4_000
PENALTY = 1.0
PASSES = 12
HOLD_OUT, HELD = 4, 2
THRESHOLD = 0.7
CACHE_TOKENS = 200_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\n+|[^\w\s]+|_+")
_REPEAT, _SIGNED, _END = 1, 2, 3  # ids of the marks


class _Tokens(dict):
    def __missing__(self, token: str) -> int:
        self[token] = i = zlib.crc32(token.encode("utf-8", "replace")) | 16
        return i


def features(text: str | None, known: _Tokens) -> np.ndarray:
    """The sorted distinct buckets of a text's n-grams."""
    if not text:
        return np.empty(0, np.int32)
    found = _TOKEN.findall(text.lower())
    if not found:
        return np.empty(0, np.int32)
    if len(known) > CACHE_TOKENS:
        known.clear()
    ids = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
    same = np.flatnonzero(ids[1:] == ids[:-1]) + 1
    marked = ids.copy()
    marked[same] = _REPEAT
    grams = [ids * 0x9E3779B1, (marked[:-1] * 0x85EBCA77) ^ (ids[1:] * 0xC2B2AE3D + 7),
             (marked[1:] * 0x27D4EB2F) ^ (marked[:-1] * 0x165667B1 + 3)]
    grams.append(np.array([len(found).bit_length(), 64 + min(31, 64 * len(same) // len(found))]) * 0x1B873593)
    hashed = np.concatenate(grams) & 0xFFFFFFFFFFFF
    return np.unique((hashed ^ (hashed >> 21)) % BUCKETS).astype(np.int32)


def _class_counts(batches):
    """Documents per bucket and class, one row per task and class."""
    known, counts, rows = _Tokens(), np.zeros((2, BUCKETS), np.int64), [0, 0]
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[label][features(text, known)] += 1
            rows[label] += 1
    for label in (0, 1):
        at = np.flatnonzero(counts[label])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.full(len(at) + 1, label)),
             pa.array(np.append(counts[label][at], rows[label]))], ["bucket", "label", "n"])


def log_ratios(labelled: DataFrame) -> tuple[np.ndarray, int, int]:
    """Log-count ratio of every bucket and the class sizes; sums meet in Spark."""
    found = labelled.select("text", "label").mapInArrow(_class_counts, "bucket long, label long, n long")
    sums = found.groupBy("bucket", "label").agg(F.sum("n").alias("n")).toArrow()  # 2 * BUCKETS rows at most
    at, label, n = (sums.column(c).to_numpy() for c in ("bucket", "label", "n"))
    sizes = [int(n[(at < 0) & (label == k)].sum()) for k in (0, 1)]
    side = []
    for k in (0, 1):
        counts = np.zeros(BUCKETS)
        mine = (at >= 0) & (label == k)
        counts[at[mine]] = n[mine]
        side.append((counts + 1) / (sizes[k] + 2))
    return np.log(side[1] / side[0]), sizes[0], sizes[1]


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY,
                 passes: int = PASSES) -> np.ndarray:
    """Weights (bias last) that minimise |w|^2 / 2 + sum of cost * hinge loss; classes weigh alike."""
    rng = np.random.default_rng(11)
    w = np.zeros(len(ratio) + 1)
    alpha = np.zeros(len(rows))
    share = np.array([(signs < 0).mean(), (signs > 0).mean()]).clip(1e-9)
    cost = penalty * np.where(signs > 0, 0.5 / share[1], 0.5 / share[0])
    values = []
    for at in rows:
        v = ratio[at]
        norm = math.sqrt(float(v @ v)) or 1.0
        values.append(v / norm)
    square = np.array([float(v @ v) for v in values]) + 1.0
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            slope = signs[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                alpha[i] = new
                w[at] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def margins(rows, ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i, at in enumerate(rows):
        v = ratio[at]
        out[i] = w[at] @ v / (math.sqrt(float(v @ v)) or 1.0) + w[-1]
    return out


def logistic_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability over the margin, by Newton steps."""
    a, b = 1.0, 0.0
    goal = np.where(label > 0, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g = np.array([((p - goal) * margin).sum() + 1e-3 * a, (p - goal).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _fit(ratio):
    def run(batches):
        known, rows, label, use = _Tokens(), [], [], []
        for batch in batches:
            rows += [features(t, known) for t in batch.column("text").to_pylist()]
            label += batch.column("label").to_pylist()
            use += batch.column("use").to_pylist()
        label, use = np.array(label), np.array(use, bool)
        signs = np.where(label[use] > 0, 1.0, -1.0)
        w = dual_descent([r for r, u in zip(rows, use) if u], signs, ratio.value)
        rest = ~use if (~use).any() else use
        curve = logistic_curve(margins([r for r, u in zip(rows, rest) if u], ratio.value, w), label[rest])
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.tobytes()]), pa.array([curve[0]]), pa.array([curve[1]])], ["w", "slope", "offset"])

    return run


def _scored(model):
    def run(batches):
        known, (ratio, w, slope, offset) = _Tokens(), model.value
        for batch in batches:
            rows = [features(t, known) for t in batch.column("text").to_pylist()]
            value = slope * margins(rows, ratio, w) + offset
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-value)))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("quality").cast("bigint").alias("label")).filter(
        (crc_bucket(F.col("doc_id"), HOLD_OUT) != HELD) & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    spot = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20))
    labelled = known.count()
    if labelled > COUNT_ROWS:
        known = known.filter(spot < F.lit(int((1 << 20) * COUNT_ROWS / labelled)))
    rows = docs.join(F.broadcast(known), "doc_id")
    ratio, zeros, ones = log_ratios(rows)
    if not zeros or not ones:
        out = docs.withColumn("score", F.lit(ones / (zeros + ones) if zeros + ones else 0.5))
    else:
        wanted = FIT_ROWS + CALIBRATION
        few = known.filter(spot < F.lit(int((1 << 20) * min(1.0, wanted / labelled)) + 1))
        fit_share = FIT_ROWS / wanted
        use = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * fit_share))
        sample = durable(docs.join(F.broadcast(few), "doc_id").select("doc_id", "text", "label", use.alias("use")))
        fitted = durable(sample.coalesce(1).sortWithinPartitions("doc_id").mapInArrow(
            _fit(spark.sparkContext.broadcast(ratio)), "w binary, slope double, offset double")).first()
        model = ratio, np.frombuffer(fitted["w"]), fitted["slope"], fitted["offset"]
        out = docs.mapInArrow(_scored(spark.sparkContext.broadcast(model)), "doc_id long, score double")
    return out.select(
        "doc_id", (crc_bucket(F.col("doc_id"), HOLD_OUT) == HELD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
