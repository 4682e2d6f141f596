"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text, each from the whole text: density of lexicon words, of strong lexicon
words and their number, their closeness to a second-person word, closeness of a hit to
capitals, share of capital letters, of words in capitals, densities of exclamation and
question marks and of other punctuation, share of obfuscated words (digits or signs
between letters, letters drawn out) and of obfuscated lexicon words, words per text.

The lexicon joins a short fixed list with words that the labelled rows show: words in
at least ``LEAST_DOCS`` toxic texts whose smoothed log-odds pass ``LEAST_ODDS``, at most
``LEXICON_WORDS``. Trees, lexicon and calibration are fitted on labelled rows that are
not held out, at most about ``FIT_ROWS`` of them, chosen by a hash of the id; lexicon
odds and trees use four fifths, the isotonic step the last fifth.

Null and empty texts have all features 0 and get the score of such a text. Labels may
be null (not used). Rows repeated are each scored. Without labelled rows of both classes
every score is 0 and nothing is predicted toxic. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmosaic.llm.common import crc_bucket
from cellmosaic.session import durable

FIT_ROWS = 20_000
LEXICON_WORDS = 300
LEAST_DOCS = 4
LEAST_ODDS = 2.5
NEAR_WORDS = 6
TREES, DEPTH, STEP = 20, 3, 0.3
HOLD_OUT, HELD = 5, 0
THRESHOLD = 0.5

# fixed values: insults that are part of the lexicon whatever the labels show
INSULTS = (
    "idiot idiots moron morons stupid imbecile loser losers scum trash pathetic worthless clown "
    "dumb jerk fool garbage disgusting vermin filth bastard bitch asshole idiota imbécile estúpido "
    "estúpida basura escoria dummkopf abschaum arschloch crétin connard ordure"
).split()
# fixed values: words that address the reader
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted "
    "ustedes tú ti contigo vosotros".split()
)
# fixed values: signs that stand for letters
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

FEATURES = (
    "hit_density strong_density hits near_you hit_near_capitals capital_letters capital_words exclaims "
    "punctuation obfuscated obfuscated_hits log_words"
).split()
_TOKEN = re.compile(r"[^\W_]+")
_DISGUISED = re.compile(r"[A-Za-z]+[0-9@$!*]+[A-Za-z][A-Za-z0-9@$!*]*")
_DRAWN = re.compile(r"([A-Za-z])\1{2,}")


def undisguise(word: str) -> str:
    return _DRAWN.sub(r"\1", word.lower().translate(SIGNS))


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The feature values of one text, in the order of ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = _TOKEN.findall(low)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    masked = [w for w in map(undisguise, _DISGUISED.findall(text)) if w]
    drawn = len(_DRAWN.findall(text))
    near_you = near_caps = 0.0
    if hits:
        you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        if len(you):
            near_you = float((_gaps(np.array(hits), you) <= NEAR_WORDS).mean())
        if len(low) == len(text):
            caps = [m.group().isupper() for m in _TOKEN.finditer(text)]
            near_caps = sum(caps[i] for i in hits if i < len(caps)) / len(hits)
    letters = sum(map(len, words)) or 1
    return [
        len(hits) / n,
        sum(lexicon[words[i]] for i in hits) / n,
        float(len(hits)),
        near_you,
        near_caps,
        _capitals(text) / letters,
        len(re.findall(r"\b[A-Z]{2,}\b", text)) / n,
        (text.count("!") + text.count("?")) / n,
        sum(text.count(c) for c in ".,;:*#%&$|") / n,
        (len(masked) + drawn) / n,
        sum(w in lexicon for w in masked) / n,
        math.log1p(len(words)),
    ]


def _capitals(text: str) -> int:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return int(((data >= 65) & (data <= 90)).sum())


def _gaps(hits: np.ndarray, you: np.ndarray) -> np.ndarray:
    at = np.searchsorted(you, hits)
    left = np.abs(hits - you[np.maximum(at - 1, 0)])
    return np.minimum(left, np.abs(hits - you[np.minimum(at, len(you) - 1)]))


def _with_features(lexicon: dict[str, float]):
    def run(batches):
        for batch in batches:
            rows = [features(t, lexicon) for t in batch.column("text").to_pylist()]
            values = pa.array(np.array(rows, np.float64).reshape(-1))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(ends, values)], [*names, "features"])

    return run


def _word_rows(batches):
    """Distinct words of labelled texts with the number of toxic and other texts they are in."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            (toxic if label else other).update(set(_TOKEN.findall((text or "").lower())))
    words = [w for w in toxic if len(w) > 2]
    yield pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()),
         pa.array([other[w] for w in words], pa.int64())], ["word", "toxic", "other"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """word -> weight from labelled rows (text, label); at most LEXICON_WORDS learned words."""
    sides = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    t, o = sides.get(1, 0), sides.get(0, 0)
    odds = F.log((F.sum("toxic") + 0.5) / (t + 1.0)) - F.log((F.sum("other") + 0.5) / (o + 1.0))
    found = (
        rows.select("text", "label").mapInArrow(_word_rows, "word string, toxic long, other long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), odds.alias("odds"))
        .filter((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "word").limit(LEXICON_WORDS)
    )
    lexicon = {w: LEAST_ODDS for w in INSULTS}
    return lexicon | {r["word"]: float(r["odds"]) for r in found.collect()}


class ToxicityModel:
    """Lexicon, trees and isotonic step; ``score`` adds a column score in [0, 1]."""

    def __init__(self, lexicon, trees=None, calibration=None):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns of docs (text among them or not) with score."""
        kept = docs.select(*keep, F.col("text"))
        schema = T.StructType([kept.schema[c] for c in keep]).add("features", T.ArrayType(T.DoubleType()))
        rows = kept.mapInArrow(_with_features(self.lexicon), schema)
        if self.trees is None:
            return rows.select(*keep, F.lit(0.0).alias("score"))
        margin = self.trees.transform(rows.withColumn("features", array_to_vector("features")))
        margin = margin.withColumn("margin", vector_to_array("probability")[1])
        return self.calibration.transform(margin).select(
            *keep, F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from labelled rows; the caller has taken the held-out ones away."""
    known = labels.select("doc_id", F.col("toxic").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    part = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20))
    if total > FIT_ROWS:
        known = known.filter(part < F.lit(int((1 << 20) * FIT_ROWS / total)))
    rows = durable(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))  # FIT_ROWS bounds it
    train = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) > 0
    lexicon = learn_lexicon(rows.filter(train))
    if rows.select("label").distinct().count() < 2:
        return ToxicityModel(lexicon)
    model = ToxicityModel(lexicon)
    seen = durable(rows.select("doc_id", F.col("label").cast("double").alias("label"), "text").mapInArrow(
        _with_features(lexicon), "doc_id long, label double, features array<double>"))
    seen = seen.withColumn("features", array_to_vector("features"))
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, minInstancesPerNode=5)
    sides = [seen.filter(train), seen.filter(~train)]
    if any(s.select("label").distinct().count() < 2 for s in sides):
        sides = [seen, seen]
    model.trees = gbt.fit(sides[0].orderBy("doc_id"))
    fold = model.trees.transform(sides[1]).withColumn("margin", vector_to_array("probability")[1])
    model.calibration = IsotonicRegression(
        featuresCol="margin", labelCol="label", predictionCol="score").fit(fold.select("margin", "label"))
    return model


def _learned(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    held = crc_bucket(F.col("doc_id"), HOLD_OUT) == HELD
    return fit(docs, labels.filter(~held))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    out = _learned(docs, labels).score(docs, ["doc_id"])
    return out.select(
        "doc_id", (crc_bucket(F.col("doc_id"), HOLD_OUT) == HELD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")  # no name can clash in there
    kept = _learned(docs, labels).score(packed, ["row"]).filter(F.col("score") < THRESHOLD)
    return kept.select("row.*")
