"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``WINDOW`` words, or all its words if it has fewer. A
window's tokens are its word shingles (five words, or all of a shorter window). A text
contains a window only if it holds every token of it, so one token is a sufficient
prefix: the tokens are ordered by their count over all documents, rarest first, and only
each window's first one is joined with the shingles of the documents. Windows with a
token that no document has are out. A match must leave room for the window before and
behind it (positions, length); what is left is verified word by word against the text.

Two scans of the documents: one writes where tokens of the benchmark stand, from which
counts and prefix join are read; the other verifies. Candidates hold places and hashes of
windows, whose words they meet when the text is at hand: nothing that is broadcast holds
words or items once per document. Texts with candidates are shuffled if the candidates
of all documents are too large to broadcast by a checked size, other texts only if even
the keys of those texts are.

Null texts have no words. Texts without words hit nothing and are clean. Rows are judged
one by one, repeated ids too. Items with a null id count for hits and are not listed;
null or empty items have no window; repeated item ids count once. With an empty
benchmark nothing is hit. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.common import lower_ascii
from cellmosaic.operators.joins import join_dim
from cellmosaic.session import durable

WINDOW = 13
SHINGLE = 5
SHARE = 20  # contaminated: SHARE * n_hit >= n_words
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before lower-casing


def terms(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def term_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ANY_CASE)), F.lit(0)).cast("bigint")


def shingles(size: int) -> Column:
    """Hashes of the runs of ``size`` entries of the column ``words``."""
    parts = ", ".join(f"get(words, i + {j})" for j in range(size))
    return F.expr(
        f"IF(size(words) < {size}, array(), transform(sequence(0, size(words) - {size}), i -> xxhash64({size}, {parts})))"
    ).cast("array<bigint>")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: words, the sorted ids of their items."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), terms(F.col("text")).alias("words"))
    rows = rows.filter("size(words) > 0").withColumn("start", F.explode(F.expr(
        f"sequence(1, greatest(size(words) - {window} + 1, 1))")))
    return rows.groupBy(F.slice("words", F.col("start"), F.lit(window)).alias("words")).agg(
        F.array_sort(F.collect_set("item")).alias("items"))


def _doc_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, pos, token) of every shingle of every document."""
    rows = docs.select("row", terms(F.col("text")).alias("words"))
    out = None
    for size in sizes:
        part = rows.select("row", F.posexplode(shingles(size)).alias("pos", "token"))
        out = part if out is None else out.unionByName(part)
    return out


def window_tokens(windows: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """Every token of every window: words, items, at (the token's place), token."""
    parts = None
    for size in sizes:
        fits = windows.filter(F.least(F.size("words"), F.lit(shingle)) == size)
        part = fits.select("words", "items", F.posexplode(shingles(size)).alias("at", "token"))
        parts = part if parts is None else parts.unionByName(part)
    return durable(parts)


def prefix_tokens(parts: DataFrame, places: DataFrame) -> DataFrame:
    """Per window its rarest token in ``places``: token, at, words, items."""
    counts = durable(places.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    counted = parts.join(counts, "token", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("rare"),
        F.first("items").alias("items"))
    return durable(counted.filter("rare.n > 0").select("rare.token", "rare.at", "words", "items"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row that holds a window: row, n_hit, items (sorted list of ids as text)."""
    windows = durable(item_windows(items, window))
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect())
    if not sizes:
        return docs.select("row").filter("false").withColumns(
            {"n_hit": F.lit(0).cast("bigint"), "items": F.array().cast("array<string>")})
    parts = window_tokens(windows, sizes, shingle)
    places = durable(join_dim(
        _doc_shingles(docs, sizes), parts.select("token").distinct(), ["token"], ["row"], bound=parts))
    prefix = prefix_tokens(parts, places)
    named = prefix.withColumns({"wid": F.xxhash64("words"), "n": F.size("words")})
    tokens = named.groupBy("token").agg(F.collect_list(F.struct("at", "wid", "n")).alias("windows"))
    found = join_dim(places, tokens, ["token"], ["row"], bound=prefix, stored=True)
    found = found.select("row", "pos", F.explode("windows").alias("w")).select(
        "row", (F.col("pos") - F.col("w.at")).alias("start"), "w.wid", "w.n").filter("start >= 0")
    candidates = durable(found.groupBy("row").agg(F.collect_set(F.struct("start", "wid", "n")).alias("found")))
    # the row is a hash of the text too, so a salt by the text would not spread it
    texts = join_dim(docs.select("row", "text"), candidates, ["row"], ["text"], salts=1, stored=True)
    # the array of one binds the words once; as a column of their own they would be split anew per candidate
    cut = texts.select("row", F.explode(F.transform(
        F.array(F.struct(terms(F.col("text")).alias("words"), "found")),
        lambda x: F.transform(x["found"], lambda f: F.struct(
            f["start"].alias("start"), f["wid"].alias("wid"),
            F.slice(x["words"], f["start"] + 1, f["n"]).alias("here"))))[0]).alias("f")).select("row", "f.*")
    # windows whose hashes are equal are told apart by their words
    held = join_dim(cut, named.select("wid", "words", "items"), ["wid"], ["row"], bound=prefix, stored=True)
    return held.filter("here = words").groupBy("row").agg(
        F.collect_set(F.struct("start", F.size("words").alias("n"))).alias("spans"),
        F.collect_set("items").alias("items"),
    ).select(
        "row",
        F.expr("size(array_distinct(flatten(transform(spans, f -> sequence(f.start, f.start + f.n - 1)))))")
        .cast("bigint").alias("n_hit"),
        F.expr("array_sort(array_distinct(flatten(items)))").alias("items"),
    )


def with_row(docs: DataFrame) -> DataFrame:
    """Adds row: a hash of id and text. Rows that share it are equal or are verified apart."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items, contaminated."""
    rows = with_row(docs.select("doc_id", "text"))
    found = durable(hits(rows, items, window, shingle))
    out = join_dim(
        rows.select("row", "doc_id", term_count(F.col("text")).alias("n_words")), found, ["row"], ["doc_id"], "left",
        salts=1, stored=True)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
        listed.alias("items"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    packed = with_row(docs.select("doc_id", "text", F.struct(*docs.columns).alias("own")))
    found = durable(hits(packed.select("row", "doc_id", "text"), items, window, shingle).select("row", "n_hit"))
    out = join_dim(
        packed.withColumn("n_words", term_count(F.col("text"))), found, ["row"], ["doc_id"], "left", salts=1, stored=True)
    dirty = F.coalesce(SHARE * F.col("n_hit") >= F.col("n_words"), F.lit(False))
    return out.filter(~dirty).select("own.*")
