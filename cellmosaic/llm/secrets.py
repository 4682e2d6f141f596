"""Secret scan with multipart credential linking, in DataFrame operations only.

Base kinds are reported wherever they match: assignments to a secret's name, access
identifiers, hexadecimal runs. Weak parts alone mean nothing: names of users or clients
("id"), values of further secret-like names ("part"), hosts and addresses ("endpoint").
They are linked by an interval join: parts lie in scopes, stretches of ``SCOPE`` code
points, and a weak part is reported only if its complement starts within ``SCOPE`` of it:
an identifier needs a secret (base or weak), a secret an identifier, an endpoint both.
The join probes a part's own scope and its two neighbours, of which only the first and
last start per role are kept, so a text full of parts costs its length, not its pairs.

Positions are code points of the whole text. A match's place is the length of all that
the pattern splits off before it.

Null and empty texts have no span. Rows are judged one by one; rows equal in id and text
get equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.operators.joins import join_dim
from cellmosaic.session import durable

SCOPE = 240

# fixed values: the base kinds in their order, their patterns, the least length of the group that counts
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same as runs of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # the same as runs of 16 characters or more
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "id", "part", "endpoint")
ROLES = {"assign": "secret", "hex": "secret", "access": "id", "id": "id", "part": "secret", "endpoint": "endpoint"}

ID = r"""(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
PART = r"""(?i:pwd|pass(?:code|phrase)|credentials?|private_?key|signature|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
ENDPOINT = r"""(?i:https?|ftp|ssh|jdbc:[a-z]+|mongodb|redis|amqp)://[A-Za-z0-9._:@/-]+|(?i:host|server|endpoint|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}"""

_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def match_spans(text: Column, pattern: str, rank: int, likely: Column, group: int = 0, least: int = 1) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters; ``likely`` is a cheap
    condition that every text with a match meets."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.split(text, pattern, -1).alias("gap"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + F.char_length(x["gap"])
        last = first + F.coalesce(F.char_length(x["whole"]), F.lit(0))
        span = F.struct(first.alias("start"), F.lit(rank).alias("rank"), last.cast("bigint").alias("end"))
        kept = F.char_length(x["value"]) >= least  # null behind the last match
        return F.struct(
            last.cast("bigint").alias("at"),
            F.when(kept, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(found, start, step)["spans"]
    return F.when(likely & F.coalesce(text.rlike(pattern), F.lit(False)), spans).otherwise(F.array().cast(_SPAN))


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, base and weak spans of every text."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    text, low = F.col("text"), F.col("low")
    has = lambda *parts: F.greatest(*[low.contains(p) for p in parts], F.lit(False))
    base = F.concat(
        match_spans(text, ASSIGN, 0, has("passw", "secret", "token", "key"), 2, ASSIGN_LEAST),
        match_spans(text, ACCESS, 1, text.contains("AKIA")),
        match_spans(text, HEX, 2, F.lit(True)),
    )
    weak = F.concat(
        match_spans(text, ID, 3, has("user", "login", "account", "client", "access")),
        match_spans(text, PART, 4, has("pwd", "passcode", "passphrase", "credential", "private", "signature", "auth")),
        match_spans(text, ENDPOINT, 5, has("://", "host", "server", "endpoint", "url")),
    )
    return rows.select("doc_id", "row", base.alias("base"), weak.alias("weak"))


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, linked: the weak spans whose complements co-occur, per row that has any."""
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("s.rank") + 1)
    parts = durable(
        found.filter("size(weak) > 0").select("row", F.explode(F.concat("base", "weak")).alias("s"))
        .select("row", "s", role.alias("role"), F.floor(F.col("s.start") / scope).alias("place")).distinct())
    edges = parts.groupBy("row", "place").pivot("role", ["id", "secret", "endpoint"]).agg(
        F.min("s.start").alias("first"), F.max("s.start").alias("last"))
    probes = parts.filter("s.rank >= 3").withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    probes = probes.withColumn("place", F.col("place") + F.col("step"))
    met = probes.join(edges, ["row", "place"])
    near = {
        r: F.when(F.col("step") == 0, F.col(f"{r}_first").isNotNull())
        .when(F.col("step") < 0, F.col(f"{r}_last") >= F.col("s.start") - scope)
        .otherwise(F.col(f"{r}_first") <= F.col("s.start") + scope)
        for r in ("id", "secret")
    }
    flags = met.groupBy("row", "s", "role").agg(*[
        F.coalesce(F.bool_or(c), F.lit(False)).alias(f"near_{r}") for r, c in near.items()])
    kept = flags.filter(
        ((F.col("role") == "id") & F.col("near_secret")) | ((F.col("role") == "secret") & F.col("near_id"))
        | (F.col("near_id") & F.col("near_secret")))
    return kept.groupBy("row").agg(F.collect_list("s").alias("linked"))


def span_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, base and linked spans (start, rank of the kind, end)."""
    found = durable(with_spans(docs))
    linked = durable(linked_parts(found, scope))
    out = join_dim(found, linked, ["row"], ["doc_id"], "left")
    return out.select("doc_id", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))
