"""Approximate nearest neighbours: one robust-pruned directed graph per shard.

Vectors are dealt into shards of about ``SHARD_ROWS`` distinct vectors by a hash. A shard
builds its graph in two passes: each batch of vectors searches the graph greedily from
the middle, the vectors met are candidates, and pruning keeps a candidate only if no kept
neighbour is closer to it by the factor ``RELAX``; edges are added both ways and pruned
again where they are too many. A query walks every shard's graph with a beam of width
``BEAM``; the best of each shard meet by query, so a task holds one shard, and a query
gathers ``k`` rows per shard.

Copies of a vector are one point of the graph that carries its smallest ``k + 1`` ids:
more can never be among the ``k`` nearest, as ties go to the smaller id. Distances are
computed in double precision from the original components.

Vectors that are null, empty, zero, or hold null or non-finite components take no part,
neither as queries nor as candidates. Vectors of different lengths are never compared. A
table with fewer candidates than ``k`` gives all of them. Repeated ids are rows of their
own, a query's own id is never its neighbour. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.session import durable

K = 10
SHARD_ROWS = 4096
DEGREE = 32
BUILD_BEAM = 64
BEAM = 96
RELAX = 1.2
BATCH = 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint"), v.alias("v")).filter(F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)))
    return rows.filter(F.exists("v", lambda x: x != 0))


def _distances(points: np.ndarray, at: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of queries (lanes x d) to points at (lanes x m); far for at < 0."""
    diff = points[at] - queries[:, None, :]
    out = np.einsum("lmd,lmd->lm", diff, diff)
    out[at < 0] = np.inf
    return out


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, width: int, want_seen: bool = False):
    """Ids and squared distances of the beam (lanes x width), and the vectors expanded."""
    lanes = len(queries)
    row = np.arange(lanes)
    beam = np.full((lanes, width), -1, np.int64)
    beam[:, 0] = start
    far = np.full((lanes, width), np.inf)
    far[:, 0] = _distances(points, beam[:, :1], queries)[:, 0]
    done = np.zeros((lanes, width), bool)
    met = np.zeros((lanes, len(points)), bool)
    met[:, start] = True
    seen: list[np.ndarray] = []
    while True:
        open_ = np.where(done | (beam < 0), np.inf, far)
        best = open_.argmin(axis=1)
        active = np.isfinite(open_[row, best])
        if not active.any():
            break
        now = np.where(active, beam[row, best], -1)
        done[row[active], best[active]] = True
        seen.append(now)
        near = np.where(active[:, None], edges[now], -1)
        fresh = (near >= 0) & ~met[row[:, None], near]
        near = np.where(fresh, near, -1)
        r, c = np.nonzero(fresh)
        met[r, near[r, c]] = True
        every = np.concatenate([beam, near], axis=1)
        dist = np.concatenate([far, _distances(points, near, queries)], axis=1)
        used = np.concatenate([done, np.zeros(near.shape, bool)], axis=1)
        part = np.argpartition(dist, width - 1, axis=1)[:, :width]
        beam, far, done = (np.take_along_axis(x, part, 1) for x in (every, dist, used))
        beam = np.where(np.isfinite(far), beam, -1)
    return beam, far, (np.stack(seen, axis=1) if want_seen and seen else None)


def prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """Diverse neighbours (lanes x degree, -1 behind) among candidates (lanes x m, -1 for none)."""
    candidates = np.where(candidates == own[:, None], -1, candidates)
    order = np.sort(candidates, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1  # each once
    dist = _distances(points, order, points[own])
    by = np.argsort(dist, axis=1, kind="stable")[:, :192]
    cand, dist = np.take_along_axis(order, by, 1), np.take_along_axis(dist, by, 1)
    vectors = points[cand]
    alive = np.isfinite(dist)
    out = np.full((len(own), degree), -1, np.int64)
    row = np.arange(len(own))
    for slot in range(degree):
        first = alive.argmax(axis=1)
        any_ = alive[row, first]
        if not any_.any():
            break
        out[any_, slot] = cand[row, first][any_]
        diff = vectors - vectors[row, first][:, None, :]
        covered = relax * relax * np.einsum("lmd,lmd->lm", diff, diff) <= dist
        alive &= ~(covered & any_[:, None])
        alive[row, first] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX):
    """Edges (n x degree, -1 behind) and the vector that searches start from."""
    n = len(points)
    rng = np.random.default_rng(5)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree), -1, np.int64)
    first = min(degree // 2, n - 1)
    if first:
        edges[:, :first] = rng.integers(0, n, (n, first))
        edges[edges == np.arange(n)[:, None]] = start
    for factor in (1.0, relax):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            own = order[lo:lo + BATCH]
            found, _, seen = beam_search(points, edges, start, points[own], min(beam, n), True)
            edges[own] = prune(points, own, np.concatenate([found, seen, edges[own]], axis=1), factor, degree)
            src = np.repeat(own, degree)
            dst = edges[own].reshape(-1)
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            ends, heads, sizes = np.unique(dst, return_index=True, return_counts=True)
            back = np.full((len(ends), int(sizes.max()) if len(sizes) else 0), -1, np.int64)
            if len(ends):
                col = np.arange(len(dst)) - np.repeat(heads, sizes)
                back[np.repeat(np.arange(len(ends)), sizes), col] = src
                for at in range(0, len(ends), BATCH):
                    some = ends[at:at + BATCH]
                    edges[some] = prune(points, some, np.concatenate([edges[some], back[at:at + BATCH]], axis=1), factor, degree)
    return edges, start


def _search_shard(queries, k: int, beam: int):
    """One shard: build the graph and give each query's best k candidates."""

    def run(table: pa.Table) -> pa.Table:
        q_ids, q_vectors = queries.value
        points = np.array(table.column("v").to_pylist(), np.float64)
        ids = table.column("ids").to_pylist()
        out_q, out_v, out_s = [], [], []
        same = [i for i, v in enumerate(q_vectors) if len(v) == points.shape[1]]
        edges, start = build_graph(points)
        for lo in range(0, len(same), BATCH):
            some = same[lo:lo + BATCH]
            asked = np.stack([q_vectors[i] for i in some])
            found, far, _ = beam_search(points, edges, start, asked, min(max(beam, k + 1), len(points)))
            by = np.argsort(far, axis=1, kind="stable")
            for lane, i in enumerate(some):
                best = [
                    (float(far[lane, j]), vec) for j in by[lane] if found[lane, j] >= 0
                    for vec in ids[found[lane, j]] if vec != q_ids[i]]
                for d, vec in sorted(best)[:k]:
                    out_q.append(q_ids[i])
                    out_v.append(vec)
                    out_s.append(d ** 0.5)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()),
                         "score": pa.array(out_s, pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per query its k nearest found: query_id, rank (from 1), vec_id, score (distance).

    ``vectors`` and ``queries`` have vec_id and v as from ``usable``. Queries go to every
    shard; they are read in blocks of ``QUERY_BLOCK`` so that a block can be broadcast.
    """
    spark = vectors.sparkSession
    copies = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    points = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = durable(points)
    total = points.count()
    shards = max(1, -(-total // shard_rows))
    shard = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    points = points.withColumn("shard", shard).withColumn("width", F.size("v"))
    found = None
    for block in _blocks(queries):
        part = points.groupBy("shard", "width").applyInArrow(
            _search_shard(spark.sparkContext.broadcast(block), k, beam), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


QUERY_BLOCK = 100_000


def _blocks(queries: DataFrame):
    """The queries on the driver, ``QUERY_BLOCK`` at a time."""
    ids, rows = [], []
    for r in queries.select("vec_id", "v").orderBy("vec_id").toLocalIterator():
        ids.append(r["vec_id"])
        rows.append(np.array(r["v"], np.float64))
        if len(ids) == QUERY_BLOCK:
            yield ids, rows
            ids, rows = [], []
    if ids:
        yield ids, rows


def search_every(vectors: DataFrame, step: int, k: int = K) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by ``step``; candidates: every other row."""
    rows = durable(usable(vectors))
    return nearest(rows, rows.filter(F.col("vec_id") % step == 0), k)
