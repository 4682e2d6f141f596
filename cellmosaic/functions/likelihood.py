"""Beta-Binomial and Negative-Binomial log-probabilities as SQL text.

Arguments are SQL text too, best plain column names: an argument occurs many times
in the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellmosaic.functions.special import lgamma

EPS = "1e-12D"


def bb_constant(b: str, n: str) -> str:
    """log binomial coefficient; depends on data only, so it is computed once."""
    return f"({lgamma(f'{n} + 1D')} - {lgamma(f'{b} + 1D')} - {lgamma(f'{n} - {b} + 1D')})"


def bb_offset(tau: str, p: str) -> str:
    """Part of the Beta-Binomial that depends on parameters only."""
    return f"({lgamma(tau)} - {lgamma(f'{tau} * {p}')} - {lgamma(f'{tau} * (1D - {p})')})"


def bb_data_term(b: str, n: str, tau: str, p: str) -> str:
    heads, tails = lgamma(f"{b} + {tau} * {p}"), lgamma(f"{n} - {b} + {tau} * (1D - {p})")
    return f"({heads} + {tails} - {lgamma(f'{n} + {tau}')})"


def bb_logpmf(b: str, n: str, tau: str, p: str) -> str:
    return f"({bb_constant(b, n)} + {bb_data_term(b, n, tau, p)} + {bb_offset(tau, p)})"


def nb_constant(x: str) -> str:
    return f"(-{lgamma(f'{x} + 1D')})"


def nb_offset(size: str) -> str:
    return f"(-{lgamma(size)})"


def nb_data_term(x: str, mu: str, size: str) -> str:
    log_total = f"ln({size} + {mu})"
    return (
        f"({lgamma(f'{x} + {size}')} + {size} * (ln({size}) - {log_total})"
        f" + {x} * (ln({mu}) - {log_total}))"
    )


def nb_mean(expected: str) -> str:
    return f"greatest({expected}, {EPS})"


def nb_logpmf(x: str, mu: str, size: str) -> str:
    """``mu`` must be floored by :func:`nb_mean`; ``size`` is the inverse dispersion."""
    return f"({nb_constant(x)} + {nb_offset(size)} + {nb_data_term(x, mu, size)})"


def purity_baf(baf: str, rdr: str, theta: str) -> str:
    """Expected B-allele fraction of a mixture of tumour (theta) and normal cells."""
    mixed = f"({baf} * {rdr} * {theta} + 0.5D * (1D - {theta}))"
    depth = f"greatest({rdr} * {theta} + (1D - {theta}), {EPS})"
    return f"greatest({EPS}, least(1D - {EPS}, {mixed} / {depth}))"


def purity_mean(total: str, base: str, rdr: str, theta: str) -> str:
    """Expected depth of the same mixture."""
    return f"({total} * {base} * ({theta} * {rdr} + (1D - {theta})))"


def array_log_gamma() -> Callable[[np.ndarray], np.ndarray]:
    """The series of :func:`special.lgamma` on arrays; a local function, so that it travels by value."""
    half_log_2pi = 0.5 * math.log(2.0 * math.pi)

    def log_gamma(x):
        y = x + 8.0
        inv2 = 1.0 / (y * y)
        series = (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188)))) / y
        rising = x + 1.0
        for i in range(2, 8):
            rising = rising * (x + i)
        return np.where(x > 0, (y - 0.5) * np.log(y) - y + half_log_2pi + series - np.log(x) - np.log(rising), np.nan)

    return log_gamma


def row_constants():
    """The data-only parts of both log-probabilities as UDFs of (b, n) and of x; NULL for NULL."""
    log_gamma = array_log_gamma()

    def allele(b: pd.Series, n: pd.Series) -> pd.Series:
        b, n = b.to_numpy(), n.to_numpy()
        with np.errstate(all="ignore"):
            return pd.Series(log_gamma(n + 1.0) - log_gamma(b + 1.0) - log_gamma(n - b + 1.0))

    def depth(x: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(-log_gamma(x.to_numpy() + 1.0))

    return tuple(F.pandas_udf(f, DoubleType(), F.PandasUDFType.SCALAR) for f in (allele, depth))


# rows of a dispersion's log-likelihood, counted ``cnt`` times: ``gamma`` is log G(u + s w) - log G(s w), of which
# a Beta-Binomial row has three (b, n - b and, counted negative, n) and a depth one; ``mean`` has the depth, its
# mean and the mean's logarithm in u, v, w
PARTS = ["kind", "u", "v", "w", "cnt"]


def grid_sums(keys: Sequence[str], points: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over rows of :data:`PARTS` for an even grid of log dispersions on ``_lo`` to ``_hi`` of the key.

    For ``mapInArrow``, so that keys are compared as codes and no text becomes an object. What it calls is
    local, so that it travels by value. As in SQL, an undefined term is left out of its sum.
    """
    keys, chunk, log_gamma = list(keys), 1024, array_log_gamma()

    def term(kind, u, v, w, log_s):
        s = np.exp(log_s)
        if kind == "mean":
            log_total = np.log(s + v)
            return s * (log_s - log_total) + u * (w - log_total)
        return log_gamma(u + s * w) - log_gamma(s * w)

    def codes_of(columns, rows):
        codes = np.zeros(rows, np.int64)
        for column in columns:
            coded = column.dictionary_encode(null_encoding="encode")
            mixed = codes * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
            codes = np.unique(mixed, return_inverse=True)[1]
        return codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            codes = codes_of([column[c] for c in [*keys, "_lo", "_hi", "kind"]], batch.num_rows)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            values = [column[c].to_numpy(zero_copy_only=False)[order, None] for c in ("u", "v", "w", "cnt")]
            first, sums = order[starts], []
            with np.errstate(all="ignore"):
                for i, start, end in zip(first.tolist(), starts, [*starts[1:], len(order)]):
                    lo, hi, kind = (column[c][i].as_py() for c in ("_lo", "_hi", "kind"))
                    log_s = (lo + (hi - lo) * np.arange(points) / (points - 1.0))[None, :]
                    total = np.zeros(points)
                    for j in range(start, end, chunk):
                        u, v, w, cnt = (x[j:min(j + chunk, end)] for x in values)
                        total += np.nansum(cnt * term(kind, u, v, w, log_s), axis=0)
                    sums.append(total)
            kept = [column[c].take(pa.array(first)) for c in [*keys, "_lo", "_hi"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.list_(pa.float64()))], names=[*keys, "_lo", "_hi", "_sums"])

    return run


# a count row under its own parameters: ``at_allele`` and ``at_total`` are the parts known beforehand
ROW = ["b", "n", "p", "tau", "at_allele", "use_allele", "x", "mu", "size", "at_total", "use_total"]


def row_terms(offsets: bool) -> Callable[..., np.ndarray]:
    """Log-likelihoods of :data:`ROW` arrays; with ``offsets`` the known parts hold those of the parameters.

    As SQL text the terms are more than the JVM compiles to machine code. A row without allele coverage
    has probability one, a row without counts none; an undefined term that counts is an error.
    """
    log_gamma = array_log_gamma()

    def terms(b, n, p, tau, at_allele, use_allele, x, mu, size, at_total, use_total):
        allele, total, out = use_allele & (n > 0), use_total & ~np.isnan(n), np.zeros(len(n))
        with np.errstate(all="ignore"):
            if allele.any():
                u, v, t, w = b[allele], n[allele], tau[allele], p[allele]
                head, tail = t * w, t * (1.0 - w)
                fixed = 0.0 if offsets else log_gamma(t) - log_gamma(head) - log_gamma(tail)
                out[allele] = at_allele[allele] + fixed + log_gamma(u + head) + log_gamma(v - u + tail) - log_gamma(v + t)
            if total.any():
                u, m, s = x[total], mu[total], size[total]
                fixed, log_all = 0.0 if offsets else -log_gamma(s), np.log(s + m)
                out[total] += at_total[total] + fixed + log_gamma(u + s) + s * (np.log(s) - log_all) + u * (np.log(m) - log_all)
        if np.isnan(out).any():
            raise ValueError("undefined log-probability")
        return out

    return terms


def row_loglik():
    """The log-likelihoods of :data:`ROW` columns as a UDF."""
    terms = row_terms(True)

    def loglik(b, n, p, tau, at_allele, use_allele, x, mu, size, at_total, use_total):
        rows = (b, n, p, tau, at_allele, use_allele, x, mu, size, at_total, use_total)
        return pd.Series(terms(*[c.to_numpy() for c in rows]))

    return F.pandas_udf(loglik, DoubleType(), F.PandasUDFType.SCALAR)


def clone_sums(keys: Sequence[str], offsets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Score per clone of every row of ``keys`` from its list ``_rows`` of k, log_pi and :data:`ROW`.

    For ``mapInArrow``; adds ``ks`` in ascending order and ``lls``, the sums with the clone's log_pi.
    """
    keys, chunk, names, terms = list(keys), 1024, ["k", "log_pi", *ROW], row_terms(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                lists = part.column(part.schema.get_field_index("_rows"))
                counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten()
                k, log_pi, *row = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(len(names)))
                width = int(k.max()) + 1
                of = np.repeat(np.arange(len(counts)), counts) * width + k
                found, first, at = np.unique(of, return_index=True, return_inverse=True)
                sums = np.bincount(at, weights=terms(*row), minlength=len(found)) + log_pi[first]
                ends = np.concatenate([[0], np.cumsum(np.bincount(found // width, minlength=len(counts)))])
                ends = pa.array(ends, pa.int32())
                made = [pa.ListArray.from_arrays(ends, pa.array(found % width, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(sums))]
                kept = [part.column(part.schema.get_field_index(c)) for c in keys]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keys, "ks", "lls"])

    return run


# count rows of a spot in a purity search: counts with their parts of the likelihood, parameters of the group, switches
PURITY_ROW = ["b", "n", "x", "total", "bb_const", "nb_const", "baf", "rdr", "lambda", "use_allele", "use_total"]


def purity_grids(
    keys: Sequence[str], tau: float, size: float, span: tuple[float, float], points: int, rounds: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Grid search of the purity of every row of ``keys`` over its list ``_rows`` of :data:`PURITY_ROW`.

    For ``mapInArrow``; adds ``_sums``, the log-likelihoods of the last round's grid, and ``theta``, the
    vertex around its best point (the first on ties). Both are NULL for an empty list. Each round keeps
    one grid step on both sides of the best point. As in SQL, a limit stands in for an undefined value.
    """
    keys, chunk, log_gamma, eps, (lowest, highest) = list(keys), 512, array_log_gamma(), 1e-12, span
    names = list(PURITY_ROW)
    log_size, gamma_size, gamma_tau = math.log(size), math.lgamma(size), math.lgamma(tau)

    def scores(row, theta):
        rest = 1.0 - theta
        depth = row["rdr"] * theta + rest
        out = np.zeros(theta.shape)
        at = (row["use_allele"] & (row["n"] > 0))[:, 0]
        if at.any():
            b, n = row["b"][at], row["n"][at]
            mixed = row["baf"][at] * row["rdr"][at] * theta[at] + 0.5 * rest[at]
            p = np.fmax(eps, np.fmin(1.0 - eps, mixed / np.fmax(depth[at], eps)))
            head, tail = tau * p, tau * (1.0 - p)
            fixed = row["bb_const"][at] + gamma_tau - log_gamma(n + tau)
            out[at] = fixed + log_gamma(b + head) + log_gamma(n - b + tail) - log_gamma(head) - log_gamma(tail)
        at = row["use_total"][:, 0]
        if at.any():
            x = row["x"][at]
            mu = np.fmax(row["total"][at] * row["lambda"][at] * depth[at], eps)
            log_total = np.log(size + mu)
            fixed = row["nb_const"][at] - gamma_size + log_gamma(x + size)
            out[at] += fixed + size * (log_size - log_total) + x * (np.log(mu) - log_total)
        if np.isnan(out).any():
            raise ValueError("undefined log-probability")
        return out

    def search(row, counts):
        starts, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
        own = np.arange(len(counts))
        low, high = np.full(len(counts), lowest), np.full(len(counts), highest)
        for _ in range(rounds):
            grid = low[:, None] + (high - low)[:, None] * np.arange(points) / (points - 1.0)
            sums = np.add.reduceat(scores(row, grid[owner]), starts, axis=0)
            top, step = sums.argmax(1), grid[:, 1] - grid[:, 0]
            best = grid[own, top]
            low, high = np.maximum(low, best - step), np.minimum(high, best + step)
        left = np.where(top > 0, sums[own, top - 1], np.nan)
        right = np.where(top < points - 1, sums[own, np.minimum(top + 1, points - 1)], np.nan)
        bend = left - 2 * sums[own, top] + right
        peak = np.where(bend < 0, best + step * (left - right) / (2 * bend), best)
        return sums, np.clip(peak, lowest, highest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                lists = part.column(part.schema.get_field_index("_rows"))
                counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                full = np.flatnonzero(counts > 0)
                sums, theta = [None] * len(counts), np.full(len(counts), np.nan)
                if len(full):
                    flat = lists.flatten()
                    row = {c: flat.field(j).to_numpy(zero_copy_only=False)[:, None] for j, c in enumerate(names)}
                    with np.errstate(all="ignore"):
                        found, theta[full] = search(row, counts[full])
                    for j, values in zip(full, found):
                        sums[j] = values
                kept = [part.column(part.schema.get_field_index(c)) for c in keys]
                made = [pa.array(sums, pa.list_(pa.float64())), pa.array(theta, pa.float64(), mask=counts == 0)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keys, "_sums", "theta"])

    return run
