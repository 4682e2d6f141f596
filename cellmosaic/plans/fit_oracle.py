"""Oracle SQL of the fits: expectation maximisation as a recursive query.

Every function returns common table expressions. A fit needs two tables under its ``name``:
``{name}_obs (run, assay, group_id, cell_id, x, b, n, total)`` and ``{name}_par (run, assay, group_id, k,
baf, props, st, use_allele, use_total, covered, amask, tmask)``; ``st`` is the key of the dispersions. The
recursion holds one row per run and iteration, with dispersions and weights as lists; a run stops at the
relative change ``tol`` from the second iteration on.
"""

from __future__ import annotations

LOW, HIGH = "1e-6", "1e6"


def bb(tau: str, p: str) -> str:
    return (
        f"(lgamma(n + 1) - lgamma(b + 1) - lgamma(n - b + 1) + lgamma(b + {tau} * {p}) + lgamma(n - b + {tau} * (1 - {p}))"
        f" - lgamma(n + {tau}) + lgamma({tau}) - lgamma({tau} * {p}) - lgamma({tau} * (1 - {p})))"
    )


def nb(size: str, mu: str) -> str:
    return f"(lgamma(x + {size}) - lgamma({size}) - lgamma(x + 1) + {size} * ln({size} / ({size} + {mu})) + x * ln({mu} / ({size} + {mu})))"


def params(name: str, state: str, baf_clip: str = "0.001", k: str = "true", allele: str = "c.imbalanced",
           total: str = "c.aneuploid", use_allele: str = "true", use_total: str = "true") -> str:
    """``{name}_par`` from ``{name}_depth (run, assay, group_id, lam)`` and ``{name}_clones``.

    ``{name}_clones`` has ``(run, group_id, k, cn_a, cn_b, imbalanced, aneuploid, subclonal)``. Depth shares are
    those of the clones kept by ``k``.
    """
    total_copies = "sum(d.lam * (c.cn_a + c.cn_b)) OVER (PARTITION BY d.run, d.assay, c.k)"
    return f"""
{name}_par AS (
  SELECT d.run, d.assay, c.group_id, c.k, {state} AS st, d.lam, coalesce(d.lam > 0, false) AS covered,
         greatest({baf_clip}, least(1 - {baf_clip}, CASE WHEN c.cn_a + c.cn_b > 0 THEN c.cn_b::DOUBLE / (c.cn_a + c.cn_b) ELSE 0 END)) AS baf,
         (c.cn_a + c.cn_b) / {total_copies} AS rdr, d.lam * (c.cn_a + c.cn_b) / {total_copies} AS props,
         ({use_allele}) AND ({allele}) AS use_allele, ({use_total}) AND ({total}) AND coalesce(d.lam > 0, false) AS use_total,
         {allele} AS amask, {total} AS tmask, c.subclonal
  FROM {name}_clones c JOIN {name}_depth d USING (run, group_id) WHERE {k})"""


def scores(out: str, obs: str, par: str) -> str:
    """``{out} (run, cell_id, k, ll)``; ``par`` has tau, phi and pi besides the static columns."""
    mu = "greatest(total * props, 1e-12)"
    return f"""
{out} AS (
  SELECT run, cell_id, k, sum(CASE WHEN use_allele AND n > 0 THEN {bb('tau', 'baf')} ELSE 0 END
     + CASE WHEN use_total THEN {nb('phi', mu)} ELSE 0 END) + max(ln(greatest(pi, 1e-30))) AS ll
  FROM {obs} JOIN {par} USING (run, assay, group_id) GROUP BY run, cell_id, k)"""


def posteriors(out: str, source: str) -> str:
    """``{out}_post (run, cell_id, k, p)`` and ``{out} (run, cell_id, z, max_posterior, best_ll)``."""
    return f"""
{out}_top AS (SELECT run, cell_id, max(ll) AS m FROM {source} GROUP BY ALL),
{out}_sum AS (SELECT run, cell_id, any_value(m) AS m, sum(exp(ll - m)) AS s FROM {source} JOIN {out}_top USING (run, cell_id) GROUP BY ALL),
{out}_post AS (SELECT run, cell_id, k, ll, exp(ll - m) / s AS p FROM {source} JOIN {out}_sum USING (run, cell_id)),
{out} AS (
  SELECT run, cell_id, arg_max(k, (ll, -k)) AS z, max(p) AS max_posterior, max(ll) AS best_ll FROM {out}_post GROUP BY ALL)"""


def rounds(out: str, data: str, keys: str, term: str, lo: str, hi: str, points: int, times: int, log_scale: bool) -> str:
    """A grid search: ``{out} ({keys}, value)``; ``term`` is the likelihood of a row of ``data`` at ``v``.

    On a log scale each round spans one step to both sides of the best point; else it stays inside the
    bounds of the round before as well.
    """
    parts = []
    value = "exp(pt)" if log_scale else "pt"
    last = points - 1
    for r in range(1, times + 1):
        if r == 1:
            source = f"(SELECT DISTINCT {keys}, {lo} AS lo, {hi} AS hi FROM {data})"
        else:
            floor, ceiling = ("lo0", "hi0") if log_scale else ("lo", "hi")
            source = f"(SELECT {keys}, greatest({floor}, best - step) AS lo, least({ceiling}, best + step) AS hi FROM {out}_b{r - 1})"
        parts.append(f"""
{out}_g{r} AS (SELECT {keys}, i, lo, hi, lo + (hi - lo) * i / {last}.0 AS pt, {value} AS v FROM {source} e, range({points}) g(i)),
{out}_s{r} AS (SELECT {keys}, i, any_value(pt) AS pt, any_value(lo) AS lo, any_value(hi) AS hi, sum({term}) AS ll
  FROM {data} JOIN {out}_g{r} USING ({keys}) GROUP BY {keys}, i),
{out}_l{r} AS (SELECT {keys}, arg_max(i, (ll, -i)) AS j, list(ll ORDER BY i) AS lls, list(pt ORDER BY i) AS pts, any_value(lo) AS lo, any_value(hi) AS hi
  FROM {out}_s{r} GROUP BY {keys}),
{out}_b{r} AS (SELECT {keys}, pts[j + 1] AS best, pts[2] - pts[1] AS step, CASE WHEN j > 0 THEN lls[j] END AS l, lls[j + 1] AS m,
  CASE WHEN j < {last} THEN lls[j + 2] END AS r, lo, hi, {lo} AS lo0, {hi} AS hi0 FROM {out}_l{r})""")
    vertex = "CASE WHEN l - 2 * m + r < 0 THEN best + step * (l - r) / (2 * (l - 2 * m + r)) ELSE best END"
    clamped = f"greatest(lo0, least(hi0, {vertex}))"
    parts.append(f"\n{out} AS (SELECT {keys}, {'exp(' + clamped + ')' if log_scale else clamped} AS value FROM {out}_b{times})")
    return ",".join(parts)


TAU_TERM = (
    "CASE WHEN n > 0 THEN lgamma(b + v * baf) + lgamma(n - b + v * (1 - baf)) - lgamma(n + v) + lgamma(v)"
    " - lgamma(v * baf) - lgamma(v * (1 - baf)) ELSE 0 END"
)
PHI_TERM = "lgamma(x + v) - lgamma(v) + v * ln(v / (v + mu)) + x * ln(mu / (v + mu))"


def search(out: str, rows: str, what: str, shared: bool, points: int = 65, times: int = 3) -> str:
    """Dispersions ``{out} (run, assay, st, value)`` of the count rows of the assigned clones."""
    if what == "tau":
        where, term = ("amask" if shared else "true"), TAU_TERM
    else:
        where, term = ("covered AND tmask" if shared else "covered"), PHI_TERM
    kept = f"{out}_d AS (SELECT run, assay, st, baf, b, n, x, greatest(total * props, 1e-12) AS mu FROM {rows} WHERE {where})"
    return f"\n{kept}," + rounds(out, f"{out}_d", "run, assay, st", term, f"ln({LOW})", f"ln({HIGH})", points, times, True)


def joined(out: str, name: str, source: str) -> str:
    """``{name}_par`` with the dispersions and weights of ``source``."""
    return f"""
{out} AS (
  SELECT f.*, coalesce(a.v, {HIGH}::DOUBLE) AS tau, coalesce(t.v, {HIGH}::DOUBLE) AS phi, w.p AS pi FROM {name}_par f
  JOIN (SELECT run, unnest(pi, recursive := true) FROM {source}) w ON w.run = f.run AND w.k = f.k
  LEFT JOIN (SELECT run, unnest(tau, recursive := true) FROM {source}) a ON a.run = f.run AND a.assay = f.assay AND a.st = f.st
  LEFT JOIN (SELECT run, unnest(phi, recursive := true) FROM {source}) t ON t.run = f.run AND t.assay = f.assay AND t.st = f.st)"""


def e_step(name: str) -> str:
    """``{name}`` and ``{name}_post`` from the parameters in ``{name}_fit``."""
    return f"{joined(name + '_end', name, name + '_fit')},{scores(name + '_ll', name + '_obs', name + '_end')},{posteriors(name, name + '_ll')}"


def em(name: str, shared: bool = True, allele: bool = True, total: bool = True, update_pi: bool = False,
       niters: int = 100, tol: str = "1e-4") -> str:
    """``{name}_post`` and ``{name}`` as of :func:`posteriors`, ``{name}_fit`` with the parameters."""
    slot = "STRUCT(assay VARCHAR, st VARCHAR, v DOUBLE)[]"
    tau = search("tau_new", "mine", "tau", shared) if allele else "\ntau_new AS (SELECT NULL::VARCHAR AS run, NULL::VARCHAR AS assay, NULL::VARCHAR AS st, NULL::DOUBLE AS value WHERE false)"
    phi = search("phi_new", "mine", "phi", shared) if total else "\nphi_new AS (SELECT NULL::VARCHAR AS run, NULL::VARCHAR AS assay, NULL::VARCHAR AS st, NULL::DOUBLE AS value WHERE false)"
    weights = f"""(SELECT run, list({{'k': k, 'p': p}}) AS pi FROM (
       SELECT c.run, c.k, coalesce(m.n, 0)::DOUBLE / t.n AS p FROM (SELECT DISTINCT run, k FROM {name}_par) c
       JOIN (SELECT run, count(*) AS n FROM called GROUP BY run) t USING (run)
       LEFT JOIN (SELECT run, z AS k, count(*) AS n FROM called GROUP BY ALL) m USING (run, k)) GROUP BY run)"""
    if not update_pi:
        weights = "(SELECT run, pi FROM cur)"

    def listed(source: str) -> str:
        return f"(SELECT run, list({{'assay': assay, 'st': st, 'v': value}}) AS found FROM {source} GROUP BY run)"

    return f"""
{name}_em AS (
  SELECT 0 AS t, run, []::{slot} AS tau, []::{slot} AS phi, list({{'k': k, 'p': 1.0::DOUBLE / m}}) AS pi, NULL::DOUBLE AS ll, false AS done
  FROM (SELECT DISTINCT run, k, count(DISTINCT k) OVER (PARTITION BY run) AS m FROM {name}_par) GROUP BY run
  UNION ALL
  (WITH cur AS (SELECT * FROM {name}_em WHERE NOT done AND t < {niters} - 1),{joined('par_now', name, 'cur')},{scores('ll_now', name + '_obs', 'par_now')},
{posteriors('called', 'll_now')},
   mine AS (SELECT o.*, f.baf, f.props, f.st, f.covered, f.amask, f.tmask FROM {name}_obs o JOIN called c USING (run, cell_id)
     JOIN {name}_par f ON f.run = o.run AND f.assay = o.assay AND f.group_id = o.group_id AND f.k = c.z),{tau},{phi},
   next AS (
     SELECT cur.t + 1 AS t, cur.run, coalesce(a.found, []) AS tau, coalesce(p.found, []) AS phi, w.pi, cur.ll
     FROM cur JOIN {weights} w ON w.run = cur.run LEFT JOIN {listed('tau_new')} a ON a.run = cur.run
     LEFT JOIN {listed('phi_new')} p ON p.run = cur.run),{joined('par_next', name, 'next')},{scores('ll_next', name + '_obs', 'par_next')},
   objective AS (SELECT run, sum(best) AS ll FROM (SELECT run, cell_id, max(ll) AS best FROM ll_next GROUP BY ALL) GROUP BY run)
   SELECT n.t, n.run, n.tau, n.phi, n.pi, o.ll, coalesce(abs(o.ll - n.ll) / (abs(n.ll) + 1e-10) < {tol}, false) FROM next n JOIN objective o USING (run))
),
{name}_fit AS (SELECT * FROM {name}_em QUALIFY row_number() OVER (PARTITION BY run ORDER BY t DESC) = 1),{e_step(name)}"""
