"""SQL for DuckDB that gives the same rows as the queries of ``elutra.queries``."""

from __future__ import annotations

import numpy as np

PROF = """prof AS (SELECT s.s_suppkey AS key, g.i::INT AS idx, coalesce(sum(l.l_quantity), 0)::DOUBLE AS v
  FROM supplier s CROSS JOIN range(83) g(i)
  LEFT JOIN (SELECT l_suppkey, l_quantity, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS m FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F') l
    ON l.l_suppkey = s.s_suppkey AND l.m = g.i GROUP BY 1, 2)"""
GAP = """gap AS (SELECT key, idx, CASE WHEN v = 0 AND lag(v) OVER w <> 0 AND lead(v) OVER w <> 0 THEN (lag(v) OVER w + lead(v) OVER w) / 2 ELSE v END AS v
  FROM {0} WINDOW w AS (PARTITION BY key ORDER BY idx))"""
GRID = """grid AS (SELECT p.key, j.j::INT AS idx, CASE WHEN floor(j.j * n.l / 72.0::DOUBLE) >= n.l - 1 THEN z.v ELSE p.v + (q.v - p.v) * (j.j * n.l / 72.0::DOUBLE - floor(j.j * n.l / 72.0::DOUBLE)) END AS v
  FROM range(72) j(j), (SELECT key, count(*) AS l FROM {0} GROUP BY 1) n, {0} p
  LEFT JOIN {0} q ON q.key = p.key AND q.idx = p.idx + 1
  LEFT JOIN {0} z ON z.key = p.key AND z.idx = (SELECT max(idx) FROM {0})
  WHERE n.key = p.key AND p.idx = least(floor(j.j * n.l / 72.0::DOUBLE), n.l - 1))"""
SCALE = """scale AS (SELECT key, idx, CASE WHEN max(v) OVER w = min(v) OVER w THEN 0 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS v
  FROM {0} WINDOW w AS (PARTITION BY key))"""
VEC = "vec AS (SELECT vec_id AS key, label, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INT AS idx FROM embeddings)"
TOP = """top AS (SELECT key, idx FROM (SELECT key, idx, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM {0} WINDOW w AS (PARTITION BY key ORDER BY idx)) WHERE v > a AND v > b)"""
STEP = "step AS (SELECT x.key AS a, y.key AS b, x.idx, x.v AS va, y.v AS vb FROM vec x JOIN vec y ON y.key = x.key + 1 AND x.idx = y.idx)"
CORR = "cor AS (SELECT x.key AS a, y.key AS b, any_value(x.label) AS la, any_value(y.label) AS lb, corr(x.v, y.v) AS r FROM {0} x JOIN {0} y ON x.idx = y.idx AND x.key < y.key GROUP BY 1, 2)"
SCORED = """sc AS (SELECT a % 10 AS sample, a, b, round(CASE WHEN (a + b) % 3 = 0 THEN x ELSE sqrt(x) END, 5) AS score, (a + b) % 3 = 0 AS d
  FROM (SELECT l_suppkey AS a, l_partkey % (SELECT count(*) FROM supplier) AS b, avg(l_quantity) / 51 AS x FROM lineitem GROUP BY 1, 2))"""
PVAL = """, cnt AS (SELECT sample, score, count_if(NOT d)::DOUBLE AS nt, count_if(d)::DOUBLE AS nd FROM sc GROUP BY 1, 2),
 tot AS (SELECT sample, sum(nd) AS m0 FROM cnt GROUP BY 1 HAVING sum(nd) > 0),
 abv AS (SELECT *, coalesce(sum(nd) OVER (PARTITION BY sample ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM cnt),
 pv AS (SELECT sample, score, nt, greatest(above / m0, 1 / m0) AS pvalue FROM abv JOIN tot USING (sample) WHERE nt > 0)"""
QVAL = """, per AS (SELECT sample, pvalue, sum(nt) AS n FROM pv GROUP BY 1, 2),
 qv AS (SELECT *, sum(n) OVER (PARTITION BY sample ORDER BY pvalue) AS v, sum(n) OVER (PARTITION BY sample) AS m, max(pvalue) OVER (PARTITION BY sample) AS last FROM per),
 qr AS (SELECT *, m * pvalue / (v * (1 - pow(1 - pvalue, m))) AS raw, pvalue = last AND n = 1 AS single FROM qv),
 qq AS (SELECT sample, pvalue, n, CASE WHEN single THEN least(raw, 1) ELSE min(CASE WHEN NOT single THEN raw END) OVER (PARTITION BY sample ORDER BY pvalue ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS qvalue FROM qr),
 et AS (SELECT sample, score AS cutoff, nt AS n, pvalue, qvalue FROM pv JOIN (SELECT sample, pvalue, qvalue FROM qq) USING (sample, pvalue))"""
DIR = """items AS (SELECT src, dst{1}, count(*) AS n FROM (SELECT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) AS dst{1} FROM lineitem)
  WHERE src <> dst GROUP BY src, dst{1}), dir AS (SELECT src, dst{1}, n / (n + (SELECT avg(n) FROM items) / 3) AS weight FROM items), edg AS (SELECT lo AS src, hi AS dst{1}, weight FROM (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi{1}, max(weight) AS weight FROM dir GROUP BY least(src, dst), greatest(src, dst){1}))"""
EDGES = DIR.replace("{1}", "")
REPS = DIR.replace("{1}", ", l_returnflag")
CONDS = DIR.replace("{1}", ", l_linestatus")
SYM = "sym AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM {0} UNION ALL SELECT dst, src, weight FROM {0}) GROUP BY 1, 2)"
HEAVY = "heavy AS (SELECT * FROM edg WHERE weight >= {0})"
MAT = EDGES + ", m AS (SELECT src AS i, dst AS j, weight AS v FROM dir WHERE weight >= 0.75)"
NORM = "nrm AS (SELECT i, j, v / sum(abs(v)) OVER (PARTITION BY j) AS v FROM {0})"
EXPAND = "xp AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM nrm a JOIN nrm b ON a.j = b.i GROUP BY 1, 2)"
WD = (
    EDGES + ", " + HEAVY.format(0.75) + ", " + SYM.format("heavy") + """, x AS (SELECT src AS i, dst AS j, -log2(1 - weight) AS v FROM sym), n AS (SELECT count(*)::DOUBLE AS n FROM supplier),
 st AS (SELECT i, sum(v) AS s1, sum(v * v) AS s2, count(*) AS k, any_value(n.n) AS n FROM x, n GROUP BY 1),
 wd AS (SELECT x.i, x.j, x.v * (n / k) * greatest(1, sqrt((s2 - n * pow(s1 / n, 2) + pow(s1 / n, 2) * (n - k)) / (n - 1)) / (s1 / n)) AS wd FROM x JOIN st USING (i))"""
)
# Decoys for {0}: the first of eight tries of each draw; a ninth is as likely as a tenth to the eighth power.
DECOY = """num AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS at FROM (SELECT DISTINCT key FROM vec)), size AS (SELECT count(*) AS n FROM num),
 hash AS (SELECT draw, try, ('0x' || substr(md5('0:i:' || draw || ':' || try), 1, 15))::BIGINT % n AS i, ('0x' || substr(md5('0:j:' || draw || ':' || try), 1, 15))::BIGINT % n AS j
   FROM range(({0})::BIGINT) d(draw), range(8) t(try), size),
 dec AS (SELECT draw, arg_min((x.key, y.key), try) AS p FROM hash JOIN num x ON i = x.at JOIN num y ON j = y.at JOIN cor ON cor.a = least(x.key, y.key) AND cor.b = greatest(x.key, y.key)
   WHERE i <> j AND r <= 0.4 GROUP BY draw), decoy AS (SELECT draw, p[1] AS a, p[2] AS b FROM dec)"""
POSITIVE = "SELECT count(*) FROM cor WHERE r > 0.4 AND isfinite(r)"
NULLS = """draws AS (SELECT r, exp(sqrt(-2 * ln((('0x' || substr(h, 1, 15))::BIGINT + 0.5::DOUBLE) / 1152921504606846976::DOUBLE)) * cos(2 * pi() * ((('0x' || substr(h, 16, 15))::BIGINT + 0.5::DOUBLE) / 1152921504606846976::DOUBLE))) AS x
   FROM (SELECT r, md5('0:' || r || ':' || j) AS h FROM range(10001) a(r), range((SELECT count(*) FROM supplier)) b(j))),
 nulls AS (SELECT x * greatest(1, sqrt((sum(x * x) OVER w - count(*) OVER w * pow(avg(x) OVER w, 2)) / (count(*) OVER w - 1)) / avg(x) OVER w) AS v FROM draws WINDOW w AS (PARTITION BY r)),
 cut AS (SELECT quantile_cont(v, 0.9) AS cutoff FROM nulls)"""
R = "round({0}, 6) + 0.0 AS {1}"


def _r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


def _last_of_cubic() -> str:
    """(lam, h): what each share counts for in the last value of the cubic through the shares at 0.05, 0.1 .. 0.95."""
    grid = np.arange(1, 20) / 20
    v = np.vander(grid, 4)
    h = v[-1] @ np.linalg.pinv(v)
    return "(VALUES " + ", ".join(f"({g!r}::DOUBLE, {c!r}::DOUBLE)" for g, c in zip(grid.tolist(), h.tolist(), strict=True)) + ") l(lam, h)"


NATION = (
    EDGES + ", " + HEAVY.format(0.75) + ", inside AS (SELECT src, dst, weight FROM heavy JOIN supplier x ON src = x.s_suppkey JOIN supplier y ON dst = y.s_suppkey WHERE x.s_nationkey = y.s_nationkey), "
    + SYM.format("inside") + ", ent AS (SELECT src AS i, dst AS j, weight AS v FROM sym)"
)


def _rounds(powers: str, n: int) -> str:
    """The tables of ``n`` rounds of Markov clustering by each power, of which the last is r{n}."""
    steps = f"""ids AS (SELECT DISTINCT i FROM ent), lp AS (SELECT g, i, j, v FROM (SELECT i, j, v FROM ent UNION ALL SELECT i, i, 1.0 FROM ids) a, (SELECT unnest({powers})::DOUBLE AS g) b),
 r0 AS MATERIALIZED (SELECT g, i, j, v / sum(v) OVER (PARTITION BY g, j) AS v FROM lp)"""
    for k in range(n):
        steps += f""", e{k} AS MATERIALIZED (SELECT g, i, j, pow(v, g) AS v FROM (SELECT a.g, a.i, b.j, sum(a.v * b.v) AS v FROM r{k} a JOIN r{k} b ON a.g = b.g AND a.j = b.i GROUP BY 1, 2, 3)),
 r{k + 1} AS MATERIALIZED (SELECT g, i, j, v FROM (SELECT g, i, j, v / sum(v) OVER (PARTITION BY g, j) AS v, row_number() OVER (PARTITION BY g, j ORDER BY v DESC, i) AS n FROM e{k}) WHERE v >= 0.001 OR n = 1)"""
    return steps + f""", sets AS (SELECT DISTINCT g, list_sort(list(j)) AS members FROM r{n} WHERE v <> 0 AND (g, i) IN (SELECT (g, i) FROM r{n} WHERE i = j AND v <> 0) GROUP BY g, i)"""

SQL: dict[str, str] = {
    "scan_matrix": f"WITH {PROF} SELECT key, idx, {_r('nullif(v, 0)', 'v')} FROM prof",
    "scan_matrix_legacy": f"WITH {PROF} SELECT key, (row_number() OVER (PARTITION BY key ORDER BY idx) - 1)::INT AS idx, {_r('2 * v', 'v')} FROM prof WHERE v <> 0",
    "sample_labels": "SELECT o_orderpriority || '_' || year(o_orderdate) AS label, count(*) AS n FROM orders GROUP BY 1",
    "condition_last_id": "SELECT o_orderpriority AS cond, arg_max(o_custkey, o_orderkey)::VARCHAR AS short_id FROM orders GROUP BY 1",
    "contaminant_freq": f"WITH {PROF} SELECT key AS gene, round(count_if(v > 0) / count(*), 6) + 0.0 AS freq FROM prof GROUP BY 1",
    "members_split": "SELECT p_partkey, p_name AS a, p_type AS b FROM part",
    "joined_row": "SELECT p_partkey, p_name || '#' || p_brand || '#' || p_size AS row FROM part",
    "collect_members": "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS members FROM nation GROUP BY 1",
    "last_per_key": "SELECT o_custkey AS src, arg_max(o_orderpriority, o_orderkey) AS dst FROM orders GROUP BY 1",
    "missing_tokens": "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN p_size::DOUBLE END AS v FROM part",
    "null_counts": """SELECT 'price' AS "column", count_if(NOT o_totalprice > 100000)::BIGINT AS nulls FROM orders UNION ALL SELECT 'status', count_if(o_orderstatus = 'F')::BIGINT FROM orders
      UNION ALL SELECT 'o_custkey', count_if(o_custkey IS NULL)::BIGINT FROM orders""",
    "duplicate_keys": "SELECT year(o_orderdate)::INT AS repl, o_custkey::VARCHAR AS short_id, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    "explode_lists": """SELECT p_partkey, coalesce(a, '') AS a, coalesce(b, '') AS b, count(*) AS n FROM (SELECT p_partkey, unnest(list_zip(string_split(p_name, ' '), string_split(p_type, ' '))) AS z FROM part) t,
      LATERAL (SELECT z[1] AS a, z[2] AS b) GROUP BY 1, 2, 3""",
    "dense_ids": "SELECT c_name, row_number() OVER (ORDER BY c_name) AS id FROM (SELECT DISTINCT c_name FROM customer)",
    "min_support": f"WITH {PROF} SELECT key, count_if(v > 150)::INT AS positive FROM prof GROUP BY 1 HAVING count_if(v > 150) >= 2",
    "impute_gap": f"WITH {PROF}, {GAP.format('prof')} SELECT key, idx, {_r('v')} FROM gap",
    "truncate_profile": f"WITH {PROF} SELECT key, idx, {_r('v')} FROM prof WHERE idx < 60",
    "gaussian_smooth": f"""WITH {PROF}, k AS (SELECT i AS k, exp(-0.5::DOUBLE * i * i) / (SELECT sum(exp(-0.5::DOUBLE * i * i)) FROM range(-4, 5) t(i)) AS w FROM range(-4, 5) t(i))
      SELECT p.key, p.idx, round(sum(q.v * k.w), 6) + 0.0 AS v FROM prof p, k, prof q WHERE q.key = p.key
        AND q.idx = CASE WHEN p.idx + k.k < 0 THEN -1 - p.idx - k.k WHEN p.idx + k.k > 82 THEN 165 - p.idx - k.k ELSE p.idx + k.k END GROUP BY 1, 2""",
    "resample_profile": f"WITH {PROF}, {GRID.format('prof')} SELECT key, idx, {_r('v')} FROM grid",
    "minmax_scale": f"WITH {PROF}, {SCALE.format('prof')} SELECT key, idx, {_r('v')} FROM scale",
    "normalize_profiles": f"""WITH {PROF}, enough AS (SELECT * FROM prof WHERE key IN (SELECT key FROM prof GROUP BY 1 HAVING count_if(v > 0) >= 2)), {GAP.format('enough')}, {GRID.format('gap')}, {SCALE.format('grid')}
      SELECT key, idx, {_r('v')} FROM scale""",
    "fill_zero": f"WITH {PROF} SELECT key, idx, round(CASE WHEN v = max(v) OVER (PARTITION BY key) THEN 0 ELSE v END, 6) + 0.0 AS v FROM prof",
    "local_maxima": f"WITH {VEC}, {TOP.format('vec')} SELECT key, idx AS at FROM top",
    "argmax_by_group": f"WITH {VEC} SELECT key, arg_min(idx, (-v, idx))::INT AS at FROM vec GROUP BY 1",
    "mean_positive": f"WITH {VEC} SELECT key, round(CASE WHEN sum(v) > 0 THEN avg(v) ELSE 0 END, 6) + 0.0 AS mean FROM vec GROUP BY 1",
    "fwhm": f"WITH {PROF} SELECT k.key, (max(idx) - min(idx))::INT AS fwhm FROM (SELECT DISTINCT key FROM prof) k LEFT JOIN (SELECT key, idx, v > max(v) OVER (PARTITION BY key) / 2 AS over FROM prof) t ON k.key = t.key AND t.over GROUP BY 1",
    "median": f"SELECT l_suppkey, {_r('median(l_extendedprice)', 'median')} FROM lineitem GROUP BY 1",
    "percentile": f"SELECT l_suppkey, {_r('quantile_cont(l_extendedprice, 0.9)', 'p90')} FROM lineitem GROUP BY 1",
    "mean_sd": f"SELECT l_suppkey, {_r('avg(l_quantity)', 'mean')}, {_r('stddev_samp(l_quantity)', 'sd')} FROM lineitem GROUP BY 1",
    "renormalize": f"SELECT p_partkey, {_r('(p_size::DOUBLE - 1) / 49', 'v')} FROM part",
    "power_scale": f"SELECT p_partkey, {_r('pow(p_size::DOUBLE / 51, 2)', 'v')} FROM part",
    "overlap": """SELECT p_partkey, round(len(list_distinct(list_intersect(string_split(p_name, ''), string_split(p_type, ''))))::DOUBLE / greatest(len(string_split(p_name, '')), len(string_split(p_type, ''))), 6) + 0.0 AS share FROM part""",
    "combinations": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
    "confidence_label": f"WITH {EDGES} SELECT src, dst, CASE WHEN weight > 0.9 THEN 'High' WHEN weight > 0.75 THEN 'Medium' WHEN weight >= 0.5 THEN 'Low' ELSE 'No interaction' END AS confidence FROM dir",
    "strip_peak_suffix": "SELECT s_suppkey, regexp_replace(s_name || '_p_' || (s_suppkey % 20), '_p_.', '', 'g') AS name FROM supplier",
    "name_prefix": "SELECT s_suppkey, split_part(s_name || '_p_' || (s_suppkey % 20), '_', 1) AS prefix, (s_suppkey % 20)::VARCHAR AS suffix FROM supplier",
    "decoy_flag": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'DECOY' ELSE 'TARGET' END AS isdecoy FROM supplier",
    "pair_key": "SELECT n_nationkey, n_name || '#' || r_name AS mb, n_name || '_DECOY#' || r_name || '_DECOY' AS decoy_mb FROM nation JOIN region ON n_regionkey = r_regionkey",
    "corr_pairs": f"WITH {VEC}, {CORR.format('vec')} SELECT a, b, {_r('r')} FROM cor WHERE r > 0.4 AND isfinite(r)",
    "cosine_similarity": f"WITH {VEC}, {STEP} SELECT a, b, {_r('sum(va * vb) / (sqrt(sum(va * va)) * sqrt(sum(vb * vb)))', 'cosine')} FROM step GROUP BY 1, 2",
    "pearson_pair": f"WITH {VEC}, {STEP} SELECT a, b, {_r('corr(va, vb)', 'r')} FROM step GROUP BY 1, 2",
    "prior_semi": f"WITH {EDGES}, s AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0) SELECT src AS a, dst AS b FROM dir WHERE src IN (SELECT k FROM s) AND dst IN (SELECT k FROM s)",
    "attach_profiles": f"WITH {VEC}, {STEP} SELECT a, b, {_r('sum(va)', 'sum_a')}, {_r('sum(vb)', 'sum_b')} FROM step GROUP BY 1, 2",
    "pair_ids": f"""WITH {VEC}, {CORR.format('vec')}, {DECOY.format(POSITIVE)} SELECT 'ppi_' || row_number() OVER (ORDER BY a, b) AS id, a, b, a || '#' || b AS mb FROM cor WHERE r > 0.4 AND isfinite(r)
      UNION ALL SELECT 'DECOY_ppi_' || (row_number() OVER (ORDER BY a, b) + ({POSITIVE})), a, b, a || '_DECOY#' || b || '_DECOY' FROM decoy""",
    "pair_union": f"""WITH {VEC}, {CORR.format('vec')}, {DECOY.format(POSITIVE)} SELECT a, b, is_decoy, count(*) AS n FROM (SELECT a, b, false AS is_decoy FROM cor WHERE r > 0.4 AND isfinite(r) UNION ALL
      SELECT vec_id - 1, vec_id, false FROM embeddings WHERE vec_id - 1 IN (SELECT vec_id FROM embeddings) UNION ALL SELECT a, b, true FROM decoy) GROUP BY 1, 2, 3""",
    "decoy_sample": f"WITH {VEC}, {CORR.format('vec')}, {DECOY.format('SELECT count(*) FROM embeddings')} SELECT draw, a, b FROM decoy",
    "abs_diff": f"WITH {VEC}, {STEP} SELECT a, b, idx, {_r('abs(va - vb)', 'v')} FROM step",
    "peak_shift": f"""WITH {VEC}, {TOP.format('vec')}, pr AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)
      SELECT a, b, min(abs(p.idx - q.idx))::INT AS shft FROM pr LEFT JOIN top p ON p.key = a LEFT JOIN top q ON q.key = b GROUP BY 1, 2""",
    "common_peak": f"""WITH {VEC}, {TOP.format('vec')}, pr AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)
      SELECT a, b, max(CASE WHEN p.idx = q.idx THEN p.idx END)::INT AS peak FROM pr LEFT JOIN top p ON p.key = a LEFT JOIN top q ON q.key = b GROUP BY 1, 2""",
    "min_sd_column": f"WITH {VEC}, s AS (SELECT label, idx, round(stddev_samp(v), 9) AS sd FROM vec GROUP BY 1, 2) SELECT label, arg_min(idx, (sd, idx))::INT AS idx FROM s GROUP BY 1",
    "sliding_corr": f"""WITH {VEC}, {STEP}, w AS (SELECT x.a, x.b, x.idx, corr(y.va, y.vb) AS r FROM step x JOIN step y ON x.a = y.a AND x.b = y.b AND y.idx BETWEEN x.idx AND x.idx + 9 WHERE x.idx <= 54 GROUP BY 1, 2, 3)
      SELECT a, b, idx, round(r, 6) + 0.0 AS v FROM w WHERE isfinite(r)""",
    "assemble_features": f"""WITH {VEC}, {STEP}, {TOP.format('vec')}, w AS (SELECT x.a, x.b, x.idx, corr(y.va, y.vb) AS r FROM step x JOIN step y ON x.a = y.a AND x.b = y.b AND y.idx BETWEEN x.idx AND x.idx + 9 WHERE x.idx <= 54 GROUP BY 1, 2, 3),
      sh AS (SELECT a, b, min(abs(p.idx - q.idx)) AS s FROM (SELECT DISTINCT a, b FROM step) LEFT JOIN top p ON p.key = a LEFT JOIN top q ON q.key = b GROUP BY 1, 2),
      ok AS (SELECT sh.a, sh.b, s FROM sh LEFT JOIN w ON w.a = sh.a AND w.b = sh.b AND isfinite(r) GROUP BY 1, 2, 3 HAVING (64 - count(r) + (s IS NULL)::INT) / 129 <= 0.075)
      SELECT a, b, 0::INT AS idx, coalesce(s, 0)::DOUBLE AS v FROM ok
      UNION ALL SELECT t.a, t.b, (t.idx + 1)::INT, round(CASE WHEN isfinite(r) THEN r ELSE 0 END, 6) + 0.0 FROM step t SEMI JOIN ok ON ok.a = t.a AND ok.b = t.b LEFT JOIN w ON w.a = t.a AND w.b = t.b AND w.idx = t.idx
      UNION ALL SELECT a, b, (idx + 65)::INT, round(abs(va - vb), 6) + 0.0 FROM step SEMI JOIN ok USING (a, b)""",
    "mcc": """WITH c AS (SELECT sum(t * y)::DOUBLE AS tp, sum((1 - t) * (1 - y))::DOUBLE AS tn, sum((1 - t) * y)::DOUBLE AS fp, sum(t * (1 - y))::DOUBLE AS fn FROM (SELECT quality AS t, 1 - toxic AS y FROM labels))
      SELECT round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) + 0.0 AS mcc FROM c""",
    "empirical_pvalue": f"WITH {SCORED}{PVAL} SELECT sample, score, nt::BIGINT AS n, {_r('pvalue')} FROM pv",
    "pi0_lambda": f"""WITH {SCORED}{PVAL} SELECT sample, lam, round(sum(CASE WHEN pvalue >= lam THEN nt ELSE 0 END) / sum(nt) / (1 - lam), 6) + 0.0 AS pi0
      FROM pv, (SELECT unnest([0.0, 0.25, 0.5, 0.75])::DOUBLE AS lam) GROUP BY 1, 2""",
    "qvalue": f"WITH {SCORED}{PVAL}{QVAL} SELECT sample, {_r('pvalue')}, n::BIGINT AS n, {_r('qvalue')} FROM qq",
    "bandwidth": f"""WITH {SCORED}, b AS (SELECT sample, stddev_samp(score) AS sd, (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.34 AS iq, count(*) AS n, any_value(score) AS f FROM sc GROUP BY 1)
      SELECT sample, round(0.9::DOUBLE * coalesce(nullif(least(sd, iq), 0), nullif(sd, 0), nullif(abs(f), 0), 1) * pow(n, -0.2::DOUBLE), 6) + 0.0 AS bw FROM b""",
    "error_table": f"WITH {SCORED}{PVAL}{QVAL} SELECT sample, cutoff, n::BIGINT AS n, {_r('pvalue')}, {_r('qvalue')} FROM et",
    "fdr_cutoff": f"WITH {SCORED}{PVAL}{QVAL} SELECT sample, arg_min(cutoff, (round(abs(qvalue - 0.1::DOUBLE), 9), cutoff)) AS cutoff FROM et GROUP BY 1",
    "nearest_cutoff": f"""WITH {SCORED}{PVAL}{QVAL}, g AS (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS "at"), x AS (SELECT sample, "at", arg_min((cutoff, pvalue, qvalue), (round(abs(cutoff - "at"), 9), cutoff)) AS r FROM et, g GROUP BY 1, 2)
      SELECT sample, "at", r[1] AS cutoff, round(r[2], 6) + 0.0 AS pvalue, round(r[3], 6) + 0.0 AS qvalue FROM x""",
    "fdr_curve": f"""WITH {SCORED}{PVAL}, c AS (SELECT sample, score, sum(nt) OVER w / nullif(sum(nt) OVER (PARTITION BY sample), 0) AS t, sum(nd) OVER w / nullif(sum(nd) OVER (PARTITION BY sample), 0) AS d FROM cnt
        WINDOW w AS (PARTITION BY sample ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT sample, score, {_r('t', 'target')}, {_r('d', 'decoy')}, round(coalesce(least(d / nullif(t, 0), 1), 1), 6) + 0.0 AS fdr FROM c""",
    "fdr_filter": f"""WITH {SCORED.replace('sc AS (', 'raw AS (')}, sc AS (SELECT * FROM raw WHERE score >= 0.5){PVAL}{QVAL}, c AS (SELECT sample, arg_min(cutoff, (round(abs(qvalue - 0.3::DOUBLE), 9), cutoff)) AS cut FROM et GROUP BY 1)
      SELECT sample, a, b, score FROM sc JOIN c USING (sample) WHERE score > cut AND NOT d""",
    "prob_histogram": f"WITH {SCORED} SELECT CASE WHEN d THEN 'DECOY' ELSE 'TARGET' END AS isdecoy, least(floor(score * 20), 19)::INT AS bin, count(*) AS n FROM sc GROUP BY 1, 2",
    "canonical_edges": f"WITH {EDGES} SELECT src, dst, {_r('weight')} FROM edg",
    "symmetrize": f"WITH {EDGES}, {SYM.format('dir')} SELECT src, dst, {_r('weight')} FROM sym",
    "distinct_vertices": f"WITH {EDGES}, {HEAVY.format(0.8)} SELECT src AS id FROM heavy UNION SELECT dst FROM heavy",
    "vertex_union": f"WITH {REPS}, h AS (SELECT * FROM edg WHERE weight >= 0.7 AND l_returnflag IN ('A', 'R')) SELECT src AS id FROM h UNION SELECT dst FROM h",
    "replicate_outer": f"WITH {REPS} SELECT src, dst, " + ", ".join(f"round(max(weight) FILTER (WHERE l_returnflag = '{k}'), 6) + 0.0 AS weight_{i}" for i, k in enumerate("ANR")) + " FROM edg GROUP BY 1, 2",
    "outer_max": f"WITH {REPS} SELECT src, dst, {_r('max(weight)', 'weight')} FROM edg GROUP BY 1, 2",
    "combine_max": f"WITH {REPS} SELECT src, dst, {_r('max(weight)', 'weight')} FROM edg GROUP BY 1, 2",
    "combine_mean": f"WITH {REPS} SELECT src, dst, {_r('sum(weight) / 3', 'weight')} FROM edg GROUP BY 1, 2",
    "combine_product": f"WITH {REPS} SELECT src, dst, {_r('CASE WHEN count(*) < 3 THEN 0 ELSE product(weight) END', 'weight')} FROM edg GROUP BY 1, 2",
    "edge_frequency": f"WITH {REPS} SELECT src, dst, {_r('count_if(weight >= 0.5) / 3', 'freq')} FROM edg GROUP BY 1, 2",
    "desirability": f"""WITH {REPS}, x AS (SELECT src, dst, count_if(weight >= 0.7) / 3 AS f, max(weight) AS p FROM edg GROUP BY 1, 2)
      SELECT src, dst, round(CASE WHEN f > 0 AND p > 0 THEN exp((0.5::DOUBLE * ln(f) + ln(p)) / 1.5::DOUBLE) ELSE 0 END, 6) + 0.0 AS score FROM x""",
    "edge_list": f"WITH {EDGES} SELECT src AS prot_a, dst AS prot_b, {_r('weight', 'comb_prob')}, CASE WHEN weight > 0.9 THEN 'High' WHEN weight > 0.75 THEN 'Medium' ELSE 'Low' END AS confidence FROM edg WHERE weight >= 0.75",
    "neighbours": f"WITH {EDGES}, {HEAVY.format(0.8)}, {SYM.format('heavy')} SELECT src AS protein, string_agg(dst::VARCHAR, ', ' ORDER BY dst::VARCHAR) AS interactors, count(*) AS n FROM sym GROUP BY 1",
    "cross_condition_max": f"WITH {CONDS} SELECT src, dst, {_r('max(weight)', 'weight')} FROM edg GROUP BY 1, 2",
    "cross_condition_last": f"WITH {CONDS} SELECT src, dst, {_r('weight')} FROM edg WHERE l_linestatus = (SELECT max(l_linestatus) FROM edg)",
    "prune_vertices": f"WITH {EDGES}, {HEAVY.format(0.8)} SELECT src AS id FROM heavy UNION SELECT dst FROM heavy",
    "contaminant_anti": f"""WITH {PROF}, {EDGES}, bad AS (SELECT key FROM prof GROUP BY 1 HAVING count_if(v > 0) / count(*) >= 0.7)
      SELECT src, dst, {_r('weight')} FROM edg WHERE src NOT IN (SELECT key FROM bad) AND dst NOT IN (SELECT key FROM bad)""",
    "information_content": f"WITH {EDGES} SELECT src, dst, {_r('-log2(1 - weight)', 'ic')} FROM edg",
    "wd_score": f"WITH {WD} SELECT i, j, {_r('wd')} FROM wd",
    "quantile_normalize": f"WITH {WD} SELECT i, j, round(wd / (SELECT quantile_cont(wd, 0.9) FROM wd WHERE wd > 0), 6) + 0.0 AS wd FROM wd",
    "wd_cutoff": f"WITH {WD}, {NULLS} SELECT round(cutoff, 6) + 0.0 AS cutoff, count(*) AS n, count_if(wd < cutoff)::BIGINT AS under FROM wd, cut GROUP BY 1",
    "wd_filtered": f"WITH {WD}, {NULLS} SELECT i, j, round(CASE WHEN wd < cutoff THEN 0 ELSE wd END, 6) + 0.0 AS wd FROM wd, cut",
    "upper_triangle": f"WITH {WD} SELECT b.s_suppkey AS prot_a, a.s_suppkey AS prot_b, round(coalesce(wd, 0), 6) + 0.0 AS wd FROM supplier a JOIN supplier b ON a.s_suppkey <= b.s_suppkey LEFT JOIN wd ON wd.i = a.s_suppkey AND wd.j = b.s_suppkey",
    "mcl_normalize": f"WITH {MAT}, {NORM.format('m')} SELECT i, j, {_r('v')} FROM nrm",
    "mcl_inflate": f"WITH {MAT}, p AS (SELECT i, j, v * v AS v FROM m), {NORM.format('p')} SELECT i, j, {_r('v')} FROM nrm",
    "mcl_expand": f"WITH {MAT}, {NORM.format('m')}, {EXPAND} SELECT i, j, {_r('v')} FROM xp",
    "mcl_self_loops": f"WITH {MAT} SELECT i, j, {_r('v')} FROM m WHERE i <> j UNION ALL SELECT k, k, 1.0::DOUBLE FROM (SELECT i AS k FROM m UNION SELECT j FROM m)",
    "mcl_prune": f"WITH {MAT}, t AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY v DESC, i) AS rn FROM m) SELECT i, j, {_r('v')} FROM t WHERE v >= 0.8 OR rn = 1",
    "mcl_iterate": f"WITH {MAT}, {NORM.format('m')}, {EXPAND}, p AS (SELECT i, j, v * v AS v FROM xp) SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 6) + 0.0 AS v FROM p",
    "modularity": f"""WITH {EDGES}, {HEAVY.format(0.75)}, {SYM.format('heavy')}, t AS (SELECT sum(weight) AS t FROM sym),
      d AS (SELECT s_suppkey AS k, s_nationkey AS g, 2 * coalesce(sum(weight), 0) AS d FROM supplier LEFT JOIN sym ON src = s_suppkey GROUP BY 1, 2)
      SELECT round(coalesce(sum(coalesce(weight, 0) - a.d * b.d / t) / any_value(t), 0), 6) + 0.0 AS q FROM d a JOIN d b ON a.g = b.g AND a.k <> b.k LEFT JOIN sym ON src = a.k AND dst = b.k, t""",
    "profile_network": f"""WITH {PROF}, enough AS (SELECT * FROM prof WHERE key IN (SELECT key FROM prof GROUP BY 1 HAVING count_if(v > 0) >= 2)), {GAP.format('enough')}, {GRID.format('gap')}, {SCALE.format('grid')},
      cor AS (SELECT x.key AS a, y.key AS b, corr(x.v, y.v) AS r FROM scale x JOIN scale y ON x.idx = y.idx AND x.key < y.key GROUP BY 1, 2), e AS (SELECT a, b, (r + 1) / 2 AS w FROM cor WHERE isfinite(r) AND r > 0.2)
      SELECT a AS prot_a, b AS prot_b, round(w, 6) + 0.0 AS comb_prob, CASE WHEN w > 0.9 THEN 'High' WHEN w > 0.75 THEN 'Medium' ELSE 'Low' END AS confidence FROM e""",
    "condition_corr_pairs": f"WITH {VEC}, {CORR.format('vec')} SELECT (la % 3)::INT AS cond, a, b, {_r('r')} FROM cor WHERE la % 3 = lb % 3 AND r > 0.4 AND isfinite(r)",
    "condition_specificity": f"""WITH {DIR.replace('{1}', ', l_returnflag, l_linestatus')},
      comb AS (SELECT l_returnflag AS cond, src, dst, max(weight) AS weight FROM edg GROUP BY 1, 2, 3), kept AS (SELECT * FROM comb WHERE weight >= 0.75),
      n AS (SELECT cond, count(DISTINCT id) AS n FROM (SELECT cond, src AS id FROM kept UNION ALL SELECT cond, dst FROM kept) GROUP BY 1),
      x AS (SELECT cond, i, j, -log2(1 - sum(w)) AS v FROM (SELECT cond, src AS i, dst AS j, weight AS w FROM kept UNION ALL SELECT cond, dst, src, weight FROM kept) GROUP BY 1, 2, 3),
      st AS (SELECT cond, i, sum(v) AS s1, sum(v * v) AS s2, count(*) AS k, any_value(n)::DOUBLE AS n FROM x JOIN n USING (cond) GROUP BY 1, 2)
      SELECT cond, x.i, x.j, round(x.v * (n / k) * greatest(1, sqrt((s2 - n * pow(s1 / n, 2) + pow(s1 / n, 2) * (n - k)) / (n - 1)) / (s1 / n)), 6) + 0.0 AS wd FROM x JOIN st USING (cond, i)""",
    "connected_parts": f"""WITH RECURSIVE {NATION}, way(id, k) AS (SELECT DISTINCT i, i FROM ent UNION SELECT way.id, ent.j FROM way JOIN ent ON way.k = ent.i)
      SELECT id, min(k) AS component FROM way GROUP BY 1""",
    "mcl_grid": f"WITH {NATION}, {_rounds('[1.5, 2.0, 3.0]', 40)} SELECT g AS inflation, array_to_string(members, ';') AS members FROM sets",
    "mcl_clusters": f"""WITH {NATION}, {_rounds('[2.0]', 40)}, num AS (SELECT members, row_number() OVER (ORDER BY members) AS n FROM sets WHERE len(members) > 1)
      SELECT n::INT AS "ComplexID", 'cmplx_' || n AS "ComplexName", array_to_string(members, ';') AS "subunits(Gene name)" FROM num""",
    "pi0_smoother": f"""WITH {SCORED}{PVAL}, m AS (SELECT sample, sum(nt) AS m FROM pv GROUP BY 1),
      sh AS (SELECT pv.sample, lam, any_value(h) AS h, sum(CASE WHEN pvalue >= lam THEN nt ELSE 0 END) / any_value(m) / (1 - lam) AS s FROM pv JOIN m USING (sample), {_last_of_cubic()} GROUP BY 1, 2)
      SELECT sample, round(least(1, sum(h * s)), 6) + 0.0 AS pi0 FROM sh GROUP BY 1""",
    "aligned_peaks": f"""WITH {VEC}, {TOP.format('vec')}, ks AS (SELECT DISTINCT key FROM vec), pr AS (SELECT x.key AS a, y.key AS b FROM ks x JOIN ks y ON y.key = x.key + 1),
      s AS (SELECT a, b, arg_min((x.idx, y.idx), (abs(x.idx - y.idx), -x.idx, -y.idx)) AS p FROM pr JOIN top x ON x.key = a JOIN top y ON y.key = b GROUP BY 1, 2)
      SELECT a, b, p[1] AS peak_a, p[2] AS peak_b FROM pr LEFT JOIN s USING (a, b)""",
}
