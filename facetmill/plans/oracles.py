"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

import itertools
import math

QS = ", ".join(f"{i}/10.0" for i in range(1, 10))
SUBSETS = [(0,), (1,), (2,), (3,), *itertools.combinations(range(4), 2), *itertools.combinations(range(4), 3)]
F4 = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _key(m) -> str:
    return " || '-' || ".join(f"c{j}" for j in m)


RAW = "raw AS (SELECT " + ", ".join(f"{c} AS f{i}" for i, c in enumerate(F4)) + ", CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS y FROM lineitem)"
CODE = RAW + ", edge AS (SELECT " + ", ".join(f"list_sort(list_distinct(quantile_cont(f{i}, [{QS}]))) AS e{i}" for i in range(4)) + " FROM raw), code AS (SELECT y, " + ", ".join(f"len(list_filter(e{i}, lambda v: v <= f{i})) AS c{i}" for i in range(4)) + " FROM raw, edge)"
CNT = CODE + ", cnt AS (" + " UNION ALL ".join(f"SELECT {s} AS s, {len(m)} AS o, '{';'.join(map(str, m))}' AS members, {_key(m)} AS k, y, count(*) AS c FROM code GROUP BY {_key(m)}, y" for s, m in enumerate(SUBSETS)) + ")"
H = CNT + """, kx AS (SELECT s, o, members, k, sum(c) AS ck, sum(c * ln(c)) AS t, count(*) AS q FROM cnt GROUP BY s, o, members, k),
hh AS (SELECT s, o, members, sum(ck) AS n, ln(sum(ck)) - sum(ck * ln(ck)) / sum(ck) AS hx, ln(sum(ck)) - sum(t) / sum(ck) AS hxy, count(*) AS kx, sum(q) AS kxy FROM kx GROUP BY s, o, members),
hl AS (SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) AS hy FROM (SELECT count(*) AS c FROM code GROUP BY y)),
h AS (SELECT *, greatest(0, hx + hy - hxy) AS mi, CASE WHEN least(hx, hy) <= 1e-12 THEN 0 ELSE least(1, greatest(0, hx + hy - hxy) / least(hx, hy)) END AS nmi FROM hh, hl),
m AS (SELECT TRY_CAST(members AS INTEGER) AS f, hx AS hf, nmi AS rel FROM h WHERE o = 1),
mem AS (SELECT s, unnest(CAST(string_split(members, ';') AS INTEGER[])) AS f FROM h WHERE o > 1),
pr AS (SELECT CAST(split_part(members, ';', 1) AS INTEGER) AS a, CAST(split_part(members, ';', 2) AS INTEGER) AS b, hx AS hab, hxy AS haby FROM h WHERE o = 2),
pn AS (SELECT a, b, least(1, greatest(0, x.hf + z.hf - hab) / least(x.hf, z.hf)) AS v FROM pr JOIN m x ON x.f = a JOIN m z ON z.f = b),
red AS (SELECT f, sum(v) / 3 AS red FROM (SELECT a AS f, v FROM pn UNION ALL SELECT b, v FROM pn) GROUP BY f),
g AS (SELECT h.s, h.members, h.nmi, q.hs, q.hm, greatest(0, q.hs - h.hx) AS tc, CASE WHEN q.hs - q.hm > 1e-12 THEN least(1, greatest(0, q.hs - h.hx) / (q.hs - q.hm)) ELSE 0 END AS r FROM h JOIN (SELECT s, sum(hf) AS hs, max(hf) AS hm FROM mem JOIN m USING (f) GROUP BY s) q ON q.s = h.s),
va AS (SELECT f, rel, red, 1 / (1 + exp(-(5 * rel - 2.5))) AS a, 1 / (1 + exp(-(5 * red - 2.5))) AS b FROM m JOIN red USING (f)),
v AS (SELECT f, rel, red, a / (1 + a + b) AS mu, b / (1 + a + b) AS nu, 1 / (1 + a + b) AS pi FROM va),
ga AS (SELECT *, 1 / (1 + exp(-(5 * nmi - 2.5))) AS a, 1 / (1 + exp(-(5 * r - 2.5))) AS b FROM g),
gd AS (SELECT s, members, a / (1 + a + b) AS mu, b / (1 + a + b) AS nu, 1 / (1 + a + b) AS pi FROM ga),
gw AS (SELECT *, greatest(0, mu - 0.5 * nu) * (1 - pi) AS w FROM gd),
st AS (SELECT s, min(mu) AS smu, max(nu) AS snu FROM mem JOIN v USING (f) GROUP BY s),
sets AS (SELECT mask, (SELECT coalesce(sum(mu), 0) FROM v WHERE (mask >> f) & 1 = 1) + (SELECT coalesce(sum(w), 0) FROM gw WHERE w > 0 AND s IN (SELECT s FROM mem WHERE (mask >> f) & 1 = 1)) AS val FROM range(16) t(mask))"""
EMB = "ev AS (SELECT vec_id AS id, dense_rank() OVER (ORDER BY label) - 1 AS y, unnest(range(64)) AS f, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"
ENMI = EMB + f""", ee AS (SELECT f, list_sort(list_distinct(quantile_cont(x, [{QS}]))) AS e FROM ev GROUP BY f),
ec AS (SELECT f, y, len(list_filter(e, lambda v: v <= x)) AS c FROM ev JOIN ee USING (f)),
e1 AS (SELECT f, c, y, count(*) AS n FROM ec GROUP BY ALL),
e2 AS (SELECT f, c, sum(n) AS n FROM e1 GROUP BY ALL),
ex AS (SELECT f, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hx FROM e2 GROUP BY f),
exy AS (SELECT f, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hxy FROM e1 GROUP BY f),
ey AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hy FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)),
en AS (SELECT f, CASE WHEN least(hx, hy) <= 1e-12 THEN 0 ELSE least(1, greatest(0, hx + hy - hxy) / least(hx, hy)) END AS nmi FROM ex JOIN exy USING (f), ey)"""
SC = "sc AS (SELECT c_mktsegment AS dataset, CAST(year(o_orderdate) AS INTEGER) AS run, o_orderpriority AS method, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS score FROM orders JOIN customer ON o_custkey = c_custkey)"
ME = SC + ", me AS (SELECT dataset, method, round(avg(score), 9) AS score FROM sc GROUP BY ALL), pa AS (SELECT m.dataset, m.method, r.score AS a, m.score AS b, r.score - m.score AS diff FROM me m JOIN me r ON r.dataset = m.dataset AND r.method = '1-URGENT' WHERE m.method <> '1-URGENT')"
RK = ME + ", rk AS (SELECT dataset, method, score, rank() OVER (PARTITION BY dataset ORDER BY -score) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS r FROM me)"
SEL = "rv AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS run, c_nationkey AS n, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), sl AS (SELECT run, n FROM rv QUALIFY row_number() OVER (PARTITION BY run ORDER BY v DESC, n) <= 10), se AS (SELECT run, list_sort(list(n)) AS s FROM sl GROUP BY run), sp AS (SELECT a.run AS run_a, b.run AS run_b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS k, len(b.s) AS l FROM se a JOIN se b ON a.run < b.run)"
JK = SEL + ", jk AS (SELECT run_a, run_b, i * 1.0 / (k + l - i) AS j, (i - k * l / 25.0) / (least(k, l) - k * l / 25.0) AS ku FROM sp)"
REP = SC + ", rp AS (SELECT dataset, method, avg(score) AS accuracy, count(*) AS n_selected, 100000 AS d, 1 - count(*) / 100000.0 AS feature_reduction FROM sc GROUP BY ALL)"
SPLIT = "vs AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y FROM embeddings), sp AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || row_id)) <= round(0.25 * count(*) OVER (PARTITION BY y)) AS is_test FROM vs)"

#: Poisson counts of mean 1 from 16 bits of a digest of seed, row and block of eight replicates; NMI of each replicate.
STEPS = [math.floor(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
BOOT = ENMI + f""", bd AS (SELECT vec_id AS id, md5('42|' || vec_id || '|0') || md5('42|' || vec_id || '|1') || md5('42|' || vec_id || '|2') AS h FROM embeddings),
bw AS (SELECT id, b, len(list_filter({STEPS}, lambda s: s <= CAST('0x' || substr(h, 4 * b + 1, 4) AS INTEGER))) AS w FROM bd, (SELECT unnest(range(20)) AS b)),
bc AS (SELECT b, f, y, c, sum(w) AS n FROM (SELECT ev.id, ev.f, ev.y, len(list_filter(e, lambda v: v <= x)) AS c FROM ev JOIN ee USING (f)) q JOIN bw USING (id) WHERE w > 0 GROUP BY ALL),
bx AS (SELECT b, f, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hx FROM (SELECT b, f, c, sum(n) AS n FROM bc GROUP BY ALL) GROUP BY b, f),
bxy AS (SELECT b, f, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hxy FROM bc GROUP BY b, f),
byy AS (SELECT b, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hy FROM (SELECT b, y, sum(n) AS n FROM bc WHERE f = 0 GROUP BY ALL) GROUP BY b),
bn AS (SELECT b, f, CASE WHEN least(hx, hy) <= 1e-12 THEN 0 ELSE least(1, greatest(0, hx + hy - hxy) / least(hx, hy)) END AS nmi FROM bx JOIN bxy USING (b, f) JOIN byy USING (b)),
br AS (SELECT b, f, row_number() OVER (PARTITION BY b ORDER BY round(nmi, 9) DESC, f) AS r FROM bn)"""
BSEL = BOOT + ", bs AS (SELECT b, list(f) AS s FROM br WHERE r <= 32 GROUP BY b), bp AS (SELECT len(list_intersect(p.s, q.s)) AS i FROM bs p JOIN bs q ON p.b < q.b), bj AS (SELECT i / (64.0 - i) AS j, (i - 16.0) / 16.0 AS k FROM bp), bf AS (SELECT count(*) / 20.0 AS p FROM br WHERE r <= 32 GROUP BY f)"
#: F statistic of every feature, average ranks, and p by the finite series of Student's distribution with 62 degrees of freedom.
ASSOC = ENMI + """, fc AS (SELECT f, y, count(*) AS n, avg(x) AS m FROM ev GROUP BY f, y), fg AS (SELECT f, avg(x) AS g FROM ev GROUP BY f),
fw AS (SELECT ev.f, sum((x - m) * (x - m)) AS w, count(*) AS n FROM ev JOIN fc ON fc.f = ev.f AND fc.y = ev.y GROUP BY ev.f), fb AS (SELECT f, sum(n * (m - g) * (m - g)) AS b, count(*) AS c FROM fc JOIN fg USING (f) GROUP BY f),
fp AS (SELECT f, round(nmi, 9) AS a, round((b / (c - 1)) / (w / (n - c)), 6) AS v FROM fw JOIN fb USING (f) JOIN en USING (f)),
fr AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS v FROM fp),
ft AS (SELECT corr(a, v) AS rho, count(*) AS n FROM fr), fs AS (SELECT j, exp(sum(ln((2.0 * j - 1) / (2.0 * j))) OVER (ORDER BY j)) AS k FROM (SELECT unnest(range(1, 31)) AS j))"""

#: Distance to the fifth nearest of the own class, counts within it, and harmonic numbers for the digamma function.
KNN = EMB + """, kd AS (SELECT p.f, p.id, list_sort(list(abs(p.x - q.x)))[5] AS d FROM ev p JOIN ev q ON q.f = p.f AND q.y = p.y AND q.id <> p.id GROUP BY p.f, p.id),
km AS (SELECT p.f, p.id, count(*) AS m FROM ev p JOIN kd ON kd.f = p.f AND kd.id = p.id JOIN ev q ON q.f = p.f AND q.id <> p.id AND abs(p.x - q.x) <= kd.d GROUP BY p.f, p.id),
hn AS (SELECT i + 1 AS m, sum(1.0::DOUBLE / i) OVER (ORDER BY i) AS h FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM embeddings))) AS i) UNION ALL SELECT 1, 0.0),
kc AS (SELECT sum(n * h) / sum(n) AS own, sum(n) AS n FROM (SELECT count(*) AS n FROM embeddings GROUP BY label) JOIN hn ON hn.m = n)"""


def _w(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def _h(body: str) -> str:
    return _w(H, body)


def _strong(status: str, k: int) -> str:
    """The audit of groups of at most k features over the line items of one status."""
    gaps = [f"round({f}({v}), 6) AS {n}_{c}" for n, f in (("mean", "avg"), ("max", "max")) for c, v in (("abs_mu", "abs(mu - smu)"), ("abs_nu", "abs(nu - snu)"))]
    gaps += [f"round(avg({v}), 6) AS mean_{c}" for c, v in (("rel_mu", "abs(mu - smu) / (abs(smu) + 1e-12)"), ("rel_nu", "abs(nu - snu) / (abs(snu) + 1e-12)"))]
    near = [f"round(100.0 * count(*) FILTER ({v}) / count(*), 6) AS pct_{n}" for n, v in (("mu", "abs(mu - smu) <= 1e-9"), ("nu", "abs(nu - snu) <= 1e-9"), ("both", "abs(mu - smu) <= 1e-9 AND abs(nu - snu) <= 1e-9"))]
    return "SELECT * FROM (" + _h(f"SELECT '{status}' AS dataset, {k} AS largest, count(*) AS n_groups, {', '.join([*near, *gaps])} FROM gd JOIN st USING (s) WHERE len(string_split(members, ';')) <= {k}").replace("FROM lineitem)", f"FROM lineitem WHERE l_linestatus = '{status}')") + ")"


#: Greedy over all subsets of four features: each step takes the best gain, ties by id.
GREEDY = H + ", p0 AS (SELECT 0 AS step, 0 AS mask, -1 AS f, CAST(0 AS DOUBLE) AS val, CAST(0 AS DOUBLE) AS gain)" + "".join(
    f", p{i} AS (SELECT {i} AS step, p.mask | (1 << t.f) AS mask, t.f, x.val, x.val - p.val AS gain FROM p{i - 1} p, (SELECT unnest(range(4)) AS f) t, sets x WHERE (p.mask >> t.f) & 1 = 0 AND x.mask = p.mask | (1 << t.f) ORDER BY round(x.val - p.val, 12) DESC, t.f LIMIT 1)" for i in range(1, 5)
) + ", path AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)"

#: Mean |correlation| of codes of all 64 embedding columns.
CORR = f"ev AS (SELECT vec_id AS id, unnest(range(64)) AS f, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), ee AS (SELECT f, list_sort(list_distinct(quantile_cont(x, [{QS}]))) AS e FROM ev GROUP BY f), ec AS (SELECT id, f, len(list_filter(e, lambda v: v <= x)) AS c FROM ev JOIN ee USING (f)), cc AS (SELECT a.f AS a, b.f AS b, coalesce(abs(corr(a.c, b.c)), 0) AS v FROM ec a JOIN ec b ON a.id = b.id AND a.f <> b.f GROUP BY ALL)"

#: Greedy chains of three selectors on four features: relevance less mean redundancy, least conditional and least joint information.
RANKED = H + """, rl AS (SELECT m.f, h.hx + h.hy - h.hxy AS rel FROM m JOIN h ON h.o = 1 AND CAST(h.members AS INTEGER) = m.f),
one AS (SELECT CAST(members AS INTEGER) AS f, hx, hxy, hy FROM h WHERE o = 1),
ps AS (SELECT p.j, p.c, x.hx + z.hx - p.hab AS red, p.hab + z.hxy - p.haby - z.hx AS giv, p.hab + z.hy - p.haby AS jnt FROM (SELECT a AS j, b AS c, hab, haby FROM pr UNION ALL SELECT b, a, hab, haby FROM pr) p JOIN one x ON x.f = p.j JOIN one z ON z.f = p.c),
k0 AS (SELECT 0 AS step, method, 0 AS mask, -1 AS f FROM (VALUES ('mrmr'), ('cmim'), ('jmi_least')) t(method))""" + "".join(f""",
k{i} AS (SELECT {i} AS step, method, mask | (1 << f) AS mask, f FROM (SELECT k.method, k.mask, rl.f, CASE WHEN k.mask = 0 THEN any_value(rl.rel) WHEN k.method = 'mrmr' THEN any_value(rl.rel) - avg(red) WHEN k.method = 'cmim' THEN least(any_value(rl.rel), min(giv)) ELSE min(jnt) END AS score
  FROM k{i - 1} k JOIN rl ON (k.mask >> rl.f) & 1 = 0 LEFT JOIN ps ON ps.j = rl.f AND (k.mask >> ps.c) & 1 = 1 GROUP BY k.method, k.mask, rl.f) QUALIFY row_number() OVER (PARTITION BY method ORDER BY round(score, 12) DESC, f) = 1)""" for i in range(1, 5))  # fmt: skip

#: Nearest hits and misses by the sum of scaled gaps, ten of each class.
RELIEF = """rw AS (SELECT vec_id AS id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
en AS (SELECT f, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(range(64)) AS f, unnest(x) AS v FROM rw) GROUP BY f), el AS (SELECT list(lo ORDER BY f) AS lo, list(hi ORDER BY f) AS hi FROM en),
un AS (SELECT id, y, list_transform(range(1, 65), lambda i: (x[i] - lo[i]) / CASE WHEN hi[i] > lo[i] THEN hi[i] - lo[i] ELSE 1 END) AS x FROM rw, el),
cl AS (SELECT y, count(*) * 1.0 / (SELECT count(*) FROM rw) AS p FROM rw GROUP BY y),
gp AS (SELECT a.id, a.y, b.id AS n_id, b.y AS n_y, list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])) AS g FROM un a JOIN un b ON a.id <> b.id),
nb AS (SELECT * FROM gp QUALIFY row_number() OVER (PARTITION BY id, n_y ORDER BY round(list_sum(g), 9), n_id) <= (SELECT least(10, greatest(2, count(*) // 10)) FROM rw)),
wt AS (SELECT nb.*, CASE WHEN n_y = nb.y THEN -1.0 ELSE q.p / (1 - c.p) END / count(*) OVER (PARTITION BY id, n_y) / (SELECT count(*) FROM rw) AS w FROM nb JOIN cl c ON c.y = nb.y JOIN cl q ON q.y = nb.n_y),
sc AS (SELECT unnest(range(64)) AS f, unnest(g) * w AS v FROM wt)"""

#: Exact two-sided signed-rank tests of five pairs, by counting the sign patterns.
TESTS = ME + """, ab AS (SELECT method, diff, round(abs(diff), 9) AS m FROM pa), ra AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY m) AS r FROM ab WHERE m > 0),
su AS (SELECT method, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS rp, sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS rm FROM ra GROUP BY method),
pv AS (SELECT su.*, least(1.0, 2.0 * (SELECT count(*) FROM range(1 << su.n) t(k) WHERE (SELECT coalesce(sum(i + 1), 0) FROM range(su.n) u(i) WHERE (k >> i) & 1 = 1) <= least(rp, rm)) / (1 << su.n)) AS p FROM su),
ho AS (SELECT method, max((c - rn + 1) * p) OVER (ORDER BY p, method ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM (SELECT *, row_number() OVER (ORDER BY p, method) AS rn, count(*) OVER () AS c FROM pv)),
ds AS (SELECT method, count(*) AS n_pairs, string_agg(dataset, ';' ORDER BY dataset) AS paired_datasets, avg(diff) AS d, quantile_cont(diff, 0.5) AS md FROM pa GROUP BY method)"""

#: NMI with five bins.
FIVE = RAW + ", edge AS (SELECT " + ", ".join(f"list_sort(list_distinct(quantile_cont(f{i}, [0.2, 0.4, 0.6, 0.8]))) AS e{i}" for i in range(4)) + " FROM raw), code AS (" + " UNION ALL ".join(f"SELECT {i} AS f, y, len(list_filter(e{i}, lambda v: v <= f{i})) AS c FROM raw, edge" for i in range(4)) + "), c1 AS (SELECT f, c, y, count(*) AS n FROM code GROUP BY ALL), c2 AS (SELECT f, c, sum(n) AS n FROM c1 GROUP BY ALL), hx AS (SELECT f, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hx FROM c2 GROUP BY f), hz AS (SELECT f, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hxy FROM c1 GROUP BY f), hy AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hy FROM (SELECT count(*) AS n FROM raw GROUP BY y))"

EV = "ev AS (SELECT event_type AS scenario, CAST(ts AS DATE) AS seed, value FROM events)"

SQL: dict[str, str] = {
    "q01_label_prep": "WITH d AS (SELECT lang || '|' || source AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 2) SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y, n FROM d",
    "q02_split": _w(SPLIT, "SELECT row_id, y, is_test FROM sp"),
    "q03_run_seed": "SELECT p_partkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split('42|' || p_name || '|0', ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 131 + c) % 2147483647) AS seed FROM part",
    "q04_quantile_edges": _w(CODE, "SELECT feature_id, CAST(i - 1 AS INTEGER) AS i, round(e[i], 6) AS edge FROM (" + " UNION ALL ".join(f"SELECT {j} AS feature_id, e{j} AS e FROM edge" for j in range(4)) + ") t, range(1, 10) r(i) WHERE i <= len(e)"),
    "q05_quantile_codes": _w(CODE, " UNION ALL ".join(f"SELECT {j} AS feature_id, CAST(c{j} AS INTEGER) AS code, y, count(*) AS n FROM code GROUP BY ALL" for j in range(4))),
    "q06_uniform_codes": _w(RAW, " UNION ALL ".join(f"SELECT {j} AS feature_id, CAST(len(list_filter(list_distinct([lo + q * (hi - lo) FOR q IN [{', '.join(f'{i}/8.0::DOUBLE' for i in range(1, 8))}]]), lambda v: v <= f{j})) AS INTEGER) AS code, count(*) AS n FROM raw, (SELECT min(f{j}) AS lo, max(f{j}) AS hi FROM raw) GROUP BY ALL" for j in range(4))),
    "q07_entropy": _h("SELECT members, round(hx, 6) AS h, round(hxy, 6) AS h_label FROM h"),
    "q08_entropy_miller_madow": _h("SELECT members, round(hx + (kx - 1) / (2.0 * n), 6) AS h, round(hxy + (kxy - 1) / (2.0 * n), 6) AS h_label FROM h"),
    "q09_mutual_information": _h("SELECT CAST(members AS INTEGER) AS feature_id, round(mi, 6) AS mi FROM h WHERE o = 1"),
    "q10_nmi": _w(ENMI, "SELECT CAST(f AS INTEGER) AS feature_id, round(nmi, 6) AS nmi FROM en"),
    "q11_pairwise_nmi": _h("SELECT f AS feature_id, round(red, 6) AS redundancy FROM red"),
    "q12_mean_correlation": _w(CORR, "SELECT CAST(a AS INTEGER) AS feature_id, round(sum(v) / 64, 6) AS redundancy FROM cc GROUP BY a"),
    "q13_group_nmi": _h("SELECT members, round(nmi, 6) AS nmi FROM g"),
    "q14_total_correlation": _h("SELECT members, round(tc, 6) AS tc FROM g"),
    "q15_group_redundancy": _h("SELECT members, round(hs, 6) AS h_sum, round(hm, 6) AS h_max, round(hs - hm, 6) AS room, round(r, 6) AS redundancy FROM g"),
    "q16_legacy_redundancy": _h("SELECT members, round(least(1, greatest(0, tc / (hs + 1e-12))), 6) AS legacy FROM g"),
    "q17_screen_mi": _w(ENMI, "SELECT CAST(f AS INTEGER) AS feature_id, row_number() OVER (ORDER BY round(nmi, 9) DESC, f) AS rank FROM en QUALIFY rank <= 20"),
    "q18_screen_anova": _w(EMB, ", cl AS (SELECT f, y, count(*) AS n, avg(x) AS m, sum(x) AS s, sum(x * x) AS q FROM ev GROUP BY ALL), fs AS (SELECT f, ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS sc FROM cl GROUP BY f) SELECT CAST(f AS INTEGER) AS feature_id, row_number() OVER (ORDER BY round(sc, 6) DESC, f) AS rank, round(sc, 4) AS score FROM fs QUALIFY rank <= 20"),
    "q19_vertex_degrees": _h("SELECT f AS feature_id, round(rel, 6) AS relevance, round(red, 6) AS redundancy, round(mu, 6) AS mu, round(nu, 6) AS nu, round(pi, 6) AS pi FROM v"),
    "q20_exhaustive_groups": "WITH i AS (SELECT CAST(unnest(range((SELECT count(DISTINCT o_orderpriority) FROM orders) + (SELECT count(DISTINCT c_mktsegment) FROM customer))) AS INTEGER) AS i) SELECT 2 AS \"order\", a.i || ';' || b.i AS members FROM i a, i b WHERE a.i < b.i UNION ALL SELECT 3, a.i || ';' || b.i || ';' || c.i FROM i a, i b, i c WHERE a.i < b.i AND b.i < c.i",
    "q21_group_degrees": _h("SELECT members, round(mu, 6) AS mu, round(nu, 6) AS nu, round(pi, 6) AS pi FROM gd"),
    "q22_strong_degrees": _h("SELECT members, round(smu, 6) AS mu, round(CASE WHEN smu + snu > 1 THEN greatest(0, 1 - smu) ELSE snu END, 6) AS nu, round(1 - smu - CASE WHEN smu + snu > 1 THEN greatest(0, 1 - smu) ELSE snu END, 6) AS pi FROM st JOIN g USING (s)"),
    "q23_strong_audit": _h("SELECT members, round(abs(mu - smu), 6) AS abs_mu, round(abs(nu - snu), 6) AS abs_nu, round(abs(mu - smu) / (abs(smu) + 1e-12), 6) AS rel_mu, round(abs(nu - snu) / (abs(snu) + 1e-12), 6) AS rel_nu, abs(mu - smu) <= 1e-9 AS ok_mu, abs(nu - snu) <= 1e-9 AS ok_nu, abs(mu - smu) <= 1e-9 AND abs(nu - snu) <= 1e-9 AS ok FROM gd JOIN st USING (s)"),
    "q24_audit_summary": _h("SELECT count(*) AS n_groups, round(100.0 * count(*) FILTER (abs(mu - smu) <= 1e-9) / count(*), 6) AS pct_mu, round(100.0 * count(*) FILTER (abs(nu - snu) <= 1e-9) / count(*), 6) AS pct_nu, round(100.0 * count(*) FILTER (abs(mu - smu) <= 1e-9 AND abs(nu - snu) <= 1e-9) / count(*), 6) AS pct_both, round(avg(abs(mu - smu)), 6) AS mean_abs_mu, round(avg(abs(nu - snu)), 6) AS mean_abs_nu, round(max(abs(mu - smu)), 6) AS max_abs_mu, round(max(abs(nu - snu)), 6) AS max_abs_nu, round(avg(abs(mu - smu) / (abs(smu) + 1e-12)), 6) AS mean_rel_mu, round(avg(abs(nu - snu) / (abs(snu) + 1e-12)), 6) AS mean_rel_nu FROM gd JOIN st USING (s)"),
    "q25_group_weights": _h("SELECT members, round(w, 6) AS w FROM gw"),
    "q26_objective_values": _h(", hit AS (SELECT s, count(*) FILTER (f IN (0, 2)) AS k, count(*) AS n FROM mem GROUP BY s), own AS (SELECT sum(mu) AS m FROM v WHERE f IN (0, 2)) SELECT 'binary' AS coverage, round(m + (SELECT sum(w * (k >= 1)::INT) FROM gw JOIN hit USING (s)), 6) AS value FROM own UNION ALL SELECT 'soft', round(m + (SELECT sum(w * (1 - pow(0.5, k))) FROM gw JOIN hit USING (s)), 6) FROM own UNION ALL SELECT 'fraction', round(m + (SELECT sum(w * least(1.0, k * 1.0 / n)) FROM gw JOIN hit USING (s)), 6) FROM own"),
    "q27_marginal_gains": _h(", hit AS (SELECT s, count(*) FILTER (f = 0) AS k FROM mem GROUP BY s) SELECT v.f AS feature_id, round(any_value(v.mu) + sum(w * (pow(0.5, k) - pow(0.5, k + 1))), 6) AS gain FROM v JOIN mem ON mem.f = v.f JOIN gw USING (s) JOIN hit USING (s) WHERE v.f <> 0 GROUP BY v.f"),
    "q28_greedy_path": _w(GREEDY, "SELECT step, CAST(f AS INTEGER) AS feature_id, round(gain, 6) AS gain, round(val, 6) AS value FROM path"),
    "q29_efficiency_prefix": _w(GREEDY, "SELECT step AS size, round(val / step, 6) AS efficiency FROM path WHERE step >= 2 ORDER BY val / step DESC, step LIMIT 1"),
    "q30_best_subset": _h("SELECT a || ';' || b AS members, round(val, 6) AS value FROM (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, val FROM range(4) x(a), range(4) z(b), sets WHERE a < b AND mask = (1 << a) | (1 << b)) ORDER BY val DESC, members LIMIT 1"),
    "q31_jaccard": _w(JK, "SELECT run_a, run_b, round(j, 6) AS jaccard FROM jk"),
    "q32_kuncheva": _w(JK, "SELECT run_a, run_b, round(ku, 6) AS kuncheva FROM jk"),
    "q33_stability_summary": _w(JK, ", fr AS (SELECT n, count(*) * 1.0 / (SELECT count(*) FROM se) AS p FROM sl GROUP BY n), no AS (SELECT 1 - (sum(p * (1 - p)) / 25) / ((sum(p) / 25) * (1 - sum(p) / 25)) AS v FROM fr) SELECT count(*) AS n_pairs, round(avg(j), 6) AS jaccard_mean, round(coalesce(stddev_samp(j), 0), 6) AS jaccard_std, round(avg(ku), 6) AS kuncheva_mean, round(coalesce(stddev_samp(ku), 0), 6) AS kuncheva_std, round(any_value(v), 6) AS nogueira FROM jk, no"),
    "q34_consensus": _w(SEL, "SELECT row_number() OVER (ORDER BY count(*) DESC, n) AS rank, n AS feature_id, round(count(*) * 1.0 / (SELECT count(*) FROM se), 6) AS frequency FROM sl GROUP BY n QUALIFY rank <= 10"),
    "q35_summary": _w(SC, "SELECT dataset, method, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_std, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max FROM sc GROUP BY ALL"),
    "q36_pareto": "WITH p AS (SELECT c_mktsegment AS dataset, o_custkey, count(*) AS n_selected, round(avg(o_totalprice), 2) AS accuracy FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.dataset = p.dataset AND q.n_selected <= p.n_selected AND q.accuracy >= p.accuracy AND (q.n_selected < p.n_selected OR q.accuracy > p.accuracy))",
    "q37_paired": _w(ME, "SELECT method, count(*) AS n_pairs, string_agg(dataset, ';' ORDER BY dataset) AS paired_datasets, round(avg(a), 6) AS reference_mean, round(avg(b), 6) AS method_mean, round(avg(diff), 6) AS mean_difference, round(quantile_cont(diff, 0.5), 6) AS median_difference FROM pa GROUP BY method"),
    "q38_signed_ranks": _w(ME, ", ab AS (SELECT method, diff, round(abs(diff), 9) AS m FROM pa), ra AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY m) + (count(*) OVER (PARTITION BY method, m) - 1) / 2.0 AS r FROM ab WHERE m > 0), su AS (SELECT method, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS rp, sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS rm FROM ra GROUP BY method) SELECT method, n, round(rp, 6) AS r_plus, round(rm, 6) AS r_minus, round(least(rp, rm), 6) AS statistic, round((rp - rm) / (rp + rm), 6) AS rank_biserial FROM su"),
    "q39_friedman": _w(RK, ", s AS (SELECT method, sum(r) AS s, count(*) AS n FROM rk GROUP BY method), t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM rk GROUP BY dataset, score)) SELECT round((12.0 / (max(n) * count(*) * (count(*) + 1)) * sum(s * s) - 3 * max(n) * (count(*) + 1)) / (1 - any_value(ties) * 1.0 / (max(n) * count(*) * (count(*) * count(*) - 1))), 6) AS chi2, count(*) - 1 AS df, max(n) AS n_datasets, count(*) AS n_methods FROM s, t"),
    "q40_average_ranks": _w(RK, "SELECT method, round(avg(r), 6) AS average_rank, count(*) AS n_datasets FROM rk GROUP BY method"),
    "q41_holm": "WITH p AS (SELECT n_name AS method, round(pow(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE WHEN o_orderkey IS NOT NULL THEN 0.0 END), 3), 9) AS p FROM nation LEFT JOIN (customer JOIN orders ON o_custkey = c_custkey) ON c_nationkey = n_nationkey GROUP BY n_name), k AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, method) + 1) * p AS a FROM p WHERE p IS NOT NULL) SELECT method, p, round(least(1.0::DOUBLE, max(a) OVER (ORDER BY p, method ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM k UNION ALL SELECT method, NULL, NULL FROM p WHERE p IS NULL",
    "q42_recovery": _w(SEL, ", x AS (SELECT run, len(list_intersect(s, [0, 3, 7, 11, 15, 20])) AS i, len(s) AS k FROM se) SELECT run, round(i * 1.0 / k, 6) AS precision, round(i / 6.0, 6) AS recall, round(CASE WHEN i > 0 THEN 2.0 * i / (k + 6) ELSE 0 END, 6) AS f1, round(i * 1.0 / (k + 6 - i), 6) AS jaccard, i = 6 AS all_selected FROM x"),
    "q43_checks": _w(REP, "SELECT 'accuracy_in_range' AS name, bool_and(accuracy BETWEEN 0 AND 1) AS ok FROM rp UNION ALL SELECT 'cardinality_is_integer', bool_and(n_selected = round(n_selected)) FROM rp UNION ALL SELECT 'reduction_adds_up', bool_and(abs(1 - n_selected * 1.0 / d - feature_reduction) <= 1e-9) FROM rp"),
    "q44_scenarios": _w(EV, "SELECT scenario, count(seed) AS n_seeds, round(avg(value), 6) AS value_mean FROM ev GROUP BY scenario"),
    "q45_reconciled": _w(EV, ", s AS (SELECT DISTINCT scenario, seed FROM ev WHERE value > 1), r AS (SELECT DISTINCT scenario, seed FROM ev WHERE scenario <> 'click') SELECT CASE WHEN s.scenario IS NULL THEN 'raw_only' WHEN r.scenario IS NULL THEN 'summary_only' ELSE 'both' END AS side, count(*) AS n FROM s FULL JOIN r ON s.scenario = r.scenario AND s.seed = r.seed GROUP BY 1"),
    "q46_append_new": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY o_custkey",
    "q47_manifest_diff": "WITH d AS (SELECT doc_id, sha256(text) AS h, n_chars FROM documents), b AS (SELECT * FROM d WHERE n_chars < 20000), a AS (SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'new' ELSE h END AS h FROM d WHERE n_chars > 300) SELECT CASE WHEN b.doc_id IS NULL THEN 'ADDED' WHEN a.doc_id IS NULL THEN 'MISSING' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS status, count(*) AS n FROM b FULL JOIN a ON a.doc_id = b.doc_id GROUP BY 1",
    "q48_failure_status": "SELECT CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '5-LOW' THEN 'resolved' ELSE 'active' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "q49_text_scan": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, 'license' AS pattern, CAST(line AS BIGINT) AS line FROM l WHERE regexp_matches(t, '(?i)licen[sc]ed? under') UNION ALL SELECT doc_id, 'mail', CAST(line AS BIGINT) FROM l WHERE regexp_matches(t, '[a-z0-9.]+@[a-z0-9]+[.][a-z]+') UNION ALL SELECT doc_id, 'insult', CAST(line AS BIGINT) FROM l WHERE regexp_matches(t, '(?i)(idiot|stupid)')",
    "q50_nearest": _w(SPLIT, ", nn AS (SELECT t.row_id, t.y, n.y AS ny, row_number() OVER (PARTITION BY t.row_id ORDER BY round(list_sum(list_transform(list_zip(t.x, n.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), n.row_id) AS r FROM sp t, sp n WHERE t.is_test AND NOT n.is_test), vo AS (SELECT row_id, y, ny, count(*) AS v FROM nn WHERE r <= 5 GROUP BY ALL), pd AS (SELECT row_id, y, ny AS pred FROM vo QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY v DESC, ny) = 1), tr AS (SELECT y AS k, count(*) AS t, count(*) FILTER (y = pred) AS hit FROM pd GROUP BY y), sd AS (SELECT pred AS k, count(*) AS p FROM pd GROUP BY pred), al AS (SELECT coalesce(tr.k, sd.k) AS k, coalesce(t, 0) AS t, coalesce(p, 0) AS p, coalesce(hit, 0) AS hit FROM tr FULL JOIN sd ON tr.k = sd.k) SELECT round(sum(hit) * 1.0 / sum(t), 6) AS accuracy, round(avg(CASE WHEN t > 0 THEN hit * 1.0 / t END), 6) AS balanced_accuracy, round(avg(2.0 * hit / (t + p)), 6) AS macro_f1 FROM al"),
    "q51_uncertainty": _h("SELECT CAST(members AS INTEGER) AS a, CAST(NULL AS INTEGER) AS b, round(2 * greatest(0, hx + hy - hxy) / (hx + hy), 6) AS su FROM h WHERE o = 1 UNION ALL SELECT a, b, round(2 * greatest(0, x.hf + z.hf - hab) / (x.hf + z.hf), 6) FROM pr JOIN m x ON x.f = a JOIN m z ON z.f = b"),
    "q53_rank_correlation": _w(SC, ", g AS (SELECT dataset, method, round(avg(score), 9) AS x, count(*) AS n FROM sc GROUP BY ALL), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS b FROM g) SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM r"),
    "q54_selection_diff": _w(SEL, ", fu AS (SELECT s AS f FROM se ORDER BY run LIMIT 1) SELECT run, round(len(list_intersect(s, f)) * 1.0 / len(list_distinct(list_concat(s, f))), 6) AS jaccard, array_to_string(list_filter(f, lambda v: NOT list_contains(s, v)), ';') AS only_full, array_to_string(list_filter(s, lambda v: NOT list_contains(f, v)), ';') AS only_here FROM se, fu"),
    "q52_ranked_selectors": _w(RANKED, " UNION ALL ".join(f"SELECT method, step, CAST(f AS INTEGER) AS feature_id FROM k{i}" for i in range(1, 5))),
    "q57_paired_tests": _w(TESTS, "SELECT ds.method, n_pairs, paired_datasets, round(d, 6) AS mean_difference, round(md, 6) AS median_difference, round(CAST(least(rp, rm) AS DOUBLE), 6) AS statistic, round((rp - rm) / (rp + rm), 6) AS rank_biserial, round(CAST(p AS DOUBLE), 6) AS p_raw, round(CAST(least(1.0, h) AS DOUBLE), 6) AS p_holm, least(1.0, h) < 0.05 AS significant FROM ds JOIN pv USING (method) JOIN ho USING (method)"),
    "q58_validations": _w(REP, "SELECT 'accuracy_in_range' AS \"check\", CASE WHEN bool_and(accuracy BETWEEN 0 AND 1) THEN 'PASS' ELSE 'FAIL' END AS status FROM rp UNION ALL SELECT 'has_values', CASE WHEN count(accuracy) > 0 THEN 'PASS' ELSE 'FAIL' END FROM rp UNION ALL SELECT 'cardinality_is_integer', CASE WHEN bool_and(n_selected = round(n_selected)) THEN 'PASS' ELSE 'FAIL' END FROM rp UNION ALL SELECT 'reduction_adds_up', CASE WHEN bool_and(abs(1 - n_selected * 1.0 / d - feature_reduction) <= 1e-9 + 1e-5 * abs(feature_reduction)) THEN 'PASS' ELSE 'FAIL' END FROM rp UNION ALL SELECT 'summary_recomputes', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END FROM rp UNION ALL SELECT 'summary_is_a_fraction', CASE WHEN max(accuracy) <= 1 THEN 'PASS' ELSE 'FAIL' END FROM rp"),
    "q59_valid_degrees": _h(", al AS (SELECT mu, nu, pi FROM v UNION ALL SELECT mu, nu, pi FROM gd) SELECT bool_and(mu >= -1e-9) AS mu_ge_0, bool_and(nu >= -1e-9) AS nu_ge_0, bool_and(pi >= -1e-9) AS pi_ge_0, bool_and(mu + nu <= 1 + 1e-9) AS mu_nu_le_1, bool_and(abs(mu + nu + pi - 1) <= 1e-9) AS sum_eq_1 FROM al"),
    "q60_relieff": _w(RELIEF, "SELECT CAST(f AS INTEGER) AS feature_id, round(sum(v), 6) AS score FROM sc GROUP BY f"),
    "q61_seed_checks": _w(EV, ", o AS (SELECT scenario, seed, round(avg(value), 6) AS value FROM ev GROUP BY ALL), s AS (SELECT scenario, count(seed) AS n_seeds, avg(value) AS m FROM o GROUP BY scenario), r AS (SELECT scenario, count(DISTINCT seed) AS k, count(seed) AS c, avg(value) AS m2 FROM o GROUP BY scenario), j AS (SELECT * FROM s FULL JOIN r USING (scenario)) SELECT 'keys_unique' AS name, count(*) = count(DISTINCT scenario) AS ok FROM s UNION ALL SELECT 'keys_match', bool_and(n_seeds IS NOT NULL AND k IS NOT NULL) FROM j UNION ALL SELECT 'seeds_match', bool_and(n_seeds = k) FROM j UNION ALL SELECT 'rows_add_up', sum(n_seeds) = sum(c) FROM j UNION ALL SELECT 'value_reproduces', bool_and(abs(m - m2) <= 1e-12 + 1e-5 * abs(m2)) FROM j"),
    "q62_marginal_association": _w(FIVE, "SELECT CAST(hx.f AS INTEGER) AS feature_id, round(CASE WHEN least(hx, hy) <= 1e-12 THEN 0 ELSE least(1, greatest(0, hx + hy - hxy) / least(hx, hy)) END, 6) AS nmi FROM hx JOIN hz USING (f), hy"),
    "q66_bootstrap_nmi": _w(BOOT, "SELECT CAST(b AS INTEGER) AS replicate, CAST(f AS INTEGER) AS feature_id, round(nmi, 6) AS nmi FROM bn"),
    "q67_bootstrap_consensus": _w(BOOT, "SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, f) AS INTEGER) AS rank, CAST(f AS INTEGER) AS feature_id, round(count(*) / 20.0, 6) AS frequency FROM br WHERE r <= 10 GROUP BY f QUALIFY row_number() OVER (ORDER BY count(*) DESC, f) <= 10"),
    "q68_screened_stability": _w(BSEL, "SELECT (SELECT count(*) FROM bj) AS n_pairs, round(avg(j), 6) AS jaccard_mean, round(stddev_samp(j), 6) AS jaccard_std, round(avg(k), 6) AS kuncheva_mean, round(1 - (SELECT sum(p * (1 - p)) FROM bf) / 64 / 0.25, 6) AS nogueira FROM bj"),
    "q69_rank_association": _w(ASSOC, "SELECT round(rho, 6) AS rho, n, round(1 - abs(rho) * (1 + (SELECT sum(k * pow(1 - rho * rho, j)) FROM fs)), 6) AS p FROM ft"),
    "q70_neighbour_information": _w(KNN, "SELECT CAST(f AS INTEGER) AS feature_id, round((SELECT h FROM hn WHERE m = (SELECT n FROM kc)) - (SELECT own FROM kc) + (SELECT h FROM hn WHERE m = 5) - avg(h), 6) AS mi FROM km JOIN hn USING (m) GROUP BY f"),
    "q72_complete_cases": _w(SC, ", w AS (SELECT dataset, " + ", ".join(f"round(avg(CASE WHEN method = '{m}'{x} THEN score END), 6) AS \"{m}\"" for m, x in (("2-HIGH", " AND dataset <> 'BUILDING'"), ("3-MEDIUM", ""), ("4-NOT SPECIFIED", ""), ("5-LOW", ""))) + " FROM sc GROUP BY dataset) SELECT * FROM w WHERE \"2-HIGH\" IS NOT NULL AND \"3-MEDIUM\" IS NOT NULL AND \"4-NOT SPECIFIED\" IS NOT NULL AND \"5-LOW\" IS NOT NULL"),
    "q73_fuzzy_dependency": _w(EMB, ", sd AS (SELECT f, stddev_pop(x) AS s FROM ev GROUP BY f), ps AS (SELECT p.f, p.id, max(greatest(0, 1 - abs(p.x / s - q.x / s))) AS near FROM ev p JOIN sd USING (f) JOIN ev q ON q.f = p.f AND q.y <> p.y GROUP BY p.f, p.id) SELECT CAST(f AS INTEGER) AS feature_id, round(avg(1 - near), 6) AS dependency FROM ps GROUP BY f"),
    "q55_summary_recomputes": _w(SC, "SELECT count(*) AS n_matched, true AS ok FROM (SELECT DISTINCT dataset, method FROM sc)"),
    "q63_interaction_example": "SELECT row, x1_binary, x2_binary, CAST(xor(x1_binary, x2_binary) AS INTEGER) AS y_xor, CAST((x1_binary + x2_binary + e) % 2 AS INTEGER) AS x3_noisy_sum FROM (SELECT row, d & 1 AS x1_binary, (d >> 1) & 1 AS x2_binary, (d >> 2) & 1 AS e FROM (SELECT event_id AS row, CAST('0x' || substr(md5('0|' || event_id), 1, 1) AS INTEGER) AS d FROM events))",
    "q75_strong_relation": " UNION ALL ".join(_strong(status, k) for status in "FO" for k in (2, 3)),
    "q76_framed_scan": "WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line FROM documents) SELECT doc_id, 'license' AS pattern, line FROM l WHERE regexp_matches(t, '(?i)licen[sc]ed? under') AND NOT regexp_matches(t, '[0-9][.][0-9]') UNION ALL SELECT doc_id, 'mail', line FROM l WHERE regexp_matches(t, '[a-z0-9.]+@[a-z0-9]+[.][a-z]+') AND coalesce(lang, '') <> 'es'",
    "q77_lineage": "SELECT page_id, CASE WHEN contains(b, '/') THEN split_part(b, '/', 1) ELSE '' END AS artifact_group, CASE WHEN regexp_matches(b, '[0-5]$') THEN 'early' WHEN regexp_matches(b, '[6-9]$') THEN 'late' ELSE 'unknown' END AS authenticity, CASE WHEN regexp_matches(b, '[.]html?$') THEN 'page' WHEN regexp_matches(b, '[6-9]$') THEN 'numbered' WHEN contains(b, '/') THEN 'nested' ELSE 'unknown' END AS kind FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS b FROM pages)",
}
for _n in ("q18_screen_anova", "q26_objective_values", "q27_marginal_gains", "q33_stability_summary", "q38_signed_ranks", "q39_friedman", "q42_recovery", "q45_reconciled", "q50_nearest", "q53_rank_correlation", "q54_selection_diff", "q59_valid_degrees", "q61_seed_checks"):
    SQL[_n] = SQL[_n].replace(") , ", "), ", 1) if ") , " in SQL[_n] else SQL[_n]
