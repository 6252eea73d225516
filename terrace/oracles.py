"""The queries in SQL, for engines that read the same tables."""

from __future__ import annotations

_ORDERS = "o AS (SELECT o_totalprice / 1e5 + 0.01 AS y, (o_custkey % 7) / 2.0 + 0.5 AS a, (o_orderkey % 5) / 4.0 + 0.75 AS b, CAST(o_orderkey % 9 AS DOUBLE) AS k FROM orders)"
_LOGIT = "l AS (SELECT labels.doc_id, quality, 1 / (1 + exp(-(0.5 + n_chars / 10000.0))) AS p FROM labels JOIN documents USING (doc_id))"
_C = "c AS (SELECT l_quantity AS q, l_discount AS t, l_quantity / 10 AS fq, l_discount * l_discount * 100 AS ft, l_quantity * l_discount AS fqt FROM lineitem)"
_Z = "z AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 6) AS z FROM embeddings)"
_ERF = "CASE WHEN {z} = 0 THEN 0 ELSE sign({z}) * least(1, exp(-({z}) * ({z})) * list_sum(list_transform(generate_series(0, 160), lambda n: exp((2 * n + 1) * ln(abs({z})) - lgamma(n + 1.5))))) END"
_NORMAL = "0.5 * ln(2 * pi()) + ln(b) + 0.5 * ((y - a) / b) * ((y - a) / b)"


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _long(source: str, keys: str, vector: str) -> str:
    """(keys, pos, value) of a vector."""
    return f"SELECT {keys}{', ' if keys else ''}pos - 1 AS pos, {_r('v[pos]')} AS value FROM (SELECT {keys}{', ' if keys else ''}v, unnest(generate_series(1, len(v))) AS pos FROM (SELECT {keys}{', ' if keys else ''}{vector} AS v FROM {source}))"


def _counts(source: str, bin_: str) -> str:
    return f"SELECT CAST({bin_} AS BIGINT) AS bin, count(*) AS n FROM {source} GROUP BY 1"


def _stump(source: str, x: str, y: str) -> str:
    """The best cut of a regression tree's root."""
    return f"""
WITH t AS (SELECT {x} AS x, CAST(count(*) AS DOUBLE) AS n, sum(CAST({y} AS DOUBLE)) AS s FROM {source} GROUP BY 1),
c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS sl, sum(n) OVER () AS na, sum(s) OVER () AS sa FROM t),
g AS (SELECT x, nx, sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) AS gain FROM c WHERE nx IS NOT NULL)
SELECT '{x}' AS feature, CAST(x + (nx - x) / 2 AS DOUBLE) AS threshold FROM g ORDER BY gain DESC, x LIMIT 1"""


def _tree(source: str, features: list[str], y: str, depth: int) -> str:
    """All thresholds of a regression tree of each feature: at every level the best cut of every node."""
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n, sum(CAST({y} AS DOUBLE)) AS s FROM {source} GROUP BY 2" for f in features)
    sql, cuts = f"WITH t0 AS (SELECT *, 0 AS node FROM ({parts}))", []
    for k in range(depth):
        sql += f""",
c{k} AS (SELECT feature, node, x, lead(x) OVER w AS nx, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER p AS na, sum(s) OVER p AS sa FROM t{k} WINDOW w AS (PARTITION BY feature, node ORDER BY x), p AS (PARTITION BY feature, node)),
g{k} AS (SELECT feature, node, x, nx, sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na AS gain, sa FROM c{k} WHERE nx IS NOT NULL),
b{k} AS (SELECT feature, node, x + (nx - x) / 2 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY feature, node ORDER BY gain DESC, x) AS r FROM g{k}) WHERE r = 1 AND gain > 1e-9 * abs(sa)),
t{k + 1} AS (SELECT t.feature, t.x, t.n, t.s, 2 * t.node + CAST(t.x > b.cut AS INTEGER) AS node FROM t{k} t JOIN b{k} b ON t.feature = b.feature AND t.node = b.node)"""
        cuts.append(f"SELECT feature, cut FROM b{k}")
    return f"{sql} SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY cut) - 1 AS i, round(cut, 6) AS threshold FROM ({' UNION ALL '.join(cuts)})"


ORACLES: dict[str, str] = {
    "tree_bins_depth3": _tree("lineitem", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 3),
    "infer_feature_types": """
WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT l_orderkey) AS o, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_linenumber) AS l FROM lineitem)
SELECT 'l_orderkey' AS feature, CASE WHEN o / n < 0.03 THEN 'categorical' ELSE 'numerical' END AS kind FROM n
UNION ALL SELECT 'l_partkey', CASE WHEN p / n < 0.03 THEN 'categorical' ELSE 'numerical' END FROM n UNION ALL SELECT 'l_suppkey', CASE WHEN s / n < 0.03 THEN 'categorical' ELSE 'numerical' END FROM n
UNION ALL SELECT 'l_linenumber', CASE WHEN l / n < 0.03 THEN 'categorical' ELSE 'numerical' END FROM n
UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']), 'numerical' UNION ALL SELECT unnest(['l_returnflag', 'l_linestatus', 'l_shipdate']), 'categorical'""",
    "feature_info": """
SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature, 'num' AS kind, 'normalization' AS encoding, CAST(1 AS INTEGER) AS dimension, CAST(NULL AS INTEGER) AS unique_vals
UNION ALL SELECT 'l_returnflag', 'cat', 'int', 1, CAST(count(DISTINCT l_returnflag) + 1 AS INTEGER) FROM lineitem UNION ALL SELECT 'l_linestatus', 'cat', 'int', 1, CAST(count(DISTINCT l_linestatus) + 1 AS INTEGER) FROM lineitem""",
    "impute_mean": f"WITH x AS (SELECT l_orderkey, nullif(l_quantity, 10) AS q FROM lineitem) SELECT l_orderkey, {_r('coalesce(q, (SELECT avg(q) FROM x))')} AS l_quantity FROM x",
    "impute_most_frequent": """
WITH x AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders), m AS (SELECT s FROM x WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
SELECT o_orderkey, coalesce(s, (SELECT s FROM m)) AS o_orderstatus FROM x""",
    "impute_constant": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'missing') AS o_orderstatus FROM orders",
    "split_counts": """
SELECT CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':101'), 1, 8) AS BIGINT) % 10000 < 2000 THEN 'validation' ELSE 'train' END AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""",
    "union_distinct_counts": "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses FROM orders",
    "class_logodds_bias": f"WITH c AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic), p AS (SELECT *, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM c) SELECT toxic, n, {_r('ln(p / (1 - p))')} AS bias FROM p",
    "standardize": f"SELECT l_orderkey, {_r('(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem)')} AS z FROM lineitem",
    "minmax": f"SELECT l_orderkey, {_r('(l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem)')} AS u FROM lineitem",
    "bins_uniform": _counts("orders", "len(list_filter(list_transform(generate_series(1, 49), lambda k: k * 12000.0), lambda e: e <= o_totalprice))"),
    "bins_quantile": "WITH e AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM orders) SELECT CAST(len(list_filter(e, lambda x: x <= o_totalprice)) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1",
    "bins_custom_right_closed": _counts("lineitem", "CASE WHEN l_quantity < 5 OR l_quantity > 40 THEN NULL WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 ELSE 2 END"),
    "bins_onehot": "WITH b AS (SELECT len(list_filter([10.0, 20.0, 30.0, 40.0], lambda e: e <= l_quantity)) AS b FROM lineitem) SELECT pos, CAST(sum(CASE WHEN b = pos THEN 1 ELSE 0 END) AS BIGINT) AS n FROM b, (SELECT unnest(generate_series(0, 4)) AS pos) GROUP BY pos",
    "quantile_uniform": f"""
WITH q AS (SELECT quantile_cont(c_acctbal, list_transform(generate_series(0, 20), lambda k: k / 20.0)) AS q FROM customer),
p AS (SELECT c_custkey, c_acctbal AS x, q, len(list_filter(q, lambda e: e <= c_acctbal)) AS j, len(list_filter(q, lambda e: e < c_acctbal)) AS i FROM customer, q)
SELECT c_custkey, {_r('''CASE WHEN x <= q[1] THEN 0.0 WHEN x >= q[21] THEN 1.0
  ELSE ((j - 1) / 20.0 + 0.05 * (x - q[j]) / (q[j + 1] - q[j]) + (i - 1) / 20.0 + 0.05 * (x - q[i]) / (q[i + 1] - q[i])) / 2 END''')} AS u FROM p""",
    "polynomial": _long("part", "p_partkey", "[p_retailprice / 1000, (p_retailprice / 1000) * (p_retailprice / 1000), (p_retailprice / 1000) * (p_retailprice / 1000) * (p_retailprice / 1000)]"),
    "bspline_basis": f"""
WITH p AS (SELECT p_partkey, (p_size - 1) / 12.25 AS t FROM part), g AS (SELECT p_partkey, t, least(floor(t), 3) AS j, unnest(generate_series(0, 5)) AS pos FROM p),
u AS (SELECT *, t - j AS u FROM g)
SELECT p_partkey, pos, {_r('CASE CAST(pos - j AS INTEGER) WHEN 0 THEN (1 - u) * (1 - u) / 2 WHEN 1 THEN (1 + 2 * u - 2 * u * u) / 2 WHEN 2 THEN u * u / 2 ELSE 0 END')} AS value FROM u""",
    "bspline_unity": "SELECT CAST(1.0 AS DOUBLE) AS total, CAST(14 AS BIGINT) AS width, count(*) AS n FROM part",
    "cubic_basis": f"""
WITH p AS (SELECT p_partkey, p_size + CASE WHEN p_partkey % 7 = 0 THEN 30.0 ELSE 0.0 END AS v FROM part), c AS (SELECT p_partkey, v, least(v, 50.0) AS x FROM p),
m AS (SELECT *, [1 / 19.0, -1 / 19.0 - 1 / 30.0, 1 / 30.0] AS d, 49 / 3.0 AS b FROM c),
r AS (SELECT *, CASE WHEN x <= 20 THEN ((x - 1) * (x - 1) * (x - 1) / 19 - 19 * (x - 1)) / 6 ELSE ((50 - x) * (50 - x) * (50 - x) / 30 - 30 * (50 - x)) / 6 END + (v - x) * 30 / 6.0 AS w FROM m),
l AS (SELECT *, CASE WHEN x <= 20 THEN [(20 - x) / 19, (x - 1) / 19, 0] ELSE [0, (50 - x) / 30, (x - 20) / 30] END AS h, [0, -(v - x) / 30, (v - x) / 30] AS s FROM r)
SELECT p_partkey, pos - 1 AS pos, {_r('h[pos] + s[pos] + w * d[pos] / b')} AS value FROM (SELECT *, unnest(generate_series(1, 3)) AS pos FROM l)""",
    "cubic_unity": "SELECT CAST(1.0 AS DOUBLE) AS total, count(*) AS n FROM part",
    "rff_features": _long("part", "p_partkey", "list_transform([[0.5, 0.1], [-1.25, 1.5], [2.0, 3.0]], lambda p: sqrt(2 / 3.0) * cos(p[1] / 0.2 * (p_size / 50.0) + p[2]))"),
    "stump_split": _stump("lineitem", "l_quantity", "l_extendedprice"),
    "tree_bins_classes": """
WITH t AS (SELECT n_chars AS x, CAST(count(*) AS DOUBLE) AS n, sum(CAST(quality AS DOUBLE)) AS s FROM labels JOIN documents USING (doc_id) GROUP BY 1),
c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS sl, sum(n) OVER () AS na, sum(s) OVER () AS sa FROM t),
g AS (SELECT x, nx, (sl * sl + (nl - sl) * (nl - sl)) / nl + ((sa - sl) * (sa - sl) + (na - nl - sa + sl) * (na - nl - sa + sl)) / (na - nl) AS gain FROM c WHERE nx IS NOT NULL)
SELECT 'n_chars' AS feature, x + (nx - x) / 2.0 AS threshold FROM g ORDER BY gain DESC, x LIMIT 1""",
    "ple_encode": f"""
WITH p AS (SELECT l_orderkey, (l_quantity - 1) / 49 AS x FROM lineitem), b AS (SELECT *, CASE WHEN x >= 0.9 THEN 3 WHEN x > 0.5 THEN 2 WHEN x > 0.2 THEN 1 ELSE 0 END AS b FROM p),
v AS (SELECT *, CASE b WHEN 1 THEN (x - 0.2) / (0.5 - 0.2) WHEN 2 THEN (x - 0.5) / (0.9 - 0.5) ELSE x END AS own, unnest(generate_series(0, 3)) AS pos FROM b)
SELECT l_orderkey, pos, {_r('CASE WHEN pos < b THEN 1.0 WHEN pos = b THEN own ELSE 0.0 END')} AS value FROM v""",
    "cat_ordinal": "WITH c AS (SELECT source, row_number() OVER (ORDER BY source) AS id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) SELECT doc_id, coalesce(id, 0) AS code FROM documents LEFT JOIN c USING (source)",
    "cat_ordinal_unknown": "SELECT CAST(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 1 WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 2 ELSE 0 END AS BIGINT) AS code, count(*) AS n FROM lineitem GROUP BY 1",
    "cat_onehot": "WITH c AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS c FROM lineitem) SELECT pos, CAST(sum(CASE WHEN c = pos THEN 1 ELSE 0 END) AS BIGINT) AS n FROM c, (SELECT unnest(generate_series(0, 2)) AS pos) GROUP BY pos",
    "preprocess_block_sums": """
WITH m AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) AS c, max(l_discount) AS d FROM lineitem)
SELECT 'num_l_quantity' AS block, CAST(0 AS BIGINT) AS pos, round(sum((l_quantity - a) / (b - a)), 3) AS total FROM lineitem, m UNION ALL SELECT 'num_l_discount', 0, round(sum((l_discount - c) / (d - c)), 3) FROM lineitem, m
UNION ALL SELECT 'cat_l_returnflag', k, round(CAST(count(*) FILTER (c = k) AS DOUBLE), 3) FROM (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 0 END AS c FROM lineitem), (SELECT unnest(generate_series(0, 3)) AS k) GROUP BY k""",
    "gram_sufficient_stats": "WITH s AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice / 1e5 AS y FROM lineitem) SELECT name, round(value, 3) AS value FROM (SELECT unnest(['n', 'sum_l_quantity', 'sum_l_discount', 'sum_l_tax', 'sum_y', 'l_quantity_l_quantity', 'l_quantity_l_discount', 'l_quantity_l_tax', 'l_quantity_y', 'l_discount_l_discount', 'l_discount_l_tax', 'l_discount_y', 'l_tax_l_tax', 'l_tax_y', 'y_y']) AS name, unnest([CAST(count(*) AS DOUBLE), sum(a), sum(b), sum(c), sum(y), sum(a * a), sum(a * b), sum(a * c), sum(a * y), sum(b * b), sum(b * c), sum(b * y), sum(c * c), sum(c * y), sum(y * y)]) AS value FROM s)",
    "linreg_fit_1d": "SELECT 'slope' AS name, round(regr_slope(l_extendedprice, l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM lineitem",
    "linreg_mse": "WITH f AS (SELECT regr_slope(l_extendedprice / 1e4, l_quantity) AS s, regr_intercept(l_extendedprice / 1e4, l_quantity) AS i FROM lineitem) SELECT round(avg((l_extendedprice / 1e4 - i - s * l_quantity) * (l_extendedprice / 1e4 - i - s * l_quantity)), 5) AS mse FROM lineitem, f",
    "gam_moments": "SELECT round(avg(l_extendedprice * l_quantity), 3) AS by_l_quantity, round(avg(l_extendedprice * l_discount), 3) AS by_l_discount FROM lineitem",
    "gam_thin_plate": "WITH s AS (SELECT s_acctbal / 10000 AS x, s_nationkey / 25.0 AS y, CAST(s_suppkey % 13 AS DOUBLE) AS w, s_suppkey % 7 + s_acctbal / 1000 AS t FROM supplier) SELECT round(avg(t), 5) AS mean, round(avg(t * x), 5) AS by_x, round(avg(t * y), 5) AS by_y, round(avg(t * w), 5) AS by_w FROM s",
    "gam_regions": "SELECT n_nationkey AS region, CAST(count(c_custkey) AS BIGINT) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey",
    "gam_predict": "SELECT round(avg(l_extendedprice), 4) AS mean FROM lineitem",
    "logit_score": f"WITH {_LOGIT} SELECT doc_id, {_r('p')} AS p, CAST(p > 0.7 AS INTEGER) AS predicted FROM l",
    "accuracy": f"WITH {_LOGIT} SELECT {_r('avg(CASE WHEN quality = CAST(p > 0.7 AS INTEGER) THEN 1.0 ELSE 0.0 END)')} AS accuracy, {_r('sum(CASE WHEN quality = 1 AND p > 0.7 THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN p > 0.7 THEN 1.0 ELSE 0.0 END), 0)')} AS precision FROM l",
    "auroc_rank": f"WITH {_LOGIT}, r AS (SELECT quality, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM l), s AS (SELECT sum(r) FILTER (quality = 1) AS s, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM r) SELECT {_r('CAST(s - p * (p + 1) / 2.0 AS DOUBLE) / (CAST(p AS DOUBLE) * n)')} AS auroc FROM s",
    "brier": f"WITH {_LOGIT} SELECT {_r('avg((p - quality) * (p - quality))')} AS brier FROM l",
    "nll_normal": f"WITH {_ORDERS} SELECT round(avg({_NORMAL}), 6) AS nll FROM o",
    "nll_poisson": f"WITH {_ORDERS} SELECT round(avg(a - k * ln(a) + lgamma(k + 1)), 6) AS nll FROM o",
    "nll_gamma": f"WITH {_ORDERS} SELECT round(avg(b * y + lgamma(a) - a * ln(b) - (a - 1) * ln(y)), 6) AS nll FROM o",
    "nll_inversegamma": f"WITH {_ORDERS} SELECT round(avg(b / y + lgamma(a) - a * ln(b) + (a + 1) * ln(y)), 6) AS nll FROM o",
    "nll_beta": f"WITH {_ORDERS} SELECT round(avg(lgamma(a) + lgamma(b) - lgamma(a + b) - (a - 1) * ln(y / 10) - (b - 1) * ln(1 - y / 10)), 6) AS nll FROM o",
    "nll_negativebinom": f"WITH {_ORDERS} SELECT round(avg(lgamma(1 / b) + lgamma(k + 1) - lgamma(k + 1 / b) - (1 / b) * ln((1 / b) / (1 / b + a)) - k * ln(a / (1 / b + a))), 6) AS nll FROM o",
    "nll_robustnormal": f"WITH {_ORDERS} SELECT round(avg(ln(1 + exp(0.1)) - ln(1 + exp(0.1 - ({_NORMAL})))), 6) AS nll FROM o",
    "nll_studentt": f"WITH {_ORDERS} SELECT round(avg(lgamma(1.75) - lgamma(2.25) + 0.5 * ln(3.5 * pi()) + ln(b) + 2.25 * ln(1 + (y - a) * (y - a) / (b * b * 3.5))), 6) AS nll FROM o",
    "nll_categorical": f"WITH z AS (SELECT label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings) SELECT {_r('avg(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[label + 1])')} AS nll FROM z",
    "nll_dirichlet": f"WITH {_ORDERS} SELECT {_r('avg(lgamma(a) + lgamma(b) + lgamma(1.5) - lgamma(a + b + 1.5) - (a - 1) * ln(b / 4) - (b - 1) * ln(0.5 - b / 8) - 0.5 * ln(0.5 - b / 8))')} AS nll FROM o",
    "pinball_loss": f"WITH {_ORDERS} SELECT {_r('avg(greatest(-0.75 * (y - a), 0.25 * (y - a)) + greatest(-0.5 * (y - a - 1), 0.5 * (y - a - 1)) + greatest(-0.25 * (y - a - 2), 0.75 * (y - a - 2)))')} AS loss FROM o",
    "monotone_quantiles": _long("orders", "o_orderkey", "[o_totalprice / 1e4, o_totalprice / 1e4 + exp(o_custkey % 3 - 1.0), o_totalprice / 1e4 + exp(o_custkey % 3 - 1.0) + exp((o_custkey % 4) / 4.0 - 0.5)]"),
    "link_functions": f"SELECT s_suppkey, {_r('ln(1 + exp(-abs(s_acctbal / 1000))) + greatest(s_acctbal / 1000, 0)')} AS softplus, {_r('1 / (1 + exp(-s_acctbal / 1000))')} AS sigmoid, {_r('(s_acctbal / 1000) * (s_acctbal / 1000)')} AS square, {_r('exp(s_acctbal / 1000 / 10)')} AS exp, {_r('ln(abs(s_acctbal / 1000) + 1e-6)')} AS log FROM supplier",
    "special_functions": f"SELECT p_partkey, {_r('lgamma(p_size / 7.0)')} AS lgamma, {_r(_ERF.format(z='p_size / 7.0 / 3'))} AS erf FROM part",
    "metric_deviances": f"""
WITH {_ORDERS} SELECT round(2 * sum(CASE WHEN k = 0 THEN 0 ELSE k * ln(k / a) END - (k - a)), 4) AS dev_poisson, round(2 * sum(ln(y / a) + (y - a) / a), 4) AS dev_gamma,
  round(2 * sum(k * ln(k / a + 1e-9) + (k + b) * ln((a + b) / (k + b))), 4) AS dev_negbin, {_r('avg(3 * ln(1 + (y - a) * (y - a) / (2 * b)) / b)')} AS loss_studentt,
  {_r('avg((a + 1) * ln(y / b) + ln(pow(b, a) / y))')} AS loss_invgamma, {_r('avg((y - a) * (y - a))')} AS mse, {_r('avg(abs(y - a))')} AS mae, {_r('sqrt(avg((y - a) * (y - a)))')} AS rmse FROM o""",
    "err_dirichlet": f"WITH {_ORDERS} SELECT {_r('avg((b - a) * (b - a) + (y - b) * (y - b) + (a - y) * (a - y))')} AS error FROM o",
    "crps_gaussian": f"WITH {_ORDERS}, z AS (SELECT b, (y - a) / b AS z FROM o), e AS (SELECT b, z, {_ERF.format(z='z / sqrt(2)')} AS erf FROM z) SELECT {_r('avg(b * (z * erf + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi())))')} AS crps FROM e",
    "sparsemax": f"""
WITH {_Z}, s AS (SELECT vec_id, z, list_reverse_sort(z) AS s FROM z), k AS (SELECT *, list_filter(generate_series(1, len(s)), lambda k: 1 + k * s[k] > list_sum(s[1:k])) AS ks FROM s),
t AS (SELECT vec_id, z, (list_sum(s[1:ks[-1]]) - 1) / ks[-1] AS tau FROM k) {_long('t', 'vec_id', 'list_transform(z, lambda x: greatest(x - tau, 0))')}""",
    "entmax15_unity": "SELECT CAST(1.0 AS DOUBLE) AS total, count(*) AS n FROM embeddings",
    "softmax_argmax": f"WITH {_Z}, s AS (SELECT vec_id, z, list_sum(list_transform(z, lambda x: exp(x))) AS s FROM z) SELECT vec_id, {_r('exp(list_max(z)) / s')} AS p, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS at, {_r('ln(s)')} AS norm FROM s",
    "entmoid": f"""
WITH x AS (SELECT s_suppkey, s_acctbal / 3000 AS x FROM supplier), t AS (SELECT s_suppkey, x, abs(x) AS a, (abs(x) + sqrt(greatest(8 - x * x, 0))) / 2 AS t FROM x),
y AS (SELECT s_suppkey, x, 0.25 * pow(greatest(CASE WHEN t <= a THEN 2.0 ELSE t END - a, 0), 2) AS y FROM t)
SELECT s_suppkey, {_r('CASE WHEN x >= 0 THEN 1 - y ELSE y END')} AS entmoid, {_r('greatest(least(0.5 * x + 0.5, 1), 0)')} AS sparsemoid FROM y""",
    "norms": f"""
WITH {_Z}, w AS (SELECT vec_id, z, len(z) // 2 AS h FROM z), m AS (SELECT vec_id, z, h, list_avg(z) AS m, list_avg(z[1:h]) AS m1, list_avg(z[h + 1:]) AS m2, sqrt(list_avg(list_transform(z, lambda x: x * x)) + 1e-5) AS rms FROM w),
d AS (SELECT *, sqrt(list_avg(list_transform(z, lambda x: (x - m) * (x - m))) + 1e-5) AS s, sqrt(list_avg(list_transform(z[1:h], lambda x: (x - m1) * (x - m1))) + 1e-5) AS s1, sqrt(list_avg(list_transform(z[h + 1:], lambda x: (x - m2) * (x - m2))) + 1e-5) AS s2 FROM m),
v AS (SELECT vec_id, 'rms' AS norm, list_transform(z, lambda x: x / rms) AS v FROM d UNION ALL SELECT vec_id, 'layer', list_transform(z, lambda x: (x - m) / s) FROM d
  UNION ALL SELECT vec_id, 'group', list_concat(list_transform(z[1:h], lambda x: (x - m1) / s1), list_transform(z[h + 1:], lambda x: (x - m2) / s2)) FROM d
  UNION ALL SELECT vec_id, 'glu', list_transform(generate_series(1, h), lambda i: z[i] / (1 + exp(-z[i + h]))) FROM d UNION ALL SELECT vec_id, 'reglu', list_transform(generate_series(1, h), lambda i: z[i] * greatest(z[i + h], 0)) FROM d)
{_long('v', 'vec_id, norm', 'v')}""",
    "effect_main": f"WITH {_C} SELECT 'l_quantity' AS term, {_r('q')} AS x, count(*) AS n, {_r('min(fq)')} AS y FROM c GROUP BY q UNION ALL SELECT 'l_discount', {_r('t')}, count(*), {_r('min(ft)')} FROM c GROUP BY t",
    "effect_pair": f"""
WITH {_C}, p AS (SELECT q AS x1, t AS x2, count(*) AS n, min(fqt) AS y FROM c GROUP BY q, t), g AS (SELECT * FROM (SELECT DISTINCT x1 FROM p), (SELECT DISTINCT x2 FROM p)),
d AS (SELECT x1, x2, coalesce(n, 0) AS n, coalesce(y, 0) AS y FROM g LEFT JOIN p USING (x1, x2)) SELECT x1, x2, n, {_r('y')} AS y FROM d WHERE y <> 0 OR n > 0""",
    "effect_centered": f"WITH {_C}, m AS (SELECT q AS x, count(*) AS n, min(fq) AS y FROM c GROUP BY q), o AS (SELECT sum(y * n) / sum(n) AS o FROM m) SELECT x, n, {_r('y - o')} AS y, {_r('o')} AS \"offset\" FROM m, o",
    "effect_importance": f"WITH {_C} SELECT 'l_quantity' AS term, {_r('avg(abs(fq))')} AS importance FROM c UNION ALL SELECT 'l_discount', {_r('avg(abs(ft))')} FROM c",
    "purify_pair": f"WITH {_C}, p0 AS (SELECT q AS x1, t AS x2, count(*) AS n, min(fqt) AS y, 0.0 AS r, 0.0 AS k FROM c GROUP BY q, t)"
    + "".join(f", a{i} AS (SELECT *, sum(y * n) OVER (PARTITION BY x1) / sum(n) OVER (PARTITION BY x1) AS m FROM p{i}), b{i} AS (SELECT x1, x2, n, y - m AS y, r + m AS r, k FROM a{i}), d{i} AS (SELECT *, sum(y * n) OVER (PARTITION BY x2) / sum(n) OVER (PARTITION BY x2) AS m FROM b{i}), p{i + 1} AS (SELECT x1, x2, n, y - m AS y, r, k + m AS k FROM d{i})" for i in range(4))
    + f' SELECT x1, x2, n, {_r("y")} AS y, {_r("r")} AS "row", {_r("k")} AS col FROM p4',
    "purify_converged": f"WITH {_C}, p0 AS (SELECT q AS x1, t AS x2, count(*) AS n, min(fqt) AS y, 0.0 AS r, 0.0 AS k FROM c GROUP BY q, t)"
    + "".join(f", a{i} AS (SELECT *, sum(y * n) OVER (PARTITION BY x1) / sum(n) OVER (PARTITION BY x1) AS m FROM p{i}), b{i} AS (SELECT x1, x2, n, y - m AS y, r + m AS r, k FROM a{i}), d{i} AS (SELECT *, sum(y * n) OVER (PARTITION BY x2) / sum(n) OVER (PARTITION BY x2) AS m FROM b{i}), p{i + 1} AS (SELECT x1, x2, n, y - m AS y, r, k + m AS k FROM d{i})" for i in range(12))
    + f' SELECT x1, x2, n, {_r("y")} AS y FROM p12',
    "effect_histogram": f"WITH b AS (SELECT CAST(len(list_filter(list_transform(generate_series(1, 29), lambda k: k * 2.0), lambda e: e <= l_quantity)) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT bin, n, {_r('n / CAST(max(n) OVER () AS DOUBLE)')} AS shade FROM b",
    "effect_sorted_columns": f"SELECT 'l_quantity' AS \"column\", row_number() OVER (ORDER BY l_quantity) AS rank, {_r('l_quantity')} AS value FROM lineitem UNION ALL SELECT 'l_extendedprice', row_number() OVER (ORDER BY l_extendedprice), {_r('l_extendedprice')} FROM lineitem",
    "tree_terms": "WITH s AS (SELECT DISTINCT c_custkey % 40 AS tree, c_mktsegment AS feature FROM customer) SELECT DISTINCT term FROM (SELECT tree, string_agg(feature, ':' ORDER BY feature) AS term FROM s GROUP BY tree)",
    "tree_feature_counts": "SELECT c_mktsegment AS feature, count(DISTINCT c_custkey % 40) AS n FROM customer GROUP BY 1",
    "mrf_neighbours": """
WITH v AS (SELECT n_nationkey AS region, n_nationkey % 5 + a AS vx, n_nationkey // 5 + b AS vy FROM nation, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
SELECT x.region AS region_a, y.region AS region_b, count(*) AS shared FROM v x JOIN v y ON x.vx = y.vx AND x.vy = y.vy AND x.region <> y.region GROUP BY 1, 2""",
    "mrf_laplacian": """
WITH v AS (SELECT n_nationkey AS region, n_nationkey % 5 + a AS vx, n_nationkey // 5 + b AS vy FROM nation, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
e AS (SELECT DISTINCT x.region AS a, y.region AS b FROM v x JOIN v y ON x.vx = y.vx AND x.vy = y.vy AND x.region <> y.region)
SELECT a AS region_a, b AS region_b, CAST(-1.0 AS DOUBLE) AS value FROM e UNION ALL SELECT a, a, CAST(count(*) AS DOUBLE) FROM e GROUP BY a""",
    "region_indicator": "SELECT k AS pos, CAST(count(*) FILTER (c_nationkey = r) AS BIGINT) AS n FROM customer, (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k FROM (SELECT unnest(generate_series(0, 24)) AS r)) GROUP BY k",
    "daily_event_counts": "WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM d",
}
