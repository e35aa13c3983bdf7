"""One query for each operator, over the test tables, with the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import graph
from tesserae.registry import ORACLE_SQL, QUERIES, plan, script
from tesserae.session import Session
from tesserae.storage import distinct_rows

# --- scans, projections, joins, sets --------------------------------------------------------------------

FLAGSHIP = """
revenue[name, sum(rev)] := *lineitem{l_orderkey: o, l_extendedprice: p, l_discount: d}, *orders{o_orderkey: o, o_custkey: c},
    *customer{c_custkey: c, c_nationkey: n}, *nation{n_nationkey: n, n_name: name}, rev = p * (1 - d)
?[name, revenue] := revenue[name, r], revenue = round(r)
:order -revenue
:limit 10
"""
script("revenue_by_nation", FLAGSHIP, "SELECT n_name AS name, round(sum(l_extendedprice * (1 - l_discount))) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
script("scan_filter_project", "?[k, total] := *orders{o_orderkey: k, o_totalprice: total, o_orderpriority: '1-URGENT'}, total > 200000", "SELECT DISTINCT o_orderkey AS k, o_totalprice AS total FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000")
script("point_lookup", "?[name, bal] := *customer{c_custkey: 7, c_name: name, c_acctbal: bal}", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 7")
script("prefix_scan", "?[k, name] := *part{p_partkey: k, p_name: name}, starts_with(name, 'red')", "SELECT p_partkey AS k, p_name AS name FROM part WHERE starts_with(p_name, 'red')")
script("constant_rule", "c[a, b] <- [[1, 'x'], [2, 'y'], [null, 'z']] ?[a, b] := c[a, b]", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x'), (2, 'y'), (NULL, 'z')) t(a, b)")
script("join_equi", "?[c, o, total] := *customer{c_custkey: c, c_mktsegment: 'BUILDING'}, *orders{o_orderkey: o, o_custkey: c, o_totalprice: total}, total > 100000", "SELECT c_custkey AS c, o_orderkey AS o, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000")
script("join_self", "?[a, b] := *nation{n_nationkey: a, n_regionkey: r}, *nation{n_nationkey: b, n_regionkey: r}, a < b", "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
script("join_cross_range", "?[r, s] := *region{r_regionkey: r}, *supplier{s_suppkey: s, s_acctbal: b}, b > r * 2000", "SELECT r_regionkey AS r, s_suppkey AS s FROM region CROSS JOIN supplier WHERE s_acctbal > r_regionkey * 2000")
script("join_anti", "?[c] := *customer{c_custkey: c}, not *orders{o_custkey: c, o_orderpriority: '1-URGENT'}", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
script("join_anti_rule", "rich[c] := *customer{c_custkey: c, c_acctbal: b}, b > 5000 ?[c] := *customer{c_custkey: c}, not rich[c]", "SELECT c_custkey AS c FROM customer WHERE c_acctbal <= 5000")
script("join_semi", "?[c] := *customer{c_custkey: c}, *orders{o_custkey: c, o_totalprice: t}, t > 300000", "SELECT DISTINCT c_custkey AS c FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000")
script("join_nulls", "a[x] <- [[1], [null], [3]] b[x] <- [[null], [3]] ?[x] := a[x], b[x]", "SELECT * FROM (VALUES (CAST(NULL AS BIGINT)), (3)) t(x)")
script("union_rules", "?[k, kind] := *customer{c_nationkey: k}, kind = 'c' ?[k, kind] := *supplier{s_nationkey: k}, kind = 's'", "SELECT c_nationkey AS k, 'c' AS kind FROM customer UNION SELECT s_nationkey, 's' FROM supplier")
script("intersect_rules", "?[n] := *customer{c_nationkey: n, c_mktsegment: 'MACHINERY'}, *supplier{s_nationkey: n}", "SELECT c_nationkey AS n FROM customer WHERE c_mktsegment = 'MACHINERY' INTERSECT SELECT s_nationkey FROM supplier")
script("except_rules", "poor[n] := *supplier{s_nationkey: n, s_acctbal: b}, b < 1000 ?[n] := *nation{n_nationkey: n}, not poor[n]", "SELECT n_nationkey AS n FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 1000")
script("disjunction", "?[k] := *part{p_partkey: k, p_size: s, p_retailprice: p}, s == 1 or s > 48 or p > 1090", "SELECT p_partkey AS k FROM part WHERE p_size = 1 OR p_size > 48 OR p_retailprice > 1090")
script("negated_group", "?[k] := *part{p_partkey: k, p_size: s, p_retailprice: p}, not (s > 10, p > 1000)", "SELECT p_partkey AS k FROM part WHERE NOT (p_size > 10 AND p_retailprice > 1000)")
script("unnest_in", "?[k, n] := *region{r_regionkey: k}, n in [k, k + 1, 9]", "SELECT DISTINCT r_regionkey AS k, unnest([r_regionkey, r_regionkey + 1, 9]) AS n FROM region")
script("unification_filter", "?[k] := *nation{n_nationkey: k, n_regionkey: r}, r = k % 5", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = n_nationkey % 5")
script("cond_if", "?[k, size] := *part{p_partkey: k, p_size: s}, size = cond(s < 10, 'small', s < 30, 'middle', true, 'large')", "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size FROM part")
script("coalesce_op", "a[x, y] <- [[1, null], [null, 2], [null, null]] ?[x, y, z] := a[x, y], z = x ~ y ~ -1", "SELECT x, y, coalesce(x, y, -1) AS z FROM (VALUES (CAST(1 AS BIGINT), CAST(NULL AS BIGINT)), (NULL, 2), (NULL, NULL)) t(x, y)")

# --- aggregates ------------------------------------------------------------------------------------------

script("agg_numeric", "?[f, count(q), sum(q), min(p), max(p), mean(d)] := *lineitem{l_returnflag: f, l_quantity: q, l_extendedprice: p, l_discount: d}", "SELECT l_returnflag AS f, count(*) AS n, round(sum(l_quantity), 4) AS s, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_discount), 8) AS m FROM lineitem GROUP BY 1", None)
_numeric = QUERIES["agg_numeric"]
QUERIES["agg_numeric"] = lambda spark, d: _numeric(spark, d).toDF("f", "n", "s", "lo", "hi", "m").withColumn("s", F.round("s", 4)).withColumn("m", F.round("m", 8))
script("agg_variance", "a[f, variance(q), std_dev(q)] := *lineitem{l_returnflag: f, l_quantity: q} ?[f, v, s] := a[f, x, y], v = round(x * 1000), s = round(y * 1000)", "SELECT l_returnflag AS f, round(var_samp(l_quantity) * 1000) AS v, round(stddev_samp(l_quantity) * 1000) AS s FROM lineitem GROUP BY 1")
script("agg_product", "?[r, product(x)] := *nation{n_nationkey: k, n_regionkey: r}, x = k + 1", "SELECT n_regionkey AS r, product(n_nationkey + 1) AS p FROM nation GROUP BY 1", ["r", "p"])
script("agg_count_unique", "?[n, count_unique(s)] := *customer{c_nationkey: n, c_mktsegment: s}", "SELECT c_nationkey AS n, count(DISTINCT c_mktsegment) AS k FROM customer GROUP BY 1", ["n", "k"])
script("agg_unique", "u[n, unique(s)] := *customer{c_nationkey: n, c_mktsegment: s} ?[n, s] := u[n, l], s = from_substrings(l)", "SELECT c_nationkey AS n, string_agg(DISTINCT c_mktsegment, '' ORDER BY c_mktsegment) AS s FROM customer GROUP BY 1")
script("agg_collect", "u[r, collect(k)] := *nation{n_nationkey: k, n_regionkey: r} ?[r, n, first] := u[r, l], n = length(l), first = first(l)", "SELECT n_regionkey AS r, count(*) AS n, min(n_nationkey) AS first FROM nation GROUP BY 1")
script("agg_group_count", "g[n, group_count(s)] := *customer{c_nationkey: n, c_mktsegment: s} ?[n, s, k] := g[n, l], x in l, s = get(x, 0), k = get(x, 1)", "SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS k FROM customer GROUP BY 1, 2")
script("agg_bool", "?[s, and(b), or(b)] := *orders{o_orderstatus: s, o_totalprice: t}, b = t > 1000", "SELECT o_orderstatus AS s, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 1000) AS o FROM orders GROUP BY 1", ["s", "a", "o"])
script("agg_latest_by", "?[c, latest_by(x)] := *orders{o_orderkey: k, o_custkey: c, o_orderdate: d}, x = [k, to_int(d)]", "SELECT o_custkey AS c, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1", ["c", "k"])
script("agg_smallest_by", "?[c, smallest_by(x)] := *orders{o_orderkey: k, o_custkey: c, o_totalprice: t}, x = [k, t]", "SELECT o_custkey AS c, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS k FROM orders GROUP BY 1", ["c", "k"])
script("agg_min_cost", "m[c, min_cost(x)] := *orders{o_orderkey: k, o_custkey: c, o_totalprice: t}, x = [k, t] ?[c, k, t] := m[c, x], k = get(x, 0), t = get(x, 1)", "SELECT o_custkey AS c, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS k, min(o_totalprice) AS t FROM orders GROUP BY 1")
script("agg_shortest_choice", "?[r, shortest(l), choice(k)] := *nation{n_nationkey: k, n_regionkey: r, n_name: n}, l = chars(n)", "SELECT r, array_to_string(string_split(n, ''), ',') AS l, k FROM (SELECT n_regionkey AS r, arg_min(n_name, (length(n_name), n_name)) AS n, min(n_nationkey) AS k FROM nation GROUP BY 1)", ["r", "l", "k"])
_short = QUERIES["agg_shortest_choice"]
QUERIES["agg_shortest_choice"] = lambda spark, d: _short(spark, d).withColumn("l", F.array_join("l", ","))
script("agg_list_sets", "l[r, x] := *nation{n_nationkey: k, n_regionkey: r}, x = [r, k % 3] u[r, union(x), intersection(x)] := l[r, x] ?[r, n, m] := u[r, a, b], n = length(a), m = length(b)", "SELECT n_regionkey AS r, count(DISTINCT x) AS n, count(DISTINCT x) FILTER (c = t) AS m FROM (SELECT n_regionkey, x, count(DISTINCT g) OVER (PARTITION BY n_regionkey, x) AS c, count(DISTINCT g) OVER (PARTITION BY n_regionkey) AS t FROM (SELECT n_regionkey, n_nationkey % 3 AS g, unnest([n_regionkey, n_nationkey % 3]) AS x FROM nation)) GROUP BY 1")
script("agg_empty", "e[x] <- [] ?[count(x), sum(x)] := *region{r_regionkey: x}, x > 1000", "SELECT count(*) AS n, coalesce(sum(r_regionkey), 0)::DOUBLE AS s FROM region WHERE r_regionkey > 1000", ["n", "s"])

# --- order, limits, time travel -----------------------------------------------------------------------------

script("topk", "?[k, t] := *orders{o_orderkey: k, o_totalprice: t} :order -t, k :limit 20", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY 2 DESC, 1 LIMIT 20")
script("limit_offset", "?[k] := *part{p_partkey: k} :order k :limit 15 :offset 30", "SELECT p_partkey AS k FROM part ORDER BY 1 LIMIT 15 OFFSET 30")
script("reorder_sort_rank", "s[k, n] := *nation{n_nationkey: k, n_regionkey: n} ?[rank, n, k] <~ ReorderSort(s[k, n], out: [n, k], sort_by: n, descending: true)", "SELECT rank() OVER (ORDER BY n_regionkey DESC) AS rank, n_regionkey AS n, n_nationkey AS k FROM nation")
script("reorder_sort_take", "s[k, n] := *nation{n_nationkey: k, n_regionkey: n} ?[rank, k] <~ ReorderSort(s[k, n], out: [k], sort_by: [n, k], break_ties: true, skip: 3, take: 5)", "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS rank, n_nationkey AS k FROM nation QUALIFY rank > 3 AND rank <= 8")
script("asof_scan", "?[u, e] := *history{u, e @ 1704800000000000}", "SELECT user_id AS u, arg_max(event_id, (epoch_us(ts), event_id)) AS e FROM events WHERE epoch_us(ts) <= 1704800000000000 GROUP BY 1", setup="seen[u, t, max(e)] := *events{event_id: e, user_id: u, ts: d}, t = to_int(d) ?[u, at, e] := seen[u, t, e], at = validity(t) :create history {u: Int, at: Validity => e: Int}")

# --- recursion --------------------------------------------------------------------------------------------

#: Each turn of a conversation and the next one.
TURNS = "e[a, b] := *conversations{conv_id: c, turn: t}, *conversations{conv_id: c, turn: u}, u == t + 1, a = c * 1000 + t, b = c * 1000 + u "
SQL_TURNS = "e AS (SELECT DISTINCT x.conv_id * 1000 + x.turn AS a, y.conv_id * 1000 + y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"
#: Suppliers and the parts that they sell; a key is one node, whether a supplier or a part has it, so there are cycles.
SALES = "e[a, b] := *lineitem{l_suppkey: a, l_partkey: b} "
SQL_SALES = "e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)"
script("recursion_transitive_closure", TURNS + "t[a, b] := e[a, b] t[a, c] := t[a, b], e[b, c] ?[a, b] := t[a, b]", f"WITH RECURSIVE {SQL_TURNS}, t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t")
script("recursion_bound", SALES + "t[a, b] := e[a, b] t[a, c] := t[a, b], e[b, c] ?[b] := t[3, b]", f"WITH RECURSIVE {SQL_SALES}, t AS (SELECT a, b FROM e WHERE a = 3 UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT DISTINCT b FROM t")
script("recursion_nonlinear", TURNS + "t[a, b] := e[a, b] t[a, c] := t[a, b], t[b, c] ?[a, b] := t[a, b]", f"WITH RECURSIVE {SQL_TURNS}, t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t")
script("recursion_mutual", TURNS + "odd[a, b] := e[a, b] odd[a, c] := even[a, b], e[b, c] even[a, c] := odd[a, b], e[b, c] ?[a, b] := even[a, b]", f"WITH RECURSIVE {SQL_TURNS}, t AS (SELECT a, b, 1 AS o FROM e UNION SELECT t.a, e.b, 1 - t.o FROM t JOIN e ON t.b = e.a) SELECT DISTINCT a, b FROM t WHERE o = 0")
script("recursion_same_generation", "p[c, q] := *nation{n_nationkey: k, n_regionkey: r}, c = k + 100, q = r sg[x, y] := p[x, q], p[y, q], x != y sg[x, y] := p[x, a], sg[a, b], p[y, b] ?[x, y] := sg[x, y]", "SELECT x.n_nationkey + 100 AS x, y.n_nationkey + 100 AS y FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey")
script("recursion_negation", SALES + "t[b] := e[b, 3] t[c] := t[b], e[c, b] n[a] := e[a, _] n[b] := e[_, b] ?[a] := n[a], not t[a]", f"WITH RECURSIVE {SQL_SALES}, t AS (SELECT a AS b FROM e WHERE b = 3 UNION SELECT e.a FROM t JOIN e ON t.b = e.b) SELECT a FROM (SELECT a FROM e UNION SELECT b FROM e) WHERE a NOT IN (SELECT b FROM t)")
script("recursion_min_hops", SALES + "d[b, min(n)] := e[3, b], n = 1 d[c, min(n)] := d[b, m], e[b, c], n = m + 1 ?[b, n] := d[b, n]", f"WITH RECURSIVE {SQL_SALES}, t AS (SELECT b, CAST(1 AS BIGINT) AS n FROM e WHERE a = 3 UNION SELECT e.b, t.n + 1 FROM t JOIN e ON t.b = e.a WHERE t.n < 12) SELECT b, min(n) AS n FROM t GROUP BY 1")
script("recursion_shortest", SALES + "p[b, shortest(l)] := e[3, b], l = [3, b] p[c, shortest(l)] := p[b, m], e[b, c], l = append(m, c) ?[b, n] := p[b, l], n = length(l) - 1", f"WITH RECURSIVE {SQL_SALES}, t AS (SELECT b, CAST(1 AS BIGINT) AS n FROM e WHERE a = 3 UNION SELECT e.b, t.n + 1 FROM t JOIN e ON t.b = e.a WHERE t.n < 12) SELECT b, min(n) AS n FROM t GROUP BY 1")

# --- scalar functions ----------------------------------------------------------------------------------------

script("math_functions", "?[k, a, b, c, d, e] := *part{p_partkey: k, p_size: s, p_retailprice: p}, a = round(sqrt(p) * 10000), b = round(ln(s + 1) * 10000) + floor(p), c = s ^ 2, d = ceil(p / 7), e = (-s % 7) + abs(3 - s) + signum(s - 25)", "SELECT p_partkey AS k, round(sqrt(p_retailprice) * 10000) AS a, round(ln(p_size + 1) * 10000) + floor(p_retailprice) AS b, p_size::DOUBLE ^ 2 AS c, ceil(p_retailprice / 7) AS d, -p_size % 7 + abs(3 - p_size) + sign(p_size - 25) AS e FROM part")
script("math_trig", "?[k, a, b] := *supplier{s_suppkey: k}, a = round((sin(k) + cos(k) + atan2(k, 2) + tanh(k / 10)) * 100000), b = round(haversine_deg_input(k / 100, 10, 20, k) * 100000)", "SELECT s_suppkey AS k, round((sin(s_suppkey) + cos(s_suppkey) + atan2(s_suppkey, 2) + tanh(s_suppkey / 10)) * 100000) AS a, round(2 * asin(sqrt(sin(radians(20 - s_suppkey / 100) / 2) ^ 2 + cos(radians(s_suppkey / 100)) * cos(radians(20)) * sin(radians(s_suppkey - 10) / 2) ^ 2)) * 100000) AS b FROM supplier")
script("div_by_zero", "?[x, y] := x in [1, 0, -1], y = to_string(x / 0)", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Infinity'), (0, 'NaN'), (-1, '-Infinity')) t(x, y)")
script("string_functions", "?[k, u, n, s, p] := *part{p_partkey: k, p_name: x, p_type: t}, u = uppercase(x) ++ '-' ++ lowercase(t), n = length(x), s = slice_string(x, 1, 4), p = str_includes(t, 'E') || ends_with(x, '7')", "SELECT p_partkey AS k, upper(p_name) || '-' || lower(p_type) AS u, length(p_name) AS n, substr(p_name, 2, 3) AS s, contains(p_type, 'E') OR ends_with(p_name, '7') AS p FROM part")
script("regex_functions", "?[k, m, r, a, f] := *part{p_partkey: k, p_name: x}, m = regex_matches(x, '[0-9]{3}'), r = regex_replace(x, '[0-9]', '#'), a = regex_replace_all(x, '[0-9]', '#'), f = regex_extract_first(x, '[0-9]+')", "SELECT p_partkey AS k, regexp_matches(p_name, '[0-9]{3}') AS m, regexp_replace(p_name, '[0-9]', '#') AS r, regexp_replace(p_name, '[0-9]', '#', 'g') AS a, nullif(regexp_extract(p_name, '[0-9]+'), '') AS f FROM part")
script("list_functions", "?[k, a, b, c, d] := *nation{n_nationkey: k, n_regionkey: r}, l = [k, r, 3, k], a = length(union(l, [1])), b = get(sorted(l), -1), c = length(windows(l, 2)) + length(chunks(l, 3)), d = is_in(3, difference(l, [k])) ", "SELECT n_nationkey AS k, len(list_distinct([n_nationkey, n_regionkey, 3, n_nationkey, 1])) AS a, greatest(n_nationkey, n_regionkey, 3) AS b, 5 AS c, n_nationkey <> 3 AS d FROM nation")
script("json_functions", "?[k, t] := *nation{n_nationkey: k, n_name: n}, j = {'name': n, 'k': k}, t = dump_json(j)", "SELECT n_nationkey AS k, '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS t FROM nation")
script("time_functions", "?[k, t] := *orders{o_orderkey: k, o_orderdate: d}, t = round(to_float(d))", "SELECT o_orderkey AS k, round(epoch_us(o_orderdate) / 1e6) AS t FROM orders")
script("vector_functions", "?[k, a, b] := *embeddings{vec_id: k, embedding: v}, *embeddings{vec_id: 0, embedding: w}, a = round(l2_dist(v, w) * 1000), b = round(cos_dist(v, w) * 1000)", "SELECT x.vec_id AS k, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) * 1000) AS a, round((1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])) * 1000) AS b FROM embeddings x, embeddings y WHERE y.vec_id = 0")
script("conversion_functions", "?[k, a, b, c] := *nation{n_nationkey: k, n_name: n}, a = to_string(k), b = to_int(to_float(a) * 1.5), c = to_unity(k % 2)", "SELECT n_nationkey AS k, n_nationkey::VARCHAR AS a, trunc(n_nationkey * 1.5)::BIGINT AS b, (n_nationkey % 2)::BIGINT AS c FROM nation")

# --- graphs ------------------------------------------------------------------------------------------------------

SQL_G = "g AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)"


def supply(t) -> DataFrame:
    """Suppliers and their parts; a key is one node, whether a supplier or a part has it."""
    return distinct_rows(t("lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


@plan("graph_degree", f"WITH {SQL_G} SELECT node, count(*) AS total, sum(o)::BIGINT AS out, sum(i)::BIGINT AS \"in\" FROM (SELECT a AS node, 1 AS o, 0 AS i FROM g UNION ALL SELECT b, 0, 1 FROM g) GROUP BY 1")
def graph_degree(t, spark):
    return graph.degree_centrality(supply(t))


@plan("graph_connected_components", "WITH RECURSIVE g AS (SELECT n_nationkey AS a, n_nationkey + 5 AS b FROM nation), e AS (SELECT a, b FROM g UNION SELECT b, a FROM g), t AS (SELECT DISTINCT a AS node, a AS c FROM e UNION SELECT e.b, t.c FROM t JOIN e ON t.node = e.a) SELECT node, min(c) AS component FROM t GROUP BY 1")
def graph_components(t, spark):
    return graph.connected_components(t("nation").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 5).alias("b")))


@plan("graph_strong_components", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey > 15), t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a), n AS (SELECT a AS node FROM e UNION SELECT b FROM e) SELECT node, least(node, min(y.b)) AS component FROM n LEFT JOIN (SELECT x.a, x.b FROM t x JOIN t z ON x.a = z.b AND x.b = z.a) y ON y.a = node GROUP BY 1")
def graph_scc(t, spark):
    n = t("nation")
    k = F.col("n_nationkey")
    return graph.strongly_connected_components(n.select(k.alias("a"), ((k * 3 + 1) % 25).alias("b")).union(n.where(k > 15).select(k, F.floor(k / 2).cast("int"))))


_ranks = ", ".join(f"r{i} AS (SELECT n.v, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(sum(p.r / d.d), 0) AS r FROM n LEFT JOIN g ON g.b = n.v LEFT JOIN r{i - 1} p ON p.v = g.a LEFT JOIN d ON d.a = g.a GROUP BY 1)" for i in range(1, 6))


@plan("graph_pagerank", f"WITH {SQL_G}, n AS (SELECT a AS v FROM g UNION SELECT b FROM g), d AS (SELECT a, count(*) AS d FROM g GROUP BY 1), r0 AS (SELECT v, 1.0 / (SELECT count(*) FROM n) AS r FROM n), {_ranks} SELECT v AS node, round(r * 1e7) AS rank FROM r5")
def graph_pagerank(t, spark):
    return graph.pagerank(supply(t), epsilon=0.0, iterations=5).select("node", F.round(F.col("rank") * 1e7).alias("rank"))


@plan("graph_triangles", f"WITH {SQL_G}, e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM g WHERE a <> b), t AS (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b), d AS (SELECT v, count(*) AS d FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) GROUP BY 1), k AS (SELECT v, count(*) AS t FROM (SELECT unnest([a, b, c]) AS v FROM t) GROUP BY 1) SELECT d.v AS node, round(CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END * 1e6) AS cc, coalesce(t, 0) AS n_triangles, d AS degree FROM d LEFT JOIN k ON d.v = k.v")
def graph_triangles(t, spark):
    return graph.clustering(supply(t)).withColumn("cc", F.round(F.col("cc") * 1e6))


@plan("graph_expansion_2", f"WITH {SQL_G} SELECT DISTINCT y.b AS node FROM g x JOIN g y ON x.b = y.a WHERE x.a = 7")
def graph_expansion(t, spark):
    db = Session(spark)
    db.register("g", supply(t))
    return db.run("?[node] := *g{a: 7, b: x}, *g{a: x, b: node}")


@plan("graph_bfs_hops", f"WITH RECURSIVE {SQL_G}, t AS (SELECT CAST(7 AS BIGINT) AS node, 0 AS hops UNION SELECT g.b, hops + 1 FROM t JOIN g ON t.node = g.a WHERE hops < 30) SELECT node, min(hops) AS hops FROM t GROUP BY 1")
def graph_bfs(t, spark):
    return graph.reachable(supply(t), spark.createDataFrame([(7,)], "a long"))


WEIGHTED = "w AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b, (n_nationkey % 5 + 1)::DOUBLE AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, 2.5 FROM nation)"


def weighted(t) -> DataFrame:
    n, k = t("nation"), F.col("n_nationkey")
    return n.select(k.alias("a"), ((k * 7 + 3) % 25).alias("b"), (k % 5 + 1).cast("double").alias("w")).unionAll(n.select(k, (k + 1) % 25, F.lit(2.5)))


@plan("graph_dijkstra", f"WITH RECURSIVE {WEIGHTED}, t AS (SELECT 0 AS node, 0.0::DOUBLE AS cost, 0 AS n UNION SELECT w.b, t.cost + w.w, n + 1 FROM t JOIN w ON t.node = w.a WHERE n < 12) SELECT 0 AS start, node AS \"end\", min(cost) AS cost FROM t GROUP BY 2")
def graph_dijkstra(t, spark):
    return graph.shortest_paths(weighted(t), t("nation").where("n_nationkey = 0").select("n_nationkey")).drop("path")


SIMPLE_PATHS = f"{WEIGHTED}, p AS (SELECT 0 AS node, 0.0::DOUBLE AS cost, ['0'] AS path UNION ALL SELECT w.b, cost + w.w, list_append(path, w.b::VARCHAR) FROM p JOIN w ON p.node = w.a WHERE NOT list_contains(path, w.b::VARCHAR) AND len(path) < 12)"


@plan("graph_yen", f"WITH RECURSIVE {SIMPLE_PATHS} SELECT start, \"end\", cost FROM (SELECT 0 AS start, node AS \"end\", cost, row_number() OVER (PARTITION BY node ORDER BY cost) AS i FROM (SELECT node, path, min(cost) AS cost FROM p GROUP BY 1, 2) WHERE node IN (9, 20)) WHERE i <= 3")
def graph_yen(t, spark):
    n = t("nation").select("n_nationkey")
    return graph.k_shortest_paths(weighted(t), n.where("n_nationkey = 0"), n.where("n_nationkey in (9, 20)"), 3).drop("path")


#: An edge is in the forest of least weight unless edges that come before it connect its ends.
SQL_FOREST = f"WITH RECURSIVE {WEIGHTED}, u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS w FROM w WHERE a <> b GROUP BY 1, 2), r AS (SELECT u.a AS a, u.b AS b, u.w AS w, u.a AS node FROM u UNION SELECT r.a, r.b, r.w, CASE WHEN u.a = r.node THEN u.b ELSE u.a END FROM r JOIN u ON (u.w, u.a, u.b) < (r.w, r.a, r.b) AND r.node IN (u.a, u.b)) SELECT a AS \"from\", b AS \"to\", w AS cost FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = u.a AND r.b = u.b AND r.node = u.b)"


@plan("graph_spanning_forest", SQL_FOREST)
def graph_forest(t, spark):
    return graph.minimum_spanning_forest(weighted(t))


@plan("graph_spanning_tree", SQL_FOREST)
def graph_prim(t, spark):
    db = Session(spark)
    db.register("w", weighted(t))
    return db.run("w[a, b, w] := *w{a, b, w} ?[a, b, c] <~ MinimumSpanningTreePrim(w[a, b, w])").toDF("from", "to", "cost")


@plan("graph_top_sort", "SELECT n_nationkey::BIGINT AS idx, n_nationkey AS node FROM nation UNION ALL SELECT 25, 25")
def graph_top_sort(t, spark):
    return graph.top_sort(t("nation").select("n_nationkey", (F.col("n_nationkey") + 1).alias("b")))


#: All shortest paths, and for each inner node the share of its pair's paths that it lies on.
SQL_BETWEENNESS = f"WITH RECURSIVE {WEIGHTED}, t AS (SELECT n_nationkey AS s, n_nationkey AS node, 0.0::DOUBLE AS cost, 0 AS n FROM nation UNION SELECT s, w.b, t.cost + w.w, n + 1 FROM t JOIN w ON t.node = w.a WHERE n < 9), d AS (SELECT s, node, min(cost) AS c FROM t GROUP BY 1, 2), p AS (SELECT n_nationkey AS s, n_nationkey AS node, 0.0::DOUBLE AS cost, [n_nationkey] AS path FROM nation UNION ALL SELECT p.s, w.b, p.cost + w.w, list_append(p.path, w.b) FROM p JOIN w ON p.node = w.a JOIN d ON d.s = p.s AND d.node = w.b AND d.c = p.cost + w.w), k AS (SELECT s, node, count(*) AS k FROM p GROUP BY 1, 2), i AS (SELECT v, 1.0::DOUBLE / k AS share FROM (SELECT s, node, unnest(path[2:-2]) AS v FROM p WHERE s <> node) JOIN k USING (s, node)) SELECT n_nationkey AS node, coalesce(round(sum(share), 6), 0) AS score FROM nation LEFT JOIN i ON v = n_nationkey GROUP BY 1"


@plan("graph_betweenness", SQL_BETWEENNESS)
def graph_betweenness(t, spark):
    return graph.betweenness_centrality(weighted(t)).withColumn("score", F.round("score", 6))


@plan("graph_closeness", f"WITH RECURSIVE {WEIGHTED}, t AS (SELECT n_nationkey AS s, n_nationkey AS node, 0.0::DOUBLE AS cost, 0 AS n FROM nation UNION SELECT s, w.b, t.cost + w.w, n + 1 FROM t JOIN w ON t.node = w.a WHERE n < 9), d AS (SELECT s, node, min(cost) AS c FROM t GROUP BY 1, 2) SELECT s AS node, round(count(*) * count(*) / sum(c) / 24 * 1e6) AS c FROM d GROUP BY 1")
def graph_closeness(t, spark):
    return graph.closeness_centrality(weighted(t)).withColumn("c", F.round(F.col("c") * 1e6))


_votes = ", ".join(f"l{i} AS (SELECT l.node, coalesce(v.label, l.label) AS label FROM l{i - 1} l LEFT JOIN (SELECT a, arg_min(label, (-w, label)) AS label FROM (SELECT e.a, l.label, sum(e.w) AS w FROM e JOIN l{i - 1} l ON l.node = e.b GROUP BY 1, 2) GROUP BY 1) v ON v.a = l.node)" for i in range(1, 11))


@plan("graph_label_propagation", f"WITH {WEIGHTED}, e AS (SELECT a, b, w FROM w UNION ALL SELECT b, a, w FROM w), l0 AS (SELECT n_nationkey AS node, n_nationkey AS label FROM nation), {_votes} SELECT label, node FROM l10")
def graph_lpa(t, spark):
    return graph.label_propagation(weighted(t), undirected=True)


@plan("graph_louvain", "SELECT n_nationkey AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS community FROM nation")
def graph_louvain(t, spark):
    """Nations of a region know each other well, and the next region's a little: the regions are the communities."""
    n, k = t("nation"), F.col("n_nationkey")
    other = n.toDF("b", "_name", "r")
    edges = n.join(other, F.col("n_regionkey") == F.col("r")).where("n_nationkey < b").select(k.alias("a"), "b", F.lit(1.0).alias("w"))
    edges = edges.unionAll(n.where("n_nationkey < 24").select(k, k + 1, F.lit(0.1)))
    groups = graph.louvain(edges, undirected=True).select("node", F.element_at("labels", 1).alias("c"))
    least = groups.groupBy("c").agg(F.min("node").alias("community"))
    return groups.join(least, "c").select("node", "community")


@plan("graph_random_walk", "SELECT n_nationkey AS start, 2::BIGINT AS walks, 10::BIGINT AS steps FROM nation")
def graph_walk(t, spark):
    """From each node two walks of five steps, each step along an edge."""
    edges = weighted(t)
    walks = graph.random_walk(edges, t("nation").select("n_nationkey"), 5, 2)
    steps = walks.select("walk_id", "start", F.posexplode("path").alias("i", "x"), "path").where(F.col("i") > 0).withColumn("before", F.element_at("path", F.col("i")))
    along = steps.join(edges.select(F.col("a").alias("before"), F.col("b").alias("x")).distinct(), ["before", "x"])
    return along.groupBy("start").agg(F.count_distinct("walk_id").alias("walks"), F.count(F.lit(1)).alias("steps"))


@plan("graph_bfs_search", f"WITH RECURSIVE {WEIGHTED}, p AS (SELECT 0 AS node, [0] AS path UNION ALL SELECT w.b, list_append(path, w.b) FROM p JOIN w ON p.node = w.a WHERE len(path) < 9), f AS (SELECT node, arg_min(path, (len(path), path)) AS path FROM p GROUP BY 1) SELECT 0 AS start, node AS goal, array_to_string(path, ',') AS path FROM f WHERE node > 20 ORDER BY len(path), path LIMIT 2")
def graph_bfs_search(t, spark):
    n = t("nation").select("n_nationkey")
    return graph.breadth_first(weighted(t), n, n.where("n_nationkey = 0"), lambda d: d["n_nationkey"] > 20, 2).withColumn("path", F.array_join("path", ","))


@plan("graph_dfs_search", "SELECT 0 AS start, g AS goal, array_to_string(range(0, g + 1), ',') AS path FROM (VALUES (21), (22)) t(g)")
def graph_dfs_search(t, spark):
    """Along the edges to the next key, which an unlucky branch to a node without a goal leaves at every fifth."""
    n, k = t("nation").select("n_nationkey"), F.col("n_nationkey")
    edges = n.select(k, k + 1).unionAll(n.where(k % 5 == 0).select(k, k - 100))
    return graph.depth_first(edges, n, n.where("n_nationkey = 0"), lambda d: d["n_nationkey"] > 20, 2).withColumn("path", F.array_join("path", ","))


@plan("graph_a_star", f"WITH RECURSIVE {WEIGHTED}, t AS (SELECT 0 AS node, 0.0::DOUBLE AS cost, 0 AS n UNION SELECT w.b, t.cost + w.w, n + 1 FROM t JOIN w ON t.node = w.a WHERE n < 12) SELECT 0 AS start, node AS goal, min(cost) AS cost FROM t WHERE node IN (9, 20) GROUP BY 2")
def graph_a_star(t, spark):
    n = t("nation").select("n_nationkey")
    goals = n.where("n_nationkey in (9, 20)")
    # no edge is cheaper than one: a bound for each node but the goal
    h = n.crossJoin(goals.withColumnRenamed("n_nationkey", "goal")).select(F.col("n_nationkey").alias("node"), "goal", F.when(F.col("n_nationkey") == F.col("goal"), 0.0).otherwise(1.0).alias("h"))
    return graph.a_star(weighted(t), n.where("n_nationkey = 0"), goals, h).drop("path")


@plan("graph_shortest_path_bfs", f"WITH RECURSIVE {WEIGHTED}, t AS (SELECT 0 AS node, 0 AS n UNION SELECT w.b, n + 1 FROM t JOIN w ON t.node = w.a WHERE n < 12) SELECT 0 AS start, node AS \"end\", min(n) + 1 AS nodes FROM t WHERE node IN (9, 20) GROUP BY 2")
def graph_spbfs(t, spark):
    n = t("nation").select("n_nationkey")
    return graph.shortest_path_bfs(weighted(t), n.where("n_nationkey = 0"), n.where("n_nationkey in (9, 20)")).select("start", "end", F.size("path").alias("nodes"))


# --- stored relations ----------------------------------------------------------------------------------------------

MAKE = "?[k, name, r] := *nation{n_nationkey: k, n_name: name, n_regionkey: r} :create n {k: Int => name: String, r: Int}"
script("put_upsert", "?[k, name, r] := *n{k, name, r}", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey > 20 THEN 'new' ELSE n_name END AS name, n_regionkey::BIGINT AS r FROM nation UNION ALL SELECT 99, 'added', 1", setup=[MAKE, "?[k, name, r] := *nation{n_nationkey: k, n_regionkey: r}, k > 20, name = 'new' c[k, name, r] <- [[99, 'added', 1]] ?[k, name, r] := c[k, name, r] :put n {k => name, r}"])
script("rm_rows", "?[k, r] := *n{k, r}", "SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS r FROM nation WHERE n_regionkey <> 2", setup=[MAKE, "?[k] := *n{k, r: 2} :rm n {k}"])
script("update_rows", "?[k, name, r] := *n{k, name, r}", "SELECT n_nationkey::BIGINT AS k, n_name AS name, CASE WHEN n_nationkey < 5 THEN 7 ELSE n_regionkey END::BIGINT AS r FROM nation", setup=[MAKE, "?[k, r] := *n{k}, k < 5, r = 7 :update n {k => r}"])
script("imperative_loop", "{?[x] <- [[1]] :create _t {x}} %loop {?[x] := *_t{x: y}, x = y + 1, x < 6 :put _t {x}} %if {?[x] := *_t{x}, x == 5} %then %break %end %end %return {?[x] := *_t{x}}", "SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS x")

from tesserae import queries_functions, queries_store  # noqa: E402, F401  they register theirs

__all__ = ["ORACLE_SQL", "QUERIES"]
