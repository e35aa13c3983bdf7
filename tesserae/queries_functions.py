"""Queries of scalar functions and aggregates, with the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.registry import plan, script

# --- numbers --------------------------------------------------------------------------------------------

script("math_exponential", "?[k, a, b, c, d] := *part{p_partkey: k, p_size: s, p_retailprice: p}, a = round(exp(s / 25) * 1000), b = exp2(s % 10), c = round(log2(p) * 10000), d = round(log10(p) * 10000)", "SELECT p_partkey AS k, round(exp(p_size / 25) * 1000) AS a, 2::DOUBLE ^ (p_size % 10) AS b, round(log2(p_retailprice) * 10000) AS c, round(log10(p_retailprice) * 10000) AS d FROM part")
_ANGLES = ("tan", "asin", "acos", "atan", "sinh", "cosh", "asinh", "atanh")
script("math_angles", "?[k, " + ", ".join(f"v_{f}" for f in _ANGLES) + ", v_acosh, v_rad, v_deg] := *part{p_partkey: k, p_size: s}, x = s / 100, " + ", ".join(f"v_{f} = round({f}(x) * 100000)" for f in _ANGLES) + ", v_acosh = round(acosh(x + 1) * 100000), v_rad = round(deg_to_rad(x) * 1000000), v_deg = round(rad_to_deg(x) * 1000)", "SELECT p_partkey AS k, " + ", ".join(f"round({f}(p_size / 100) * 100000) AS v_{f}" for f in _ANGLES) + ", round(acosh(p_size / 100 + 1) * 100000) AS v_acosh, round(radians(p_size / 100) * 1000000) AS v_rad, round(degrees(p_size / 100) * 1000) AS v_deg FROM part")
script("math_haversine", "?[k, d] := *supplier{s_suppkey: k}, d = round(haversine(k / 100, 0.5, 0.25, k / 50) * 100000)", "SELECT s_suppkey AS k, round(2 * asin(sqrt(sin((0.25 - s_suppkey / 100) / 2) ^ 2 + cos(s_suppkey / 100) * cos(0.25) * sin((s_suppkey / 50 - 0.5) / 2) ^ 2)) * 100000) AS d FROM supplier")
script("math_least_greatest", "?[k, a, b] := *part{p_partkey: k, p_size: s}, a = max(s, 25, k % 60), b = min(s, 25, k % 60)", "SELECT p_partkey AS k, greatest(p_size, 25, p_partkey % 60) AS a, least(p_size, 25, p_partkey % 60) AS b FROM part")
script("comparisons", "?[k, a, b, c, d, e] := *part{p_partkey: k, p_size: s, p_type: t}, a = s >= 10 && s <= 20, b = ge(s, 30) || le(s, 5), c = !(s > 25), d = negate(t == 'ECONOMY'), e = assert(s >= 0, 'a size')", "SELECT p_partkey AS k, p_size >= 10 AND p_size <= 20 AS a, p_size >= 30 OR p_size <= 5 AS b, NOT p_size > 25 AS c, p_type <> 'ECONOMY' AS d, true AS e FROM part")
script("boolean_functions", "?[k, a, b] := *part{p_partkey: k, p_size: s}, a = and(s > 10, s < 40, k % 2 == 0), b = or(s < 10, s > 40, k % 3 == 0)", "SELECT p_partkey AS k, p_size > 10 AND p_size < 40 AND p_partkey % 2 = 0 AS a, p_size < 10 OR p_size > 40 OR p_partkey % 3 = 0 AS b FROM part")
script("operator_precedence", "?[k, a, b, c, d] := *nation{n_nationkey: k}, a = 1 + 2 * k - 3, b = -k ^ 2 + 10 % 4, c = k > 3 || k < 1 && k == 0, d = 2 * (k + 1) ^ 2", "SELECT n_nationkey AS k, 1 + 2 * n_nationkey - 3 AS a, ((n_nationkey * n_nationkey + 10) % 4)::DOUBLE AS b, n_nationkey > 3 OR n_nationkey < 1 AND n_nationkey = 0 AS c, 2 * (n_nationkey + 1)::DOUBLE ^ 2 AS d FROM nation")
script("literals", "# a comment\n?[k, h, f, s, r, n] := *region{r_regionkey: k}, /* and /* a nested */ one */ h = 0x1f + 0b101 + 0o17 + 1_000, f = 1.5e2, s = 'it\\'s \\u00e9', r = ___\"a\"b\"___, n = null", "SELECT r_regionkey AS k, CAST(1051 AS BIGINT) AS h, 150.0::DOUBLE AS f, 'it''s é' AS s, 'a\"b' AS r, NULL AS n FROM region", shape=lambda df: df.withColumn("n", F.col("n").cast("int")))
script("parameters", "?[k, t] := *orders{o_orderkey: k, o_totalprice: t, o_orderpriority: $p}, t > $least, k in $some", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 1000.5 AND o_orderkey % 2 = 0 AND o_orderkey < 100", params={"p": "2-HIGH", "least": 1000.5, "some": list(range(0, 100, 2))})
script("wildcards", "?[p] := *orders{o_orderpriority: p, o_custkey: _, o_orderkey: _}", "SELECT DISTINCT o_orderpriority AS p FROM orders")
script("multi_unification", "?[a, b] := *region{r_regionkey: a}, b in [a, a * 2], b == a * 2", "SELECT r_regionkey AS a, r_regionkey * 2 AS b FROM region")

# --- bytes ------------------------------------------------------------------------------------------------

_BYTE = "bits = [k % 2 == 1, k > 10, k % 3 == 0, false, true], b = pack_bits(bits), other = decode_base64('qg==')"
_INT = "((n_nationkey % 2) * 128 + (n_nationkey > 10)::INT * 64 + (n_nationkey % 3 = 0)::INT * 32 + 8)"
script("bit_functions", f"?[k, p, a, o, x, n, u] := *nation{{n_nationkey: k}}, {_BYTE}, p = encode_base64(b), a = encode_base64(bit_and(b, other)), o = encode_base64(bit_or(b, other)), x = encode_base64(bit_xor(b, other)), n = encode_base64(bit_not(b)), u = to_string(unpack_bits(b))", "SELECT k, to_base64(unhex(printf('%02X', v))) AS p, to_base64(unhex(printf('%02X', v & 170))) AS a, to_base64(unhex(printf('%02X', v | 170))) AS o, to_base64(unhex(printf('%02X', xor(v, 170)))) AS x, to_base64(unhex(printf('%02X', 255 - v))) AS n, '[' || array_to_string(list_transform(range(7, -1, -1), lambda i: ((v >> i) & 1 = 1)::VARCHAR), ',') || ']' AS u FROM (SELECT n_nationkey AS k, " + _INT + " AS v FROM nation)")
script("agg_bits", f"g[r, bit_and(b), bit_or(b), bit_xor(b)] := *nation{{n_nationkey: k, n_regionkey: r}}, {_BYTE} ?[r, a, o, x] := g[r, p, q, s], a = encode_base64(p), o = encode_base64(q), x = encode_base64(s)", "SELECT r, to_base64(unhex(printf('%02X', bit_and(v)))) AS a, to_base64(unhex(printf('%02X', bit_or(v)))) AS o, to_base64(unhex(printf('%02X', bit_xor(v)))) AS x FROM (SELECT n_regionkey AS r, " + _INT + " AS v FROM nation) GROUP BY 1")
script("agg_choice_rand", "g[r, choice_rand(k), unique(k)] := *nation{n_nationkey: k, n_regionkey: r} ?[r, ok] := g[r, x, all], ok = is_in(x, all)", "SELECT DISTINCT n_regionkey AS r, true AS ok FROM nation")

# --- strings ------------------------------------------------------------------------------------------------

script("string_trims", "?[k, a, b, c, d] := *part{p_partkey: k, p_name: n}, x = ' \\t\u3000' ++ n ++ '\u3000 \\n', a = trim(x), b = length(trim_start(x)), c = length(trim_end(x)), d = starts_with(n, 'small')", "SELECT p_partkey AS k, p_name AS a, length(p_name) + 3 AS b, length(p_name) + 3 AS c, starts_with(p_name, 'small') AS d FROM part")
script("regex_extraction", "?[k, all, first, none] := *supplier{s_suppkey: k, s_name: n}, all = from_substrings(regex_extract(n, '[1-9]')), first = regex_extract_first(n, '[1-9][0-9]*'), none = length(regex_extract(n, 'zz+'))", "SELECT s_suppkey AS k, array_to_string(regexp_extract_all(s_name, '[1-9]'), '') AS \"all\", nullif(regexp_extract(s_name, '[1-9][0-9]*'), '') AS first, 0::BIGINT AS none FROM supplier")
script("unicode_forms", "?[c, t, a, b] := *conversations{conv_id: c, turn: t, text: x}, a = unicode_normalize(x, 'nfc') == x, b = length(unicode_normalize(x, 'nfd')) >= length(unicode_normalize(x, 'nfc'))", "SELECT conv_id AS c, turn AS t, nfc_normalize(text) = text AS a, true AS b FROM conversations")
script("unicode_constants", "c[i, x] <- [[1, 'é'], [2, 'ﬁ'], [3, '①']] ?[i, d, k, n] := c[i, x], d = length(unicode_normalize(x, 'nfd')), k = unicode_normalize(x, 'nfkc'), n = length(unicode_normalize(x, 'nfkd'))", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(2 AS BIGINT), 'é', CAST(2 AS BIGINT)), (2, 1, 'fi', 2), (3, 1, '1', 1)) t(i, d, k, n)")
script("simplified_characters", "c[i, x] <- [[1, '國學'], [2, '會說 abc'], [3, '龍門']] ?[i, y] := c[i, x], y = t2s(x)", "SELECT i, translate(x, '國學會說龍門', '国学会说龙门') AS y FROM (VALUES (CAST(1 AS BIGINT), '國學'), (2, '會說 abc'), (3, '龍門')) t(i, x)")

# --- types ------------------------------------------------------------------------------------------------------

_TYPES = "is_null is_int is_float is_num is_string is_list is_vec is_bytes is_uuid is_json is_finite is_infinite is_nan".split()
script("type_predicates", "?[k, " + ", ".join(f"p_{n}, e_{n}" for n in _TYPES) + "] := *part{p_partkey: k, p_name: n, p_retailprice: p}, *embeddings{vec_id: k, embedding: v}, " + ", ".join(f"p_{n} = {n}(p), e_{n} = {n}({'n' if n in ('is_string', 'is_bytes', 'is_uuid', 'is_json') else 'v' if n in ('is_list', 'is_vec') else 'k'})" for n in _TYPES), "SELECT p_partkey AS k, " + ", ".join(f"{'true' if n in ('is_float', 'is_num', 'is_finite') else 'false'} AS p_{n}, {'true' if n in ('is_int', 'is_num', 'is_string', 'is_list', 'is_vec', 'is_finite') else 'false'} AS e_{n}" for n in _TYPES) + " FROM part JOIN embeddings ON vec_id = p_partkey")
script("type_predicates_special", "c[i, x] <- [[1, 1.5], [2, null]] ?[i, n, f, g, h, b, u, j] := c[i, x], n = is_null(x), f = is_infinite(1 / 0.0 * i), g = is_nan(to_float('NAN') + i), h = is_finite(to_float('INF')), b = is_bytes(decode_base64('AA==')), u = is_uuid(to_uuid('00000000-0000-4000-8000-000000000000')), j = is_json(json(i))", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), false, true, true, false, true, true, true), (2, true, true, true, false, true, true, true)) t(i, n, f, g, h, b, u, j)")
script("to_bool_uuid", "?[k, a, b, c, u] := *nation{n_nationkey: k, n_name: n}, a = to_bool(k % 2), b = to_bool(n), c = to_bool(''), u = to_string(to_uuid('00000000-0000-4000-8000-0000000000' ++ slice_string(to_string(k + 100), 1, 3)))", "SELECT n_nationkey AS k, n_nationkey % 2 <> 0 AS a, n_name <> '' AS b, false AS c, ('00000000-0000-4000-8000-0000000000' || substr((n_nationkey + 100)::VARCHAR, 2, 2))::UUID::VARCHAR AS u FROM nation")

# --- lists -----------------------------------------------------------------------------------------------------------

script("list_building", "?[k, p, r, l, e, m, s, i, n, q] := *nation{n_nationkey: k, n_regionkey: r0}, x = list(k, r0, 7), y = append(x, 9), p = first(prepend(y, -1)), r = first(reverse(y)), l = last(y), e = length(chunks_exact(y, 3)), m = y -> 10, s = first(slice(y, 1, -1)), i = length(int_range(2, 20, 3)) + length(int_range(k)) + length(int_range(3, k)), n = first(intersection([k, 7, 9], y)), q = last(int_range(5, 0, -2))", "SELECT n_nationkey AS k, -1::BIGINT AS p, 9::BIGINT AS r, 9::BIGINT AS l, 1::BIGINT AS e, NULL::BIGINT AS m, n_regionkey::BIGINT AS s, 6 + n_nationkey + greatest(n_nationkey - 3, 0) AS i, least(n_nationkey, 7)::BIGINT AS n, 1::BIGINT AS q FROM nation")

# --- JSON ------------------------------------------------------------------------------------------------------------

script("json_paths", "?[e, k, t, s, r, m, g] := *events{event_id: e, props: p, user_id: u}, j = parse_json(p), k = json_to_scalar(j -> 'k'), t = dump_json(json(u)), s = dump_json(set_json_path(j, ['a', 'b'], u)), r = dump_json(remove_json_path(j, ['k'])), m = dump_json(j ++ {'u': u}), g = to_int(to_string(get(j, 'k')))", "SELECT event_id AS e, json_extract_string(props, '$.k') AS k, user_id::VARCHAR AS t, '{\"a\":{\"b\":' || user_id || '},\"k\":' || json_extract_string(props, '$.k') || '}' AS s, '{}' AS r, '{\"k\":' || json_extract_string(props, '$.k') || ',\"u\":' || user_id || '}' AS m, json_extract_string(props, '$.k')::BIGINT AS g FROM events")

# --- vectors -----------------------------------------------------------------------------------------------------------

script("vector_building", "?[k, n, i, s] := *embeddings{vec_id: k, embedding: v}, u = l2_normalize(vec(v, 'F64')), n = round(ip_dist(u, u) * 1000000), i = round(ip_dist(vec(v, 'F64'), u) * 1000), s = length(vec([1, 2, k]))", "SELECT vec_id AS k, 0.0::DOUBLE AS n, round((1 - sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) * 1000) AS i, 3::BIGINT AS s FROM embeddings", shape=lambda df: df.withColumn("n", F.abs("n")))

# --- random values, ids, times --------------------------------------------------------------------------------------------

script("random_functions", "?[k, a, b, c, d, e, f, g, h] := *nation{n_nationkey: k}, x = rand_float(), a = x >= 0.0 && x < 1.0, b = rand_bernoulli(1.0), c = rand_bernoulli(0.0), y = rand_int(3, 5), d = y >= 3 && y <= 5, e = rand_choose([k]) == k, f = length(to_string(rand_uuid_v4())), g = length(to_string(rand_uuid_v1())), h = length(rand_vec(5))", "SELECT n_nationkey AS k, true AS a, true AS b, false AS c, true AS d, true AS e, 36::BIGINT AS f, 36::BIGINT AS g, 5::BIGINT AS h FROM nation")
_UUID = "(('0x' || substr(u, 16, 3) || substr(u, 10, 4) || substr(u, 1, 8))::BIGINT - 122192928000000000)"
script("uuid_timestamps", "c[u] <- [['c232ab00-9414-11ec-b3c8-9f6bdeced846'], ['f81d4fae-7dec-11d0-a765-00a0c91e6bf6'], ['00000000-0000-4000-8000-000000000000']] ?[u, t] := c[u], t = round(uuid_timestamp(to_uuid(u)))", f"SELECT u, CASE WHEN substr(u, 15, 1) = '1' THEN round({_UUID} / 1e7) END AS t FROM (VALUES ('c232ab00-9414-11ec-b3c8-9f6bdeced846'), ('f81d4fae-7dec-11d0-a765-00a0c91e6bf6'), ('00000000-0000-4000-8000-000000000000')) t(u)")
script("time_texts", "?[e, t, z, b, n] := *events{event_id: e, ts: d}, s = to_float(d), t = format_timestamp(s), z = format_timestamp(s, 'Asia/Tokyo'), b = abs(parse_timestamp(t) - s) < 0.0011, n = now() > s", "SELECT event_id AS e, CASE WHEN date_part('millisecond', ts) % 1000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.') || printf('%03d', (epoch_us(ts) // 1000) % 1000) END || '+00:00' AS t, CASE WHEN date_part('millisecond', ts) % 1000 = 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S.') || printf('%03d', (epoch_us(ts) // 1000) % 1000) END || '+09:00' AS z, true AS b, true AS n FROM events")


@plan("evaluate_expressions", "SELECT * FROM (VALUES ('1 + 2 * 3', '7.0'), ('length(concat(''a'', ''bc''))', '3.0'), ('round(2.5)', '3.0')) t(e, v)")
def evaluate_expressions(t, spark):
    """Expressions without a query."""
    from tesserae.session import Session

    db = Session(spark)
    texts = ["1 + 2 * 3", "length(concat('a', 'bc'))", "round(2.5)"]
    return spark.createDataFrame([(x, str(float(db.evaluate(x)))) for x in texts], "e string, v string")
