"""Queries of stored relations, system operations, readers, search options and the interface, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tesserae.plans.ir import EngineError
from tesserae.plans.parser import parse
from tesserae.registry import plan, script
from tesserae.session import NamedRows, Session
from tesserae.storage import shared_dir

# --- mutations ----------------------------------------------------------------------------------------------

MAKE = "?[k, name, r] := *nation{n_nationkey: k, n_name: name, n_regionkey: r} :create n {k: Int => name: String, r: Int}"
ALL = "SELECT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey::BIGINT AS r FROM nation"
script("insert_rows", "?[k, name, r] := *n{k, name, r}", ALL + " UNION ALL SELECT n_nationkey + 100, n_name, 9 FROM nation WHERE n_regionkey = 1", setup=[MAKE, "?[k, name, r] := *nation{n_nationkey: x, n_name: name, n_regionkey: 1}, k = x + 100, r = 9 :insert n {k => name, r}"])
script("insert_refuses_keys", "?[k, name, r] := *n{k, name, r}", ALL, setup=[MAKE, "%ignore_error {?[k, name, r] <- [[200, 'new', 1], [3, 'there', 1]] :insert n {k => name, r}}"])
script("delete_rows", "?[k, r] := *n{k, r}", "SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS r FROM nation WHERE n_regionkey <> 3", setup=[MAKE, "?[k] := *n{k, r: 3} :delete n {k}", "%ignore_error {?[k] <- [[1], [999]] :delete n {k}}"])
script("ensure_rows", "?[k, name, r] := *n{k, name, r}", ALL + " UNION ALL SELECT 300, 'ensured', 1 UNION ALL SELECT 302, 'absent', 1", setup=[MAKE, "{?[k, name, r] := *nation{n_nationkey: k, n_name: name, n_regionkey: r}, k < 9 :ensure n {k => name, r}} {?[k, name, r] <- [[300, 'ensured', 1]] :put n {k => name, r}}", "%ignore_error {?[k, name, r] <- [[1, 'other', 1]] :ensure n {k => name, r}}", "{?[k] <- [[302]] :ensure_not n {k}} {?[k, name, r] <- [[302, 'absent', 1]] :put n {k => name, r}}", "%ignore_error {?[k] <- [[5]] :ensure_not n {k}}"])
script("replace_relation", "?[k, x] := *n{k, x}", "SELECT n_nationkey::BIGINT AS k, n_name || '!' AS x FROM nation WHERE n_regionkey = 4", setup=[MAKE, "?[k, x] := *nation{n_nationkey: k, n_name: n, n_regionkey: 4}, x = n ++ '!' :replace n {k: Int => x: String}"])
script("column_defaults", "?[k, a, b, c] := *d{k, a, b, c}", "SELECT n_nationkey::BIGINT AS k, 7::BIGINT AS a, n_regionkey::DOUBLE AS b, n_name || 'x' AS c FROM nation", setup=["?[k, b, name] := *nation{n_nationkey: k, n_regionkey: b, n_name: n}, name = n ++ 'x' :create d {k: Int => a: Int default 7, b: Float, c: String = name}"])
script("coercions", "?[k, a, b, c, d] := *d{k, a, b: x, c, v}, b = encode_base64(x), d = round(get(v, 1) * 10)", "SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS a, 'AQID' AS b, NULL::VARCHAR AS c, round(n_nationkey * 5.0::DOUBLE) AS d FROM nation", setup=["?[k, a, b, c, v] := *nation{n_nationkey: k, n_regionkey: r}, a = r * 1.0, b = 'AQID', c = null, v = [0.5, k / 2] :create d {k: Int => a: Int, b: Bytes, c: String?, v: <F64; 2>}"])
script("triggers", "?[k, what] := *log{k, what}", "SELECT n_nationkey::BIGINT AS k, 'put' AS what FROM nation WHERE n_nationkey > 20 UNION ALL SELECT n_nationkey, 'rm' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, 'old' FROM nation WHERE n_nationkey > 20", setup=[MAKE, "?[k, what] <- [[0, '']] :create log {k: Int, what: String}", "?[k, what] <- [[0, '']] :rm log {k, what}", "::set_triggers n on put { ?[k, what] := _new[k, _, _], what = 'put' :put log {k, what} } on put { ?[k, what] := _old[k, _, _], what = 'old' :put log {k, what} } on rm { ?[k, what] := _old[k, _, _], what = 'rm' :put log {k, what} }", "?[k, name, r] := *nation{n_nationkey: k, n_name: name, n_regionkey: r}, k > 20 :put n {k => name, r}", "?[k] := *n{k, r: 2} :rm n {k}"])
script("returning_rows", "?[k, name, r] := *nation{n_nationkey: k, n_regionkey: r}, k > 20, name = 'new' c[k, name, r] <- [[99, 'added', 1]] ?[k, name, r] := c[k, name, r] :put n {k => name, r} :returning", "SELECT 'inserted' AS _kind, n_nationkey::BIGINT AS k, 'new' AS name, n_regionkey::BIGINT AS r FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 'inserted', 99, 'added', 1 UNION ALL SELECT 'replaced', n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey > 20", setup=[MAKE])
script("assert_options", "?[k] := *nation{n_nationkey: k, n_regionkey: 1} :assert some :timeout 60 :sleep 0.01", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1", setup=["?[k] := *nation{n_nationkey: k, n_regionkey: 99} :assert none", "%ignore_error {?[k] := *nation{n_nationkey: k} :assert none}"])
script("without_magic_rewrite", "e[a, b] := *nation{n_nationkey: a}, b = a + 1 t[a, b] := e[a, b] t[a, c] := t[a, b], e[b, c] ?[b] := t[20, b] :disable_magic_rewrite true", "SELECT unnest([21, 22, 23, 24, 25]) AS b")
script("retraction", "?[u, e] := *h{u, e @ 'NOW'}", "SELECT user_id AS u, max(event_id) AS e FROM events GROUP BY 1 HAVING user_id % 3 <> 0", setup=["s[u, max(e)] := *events{event_id: e, user_id: u} ?[u, at, e] := s[u, e], at = validity(1000) :create h {u: Int, at: Validity => e: Int}", "s[u, max(e)] := *events{event_id: e, user_id: u}, u % 3 == 0 ?[u, at, e] := s[u, e], at = validity(2000, false) :put h {u, at => e}"])
script("imperative_control", "%if {?[x] := *region{r_regionkey: x}, x > 100} %then %return {?[x] <- [['wrong']]} %else {?[x, n] := *region{r_regionkey: x, r_name: n}} as _a %end {?[y] := *_a{x, n}, y = x * 2} as _b %swap _a _b %mark outer %loop %loop %break outer %end %end %if_not {?[y] := *_a{y}, y > 1000} %then %return _a %end", "SELECT r_regionkey * 2 AS y FROM region")

# --- system operations ----------------------------------------------------------------------------------------



def listing(name: str, op: str, sql: str, setup: list[str], columns: str) -> None:
    @plan(name, sql)
    def run(t, spark):
        db = Session(spark)
        db.register("nation", t("nation"), ["n_nationkey"])
        for s in setup:
            db.run(s)
        return db.run(op).selectExpr(*columns.split(", "))


listing("list_relations", "::relations", "SELECT * FROM (VALUES ('n', 3::BIGINT, 'protected', 1::BIGINT, 2::BIGINT), ('nation', 3, 'read_only', 1, 2)) t(name, arity, access_level, n_keys, n_non_keys)", [MAKE, "::access_level protected n"], "name, arity, access_level, n_keys, n_non_keys")
listing("list_columns", "::columns n", "SELECT * FROM (VALUES ('k', true, 0::BIGINT, 'Int'), ('name', false, 1, 'String'), ('r', false, 2, 'Int')) t(\"column\", is_key, \"index\", type)", [MAKE], "column, is_key, index, type")
listing("list_indices", "::indices n", "SELECT 'by_r' AS name, 'normal' AS type, 'n' AS relations", [MAKE, "::index create n:by_r {r}", "::index create n:gone {name}", "::index drop n:gone"], "name, type, relations")
listing("list_triggers", "::show_triggers n", "SELECT * FROM (VALUES ('put', 0::BIGINT), ('rm', 1)) t(type, idx)", [MAKE, "::set_triggers n on put { ?[k] := _new[k, _, _] } on rm { ?[k] := _old[k, _, _] }"], "type, idx")
listing("list_fixed_rules", "::fixed_rules", "SELECT * FROM (VALUES ('BFS'), ('DFS'), ('PageRank')) t(rule)", [], "rule")
listing("explain_strata", "::explain {r[k] := *nation{n_nationkey: k}, k > 3 ?[k] := r[k], not s[k] s[k] := r[k], k > 9}", "SELECT * FROM (VALUES ('?'), ('r'), ('s')) t(rule)", [], "rule")
listing("rename_compact_remove", "?[k] := *m{k}", "SELECT n_nationkey::BIGINT AS k FROM nation", [MAKE, "::rename n -> m", "::compact", "?[k] <- [[1]] :create gone {k: Int}", "::remove gone", "%ignore_error {?[k] := *gone{k}}", "%ignore_error {?[k] := *n{k}}", "::running"], "k")
listing("access_levels", "?[k, name, r] := *n{k, name, r}", ALL, [MAKE, "::access_level read_only n", "%ignore_error {?[k] <- [[1]] :rm n {k}}"], "k, name, r")


def _narrowed(name: str, keep) -> None:
    from tesserae.registry import QUERIES

    full = QUERIES[name]
    QUERIES[name] = lambda spark, d: keep(full(spark, d))


_narrowed("list_fixed_rules", lambda df: df.where("rule in ('BFS', 'DFS', 'PageRank')"))
_narrowed("explain_strata", lambda df: df.where("rule in ('?', 'r', 's')").distinct())

# --- readers ----------------------------------------------------------------------------------------------------


def exported(t, spark, name: str, kind: str, **options) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/exports/{uuid.uuid4().hex}"
    getattr(t(name).write, kind)(path, **options)
    return path


@plan("csv_reader", "SELECT n_nationkey::BIGINT AS k, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::DOUBLE END AS r FROM nation")
def csv_reader(t, spark):
    odd = lambda name: t(name).withColumn("n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).otherwise("none"))
    path = exported(odd, spark, "nation", "csv", header=True, sep=";")
    return Session(spark).run("?[k, name, r] <~ CsvReader(url: $u, types: ['Int', 'String', 'Float?'], delimiter: ';', has_headers: true)", {"u": path})


@plan("json_reader", "SELECT n_nationkey::BIGINT AS k, n_name AS name, NULL::VARCHAR AS x FROM nation")
def json_reader(t, spark):
    path = exported(t, spark, "nation", "json")
    return Session(spark).run("?[k, name, x] <~ JsonReader(url: $u, fields: ['n_nationkey', 'n_name', 'not_there'], null_if_absent: true)", {"u": path})


@plan("csv_reader_index", "SELECT n_nationkey::BIGINT AS i, n_nationkey::BIGINT AS k FROM nation")
def csv_reader_index(t, spark):
    path = exported(lambda name: t(name).coalesce(1).sortWithinPartitions("n_nationkey"), spark, "nation", "csv")
    return Session(spark).run("r[i, k, n, x] <~ CsvReader(url: $u, types: ['Int', 'String', 'Int'], has_headers: false, prepend_index: true) ?[i, k] := r[i, k, _, _]", {"u": path})


script("constant_fixed_rule", "c[a, b] <~ Constant(data: [[1, 'x'], [2, 'y'], [2, 'y']]) ?[a, b] := c[a, b]", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x'), (2, 'y')) t(a, b)")

# --- indices and search ---------------------------------------------------------------------------------------------

script("index_scan", "?[p, k] := *orders:by_priority{o_orderpriority: p, o_orderkey: k}, p == '2-HIGH'", "SELECT o_orderpriority AS p, o_orderkey AS k FROM orders WHERE o_orderpriority = '2-HIGH'", setup="::index create orders:by_priority {o_orderpriority}")
script("index_chosen", "?[k] := *orders{o_orderkey: k, o_orderpriority: '2-HIGH'}", "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '2-HIGH'", setup="::index create orders:by_priority {o_orderpriority}")
script("index_join", "?[c, o] := *customer{c_custkey: c, c_mktsegment: 'BUILDING'}, *orders:by_customer{o_custkey: c, o_orderkey: o}", "SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", setup="::index create orders:by_customer {o_custkey}")
script("index_follows_changes", "?[r, k] := *n:by_r{r, k}", "SELECT n_regionkey::BIGINT AS r, n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 7, 99", setup=[MAKE, "::index create n:by_r {r}", "?[k, name, r] <- [[99, 'new', 7]] :put n {k => name, r}", "?[k] := *n{k, r: 2} :rm n {k}"])

WORDS = "::fts create documents:words {extractor: text, tokenizer: Simple, filters: [Lowercase]}"
SQL_WORDS = "w AS (SELECT doc_id, p, tokens[p] AS t FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS tokens FROM documents)))"
script("fts_tf_idf", "?[k, s] := ~documents:words{doc_id: k | query: 'the AND with NOT onnt', bind_score: x}, s = round(x * 1000)", "WITH w AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM documents) GROUP BY 1, 2), n AS (SELECT t, count(*) AS n FROM w GROUP BY 1), s AS (SELECT doc_id, sum(tf * ln(1 + ((SELECT count(*) FROM documents WHERE text IS NOT NULL) - n + 0.5) / (n + 0.5))) AS s, count(*) AS c FROM w JOIN n USING (t) WHERE t IN ('the', 'with') GROUP BY 1) SELECT doc_id AS k, round(s * 1000) AS s FROM s WHERE c = 2 AND doc_id NOT IN (SELECT doc_id FROM w WHERE t = 'onnt')", setup=WORDS)
script("fts_prefix_near", "?[k] := ~documents:words{doc_id: k | query: 'NEAR/3(the with) OR licen*'}", f"WITH {SQL_WORDS} SELECT DISTINCT x.doc_id AS k FROM w x JOIN w y ON x.doc_id = y.doc_id AND abs(x.p - y.p) <= 3 WHERE x.t = 'the' AND y.t = 'with' UNION SELECT doc_id FROM w WHERE starts_with(t, 'licen')", setup=WORDS)
script("fts_phrase_boost_tf", "?[k, s] := ~documents:words{doc_id: k | query: '\"the with\"^2 OR licensed^3.5', score_kind: 'tf', bind_score: s}", f"WITH {SQL_WORDS}, c AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM w GROUP BY 1, 2) SELECT k, max(s) AS s FROM (SELECT x.doc_id AS k, x.tf * 2 + y.tf * 2 AS s FROM c x JOIN c y USING (doc_id) WHERE x.t = 'the' AND y.t = 'with' UNION ALL SELECT doc_id, tf * 3.5 FROM c WHERE t = 'licensed') GROUP BY 1", setup=WORDS)
script("fts_top_k", "?[k, s] := ~documents:words{doc_id: k, source: c | query: 'the', k: 20, filter: c != 'web', score_kind: 'tf', bind_score: s}", f"WITH {SQL_WORDS}, c AS (SELECT doc_id, count(*)::DOUBLE AS s FROM w WHERE t = 'the' GROUP BY 1) SELECT doc_id AS k, s FROM c JOIN documents USING (doc_id) WHERE source <> 'web' ORDER BY s DESC, doc_id LIMIT 20", setup=WORDS)
script("fts_queries_from_rows", "q[t] <- [['the'], ['licensed under']] ?[t, k] := q[t], ~documents:words{doc_id: k | query: t}", f"WITH {SQL_WORDS} SELECT DISTINCT 'the' AS t, doc_id AS k FROM w WHERE t = 'the' UNION ALL SELECT DISTINCT 'licensed under', x.doc_id FROM w x JOIN w y USING (doc_id) WHERE x.t = 'licensed' AND y.t = 'under'", setup=WORDS)
script("fts_index_rows", "r[w, count(k), sum(n)] := *documents:words{word: w, src_doc_id: k, position: p}, n = length(p) ?[w, d, n] := r[w, d, n]", f"WITH {SQL_WORDS} SELECT t AS w, count(DISTINCT doc_id) AS d, count(*)::DOUBLE AS n FROM w GROUP BY 1", setup=WORDS)
script("fts_follows_changes", "?[k] := ~n:words{k | query: 'nation OR extra'}", "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 99", setup=[MAKE, "::fts create n:words {extractor: name, tokenizer: Simple, filters: [Lowercase]}", "?[k, name, r] <- [[99, 'extra word', 7]] :put n {k => name, r}", "?[k] := *n{k, r: 2} :rm n {k}"])
script("fts_analyzers", "?[k] := ~part:names{p_partkey: k | query: 'running'}", "SELECT p_partkey AS k FROM part WHERE p_size % 2 = 0", setup=["::fts create part:names {extractor: if(p_size % 2 == 0, 'The RUNNER runs', 'a'), tokenizer: Whitespace, filters: [Lowercase, AlphaNumOnly, Stopwords('en'), RemoveLong(40), Stemmer('english')]}"])
script("fts_ngrams", "?[k] := ~nation:grams{n_nationkey: k | query: 'on_1'}", "SELECT n_nationkey AS k FROM nation WHERE contains(lower(n_name), 'on_1')", setup=["::fts create nation:grams {extractor: n_name, tokenizer: NGram(4, 4), filters: [Lowercase, AsciiFolding]}"])

SIMILAR = "::lsh create documents:near {extractor: text, tokenizer: Simple, filters: [Lowercase], n_gram: 5, n_perm: 128, target_threshold: 0.7}"
script("lsh_search", "?[q, k] := *documents{doc_id: q, text: t}, q % 100 == 0, ~documents:near{doc_id: k, text: u | query: t}, lowercase(u) == lowercase(t)", "SELECT x.doc_id AS q, y.doc_id AS k FROM documents x JOIN documents y ON lower(x.text) = lower(y.text) WHERE x.doc_id % 100 = 0 AND regexp_matches(x.text, '[\\p{L}\\p{N}]')", setup=SIMILAR)
script("lsh_follows_changes", "?[q, k] := *n{k: q, name: t}, q < 3, ~n:near{k | query: t}", "SELECT n_nationkey::BIGINT AS q, n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 1, 99", setup=["?[k, name] := *nation{n_nationkey: k}, name = 'word' ++ to_string(k) ++ ' of a nation' :create n {k: Int => name: String}", "::lsh create n:near {extractor: name, tokenizer: Simple, n_gram: 3, n_perm: 64, target_threshold: 0.9}", "?[k, name] <- [[99, 'word1 of a nation']] :put n {k => name}", "?[k, name] <- [[1, 'word1 of a nation']] :put n {k => name}", "?[k, name] := *n{k, name}, k in [99] :put n {k => name}"])
script("lsh_lists", "?[q, k] := *s{k: q, l}, q < 3, ~s:near{k | query: l}", "SELECT x.n_nationkey::BIGINT AS q, y.n_nationkey::BIGINT AS k FROM nation x JOIN nation y ON x.n_nationkey % 7 = y.n_nationkey % 7 WHERE x.n_nationkey < 3", setup=["?[k, l] := *nation{n_nationkey: k}, x = (k % 7) * 1000, l = [x, x + 1, x + 2, x + 3] :create s {k: Int => l}", "::lsh create s:near {extractor: l, tokenizer: Raw, n_perm: 64, target_threshold: 0.95}"])
_L2 = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))"
for _kind, _sql in (("L2", _L2), ("IP", "1 - list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[])"), ("Cosine", "1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])")):
    script(f"knn_{_kind.lower()}", "?[q, k, d] := *embeddings{vec_id: q, embedding: v}, q % 100 == 0, ~embeddings:near{vec_id: k | query: v, k: 5, bind_distance: x}, d = abs(round(x * 10000))", f"SELECT q, k, abs(round(d * 10000)) AS d FROM (SELECT y.vec_id AS q, x.vec_id AS k, {_sql} AS d, row_number() OVER (PARTITION BY y.vec_id ORDER BY {_sql}, x.vec_id) AS i FROM embeddings x, embeddings y WHERE y.vec_id % 100 = 0) WHERE i <= 5", setup=f"::hnsw create embeddings:near {{dim: 64, fields: [embedding], distance: {_kind}}}")
NEAR = "::hnsw create embeddings:near {dim: 64, dtype: F32, fields: [embedding], distance: L2, ef_construction: 50, m: 16}"
script("knn_filter", "?[q, k] := *embeddings{vec_id: q, embedding: v}, q % 100 == 0, ~embeddings:near{vec_id: k, label: l | query: v, k: 5, ef: 50, filter: l % 2 == 1}", f"SELECT q, k FROM (SELECT y.vec_id AS q, x.vec_id AS k, row_number() OVER (PARTITION BY y.vec_id ORDER BY {_L2}, x.vec_id) AS i FROM embeddings x, embeddings y WHERE y.vec_id % 100 = 0 AND x.label % 2 = 1) WHERE i <= 5", setup=NEAR)
script("knn_radius", "?[q, k] := *embeddings{vec_id: q, embedding: v}, q % 100 == 0, ~embeddings:near{vec_id: k | query: v, k: 5, radius: 1.2}", f"SELECT q, k FROM (SELECT y.vec_id AS q, x.vec_id AS k, {_L2} AS d, row_number() OVER (PARTITION BY y.vec_id ORDER BY {_L2}, x.vec_id) AS i FROM embeddings x, embeddings y WHERE y.vec_id % 100 = 0) WHERE i <= 5 AND d <= 1.2", setup=NEAR)
script("knn_bindings", "?[q, k, f, i, n] := *embeddings{vec_id: q, embedding: v}, q % 100 == 0, ~embeddings:near{vec_id: k | query: v, k: 1, bind_field: f, bind_field_idx: x, bind_vector: w}, i = is_null(x), n = length(w)", "SELECT vec_id AS q, vec_id AS k, 'embedding' AS f, true AS i, 64::BIGINT AS n FROM embeddings WHERE vec_id % 100 = 0", setup=NEAR)
script("knn_two_fields", "?[k, f, i, d] := ~p:near{k | query: vec([3.0, 0.0]), k: 4, bind_field: f, bind_field_idx: i, bind_distance: d}", "SELECT k, f, i, d FROM (SELECT n_nationkey::BIGINT AS k, 'a' AS f, NULL::BIGINT AS i, ((n_nationkey - 3) * (n_nationkey - 3))::DOUBLE AS d FROM nation UNION ALL SELECT n_nationkey, 'b', 0, ((n_nationkey + 0.5 - 3) * (n_nationkey + 0.5 - 3))::DOUBLE FROM nation UNION ALL SELECT n_nationkey, 'b', 1, 10000.0 FROM nation) ORDER BY d, k LIMIT 4", setup=["?[k, a, b] := *nation{n_nationkey: k}, a = [k * 1.0, 0.0], b = [[k + 0.5, 0.0], [3.0, 100.0]] :create p {k: Int => a: <F64; 2>, b: [<F64; 2>]}", "::hnsw create p:near {dim: 2, fields: [a, b], distance: L2}"])

# --- the interface ----------------------------------------------------------------------------------------------------------


@plan("run_parsed_program", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2")
def run_parsed_program(t, spark):
    db = Session(spark)
    db.register("nation", t("nation"), ["n_nationkey"])
    _, program = parse("?[k] := *nation{n_nationkey: k, n_regionkey: 2}")
    return db.run_program(program)


@plan("run_json", "SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT -1, 'false'")
def run_json(t, spark):
    """Results and errors as JSON text."""
    db = Session(spark)
    db.register("nation", t("nation"), ["n_nationkey"])
    fine, wrong = (json.loads(db.run_json(s, '{"r": 2}')) for s in ("?[k, n] := *nation{n_nationkey: k, n_name: n, n_regionkey: $r}", "?[k] := *nowhere{k}"))
    return spark.createDataFrame([*map(tuple, fine["rows"]), (-1, str(wrong["ok"]).lower())], "k long, n string")


@plan("named_rows", "SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey < 2")
def named_rows(t, spark):
    """Two results, through JSON and back, put into a relation."""
    db = Session(spark)
    db.register("nation", t("nation"), ["n_nationkey"])
    found = db.run_named("%return {?[k, n] := *nation{n_nationkey: k, n_name: n}, k < 5}, {?[k, n] := *nation{n_nationkey: x, n_name: n}, x < 2, k = x + 100}")
    assert found.has_more
    parts = NamedRows.from_json(json.loads(json.dumps(found.into_json()))).flatten()
    db.run("?[k, n] <- [[-1, '']] :create r {k: Int => n: String}")
    db.run("?[k] <- [[-1]] :rm r {k}")
    for part in parts:
        db.run(*part.into_payload("r", "put"))
    return db.run("?[k, n] := *r{k, n}")


@plan("export_import", ALL + " WHERE n_regionkey <> 0 UNION ALL SELECT 500, 'imported', 5")
def export_import(t, spark):
    db = Session(spark)
    db.register("nation", t("nation"), ["n_nationkey"])
    db.run(MAKE)
    gone = db.export(["n"])["n"].where("r = 0").select("k")
    db.import_({"-n": gone})
    db.import_({"n": spark.createDataFrame([(500, "imported", 5)], "k long, name string, r long")})
    return db.run("?[k, name, r] := *n{k, name, r}")


@plan("backup_restore", ALL)
def backup_restore(t, spark):
    db, path = Session(spark), f"{shared_dir(spark).rstrip('/')}/backups/{uuid.uuid4().hex}"
    db.register("nation", t("nation"), ["n_nationkey"])
    db.run(MAKE)
    db.backup(path)
    other, third = Session(spark), Session(spark)
    other.restore(path)
    third.run("?[k, name, r] <- [[1000, 'x', 1]] :create n {k: Int => name: String, r: Int}")
    third.import_from_backup(path, ["n"])
    return third.run("?[k, name, r] := *n{k, name, r}").intersect(other.run("?[k, name, r] := *n{k, name, r}"))


@plan("callbacks", "SELECT * FROM (VALUES ('put', 26::BIGINT, 1::BIGINT), ('rm', 0, 5)) t(event, new, old)")
def callbacks(t, spark):
    db, seen = Session(spark), []
    db.register("nation", t("nation"), ["n_nationkey"])
    db.run("?[k, name, r] <- [[3, 'old', 1]] :create n {k: Int => name: String, r: Int}")
    ident = db.on_change("n", lambda event, new, old: seen.append((event, new.count(), old.count())))
    db.run("?[k, name, r] := *nation{n_nationkey: k, n_name: name, n_regionkey: r} c[k, name, r] <- [[99, 'x', 9]] ?[k, name, r] := c[k, name, r] :put n {k => name, r}")
    db.run("?[k] := *n{k, r: 2} :rm n {k}")
    db.remove_callback(ident)
    db.run("?[k] := *n{k, r: 3} :rm n {k}")
    return spark.createDataFrame(seen, "event string, new long, old long")


@plan("transactions", "SELECT * FROM (VALUES (1::BIGINT), (2), (3)) t(k)")
def transactions(t, spark):
    """What one transaction wrote stays, what another wrote before it failed does not."""
    db = Session(spark)
    db.run("?[k] <- [[1]] :create n {k: Int}")
    with db.transaction():
        db.run("?[k] <- [[2]] :put n {k}")
        db.run("?[k] <- [[3]] :put n {k}")
    try:
        with db.transaction():
            db.run("?[k] <- [[4]] :put n {k}")
            db.run("?[k] <- [[1]] :insert n {k}")
    except EngineError:
        pass
    return db.run("?[k] := *n{k}")


@plan("custom_fixed_rule", "SELECT n_nationkey AS a, (n_nationkey * 3)::BIGINT AS b FROM nation")
def custom_fixed_rule(t, spark):
    db = Session(spark)
    db.register("nation", t("nation"), ["n_nationkey"])
    db.register_rule("Times", lambda inputs, options: inputs[0].selectExpr("a", f"a * {options['by']} as b"), 2)
    db.register_rule("Gone", lambda inputs, options: [], 1)
    assert db.unregister_rule("Gone")
    return db.run("r[a] := *nation{n_nationkey: a} ?[a, b] <~ Times(r[a], by: 3)").selectExpr("a", "cast(b as long) as b")


@plan("time_travel_versions", "SELECT * FROM (VALUES (1::BIGINT, 'p', 12::BIGINT), (1, 'q', 25), (2, 'r', 25), (2, 'r', 99)) t(a, d, m)")
def time_travel_versions(t, spark):
    """Assertions and retractions, read as of three times."""
    db = Session(spark)
    db.run("?[a, v, d] <- [[1, [10, true], 'p'], [1, [20, true], 'q'], [1, [30, false], 'q'], [2, [15, true], 'r']] :create h {a: Int, v: Validity => d: String}")
    parts = [db.run(f"?[a, d, m] := *h{{a, d @ {n}}}, m = {n}") for n in (12, 25, 99)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
