"""The text language and its operators, on small literals and against DuckDB."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae import EngineError, Session, storage
from tesserae.functions.text import stem
from tesserae.operators import graph, search
from tesserae.plans.normalize import dnf
from tesserae.plans.parser import parse, parse_expression
from tesserae.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(spark):
    return Session(spark)


def rows(db, script, **params):
    return sorted(map(tuple, db.run(script, params or None).collect()), key=str)


def test_parser_precedence_and_literals():
    assert parse_expression("1 + 2 * 3 ^ 2") == parse_expression("1 + (2 * (3 ^ 2))")
    assert parse_expression("7 % 2 + 1") == parse_expression("7 % (2 + 1)")
    assert parse_expression('0xff + __"a"b"__') and parse_expression("1_000.5e1")
    kind, p = parse("r[a] <- [[1]] # note\n/* a /* b */ c */ ?[a] := r[a], not (a > 1, a < 3) or a == 2 :limit 3")
    assert kind == "query" and p.limit == 3 and len(dnf(p.rules[1].body)) == 3
    for bad in ("?[a] := a >", "?[a] :- b", ":limit 2"):
        with pytest.raises(EngineError):
            parse(bad)


def test_sets_nulls_and_aggregates(db):
    assert rows(db, "a[x] <- [[1], [2], [null], [2]] ?[x] := a[x]") == [(1,), (2,), (None,)]
    assert rows(db, "a[x] <- [[1], [null]] ?[x] := a[x], a[x]") == [(1,), (None,)]
    assert rows(db, "?[count(x), sum(x)] := x in [1, 1, 2]") == [(3, 4.0)]
    assert rows(db, "r[x] := x in [1, 1, 2] ?[count(x)] := r[x]") == [(2,)]
    assert rows(db, "a[x, y] <- [['p', 1], ['p', 2], ['q', 5]] ?[x, min(y), mean(y)] := a[x, y]") == [("p", 1, 1.5), ("q", 5, 5.0)]


def test_errors(db):
    for script in ("?[a] := b = 1", "?[a] := a = 1, 'x' > 2", "?[a] := a = nope(1)", "r[a] := not r[a], a = 1 ?[a] := r[a]", "?[a] := *missing[a]", "?[a] := a = 1, 1 + 1", "?[a] := not r[a] r[a] <- [[1]]"):
        with pytest.raises(EngineError):
            db.run(script).collect()


def test_recursion_terminates_on_cycles(db):
    edges = "e[a, b] <- [[1, 2], [2, 3], [3, 1], [3, 4]] p[a, b] := e[a, b] p[a, c] := p[a, b], e[b, c] "
    assert len(rows(db, edges + "?[a, b] := p[a, b]")) == 12
    assert rows(db, edges + "?[b] := p[2, b]") == [(1,), (2,), (3,), (4,)]
    assert rows(db, "e[a, b] <- [[1, 2], [2, 3], [1, 3]] d[b, min(n)] := b = 1, n = 0 d[b, min(n)] := d[a, m], e[a, b], n = m + 1 ?[b, n] := d[b, n]") == [(1, 0), (2, 1), (3, 1)]


def test_relations_and_transactions(db):
    db.run("?[a, b] <- [[1, 'x'], [2, 'y']] :create t {a: Int => b: String}")
    seen = []
    ident = db.on_change("t", lambda event, new, old: seen.append((event, new.count(), old.count())))
    db.run("?[a, b] <- [[2, 'z'], [3, 'w']] :put t {a => b}")
    assert seen == [("put", 2, 1)] and rows(db, "?[a, b] := *t{a, b}") == [(1, "x"), (2, "z"), (3, "w")]
    with pytest.raises(EngineError):
        db.run("?[a, b] <- [[1, 'q']] :insert t {a => b}")
    with pytest.raises(RuntimeError), db.transaction():
        db.run("?[a] <- [[1]] :rm t {a}")
        raise RuntimeError
    assert len(rows(db, "?[a] := *t{a}")) == 3 and len(seen) == 1
    db.run("?[a] <- [[0]] :create log {a: Int}")
    db.run("::set_triggers t on put { ?[a] := _new[a, _] :put log {a} }")
    db.run("?[a, b] <- [[7, 'z']] :put t {a => b}")
    assert rows(db, "?[a] := *log{a}") == [(0,), (7,)] and len(seen) == 2
    db.run("::set_triggers t")
    db.run("?[a, b] <- [[8, 'z']] :put t {a => b}")
    assert rows(db, "?[a] := *log{a}") == [(0,), (7,)]
    seen.clear()
    db.run("?[a] <- [[7], [8]] :rm t {a}")
    assert [e for e, _, _ in seen] == ["rm"]
    db.remove_callback(ident)
    with pytest.raises(EngineError):
        db.run("?[a] <- [[1]] :rm t {a}", read_only=True)


def test_time_travel(db):
    db.run("?[a, v, d] <- [[1, [10, true], 'p'], [1, [20, true], 'q'], [1, [30, false], 'q'], [2, [15, true], 'r']] :create h {a: Int, v: Validity => d: String}")
    assert rows(db, "?[a, d] := *h{a, d @ 12}") == [(1, "p")]
    assert rows(db, "?[a, d] := *h{a, d @ 25}") == [(1, "q"), (2, "r")]
    assert rows(db, "?[a, d] := *h{a, d @ 'NOW'}") == [(2, "r")]


def test_custom_rule_export_and_backup(db, spark, tmp_path):
    db.register_rule("Twice", lambda inputs, options: inputs[0].selectExpr("a", f"a * {options['by']} as b"), 2)
    assert rows(db, "r[a] <- [[1], [2]] ?[a, b] <~ Twice(r[a], by: 3)") == [(1, 3), (2, 6)]
    db.run("?[k, v] <- [[1, 'a']] :create kept {k => v}")
    db.backup("file://" + str(tmp_path / "b"))
    other = Session(spark)
    other.restore("file://" + str(tmp_path / "b"))
    assert rows(other, "?[k, v] := *kept{k, v}") == [(1, "a")]
    assert db.evaluate("1 + 2 * 3") == 7 and db.variables("a + b") == {"a", "b"}


def test_functions(db):
    cases = {"5 / 0": math.inf, "-7 % 3": -1, "round(2.5)": 3.0, "concat([1], [2])": [1, 2], "length('né')": 2, "chars('')": [], "get([1, 2, 3], -1)": 3, "[1, 2] -> 5": None, "slice([1, 2, 3, 4], 1, -1)": [2, 3], "int_range(3, 0, -1)": [3, 2, 1], "windows([1, 2, 3], 2)": [[1, 2], [2, 3]], "union([2, 1], [2, 3])": [1, 2, 3], "bit_and(decode_base64('/w8='), decode_base64('Dw8='))": b"\x0f\x0f", "parse_json('{\"b\": 1, \"a\": 2}')": '{"a":2,"b":1}', "set_json_path({'a': 1}, ['b', 'c'], 5)": '{"a":1,"b":{"c":5}}', "unicode_normalize('é', 'nfc')": "é", "regex_replace('aab', 'a', 'x')": "xab", "to_int('12')": 12, "to_float('PI')": math.pi, "is_in(1, [2, 1])": True, "null == null": True, "1 == 1.0": True, "if(false, 1)": None, "l2_dist(vec([1, 2]), vec([1, 4]))": 4.0, "format_timestamp(0, 'Asia/Tokyo')": "1970-01-01T09:00:00+09:00", "trim('\t x　')": "x"}
    for text, want in cases.items():
        got = db.evaluate(text)
        assert (bytes(got) if isinstance(got, bytearray) else got) == want, text


def test_stemmer():
    for word, want in {"running": "run", "happily": "happili", "nationalization": "nation", "skies": "sky", "generously": "generous", "hopping": "hop", "consistency": "consist"}.items():
        assert stem(word) == want


SLOW = {"graph_top_sort", "graph_strong_components", "graph_spanning_tree", "graph_spanning_forest", "without_magic_rewrite"}
CHECKED = sorted(set(ORACLE_SQL) - SLOW)


def norm(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    order = sorted(df.columns)
    assert set(QUERIES) == set(ORACLE_SQL)
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(norm(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(columns) == order and want
    assert sorted(tuple(norm(r[c]) for c in order) for r in df.collect()) == want


def test_full_text_queries_return_every_hit(spark, tmp_path):
    n = 100_003
    spark.range(n).selectExpr("id AS doc_id", "'the with' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["fts_tf_idf"](spark, str(tmp_path)).count() == n
    assert QUERIES["fts_prefix_near"](spark, str(tmp_path)).count() == n


def test_a_text_index_is_sorted_in_runs_and_not_by_a_task(spark, monkeypatch):
    """Rows of a run are in order of tokens and keys, whatever its bounds are; no task sorts all of its rows, which spills."""
    texts = [(i, None if i % 7 == 3 else "b%d a, B%d c%d a" % (i % 5, i % 5, i)) for i in range(40)] + [(40, "a " * 300), (41, "")]
    docs = spark.createDataFrame(texts, "key long, text string").coalesce(1)
    found = []
    for rows, size in ((1024, 2 << 20), (4, 1 << 20), (1024, 100)):
        monkeypatch.setattr(search, "RUN_ROWS", rows)
        monkeypatch.setattr(search, "RUN_BYTES", size)
        made = search.arranged(search.postings(docs, ("Simple",), [("Lowercase",)]), "fts", {})
        assert "Sort" not in made._jdf.queryExecution().sparkPlan().toString()
        found.append(sorted(map(tuple, made.collect()), key=str))
    assert found[0] == found[1] == found[2] and sum(r[0] is None for r in found[0]) == 36
    hit = next(r for r in found[0] if r[:2] == ("b2", 2))
    assert hit[2:] == (2, [0, 2], [0, 6], [2, 8], 5)
    batch = pa.RecordBatch.from_pydict({"key": list(range(40)), "text": ["x" * i for i in range(40)]})
    runs = list(search.in_runs(batch, 1024, 30))
    assert pa.Table.from_batches(runs).to_pydict() == batch.to_pydict() and all(r.num_rows == 1 or sum(map(len, r.column("text").to_pylist())) <= 30 for r in runs)


def test_places_of_a_posting_are_one_list_and_its_order_is_stable(spark):
    """A text index stores positions, starts and ends as one list, and gives them back apart; none for a text without words."""
    docs = spark.createDataFrame([(1, "é b é"), (2, "b"), (3, ""), (4, None)], "key long, text string")
    stored = search.stored_postings(docs, ("Simple",), [])
    assert [f.name for f in stored.schema.fields if f.dataType.typeName() == "array"] == ["places"]
    got = {r[:2]: r[2:] for r in map(tuple, search.postings(docs, ("Simple",), []).collect())}
    assert got == {("é", 1): (2, [0, 2], [0, 4], [1, 5], 3), ("b", 1): (1, [1], [2], [3], 3), ("b", 2): (1, [0], [0], [1], 1), (None, 1): (0, [], [], [], 3), (None, 2): (0, [], [], [], 1), (None, 3): (0, [], [], [], 0)}
    for most in (1, 300, 1 << 16, 1 << 20):
        x = np.random.default_rng(0).integers(0, most, 100_000)
        assert (search.stable_order(x) == np.argsort(x, kind="stable")).all()


@pytest.mark.parametrize("made", ["postings", "bands"])
def test_texts_of_one_row_group_are_dealt_out(spark, tmp_path, made):
    """One task reads a row group, however many parts its file is cut into; what is made of its texts is made in all tasks."""
    n = 4000
    pq.write_table(pa.table({"key": range(n), "text": [f"a b c d e f g h w{i}" for i in range(n)]}), tmp_path / "one.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        docs = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert docs.rdd.getNumPartitions() > 4
        out = search.postings(docs, ("Simple",), []) if made == "postings" else search.band_hashes(docs.withColumnRenamed("text", "value"), 8, 2, 4, 1, ("Simple",), [])
        parts = [r["n"] for r in out.select("key", F.spark_partition_id().alias("p")).distinct().groupBy("p").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(parts) == 4 and sum(parts) == n and max(parts) < n / 2


@pytest.mark.parametrize("kind", search.DISTANCES)
def test_nearest_vectors_in_small_pieces(spark, monkeypatch, kind):
    """A task that holds few distances at once finds what all pairs give, ties and distances that are no numbers too."""
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 2, (300, 3)).astype(float)
    x[:298:3] = 0
    base = spark.createDataFrame([(i, None if i % 11 == 5 else v.tolist()) for i, v in enumerate(x)], "key long, vector array<double>").repartition(3)
    asked = [0, 1, 2, 4, 7]
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in asked], "qid long, vector array<double>")
    d = search.distances(x[asked], x, kind)
    for k in (3, 250):
        want = [(q, *e) for row, q in zip(d, asked, strict=True) for e in sorted(((i, v) for i, v in enumerate(row.tolist()) if i % 11 != 5), key=lambda e: (math.isnan(e[1]), e[1] if e[1] == e[1] else 0, e[0]))[:k]]
        for most in (1, 40, 1 << 20):
            monkeypatch.setattr(search, "CELLS", most)
            got = search.nearest(queries, base, k, kind).collect()
            assert sorted((r["qid"], r["key"], repr(r["distance"])) for r in got) == sorted((q, i, repr(v)) for q, i, v in want)


def test_bands_of_a_whole_batch_are_those_of_each_text(spark, monkeypatch):
    """Equal sets of grams share all bands, whatever texts stand beside them; a text or list without any has none."""
    texts = ["a b c d e f", "A b, c d e f", "a b", "a  B", "a b c", "", None, " . ", "x " * 50, "x x x x x", "c d e f a b", "a b c d e f a b c d e"]
    one = [spark.createDataFrame([(i, t)], "key long, value string") for i, t in enumerate(texts)]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, value string").coalesce(1)
    bands = lambda df, g: sorted(map(tuple, search.band_hashes(df, 32, 8, 4, g, ("Simple",), [("Lowercase",)]).collect()))
    got = bands(rows, 3)
    apart = one[0]
    for o in one[1:]:
        apart = apart.unionAll(o)
    monkeypatch.setattr(search, "RUN_ROWS", 1)
    assert got == bands(apart, 3) and {k for k, _ in got} == {0, 1, 2, 3, 4, 8, 9, 10, 11} and len(got) == 9 * 8
    of = lambda k: {b for i, b in got if i == k}
    assert of(0) == of(1) and of(2) == of(3) and of(8) == of(9) and not of(2) & of(4) and not of(0) & of(2)
    lists = spark.createDataFrame([(0, [1, 2, 3]), (1, [3, 2, 1]), (2, []), (3, None), (4, [1, 2, 4])], "key long, value array<long>")
    found = {k: {b for i, b in bands(lists, 1) if i == k} for k in range(5)}
    assert found[0] == found[1] and len(found[0]) == 8 and not found[2] and not found[3] and found[4] != found[0]


def test_shared_folder_must_be_named_off_one_machine():
    from tesserae import storage

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(RuntimeError):
        storage.shared_dir(Cluster())


def test_depth_first_search_against_a_plain_one(spark):
    """On a graph with branches and cycles, edges in the order of their ends."""
    from tesserae.operators import graph

    edges = sorted({(a, (a * 7 + 3) % 25) for a in range(25)} | {(a, (a + 1) % 25) for a in range(25)})
    seen, found, stack = set(), [], [(0, [0])]
    while stack and len(found) < 3:
        x, path = stack.pop()
        if x in seen:
            continue
        seen.add(x)
        if x > 20 and x != 0:
            found.append((0, x, path))
        stack += [(y, [*path, y]) for a, y in reversed(edges) if a == x and y not in seen]
    nodes = spark.range(25).toDF("n")
    got = graph.depth_first(spark.createDataFrame(edges, "a long, b long"), nodes, nodes.where("n = 0"), lambda d: d["n"] > 20, 3).collect()
    assert [tuple(r) for r in got] == found


@pytest.mark.parametrize("most", [0, 5_000_000])
def test_ranks_and_components_in_one_task_and_round_by_round(spark, monkeypatch, most):
    import random

    from tesserae.operators import graph

    monkeypatch.setattr(graph, "MOST_EDGES", most)
    rng = random.Random(5)
    edges = list({(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)}) + [(f"m{i}", f"m{i + 1}") for i in range(20)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a string, b string")
    assert {r["node"]: r["component"] for r in graph.connected_components(df).collect()} == {x: find(x) for x in up}
    out = {x: sum(a == x for a, _ in edges) for x in up}
    rank = {x: 1 / len(up) for x in up}
    for _ in range(4):
        rank = {x: 0.15 / len(up) + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == x) for x in up}
    got = {r["node"]: r["rank"] for r in graph.pagerank(df, epsilon=0.0, iterations=4).collect()}
    assert set(got) == set(rank) and all(math.isclose(got[x], rank[x], rel_tol=1e-9) for x in rank)
    assert graph.pagerank(df.limit(0)).count() == 0 and graph.connected_components(df.limit(0)).count() == 0


def test_louvain_finds_better_groups_than_none(spark):
    from tesserae.operators import graph

    edges = [(a, b) for g in range(4) for a in range(g * 5, g * 5 + 5) for b in range(a + 1, g * 5 + 5)] + [(4, 5), (9, 10), (14, 15), (19, 0)]
    groups = {r["node"]: r["labels"][0] for r in graph.louvain(spark.createDataFrame(edges, "a long, b long"), undirected=True).collect()}
    assert len(set(groups.values())) == 4 and all(groups[a] == groups[a - a % 5] for a in groups)


def test_runs_of_many_texts_are_each_text_tokenized():
    from tesserae.functions import text
    from tesserae.plans import ir

    texts = ["", "The cat's naïve_dog", "  ", "a b\u00a0c\u2003d", "x" * 50, "日本 語 ½ ①x", "end "]
    for name in text.RUNS:
        got = list(zip(*text.runs(name, texts), strict=True))
        assert [(w, int(i), int(s), int(e), int(p)) for w, i, s, e, p in got] == [(t.text, i, t.start, t.end, t.position) for i, x in enumerate(texts) for t in text.tokenizer(ir.Var(name))(x)]


def test_fixpoint_compacts_long_recursions(db):
    assert len(rows(db, "e[a, b] := a in int_range(40), b = a + 1 t[b] := e[0, b] t[c] := t[b], e[b, c] ?[b] := t[b]")) == 40


def test_http_reader(db, tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "x.csv").write_text("k;v\n1;a\n2;b\n")
    (tmp_path / "x.json").write_text('{"k": 1}\n{"k": 2}\n')
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        assert rows(db, "?[k, v] <~ CsvReader(url: $u, types: ['Int', 'String'], delimiter: ';')", u=at + "/x.csv") == [(1, "a"), (2, "b")]
        assert rows(db, "?[k] <~ JsonReader(url: $u, fields: ['k'])", u=at + "/x.json") == [(1,), (2,)]
    finally:
        server.shutdown()


def test_timestamps_do_not_depend_on_the_zone_of_the_session(db, spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert db.evaluate("format_timestamp(1.5, 'Asia/Kolkata')") == "1970-01-01T05:30:01.500+05:30"
            assert db.evaluate("format_timestamp(-1, 'America/New_York')") == "1969-12-31T18:59:59-05:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("sizes", [(8_000_000, 4_000_000, 1 << 20), (40, 50, 7), (3, 4_000_000, 1)])
def test_triangles_in_tasks_of_bounded_size(spark, monkeypatch, sizes):
    """Hubs, loops, parallel edges and nulls, in one task and in tasks for colours and parts; pairs of edges are joined by no plan."""
    for name, value in zip(("CLOSING_EDGES", "PAIRED_EDGES", "PAIRS"), sizes, strict=True):
        monkeypatch.setattr(graph, name, value)
    rng = np.random.default_rng(2)
    edges = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 40, (220, 2))] + [("hub", f"n{i}") for i in range(40)] + [("hub", f"leaf{i}") for i in range(60)] + [("hub", "hub"), (None, "hub"), ("x", "y"), ("y", "x")]
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {v: (sum(b in near[a] for a in s for b in s) // 2, len(s)) for v, s in near.items()}
    out = graph.clustering(spark.createDataFrame(edges, "a string, b string"))
    got = out.collect()
    assert {r["node"]: (r["n_triangles"], r["degree"]) for r in got} == want and len(got) == len(want)
    assert all(r["cc"] == (2 * t / (k * (k - 1)) if k > 1 else 0) for r in got for t, k in [want[r["node"]]])
    assert graph.clustering(spark.createDataFrame([], "a long, b long")).count() == 0
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().sparkPlan().toString()


def test_distinct_rows_of_a_large_table_are_in_more_parts(spark, monkeypatch, tmp_path):
    spark.range(3000).selectExpr("id % 50 AS l_suppkey", "id % 7 AS l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = QUERIES["graph_degree"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" not in want._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(storage, "DISTINCT_BYTES", 100)
    got = QUERIES["graph_degree"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("FileScan parquet") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len(want.collect()) == 50
