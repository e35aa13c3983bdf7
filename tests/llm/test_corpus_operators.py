"""Scoring, packing, near-duplicates and mixing: against plain versions and edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import common, covertree, lm, minhash, mixing, packing, queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


DOCS = "doc_id long, text string, source string, block int, node string, k int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "a", 0, "x", 1), (2, "", None, 1, None, 2), (3, "The cat sat on THE mat", "a", 2, "y", 3), (3, "The cat sat on THE mat", "a", 2, "y", 3), (None, "the cat sat", "a", 3, "z", 4), (4, "a b", "b", 4, "z", 5), (5, "word " * 30_000, "b", 5, "z", 6), (-7, " \x0b\t ", None, 6, "z", 7), (8, "the dog sat on the mat and the cat sat on the dog", None, 7, "q", 8)]
    return spark.createDataFrame(rows, DOCS)


# --- language model --------------------------------------------------------------------------------


def plain_scores(rows, s):
    """Interpolated n-grams, one probability at a time."""
    train = [words(t) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 10]
    count = Counter()
    for x in train:
        x = ["<s>", *x, "</s>"]
        count.update(tuple(x[i : i + k]) for k in range(1, s.order + 1) for i in range(len(x) - k + 1))
    uni = {g[0]: c for g, c in count.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(uni.values()), len(uni)
    once, twice = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    d = once / (once + 2 * twice) if once and twice else 0.5
    out = []
    for i, t in rows:
        x = ["<s>", *words(t), "</s>"]
        base = sum(math.log10((uni.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in x[1:])
        score = 0.0
        for j in range(1, len(x)):
            w = x[j]
            p = 1.0 if not n else (uni[w] - d) / n if w in uni else d * v / n
            for k in range(1, min(s.order - 1, j) + 1):
                context = tuple(x[j - k : j])
                if count[context]:
                    p = (count[*context, w] + s.mu[k - 1] * p) / (count[context] + s.mu[k - 1])
            score += math.log10(p)
        out.append((i, zlib.crc32(str("" if i is None else i).encode()) % 10 == 0, len(x) - 1, sum(w in uni for w in x[1:]), n, base, score))
    return out


def near(a, b):
    return a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("settings", [lm.Settings(), lm.Settings(block_bytes=20_000, blocks_a_shard=3), lm.Settings(order=1), lm.Settings(order=2), lm.Settings(order=4, mu=(40.0, 4.0, 2.0), block_bytes=100_000)])
def test_scores(spark, sf, odd, settings):
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    for docs in (queries.table(spark, sf, "documents"), odd, odd.where("doc_id is null"), odd.limit(0)):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = sorted((tuple(r) for r in lm.score(docs, settings).collect()), key=key)
        want = sorted(plain_scores(rows, settings), key=key)
        assert len(got) == len(want) and all(near(a, b) for a, b in zip(got, want, strict=True))


def automaton(texts, settings):
    """The automaton over one block that is all of the corpus, and its tokens."""
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    tokens, starts = lm.sequences(table)
    found = []
    for k in range(1, settings.order + 1):
        last, known, which = lm.distinct(tokens, starts, k)
        found.append((last, which, np.bincount(which, minlength=len(known))))
    uni = found[0][2]
    totals = lm.Totals(tokens=int(uni.sum()), types=len(uni), once=int((uni == 1).sum()), twice=int((uni == 2).sum()), docs=len(texts))
    return lm.Automaton(len(tokens), starts, found, totals, settings), tokens, starts, found, totals


def test_states_are_contexts_of_training_and_failure_arcs_drop_their_first_word():
    a, tokens, starts, found, _ = automaton(["a b c a b d", "b c", "a b c"], lm.Settings(order=3))
    assert len(a.depth) == 2 + sum(len(c) for _, _, c in found[:2])  # the root, the beginning, words and pairs
    assert all(a.depth[a.fail[s]] == a.depth[s] - 1 for s in range(len(a.depth)) if s)
    # after "a b" the state is that of the pair, and its failure arc leads to the state of "b"
    first = int(starts[0]) + 1
    pair, single = a.to[1, first + 1], a.to[0, first + 1]
    assert a.depth[pair] == 2 and a.fail[pair] == single and a.depth[single] == 1 and a.fail[single] == 0
    assert a.depth[a.begin] == 1 and a.fail[a.begin] == 0


def test_arcs_and_failures_of_a_state_are_a_distribution():
    """Over the words that training knows, and the unknown word, what a state gives sums to one."""
    texts = ["a b c a b d", "b c", "a b c", "c c c a"]
    settings = lm.Settings(order=3)
    vocabulary = sorted({w for t in texts for w in t.split()})
    for context in ("", "a", "a b", "c c", "d", "b a"):
        total = 0.0
        for w in [*vocabulary, None, "unseen"]:  # None: the end
            text = context if w is None else f"{context} {w}".strip()
            probe = pa.table({"doc_id": [*range(len(texts)), 99], "text": [*texts, text]})
            tokens, starts = lm.sequences(probe)
            found = []
            for k in range(1, 4):
                last, known, which = lm.distinct(tokens, starts, k)
                inside = last < starts[-2]  # the probe is not of the training
                found.append((last, which, np.bincount(which[inside], minlength=len(known))))
            _, _, _, _, totals = automaton(texts, settings)
            a = lm.Automaton(len(tokens), starts, found, totals, settings)
            i, j = int(starts[-2]) + 1, int(starts[-1])
            upto = j if w is None else j - 1
            total += 10 ** (a.read(i, upto) - (a.read(i, upto - 1) if upto - 1 > i else 0.0 if upto - 1 == i else 0.0))
        assert math.isclose(total, 1.0, rel_tol=1e-9), (context, total)


def test_a_block_with_other_rows_than_it_asked_for_is_refused():
    docs = pa.table({"doc_id": [1], "text": ["a b"], "block": ["0.0"], "place": [0]})
    right = lm.ask("0.0", docs, lm.Settings(), 1)
    told = right.select(["block", "shard", "k", "low", "high"])
    check = right.column("keys")[-1].as_py()
    told = told.set_column(3, "low", pa.array([*told.column("low").to_pylist()[:-1], check], pa.binary()))
    totals = lm.Totals(1, 1, 1, 0, 1)
    assert lm.score_block(docs, told, totals, lm.Settings()).num_rows == 1
    for text in ("a b c", "a c"):  # other n-grams, in another number or not
        with pytest.raises(RuntimeError):
            lm.score_block(docs.set_column(1, "text", pa.array([text])), told, totals, lm.Settings())


def test_scores_of_rows_that_are_computed_anew(spark, sf):
    docs = queries.table(spark, sf, "documents")
    got = lm.score(docs.repartition(3), lm.Settings(block_bytes=50_000)).collect()
    want = {r["doc_id"]: r["score"] for r in lm.score(docs, stable=True).collect()}
    assert len(got) == len(want) and all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in got)


def test_held_out_text_is_likelier_than_under_the_base(spark, sf):
    r = queries.op2_lm_scoring(spark, sf).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# --- packing -----------------------------------------------------------------------------------------


def check_packing(spark, docs):
    pieces = queries.packed(docs).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        x = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want[r["doc_id"], x.tobytes()] += 1
    # every id of every document lies in one piece: pieces of equal documents are put together in any order
    got, by_sequence = defaultdict(lambda: defaultdict(Counter)), defaultdict(list)
    for p in pieces:
        ids = bytes(p["ids"])
        assert len(ids) == 4 * p["length"] > 0 and p["ids_crc32"] == zlib.crc32(ids)
        for j, i in enumerate(np.frombuffer(ids, "<u4").tolist()):
            got[p["doc_id"], p["doc_tokens"]][p["start"] + j][i] += 1
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    places = defaultdict(lambda: defaultdict(Counter))
    for (i, x), times in want.items():
        x = np.frombuffer(x, "<u4").tolist()
        for j, y in enumerate(x):
            places[i, len(x)][j][y] += times
    assert got == places
    padding = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_packing(spark, sf, odd):
    assert check_packing(spark, queries.table(spark, sf, "documents")) == 0
    assert check_packing(spark, odd) == 0
    special = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "naïve 中文 😀 \x85 text"), (3, "x" * 5000)], "doc_id long, text string")
    assert check_packing(spark, special) == 0
    assert packing.pack(odd.limit(0), queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_linear_program_meets_its_bound():
    rng = np.random.default_rng(0)
    for _ in range(5):
        lengths = np.unique(rng.integers(1, 64, 40))
        demand = rng.integers(1, 500, len(lengths))
        s = packing.solve(lengths, demand, 64)
        assert np.allclose(s.patterns @ s.times, demand) and (s.times >= -1e-9).all()
        assert (lengths @ s.patterns <= 64 + 1e-9).all()
        assert s.times.sum() <= s.bound * 1.001 and s.bound >= (lengths * demand).sum() / 64 - 1e-6


def test_knapsack_against_enumeration():
    lengths, values = np.array([3, 5, 7]), np.array([0.3, 0.55, 0.75])
    best = max(a * 0.3 + b * 0.55 + c * 0.75 for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 23)
    got, copies = packing.best_pattern(lengths, values, 23)
    assert math.isclose(got, best) and math.isclose(copies @ values, best) and lengths @ copies <= 23


# --- near-duplicates -----------------------------------------------------------------------------------


def classes(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = words(text)
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def check_minhash(docs):
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.select("doc_id", "text").collect()]
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    root = classes([i for i, _ in rows], links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(x), root[i], root[i] == i)
    return root


def test_minhash_near_duplicates(spark, sf):
    check_minhash(queries.table(spark, sf, "documents").select("doc_id", "text"))
    # a chain whose ends are no links, near copies that share a bucket without the first, short and empty texts
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join(base[k * 8 :] + [f"x{k}_{i}" for i in range(k * 8)]) for k in range(8)]
    rows = [(100 - i, t) for i, t in enumerate(chain)] + [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "b a"), (6, " ".join(base)), (7, " ".join(base).upper())]
    root = check_minhash(spark.createDataFrame(rows, "doc_id long, text string"))
    assert root[4] == 3 and root[100] == 6


def test_prefix_filter_loses_no_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 150)
    sets = []
    for i in range(120):
        x = np.delete(base, rng.choice(150, rng.integers(0, 16), replace=False))
        sets.append(np.unique(np.concatenate([x, rng.integers(0, 1 << 62, rng.integers(0, 16))]).astype(np.uint64)))
    count = Counter(v for x in sets for v in x.tolist())
    entries = {}
    for i, x in enumerate(sets):
        order = sorted(x.tolist(), key=lambda v: (count[v], v))
        small, large = minhash.prefixes(len(x), 85)
        entries[i] = {(small[0], v) for v in order[: small[1]]}, {(c, v) for c, k in large for v in order[:k]}
    links = candidates = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j and len(x) <= len(y):
                common = len(np.intersect1d(x, y))
                linked = 100 * common >= 85 * (len(x) + len(y) - common)
                shared = bool(entries[i][0] & entries[j][1])
                assert shared or not linked
                links, candidates = links + linked, candidates + shared
    assert 0 < links < candidates < 120 * 119 / 2


def test_minhash_far_copies_of_one_text(spark):
    """Copies that link with the base, with each other through it, or with nothing."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        text = list(base)
        for j in rng.choice(150, rng.integers(1, 7), replace=False):
            text[j] = f"x{i}_{j}"
        rows.append((i, " ".join(text)))
    check_minhash(spark.createDataFrame(rows, "doc_id long, text string"))


def test_pipeline_links_pairs_from_four_fifths_on(spark):
    """Pairs of 100 shingles or more that share 0.80 to 0.85 of them, and one pair just below 0.80 that stays apart."""
    rows, want = [], set()
    for i in range(40):
        text = [f"w{i}_{j}" for j in range(104 + i)]
        # an edit of the last words costs each text as many shingles
        n = len(text) - 4
        edits = next(e for e in range(n) if 100 * (n - e - 1) < 80 * (n + e + 1))
        near = text[: len(text) - edits] + [f"x{i}_{j}" for j in range(edits)]
        share = len(shingles(" ".join(text)) & shingles(" ".join(near))) / len(shingles(" ".join(text)) | shingles(" ".join(near)))
        assert 0.80 <= share < 0.85
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
        want.add(2 * i)
    far = text[: len(text) - edits - 1] + [f"y{j}" for j in range(edits + 1)]
    assert len(shingles(" ".join(text)) & shingles(" ".join(far))) < 0.8 * len(shingles(" ".join(text)) | shingles(" ".join(far)))
    rows += [(1000, " ".join(f"z{j}" for j in range(100))), (1001, " ".join(f"q{j}" for j in range(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want | {1000, 1001}
    apart = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(far))], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, apart, "").count() == 2


def test_minhash_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 9 and sum(r["doc_id"] == 3 and r["kept"] for r in got) == 2
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id in (1, 2, 4, 5, -7, 8)").count() == 6
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_minhash_broadcasts_no_table(spark, monkeypatch):
    """Spark sizes lists and what is exploded from them too low to tell which tables fit a driver."""
    plans, write = [], minhash.materialise

    def seen(df, *a, **k):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, *a, **k)

    monkeypatch.setattr(minhash, "materialise", seen)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[:i] + ["edit"] + base[i + 1 :]) for i in range(0, 400, 80)] + ["another text of some words here"] * 2 + ["alone in this table as it is"]
    out = minhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert out.count() == 3 and sum("Join" in p for p in plans) > 5 and not [p for p in plans if "Broadcast" in p]


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    want = classes({i for x in links for i in x}, links)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: r for i, r in want.items() if i in got} and all(i in got for a, b in links for i in (a, b) if a != b)


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    """A chain, a star, a loop, repeated links and a pair: in one task, without a job for each round, and round by round."""
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 220)] + [(300, 301), (301, 302), (302, 300), (300, 301), (5, 5), (400, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 220)]} | {300: 300, 301: 300, 302: 300, 400: 3, 3: 3}
    spark.sparkContext.setJobGroup("few links", "")
    rows = common.components(df).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["node"]: r["root"] for r in rows} == want and len(rows) == len(want) and len(jobs) <= 5
    monkeypatch.setattr(common, "LINKS_IN_ONE_TASK", 10)
    assert {r["node"]: r["root"] for r in common.components(df).collect()} == want
    assert common.components(df.limit(0)).count() == 0


def check_vectors(vectors, settings=None):
    s = settings or covertree.Settings()
    rows = [(r["vec_id"], r["label"], covertree.unit(r["embedding"])) for r in vectors.collect()]
    links = [(a, b) for i, (a, k, x) in enumerate(rows) for b, m, y in rows[:i] if k is not None and k == m and x is not None and y is not None and len(x) == len(y) and x @ y >= s.cosine]
    root, count = classes([i for i, _, _ in rows], links), Counter(i for x in links for i in x)
    for r in covertree.near_duplicates(vectors, s).collect():
        assert tuple(r) == (r["vec_id"], count[r["vec_id"]], root[r["vec_id"]], root[r["vec_id"]] == r["vec_id"])
    return len(links)


def test_embedding_near_duplicates(spark, sf):
    check_vectors(queries.table(spark, sf, "embeddings").select("vec_id", "label", "embedding"))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, int(i % 3 == 0), [float(e) for e in centres[i % 12] + rng.normal(size=8) * 0.12]) for i in range(700)]
    rows += [(1000, 0, None), (1001, 0, [0.0] * 8), (1002, None, rows[0][2]), (1003, 0, [float("nan")] * 8), (1004, 0, [None, *rows[1][2][1:]]), (1005, 0, [1.0, 2.0]), (1006, 0, [2.0, 4.0]), (1007, 0, []), (1008, 0, [1e300] * 8), (1009, 0, [1e-300] * 8), (1010, 0, [float("inf")] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("node", F.lit(1)).select("vec_id", "label", "embedding")
    assert check_vectors(vectors) > 1000
    assert check_vectors(vectors, covertree.Settings(cell=40, leaf=4)) > 1000  # many cells
    assert check_vectors(vectors, covertree.Settings(cell=12, most_pivots=3, leaf=4, chunk=50)) > 1000  # dealt again and again
    assert check_vectors(vectors, covertree.Settings(cell=12, most_pivots=2, leaf=4, cosine=0.6)) > 10_000  # nodes within reach as a whole
    repeated = covertree.near_duplicates(vectors.where("vec_id < 2").unionAll(vectors.where("vec_id = 0"))).where("vec_id = 0").collect()
    assert len(repeated) == 2 and all(r["n_links"] == 1 and r["kept"] for r in repeated)
    assert covertree.near_duplicates(vectors.limit(0)).count() == 0


def test_a_cell_whose_classes_all_miss_the_pivot_threshold(spark, monkeypatch):
    """Where the hash lets no class through, the smallest one stands for the cell."""
    rng = np.random.default_rng(6)
    rows = [(i, 7, [float(x) for x in np.array([1.0, 0.0, 0.0, 0.0]) + rng.normal(size=4) * 0.05]) for i in range(60)]
    real = F.pmod
    monkeypatch.setattr(covertree.F, "pmod", lambda a, b: F.lit(1 << 21) if "1048576" in str(b) else real(a, b))
    assert check_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), covertree.Settings(cell=10)) > 1000


def test_cover_tree_prunes():
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(50, 32)), 40, axis=0) + rng.normal(size=(2000, 32)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, compared, wholes = covertree.build(x, np.arange(2000), 2.0, 32), 0, 0

    def count(p, q):
        nonlocal compared
        compared += len(p) * len(q)

    def whole(a, b):
        nonlocal wholes
        wholes += len(a.points) * (len(a.points) - 1) // 2 if a is b else len(a.points) * len(b.points)

    covertree.dual(tree, tree, covertree.Settings().reach, count)
    assert compared < 2000 * 2000 / 10
    alone, compared = compared, 0
    covertree.dual(tree, tree, covertree.Settings().reach, count, whole)
    assert compared < alone / 10 and wholes > 50 * 40 * 39 // 2 * 0.9  # a dense cluster is counted, not compared


def test_scattered_vectors_meet_in_few_products():
    """Groups of two or three in a tree of scattered points are not compared node by node."""
    x = np.random.default_rng(8).normal(size=(4000, 48))
    x[2000:] = x[:2000] + np.random.default_rng(9).normal(size=(2000, 48)) * 0.4
    x /= np.linalg.norm(x, axis=1)[:, None]
    met = Counter()

    def count(p, q):
        met["products"] += 1
        met["pairs"] += len(p) * (len(p) - 1) // 2 if p is q else len(p) * len(q)

    tree = covertree.build(x, np.arange(4000), 2.0, 32)
    covertree.dual(tree, tree, covertree.Settings().reach, count)
    assert met["products"] < 100 and met["pairs"] <= 4000 * 3999 // 2


def test_many_visitors_of_a_cell_meet_it_in_several_tasks(spark):
    rng = np.random.default_rng(10)
    rows = [(i, 1, [float(e) for e in v]) for i, v in enumerate(np.repeat(rng.normal(size=(130, 16)), 3, axis=0) + rng.normal(size=(390, 16)) * 0.1)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    s = covertree.Settings(cell=40, visitors=30, leaf=4, shared=16, chunk=50)
    members = covertree.cells(covertree.prepared(vectors).select(F.monotonically_increasing_id().alias("node"), "label", F.lit(16).alias("dim"), F.lit(1).cast("long").alias("size"), "unit"), s)
    parts = covertree.parted(members, s).groupBy("cell", "part").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("seen")).collect()
    assert len({r["cell"] for r in parts}) < len(parts) and len({(r["cell"], r["own"]) for r in parts}) == len({r["cell"] for r in parts})
    assert sum(r["seen"] for r in parts) == members.where("not home").count() and members.where("home").count() == 390
    assert check_vectors(vectors, s) > 100


# --- mixing --------------------------------------------------------------------------------------------


def plain_targets(sizes, cap=3):
    """The excess reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: float(cap * sizes[s]) for s in over}


def check_mix(docs):
    rows = mixing.mix_sources(docs).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["size"]:
            assert r["taken"] % r["size"] == 0
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        epochs = math.floor(r["target"] / r["source_size"] + 1e-12) if r["source_size"] else 0
        assert r["taken"] in (epochs * r["size"], (epochs + 1) * r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    return rows


def test_mixing(spark, sf, odd):
    docs = queries.table(spark, sf, "documents")
    first = check_mix(docs)
    assert sorted(map(str, first)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    sizes = {r["doc_id"]: r["size"] for r in first}
    assert all(sizes[r["doc_id"]] == len(words(r["text"])) for r in docs.collect())
    check_mix(odd)
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert check_mix(odd.where("text is null"))[0]["target"] == 0
    copies = Counter((r["doc_id"], r["source"]) for r in mixing.repeated(docs).collect())
    taken = {(r["doc_id"], r["source"]): r["taken"] // r["size"] for r in first if r["size"]}
    assert all(copies[k] == n for k, n in taken.items())
    assert mixing.repeated(odd).columns == odd.columns
    assert mixing.repeated(odd.limit(0)).count() == 0


def test_mixing_repeats_rows_as_the_mix_takes_them(spark, odd):
    """Also where equal rows stand at the edge of what is taken, and one row is a third of all."""
    same = [(7, "one two three four", "a")] * 400 + [(i, f"text {i} of the source", "a") for i in range(600)] + [(i, f"other {i} words", "b") for i in range(300)] + [(9, "", "b"), (9, None, None), (None, "no id", None), (None, "no id", None)]
    docs = spark.createDataFrame(same, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("edge", F.lit(1))
    for weights in ((5, 2, 1), (1, 4), (1, 1), (3, 7, 2)):
        taken, count = Counter(), Counter()
        for r in mixing.mix_sources(docs, weights).collect():
            taken[r["doc_id"], r["source"], r["size"]] += r["taken"] // r["size"] if r["size"] else 1
        out = mixing.repeated(docs, weights)
        assert out.columns == docs.columns
        for r in out.collect():
            count[r["doc_id"], r["source"], len(words(r["text"]))] += 1
        assert count == +taken, weights


def test_mixing_prefers_quality(spark):
    rows = [(i, ("plain words in a row " * 5) if i % 2 else ("### $$$ %%% 000 " * 7)[:100], s) for i in range(2000) for s in ("a", "b") if s == "a" or i < 1200]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 4)).where("source = 'a'").collect()
    good = sum(r["taken"] > 0 for r in got if r["doc_id"] % 2)
    assert good > 1.5 * sum(r["taken"] > 0 for r in got if not r["doc_id"] % 2)


def test_nothing_to_plan_runs_python_in_the_mix(spark, sf):
    for mix in (mixing.mix_sources, mixing.repeated):
        plan = mix(queries.table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
