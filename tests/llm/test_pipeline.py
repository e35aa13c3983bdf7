"""The pipeline's stages against plain versions, on odd rows, and operators on batches of several slices."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_corpus_operators import classes, shingles

import corpus_pipeline
from tesserae.llm import html, license, lm, minhash, mixing, packing, pii, quality, queries, warc

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def held(rows, columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return queries.table(spark, sf, "documents")


def test_every_stage_against_a_plain_version(spark, sf, documents):
    columns = documents.columns
    before = rows_of(documents)

    # quality rules: the base rules, then the band of the language or script
    f, bands = quality.Fertility(queries.vocabulary("piece_bpe_32k.model")), quality.Bands()

    def good(r):
        words = (r["text"] or "").split()
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeat = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        band = bands.by_lang.get(r["lang"]) or bands.by_script[quality.script(r["text"] or "")]
        return len(words) >= 10 and 100 * len(repeat) <= 20 * len(words) and band.holds(*f.of(r["text"] or ""))

    docs = corpus_pipeline.quality_rules(spark, documents, sf)
    after = rows_of(docs)
    assert docs.columns == columns and held(after, columns) == held([r for r in before if good(r)], columns) and 0 < len(after) < len(before)

    # near duplicates: one document of each component of links from four fifths on
    before, sets = after, {r["doc_id"]: shingles(r["text"]) for r in after}
    links = [(a, b) for i, a in enumerate(sets) for b in list(sets)[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = classes(sets, links)
    docs = corpus_pipeline.near_dedup(spark, docs, sf)
    after = rows_of(docs)
    assert docs.columns == columns and {r["doc_id"] for r in after} == set(root.values()) and len(after) == len(set(root.values())) < len(before)

    # personal data: every span of the operator gives way, and nothing else changes
    before = {r["doc_id"]: r for r in after}
    docs = corpus_pipeline.personal_data(spark, docs, sf)
    after = rows_of(docs)
    assert docs.columns == columns and len(after) == len(before)
    for r in after:
        old = before[r["doc_id"]]
        want = pii.redact(old["text"], pii.Settings())
        assert r == old | {"text": want, "n_chars": len(want)}
        assert not any(pii.base_spans(r["text"]))

    # the mix: each row as often as the operator says
    times = Counter({(r["doc_id"], r["source"]): r["taken"] // r["size"] for r in mixing.mix_sources(docs).collect() if r["size"]})
    mixed = corpus_pipeline.source_mix(spark, docs, sf)
    assert mixed.columns == columns and held(rows_of(mixed), ["doc_id", "source"]) == +times

    # packing: all ids of all rows, once
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want, got = Counter(), defaultdict(Counter)
    for r in rows_of(mixed):
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 0]
        want.update((r["doc_id"], i, x) for i, x in enumerate(ids))
    for p in corpus_pipeline.pack(spark, mixed, sf).collect():
        ids = np.frombuffer(bytes(p["ids"]), "<u4")
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and len(ids) == p["length"]
        got[p["sequence_id"]].update(range(p["offset"], p["offset"] + p["length"]))
        want.subtract((p["doc_id"], p["start"] + i, x) for i, x in enumerate(ids.tolist()))
    assert not any(want.values()) and all(set(c) == set(range(len(c))) and max(c.values()) == 1 for c in got.values())


def test_run_is_the_stages_one_after_the_other(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "ids", "sequence_id"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "personal_data", "source_mix", "packing"]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows_and_empty_tables(spark, name):
    prose = "The committee met on a grey morning and agreed that every part of the report should be read once more before the week was over"
    long = " ".join(f"word{i} of a very long text" for i in range(40_000))
    rows = [(1, None, "en", "a", None, 1), (2, "", None, None, 0, 1), (3, prose, "en", "a", 5, 1), (3, prose, "en", "a", 5, 1), (None, prose + " indeed", None, "b", 5, 1), (4, " \t\n ", "xx", "b", 3, 1), (5, long, "en", "a", len(long), 1), (6, "mail me@home.org", "en", None, 16, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int").withColumns({c: F.lit("x") for c in ("key", "size", "row", "_row", "kept", "ids")} if name != "packing" else {"node2": F.lit(1)})
    out = STAGES[name](spark, docs, "")
    if name != "packing":
        assert out.columns == docs.columns and out.schema == docs.schema
    got = out.collect()
    expected = {"quality_rules": lambda: all(r["text"] and len(r["text"].split()) >= 10 for r in got), "near_dedup": lambda: sum(r["doc_id"] == 3 for r in got) == 1 and len(got) == 6 or len(got) == 7, "personal_data": lambda: len(got) == 8 and any(r["text"] == "mail <EMAIL>" for r in got), "source_mix": lambda: len({r["doc_id"] for r in got if not (r["text"] or "").split()}) == 3, "packing": lambda: {r["doc_id"] for r in got} == {1, 2, 3, None, 4, 5, 6}}
    assert expected[name](), got
    assert STAGES[name](spark, docs.limit(0), "").count() == 0


@pytest.fixture(scope="module")
def slices(spark):
    """Rows in one batch that is cut into several slices, and the same rows each in a part of their own."""
    rows = [(i, f"<p>Text {i} BEGINS here, mail a{i}@b.org</p> " + " ".join(f"Word{i}x{j % 97} And{j % 13}" for j in range(130_000)) + " Licensed under the MIT License. ", "en", f"http://x/{i}") for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    assert len(rows[0][1]) * len(rows) > 2 * (8 << 20)
    together = docs.coalesce(1)
    return together, docs.repartition(11, "doc_id")


OPERATORS = {
    "op1": lambda spark, d, tmp: license.scan(d),
    "op2": lambda spark, d, tmp: lm.score(d).select("doc_id", "n_tokens", "n_known", F.round("base_score", 3).alias("b"), F.round("score", 3).alias("s")),
    "op3": lambda spark, d, tmp: packing.cut(d, queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken"), 1024, 0, 16).select("doc_id", "doc_tokens", F.crc32("full").alias("f"), F.crc32("ids").alias("i")),
    "op5": lambda spark, d, tmp: (warc.write(d.select(F.col("doc_id").alias("page_id"), "url", F.col("text").alias("html")), tmp), warc.read(spark, tmp).select("page_id", "payload_digest", "payload_bytes"))[1],
    "op6": lambda spark, d, tmp: pii.find(d),
    "op7": lambda spark, d, tmp: minhash.signatures(d, minhash.Settings()),
    "op8": lambda spark, d, tmp: html.extract(d.select(F.col("doc_id").alias("page_id"), "url", F.col("text").alias("html"))),
    "op10": lambda spark, d, tmp: quality.rate(d, queries.vocabulary("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_slices_of_a_batch_are_as_good_as_batches(spark, slices, tmp_path, name):
    together, apart = (sorted(map(str, OPERATORS[name](spark, d, f"file://{tmp_path}/{i}").collect())) for i, d in enumerate(slices))
    assert together == apart and len(apart) >= 11
    if name == "op7":
        want = {i: len(shingles(t)) for i, t in slices[1].select("doc_id", "text").collect()}
        assert {r["doc_id"]: r["n_shingles"] for r in minhash.signatures(slices[0], minhash.Settings()).collect()} == want
