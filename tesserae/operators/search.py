"""Proximity search: nearest vectors, full text, MinHash banding; and queries' languages."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tesserae.functions.scalar import Compiler
from tesserae.functions.text import RUNS, analyzer, arrow_runs, call_of, terms_of
from tesserae.functions.text import tokenizer as tokenizer_of
from tesserae.plans import ir
from tesserae.plans.ir import EngineError
from tesserae.storage import cut, spread


def col(name: str):
    return F.col(f"`{name}`")


# --- nearest vectors ---------------------------------------------------------------------------------

DISTANCES = ("L2", "IP", "Cosine")
#: Queries held at once by a task; more are compared block by block.
BLOCK = 2048
#: Distances held at once by a task, and candidates before they are cut down to the k best of each query.
CELLS = 1 << 20


def distances(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "L2":
        return np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0)
    dots = q @ x.T
    if kind == "IP":
        return 1 - dots
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dots / np.sqrt((q**2).sum(1)[:, None] * (x**2).sum(1)[None])


def plain(value):
    """A value as Arrow takes it: rows as dictionaries."""
    return value.asDict(recursive=True) if isinstance(value, Row) else value


def nearest(queries: DataFrame, base: DataFrame, k: int, kind: str = "L2", radius: float | None = None) -> DataFrame:
    """(qid, key, distance): exact k nearest rows of base(key, vector) for each row of queries(qid, vector).

    Queries are joined block by block: each block of BLOCK queries meets the base once, each task
    keeps its k best candidates for each query, and a second aggregate picks k of those. The base is
    never broadcast, and what is shuffled is k rows for each query and task. A task holds CELLS distances
    and as many candidates at a time, whatever its rows and queries are; a distance that is no number comes last.
    """
    if kind not in DISTANCES:
        raise EngineError("search::distance", f"a distance is one of {DISTANCES}")
    if k <= 0:
        raise EngineError("search::k", "k is above zero")
    n = queries.count()
    blocks = max(1, math.ceil(n / BLOCK))
    q = queries.select("qid", "vector").withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    q = q.groupBy("_b").agg(F.collect_list(F.struct("qid", F.col("vector").cast("array<double>").alias("v"))).alias("qs"))
    schema = T.StructType([queries.schema["qid"].__class__("qid", queries.schema["qid"].dataType), T.StructField("key", base.schema["key"].dataType), T.StructField("distance", T.DoubleType())])
    id_type, out = to_arrow_type(queries.schema["qid"].dataType), None
    for b in range(blocks):
        rows = q.where(F.col("_b") == b).select("qs").first()  # BLOCK queries at most, about
        if rows is None:
            continue
        ids = [r["qid"] for r in rows["qs"]]
        shared = base.sparkSession.sparkContext.broadcast(np.array([r["v"] for r in rows["qs"]], float))

        def scan(batches, ids=ids, shared=shared):
            asked, q = pa.array([plain(x) for x in ids], id_type), shared.value
            best, found, n_found = np.full(len(q), math.inf), [], 0
            for batch in batches:
                batch = batch.filter(pc.is_valid(batch.column("vector")))
                for at in range(0, batch.num_rows, max(1, CELLS // len(q))):
                    part = batch.slice(at, max(1, CELLS // len(q)))
                    d = distances(q, part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), kind)
                    rank = np.where(np.isnan(d), math.inf, d)
                    if d.shape[1] >= k:
                        best = np.minimum(best, np.partition(rank, k - 1, axis=1)[:, k - 1])
                    # rows that tie with the last are kept: the key decides between them later
                    i, j = np.nonzero(rank <= best[:, None])
                    found.append((i, d[i, j], part.column("key").take(pa.array(j))))
                    n_found += len(i)
                    if n_found > max(CELLS, 4 * k * len(q)):
                        found, best = [kept(found, best)], best
                        n_found = len(found[0][0])
            if found:
                i, d, key = kept(found, best)
                for at in range(0, len(i), 4096):
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(i[at : at + 4096])), key[at : at + 4096], pa.array(d[at : at + 4096])], names=["qid", "key", "distance"])

        def kept(found, best):
            """Of the candidates (query, distance, key) those that are no farther than a query's k-th, which `best` becomes."""
            i, d = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            rank = np.where(np.isnan(d), math.inf, d)
            order = np.lexsort((rank, i))
            n = np.bincount(i, minlength=len(best))
            enough = np.flatnonzero(n >= k)
            best[enough] = np.minimum(best[enough], rank[order][(np.cumsum(n) - n)[enough] + k - 1])
            at = np.flatnonzero(rank <= best[i])
            return i[at], d[at], pa.concat_arrays([f[2] for f in found]).take(pa.array(at))

        part = base.select("key", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(scan, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return base.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("qid").orderBy("distance", "key")
    out = out.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k).drop("_i")
    return out.where(F.col("distance") <= radius) if radius is not None else out


# --- full text -----------------------------------------------------------------------------------------


def terms_in(texts: list, tokenizer, split, terms) -> tuple:
    """Distinct terms of all texts, and for each term in them its number, text, start, end and position, in order."""
    if (name := call_of(tokenizer)[0]) in RUNS:
        words, doc, start, end, position = arrow_runs(name, texts)
    else:
        found = [(t, i) for i, text in enumerate(texts) for t in split(text)]
        words = pa.array([t.text for t, _ in found], pa.string())
        doc, start, end, position = np.array([(i, t.start, t.end, t.position) for t, i in found], np.int64).reshape(-1, 4).T
    coded = words.dictionary_encode()
    made = [terms(w) for w in coded.dictionary.to_pylist()]  # each distinct word goes through the filters once
    flat = pa.array([x for m in made for x in m], pa.string()).dictionary_encode()
    term, count = flat.indices.to_numpy(zero_copy_only=False), np.array([len(m) for m in made], np.int64)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    times = count[code]
    place = np.repeat(np.arange(len(code)), times)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
    code = term[(np.cumsum(count) - count)[code[place]] + nth].astype(np.int64) if len(place) else np.empty(0, np.int64)
    return flat.dictionary, code, doc[place], start[place], end[place], position[place]


def postings(docs: DataFrame, tokenizer, filters: list) -> DataFrame:
    """(token, key, tf, positions, starts, ends, total) for docs(key, text)."""
    return stored_postings(docs, tokenizer, filters).select("token", "key", "tf", *[places(n).alias(n) for n in PLACES], "total")


#: What `places` of a stored posting holds, one list after the other, each as long as tf.
PLACES = ("positions", "starts", "ends")


def places(name: str):
    """One of the lists in `places`."""
    n = F.col("tf").cast("int")
    return F.slice("places", n * PLACES.index(name) + 1, n)


def stored_postings(docs: DataFrame, tokenizer, filters: list) -> DataFrame:
    """(token, key, tf, places, total) for docs(key, text): a row for each token of each key, and one
    without a token for each key with a text, so that the index itself says how many texts it holds. Rows come in runs
    sorted by token, a run for some megabytes of text: a task that sorted all of its rows would write most of them to disk
    first, and a scan skips pages of a run as it does those of a sorted file. Places are one list, as writing a list
    costs more than writing its numbers."""
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("key", docs.schema["key"].dataType), T.StructField("tf", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("total", T.LongType())])

    most = RUN_ROWS, RUN_BYTES

    def run(batches):
        split, terms = tokenizer_of(tokenizer), terms_of(filters)
        for whole in batches:
            for batch in in_runs(whole.filter(pc.is_valid(whole.column("text"))), *most):
                yield rows_of(batch, split, terms)

    def rows_of(batch, split, terms):
        words, code, doc, start, end, position = terms_in(batch.column("text").to_pylist(), tokenizer, split, terms)
        n = batch.num_rows
        by_name = pc.array_sort_indices(words)
        rank = np.empty(len(by_name), np.int64)
        rank[by_name.to_numpy()] = np.arange(len(by_name))
        order = stable_order(rank[code])  # texts are in order already
        first = np.ones(len(order), bool)
        first[1:] = (doc[order][1:] != doc[order][:-1]) | (code[order][1:] != code[order][:-1])
        begins = np.flatnonzero(first)
        at = order[begins]
        times = np.diff(np.append(begins, len(order)))
        flat, of = np.empty(3 * len(order), np.int32), np.repeat(np.arange(len(begins)), times)
        for i, x in enumerate((position, start, end)):
            flat[np.arange(len(order)) + 2 * begins[of] + i * times[of]] = x[order]
        offsets = pa.array(3 * np.concatenate([begins, np.full(n + 1, len(order))]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
        token = pa.concat_arrays([words.take(pa.array(code[at])), pa.nulls(n, pa.string())])
        key = batch.column("key").take(pa.array(np.concatenate([doc[at], np.arange(n)])))
        tf = np.concatenate([times, np.zeros(n, np.int64)])
        total = np.bincount(doc, minlength=n)
        return pa.RecordBatch.from_arrays([token, key, pa.array(tf), lists, pa.array(np.concatenate([total[doc[at]], total]))], names=schema.names)

    return spread(docs.select("key", "text"), "key").mapInArrow(run, schema)


def stable_order(x: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 to 2^32, by their halves: numpy sorts 16 bits in linear time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return order if not len(x) or x.max() < 1 << 16 else order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]


#: Texts and bytes of text in a run of an index's rows.
RUN_ROWS, RUN_BYTES = 1024, 2 << 20


def in_runs(batch: pa.RecordBatch, rows: int, size: int):
    """A batch in slices of so many texts and bytes of text at most; a longer text comes alone."""
    at, start = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < batch.num_rows:
        end = int(np.searchsorted(at, (at[start - 1] if start else 0) + size, "right"))
        end = min(max(start + 1, end), start + rows)
        yield batch.slice(start, end - start)
        start = end


FTS_TOKEN = re.compile(r'\s+|(?P<near>NEAR(?:/(?P<n>\d+))?\s*\()|(?P<quoted>"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')|(?P<op>[(),;*])|\^(?P<boost>\d+(?:\.\d*)?)|(?P<word>\w+)')


class TextQuery:
    """Parses literals, "phrases", prefix*, ^boost, AND, OR, NOT, NEAR/n(...), brackets."""

    def __init__(self, text: str) -> None:
        self.t, at = [], 0
        while at < len(text):
            m = FTS_TOKEN.match(text, at)
            if not m:
                raise EngineError("fts::parser", f"unexpected {text[at:at + 10]!r}")
            if m.lastgroup:
                kind = next(k for k in ("near", "quoted", "op", "boost", "word") if m.group(k) is not None)
                self.t.append((kind, m.group(kind), m.group("n")))
            at = m.end()
        self.i = 0

    def peek(self) -> tuple:
        return self.t[self.i] if self.i < len(self.t) else ("end", "", None)

    def parse(self):
        out = self.any()
        if self.peek()[0] != "end":
            raise EngineError("fts::parser", f"unexpected {self.peek()[1]!r}")
        return out

    def any(self):
        parts = [self.all()]
        while self.peek()[:2] in (("word", "OR"), ("op", ","), ("op", ";")):
            self.i += 1
            parts.append(self.all())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def all(self):
        parts, nots = [self.term()], []
        while True:
            kind, text, _ = self.peek()
            if (kind, text) == ("word", "AND"):
                self.i += 1
                parts.append(self.term())
            elif (kind, text) == ("word", "NOT"):
                self.i += 1
                nots.append(self.term())
            elif kind in ("near", "quoted") or kind == "word" and text != "OR" or (kind, text) == ("op", "("):
                parts.append(self.term())
            else:
                break
        out = parts[0] if len(parts) == 1 else ("and", parts)
        return ("not", out, nots[0] if len(nots) == 1 else ("or", nots)) if nots else out

    def literal(self):
        kind, text, _ = self.peek()
        if kind not in ("word", "quoted"):
            raise EngineError("fts::parser", f"expected a word, found {text!r}")
        self.i += 1
        text, prefix, boost = re.sub(r"\\(.)", r"\1", text[1:-1]) if kind == "quoted" else text, False, 1.0
        if self.peek()[:2] == ("op", "*"):
            prefix, self.i = True, self.i + 1
        if self.peek()[0] == "boost":
            boost, self.i = float(self.peek()[1]), self.i + 1
        return ("literal", text, prefix, boost)

    def term(self):
        kind, text, n = self.peek()
        if kind == "near":
            self.i += 1
            words = []
            while self.peek()[:2] != ("op", ")"):
                words.append(self.literal())
            self.i += 1
            return ("near", words, int(n) if n else 10)
        if (kind, text) == ("op", "("):
            self.i += 1
            out = self.any()
            if self.peek()[:2] != ("op", ")"):
                raise EngineError("fts::parser", "a bracket does not end")
            self.i += 1
            return out
        return self.literal()


def analysed(node, analyse):
    """The query with literals as the index's tokens; a literal of several tokens is all of them."""
    if node[0] == "literal":
        if node[2]:
            return node
        words = [t.text for t in analyse(node[1])]
        parts = [("literal", w, False, node[3]) for w in words]
        return parts[0] if len(parts) == 1 else ("and", parts)
    if node[0] == "near":
        flat = [analysed(x, analyse) for x in node[1]]
        return ("near", [y for x in flat for y in (x[1] if x[0] == "and" else [x])], node[2])
    if node[0] == "not":
        return ("not", analysed(node[1], analyse), analysed(node[2], analyse))
    return (node[0], [analysed(x, analyse) for x in node[1]])


def literals(node) -> set[tuple[str, bool]]:
    """(word, whether a prefix) of all literals in a query."""
    if node[0] == "literal":
        return {(node[1], node[2])}
    inner = node[1:] if node[0] == "not" else node[1]
    return {x for n in inner for x in literals(n)}


def has_near(node) -> bool:
    if node[0] in ("literal", "near"):
        return node[0] == "near"
    return any(has_near(n) for n in (node[1:] if node[0] == "not" else node[1]))


def full_text(index: DataFrame, n_docs: int, query, analyse, k: int | None, kind: str = "tf_idf") -> DataFrame:
    """(key, score): index is stored_postings(); only the rows of the query's tokens leave the scan, with positions for NEAR alone."""
    texts = [query] if isinstance(query, str) else list(query)
    trees = [analysed(TextQuery(t).parse(), analyse) for t in texts if t.strip()]
    if trees:  # one pass over the index; what follows reads the rows of the query's words alone
        wanted, near = literals(("or", trees)), any(has_near(t) for t in trees)
        exact, prefixes = sorted({w for w, prefix in wanted if not prefix}), sorted({w for w, prefix in wanted if prefix})
        test = F.col("token").isin(exact) if exact else F.lit(False)
        for w in prefixes:
            test = test | F.col("token").startswith(w)
        index = cut(index.where(test).select("token", "key", "tf", *[places("positions").alias("positions")] * near))

    def weight(tf, n, boost):
        if kind == "tf":
            return tf * boost
        return tf * F.ln(F.lit(1.0) + (F.lit(float(n_docs)) - n + 0.5) / (n + 0.5)) * boost

    def literal(node, *also):
        _, word, prefix, boost = node
        if prefix:
            hit = index.where(F.col("token").startswith(word))
            rows = hit.groupBy("key").agg(F.max(F.struct("token", "tf", *also)).alias("m")).select("key", "m.tf", *[f"m.{c}" for c in also])
        else:
            hit = index.where(F.col("token") == word)
            rows = hit.select("key", "tf", *also)
        found = hit.agg(F.count(F.lit(1)).cast("double").alias("n"))
        rows = rows.crossJoin(F.broadcast(found))  # one row
        return rows.select("key", weight(F.col("tf").cast("double"), F.col("n"), F.lit(boost)).alias("score"), *also)

    def scored(node) -> DataFrame:
        if node[0] == "literal":
            return literal(node).select("key", "score")
        if node[0] in ("and", "or"):
            parts = [scored(x) for x in node[1]]
            if not parts:
                return index.select("key", F.lit(0.0).alias("score")).limit(0)
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionAll(p)
            if node[0] == "or":
                return rows.groupBy("key").agg(F.max("score").alias("score"))
            return rows.groupBy("key").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(parts)).select("key", "score")
        if node[0] == "not":
            return scored(node[1]).join(scored(node[2]).select("key"), "key", "left_anti")
        rows = None
        for x in node[1]:
            p = literal(("literal", x[1], x[2], 1.0), "positions").select("key", "positions")
            if rows is None:
                rows = p
                continue
            p = p.withColumnRenamed("positions", "other")
            close = F.filter(F.col("other"), lambda b: F.exists(F.col("positions"), lambda a: F.abs(a - b) <= node[2]))
            rows = rows.join(p, "key").select("key", close.alias("positions")).where(F.size("positions") > 0)
        found = rows.agg(F.count(F.lit(1)).cast("double").alias("n"))
        return rows.crossJoin(F.broadcast(found)).select("key", weight(F.size("positions").cast("double"), F.col("n"), F.lit(sum(x[3] for x in node[1]))).alias("score"))

    if not trees:
        return index.select("key", F.lit(0.0).alias("score")).limit(0)
    out = scored(trees[0] if len(trees) == 1 else ("or", trees))
    return out.orderBy(F.desc("score"), "key").limit(k) if k is not None else out


# --- MinHash banding --------------------------------------------------------------------------------------


def bands_for(n_perm: int, threshold: float, fp_weight: float = 1.0, fn_weight: float = 1.0) -> tuple[int, int]:
    """(bands, rows) with the least weighted error: the S-curve's area on the wrong sides of the threshold."""
    x0, x1 = np.linspace(0, threshold, 200), np.linspace(threshold, 1, 200)
    best = (math.inf, 1, 1)
    for b in range(1, n_perm + 1):
        for r in range(1, n_perm // b + 1):
            fp = np.trapezoid(1 - (1 - x0**r) ** b, x0)
            fn = np.trapezoid((1 - x1**r) ** b, x1)
            best = min(best, (float(fp_weight * fp + fn_weight * fn), b, r))
    return best[1], best[2]


def band_hashes(items: DataFrame, n_perm: int, b: int, r: int, n_gram: int, tokenizer, filters: list) -> DataFrame:
    """(key, band): a hash for each band of each row of items(key, value), value a text or a list."""
    kind, is_text = items.schema["key"].dataType, isinstance(items.schema["value"].dataType, T.StringType)
    most = RUN_ROWS, RUN_BYTES
    seeds = np.arange(1, n_perm + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        split, terms = (tokenizer_of(tokenizer), terms_of(filters)) if is_text else (None, None)
        for whole in batches:
            whole = whole.filter(pc.is_valid(whole.column("value")))
            for batch in in_runs(whole.rename_columns(["key", "text"]), *most) if is_text else (whole.slice(i, most[0]) for i in range(0, whole.num_rows, most[0])):
                yield bands_of(batch, split, terms)

    def bands_of(batch, split, terms):
        values = batch.column(1).to_pylist()
        if is_text:
            words, code, doc, *_ = terms_in(values, tokenizer, split, terms)
        else:
            coded = pa.array([str(v) for value in values for v in value], pa.string()).dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(values)), [len(v) for v in values])
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))[code]
        # texts of at least n_gram words have all runs of so many, shorter ones the run of all their words
        n, size = n_gram, np.bincount(doc, minlength=len(values))
        first = np.cumsum(size) - size
        grams, of = [], []
        for length in range(1, n + 1):
            at = first[size == length] if length < n else np.flatnonzero(size[doc] - (np.arange(len(doc)) - first[doc]) >= n)
            gram = np.full(len(at), length, np.uint64)
            for i in range(length):
                gram = mixed(gram + h[at + i])
            grams.append(gram)
            of.append(doc[at])
        gram, of = np.concatenate(grams), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        gram, of = gram[order], of[order]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        bands = np.tile(np.arange(1, b + 1).astype(np.uint64)[:, None], len(starts))
        for i in range(b * r if len(starts) else 0):
            least = (gram ^ seeds[i]) * np.uint64(0xBF58476D1CE4E5B9)
            least ^= gram * (seeds[i] | np.uint64(1))
            bands[i // r] = mixed(bands[i // r] + np.minimum.reduceat(least, starts))
        key = batch.column("key").take(pa.array(np.repeat(of[starts], b)))
        return pa.RecordBatch.from_arrays([key, pa.array(bands.T.reshape(-1).view(np.int64))], names=["key", "band"])

    return spread(items.select("key", "value"), "key").mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("band", T.LongType())]))


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers, all of whose bits follow from all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sharing_bands(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, key) that share a band: queries(key, band) against index(key, band)."""
    return queries.select(F.col("key").alias("qid"), "band").join(index, "band").select("qid", "key").distinct()


# --- as atoms -------------------------------------------------------------------------------------------


def key_struct(r):
    return F.struct(*[col(k) for k in r.key_names])


def extracted(r, config: dict) -> DataFrame:
    """(key, value): the extractor over the rows that its filter keeps."""
    c = Compiler(r.df)
    df = r.df
    if "extract_filter" in config:
        df = df.where(c.column(config["extract_filter"]))
    value = Compiler(df).column(config["extractor"]) if "extractor" in config else col(r.values[0].name)
    return df.select(key_struct(r).alias("key"), value.alias("value"))


def lsh_shape(config: dict) -> tuple[int, int, int, int]:
    n = int(config.get("n_perm", 200))
    b, r = bands_for(n, float(config.get("target_threshold", 0.9)), float(config.get("false_positive_weight", 1)), float(config.get("false_negative_weight", 1)))
    return n, b, r, int(config.get("n_gram", 1))


def vectors_of(r, config: dict) -> DataFrame:
    """(key, field, idx, vector): a row for each vector of the indexed fields; idx is its place in a list of vectors."""
    df = r.df.where(Compiler(r.df).column(config["filter"])) if "filter" in config else r.df
    out = None
    for f in config["fields"]:
        several = isinstance(df.schema[f].dataType, T.ArrayType) and isinstance(df.schema[f].dataType.elementType, T.ArrayType)
        each = [F.posexplode(col(f)).alias("idx", "vector")] if several else [F.lit(None).cast("int").alias("idx"), col(f).alias("vector")]
        part = df.select(key_struct(r).alias("key"), F.lit(f).alias("field"), *each).where("vector is not null")
        part = part.select("key", "field", F.col("idx").cast("long").alias("idx"), F.col("vector").cast("array<double>").alias("vector"))
        out = part if out is None else out.unionAll(part)
    fits = F.size("vector") == int(config["dim"])
    return out.withColumn("vector", F.when(fits, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector has {config['dim']} elements")).cast("array<double>")))


def entries(r, kind: str, config: dict) -> DataFrame:
    """What an index stores of a relation's rows."""
    if kind == "normal":
        return r.df.select(*[col(c) for c in dict.fromkeys([*config["columns"], *r.key_names])])
    if kind == "hnsw":
        return vectors_of(r, config)
    if kind == "fts":
        return stored_postings(extracted(r, config).withColumnRenamed("value", "text"), config["tokenizer"], config["filters"])
    n, b, rr, g = lsh_shape(config)
    return band_hashes(extracted(r, config), n, b, rr, g, config["tokenizer"], config["filters"])


#: What an index's files are sorted by, so that a scan skips pages that hold other values; stored_postings() makes sorted runs itself.
SORTED_BY = {"fts": [], "lsh": ["band"], "hnsw": []}


def arranged(df: DataFrame, kind: str, config: dict) -> DataFrame:
    by = config["columns"] if kind == "normal" else SORTED_BY[kind]
    return df.sortWithinPartitions(*[col(c) for c in by]) if by else df


def changed(stored: DataFrame, r, kind: str, config: dict, new: DataFrame, gone: DataFrame) -> DataFrame:
    """The stored rows after `new` rows of the relation came and `gone` ones went: only theirs are made anew."""
    from dataclasses import replace

    if kind == "normal":
        return entries(r, kind, config)
    keys = new.select(key_struct(r).alias("__key")).unionAll(gone.select(key_struct(r).alias("__key"))).distinct()
    kept = stored.join(keys, F.col("key").eqNullSafe(F.col("__key")), "left_anti")
    return kept.unionByName(entries(replace(r, df=new), kind, config).select(*stored.columns))


def index_rows(r, index: str) -> DataFrame:
    """What an index holds, as a relation."""
    kind, config = r.indices[index]
    stored, keys = r.data[index], [F.col("key").getField(k).alias(f"src_{k}") for k in r.key_names]
    if kind == "fts":
        return stored.where("token is not null").select(F.col("token").alias("word"), *keys, *[places(c).cast("array<long>").alias(n) for c, n in (("starts", "offset_from"), ("ends", "offset_to"), ("positions", "position"))], F.col("total").alias("total_length"))
    if kind == "lsh":
        return stored.select(F.col("band").alias("hash"), *keys)
    return stored.select(*keys, "field", "idx", "vector") if kind == "hnsw" else stored


def text_hits(index: DataFrame, asked: DataFrame, config: dict, k: int | None, kind: str) -> DataFrame | None:
    """(q, key, score) for each text of asked(q). A query's text decides its plan; plans are made and run some at a time."""
    n = index.where("token is null").count()
    analyse = analyzer(config["tokenizer"], config["filters"])
    texts, found = asked.toLocalIterator(), None
    while group := list(itertools.islice(texts, 64)):
        part = None
        for row in group:
            hits = full_text(index, n, row["q"], analyse, k, kind)
            hits = hits.select(F.lit(row["q"]).alias("q") if isinstance(row["q"], str) else F.array(*map(F.lit, row["q"])).alias("q"), "key", "score")
            part = hits if part is None else part.unionAll(hits)
        part = cut(part) if len(group) > 1 else part
        found = part if found is None else found.unionAll(part)
    return found


def search_atom(catalog, atom: ir.SearchAtom, rows: DataFrame, constants) -> DataFrame:
    """rows joined with what a search finds for each of them."""
    r = catalog.get(atom.relation)
    if atom.index not in r.indices:
        raise EngineError("query::no_index", f"{atom.relation} has no index {atom.index}")
    if not r.keys:
        raise EngineError("search::keys", f"{atom.relation} is searched by its keys, and declares none")
    kind, config = r.indices[atom.index]
    stored = r.data[atom.index]
    options = dict(atom.options)
    if "query" not in options:
        raise EngineError("search::query", "a search has a query")
    c = Compiler(rows)
    number = lambda name, default=None: constants(options[name]) if name in options else default
    k = number("k")
    if k is not None and (not isinstance(k, int) or k <= 0):
        raise EngineError("search::k", "k is above zero")
    base = r.df
    test = options.get("filter")
    binds = {o: options[o].name for o in options if o.startswith("bind_")}
    query = c.value(options["query"])
    asked = rows.select(query.col.alias("q")).where("q is not null").distinct()

    def passing(full: DataFrame) -> DataFrame:
        """The rows that meet the filter, which sees the atom's variables and the relation's columns."""
        named = {e.name: name for name, e in atom.named if isinstance(e, ir.Var)}
        view = full.select("*", *[col(n).alias(v) for v, n in named.items() if v not in full.columns])
        return view.where(Compiler(view).column(test)).select(*full.columns)

    down, extra, radius = False, [], None
    if kind == "hnsw":
        if k is None:
            raise EngineError("search::k", "a vector search has a k")
        if test is not None:  # search among the rows that pass: the k nearest of them, not those of the k nearest that pass
            stored = stored.join(passing(base).select(key_struct(r).alias("__key")), F.col("key").eqNullSafe(F.col("__key")), "left_semi")
        places = stored.select(F.struct("key", "field", "idx").alias("key"), "vector")
        hits = nearest(asked.select(F.struct("q").alias("qid"), F.col("q").alias("vector")), places, k, config["distance"])
        found = hits.select(F.col("qid.q").alias("q"), F.col("key.key").alias("key"), F.col("distance").alias("score"), F.col("key.field").alias("field"), F.col("key.idx").alias("idx"))
        extra, radius = ["field", "idx"], number("radius")
    elif kind == "fts":
        found, down = text_hits(stored, asked, config, None if test is not None else k, number("score_kind", "tf_idf")), True
    elif kind == "lsh":
        n, b, rr, g = lsh_shape(config)
        mine = band_hashes(asked.select(F.struct("q").alias("key"), F.col("q").alias("value")), n, b, rr, g, config["tokenizer"], config["filters"])
        found = sharing_bands(mine, stored).select(F.col("qid.q").alias("q"), "key", F.lit(0.0).alias("score"))
    else:
        raise EngineError("query::search", f"{atom.index} is not an index for searches")
    if found is None:
        found = rows.sparkSession.createDataFrame([], T.StructType([T.StructField("q", asked.schema["q"].dataType), T.StructField("key", stored.schema["key"].dataType), T.StructField("score", T.DoubleType())]))
    hits = found.select("q", F.col("score").alias("__score"), *[F.col(x).alias(f"__{x}") for x in extra], *[F.col("key").getField(n).alias(f"__k_{n}") for n in r.key_names])
    wanted = {n for n, _ in atom.named} | ({"", *config.get("fields", [])} if "bind_vector" in binds else set()) | ({""} if test is not None else set())
    if wanted <= set(r.key_names):  # the hits know all that is asked for
        full = hits.withColumnsRenamed({f"__k_{n}": n for n in r.key_names})
    else:
        on = F.lit(True)
        for n in r.key_names:
            on = on & col(n).eqNullSafe(col(f"__k_{n}"))
        full = hits.join(base, on).drop(*[f"__k_{n}" for n in r.key_names])
    if test is not None and kind != "hnsw":
        full = passing(full)
    if k is not None:
        w = Window.partitionBy("q").orderBy(F.desc("__score") if down else F.asc("__score"), *[col(n) for n in r.key_names], *[F.col(f"__{x}") for x in extra])
        full = full.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= k).drop("__i")
    if radius is not None:
        full = full.where(F.col("__score") <= F.lit(float(radius)))
    if "bind_vector" in binds:
        vector = None
        for f in config["fields"]:
            kind_of = full.schema[f].dataType.elementType
            value = F.get(col(f), F.col("__idx").cast("int")) if isinstance(kind_of, T.ArrayType) else col(f)
            vector = F.when(F.col("__field") == f, value) if vector is None else vector.when(F.col("__field") == f, value)
        full = full.withColumn("__vec", vector)
    # names for the variables, equalities for what is bound or constant
    out = full.select(F.col("q").alias("__q"), *[F.col(x) for x in ("__score", "__field", "__idx", "__vec") if x in full.columns], *[col(n).alias(f"__v{i}") for i, (n, _) in enumerate(atom.named)])
    joined = rows.join(out, query.col == F.col("__q"))
    keep = list(rows.columns)
    for i, (_, e) in enumerate(atom.named):
        if isinstance(e, ir.Var) and e.name == "_":
            continue
        if isinstance(e, ir.Var) and e.name not in keep:
            joined = joined.withColumn(e.name, F.col(f"__v{i}"))
            keep.append(e.name)
        else:
            joined = joined.where(F.col(f"__v{i}").eqNullSafe(Compiler(joined).column(e)))
    for option, source in (("bind_distance", "__score"), ("bind_score", "__score"), ("bind_field", "__field"), ("bind_field_idx", "__idx"), ("bind_vector", "__vec")):
        if option in binds:
            if source not in joined.columns:
                raise EngineError("search::bind", f"{option} is of vector searches")
            joined = joined.withColumn(binds[option], F.col(source))
            keep.append(binds[option])
    return joined.select(*[col(n) for n in keep])
