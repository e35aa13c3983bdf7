"""Near-duplicate documents by MinHash with tensored banding.

Two collections of `m` small hashes are computed, each of `k` minhashes; the m * m pairs of one hash
from either are the table keys. That is as selective as m * m bands of 2k rows, for 2mk minhashes
in place of 2m²k. Documents with equal shingle sets are one class and enter the tables once.

Links come from the tables in two steps, so that no group of near copies is spelled out in pairs:
each class in a bucket is first compared with one class only, that which shares most buckets with
others. Then the classes in buckets that still hold more than one component are compared across components. A group of copies
too far apart to link would make pairs as the square of its size here, so an exact prefix filter
picks the pairs: sets that reach the threshold share one of the few shingles that come first in an
order of rising frequency, and copies that are far apart put their own edits first, so that few of
the shingles that follow are shared and most of their pairs are ruled out in the join. Every
comparison is on full shingle sets. What is left to chance is only whether a pair at the threshold
shares a bucket: it fails with probability 2 (1 - t^k)^m at most.

A text's set: its distinct windows of five words, hashed to 64 bits; with fewer words, the whole
sequence. Nulls and texts without words have empty sets and link with nothing. Rows with a null id
take part; a component's id is its smallest id that is not null. Repeated rows are of one class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import components, discard, hash_words, materialise, mix, small_batches, sorted_join, split_words, windows


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 85  # links have 100 * intersection >= percent * union
    m: int = 9
    k: int = 2

    @property
    def minhashes(self) -> int:
        return 2 * self.m * self.k


def shingle_sets(text: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, flat = split_words(text, lower=True)
    words = hash_words(flat)
    all_windows = windows(words, k)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(all_windows[a : b - k + 1]))
        elif b > a:
            out.append(mix(windows(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def small_hashes(shingles: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Minhashes under each seed, combined k at a time."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)]
        for i, seed in enumerate(seeds):
            # multiply-shift keeps order by the high bits, after which ties do not matter
            least[i] = min(least[i], ((part ^ seed) * np.uint64(0x9E3779B97F4A7C15) ^ (part * (seed | np.uint64(1)))).min())
    return windows_of(least, k)


def windows_of(values: np.ndarray, k: int) -> np.ndarray:
    h = values.reshape(-1, k)
    out = h[:, 0].copy()
    for j in range(1, k):
        out = mix(out) + h[:, j]
    return mix(out)


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null for an empty one), the small hashes."""
    seeds = mix(np.arange(1, s.minhashes + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in small_batches(batches, "text"):
            rows, seen = [], {}
            for x in shingle_sets(batch.column("text"), s.words):
                if not len(x):
                    rows.append((0, None, None))
                    continue
                node = xxhash.xxh3_128_digest(x.tobytes())
                if node not in seen:
                    seen[node] = small_hashes(x, seeds, s.k).view(np.int64).tolist()
                rows.append((len(x), node, seen[node]))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.binary(), pa.list_(pa.int64())], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_shingles", "digest", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, hashes array<long>")


def entries(classes: DataFrame, m: int) -> DataFrame:
    """(key, node) for each of the m * m tables."""
    first, second = F.slice("hashes", 1, m), F.slice("hashes", m + 1, m)
    keys = F.flatten(F.transform(first, lambda a, i: F.transform(second, lambda b, j: F.xxhash64(i, j, a, b))))
    return classes.select(F.explode(keys).alias("key"), "node")


def may_link(a, b, percent: int):
    """Whether sets of these sizes can reach the threshold."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(sorted_join(left), "a").join(sorted_join(right), "b")

    def run(batches):
        for big in batches:
            for batch in small_batches([big], "sa"):
                yes = []
                for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                    p, q = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                    common = len(p) + len(q) - len(np.union1d(p, q))
                    yes.append(100 * common >= percent * (len(p) + len(q) - common))
                kept = batch.filter(pa.array(yes, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(node, shingles) of wanted(doc, digest, node): of the texts with the id doc, those with this digest."""
    kind = wanted.schema["doc"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    texts = texts.join(sorted_join(wanted), F.col("doc_id").eqNullSafe(F.col("doc"))).select("text", "digest", "node")

    def run(batches):
        for batch in small_batches(batches, "text"):
            x = shingle_sets(batch.column("text"), s.words)
            blobs = [v.tobytes() for v in x]
            right = [xxhash.xxh3_128_digest(v) == d for v, d in zip(blobs, batch.column("digest").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(blobs, pa.binary())], names=["node", "shingles"]).filter(pa.array(right, pa.bool_()))

    return texts.mapInArrow(run, "node long, shingles binary")


# --- the prefix filter -----------------------------------------------------------------------------

LISTED = 64  # so many of its first shingles ride along with a row, to make a pair once and only if these can hold its overlap
SLOTS, CHUNKS = 1 << 18, 64  # a fixed-size sketch of how often shingles occur; any order is exact


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles fall in each of SLOTS slots, over all sets: one array of fixed size."""
    width = SLOTS // CHUNKS

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("shingles"):
                total += np.bincount((np.frombuffer(x.as_buffer(), "<u8") & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(CHUNKS)], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in table.column("counts"))
        return pa.table([pa.array([table.column("chunk")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])

    parts = sets.select("shingles").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()  # CHUNKS rows
    out = np.zeros(SLOTS, np.int64)
    for r in parts:
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["counts"], "<i8")
    return out


def size_class(n: int) -> int:
    """Sizes in steps of about 4 %."""
    return int(np.floor(np.log(n) / np.log(1.04) + 1e-9))


def overlap(n: int, m: int, percent: int) -> int:
    """Least intersection of sets of n and m that link."""
    return -(-percent * (n + m) // (100 + percent))


def prefixes(n: int, percent: int) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """(class, length) as the smaller set of a pair, and for each class of smaller sets as the larger one."""
    small = (size_class(n), n - overlap(n, n, percent) + 1)
    large, lo = [], -(-percent * n // 100)
    while lo <= n:
        c = size_class(lo)
        large.append((c, n - overlap(n, lo, percent) + 1))
        while lo <= n and size_class(lo) == c:
            lo += 1
    return small, large


def profiles(sets: DataFrame, percent: int) -> DataFrame:
    """For each of sets(node, shingles): node, n, usual (how often its shingles occur, on average), first (its
    shingles that come first in the order of rising frequency, at least as many as any prefix), small and large
    (the classes and prefix lengths of prefixes())."""
    order = sets.sparkSession.sparkContext.broadcast(frequencies(sets))  # SLOTS numbers
    role = pa.struct([("c", pa.int32()), ("k", pa.int32())])

    def run(batches):
        known: dict[int, tuple] = {}
        for big in batches:
            for batch in small_batches([big], "shingles", 1 << 20):
                ns, usual, first, small, large = [], [], [], [], []
                for blob in batch.column("shingles"):
                    x = np.frombuffer(blob.as_buffer(), "<u8")
                    n = len(x)
                    if n not in known:
                        one, many = prefixes(n, percent)
                        known[n] = ({"c": one[0], "k": one[1]}, [{"c": c, "k": k} for c, k in many], max(k for _, k in (one, *many)))
                    one, many, longest = known[n]
                    often = order.value[(x & np.uint64(SLOTS - 1)).astype(np.int64)]
                    ns.append(n)
                    usual.append(float(often.sum()) / n)
                    first.append(x[np.lexsort((x, often))[: max(longest, min(LISTED, 2 * longest))]].view(np.int64))
                    small.append(one)
                    large.append(many)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(ns, pa.int64()), pa.array(usual, pa.float64()), pa.array(first, pa.list_(pa.int64())), pa.array(small, role), pa.array(large, pa.list_(role))], names=["node", "n", "usual", "first", "small", "large"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, n long, usual double, first array<long>, small struct<c:int,k:int>, large array<struct<c:int,k:int>>")


def filtered_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members (profiles with a root) with different roots that share a prefix shingle.

    The rows of either side also list their first shingles. Of sets x and y with lists of i and j, the
    list that ends first in the order has all that it shares with the other set in the other's list, so
    linked sets share at least min(i - |x|, j - |y|) + overlap() of their lists; other pairs are not made.
    """

    def side(role, node: str, root: str, n: str, listed: str) -> DataFrame:
        rows = members.select("node", "root", "n", "first", role.alias("role"))
        ride = F.when(F.col("role.k") <= LISTED, F.slice("first", 1, F.least(F.lit(LISTED), F.col("role.k") * 2)))
        return rows.select(F.col("role.c").alias("c"), F.col("node").alias(node), F.col("root").alias(root), F.col("n").alias(n), ride.alias(listed), F.explode(F.slice("first", F.lit(1), F.col("role.k"))).alias("shingle"))

    x = side(F.col("small"), "x", "rx", "nx", "px")
    y = side(F.explode("large"), "y", "ry", "ny", "py")
    # of two sets of one size either may be the smaller; a pair of listed sets is made at the first shared shingle only
    order = (F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))
    both = F.array_intersect("px", "py")  # in the order of frequency
    least = F.expr(f"least(size(px) - nx, size(py) - ny) + ({percent} * (nx + ny) + {99 + percent}) div {100 + percent}")
    listed = F.col("px").isNull() | F.col("py").isNull() | (F.element_at(both, 1) == F.col("shingle")) & (F.size(both) >= least)
    found = x.join(sorted_join(y), ["c", "shingle"]).where((F.col("rx") != F.col("ry")) & order & may_link("nx", "ny", percent) & listed)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    s = settings or Settings()
    rows = materialise(signatures(docs, s), "minhash_rows")
    # a class has a short number from here on, fixed by being written
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("hashes").alias("hashes"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "minhash_classes")
    tables = entries(classes, s.m)
    shared = tables.groupBy("key").count().where("count > 1").select("key", F.col("count").alias("c"))
    # a row for each class that shares a bucket, with its shared keys (m * m at most): what is known of a class is
    # joined to it once, and the keys are spelled out again after that
    met = tables.join(sorted_join(shared), "key").groupBy("node").agg(F.sum("c").alias("score"), F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("c") > 2, F.col("key"))).alias("large"))
    met = materialise(met, "minhash_met")

    wanted = classes.join(sorted_join(met.select("node")), "node", "left_semi").select("doc", "digest", "node")
    sets = materialise(sets_of(docs, wanted, s).dropDuplicates(["node"]), "minhash_sets")
    profile = materialise(profiles(sets, s.percent), "minhash_profiles")

    # first step: each class against the class of its bucket that meets most others over all buckets
    # (the text that a group's copies were made from meets more of them than any copy does; a copy that
    # has all of its hashes meets as many, but has edits of its own, which are less usual)
    ranked = met.join(sorted_join(profile.select("node", "n", F.struct("usual", "node").alias("usual"))), "node").select("node", "n", F.struct("score", "usual").alias("rank"), "keys", "large")
    hubs = ranked.select(F.explode("keys").alias("key"), "node", "n", "rank").groupBy("key").agg(F.max(F.struct("rank", "node", "n")).alias("hub")).select("key", F.col("hub.node").alias("a"), F.col("hub.n").alias("na"))
    full = ranked.select(F.explode("keys").alias("key"), "node", "n")
    stars = full.join(sorted_join(hubs), "key").where(F.col("node") != F.col("a")).where(may_link("n", "na", s.percent)).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    stars = materialise(stars, "minhash_stars")
    links = materialise(confirm(stars, sets, s.percent), "minhash_links")
    known = components(links).withColumnRenamed("node", "_node")

    # second step: buckets in which classes other than the hub, which has met them all, are of different components
    labelled = ranked.where(F.size("large") > 0).join(sorted_join(known), F.col("node") == F.col("_node"), "left").select("node", "rank", F.coalesce("root", "node").alias("root"), "large")
    labelled = materialise(labelled, "minhash_labelled")
    spelled = labelled.select(F.explode("large").alias("key"), "node", "rank", "root")
    roots = spelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), F.max("rank").alias("rank")).groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("rank", "k")).alias("hub"))
    mixed = roots.where(F.col("roots") - F.when(F.col("hub.k") == 1, 1).otherwise(0) > 1).select("key")
    mixed = spelled.select("key", "node", "root").join(sorted_join(mixed), "key", "left_semi").select("node", "root").distinct()
    members = materialise(mixed.join(sorted_join(profile), "node"), "minhash_members")
    more = filtered_pairs(members, s.percent).join(sorted_join(stars), ["a", "b"], "left_anti")
    more = materialise(confirm(more, sets, s.percent), "minhash_more")
    if not more.isEmpty():
        known = components(links.unionByName(more)).withColumnRenamed("node", "_node")
    for done in (met, sets, profile, stars, labelled, members):
        discard(done)

    roots = classes.join(sorted_join(known), F.col("node") == F.col("_node"), "left").select("digest", "doc", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc").alias("least")).withColumnRenamed("root", "_root")
    ids = roots.join(sorted_join(least), F.col("root") == F.col("_root")).select(F.col("digest").alias("_digest"), "least")
    out = rows.select("doc_id", "n_shingles", "digest").join(sorted_join(ids), F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs, all columns, with one row of each group of near duplicates; every text without words stays."""
    kept = near_duplicates(docs, settings).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(sorted_join(kept), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])
