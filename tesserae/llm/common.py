"""Pieces that several operators of this subpackage share.

Hashed words, distributed ranks and connected components; written tables are the library's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators.graph import in_one_task, small_components, smallest_reached
from tesserae.storage import counted, discard, materialise, new_path, sorted_join

#: ASCII white space, the only separator of words in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
ARROW_BYTES = 8 << 20

__all__ = ["ARROW_BYTES", "SPACE", "buckets_for", "components", "discard", "hash_words", "materialise", "mix", "new_path", "running_total", "small_batches", "sorted_join", "split_words", "windows"]


# --- words ---------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def split_words(text: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words in the flat array of all words; null texts have none."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    # a fresh copy: after a cast, the offsets of a slice do not begin at 0, and some string kernels read them as if they did
    text = pc.fill_null(text.take(pa.array(np.arange(len(text)))).cast(pa.large_string()), "")
    if lower:
        text = pc.ascii_lower(text)
    text = pc.ascii_trim_whitespace(text)
    lists = pc.ascii_split_whitespace(text)
    flat, counts = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    empty = pc.equal(text, "").to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pc.not_equal(flat, ""))
        counts = np.where(empty, 0, counts)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), flat


def hash_words(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    if not len(flat):
        return np.empty(0, np.uint64)
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; runs that cross texts are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[j : j + n]
    return mix(h)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a column's values take about `most` bytes at a time; a longer value comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        at, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            done = at[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(at, done + most, "right")))
            yield batch.slice(start, end - start)
            start = end


# --- ranks ---------------------------------------------------------------------------------------


def buckets_for(n: int, least: int = 1) -> int:
    """The square root of n: as many buckets as rows in each, so neither side outgrows a task."""
    return max(least, math.isqrt(max(0, n)))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of a group that precede this one.

    Rows precede by bucket, then by `order`. Only sums of buckets are put in one sequence, so no
    task holds a whole group; a group's rows are dealt by (group, bucket).
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_rt_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(*[F.col(g).alias(f"_rt_g{i}") for i, g in enumerate(group)], F.col(bucket).alias("_rt_b"), "_rt_before")
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col(bucket) == F.col("_rt_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_rt_g{i}"))
    local = df.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(sums, same).withColumn(out, F.col(out) + F.col("_rt_before")).drop("_rt_b", "_rt_before", *[f"_rt_g{i}" for i in range(len(group))])


# --- connected components -------------------------------------------------------------------------


#: Links that one task joins, in arrays of some 200 MB.
LINKS_IN_ONE_TASK = 2_000_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links(a, b): root is the smallest node that it reaches.

    Few links are arrays in one task: the plans of a loop's rounds, with a dozen exchanges each, are most of
    what the driver holds. More links are joined round by round, with equal results.
    """
    links, n = counted(links.select("a", "b").where("a <> b"))
    if n <= LINKS_IN_ONE_TASK:
        return materialise(in_one_task(links.toDF("src", "dst"), small_components, "node {node}, root {node}"), "components")
    pairs = smallest_reached(links, most_rounds)
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
