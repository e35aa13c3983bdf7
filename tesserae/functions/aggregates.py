"""Aggregates of rule heads: 25 by name, those that are lattice merges marked as meets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.plans.ir import EngineError


@dataclass(frozen=True)
class Aggregate:
    make: Callable  # (column, type, extra arguments) -> Column
    meet: bool = False
    merge: str | None = None  # the aggregate that merges partial results; itself if None


def pair(x: Column, t: T.DataType) -> tuple[Column, Column]:
    """(value, cost) of a two-element list or tuple."""
    if isinstance(t, T.StructType) and len(t.fields) == 2:
        return x.getField(t.names[0]), x.getField(t.names[1])
    if isinstance(t, T.ArrayType):
        return F.get(x, F.lit(0)), F.get(x, F.lit(1))
    raise EngineError("eval::type", "this aggregate takes [value, cost]")


def rebuilt(v: Column, c: Column, t: T.DataType) -> Column:
    return F.struct(v.alias(t.names[0]), c.alias(t.names[1])) if isinstance(t, T.StructType) else F.array(v, c)


def min_cost(x, t, *_):
    v, c = pair(x, t)
    best = F.min(F.when(c.isNotNull(), F.struct(c.alias("c"), v.alias("v"))))
    return rebuilt(best.getField("v"), best.getField("c"), t)


def unique(x, t, *_):
    return F.transform(F.sort_array(F.collect_set(F.struct(x.alias("x")))), lambda e: e.getField("x"))


def collect(x, t, limit=None):
    """Lists are sorted: the order in which rows arrive is not one to rely on."""
    out = F.transform(F.sort_array(F.collect_list(F.struct(x.alias("x")))), lambda e: e.getField("x"))
    return out if limit is None else F.slice(out, 1, int(limit))


def group_counts(df: DataFrame, keys: list[Column], x: Column, out: str) -> DataFrame:
    """Sorted [value, count] lists by two grouped aggregates, so that lists hold distinct values only."""
    names = [f"_k{i}" for i in range(len(keys))]
    counts = df.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)], x.alias("_0")).agg(F.count(F.lit(1)).alias("_1"))
    return counts.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_0", "_1"))).alias(out))


def shortest(x, t, *_):
    return F.min(F.when(x.isNotNull(), F.struct(F.size(x).alias("n"), x.alias("x")))).getField("x")


def variance(fn):
    return lambda x, t, *_: F.when(F.count(F.lit(1)) > 1, fn(x)).otherwise(F.lit(float("nan")))


def intersect(x, t, *_):
    every = F.collect_list(x)
    return F.sort_array(F.aggregate(F.slice(every, 2, 1 << 30), F.array_distinct(F.get(every, F.lit(0))), lambda a, b: F.array_intersect(a, b)))


BITS = {"bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor}
WORD = 7  # bytes that a long holds without its sign


def bits(name: str, x: Column, longest: int) -> Column:
    """Bytes as longs, each with the built-in aggregate, and bytes again; all values have one length."""
    n = F.max(F.octet_length(x))
    same = F.when(F.min(F.octet_length(x)) != n, F.raise_error(F.lit("bytes of different lengths")).cast("int")).otherwise(n)
    parts = []
    for at in range(0, longest, WORD):
        word = BITS[name](F.conv(F.hex(F.substring(x, at + 1, WORD)), 16, 10).cast("long"))
        parts.append(F.lpad(F.hex(word), F.greatest(F.lit(0), F.least(F.lit(WORD), same - at)) * 2, F.lit("0")))
    return F.unhex(F.concat(*parts)) if parts else F.max(x)


AGGREGATES: dict[str, Aggregate] = {
    "and": Aggregate(lambda x, t, *_: F.coalesce(F.bool_and(x), F.lit(True)), True),
    "or": Aggregate(lambda x, t, *_: F.coalesce(F.bool_or(x), F.lit(False)), True),
    "unique": Aggregate(unique),
    "group_count": Aggregate(None),  # see group_counts
    "count_unique": Aggregate(lambda x, t, *_: F.count_distinct(F.struct(x.alias("x")))),
    "union": Aggregate(lambda x, t, *_: F.sort_array(F.array_distinct(F.flatten(F.collect_set(x)))), True),
    "intersection": Aggregate(intersect, True),
    "collect": Aggregate(collect),
    "choice_rand": Aggregate(lambda x, t, *_: F.max_by(x, F.col("__rand"))),
    "count": Aggregate(lambda x, t, *_: F.count(F.lit(1))),
    "variance": Aggregate(variance(F.var_samp)),
    "std_dev": Aggregate(variance(F.stddev_samp)),
    "mean": Aggregate(lambda x, t, *_: F.coalesce(F.avg(x), F.lit(float("nan")))),
    "sum": Aggregate(lambda x, t, *_: F.coalesce(F.sum(x.cast("double")), F.lit(0.0))),
    "product": Aggregate(lambda x, t, *_: F.coalesce(F.product(x.cast("double")), F.lit(1.0))),
    "min": Aggregate(lambda x, t, *_: F.min(x), True),
    "max": Aggregate(lambda x, t, *_: F.max(x), True),
    "latest_by": Aggregate(lambda x, t, *_: F.max(F.when(pair(x, t)[1].isNotNull(), F.struct(pair(x, t)[1].alias("c"), pair(x, t)[0].alias("v")))).getField("v")),
    "smallest_by": Aggregate(lambda x, t, *_: F.min(F.when(pair(x, t)[1].isNotNull(), F.struct(pair(x, t)[1].alias("c"), pair(x, t)[0].alias("v")))).getField("v")),
    "min_cost": Aggregate(min_cost, True),
    "shortest": Aggregate(shortest, True),
    "choice": Aggregate(lambda x, t, *_: F.min(x), True),  # any would do; the least is repeatable
    "bit_and": Aggregate(None, True),  # see bits
    "bit_or": Aggregate(None, True),  # see bits
    "bit_xor": Aggregate(None),  # see bits
}

NUMERIC = frozenset(["min", "max", "sum", "product", "mean", "variance", "std_dev"])


def is_meet(head: tuple) -> bool:
    """Whether a head's aggregates may stand in recursion: all are meets, and they come last."""
    flags = [h.aggr is not None for h in head]
    return any(flags) and flags == sorted(flags) and all(AGGREGATES[h.aggr].meet for h in head if h.aggr)


def aggregated(df: DataFrame, head: tuple, inputs: list[str], constants) -> DataFrame:
    """Group df by the plain head columns; inputs[i] is the column of head argument i, outputs are 0, 1, ..."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if any(h.aggr == "choice_rand" for h in head):
        df = df.withColumn("__rand", F.rand())
    of_bytes = [i for i, h in enumerate(head) if h.aggr in BITS]
    longest = df.agg(*[F.max(F.octet_length(F.col(f"`{inputs[i]}`"))) for i in of_bytes]).first() if of_bytes else ()
    keys = [F.col(f"`{inputs[i]}`").alias(str(i)) for i, h in enumerate(head) if not h.aggr]
    made = []
    for i, h in enumerate(head):
        if not h.aggr or h.aggr == "group_count":
            continue
        if h.aggr not in AGGREGATES:
            raise EngineError("parser::no_aggr", f"no aggregate {h.aggr}")
        t = types[inputs[i]]
        if h.aggr in NUMERIC and not isinstance(t, (T.NumericType, T.NullType)) and not (h.aggr in ("min", "max") and isinstance(t, T.TimestampType)):
            raise EngineError("eval::type", f"{h.aggr} takes numbers")
        if i in of_bytes:
            made.append(bits(h.aggr, F.col(f"`{inputs[i]}`"), longest[of_bytes.index(i)] or 0).alias(str(i)))
            continue
        made.append(AGGREGATES[h.aggr].make(F.col(f"`{inputs[i]}`"), t, *[constants(a) for a in h.args]).alias(str(i)))
    if keys and made:
        out = df.groupBy(*keys).agg(*made)
    elif made:
        out = df.agg(*made)
    else:
        out = None
    plain = [F.col(f"`{inputs[i]}`") for i, h in enumerate(head) if not h.aggr]
    names = [str(i) for i, h in enumerate(head) if not h.aggr]
    for i, h in enumerate(head):
        if h.aggr != "group_count":
            continue
        counts = group_counts(df, plain, F.col(f"`{inputs[i]}`"), str(i))
        if out is None:
            out = counts.withColumnsRenamed({f"_k{j}": n for j, n in enumerate(names)})
            continue
        same = F.lit(True)
        for j, n in enumerate(names):
            same = same & F.col(f"`{n}`").eqNullSafe(F.col(f"_k{j}"))
        out = out.join(counts, same).drop(*[f"_k{j}" for j in range(len(names))])
    return out.select(*[f"`{i}`" for i in range(len(head))])
