"""Scalar functions: expressions to Columns, in the JVM wherever Spark has what they need.

A compiled value is a Column with its type, found by the analyzer; some functions choose by type.
Heterogeneous list literals become structs (tuples); JSON is canonical text, tagged in metadata.
"""

from __future__ import annotations

import datetime
import json
import math
import unicodedata
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.plans import ir
from tesserae.plans.ir import EngineError

NAN, INF = float("nan"), float("inf")
TIMES = (T.TimestampType, T.TimestampNTZType)  # the latter are read as UTC, or the session's zone


@dataclass
class Val:
    col: Column
    type: T.DataType
    kind: str | None = None  # json, uuid
    literal: object = None  # of a constant

    @property
    def is_text(self) -> bool:
        return isinstance(self.type, T.StringType) and self.kind is None

    @property
    def is_list(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_tuple(self) -> bool:
        return isinstance(self.type, T.StructType)

    @property
    def is_num(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_int(self) -> bool:
        return isinstance(self.type, T.IntegralType)

    @property
    def is_float(self) -> bool:
        return isinstance(self.type, (T.DoubleType, T.FloatType, T.DecimalType))

    @property
    def is_vec(self) -> bool:
        return self.is_list and isinstance(self.type.elementType, (T.FloatType, T.DoubleType))


class Compiler:
    """Compiles expressions over the columns of one DataFrame (a column for each variable)."""

    def __init__(self, df: DataFrame, constants: dict[str, ir.Expr] | None = None) -> None:
        self.df, self.constants = df, constants or {}
        self.fields = {f.name: f for f in df.schema.fields}

    def typed(self, col: Column, kind: str | None = None, literal=None) -> Val:
        f = self.df.select(col.alias("x")).schema.fields[0]
        return Val(col, f.dataType, kind or (f.metadata or {}).get("kind"), literal)

    def column(self, e: ir.Expr) -> Column:
        return self.value(e).col

    def value(self, e: ir.Expr) -> Val:
        if isinstance(e, ir.Lit):
            return literal(e.value)
        if isinstance(e, ir.Var):
            if e.name in self.fields:
                f = self.fields[e.name]
                return Val(F.col(f"`{e.name}`"), f.dataType, (f.metadata or {}).get("kind"))
            if e.name in self.constants:
                return self.value(self.constants[e.name])
            raise EngineError("eval::unbound", f"variable {e.name} is not bound")
        if isinstance(e, ir.Items):
            return make_list(self, [self.value(x) for x in e.args])
        if isinstance(e, ir.Obj):
            return call(self, "json_object", [self.value(x) for p in e.pairs for x in p])
        return call(self, e.name, [self.value(x) for x in e.args])


def literal(v) -> Val:
    if v is None:
        return Val(F.lit(None), T.NullType(), literal=None)
    if isinstance(v, bool):
        return Val(F.lit(v), T.BooleanType(), literal=v)
    if isinstance(v, int):
        return Val(F.lit(v).cast("long"), T.LongType(), literal=v)
    if isinstance(v, float):
        return Val(F.lit(v), T.DoubleType(), literal=v)
    if isinstance(v, bytes):
        return Val(F.lit(v), T.BinaryType(), literal=v)
    if isinstance(v, datetime.datetime):
        return Val(F.lit(v), T.TimestampType(), literal=v)
    return Val(F.lit(str(v)), T.StringType(), literal=str(v))


def make_list(c: Compiler, items: list[Val]) -> Val:
    if not items:
        return Val(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
    kinds = {type(i.type) for i in items if not isinstance(i.type, T.NullType)}
    if len(kinds) <= 1 or all(i.is_num for i in items) and len({i.is_int for i in items}) == 1:
        return c.typed(F.array(*[i.col for i in items]))
    return c.typed(F.struct(*[i.col.alias(f"_{n}") for n, i in enumerate(items)]))


#: Functions that take tuples as they are; for others a tuple of numbers is a list of doubles.
TUPLES = frozenset(["get", "maybe_get", "first", "last", "length", "is_list", "to_string", "json", "is_in", "list", "json_object", "validity", "to_bool", "to_int", "format_timestamp", "eq", "neq", "is_null", "coalesce", "cond", "if", "to_unity", "append_tuple"])


def untupled(c: Compiler, v: Val) -> Val:
    """A tuple of numbers as a list; other values as they are."""
    if v.is_tuple and v.type.names == [f"_{i}" for i in range(len(v.type))] and all(isinstance(f.dataType, (T.NumericType, T.NullType)) for f in v.type.fields):
        return c.typed(F.array(*[v.col.getField(n).cast("double") for n in v.type.names]))
    return v


# --- helpers -------------------------------------------------------------------------------------


def dbl(x: Val) -> Column:
    return x.col.cast("double")


def raise_if(cond: Column, message: str, value: Column) -> Column:
    return F.when(cond, F.raise_error(F.lit(message))).otherwise(value)


def elementwise(fn):
    """A function of doubles that also maps over vectors."""

    def run(c: Compiler, x: Val) -> Column:
        return F.transform(x.col, lambda e: fn(e.cast("double"))) if x.is_list else fn(dbl(x))

    return run


def logs(fn):
    return lambda x: F.when(x > 0, fn(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def arithmetic(op, name):
    def run(c: Compiler, *xs: Val) -> Column:
        out = xs[0]
        for x in xs[1:]:
            if out.is_list and x.is_list:
                col = F.zip_with(out.col, x.col, op)
            elif out.is_list:
                col = F.transform(out.col, lambda e, x=x: op(e, x.col))
            elif x.is_list:
                col = F.transform(x.col, lambda e, out=out: op(out.col, e))
            elif out.is_text or x.is_text or isinstance(out.type, T.BooleanType) or isinstance(x.type, T.BooleanType):
                raise EngineError("eval::type", f"{name} takes numbers or vectors")
            else:
                col = op(out.col, x.col)
            out = c.typed(col)
        return out.col

    return run


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def modulo(c: Compiler, a: Val, b: Val) -> Column:
    if a.is_float or b.is_float:
        return F.when(b.col == 0, F.lit(NAN)).otherwise(dbl(a) % F.when(b.col == 0, F.lit(1.0)).otherwise(dbl(b)))
    return a.col % b.col


def compare(op, name):
    def run(c: Compiler, a: Val, b: Val) -> Column:
        if isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType) or not (a.is_num and b.is_num or type(a.type) is type(b.type)):
            raise EngineError("eval::type", f"{name} compares values of one type, not {a.type.simpleString()} and {b.type.simpleString()}")
        return op(a.col, b.col)

    return run


def equal(c: Compiler, a: Val, b: Val) -> Column:
    same = a.is_num and b.is_num or type(a.type) is type(b.type) or isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType)
    return a.col.eqNullSafe(b.col) if same else F.lit(False)


def booleans(c: Compiler, name: str, xs: tuple[Val, ...], op, empty: bool) -> Column:
    out = F.lit(empty)
    for i, x in enumerate(xs):
        if not isinstance(x.type, (T.BooleanType, T.NullType)):
            raise EngineError("eval::type", f"{name} takes booleans")
        out = x.col if i == 0 else op(out, x.col)
    return out


def signum(c: Compiler, x: Val) -> Column:
    if x.is_int:
        return F.signum(x.col).cast("long")
    return F.when(F.isnan(dbl(x)), F.lit(NAN)).when((dbl(x) == 0) & (dbl(x).cast("string") == "-0.0"), F.lit(-1.0)).otherwise(F.signum(x.col))


def total_order(x: Val) -> Column:
    return F.sort_array(x.col)


def is_in(c: Compiler, x: Val, l: Val) -> Column:
    if l.is_tuple:
        return F.coalesce(*[equal(c, x, Val(l.col.getField(f.name), f.dataType)) for f in l.type.fields][:1]) if len(l.type.fields) == 1 else any_of([equal(c, x, Val(l.col.getField(f.name), f.dataType)) for f in l.type.fields])
    return F.coalesce(F.exists(l.col, lambda e: e.eqNullSafe(x.col)), F.lit(False))


def any_of(cols: list[Column]) -> Column:
    out = cols[0]
    for x in cols[1:]:
        out = out | x
    return out


def concat(c: Compiler, *xs: Val) -> Column:
    if all(x.kind == "json" for x in xs):
        return json_merge(*[x.col for x in xs])
    if not (all(x.is_text for x in xs) or all(x.is_list for x in xs)):
        raise EngineError("eval::type", "concat takes strings, lists or JSON")
    return F.concat(*[x.col for x in xs])


def length(c: Compiler, x: Val) -> Column:
    if x.is_tuple:
        return F.lit(len(x.type.fields)).cast("long")
    if x.is_list:
        return F.size(x.col).cast("long")
    return (F.octet_length(x.col) if isinstance(x.type, T.BinaryType) else F.char_length(x.col)).cast("long")


def get(c: Compiler, l: Val, n: Val, default: Val | None = None, strict: bool = True) -> Column:
    if l.is_tuple:
        if not isinstance(n.literal, int):
            raise EngineError("eval::type", "a tuple's index is a constant")
        i = n.literal if n.literal >= 0 else len(l.type.fields) + n.literal
        if 0 <= i < len(l.type.fields):
            return l.col.getField(l.type.fields[i].name)
        if default is not None or not strict:
            return default.col if default is not None else F.lit(None)
        raise EngineError("eval::bounds", f"no element {n.literal}")
    if l.kind == "json":
        path = json_path(n)
        found = F.get_json_object(l.col, path) if isinstance(path, str) else json_get(l.col, n.col.cast("string"))
        return F.coalesce(found, default.col.cast("string")) if default is not None else found
    i = F.when(n.col >= 0, n.col + 1).otherwise(n.col).cast("int")
    found = F.when(i == 0, F.lit(None)).otherwise(F.try_element_at(l.col, F.when(i == 0, F.lit(1)).otherwise(i)))
    inside = (n.col < F.size(l.col)) & (n.col >= -F.size(l.col))
    if default is not None:
        return F.when(inside, found).otherwise(default.col)
    return F.when(inside, found).otherwise(F.raise_error(F.lit("index out of bounds")) if strict else F.lit(None))


def json_path(n: Val):
    if isinstance(n.literal, str):
        return "$['" + n.literal.replace("'", "\\'") + "']"
    if isinstance(n.literal, int):
        return f"$[{n.literal}]"
    return None


def slice_list(c: Compiler, l: Val, m: Val, n: Val) -> Column:
    size = F.size(l.col)
    a, b = (F.when(x.col < 0, size + x.col).otherwise(x.col).cast("int") for x in (m, n))
    return raise_if((a < 0) | (b > size) | (a > b), "slice out of bounds", F.slice(l.col, a + 1, F.greatest(b - a, F.lit(0))))


def runs(l: Val, n: Val, step: Column, last: Column) -> Column:
    """Sublists of n elements from each start up to `last`; none if there is no start."""
    size = n.col.cast("int")
    return raise_if(n.col <= 0, "a length above zero is needed", F.when(last < 1, F.array().cast(T.ArrayType(l.type))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), step), lambda i: F.slice(l.col, i, size))))


def int_range(c: Compiler, *xs: Val) -> Column:
    start, end, step = (F.lit(0).cast("long"), xs[0].col, F.lit(1).cast("long")) if len(xs) == 1 else (xs[0].col, xs[1].col, xs[2].col if len(xs) > 2 else F.lit(1).cast("long"))
    none = F.array().cast("array<bigint>")
    last = end - F.signum(step).cast("long")
    fine = F.when(step > 0, start < end).when(step < 0, start > end).otherwise(F.lit(False))
    return F.when(step == 0, F.raise_error(F.lit("a step of zero"))).when(~fine, none).otherwise(F.sequence(F.when(fine, start).otherwise(F.lit(0).cast("long")), F.when(fine, last).otherwise(F.lit(0).cast("long")), F.when(fine, step).otherwise(F.lit(1).cast("long"))))


def folded(fn):
    def run(c: Compiler, *xs: Val) -> Column:
        out = xs[0].col
        for x in xs[1:]:
            out = fn(out, x.col)
        return F.sort_array(F.array_distinct(out))

    return run


def haversine(c: Compiler, *xs: Val) -> Column:
    a, b, p, q = (dbl(x) for x in xs)
    h = F.pow(F.sin((p - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(p) * F.pow(F.sin((q - b) / 2), F.lit(2.0))
    return F.lit(2.0) * F.asin(F.sqrt(h))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def same_size(a: Val, b: Val, value: Column) -> Column:
    return raise_if(F.size(a.col) != F.size(b.col), "vectors of different lengths", value)


def l2_dist(c: Compiler, a: Val, b: Val) -> Column:
    sq = F.zip_with(a.col, b.col, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return same_size(a, b, F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def cos_dist(c: Compiler, a: Val, b: Val) -> Column:
    return same_size(a, b, F.lit(1.0) - divide(dot(a.col, b.col), F.sqrt(dot(a.col, a.col) * dot(b.col, b.col))))


def vec(c: Compiler, x: Val, kind: Val | None = None) -> Column:
    name = (kind.literal if kind is not None else "F32").upper()
    to = "float" if name in ("F32", "FLOAT") else "double"
    if x.kind == "json":
        return F.from_json(x.col, f"array<{to}>")
    if x.is_text:
        return vec_base64(x.col, F.lit(to)).cast(f"array<{to}>")
    return x.col.cast(f"array<{to}>")


def to_bool(c: Compiler, x: Val) -> Column:
    if isinstance(x.type, T.NullType):
        return F.lit(False)
    if isinstance(x.type, T.BooleanType):
        yes = x.col
    elif x.is_num:
        yes = x.col != 0
    elif x.is_list:
        yes = F.size(x.col) > 0
    elif x.kind == "uuid":
        yes = x.col != "00000000-0000-0000-0000-000000000000"
    elif x.kind == "json":
        yes = ~x.col.isin("null", "false", "0", "0.0", '""', "[]", "{}")
    elif x.is_tuple and "is_assert" in x.type.names:
        yes = x.col.getField("is_assert")
    elif isinstance(x.type, T.BinaryType):
        yes = F.octet_length(x.col) > 0
    else:
        yes = x.col != ""
    return F.coalesce(yes, F.lit(False))


def to_int(c: Compiler, x: Val) -> Column:
    if x.is_tuple and "ts" in x.type.names:
        return x.col.getField("ts")
    if isinstance(x.type, TIMES):
        return F.unix_micros(x.col.cast("timestamp"))
    return F.coalesce(x.col.cast("long"), F.lit(0).cast("long"))


SPECIAL = {"PI": math.pi, "E": math.e, "NAN": NAN, "INF": INF, "NEG_INF": -INF}


def to_float(c: Compiler, x: Val) -> Column:
    if isinstance(x.type, TIMES):
        return F.unix_micros(x.col.cast("timestamp")) / F.lit(1e6)
    if not isinstance(x.type, T.StringType):
        return F.coalesce(dbl(x), F.lit(0.0))
    out = F.when(x.col.isNull(), F.lit(0.0))
    for name, value in SPECIAL.items():
        out = out.when(x.col == name, F.lit(value))
    return out.otherwise(F.when(x.col.isin(*SPECIAL), F.lit("0")).otherwise(x.col).cast("double"))


def to_text(c: Compiler, x: Val) -> Column:
    if isinstance(x.type, T.StringType):
        return F.coalesce(x.col, F.lit("null"))
    if isinstance(x.type, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(as_json(x), F.lit("null"))
    return F.coalesce(x.col.cast("string"), F.lit("null"))


def as_json(x: Val) -> Column:
    if x.kind == "json":
        return x.col
    if x.is_tuple:
        if x.type.names == [f"_{i}" for i in range(len(x.type))]:
            parts = [as_json(Val(x.col.getField(f.name), f.dataType)) for f in x.type.fields]
            return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
        return F.to_json(x.col)
    if x.is_list:
        return F.to_json(x.col, {"ignoreNullFields": "false"})
    if isinstance(x.type, T.NullType):
        return F.lit("null")
    if isinstance(x.type, T.StringType):
        return F.coalesce(quote_json(x.col), F.lit("null"))
    if isinstance(x.type, T.BinaryType):
        return quote_json(F.base64(x.col))
    return F.coalesce(F.to_json(x.col.cast("variant")) if not isinstance(x.type, TIMES) else quote_json(x.col.cast("string")), F.lit("null"))


def quote_json(s: Column) -> Column:
    return F.to_json(s.cast("variant"))


def json_object(c: Compiler, *xs: Val) -> Column:
    if len(xs) % 2:
        raise EngineError("eval::arity", "json_object takes pairs")
    pairs = list(zip(xs[::2], xs[1::2], strict=True))
    if all(isinstance(k.literal, str) for k, _ in pairs):
        pairs.sort(key=lambda p: p[0].literal)
    parts = [F.concat(quote_json(k.col.cast("string")), F.lit(":"), as_json(v)) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_to_scalar(c: Compiler, x: Val) -> Column:
    """JSON scalars as text: static types leave no other way to unwrap a value of any type."""
    return F.get_json_object(F.concat(F.lit('{"x":'), x.col, F.lit("}")), "$.x")


def regex_replace_first(s: Column, pattern: Column, rep: Column) -> Column:
    at = F.regexp_instr(s, pattern)
    hit = F.regexp_substr(s, pattern)
    head = F.substring(s, F.lit(1), at - 1)
    tail = F.substring(s, at + F.char_length(hit), F.char_length(s))
    return F.when(at > 0, F.concat(head, F.regexp_replace(hit, pattern, rep), tail)).otherwise(s)


def java_replacement(x: Val) -> Column:
    """${name} and $1 groups as Java writes them; a backslash is itself."""
    return F.replace(x.col, F.lit("\\"), F.lit("\\\\"))


def trim(pattern: str):
    return lambda c, x: F.regexp_replace(x.col, pattern, "")


def format_timestamp(c: Compiler, x: Val, zone: Val | None = None) -> Column:
    micros = F.unix_micros(x.col.cast("timestamp")) if isinstance(x.type, TIMES) else x.col.getField("ts") if x.is_tuple else (dbl(x) * 1e6).cast("long")
    return timestamp_text(micros, zone.col if zone is not None else F.lit("UTC"))


def parse_timestamp(c: Compiler, x: Val) -> Column:
    return F.unix_micros(F.to_timestamp(x.col)) / F.lit(1e6)


def chars(c: Compiler, x: Val) -> Column:
    return F.when(x.col == "", F.array().cast("array<string>")).otherwise(F.split(x.col, ""))


def slice_string(c: Compiler, s: Val, m: Val, n: Val) -> Column:
    return raise_if((m.col < 0) | (n.col < m.col), "slice out of bounds", F.substring(s.col, (m.col + 1).cast("int"), (n.col - m.col).cast("int")))


def is_finite(c: Compiler, x: Val) -> Column:
    if not x.is_num:
        return F.lit(False)
    return F.lit(True) if x.is_int else ~F.isnan(dbl(x)) & (F.abs(dbl(x)) != F.lit(INF))


def static(test):
    """A type predicate: decided by the column's type, but null is of no type."""
    return lambda c, x: x.col.isNotNull() & F.lit(bool(test(x)))


def cond(c: Compiler, *xs: Val) -> Column:
    pairs, default = list(zip(xs[::2], xs[1::2], strict=False)), xs[-1].col if len(xs) % 2 else F.lit(None)
    out = None
    for test, value in pairs:
        out = F.when(test.col, value.col) if out is None else out.when(test.col, value.col)
    return out.otherwise(default) if out is not None else default


# --- what Spark has no function for: Arrow-batched Python --------------------------------------------


def vectorised(kind):
    """A function of single values, applied to Arrow batches; null in, null out."""

    def wrap(f):
        def over(*columns):
            import pandas as pd

            return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

        over.__name__ = f.__name__
        over.__annotations__ = {}
        return F.pandas_udf(over, kind, F.PandasUDFType.SCALAR)

    return wrap


def lazily(kind):
    """Make the UDF when it is first called: it needs a session."""

    def wrap(f):
        made = []

        def call(*args):
            if not made:
                made.append(vectorised(kind)(f))
            return made[0](*args)

        return call

    return wrap


def bytes_op(f):
    def run(a, b):
        if len(a) != len(b):
            raise ValueError("bytes of different lengths")
        return bytes(f(x, y) for x, y in zip(a, b, strict=True))

    return lazily("binary")(run)


BIT_AND, BIT_OR, BIT_XOR = bytes_op(lambda x, y: x & y), bytes_op(lambda x, y: x | y), bytes_op(lambda x, y: x ^ y)
BIT_NOT = lazily("binary")(lambda b: bytes(255 - x for x in b))
UNPACK = lazily("array<boolean>")(lambda b: [bool(x >> i & 1) for x in b for i in range(7, -1, -1)])
PACK = lazily("binary")(lambda bits: bytes(sum(bool(x) << (7 - j) for j, x in enumerate(list(bits)[i : i + 8])) for i in range(0, len(bits), 8)))
NORMALIZE = lazily("string")(lambda s, form: unicodedata.normalize(form.upper(), s))


@lazily("array<double>")
def vec_base64(s, kind):
    import base64

    import numpy as np

    return np.frombuffer(base64.b64decode(s), np.float32 if kind == "float" else np.float64).astype(float).tolist()


def timestamp_text(micros: Column, zone: Column) -> Column:
    """ISO text of microseconds since 1970 in a zone, without regard to the session's; milliseconds where there are any."""
    seconds = (micros.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    local = F.convert_timezone(F.lit("UTC"), zone, utc)
    text, ms = local.cast("string"), F.floor(F.pmod(micros, F.lit(1000000)) / 1000).cast("int")
    offset = F.timestamp_diff("MINUTE", utc, local)
    hours = F.lpad((F.abs(offset) / 60).cast("int").cast("string"), 2, "0")
    return F.concat(F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T")), F.when(ms > 0, F.concat(F.lit("."), F.lpad(ms.cast("string"), 3, "0"))).otherwise(F.lit("")), F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")), hours, F.lit(":"), F.lpad((F.abs(offset) % 60).cast("string"), 2, "0"))


def dumps(x) -> str:
    return json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


@lazily("string")
def canonical(text):
    return dumps(json.loads(text))


def merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: merged(a[k], v) if k in a else v for k, v in b.items()}
    return a + b if isinstance(a, list) and isinstance(b, list) else b


def json_merge(first: Column, *rest: Column) -> Column:
    two = lazily("string")(lambda a, b: dumps(merged(json.loads(a), json.loads(b))))
    for x in rest:
        first = two(first, x)
    return first


def steps(path: str) -> list:
    p = json.loads(path)
    return p if isinstance(p, list) else [p]


@lazily("string")
def json_get(doc, path):
    x = json.loads(doc)
    try:
        for p in steps(path if path.startswith("[") else dumps(path)):
            x = x[int(p) if isinstance(x, list) else p]
    except (KeyError, IndexError, TypeError, ValueError):
        return None
    return dumps(x)


@lazily("string")
def json_set(doc, path, value):
    top = {"": json.loads(doc)}
    at, key = top, ""
    for p in steps(path):
        inner = at[key]
        if isinstance(p, int):
            inner = inner if isinstance(inner, list) else []
            inner += [None] * (p + 1 - len(inner))
        elif not isinstance(inner, dict):
            inner = {}
        if isinstance(p, str):
            inner.setdefault(p, None)
        at[key] = inner
        at, key = inner, p
    at[key] = json.loads(value)
    return dumps(top[""])


@lazily("string")
def json_remove(doc, path):
    x = json.loads(doc)
    at, keys = x, steps(path)
    if not keys:
        raise ValueError("an empty path")
    try:
        for p in keys[:-1]:
            at = at[p]
        del at[keys[-1]]
    except (KeyError, IndexError, TypeError):
        pass
    return dumps(x)


UUID1 = lazily("string")(lambda _: str(uuid.uuid1()))
UUID_TIME = lazily("double")(lambda u: (uuid.UUID(u).time - 0x01B21DD213814000) / 1e7 if uuid.UUID(u).version == 1 else None)

#: Traditional and simplified forms of frequent characters (fixed values).
TRADITIONAL = "國學會來時個們說這對為過東車門問見長馬魚鳥語書電話點開關飛風龍應廣從傳愛歡樂體臺灣聽讀寫買賣貴錢銀鐵頭黃萬與兩區醫張陳劉楊趙"
SIMPLIFIED = "国学会来时个们说这对为过东车门问见长马鱼鸟语书电话点开关飞风龙应广从传爱欢乐体台湾听读写买卖贵钱银铁头黄万与两区医张陈刘杨赵"


def json_kind(fn):
    return ("json", fn)


def uuid_kind(fn):
    return ("uuid", fn)


UUID_RE = "(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"

#: name -> (least arguments, most or None, function(compiler, *values) -> Column)
FUNCTIONS: dict[str, tuple] = {
    "add": (1, None, arithmetic(lambda a, b: a + b, "add")),
    "sub": (2, 2, arithmetic(lambda a, b: a - b, "sub")),
    "mul": (1, None, arithmetic(lambda a, b: a * b, "mul")),
    "div": (2, 2, arithmetic(divide, "div")),
    "mod": (2, 2, modulo),
    "pow": (2, 2, lambda c, a, b: F.transform(a.col, lambda e: F.pow(e.cast("double"), dbl(b))) if a.is_list else F.pow(dbl(a), dbl(b))),
    "minus": (1, 1, lambda c, x: F.transform(x.col, lambda e: -e) if x.is_list else -x.col),
    "abs": (1, 1, lambda c, x: F.transform(x.col, F.abs) if x.is_list else F.abs(x.col)),
    "signum": (1, 1, signum),
    "max": (1, None, lambda c, *xs: F.greatest(*[x.col for x in xs]) if len(xs) > 1 else xs[0].col),
    "min": (1, None, lambda c, *xs: F.least(*[x.col for x in xs]) if len(xs) > 1 else xs[0].col),
    "eq": (2, 2, equal),
    "neq": (2, 2, lambda c, a, b: ~equal(c, a, b)),
    "gt": (2, 2, compare(lambda a, b: a > b, ">")),
    "ge": (2, 2, compare(lambda a, b: a >= b, ">=")),
    "lt": (2, 2, compare(lambda a, b: a < b, "<")),
    "le": (2, 2, compare(lambda a, b: a <= b, "<=")),
    "and": (0, None, lambda c, *xs: booleans(c, "and", xs, lambda a, b: a & b, True)),
    "or": (0, None, lambda c, *xs: booleans(c, "or", xs, lambda a, b: a | b, False)),
    "negate": (1, 1, lambda c, x: ~booleans(c, "negate", (x,), None, True)),
    "is_in": (2, 2, is_in),
    "coalesce": (0, None, lambda c, *xs: F.coalesce(*[x.col for x in xs]) if xs else F.lit(None)),
    "assert": (1, None, lambda c, x, *m: F.when(x.col, F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("assertion failed"), *[v.col.cast("string") for v in m])))),
    "floor": (1, 1, lambda c, x: x.col if x.is_int else F.floor(x.col).cast("double")),
    "ceil": (1, 1, lambda c, x: x.col if x.is_int else F.ceil(x.col).cast("double")),
    "round": (1, 1, lambda c, x: x.col if x.is_int else F.round(dbl(x), 0)),
    "exp": (1, 1, elementwise(F.exp)),
    "exp2": (1, 1, elementwise(lambda x: F.pow(F.lit(2.0), x))),
    "ln": (1, 1, elementwise(logs(F.ln))),
    "log2": (1, 1, elementwise(logs(F.log2))),
    "log10": (1, 1, elementwise(logs(F.log10))),
    "sqrt": (1, 1, elementwise(F.sqrt)),
    **{n: (1, 1, elementwise(getattr(F, n))) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")},
    "atan2": (2, 2, lambda c, y, x: F.atan2(dbl(y), dbl(x))),
    "deg_to_rad": (1, 1, lambda c, x: F.radians(dbl(x))),
    "rad_to_deg": (1, 1, lambda c, x: F.degrees(dbl(x))),
    "haversine": (4, 4, haversine),
    "haversine_deg_input": (4, 4, lambda c, *xs: haversine(c, *[Val(F.radians(dbl(x)), T.DoubleType()) for x in xs])),
    "bit_and": (2, 2, lambda c, a, b: BIT_AND(a.col, b.col)),
    "bit_or": (2, 2, lambda c, a, b: BIT_OR(a.col, b.col)),
    "bit_xor": (2, 2, lambda c, a, b: BIT_XOR(a.col, b.col)),
    "bit_not": (1, 1, lambda c, a: BIT_NOT(a.col)),
    "unpack_bits": (1, 1, lambda c, a: UNPACK(a.col)),
    "pack_bits": (1, 1, lambda c, a: PACK(a.col)),
    "encode_base64": (1, 1, lambda c, x: F.base64(x.col)),
    "decode_base64": (1, 1, lambda c, x: F.to_binary(x.col, F.lit("base64"))),
    "concat": (1, None, concat),
    "str_includes": (2, 2, lambda c, a, b: a.col.contains(b.col)),
    "lowercase": (1, 1, lambda c, x: F.lower(x.col)),
    "uppercase": (1, 1, lambda c, x: F.upper(x.col)),
    "trim": (1, 1, trim(r"(?U)^\s+|\s+$")),
    "trim_start": (1, 1, trim(r"(?U)^\s+")),
    "trim_end": (1, 1, trim(r"(?U)\s+$")),
    "starts_with": (2, 2, lambda c, a, b: a.col.startswith(b.col)),
    "ends_with": (2, 2, lambda c, a, b: a.col.endswith(b.col)),
    "regex_matches": (2, 2, lambda c, s, p: F.regexp_like(s.col, p.col)),
    "regex_replace": (3, 3, lambda c, s, p, r: regex_replace_first(s.col, p.col, java_replacement(r))),
    "regex_replace_all": (3, 3, lambda c, s, p, r: F.regexp_replace(s.col, p.col, java_replacement(r))),
    "regex_extract": (2, 2, lambda c, s, p: F.regexp_extract_all(s.col, p.col, F.lit(0))),
    "regex_extract_first": (2, 2, lambda c, s, p: F.regexp_substr(s.col, p.col)),
    "t2s": (1, 1, lambda c, x: F.translate(x.col, TRADITIONAL, SIMPLIFIED) if x.is_text else x.col),
    "length": (1, 1, length),
    "unicode_normalize": (2, 2, lambda c, s, f: NORMALIZE(s.col, f.col)),
    "chars": (1, 1, chars),
    "slice_string": (3, 3, slice_string),
    "from_substrings": (1, 1, lambda c, l: F.array_join(l.col, "")),
    "is_null": (1, 1, lambda c, x: x.col.isNull()),
    "is_int": (1, 1, static(lambda x: x.is_int)),
    "is_float": (1, 1, static(lambda x: x.is_float)),
    "is_num": (1, 1, static(lambda x: x.is_num)),
    "is_finite": (1, 1, is_finite),
    "is_infinite": (1, 1, lambda c, x: F.abs(dbl(x)) == F.lit(INF) if x.is_float else F.lit(False)),
    "is_nan": (1, 1, lambda c, x: F.isnan(dbl(x)) if x.is_float else F.lit(False)),
    "is_string": (1, 1, static(lambda x: x.is_text)),
    "is_list": (1, 1, static(lambda x: x.is_list or x.is_tuple)),
    "is_vec": (1, 1, static(lambda x: x.is_vec)),
    "is_bytes": (1, 1, static(lambda x: isinstance(x.type, T.BinaryType))),
    "is_uuid": (1, 1, static(lambda x: x.kind == "uuid")),
    "is_json": (1, 1, static(lambda x: x.kind == "json")),
    "to_bool": (1, 1, to_bool),
    "to_unity": (1, 1, lambda c, x: F.when(to_bool(c, x), F.lit(1)).otherwise(F.lit(0)).cast("long")),
    "to_int": (1, 1, to_int),
    "to_float": (1, 1, to_float),
    "to_string": (1, 1, to_text),
    "to_uuid": (1, 1, uuid_kind(lambda c, x: F.when(x.col.rlike(UUID_RE), F.lower(x.col)).otherwise(F.raise_error(F.lit("not a UUID"))))),
    "append": (2, 2, lambda c, l, x: F.array_append(l.col, x.col)),
    "prepend": (2, 2, lambda c, l, x: F.array_prepend(l.col, x.col)),
    "sorted": (1, 1, lambda c, l: total_order(l)),
    "reverse": (1, 1, lambda c, l: F.reverse(l.col)),
    "first": (1, 1, lambda c, l: l.col.getField("_0") if l.is_tuple else F.get(l.col, F.lit(0))),
    "last": (1, 1, lambda c, l: l.col.getField(l.type.names[-1]) if l.is_tuple else F.try_element_at(l.col, F.lit(-1))),
    "chunks": (2, 2, lambda c, l, n: runs(l, n, n.col.cast("int"), F.size(l.col))),
    "chunks_exact": (2, 2, lambda c, l, n: F.filter(runs(l, n, n.col.cast("int"), F.size(l.col)), lambda x: F.size(x) == n.col)),
    "windows": (2, 2, lambda c, l, n: runs(l, n, F.lit(1), F.size(l.col) - n.col.cast("int") + 1)),
    "get": (2, 3, get),
    "maybe_get": (2, 2, lambda c, l, n: get(c, l, n, strict=False)),
    "slice": (3, 3, slice_list),
    "int_range": (1, 3, int_range),
    "union": (1, None, folded(F.array_union)),
    "difference": (2, None, folded(F.array_except)),
    "intersection": (1, None, folded(F.array_intersect)),
    "json": (1, 1, json_kind(lambda c, x: as_json(x))),
    "json_object": (0, None, json_kind(json_object)),
    "parse_json": (1, 1, json_kind(lambda c, x: canonical(x.col))),
    "dump_json": (1, 1, lambda c, x: F.concat(x.col, F.lit(""))),
    "json_to_scalar": (1, 1, json_to_scalar),
    "set_json_path": (3, 3, json_kind(lambda c, j, p, v: json_set(j.col, as_json(p), as_json(v)))),
    "remove_json_path": (2, 2, json_kind(lambda c, j, p: json_remove(j.col, as_json(p)))),
    "vec": (1, 2, vec),
    "rand_vec": (1, 2, lambda c, n, k=None: F.transform(F.sequence(F.lit(1), n.col.cast("int")), lambda i: (F.rand() + i * 0.0)).cast("array<float>" if k is None or k.literal == "F32" else "array<double>")),
    "l2_normalize": (1, 1, lambda c, v: F.transform(v.col, lambda e: divide(e, F.sqrt(dot(v.col, v.col))))),
    "l2_dist": (2, 2, l2_dist),
    "ip_dist": (2, 2, lambda c, a, b: same_size(a, b, F.lit(1.0) - dot(a.col, b.col))),
    "cos_dist": (2, 2, cos_dist),
    "rand_float": (0, 0, lambda c: F.rand()),
    "rand_bernoulli": (1, 1, lambda c, p: raise_if((p.col < 0) | (p.col > 1), "a probability is from 0 to 1", F.rand() < p.col)),
    "rand_int": (2, 2, lambda c, a, b: F.floor(F.rand() * (b.col - a.col + 1) + a.col).cast("long")),
    "rand_choose": (1, 1, lambda c, l: F.get(l.col, F.floor(F.rand() * F.size(l.col)).cast("int"))),
    "rand_uuid_v1": (0, 0, uuid_kind(lambda c: UUID1(F.rand()))),
    "rand_uuid_v4": (0, 0, uuid_kind(lambda c: F.uuid())),
    "uuid_timestamp": (1, 1, lambda c, u: UUID_TIME(u.col)),
    "now": (0, 0, lambda c: F.unix_micros(F.current_timestamp()) / F.lit(1e6)),
    "format_timestamp": (1, 2, format_timestamp),
    "parse_timestamp": (1, 1, parse_timestamp),
    "validity": (1, 2, lambda c, ts, a=None: F.struct(ts.col.cast("long").alias("ts"), (a.col if a is not None else F.lit(True)).alias("is_assert"))),
    "list": (0, None, lambda c, *xs: make_list(c, list(xs)).col),
    "cond": (0, None, cond),
    "if": (2, 3, lambda c, t, a, b=None: F.when(t.col, a.col).otherwise(b.col if b is not None else F.lit(None))),
}


def call(c: Compiler, name: str, args: list[Val]) -> Val:
    if name not in FUNCTIONS:
        raise EngineError("eval::no_function", f"no function {name}")
    least, most, fn = FUNCTIONS[name]
    if len(args) < least or most is not None and len(args) > most:
        raise EngineError("eval::arity", f"{name} takes {least} to {most} arguments, not {len(args)}")
    if name not in TUPLES:
        args = [untupled(c, a) for a in args]
    kind = None
    if isinstance(fn, tuple):
        kind, fn = fn
    out = c.typed(fn(c, *args), kind)
    if name in ("get", "maybe_get") and args[0].kind == "json":
        out.kind = "json"
    if name in ("coalesce", "if", "cond") and args and all(a.kind == args[-1].kind for a in args[-1:]):
        out.kind = args[-1].kind
    return out
