"""Stored relations: declared columns, immutable versions as Parquet, mutations as DataFrame plans."""

from __future__ import annotations

import datetime
import json
import re
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalar import TIMES, Compiler, Val, as_json, canonical
from tesserae.plans import ir
from tesserae.plans.compiler import col, minus
from tesserae.plans.ir import EngineError
from tesserae.storage import shared_dir

LEVELS = ("hidden", "read_only", "protected", "normal")
VALIDITY = T.StructType([T.StructField("ts", T.LongType()), T.StructField("is_assert", T.BooleanType())])
FOREVER = (1 << 63) - 2


def split_type(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "[(<"
        depth -= c in "])>"
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]] if text else []


def spark_type(text: str) -> tuple[T.DataType | None, str | None]:
    """(type, kind) of a declared type; no type for Any: what comes is taken."""
    t = text.rstrip("?")
    plain = {"Bool": T.BooleanType(), "Int": T.LongType(), "Float": T.DoubleType(), "String": T.StringType(), "Bytes": T.BinaryType(), "Validity": VALIDITY}
    if t in plain:
        return plain[t], None
    if t in ("Uuid", "Json"):
        return T.StringType(), t.lower()
    if t.startswith("["):
        inner = spark_type(t[1:-1].split(";")[0])[0] or T.StringType()
        return T.ArrayType(inner), None
    if t.startswith("("):
        return T.StructType([T.StructField(f"_{i}", spark_type(x)[0] or T.StringType()) for i, x in enumerate(split_type(t[1:-1]))]), None
    if t.startswith("<"):
        return T.ArrayType(T.FloatType() if t[1:-1].split(";")[0] in ("F32", "Float") else T.DoubleType()), None
    return None, None


def length_of(text: str) -> int | None:
    m = re.fullmatch(r"[\[<].*;(\d+)[\]>]\??", text)
    return int(m.group(1)) if m else None


def validity(v: Val, now: int) -> Column:
    """A Validity from "ASSERT", "RETRACT", a time's text (~ before it: a retraction), [ts, bool] or the struct itself."""
    if v.is_tuple:
        a, b = v.type.names
        return F.struct(v.col.getField(a).cast("long").alias("ts"), v.col.getField(b).cast("boolean").alias("is_assert"))
    if v.is_list:
        at, yes = F.get(v.col, F.lit(0)), F.get(v.col, F.lit(1))
        return F.struct(at.cast("long").alias("ts"), yes.cast("boolean").alias("is_assert"))
    if isinstance(v.type, TIMES):
        return F.struct(F.unix_micros(v.col.cast("timestamp")).alias("ts"), F.lit(True).alias("is_assert"))
    if v.is_int:
        return F.struct(v.col.cast("long").alias("ts"), F.lit(True).alias("is_assert"))
    plain = F.regexp_replace(v.col, "^~", "")
    words = v.col.isin("ASSERT", "RETRACT")
    ts = F.when(words, F.lit(now)).otherwise(F.unix_micros(F.to_timestamp(F.when(words, F.lit("1970-01-01T00:00:00Z")).otherwise(plain))))
    return F.struct(ts.cast("long").alias("ts"), (~v.col.startswith("~") & (v.col != "RETRACT")).alias("is_assert"))


def coerced(c: Compiler, v: Val, declared: str, name: str, now: int) -> Column:
    """The value as the declared type takes it; a null where none may be fails the job."""
    t, kind = spark_type(declared)
    if t is None:
        out = v.col if not isinstance(v.type, T.NullType) else v.col.cast("string")
    elif t == VALIDITY:
        out = validity(v, now)
    elif kind == "json":
        out = canonical(v.col) if v.kind == "json" else as_json(v)
    elif isinstance(t, T.BinaryType) and isinstance(v.type, T.StringType):
        out = F.to_binary(v.col, F.lit("base64"))
    elif isinstance(v.type, T.NullType) or type(v.type) is type(t):
        out = v.col.cast(t)
    elif isinstance(t, T.LongType) and v.is_num:
        out = F.when((v.col.cast("double") % 1 != 0), F.raise_error(F.lit(f"{name} is an Int"))).otherwise(v.col.cast("long"))
    elif isinstance(t, T.DoubleType) and v.is_num:
        out = v.col.cast("double")
    elif isinstance(t, T.ArrayType) and v.is_list or isinstance(t, T.StructType) and v.is_tuple:
        out = v.col.cast(t)
    elif isinstance(t, T.StructType) and v.is_list:
        out = F.struct(*[F.get(v.col, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(t.fields)])
    elif kind == "uuid" and isinstance(v.type, T.StringType):
        out = F.lower(v.col)
    else:
        raise EngineError("eval::coercion", f"{name} is a {declared}, not {v.type.simpleString()}")
    n = length_of(declared)
    if n is not None:
        out = F.when(F.size(out) != n, F.raise_error(F.lit(f"{name} has {n} elements"))).otherwise(out)
    if not declared.endswith("?"):
        out = F.coalesce(out, F.raise_error(F.lit(f"{name} can't be null")))
    return out.alias(name, metadata={"kind": kind} if kind else {})


@dataclass(frozen=True)
class Relation:
    name: str
    keys: tuple  # of ir.Column
    values: tuple
    df: DataFrame
    level: str = "normal"
    triggers: tuple = ()  # (event, script)
    indices: dict = field(default_factory=dict)  # name -> (kind, config)
    data: dict = field(default_factory=dict)  # name -> what the index stores
    view: bool = False
    path: str | None = None

    @property
    def columns(self) -> tuple:
        return (*self.keys, *self.values)

    @property
    def key_names(self) -> list[str]:
        return [c.name for c in self.keys]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def valid_key(self) -> str | None:
        """The last key column, if it is a Validity."""
        return self.keys[-1].name if self.keys and self.df.schema[self.keys[-1].name].dataType == VALIDITY else None


def micros(at, spark: SparkSession) -> int:
    if isinstance(at, bool) or not isinstance(at, (int, str, float)):
        raise EngineError("eval::validity", "a time is microseconds, a text or NOW")
    if isinstance(at, (int, float)):
        return int(at)
    if at == "NOW":
        return int(time.time() * 1e6)
    if at == "END":
        return FOREVER
    return int(datetime.datetime.fromisoformat(at.replace("Z", "+00:00")).timestamp() * 1e6)


def as_of(df: DataFrame, keys: list[str], valid: str, at: int) -> DataFrame:
    """The latest row of each key by `at`, unless it is a retraction: one partial aggregate, no sort of histories."""
    others = [k for k in keys if k != valid]
    rest = [c for c in df.columns if c not in others]
    seen = df.where(col(valid).getField("ts") <= F.lit(at))
    last = F.max_by(F.struct(*[col(c) for c in rest]), F.struct(col(valid).getField("ts"), col(valid).getField("is_assert")))
    out = seen.groupBy(*[col(k) for k in others]).agg(last.alias("__last")) if others else seen.agg(last.alias("__last")).where("__last is not null")
    out = out.select(*[col(k) for k in others], F.col("__last.*"))
    return out.where(col(valid).getField("is_assert")).select(*[col(c) for c in df.columns])


class Catalog:
    """Relations by name. Every change makes a new version; a snapshot is a copy of the map."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.root = root or f"{shared_dir(spark).rstrip('/')}/relations-{uuid.uuid4().hex}"
        self.relations: dict[str, Relation] = {}

    # --- reading

    def get(self, name: str, write: bool = False) -> Relation:
        if name not in self.relations:
            raise EngineError("query::relation_not_found", f"no relation {name}")
        r = self.relations[name]
        if r.level == "hidden" or write and r.level == "read_only":
            raise EngineError("access", f"{name} is {r.level}")
        return r

    def rows(self, name: str, at=None) -> DataFrame:
        base, _, index = name.partition(":")
        r = self.get(base)
        if at is not None:
            if not r.valid_key:
                raise EngineError("query::no_validity", f"{name} has no Validity key")
            return as_of(r.df, r.key_names, r.valid_key, micros(at, self.spark))
        if not index:
            return r.df
        if index not in r.indices:
            raise EngineError("query::no_index", f"{base} has no index {index}")
        from tesserae.operators import search

        return search.index_rows(r, index)

    def covering(self, name: str, bound: set, needed: set) -> DataFrame | None:
        """The rows of an index that begins with a bound column and has all that is needed, if there is one."""
        r = self.relations.get(name)
        for index, (kind, config) in (r.indices if r else {}).items():
            if kind == "normal" and config["columns"][0] in bound and needed <= {*config["columns"], *r.key_names}:
                return r.data[index]
        return None

    def store_index(self, name: str, index: str, rows: DataFrame) -> None:
        from tesserae.operators import search

        r = self.relations[name]
        rows, _ = self.write(f"{name}.{index}", search.arranged(rows, *r.indices[index]))
        self.relations[name] = replace(r, data=r.data | {index: rows})

    def register(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """A DataFrame as a read-only relation; without keys, its rows may repeat."""
        make = lambda n: ir.Column(n, "Any?")
        names = keys or []
        self.relations[name] = Relation(name, tuple(make(n) for n in names), tuple(make(c) for c in df.columns if c not in names), df, level="read_only", view=True)

    # --- versions

    def write(self, name: str, df: DataFrame) -> tuple[DataFrame, str | None]:
        """A new version; relations whose name starts with _ are the session's, and are written alike."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        kinds = {f.name: f.metadata for f in df.schema.fields}
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        return back.select(*[col(c).alias(c, metadata=kinds[c]) for c in df.columns]), path

    def put(self, relation: Relation, df: DataFrame) -> Relation:
        df, path = self.write(relation.name, df.select(*[col(c) for c in relation.names]))
        out = replace(relation, df=df, path=path)
        self.relations[relation.name] = out
        return out

    def remove(self, name: str) -> None:
        if self.get(name, write=True).indices:
            raise EngineError("tx::has_indices", f"{name} has indices")
        if self.relations[name].level != "normal" and not self.relations[name].view:
            raise EngineError("access", f"{name} is {self.relations[name].level}")
        del self.relations[name]

    def rename(self, old: str, new: str) -> None:
        if new in self.relations:
            raise EngineError("tx::exists", f"{new} exists")
        self.relations[new] = replace(self.get(old), name=new)
        del self.relations[old]

    # --- mutations

    def declared(self, op: ir.RelationOp, result: DataFrame | None) -> tuple[tuple, tuple]:
        if op.keys is not None:
            return tuple(op.keys), tuple(op.values)
        if result is None:
            raise EngineError("parser::schema", "a schema or a query is needed")
        return tuple(ir.Column(re.sub(r"\W+", "_", c), "Any?", binding=c) for c in result.columns), ()

    def prepared(self, columns: tuple, given: tuple | None, result: DataFrame, now: int) -> DataFrame:
        """The query's rows as the relation's columns, defaults and coercion applied."""
        c = Compiler(result)
        bindings = {x.name: x for x in given or ()}
        out = []
        for column in columns:
            source = bindings.get(column.name, column)
            name = source.binding or column.name
            default = source.default or column.default
            if name in result.columns:
                value = c.value(ir.Var(name))
            elif default is not None:
                value = c.value(default)
            else:
                raise EngineError("query::missing_column", f"no value for column {column.name}")
            out.append(coerced(c, value, column.type, column.name, now))
        return result.select(*out)

    def mutate(self, op: ir.RelationOp, result: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Run an operation, and have the indices follow; (relation's new rows, rows put, rows removed)."""
        from tesserae.operators import search

        out = self.changed(op, result)
        r = self.relations[op.name]
        if op.op not in ("ensure", "ensure_not"):
            for index, (kind, config) in r.indices.items():
                self.store_index(op.name, index, search.changed(r.data[index], r, kind, config, out[1], out[2]))
        return out

    def changed(self, op: ir.RelationOp, result: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        now = int(time.time() * 1e6)
        old = self.relations.get(op.name)
        if op.op in ("create", "replace"):
            return self.make(op, result, old, now)
        relation = self.get(op.name, write=True)
        if relation.view:
            raise EngineError("access", f"{op.name} is a view")
        given = (*op.keys, *op.values) if op.keys is not None else None
        none = relation.df.limit(0)
        keys = relation.key_names
        if op.op in ("put", "insert", "ensure"):
            new = last_of_key(self.prepared(relation.columns, given, result, now), keys)
            if op.op == "ensure":
                if not minus(new.select(*[col(c) for c in relation.names]), relation.df).isEmpty():
                    raise EngineError("tx::assertion", f"{op.name} does not hold the ensured rows")
                return relation.df, none, none
            if op.op == "insert" and not matching(relation.df, new, keys).isEmpty():
                raise EngineError("tx::exists", f"a key is in {op.name} already")
            replaced = matching(relation.df, new, keys)
            rows = without(relation.df, new, keys).unionByName(new)
            return self.put(relation, rows).df, new, replaced
        if op.op == "update":
            present = [c for c in relation.columns if c.name in result.columns or given and c.name in {g.name for g in given}]
            missing = [k for k in keys if k not in {c.name for c in present}]
            if missing:
                raise EngineError("query::missing_column", f"no value for keys {missing}")
            new = last_of_key(self.prepared(tuple(present), given, result, now), keys)
            if not without(new, relation.df, keys).isEmpty():
                raise EngineError("tx::missing", f"a key is not in {op.name}")
            replaced = matching(relation.df, new, keys)
            right = new.toDF(*[f"__n_{c}" for c in new.columns])
            on = F.lit(True)
            for k in keys:
                on = on & col(k).eqNullSafe(col(f"__n_{k}"))
            changed = relation.df.join(right, on).select(*[col(f"__n_{c}").alias(c) if c in new.columns else col(c) for c in relation.names])
            rows = without(relation.df, new, keys).unionByName(changed)
            return self.put(relation, rows).df, changed, replaced
        gone = self.prepared(relation.keys, given, result, now)
        if op.op == "ensure_not":
            if not matching(relation.df, gone, keys).isEmpty():
                raise EngineError("tx::assertion", f"{op.name} holds a row that it must not")
            return relation.df, none, none
        if op.op == "delete" and not without(gone, relation.df, keys).isEmpty():
            raise EngineError("tx::missing", f"a key is not in {op.name}")
        removed = matching(relation.df, gone, keys)
        return self.put(relation, without(relation.df, gone, keys)).df, none, removed

    def make(self, op, result, old, now):
        if op.op == "create" and old is not None:
            raise EngineError("tx::exists", f"{op.name} exists")
        if old is not None and (old.indices or old.level != "normal"):
            raise EngineError("tx::replace", f"{op.name} has indices or is {old.level}")
        keys, values = self.declared(op, result)
        if not keys:
            raise EngineError("parser::schema", "a relation has a key")
        if result is None:
            fields = [T.StructField(c.name, spark_type(c.type)[0] or T.StringType(), metadata={"kind": k} if (k := spark_type(c.type)[1]) else {}) for c in (*keys, *values)]
            df = self.spark.createDataFrame([], T.StructType(fields))
        else:
            df = last_of_key(self.prepared((*keys, *values), None, result, now), [k.name for k in keys])
        plain = [replace(c, binding=None) for c in keys], [replace(c, binding=None) for c in values]
        relation = Relation(op.name, tuple(plain[0]), tuple(plain[1]), df, triggers=old.triggers if old else ())
        made = self.put(relation, df)
        return made.df, made.df, old.df if old is not None else made.df.limit(0)


def last_of_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of several rows with one key, the last in the order of all columns."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    kinds = {f.name: f.metadata for f in df.schema.fields}
    best = df.groupBy(*[col(k) for k in keys]).agg(F.max(F.struct(*[col(c) for c in rest])).alias("__r"))
    return best.select(*[col(c).alias(c, metadata=kinds[c]) if c in keys else F.col("__r").getField(c).alias(c, metadata=kinds[c]) for c in df.columns])


def on_keys(keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & col(k).eqNullSafe(col(f"__k_{k}"))
    return on


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[col(k).alias(f"__k_{k}") for k in keys])


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(keyed(other, keys), on_keys(keys), "left_anti")


def matching(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(keyed(other, keys), on_keys(keys), "left_semi")


def backup(catalog: Catalog, path: str) -> None:
    """Every stored relation's rows and declaration under path."""
    meta = {}
    for name, r in catalog.relations.items():
        if r.view or name.startswith("_"):
            continue
        r.df.write.mode("overwrite").parquet(f"{path}/{name}")
        meta[name] = {"keys": [(c.name, c.type) for c in r.keys], "values": [(c.name, c.type) for c in r.values], "level": r.level, "triggers": r.triggers}
    catalog.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/__catalog")


def restore(catalog: Catalog, path: str, names: list[str] | None = None) -> None:
    meta = json.loads("".join(r[0] for r in catalog.spark.read.text(f"{path}/__catalog").collect()))
    for name in names or meta:
        m = meta[name]
        df = catalog.spark.read.parquet(f"{path}/{name}")
        r = Relation(name, tuple(ir.Column(*c) for c in m["keys"]), tuple(ir.Column(*c) for c in m["values"]), df, m["level"], tuple(map(tuple, m["triggers"])))
        catalog.put(r, df)
