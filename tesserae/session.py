"""The public interface: run scripts, store relations, subscribe to changes, transact."""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.scalar import Compiler, Val, as_json
from tesserae.operators import search
from tesserae.plans import fixed_rules, ir
from tesserae.plans.compiler import Context, col, literal_rows, run_rules, shaped
from tesserae.plans.ir import EngineError
from tesserae.plans.parser import constant, parse, parse_expression
from tesserae.ship import ship
from tesserae.sources.catalog import LEVELS, Catalog, backup, restore


class Break(Exception):  # noqa: N818
    def __init__(self, label: str | None, again: bool) -> None:
        self.label, self.again = label, again


class Return(Exception):  # noqa: N818
    def __init__(self, results: list) -> None:
        self.results = results


class Session:
    """One writer over a catalog of relations; every change is a new immutable version."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        ship(spark)
        self.spark, self.catalog = spark, Catalog(spark, path)
        self.custom: dict[str, tuple[Callable, int | None]] = {}
        self.callbacks: dict[int, tuple[str, Callable]] = {}
        self.running: dict[str, tuple[float, str]] = {}
        self.pending: list = []
        self.depth = 0
        self.lock = threading.RLock()

    # --- relations from outside

    def register(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """A DataFrame as a read-only relation; declared keys spare distinct where they are kept."""
        self.catalog.register(name, df, keys)

    def register_dir(self, folder: str, names: list[str]) -> None:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))

    # --- running

    def run(self, script: str, params: dict | None = None, read_only: bool = False) -> DataFrame:
        """Run a script; the last result. A script is one transaction: it fails as a whole."""
        return self.run_all(script, params, read_only)[-1]

    def run_all(self, script: str, params: dict | None = None, read_only: bool = False) -> list[DataFrame]:
        kind, what = parse(script, params)
        with self.lock, self.atomic():
            if kind == "sys":
                return [self.system(what, read_only)]
            if kind == "imperative":
                return self.imperative(what, read_only)
            return [self.program(what, read_only)]

    def run_named(self, script: str, params: dict | None = None, read_only: bool = False) -> NamedRows:
        """All results of a script, collected."""
        return NamedRows.collected(self.run_all(script, params, read_only))

    def run_program(self, program: ir.Program, read_only: bool = False) -> DataFrame:
        """Run a program that parse() gave."""
        with self.lock, self.atomic():
            return self.program(program, read_only)

    def run_json(self, script: str, params: str = "{}", read_only: bool = False) -> str:
        """Run a script with parameters as JSON; the result, or the error, as JSON. The rows are collected."""
        began = time.time()
        try:
            result = self.run(script, json.loads(params) or None, read_only)
            types = {f.name: f.dataType for f in result.schema.fields}
            rows = [json.loads(r[0]) for r in result.select(F.to_json(F.array(*[as_json(Val(col(c), t)) for c, t in types.items()]))).collect()]
            out = {"ok": True, "headers": result.columns, "rows": [[json.loads(v) for v in r] for r in rows]}
        except Exception as error:  # of any kind: the caller reads text
            out = {"ok": False, "display": str(error)[:2000], "code": getattr(error, "code", None)}
        return json.dumps(out | {"took": time.time() - began}, ensure_ascii=False)

    @contextlib.contextmanager
    def atomic(self) -> Iterator[None]:
        """Versions are swapped at the end, or not at all; callbacks follow the outermost commit."""
        before, self.depth = dict(self.catalog.relations), self.depth + 1
        try:
            yield
        except BaseException:
            self.catalog.relations = before
            if self.depth == 1:
                self.pending = []
            raise
        finally:
            self.depth -= 1
        if not self.depth:
            done, self.pending = self.pending, []
            for name, op, new, old in done:
                for relation, fn in list(self.callbacks.values()):
                    if relation == name:
                        fn(op, new, old)

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Session]:
        """Scripts run inside are committed together, and undone together on an exception."""
        with self.lock, self.atomic():
            yield self

    def context(self, extra: dict[str, DataFrame] | None = None) -> Context:
        def relation(name: str, at):
            return self.catalog.rows(name, None if at is None else constant(at))

        def keys(name: str):
            r = self.catalog.relations.get(name)
            return r.key_names if r and r.keys else None

        ctx = Context(self.spark, relation, lambda atom, rows, c: search.search_atom(self.catalog, atom, rows, constant), lambda rule: self.fixed(rule, ctx), keys, covering=self.catalog.covering, sets=fixed_rules.DISTINCT - self.custom.keys())
        ctx.rules.update(extra or {})
        return ctx

    def fixed(self, rule: ir.FixedRule, ctx: Context) -> DataFrame:
        inputs = []
        for x in rule.inputs:
            if not x.stored:
                if x.name not in ctx.rules:
                    raise EngineError("query::undefined_rule", f"no rule {x.name}")
                df = ctx.rules[x.name]
            else:
                df = ctx.relation(x.name, x.at)
            if x.named is not None:
                df = df.select(*[col(c).alias(v) for c, v in x.named])
            elif x.columns:
                if len(x.columns) != len(df.columns):
                    raise EngineError("query::arity", f"{x.name} has {len(df.columns)} columns")
                df = df.toDF(*x.columns)
            inputs.append(df)
        call = fixed_rules.Call(self.spark, rule.call, inputs, rule.options)
        if rule.call in self.custom:
            fn, arity = self.custom[rule.call]
            out = fn(inputs, {k: constant(v) for k, v in rule.options.items()})
            out = out if isinstance(out, DataFrame) else literal_rows(self.spark, [list(r) for r in out], arity or 0)
            if arity is not None and len(out.columns) != arity:
                raise EngineError("parser::fixed_arity", f"{rule.call} has {arity} columns")
            return out
        if rule.call not in fixed_rules.RULES:
            raise EngineError("parser::no_fixed_rule", f"no fixed rule {rule.call}")
        return fixed_rules.RULES[rule.call](call)

    def program(self, p: ir.Program, read_only: bool = False, extra: dict | None = None, top: bool = True) -> DataFrame:
        if read_only and p.relation:
            raise EngineError("tx::read_only", "the script must not write")
        ident = uuid.uuid4().hex[:12]
        self.running[ident] = (time.time(), p.text)
        sc, timer = self.spark.sparkContext, None
        if p.timeout:
            sc.setJobGroup(ident, p.text[:200], interruptOnCancel=True)
            timer = threading.Timer(p.timeout, sc.cancelJobGroup, [ident])
            timer.start()
        try:
            result = shaped(run_rules(self.context(extra), p), p) if any(r.name == "?" for r in p.rules) else None
            if result is None and not (p.relation and p.relation.op == "create"):
                raise EngineError("parser::no_entry", "the program has no entry rule ?")
            if p.timeout and not p.relation:
                result = search.cut(result)  # the time covers the work, not the plan alone
            if p.assertion and result is not None and result.isEmpty() != (p.assertion == "none"):
                raise EngineError("eval::assert", f":assert {p.assertion} does not hold")
            if p.relation:
                result = self.mutate(p, result, top)
            if p.sleep:
                time.sleep(p.sleep)
            return result
        finally:
            if timer:
                timer.cancel()
                sc.setLocalProperty("spark.jobGroup.id", None)
            self.running.pop(ident, None)

    def mutate(self, p: ir.Program, result: DataFrame | None, top: bool) -> DataFrame:
        op = p.relation
        if not top and op.op == "replace":
            raise EngineError("tx::trigger", "a trigger can't replace a relation")
        _, new, old = self.catalog.mutate(op, result)
        relation = self.catalog.relations[op.name]
        event = {"put": "put", "insert": "put", "update": "put", "create": "put", "rm": "rm", "delete": "rm", "replace": "replace"}.get(op.op)
        if event:
            if top:
                for kind, script in relation.triggers:
                    if kind == event:
                        _, inner = parse(script)
                        rows = {"_new": new.toDF(*map(str, range(len(new.columns)))), "_old": old.toDF(*map(str, range(len(old.columns))))}
                        self.program(inner, extra=rows, top=False)
            if any(name == op.name for name, _ in self.callbacks.values()):
                self.pending.append((op.name, event, new, old))
        if p.returning:
            kind = {"put": "inserted", "rm": "requested"}.get(event, "inserted")
            parts = [new.select(F.lit(kind).alias("_kind"), *[col(c) for c in new.columns])] if event != "rm" else []
            if not old.isEmpty() or event == "rm":
                parts.append(old.select(F.lit("deleted" if event == "rm" else "replaced").alias("_kind"), *[col(c) for c in old.columns]))
            out = parts[0]
            for x in parts[1:]:
                out = out.unionByName(x)
            return out
        return status(self.spark)

    # --- imperative scripts

    def imperative(self, statements: list, read_only: bool) -> list[DataFrame]:
        temps: dict[str, DataFrame] = {}

        def view(name: str) -> DataFrame:
            return temps[name] if name in temps else self.catalog.rows(name)

        def execute(item) -> DataFrame:
            if item[0] == "relation":
                return view(item[1])
            kind, what, name = item
            saved = {}
            for n, df in temps.items():
                saved[n] = self.catalog.relations.get(n)
                if saved[n] is None or saved[n].view:
                    self.catalog.register(n, df, list(df.columns))
            out = self.system(what, read_only) if kind == "sys" else self.program(what, read_only)
            if kind == "query" and what.relation and what.relation.name.startswith("_"):
                temps[what.relation.name] = self.catalog.relations[what.relation.name].df
            if name:
                import re

                names = [re.sub(r"\W+", "_", c).strip("_") or f"c{i}" for i, c in enumerate(out.columns)]
                temps[name] = search.cut(out.toDF(*names))
                out = temps[name]
            return out

        def walk(items: list) -> DataFrame | None:
            last = None
            for s in items:
                if s[0] in ("query", "sys"):
                    last = execute(s)
                elif s[0] == "if":
                    _, cond, negated, yes, no = s
                    last = walk(no if execute(cond).isEmpty() != negated else yes)
                elif s[0] == "loop":
                    while True:
                        try:
                            walk(s[2])
                        except Break as b:
                            if b.label is not None and b.label != s[1]:
                                raise
                            if not b.again:
                                break
                elif s[0] in ("break", "continue"):
                    raise Break(s[1], s[0] == "continue")
                elif s[0] == "return":
                    raise Return([execute(x) for x in s[1]])
                elif s[0] == "swap":
                    a, b = s[1], s[2]
                    temps[a], temps[b] = view(b), view(a)
                elif s[0] == "debug":
                    view(s[1]).show()
                elif s[0] == "ignore_error":
                    with contextlib.suppress(Exception), self.atomic():
                        last = execute(s[1])
            return last

        try:
            out = walk(statements)
            return [out if out is not None else status(self.spark)]
        except Return as r:
            return r.results or [status(self.spark)]
        except Break:
            raise EngineError("imperative", "%break or %continue outside of its loop") from None
        finally:
            for n in temps:
                r = self.catalog.relations.get(n)
                if r and n.startswith("_"):
                    del self.catalog.relations[n]

    # --- system operations

    def system(self, op: tuple, read_only: bool = False) -> DataFrame:
        word, rels, make = op[0], self.catalog.relations, self.spark.createDataFrame
        writes = word in ("remove", "rename", "access_level", "set_triggers", "index", "hnsw", "fts", "lsh")
        if read_only and writes:
            raise EngineError("tx::read_only", "the script must not write")
        if word == "relations":
            rows = [(r.name, len(r.columns), r.level, len(r.keys), len(r.values), *[sum(e == k for e, _ in r.triggers) for k in ("put", "rm", "replace")], "") for r in rels.values()]
            return make(rows, "name string, arity long, access_level string, n_keys long, n_non_keys long, n_put_triggers long, n_rm_triggers long, n_replace_triggers long, description string")
        if word == "columns":
            r = rels.get(op[1]) or self.catalog.get(op[1])
            rows = [(c.name, c in r.keys, i, c.type, c.default is not None, None if c.default is None else str(c.default)) for i, c in enumerate(r.columns)]
            return make(rows, "column string, is_key boolean, index long, type string, has_default boolean, default_expr string")
        if word == "indices":
            rows = [(n, kind, op[1], str({k: v for k, v in config.items()})) for n, (kind, config) in self.catalog.get(op[1]).indices.items()]
            return make(rows, "name string, type string, relations string, config string")
        if word == "fixed_rules":
            return make([(n,) for n in sorted({*fixed_rules.RULES, *self.custom})], "rule string")
        if word == "running":
            return make([(k, at) for k, (at, _) in self.running.items()], "id string, started_at double")
        if word == "kill":
            self.spark.sparkContext.cancelJobGroup(str(constant(op[1])))
        elif word == "compact":
            for r in list(rels.values()):
                if not r.view:
                    self.catalog.put(r, r.df.coalesce(max(1, r.df.rdd.getNumPartitions() // 2)))
        elif word == "remove":
            for n in op[1]:
                self.catalog.remove(n)
        elif word == "rename":
            for old, new in op[1]:
                self.catalog.rename(old, new)
        elif word == "access_level":
            if op[1] not in LEVELS:
                raise EngineError("parser", f"a level is one of {LEVELS}")
            for n in op[2]:
                rels[n] = replace(rels[n] if n in rels else self.catalog.get(n), level=op[1])
        elif word == "set_triggers":
            for _, script in op[2]:
                parse(script)
            rels[op[1]] = replace(self.catalog.get(op[1], write=True), triggers=tuple(op[2]))
        elif word == "show_triggers":
            rows = [(event, i, script) for i, (event, script) in enumerate(self.catalog.get(op[1]).triggers)]
            return make(rows, "type string, idx long, trigger string")
        elif word == "explain":
            return self.explain(op[1])
        else:
            self.index(op)
        return status(self.spark)

    def index(self, op: tuple) -> None:
        kind, verb, name, index = op[:4]
        r = self.catalog.get(name)
        if verb == "drop":
            if index not in r.indices:
                raise EngineError("query::no_index", f"{name} has no index {index}")
            without = lambda d: {k: v for k, v in d.items() if k != index}
            self.catalog.relations[name] = replace(r, indices=without(r.indices), data=without(r.data))
            return
        if index in r.indices:
            raise EngineError("tx::exists", f"{name} has an index {index}")
        if kind == "index":
            missing = [c for c in op[4] if c not in r.names]
            if missing:
                raise EngineError("query::no_column", f"{name} has no columns {missing}")
            config = {"columns": op[4]}
        else:
            config = self.analysis(kind, op[4])
        kind = "normal" if kind == "index" else kind
        if kind != "normal" and not r.keys:
            raise EngineError("search::keys", f"{name} is searched by its keys, and declares none")
        r = self.catalog.relations[name] = replace(r, indices=r.indices | {index: (kind, config)})
        self.catalog.store_index(name, index, search.entries(r, kind, config))

    @staticmethod
    def analysis(kind: str, options: dict) -> dict:
        def names(e) -> list:
            return [x.name if isinstance(x, ir.Var) else x for x in e.args] if isinstance(e, ir.Items) else [e.name if isinstance(e, ir.Var) else e]

        config: dict = {}
        for k, e in options.items():
            if k in ("extractor", "extract_filter", "filter", "tokenizer"):
                config[k] = e
            elif k in ("fields", "filters"):
                config[k] = names(e) if k == "fields" else list(e.args) if isinstance(e, ir.Items) else [e]
            elif k == "distance" or k == "dtype":
                config[k] = e.name if isinstance(e, ir.Var) else constant(e)
            else:
                config[k] = constant(e)
        if kind == "hnsw":
            if not config.get("fields") or "dim" not in config:
                raise EngineError("parser::hnsw", "a vector index has dim and fields")
            config.setdefault("distance", "L2")
        else:
            if "extractor" not in config:
                raise EngineError("parser::index", "a text index has an extractor")
            config.setdefault("tokenizer", ir.Var("Simple"))
            config.setdefault("filters", [])
            from tesserae.functions.text import analyzer

            analyzer(config["tokenizer"], config["filters"])
        return config

    def explain(self, p: ir.Program) -> DataFrame:
        """Strata, rules and atoms in the order in which they run, and Spark's plan of the result."""
        from tesserae.plans import magic
        from tesserae.plans.normalize import dnf, ordered
        from tesserae.plans.stratify import strata

        rules: dict[str, list] = {}
        for r in p.rules:
            rules.setdefault(r.name, []).append(r)
        rules = magic.rewritten(rules) if p.magic else rules
        rows = []
        for s, (group, recursive) in enumerate(strata(rules)):
            for n in group:
                for i, r in enumerate(rules[n]):
                    bodies = [ordered(b) for b in dnf(r.body)] if isinstance(r, ir.Rule) else [[r]]
                    rows += [(s, i, n, recursive, a, type(x).__name__, str(x)) for b in bodies for a, x in enumerate(b)]
        if any(r.name == "?" for r in p.rules):
            plan = run_rules(self.context(), p)._jdf.queryExecution().simpleString()
            rows.append((len(rows), 0, "?", False, 0, "SparkPlan", plan))
        return self.spark.createDataFrame(rows, "stratum long, rule_idx long, rule string, recursive boolean, atom_idx long, op string, ref string")

    # --- the rest of the interface

    def register_rule(self, name: str, fn: Callable, arity: int | None = None) -> None:
        """fn(inputs: list of DataFrames, options) -> DataFrame or rows, called as a fixed rule."""
        if name in self.custom or name in fixed_rules.RULES:
            raise EngineError("fixed_rule::exists", f"{name} is there already")
        self.custom[name] = (fn, arity)

    def unregister_rule(self, name: str) -> bool:
        return self.custom.pop(name, None) is not None

    def on_change(self, relation: str, fn: Callable) -> int:
        """Call fn(event, new rows, old rows) after each commit that changed the relation."""
        ident = max(self.callbacks, default=0) + 1
        self.callbacks[ident] = (relation, fn)
        return ident

    def remove_callback(self, ident: int) -> bool:
        return self.callbacks.pop(ident, None) is not None

    def export(self, names: list[str]) -> dict[str, DataFrame]:
        return {n: self.catalog.rows(n) for n in names}

    def import_(self, relations: dict[str, DataFrame]) -> None:
        """Put rows into relations, all or none; triggers do not run. A name with - before it removes rows."""
        with self.lock, self.atomic():
            for n, df in relations.items():
                self.catalog.mutate(ir.RelationOp("rm" if n.startswith("-") else "put", n.removeprefix("-")), df)

    def backup(self, path: str) -> None:
        backup(self.catalog, path)

    def restore(self, path: str) -> None:
        if any(not r.view for r in self.catalog.relations.values()):
            raise EngineError("restore", "a backup is restored into a session without relations")
        restore(self.catalog, path)

    def import_from_backup(self, path: str, names: list[str]) -> None:
        for n in names:
            self.catalog.get(n, write=True)
        restore(self.catalog, path, names)

    def evaluate(self, expression: str, params: dict | None = None):
        """The value of an expression without variables."""
        e = parse_expression(expression, params)
        df = self.spark.range(1).select()
        return df.select(Compiler(df).column(e).alias("x")).first()[0]

    @staticmethod
    def variables(expression: str, params: dict | None = None) -> set[str]:
        return ir.variables(parse_expression(expression, params))


@dataclass
class NamedRows:
    """Collected results with their headers, and the result after this one where a script returns several."""

    headers: list[str]
    rows: list[list]
    next: NamedRows | None = None

    @classmethod
    def collected(cls, frames: list[DataFrame]) -> NamedRows:
        out = None
        for df in reversed(frames):
            out = cls(df.columns, [list(r) for r in df.collect()], out)
        return out

    @property
    def has_more(self) -> bool:
        return self.next is not None

    def flatten(self) -> list[NamedRows]:
        """Each result by itself."""
        one = NamedRows(self.headers, self.rows)
        return [one, *self.next.flatten()] if self.next else [one]

    def into_json(self) -> dict:
        return {"headers": self.headers, "rows": self.rows, "next": self.next.into_json() if self.next else None}

    @classmethod
    def from_json(cls, value: dict) -> NamedRows:
        return cls(list(value["headers"]), [list(r) for r in value["rows"]], cls.from_json(value["next"]) if value.get("next") else None)

    def into_payload(self, relation: str, op: str) -> tuple[str, dict]:
        """A script and its parameters that run `op` (put, rm, ...) on a relation with these rows."""
        names = ", ".join(self.headers)
        return f"?[{names}] <- $data :{op} {relation} {{{names}}}", {"data": self.rows}


def status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("OK",)], "status string")


__all__ = ["EngineError", "NamedRows", "Session"]
