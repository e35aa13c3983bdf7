"""Rules to DataFrames: one declarative plan for each body, loops only where rules are recursive."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.aggregates import aggregated, is_meet
from tesserae.functions.scalar import Compiler, equal, untupled
from tesserae.plans import ir, magic
from tesserae.plans.ir import EngineError
from tesserae.plans.normalize import dnf, ordered
from tesserae.plans.parser import constant
from tesserae.plans.stratify import strata
from tesserae.storage import counted, cut

FRESH = itertools.count()
MOST_PARTS = 16


def fresh(stem: str = "t") -> str:
    return f"__{stem}{next(FRESH)}"


def col(name: str):
    return F.col(f"`{name}`")


@dataclass
class Context:
    """What a program may refer to."""

    spark: object
    relation: Callable  # (name, at) -> DataFrame with the relation's columns
    search: Callable  # (atom, rows so far, context) -> DataFrame
    fixed: Callable  # (name, inputs, options, head) -> DataFrame
    keys: Callable = lambda name: None  # declared key columns of a relation, or None
    covering: Callable = lambda name, bound, needed: None  # an index's rows that serve an atom as well, or None
    rules: dict[str, DataFrame] = field(default_factory=dict)
    most_epochs: int = 1000
    sets: frozenset = frozenset()  # fixed rules whose rows are distinct
    steps: list = field(default_factory=list)  # for ::explain


@dataclass
class Body:
    """Rows of a body so far, a column for each bound variable, and variables that are constants."""

    df: DataFrame | None = None
    constants: dict = field(default_factory=dict)
    unique: bool = False  # rows are known to be distinct on all bound variables

    def frame(self, spark) -> DataFrame:
        df = self.df if self.df is not None else spark.range(1).select()
        c = Compiler(df)
        have = set(df.columns)
        return df.select("*", *[c.column(e).alias(v) for v, e in self.constants.items() if v not in have])


def sourced(ctx: Context, atom, override: dict | None) -> DataFrame:
    """The relation behind an atom, columns renamed 0, 1, ... (positional) or kept (named)."""
    if isinstance(atom, ir.RuleAtom):
        rules = ctx.rules if not override else ctx.rules | override
        if atom.name not in rules:
            raise EngineError("query::undefined_rule", f"no rule {atom.name}")
        df = rules[atom.name]
        if len(df.columns) != len(atom.args):
            raise EngineError("query::arity", f"rule {atom.name} has {len(df.columns)} columns, not {len(atom.args)}")
        return df
    return ctx.relation(atom.name, atom.at)


def pairs_of(atom, df: DataFrame) -> list[tuple[str, ir.Expr]]:
    if isinstance(atom, ir.RelAtom) and atom.args is None:
        for c, _ in atom.named:
            if c not in df.columns:
                raise EngineError("query::no_column", f"relation {atom.name} has no column {c}")
        return list(atom.named)
    if len(atom.args) != len(df.columns):
        raise EngineError("query::arity", f"{atom.name} has {len(df.columns)} columns, not {len(atom.args)}")
    return list(zip(df.columns, atom.args, strict=True))


def scanned(ctx: Context, atom, body: Body, override: dict | None) -> tuple[DataFrame, dict[str, str], list]:
    """The atom's rows with filters on constants applied; {variable: column}; other column-to-expression equalities."""
    df = sourced(ctx, atom, override)
    columns, rest, tests, kept = {}, [], [], {}
    pairs = pairs_of(atom, df)
    if isinstance(atom, ir.RelAtom) and atom.at is None:
        constants = {n for n, e in pairs if not ir.variables(e) or isinstance(e, ir.Var) and e.name in body.constants}
        used = {n for n, e in pairs if not (isinstance(e, ir.Var) and e.name == "_")}
        df = ctx.covering(atom.name, constants, used) or df if constants else df
    c = Compiler(df)
    for name, e in pairs:
        if isinstance(e, ir.Var) and e.name == "_":
            continue
        if isinstance(e, ir.Var) and e.name in body.constants and (body.df is None or e.name not in body.df.columns):
            e = body.constants[e.name]
        if isinstance(e, ir.Var):
            if e.name in columns:
                tests.append(col(columns[e.name]).eqNullSafe(col(name)))
            else:
                columns[e.name] = name
        elif not ir.variables(e):
            value, field_ = Compiler(df).value(e), c.value(ir.Var(name))
            tests.append(field_.col.isNull() if isinstance(value.type, T.NullType) else field_.col == value.col if equal_types(field_, value) else F.lit(False))
        else:
            rest.append((name, e))
    for t in tests:
        df = df.where(t)
    for v, name in columns.items():
        kept[v] = fresh("c")
    extra = [(fresh("c"), name, e) for name, e in rest]
    df = df.select(*[col(columns[v]).alias(kept[v]) for v in columns], *[col(name).alias(n) for n, name, _ in extra])
    return df, kept, [(n, e) for n, _, e in extra]


def equal_types(a, b) -> bool:
    return a.is_num and b.is_num or type(a.type) is type(b.type)


def joined(ctx: Context, body: Body, atom, override: dict | None, negated: bool) -> Body:
    df, columns, rest = scanned(ctx, atom, body, override)
    if body.df is None and not negated and not rest:
        unique = isinstance(atom, ir.RuleAtom)
        if isinstance(atom, ir.RelAtom) and atom.at is None:
            keys = ctx.keys(atom.name)
            args = dict(pairs_of(atom, ctx.relation(atom.name, None)))
            unique = keys is not None and all(isinstance(args.get(k), ir.Var) and args[k].name != "_" or k in args and not ir.variables(args[k]) for k in keys)
        elif isinstance(atom, ir.RuleAtom):
            unique = all(not (isinstance(a, ir.Var) and a.name == "_") for a in atom.args)
        return Body(df.select(*[col(n).alias(v) for v, n in columns.items()]), body.constants, unique)
    left = body.frame(ctx.spark) if (rest or negated) else body.df if body.df is not None else body.frame(ctx.spark)
    on = F.lit(True)
    shared = [v for v in columns if v in left.columns]
    for v in shared:
        on = on & col(v).eqNullSafe(col(columns[v]))
    for name, e in rest:
        on = on & equal(None, Compiler(left).value(e), Compiler(df).value(ir.Var(name)))
    if negated:
        df = df.select(*[columns[v] for v in shared], *[n for n, _ in rest])
        return Body(left.join(df, on, "left_anti"), body.constants, body.unique)
    new = [v for v in columns if v not in left.columns]
    if not shared and not rest:
        out = left.crossJoin(df)
    else:
        out = left.join(df, on)
    return Body(out.select(*[col(v) for v in left.columns], *[col(columns[v]).alias(v) for v in new]), body.constants)


def extended(ctx: Context, body: Body, atom) -> Body:
    """Assignments, unnesting and tests."""
    if isinstance(atom, ir.Unify) and not ir.variables(atom.expr) and atom.var not in body.constants and (body.df is None or atom.var not in body.df.columns):
        return Body(body.df, body.constants | {atom.var: atom.expr}, body.unique)
    df = body.frame(ctx.spark)
    c = Compiler(df)
    if isinstance(atom, ir.Pred):
        v = c.value(atom.expr)
        if not isinstance(v.type, (T.BooleanType, T.NullType)):
            raise EngineError("eval::predicate", f"a predicate is boolean, not {v.type.simpleString()}")
        return Body(df.where(v.col), body.constants, body.unique)
    v = c.value(atom.expr)
    bound = atom.var in df.columns
    if isinstance(atom, ir.Unify):
        if bound:
            return Body(df.where(equal(c, c.value(ir.Var(atom.var)), v)), body.constants, body.unique)
        meta = {"kind": v.kind} if v.kind else {}
        return Body(df.select("*", v.col.alias(atom.var, metadata=meta)), body.constants, body.unique)
    v = untupled(c, v)
    if not v.is_list:
        if v.is_tuple:
            v = c.typed(F.array(*[v.col.getField(n).cast("string") for n in v.type.names]))
        else:
            raise EngineError("eval::type", "only lists can be unnested")
    if bound:
        return Body(df.where(F.exists(v.col, lambda e: e.eqNullSafe(col(atom.var)))), body.constants, body.unique)
    return Body(df.select("*", F.explode(v.col).alias(atom.var)), body.constants)


def body_rows(ctx: Context, atoms: list, overrides: dict[int, dict] | None = None) -> Body:
    """Run a body; overrides give an atom (by place) other rows for its rule."""
    body = Body()
    for atom in atoms:
        override = (overrides or {}).get(id(atom))
        if isinstance(atom, (ir.RuleAtom, ir.RelAtom)):
            body = joined(ctx, body, atom, override, False)
        elif isinstance(atom, ir.Not):
            body = joined(ctx, body, atom.atom, override, True)
        elif isinstance(atom, ir.SearchAtom):
            body = Body(ctx.search(atom, body.frame(ctx.spark), ctx), body.constants)
        else:
            body = extended(ctx, body, atom)
    return body


def head_rows(ctx: Context, head: tuple, body: Body) -> DataFrame:
    """The head's variables as columns 0, 1, ...: duplicates of rows are kept."""
    df = body.frame(ctx.spark)
    for h in head:
        if h.var not in df.columns:
            raise EngineError("eval::unbound_symb_in_head", f"variable {h.var} of the head is not bound")
    return df.select(*[col(h.var).alias(str(i)) for i, h in enumerate(head)])


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns by position under the names and types of schema."""
    return df.select(*[col(c).cast(f.dataType).alias(f.name, metadata=f.metadata) for c, f in zip(df.columns, schema.fields, strict=True)])


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        if len(f.columns) != len(out.columns):
            raise EngineError("query::arity", "rules of one name have heads of one length")
        out = out.union(f)
    return out


def head_of(rules: list) -> tuple:
    heads = [r.head for r in rules]
    if any([(h.aggr, h.args) for h in x] != [(h.aggr, h.args) for h in heads[0]] for x in heads[1:]):
        raise EngineError("parser::head_aggr_mismatch", f"the heads of {rules[0].name} have different aggregates")
    return heads[0]


def bodies_of(rules: list) -> list[tuple[tuple, list]]:
    return [(r.head, ordered(b)) for r in rules for b in dnf(r.body)]


def constant_rows(ctx: Context, rule: ir.ConstRule) -> DataFrame:
    rows = constant(rule.value)
    if not isinstance(rows, list) or any(not isinstance(r, list) for r in rows):
        raise EngineError("parser::const", "a constant rule has a list of lists")
    width = len(rule.head) or (len(rows[0]) if rows else 0)
    if any(len(r) != width for r in rows):
        raise EngineError("parser::const", f"the rows of {rule.name} have different lengths")
    return literal_rows(ctx.spark, list({repr(r): r for r in rows}.values()), width)  # a set


def type_of(values: list) -> T.DataType:
    seen = [v for v in values if v is not None]
    if not seen:
        return T.StringType()
    if all(isinstance(v, bool) for v in seen):
        return T.BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in seen):
        return T.LongType()
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in seen):
        return T.DoubleType()
    if all(isinstance(v, (bytes, bytearray)) for v in seen):
        return T.BinaryType()
    if all(isinstance(v, (list, tuple)) for v in seen):
        return T.ArrayType(type_of([x for v in seen for x in v]))
    if all(isinstance(v, str) for v in seen):
        return T.StringType()
    if all(type(v) is type(seen[0]) for v in seen) and not isinstance(seen[0], (dict, list)):
        import pyspark.sql.types as all_types

        return all_types._infer_type(seen[0])
    return T.StringType()  # of mixed types: JSON text


def fit(v, t: T.DataType):
    if v is None:
        return None
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(t, T.ArrayType):
        return [fit(x, t.elementType) for x in v]
    if isinstance(t, T.StringType) and not isinstance(v, str):
        from tesserae.functions.scalar import dumps

        return dumps(v)
    return v


def literal_rows(spark, rows: list, width: int) -> DataFrame:
    types = [type_of([r[i] for r in rows]) for i in range(width)]
    schema = T.StructType([T.StructField(str(i), t) for i, t in enumerate(types)])
    return spark.createDataFrame([tuple(fit(v, t) for v, t in zip(r, types, strict=True)) for r in rows], schema)


def evaluate(ctx: Context, rules: list) -> DataFrame:
    """A rule that is not recursive."""
    first = rules[0]
    if isinstance(first, ir.ConstRule):
        return constant_rows(ctx, first) if len(rules) == 1 else union([constant_rows(ctx, r) for r in rules]).distinct()
    if isinstance(first, ir.FixedRule):
        if len(rules) > 1:
            raise EngineError("parser::fixed", f"{first.name} has a fixed rule and others")
        out = ctx.fixed(first)
        if first.head and len(first.head) != len(out.columns):
            raise EngineError("parser::fixed_arity", f"{first.call} has {len(out.columns)} columns, not {len(first.head)}")
        out = out.toDF(*map(str, range(len(out.columns))))
        # algorithms give each node or pair once; readers and custom rules may repeat rows
        return out if first.call in ctx.sets else out.distinct()
    head = head_of(rules)
    found = [(h, body_rows(ctx, b)) for h, b in bodies_of(rules)]
    frames = [head_rows(ctx, h, b) for h, b in found]
    rows = union(frames)
    if any(h.aggr for h in head):
        return aggregated(rows, head, [str(i) for i in range(len(head))], constant)
    if len(found) == 1 and found[0][1].unique and set(found[0][1].frame(ctx.spark).columns) <= {h.var for h in head}:
        return rows
    return rows.distinct()


# --- recursion -------------------------------------------------------------------------------------


def minus(new: DataFrame, old: DataFrame) -> DataFrame:
    right = old.toDF(*[f"__o{i}" for i in range(len(old.columns))])
    on = F.lit(True)
    for i, c in enumerate(new.columns):
        on = on & col(c).eqNullSafe(col(f"__o{i}"))
    return new.join(right, on, "left_anti")


def occurrences(atoms: list, group: set) -> list:
    return [a for a in atoms if isinstance(a, ir.RuleAtom) and a.name in group]


def fixpoint(ctx: Context, group: list[str], rules: dict[str, list]) -> dict[str, DataFrame]:
    """Semi-naive evaluation of mutually recursive rules.

    Each epoch runs every body once for each recursive atom, that atom reading the rows that the
    last epoch added and the others all rows. Meet aggregates merge new rows into the groups; the
    groups that changed are the next epoch's rows.
    """
    names = set(group)
    bodies = {n: bodies_of(rules[n]) for n in group}
    heads = {n: head_of(rules[n]) for n in group}
    meets = {n for n in group if is_meet(heads[n])}

    def reduced(n: str, df: DataFrame) -> DataFrame:
        if n in meets:
            return aggregated(df, heads[n], list(df.columns), constant)
        return df.distinct()

    total, delta = {}, {}
    pending = list(group)
    # base bodies first; a rule without one starts from the bodies that its fellows' bases allow
    while pending:
        progress = False
        for n in list(pending):
            ready = [(h, b) for h, b in bodies[n] if all(a.name in total for a in occurrences(b, names))]
            base = [(h, b) for h, b in ready if not occurrences(b, names)] or ready
            if not base:
                continue
            sub = ctx if not total else Context(**{**ctx.__dict__, "rules": ctx.rules | total})
            rows = union([head_rows(sub, h, body_rows(sub, b)) for h, b in base])
            total[n] = cut(reduced(n, rows))
            pending.remove(n)
            progress = True
        if not progress:
            # nothing can ever hold: empty relations, typed as text
            for n in pending:
                total[n] = ctx.spark.createDataFrame([], T.StructType([T.StructField(str(i), T.StringType()) for i in range(len(heads[n]))]))
            break
    delta, grown = dict(total), dict.fromkeys(group, 0)
    schemas = {n: total[n].schema for n in group}
    for _ in range(ctx.most_epochs):
        fresh_rows = {}
        for n in group:
            frames = []
            for head, body in bodies[n]:
                for a in occurrences(body, names):
                    if a.name not in delta:
                        continue
                    others = {id(x): {x.name: total[x.name]} for x in occurrences(body, names)}
                    others[id(a)] = {a.name: delta[a.name]}
                    frames.append(aligned(head_rows(ctx, head, body_rows(ctx, body, others)), schemas[n]))
            if not frames:
                continue
            new = union(frames)
            if n in meets:
                merged = aligned(aggregated(total[n].union(aligned(reduced(n, new), schemas[n])), heads[n], list(total[n].columns), constant), schemas[n])
                merged = cut(merged)
                changed, n_changed = counted(minus(merged, total[n]))
                if n_changed:
                    fresh_rows[n] = (changed, merged)
            else:
                added, n_added = counted(minus(new, total[n]).distinct())  # what is known goes before it is shuffled
                if n_added:
                    fresh_rows[n] = (added, None)
        if not fresh_rows:
            return total
        delta = {n: d for n, (d, _) in fresh_rows.items()}
        for n, (d, merged) in fresh_rows.items():
            total[n] = merged if merged is not None else total[n].union(d)
            grown[n] = 0 if merged is not None else grown[n] + 1
            if grown[n] == MOST_PARTS:  # one table again: a plan does not grow with the epochs
                total[n], grown[n] = cut(total[n]), 0
    raise EngineError("eval::epochs", f"rules {group} did not settle in {ctx.most_epochs} epochs")


def run_rules(ctx: Context, program: ir.Program) -> DataFrame:
    """The entry rule's rows, columns named by its head."""
    rules: dict[str, list] = {}
    for r in program.rules:
        rules.setdefault(r.name, []).append(r)
    if "?" not in rules:
        raise EngineError("parser::no_entry", "the program has no entry rule ?")
    rules = magic.rewritten(rules) if program.magic else rules
    for group, recursive in strata(rules):
        if recursive:
            if any(not isinstance(r, ir.Rule) for n in group for r in rules[n]):
                raise EngineError("parser::mixed", f"{group} mixes recursion with constant or fixed rules")
            ctx.rules.update(fixpoint(ctx, group, rules))
        else:
            ctx.rules[group[0]] = evaluate(ctx, rules[group[0]])
        ctx.steps.append((group, recursive))
    out = ctx.rules["?"]
    labels = [h.label for h in rules["?"][0].head] or [f"_{i}" for i in range(len(out.columns))]
    seen: dict[str, int] = {}
    for i, label in enumerate(labels):
        seen[label] = seen.get(label, 0) + 1
        if seen[label] > 1:
            labels[i] = f"{label}.{seen[label]}"
    return out.toDF(*labels)


def shaped(df: DataFrame, program: ir.Program) -> DataFrame:
    """Order, offset and limit; without an order, the rows that come first by all columns."""
    for label, _ in program.order:
        if label not in df.columns:
            raise EngineError("eval::sort_key", f"no column {label} to sort by")
    if program.order or program.limit is not None or program.offset:
        keys = [col(c).desc() if down else col(c).asc() for c, down in program.order]
        ties = [col(c) for c in df.columns if c not in {c for c, _ in program.order} and orderable(df.schema[c].dataType)]
        df = df.orderBy(*keys, *ties)
    if program.offset:
        df = df.offset(program.offset)
    return df.limit(program.limit) if program.limit is not None else df


def orderable(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType, T.VariantType))
